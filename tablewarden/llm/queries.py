"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroid_clusters, compact_windows, fingerprints, hard_negatives, jaccard_join, licence_scan, nn_descent, packing, piece_coder, recurrent_lm, suffix_dedup, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_versions(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.near_passages(table(spark, sf_dir, "documents"))


def op3_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.score_documents(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_coder.code_documents(table(spark, sf_dir, "documents"), token_file("piece_bpe_32k.model"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup(docs).drop("text")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), token_file("byte_bpe_50k.json"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(table(spark, sf_dir, "pages"))


def op11_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.cluster(table(spark, sf_dir, "embeddings"))


def op13_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_approximate_nearest_neighbours": op3_approximate_nearest_neighbours,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_toxicity": op7_toxicity,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_warc": op10_warc,
    "op11_hard_negative_mining": op11_hard_negative_mining,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_licence_scans": op13_licence_scans,
}


def _whole(scale: int) -> str:
    return f"list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint))"


_FINITE = "embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)"
_NEGATIVES = f"""with v as (select vec_id, unnest(min({{'label': case when vec_id % 7 = 0 then (label + 1) % 10 else label end, 'v': {_whole(256)}}})) from embeddings
  where vec_id is not null and label is not null and {_FINITE} group by vec_id),
s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as alike, cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) as bigint) as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, other as positive_id, score as positive_score from s where alike qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
n as (select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other) as int) as rank, s.other as negative_id, p.positive_score, s.score as negative_score
  from p join s on s.anchor_id = p.anchor_id and not s.alike and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score)
select * from n where rank <= 10"""


def _clusters_sql(k: int = 16, rounds: int = 3, dim: int = 64) -> str:
    """The assignment of every round as a common table expression of its own; sums are divided rounding down."""
    near = "near{r} as (select r, cluster, distance from (select v.r, c.cluster, list_sum(list_transform(range(1, {d} + 1), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i]))) as distance from v, c{r} c) qualify row_number() over (partition by r order by distance, cluster) = 1)"
    moved = "m{n} as (select cluster, i, sum(x) as s, count(*) as n from (select near{r}.cluster, t.i, v.v[t.i] as x from near{r} join v using (r), range(1, {d} + 1) t(i)) group by cluster, i), f{n} as (select cluster, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as v from m{n} group by cluster), c{n} as (select c{r}.cluster, coalesce(f{n}.v, c{r}.v) as v from c{r} left join f{n} using (cluster))"
    steps = [f"v as (select row_number() over (order by vec_id, embedding) as r, vec_id, {_whole(dim)} as v from embeddings where len(embedding) = {dim} and {_FINITE})",
             f"c0 as (select row_number() over (order by h nulls last, v) - 1 as cluster, v from (select sha256(concat('1:', vec_id)) as h, v from v order by h nulls last, v limit {k}))"]
    for r in range(rounds):
        steps += [near.format(r=r, d=dim), moved.format(r=r, n=r + 1, d=dim)]
    steps.append(near.format(r=rounds, d=dim))
    return f"with {', '.join(steps)} select v.vec_id, cast(cluster as int) as cluster, cast(distance as bigint) as distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(c{rounds}.v, ',')) as centroid_sha256 from near{rounds} join v using (r) join c{rounds} using (cluster)"


SQL: dict[str, str] = {"op11_hard_negative_mining": _NEGATIVES, "op12_centroid_clustering": _clusters_sql()}
