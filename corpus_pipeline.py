"""Corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Toxic documents go, one document of each group of near duplicates stays, passages that an
earlier document holds are cut out, and what is left is packed into token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm import jaccard_join, packing, queries, suffix_dedup, toxicity
from tablewarden.llm.common import dropped, fresh_names, small_broadcasts, stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels outside the held-out quarter, does not reject.

    Null and empty texts are scored as empty ones. Repeated rows are judged each, alike. Columns
    of docs named score or predicted are neither read nor changed. No rows give no rows.
    """
    model = toxicity.fit(docs, queries.table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    names = tuple(fresh_names(docs, 2))
    return toxicity.score(docs, model, names).where(F.col(names[1]) == 0).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group linked by shingle similarity the row with the smallest doc_id (null last; ties: by hash of the row).

    Rows are linked under ids of their own, so rows of different texts stay apart whatever their
    doc_id, null or repeated. Texts without shingles (null, empty, blank) are linked with nothing
    and stay; only repeats of one doc_id with such a text count once. No rows give no rows.
    The result is written: so neither the numbered rows nor what their join shuffles is left on disk for later stages.
    """
    row, = fresh_names(docs, 1)
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.xxhash64(*docs.columns), row)
    groups = jaccard_join.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(f"{row}_g"), F.col("n_shingles").alias(f"{row}_n"), F.col("component_id").alias(f"{row}_c"))
    shingled = F.col(f"{row}_n") > 0
    kind = F.when(shingled, 0).when(F.col("doc_id").isNotNull(), 1).otherwise(2).alias("kind")
    group = F.when(shingled, F.col(f"{row}_c")).when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text", F.col("text").isNull())).otherwise(F.col(row)).alias("group")
    kept = rows.join(groups, rows[row] == F.col(f"{row}_g")).groupBy(kind, group).agg(F.min_by(row, order).alias(row))
    with small_broadcasts(spark):
        out = stored(rows.join(kept, row, "left_semi").select(*docs.columns))
    dropped(rows)
    return out


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that a document with a smaller doc_id holds; n_chars, where there is one, follows.

    Null texts stay null, a text that is cut away whole becomes empty. Rows of a null doc_id lose
    nothing, rows of one doc_id are not earlier than each other. No rows give no rows.
    """
    cut = suffix_dedup.dedup(docs, keep_text=True, report=False)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return cut.select(*docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left in token sequences; one row per piece. Null and empty texts are one piece of the end id, repeated rows are packed each, no rows give no rows."""
    return packing.pack(docs, queries.token_file("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity_stage), ("ngram_jaccard_join", near_duplicate_stage), ("suffix_array_dedup", repeated_passage_stage), ("best_fit_packing", pack_stage)]
#: The classifier's decisions and the packing are not to be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES) and stage is not near_duplicate_stage:  # its rows are written already
            docs = stored(docs)
    return docs
