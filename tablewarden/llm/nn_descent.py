"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node. The graph starts from random-projection leaves and improves by
local joins: around every node its neighbours (both ways) are compared with each other, in
float32, and each keeps the nearest it has met. A query walks the graph: of its pool
the nearest nodes not yet expanded give their neighbours, until the pool is all expanded.
Final distances are exact, on the original vectors in double precision.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored


@dataclass(frozen=True)
class Settings:
    neighbours: int = 32  # kept of each node
    trees: int = 4
    leaf: int = 96
    rounds: int = 6  # of local joins at most
    settled: float = 0.001  # a round that renews a smaller share of the edges is the last
    around: int = 64  # of a node's reverse neighbours, those compared in one round
    pool: int = 400
    step: int = 32  # nodes a query expands at a time
    entries: int = 32


EDGES = "node long, other long, d double"


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): vectors that are not null, not zero, all finite, and of the commonest dimension."""
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(embedding, lambda x: x.cast("double")).alias("v"))
    rows = rows.where(v.isNotNull() & F.col("vec_id").isNotNull() & (F.size(v) > 0)
                      & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    first = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), "n").first()
    return rows.where(F.size("v") == (first["n"] if first else 0))


def best(rows: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """The k first rows of every key."""
    names = ", ".join(order)
    return rows.selectExpr("*", f"row_number() over (partition by {key} order by {names}) as _k").where(f"_k <= {k}").drop("_k")


def nodes_and_members(vectors: DataFrame, members: int) -> tuple[DataFrame, DataFrame]:
    """nodes (node, v, code) of distinct vectors, named by their least vec_id, and up to `members` least vec_ids of each (node, vec_id). A hot vector's ids are cut down in salted parts first."""
    named = vectors.withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")}).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    distinct = named.groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.first("v").alias("v"))
    nodes = stored(distinct)
    ids = best(best(named.select("h1", "h2", "salt", "vec_id").distinct(), "h1, h2, salt", ["vec_id"], members), "h1, h2", ["vec_id"], members)
    return nodes.select("node", "v"), stored(ids.join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("node", "vec_id"))


def _matrix(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def _squares(x: np.ndarray) -> np.ndarray:
    norm = (x * x).sum(1)
    return np.maximum(norm[:, None] + norm[None, :] - 2 * (x @ x.T), 0)


def coded(nodes: DataFrame) -> DataFrame:
    """(node, code): the components as float32, whatever their range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.finfo(np.float32).max
        for b in batches:
            if b.num_rows:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                code = np.clip(x, -top, top).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([r.tobytes() for r in code], pa.binary())], ["node", "code"])

    return stored(nodes.mapInArrow(run, "node long, code binary"))


def first_graph(codes: DataFrame, count: int, s: Settings) -> DataFrame:
    """Nearest within the leaves of random-projection trees; a leaf larger than planned is dealt to parts at random."""
    bits = max(0, int(np.ceil(np.log2(max(1, count / s.leaf)))))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("code").to_pylist(), np.float32).astype(np.float64)
            for t in range(s.trees):
                plane = np.random.default_rng(t).standard_normal((x.shape[1], bits)).astype(np.float32)
                leaf = ((x @ plane > 0) @ (1 << np.arange(bits, dtype=np.int64))) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t)), pa.array(leaf), b.column("node"), b.column("code")], ["tree", "leaf", "node", "code"])

    rows = codes.mapInArrow(leaves, "tree long, leaf long, node long, code binary")
    sizes = rows.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / F.lit(2 * s.leaf)).alias("parts"))
    dealt = rows.join(sizes, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))

    def nearest(group: pd.DataFrame) -> pd.DataFrame:
        d = _squares(_matrix(group["code"], np.float32).astype(np.float64))
        np.fill_diagonal(d, np.inf)
        k = min(s.neighbours, len(d) - 1)
        at = np.argpartition(d, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(d), 0), np.int64)
        ids = group["node"].to_numpy()
        return pd.DataFrame({"node": np.repeat(ids, k), "other": ids[at.ravel()], "d": np.take_along_axis(d, at, 1).ravel()})

    return dealt.groupBy("tree", "leaf", "part").applyInPandas(nearest, EDGES)


def improve(edges: DataFrame, codes: DataFrame, s: Settings) -> DataFrame:
    """One local join: edges (node, other, d, fresh) become better ones; fresh marks what was found now."""
    worst = edges.groupBy("node").agg(F.max("d").alias("worst"), F.count("*").alias("have"))
    known = codes.join(worst, "node", "left").select(F.col("node").alias("other"), "code", F.when(F.col("have") >= s.neighbours, F.col("worst")).otherwise(F.lit(float("inf"))).alias("worst"))
    back = best(edges.select(F.col("other").alias("node"), F.col("node").alias("other"), "fresh", F.xxhash64("node", "other").alias("turn")), "node", ["not fresh", "turn"], s.around).drop("turn")
    near = edges.select("node", "other", "fresh").unionByName(back).groupBy("node", "other").agg(F.max("fresh").alias("fresh"))
    around = near.join(known, "other").groupBy("node").agg(F.collect_list(F.struct("other", "fresh", "worst", "code")).alias("near"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("near")
            flat, cut = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            ids, fresh, worst = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("other", "fresh", "worst"))
            x = _matrix(flat.field("code").to_pylist(), np.float32).astype(np.float64)
            found = []
            for a, z in zip(cut[:-1], cut[1:]):
                d = _squares(x[a:z])
                better = (fresh[a:z, None] | fresh[None, a:z]) & (d < worst[a:z, None])
                np.fill_diagonal(better, False)
                i, j = np.nonzero(better)
                found.append((ids[a:z][i], ids[a:z][j], d[i, j]))
            cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.float64))], ["node", "other", "d"])

    met = around.mapInArrow(compare, EDGES).groupBy("node", "other").agg(F.min("d").alias("d")).withColumn("fresh", F.lit(True))
    both = edges.withColumn("fresh", F.lit(False)).unionByName(met).groupBy("node", "other").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    return stored(best(both, "node", ["d", "other"], s.neighbours))


def build_graph(nodes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(node, other): the neighbour graph of nodes (node, v), both ways."""
    codes = coded(nodes)
    start = first_graph(codes, codes.count(), s).groupBy("node", "other").agg(F.min("d").alias("d"))
    edges = stored(best(start, "node", ["d", "other"], s.neighbours).withColumn("fresh", F.lit(True)))
    for _ in range(s.rounds):
        edges = improve(edges, codes, s)
        many, renewed = edges.agg(F.count("*"), F.count_if("fresh")).first()
        if renewed <= s.settled * many:
            break
    back = best(edges.select(F.col("other").alias("node"), F.col("node").alias("other"), "d"), "node", ["d", "other"], s.neighbours)
    return stored(edges.select("node", "other").unionByName(back.select("node", "other")).distinct())


def distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(query_id, node, score): the pool of every query (query_id, v, and own: its own node or null) after a greedy walk."""
    entries = [r["node"] for r in nodes.select("node").orderBy(F.xxhash64("node")).limit(s.entries).collect()]
    everywhere = F.explode(F.array(*map(F.lit, entries)).cast("array<bigint>"))
    start = queries.select("query_id", everywhere.alias("node")).unionByName(queries.where("own is not null").select("query_id", F.col("own").alias("node")))
    vectors = nodes.select("node", F.col("v").alias("nv"))

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.distinct().join(vectors, "node").join(queries.select("query_id", "v"), "query_id").select("query_id", "node", distance("v", "nv").alias("score"))

    pool = stored(best(scored(start), "query_id", ["score", "node"], s.pool).withColumn("expanded", F.lit(False)))
    more = True
    while more:  # ends: a pool only gets nearer, and no node of it is expanded twice
        now = best(pool.where("not expanded"), "query_id", ["score", "node"], s.step).select("query_id", "node")
        reached = now.join(graph, "node").select("query_id", F.col("other").alias("node")).distinct().join(pool.select("query_id", "node"), ["query_id", "node"], "left_anti")
        marked = pool.join(now.withColumn("now", F.lit(True)), ["query_id", "node"], "left").select("query_id", "node", "score", (F.col("expanded") | F.coalesce("now", F.lit(False))).alias("expanded"))
        pool = stored(best(marked.unionByName(scored(reached).withColumn("expanded", F.lit(False))), "query_id", ["score", "node"], s.pool))
        more = not pool.where("not expanded").isEmpty()
    return pool.select("query_id", "node", "score")


def nearest_neighbours(vectors: DataFrame, k: int = 10, every: int = 100, s: Settings = Settings(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by `every` its k nearest found among all others, by Euclidean distance, ties to the smaller id.

    Vectors that are null, zero, of another dimension than most, or hold nulls or non-finite
    components take no part. Of rows of one id the least vector counts. Other columns are
    ignored. An empty table gives an empty result; with k others or fewer, all are returned.
    """
    rows = stored(usable(vectors, vec_id, embedding).groupBy("vec_id").agg(F.min("v").alias("v")))
    nodes, members = nodes_and_members(rows, k + 1)
    graph = build_graph(nodes, s)
    own = nodes.select(F.col("node").alias("own"), F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"))
    queries = rows.where(f"vec_id % {every} = 0").withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")}).join(own, ["h1", "h2"])
    queries = stored(queries.select(F.col("vec_id").alias("query_id"), "v", "own"))
    found = search(queries, nodes, graph, s).join(members, "node").where("vec_id <> query_id")
    ranked = found.selectExpr("query_id", "row_number() over (partition by query_id order by score, vec_id) as rank", "vec_id", "score")
    return ranked.where(f"rank <= {k}")
