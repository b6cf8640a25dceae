"""K-means over integer vectors, exact: every vector searches a vantage-point tree of the centroids.

Each round builds a tree over the centroids on the driver (k points, a fixed number) and
broadcasts it. A vector opens the tree's nodes best first: a node's lower bound comes from the
triangle inequality at its parent's vantage point, a node is passed over only if its bound lies
beyond the best distance found (equal bounds are opened), and distances to vantage points and to
the members of leaves are exact integers, ties going to the smaller centroid. Tasks send a count
and a sum per centroid; centroids become floor(sum / count) in exact integers.

Vectors of another length, null, or with a null or non-finite component take no part. Repeated
rows count each, rows of a null vec_id are assigned too but are the last choice as first
centroids; fewer vectors than centroids give fewer centroids, an empty table gives no rows. Other
columns of the input are not read. A component whose scaled floor passes 2^26 is an error, as its
squared distances need not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_cleanup, stored

RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
WIDEST = 1 << 26


@dataclass(frozen=True)
class Node:
    """A leaf with members, or a vantage point with two children and the span of distances from it to each child's points."""

    members: tuple[int, ...] = ()
    vantage: int = -1
    children: tuple[int, ...] = ()
    spans: tuple[tuple[float, float], ...] = ()


@dataclass(frozen=True)
class Tree:
    points: np.ndarray
    nodes: list[Node]


def build(points: np.ndarray, leaf: int = 2) -> Tree:
    """The vantage point of a node is the one whose distances to the others differ most; the nearer half goes to the first child."""
    gaps = points[:, None, :] - points[None, :, :]
    far = np.sqrt((gaps * gaps).sum(2).astype(np.float64))
    nodes: list[Node] = []

    def grow(members: list[int]) -> int:
        at = len(nodes)
        nodes.append(Node(members=tuple(members)))
        if len(members) <= leaf:
            return at
        vantage = max(members, key=lambda m: (float(far[m, members].var()), -m))
        rest = [m for m in members if m != vantage]
        middle = float(np.median(far[vantage, rest]))
        halves = [[m for m in rest if far[vantage, m] <= middle], [m for m in rest if far[vantage, m] > middle]]
        if halves[1]:  # else all lie at one distance and stay a leaf
            spans = tuple((float(far[vantage, h].min()), float(far[vantage, h].max())) for h in halves)
            children = tuple(map(grow, halves))
            nodes[at] = Node(vantage=vantage, children=children, spans=spans)
        return at

    grow(list(range(len(points))))
    return Tree(points, nodes)


def nearest(tree: Tree, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each vector; each follows its own best-first order, all step together."""
    n, row = len(vectors), np.arange(len(vectors))
    bound = np.full((n, len(tree.nodes)), np.inf)
    bound[:, 0] = 0
    best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, len(tree.points))

    def meet(rows: np.ndarray, centroid: int) -> np.ndarray:
        gap = vectors[rows] - tree.points[centroid]
        d = np.einsum("ij,ij->i", gap, gap)
        better = (d < best[rows]) | ((d == best[rows]) & (centroid < number[rows]))
        best[rows[better]], number[rows[better]] = d[better], centroid
        return np.sqrt(d.astype(np.float64))

    while len(row):
        pick = bound[row].argmin(1)
        low = bound[row, pick]
        open_ = np.isfinite(low) & (low <= np.sqrt(best[row].astype(np.float64)) * (1 + 1e-9) + 1e-6)  # inclusive, with room for rounding
        row, pick = row[open_], pick[open_]
        for k in np.unique(pick):
            rows, node = row[pick == k], tree.nodes[k]
            lower = bound[rows, k]
            bound[rows, k] = np.inf
            for m in node.members:
                meet(rows, m)
            if node.children:
                d = meet(rows, node.vantage)
                for child, (least, most) in zip(node.children, node.spans):
                    bound[rows, child] = np.maximum(lower, np.maximum(least - d, d - most) * (1 - 1e-9))
    return number, best


def integers(vectors: DataFrame, dim: int, scale: float, column: str) -> DataFrame:
    """(vec_id, v): the vectors that take part, as integers."""
    x = F.col(column)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.where(x.isNotNull() & (F.size(x) == dim)).where(F.coalesce(whole, F.lit(False))).select("vec_id", F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    out = np.asarray(column.flatten()).reshape(-1, dim)
    if len(out) and max(int(out.max()), -int(out.min())) > WIDEST:
        raise ValueError(f"a component lies beyond {WIDEST}")
    return out


def pieces(batches: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, most):
            yield b.slice(i, most)


def next_centroids(vectors: DataFrame, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """One round: count and sum per task and centroid, added up, then floor(sum / count); centroids without vectors stay."""
    tree = vectors.sparkSession.sparkContext.broadcast(build(np.array(centroids, np.int64)))

    def sums(batches):
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dim), np.int64)
        for b in pieces(batches):
            v = matrix(b.column("v"), dim)
            number, _ = nearest(tree.value, v)
            count += np.bincount(number, minlength=len(centroids))
            np.add.at(total, number, v)
        for k in np.flatnonzero(count):
            yield pa.RecordBatch.from_pydict({"cluster": pa.array([k], pa.int32()), "n": pa.array([count[k]], pa.int64()), "total": pa.array([total[k].tolist()], pa.list_(pa.int64()))})

    per_task = vectors.mapInArrow(sums, "cluster int, n bigint, total array<bigint>")
    added = per_task.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i].cast("decimal(38,0)")) for i in range(dim))).alias("total"))
    out = list(centroids)
    for r in added.collect():  # one row per centroid
        out[r["cluster"]] = [int(t) // r["n"] for t in r["total"]]
    tree.destroy()
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, seed: int = 1, column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    kept = stored(integers(vectors, dim, scale, column))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centroids = [list(r["v"]) for r in kept.orderBy(order.asc_nulls_last(), "v").limit(k).collect()]  # k rows
    if not centroids:
        return spark.createDataFrame([], RESULT)
    with shuffle_cleanup(spark):
        for _ in range(rounds):
            centroids = next_centroids(kept, centroids, dim)
    tree = spark.sparkContext.broadcast(build(np.array(centroids, np.int64)))

    def assigned(batches):
        for b in pieces(batches):
            number, best = nearest(tree.value, matrix(b.column("v"), dim))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(number, pa.int32()), pa.array(best, pa.int64())], ["vec_id", "cluster", "distance"])

    last = stored(kept.mapInArrow(assigned, "vec_id bigint, cluster int, distance bigint"))
    inertia = {r["cluster"]: r["d"] for r in last.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # one row per centroid
    named = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    facts = spark.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return last.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
