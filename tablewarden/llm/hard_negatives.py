"""Hard negatives by inner product, exact: summaries of vector segments decide what has to be scored.

Of every vector the mean and the deviation (root of the squared residuals) of each segment of four
components are stored. Over a segment of w components the product of two vectors is w times the
product of their means, plus or minus at most the product of their deviations; so the sums over
all segments bound the score. Coarser segments (16, 64, ... components) follow from the stored
ones. Candidates meet the coarsest bounds first; only those that these cannot decide meet the finer
ones, and what is left is scored exactly in integers.

Anchors and rows are dealt into blocks and every block of anchors meets every block of rows in a
task of its own; a block keeps its best few per anchor, and these are ranked over all blocks. A
first pass finds each anchor's positives, a second one its negatives between the shares low and
high of each positive's score.

Rows with a null vec_id, label or vector, or with a null or non-finite component take no part. Of
rows of one vec_id the least by label, then vector, counts, so repeated rows count once. Ties go to
the smaller vec_id. Of vectors of different lengths the missing components count as zero; an empty
vector scores 0. A positive of negative score has no negatives. An empty table gives no rows, other
columns are not read. Scores that might leave a long are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_cleanup, stored, tasks

RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
WIDTH = 4


@dataclass(frozen=True)
class Mining:
    """How rows are read and dealt: anchors are the rows whose vec_id anchor_every divides, shift_every moves a label by one of `labels`."""

    anchor_every: int = 100
    shift_every: int = 7
    labels: int = 10
    scale: float = 256.0
    positives: int = 5
    negatives: int = 10
    low: int = 30  # percent of a positive's score
    high: int = 90
    anchors_a_block: int = 1024
    rows_a_block: int = 8192
    least_rows: int = 1024  # of a block, where there are more tasks than blocks


def integers(vectors: DataFrame, m: Mining, column: str = "embedding") -> DataFrame:
    """(vec_id, label, v): the rows that take part, one per vec_id."""
    x = F.col(column)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % m.shift_every == 0, (label + 1) % m.labels).otherwise(label)
    rows = vectors.where(F.col("vec_id").isNotNull() & label.isNotNull() & x.isNotNull()).where(F.coalesce(whole, F.lit(False)))
    rows = rows.select("vec_id", F.struct(moved.alias("label"), F.transform(x, lambda c: F.floor(F.lit(m.scale) * c.cast("double"))).alias("v")).alias("r"))
    return rows.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.v")


def dense(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, shorter ones filled with zeros."""
    sizes = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(sizes), width), np.asarray(column.values).dtype if len(column.values) else np.int64)
    flat = np.asarray(column.flatten())
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def listed(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float64())) if values.shape[1] else pa.array([[]] * len(values), pa.list_(pa.float64()))


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds mean and spread of each segment of four components."""
    for b in batches:
        for i in range(0, b.num_rows, 4096):
            part = b.slice(i, 4096)
            longest = int(np.diff(np.asarray(part.column("v").offsets)).max(initial=0))
            v = dense(part.column("v"), -(-longest // WIDTH) * WIDTH).astype(np.float64)
            cut = v.reshape(len(v), v.shape[1] // WIDTH, WIDTH)
            mean = cut.mean(2)
            spread = np.sqrt(((cut - mean[:, :, None]) ** 2).sum(2))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), part.column("v"), listed(mean), listed(spread)], ["vec_id", "label", "v", "mean", "spread"])


@dataclass(frozen=True)
class Side:
    """Rows of a block: their vectors, and mean and spread for each width of segment, coarsest first."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    levels: list[tuple[int, np.ndarray, np.ndarray]]
    norms: np.ndarray


def side(t: pa.Table, width: int) -> Side:
    t = t.combine_chunks()
    column = lambda name: t.column(name).combine_chunks() if t.num_rows else pa.array([], t.schema.field(name).type)
    v, mean, spread = dense(column("v"), width), dense(column("mean"), width // WIDTH), dense(column("spread"), width // WIDTH)
    levels, wide = [(WIDTH, mean, spread)], WIDTH
    while mean.shape[1] > 1:
        more = -mean.shape[1] % 4
        m, s = (np.pad(x, ((0, 0), (0, more))).reshape(len(v), (mean.shape[1] + more) // 4, 4) for x in (mean, spread))
        mean = m.mean(2)
        spread = np.sqrt((s * s).sum(2) + wide * ((m - mean[:, :, None]) ** 2).sum(2))
        wide *= 4
        levels.insert(0, (wide, mean, spread))
    return Side(np.asarray(t.column("vec_id")), np.asarray(t.column("label")), v, levels, np.sqrt((v.astype(np.float64) ** 2).sum(1)))


def best(a: Side, i: int, b: Side, rows: np.ndarray, wants: list[tuple[int | None, int | None]], most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each want (lowest, highest score) the best `most` of b's rows for a's row i, as (places, scores) in order."""
    if not wants or not len(rows):
        return [(rows[:0], rows[:0])] * len(wants)
    lows = [-np.inf if low is None else float(low) for low, _ in wants]
    highs = [np.inf if high is None else float(high) for _, high in wants]
    for (wide, mean, spread), (_, own_mean, own_spread) in zip(b.levels, a.levels):
        if len(rows) <= most:
            break
        middle, reach = wide * (mean[rows] @ own_mean[i]), spread[rows] @ own_spread[i] + 1e-9 * a.norms[i] * b.norms[rows] + 1e-6
        lower, upper, keep = middle - reach, middle + reach, np.zeros(len(rows), bool)
        for low, high in zip(lows, highs):
            sure = lower[(lower >= low) & (upper <= high)]  # surely wanted: the last of the best of these is a score that others have to reach
            cut = np.partition(sure, len(sure) - most)[len(sure) - most] if len(sure) >= most else -np.inf
            keep |= (upper >= max(low, cut)) & (lower <= high)
        rows = rows[keep]
    narrow = a.norms[i] * b.norms[rows].max(initial=0) < 2**52  # every partial sum is below it, so doubles are exact
    score = (b.vectors[rows].astype(np.float64) @ a.vectors[i].astype(np.float64)).astype(np.int64) if narrow else b.vectors[rows] @ a.vectors[i]
    out = []
    for low, high in wants:
        ok = np.ones(len(rows), bool) if low is None else (score >= low) & (score <= high)
        at = np.flatnonzero(ok)
        at = at[np.lexsort((b.ids[rows[at]], -score[at]))[:most]]
        out.append((rows[at], score[at]))
    return out


def both(anchors: pa.Table, rows: pa.Table) -> tuple[Side, Side]:
    segments = max((int(np.diff(np.asarray(c.offsets)).max(initial=0)) for t in (anchors, rows) for c in t.column("mean").chunks), default=0)  # of the longest vector summed up together with these
    width = max(segments, 1) * WIDTH
    a, b = side(anchors, width), side(rows, width)
    if a.norms.max(initial=0) * b.norms.max(initial=0) >= 2**62:
        raise ValueError("scores might leave a long")
    return a, b


def meetings(anchors: DataFrame, rows: DataFrame, m: Mining, n_anchors: int, n_rows: int):
    """Anchors and rows grouped so that every block of anchors meets every block of rows."""
    across = max(1, -(-n_anchors // m.anchors_a_block))
    down = max(1, -(-n_rows // m.rows_a_block), min(tasks(rows.sparkSession), -(-n_rows // m.least_rows)))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("_a", block(across)).select("*", every(down).alias("_b"))
    right = rows.withColumn("_b", block(down)).select("*", every(across).alias("_a"))
    return left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b"))


def first_by_score(df: DataFrame, keys: list[str], other: str, score: str, most: int) -> DataFrame:
    rank = f"row_number() over (partition by {', '.join(keys)} order by {score} desc, {other})"
    return df.selectExpr("*", f"cast({rank} as int) as rank").where(F.col("rank") <= most)


def mine(vectors: DataFrame, mining: Mining | None = None, column: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score."""
    m = mining or Mining()
    rows = stored(integers(vectors, m, column).mapInArrow(summaries, "vec_id bigint, label bigint, v array<bigint>, mean array<double>, spread array<double>"))
    anchors = rows.where(F.col("vec_id") % m.anchor_every == 0)
    n_rows, n_anchors = rows.count(), anchors.count()

    def positives(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = both(left, right)
        out = ([], [], [])
        for i in range(len(a.ids)):
            (at, score), = best(a, i, b, np.flatnonzero((b.labels == a.labels[i]) & (b.ids != a.ids[i])), [(None, None)], m.positives)
            for x, y in zip(out, (np.full(len(at), a.ids[i]), b.ids[at], score)):
                x.append(y)
        return table(out, ["anchor_id", "positive_id", "positive_score"])

    def negatives(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = both(left, right)
        out = ([], [], [], [], [])
        found = left.column("found").to_pylist()
        for i in range(len(a.ids)):
            wants = [(-(-m.low * p["positive_score"] // 100), m.high * p["positive_score"] // 100) for p in found[i]]
            for p, (at, score) in zip(found[i], best(a, i, b, np.flatnonzero(b.labels != a.labels[i]), wants, m.negatives)):
                n = len(at)
                for x, y in zip(out, (np.full(n, a.ids[i]), np.full(n, p["positive_id"]), np.full(n, p["positive_score"]), b.ids[at], score)):
                    x.append(y)
        return table(out, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    with shuffle_cleanup(vectors.sparkSession):
        near = meetings(anchors, rows, m, n_anchors, n_rows).applyInArrow(positives, "anchor_id bigint, positive_id bigint, positive_score bigint")
        chosen = first_by_score(near, ["anchor_id"], "positive_id", "positive_score", m.positives).groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("found"))  # a few per anchor
        asked = stored(anchors.join(chosen, anchors["vec_id"] == chosen["anchor_id"]).drop("anchor_id"))
        far = meetings(asked, rows, m, n_anchors, n_rows).applyInArrow(negatives, "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
        return stored(first_by_score(far, ["anchor_id", "positive_id"], "negative_id", "negative_score", m.negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def table(columns: tuple, names: list[str]) -> pa.Table:
    return pa.table({k: pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for k, c in zip(names, columns)})
