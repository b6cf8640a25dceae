"""Toxicity of texts: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Each text is the set of its hashed character n-grams. On the labelled rows, ratios
r = log P(n-gram | toxic) / P(n-gram | clean) are counted; those that stand out
statistically are kept, and a logistic regression over r-scaled presence gives the score.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, stored


@dataclass(frozen=True)
class Settings:
    """max_rows bounds the labelled rows that are learned from; 2**bits is the number of n-gram buckets."""

    orders: tuple[int, ...] = (3, 5)
    bits: int = 18
    max_rows: int = 12_000
    max_features: int = 4096
    least_z: float = 3.0
    smoothing: float = 1.0
    l2: float = 1e-3
    steps: int = 400
    threshold: float = 0.3


@dataclass(frozen=True)
class Model:
    settings: Settings
    slot: np.ndarray  # for each bucket its place among the kept features, or -1
    weight: np.ndarray  # r times the learned weight, by place
    bias: float


class Grams:
    """The distinct hashed n-grams of one text at a time; the table remembers where a bucket was last seen."""

    def __init__(self, settings: Settings):
        self.settings, self.seen, self.clock = settings, np.zeros(1 << settings.bits, np.int64), 1

    def __call__(self, text: str) -> np.ndarray:
        points = np.frombuffer(f"\n{text}\n".lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        parts = []
        for n in self.settings.orders:
            if len(points) >= n:
                h = np.full(len(points) - n + 1, n, np.uint64)
                for k in range(n):
                    h = h * U64(0xD1342543DE82EF95) + points[k : len(points) - n + 1 + k]
                parts.append((mix(h) >> U64(64 - self.settings.bits)).astype(np.int64))
        found = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        stamp = np.arange(self.clock, self.clock + len(found))
        self.clock += len(found)
        self.seen[found] = stamp
        return found[self.seen[found] == stamp]


def labelled_sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """At most max_rows labelled documents, those first by a hash of doc_id; rows without a usable label and ids with contrary labels teach nothing. Of several texts of one doc_id the least by hash teaches."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    # thinned by the same hash first, with a third to spare, so that the last sort is as small as the sample
    share = min(1.0, 1.3 * settings.max_rows / max(1, usable.count()))
    usable = usable.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 33) < int(share * 2**31))
    chosen = usable.select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 33), "doc_id").limit(settings.max_rows)
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic")


def log_count_ratios(counts: np.ndarray, rows: np.ndarray, smoothing: float) -> tuple[np.ndarray, np.ndarray]:
    """r and its z-score for counts[class, bucket] of documents, out of rows[class]."""
    with_gram, without = counts + smoothing, rows[:, None] - counts + smoothing
    share = with_gram / with_gram.sum(axis=1, keepdims=True)
    odds = np.log(with_gram[1] / without[1]) - np.log(with_gram[0] / without[0])
    return np.log(share[1] / share[0]), odds / np.sqrt((1 / with_gram + 1 / without).sum(axis=0))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from the labelled rows (labels: doc_id, toxic 0/1). With one class or none, every score is the smoothed share of toxic rows."""
    spark = docs.sparkSession

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Grams(settings)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array([find(x).astype(np.int32).tobytes() for x in part.column("text").to_pylist()], pa.binary())], ["toxic", "grams"])

    found = stored(labelled_sample(docs, labels, settings).mapInArrow(grams, "toxic int, grams binary"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, (1 << settings.bits) + 1), np.int64)
        for b in batches:
            for toxic, x in zip(b.column("toxic").to_pylist(), b.column("grams").to_pylist()):
                n[toxic, np.frombuffer(x, np.int32)] += 1
                n[toxic, -1] += 1  # of rows
        used = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[0, used]), pa.array(n[1, used])], ["bucket", "clean", "toxic"])

    summed = found.mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()  # at most 2**bits + 1 rows
    counts = np.zeros((2, (1 << settings.bits) + 1))
    counts[:, summed["bucket"].to_numpy(np.int64)] = summed[["clean", "toxic"]].to_numpy(np.float64).T
    rows, counts = counts[:, -1], counts[:, :-1]
    slot = np.full(1 << settings.bits, -1, np.int64)
    base = float(np.log((rows[1] + 1) / (rows[0] + 1)))
    if not rows.all():
        return Model(settings, slot, np.zeros(0), base)
    ratio, z = log_count_ratios(counts, rows, settings.smoothing)
    kept = np.argsort(-np.abs(z), kind="stable")[: settings.max_features]
    kept = np.sort(kept[np.abs(z[kept]) >= settings.least_z])
    slot[kept] = np.arange(len(kept))
    shared = spark.sparkContext.broadcast(slot)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [shared.value[np.frombuffer(x, np.int32)] for x in b.column("grams").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([np.sort(x[x >= 0]).astype(np.int16).tobytes() for x in at], pa.binary())], ["toxic", "kept"])

    sample = found.mapInArrow(select, "toxic int, kept binary").toPandas().sort_values(["toxic", "kept"])  # at most max_rows rows of max_features
    weight, bias = logistic([np.frombuffer(x, np.int16).astype(np.int64) for x in sample["kept"]], sample["toxic"].to_numpy(np.float64), ratio[kept], base, settings)
    return Model(settings, slot, weight, bias)


def logistic(rows: list[np.ndarray], label: np.ndarray, ratio: np.ndarray, bias: float, settings: Settings) -> tuple[np.ndarray, float]:
    """Logistic regression over ratio-scaled presence by full-batch Adam; returns ratio times weight, and the bias."""
    if not len(ratio):
        return np.zeros(0), bias
    at, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    x = np.concatenate([np.full(len(ratio), 1.0 / np.sqrt(len(ratio))), [bias]])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, settings.steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, (ratio * x[:-1])[at], len(rows)) + x[-1], -50, 50)))
        miss = (p - label) / len(rows)
        grad = np.append(np.bincount(at, miss[row], len(ratio)) * ratio + settings.l2 * x[:-1] / len(ratio), miss.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return ratio * x[:-1], float(x[-1])


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score (0 to 1) and predicted under the given names; only the text column decides. Null text: as empty. Columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def toxic(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        find = Grams(m.settings)
        for batch in texts:
            total = np.empty(len(batch))
            for i in range(0, len(batch), 64):  # few texts at a time become Python strings
                for k, x in enumerate(batch.slice(i, 64).to_pylist(), i):
                    at = m.slot[find(x or "")]
                    total[k] = m.weight[np.sort(at[at >= 0])].sum() + m.bias
            yield pa.array(1 / (1 + np.exp(-np.clip(total, -50, 50))), pa.float64())

    return docs.withColumn(names[0], toxic(F.col("text").cast("string"))).withColumn(names[1], (F.col(names[0]) >= model.settings.threshold).cast("int"))


def held_out(doc_id: str = "doc_id"):
    """A fixed quarter of documents that labels are never learned from; a null doc_id is not among them."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, learned from labels outside the held-out quarter.

    Null or empty texts are scored as empty; repeated rows each get their row; null doc_ids are
    scored but teach nothing; with no labels every score is 0.5. Other columns are ignored.
    """
    model = fit(docs, labels.where(~held_out()), settings)
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
