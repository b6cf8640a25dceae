"""Helpers shared by the operators: shared scratch tables, Arrow text buffers, word and byte hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
MIX = (U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB))
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SMALL, BROADCASTS = 256 << 10, ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that all executors share, spark.checkpoint.dir; where that is unset, a local one for local sessions and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: a folder that all executors share is needed")
        base = tempfile.gettempdir() + "/checkpoints"
    return f"{base.rstrip('/')}/tablewarden-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Within it, these settings of the session hold; afterwards those of before."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffle_cleanup(spark: SparkSession):
    """Within it, a finished query's shuffle files are removed at once, so that steps do not add up on disk."""
    return settings(spark, {CLEANUP: "true"})


def small_broadcasts(spark: SparkSession):
    """Within it, only tables of at most SMALL bytes are broadcast unasked: a broadcast is built in the driver, several times as large as its files, and steps of many joins would fill its memory with them."""
    set_now = {k: v for k in BROADCASTS if (v := spark.conf.get(k, None)) is not None or k == BROADCASTS[0]}
    return settings(spark, {k: str(SMALL) for k, v in set_now.items() if v is None or size_of(v) > SMALL})


def size_of(text: str) -> int:
    """Bytes of a setting such as 10485760b, 256k or -1."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgt".index(unit or " ")


def stored(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: it cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    with shuffle_cleanup(spark):
        df.write.partitionBy(*(partition_by or [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the files of a table that stored() wrote, once all that reads it is written."""
    files = df.inputFiles()
    if files:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh_names(df: DataFrame, many: int) -> list[str]:
    """Column names that df does not have, in any spelling of letters."""
    taken = {c.lower() for c in df.columns}
    return [c for c in (f"_own{i}" for i in range(many + len(taken))) if c not in taken][:many]


def parts_of(docs: DataFrame, most: int = 16 << 20) -> int:
    """Into how many parts docs (text) are dealt so that each gets about so many bytes of text; not less than the shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(tasks(docs.sparkSession), -(-total // most))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and the n + 1 offsets of its rows, without copying the texts."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    big = pa.large_string() if pa.types.is_string(column.type) else pa.large_binary() if pa.types.is_binary(column.type) else column.type
    column = column.cast(big)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of at most so many bytes each (one row may be longer)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def small_batches(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many bytes of text (one text may be longer), so that a worker's memory is bounded."""
    for b in batches:
        _, offsets = utf8(b.column("text"))
        for i, j in slices(offsets, most):
            yield b.slice(i, j - i)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> U64(30))) * MIX[0]
    x = (x ^ (x >> U64(27))) * MIX[1]
    return x ^ (x >> U64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
BASE = U64(0xD1342543DE82EF95)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))


@lru_cache(maxsize=2)
def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(n, BASE_INVERSE if inverse else BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and the inverse powers that make a range's hash independent of its place."""
    n = 1 << max(20, int(len(data)).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(n)[: len(data)], out=sums[1:])
    return sums, powers(n, True)


def range_hash(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


#: The six separators of the word rule: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LOWER_BYTES = LOWER.tobytes()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the index of its first word (n + 1 values)."""
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.ones(len(data) + 1, bool)
    before[1:] = gap[:-1]
    start = np.flatnonzero(~gap & (before | first))
    after = np.ones(len(data), bool)
    after[:] = gap[1:] | first[1:]
    end = np.flatnonzero(~gap[:-1] & after) + 1
    return start, end, np.searchsorted(start, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each row's word n-grams (A-Z lowered; fewer words: the whole sequence as one; none: none), with repeats, and the rows' n + 1 offsets into them."""
    data = LOWER[data]
    start, end, row = words(data, offsets)
    sums, inverse = prefix_hash(data)
    word = range_hash(sums, inverse, start, end)
    count = np.diff(row)
    out = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    off = np.concatenate([[0], np.cumsum(out)])
    at = np.arange(off[-1]) + np.repeat(row[:-1] - off[:-1], out)
    have = np.repeat(np.minimum(count, size), out)
    h = np.zeros(off[-1], np.uint64)
    for k in range(size):
        part = word[np.minimum(at + k, max(len(word) - 1, 0))] if len(word) else h
        h = np.where(k < have, mix(h + part + U64(k + 1)), h)
    return h, off


def binary(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
