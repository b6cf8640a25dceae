"""Token sequences packed by minimum bin slack.

Documents are tokenized once into pieces of at most `capacity` tokens. Only the histogram
of piece lengths (at most `capacity` numbers) reaches the driver; there a bitset subset-sum
search finds, bin after bin, the fullest combination of available lengths, and a
combination is used as often as its lengths last. Pieces then take their places by rank
among the pieces of their length, without any global sort.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tasks

PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def _encoders(path: str):
    """The tokenizer file itself, and its vocabulary in the faster byte-pair coder."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    letters = {c: b for b, c in byte_letters().items()}
    special = {i for i, t in slow.get_added_tokens_decoder().items() if t.special}
    ranks = {bytes(letters[c] for c in token): i for token, i in slow.get_vocab().items() if i not in special}
    return slow, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


#: Texts with other letters, with what may be a special token, or with runs that the faster coder's pattern cannot walk, go to the tokenizer file's own library.
UNUSUAL = re.compile("[^\\x00-\u024f]|<\\||\\s{400}|\\S{4000}")


def encode(path: str, texts: list[str]) -> list[np.ndarray]:
    """Byte-level BPE ids of whole texts, as the tokenizer file gives them without special tokens added."""
    slow, fast = _encoders(path)
    return [np.array(slow.encode(x, add_special_tokens=False).ids if UNUSUAL.search(x) else fast.encode_ordinary(x), np.uint32) for x in texts]


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Whole if it fits; else full pieces after a first one that takes the rest."""
    return [n] if n <= capacity else ([n % capacity] if n % capacity else []) + [capacity] * (n // capacity)


def tokenized_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of every document with the CRC-32 of their ids (little-endian unsigned 32-bit); a null text is empty: its only id is end_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], np.uint32)
        for batch in batches:
            texts, ids, row = batch.column("text"), batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            out = []
            for i in range(0, len(ids), 64):
                for k, x in enumerate(encode(tokenizer, [t or "" for t in texts.slice(i, 64).to_pylist()]), i):
                    x = np.concatenate([x, end])
                    at = 0
                    for p, n in enumerate(piece_lengths(len(x), capacity)):
                        out.append((row[k], ids[k], p, at, n, zlib.crc32(x[at : at + n].tobytes())))
                        at += n
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, largest first, of the available multiset whose sum comes nearest to room from below.

    Bit s of the set says that sum s can be reached; one snapshot per length allows the walk back.
    """
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, block = min(counts[length], room // length), 1
        while left:
            take = min(block, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & full
            left, block = left - take, block * 2
        if reach >> room & 1:
            break
    best, out = reach.bit_length() - 1, []
    for before, length, take in reversed(steps):
        if not before >> best & 1:
            out += [length] * take
            best -= length * take
    return sorted(out, reverse=True)


def bin_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of one bin, how many such bins), until every piece has a place.

    Each pattern holds the largest length left and the fullest complement of it; then it is
    removed as often as the counts allow, so every round but few uses up a length.
    """
    counts = {k: v for k, v in histogram.items() if v}
    out = []
    while counts:
        largest = max(counts)
        counts[largest] -= 1
        pattern = [largest, *fullest({k: v for k, v in counts.items() if v}, capacity - largest)]
        counts[largest] += 1
        used = {k: pattern.count(k) for k in set(pattern)}
        times = min(counts[k] // n for k, n in used.items())
        for k, n in used.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        out.append((pattern, times))
    return out


def places(patterns: list[tuple[list[int], int]]) -> dict[int, list[np.ndarray]]:
    """For each length: first rank, first sequence, copies per bin and offset of its first copy, by runs of equal bins."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        at = 0
        for length in dict.fromkeys(pattern):
            n = pattern.count(length)
            runs.setdefault(length, []).append((rank.get(length, 0), sequence, n, at))
            rank[length] = rank.get(length, 0) + n * times
            at += n * length
        sequence += times
    return {k: [np.array(c, np.int64) for c in zip(*v)] for k, v in runs.items()}


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most capacity tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty
    texts are one piece of the end id. Repeated rows are packed each; a null doc_id is kept
    as null. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = stored(tokenized_pieces(docs, tokenizer, end_id, capacity))
    part = F.pmod(F.xxhash64("row", "piece"), F.lit(max(64, tasks(spark))))
    pieces = pieces.withColumn("part", part)
    sizes = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = spark.sparkContext.broadcast(places(bin_patterns(histogram, capacity)))
    before = sizes.selectExpr("length", "part", "sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding) as before")
    ranked = pieces.selectExpr("*", "row_number() over (partition by length, part order by row, piece) as k").join(before, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.coalesce("before", F.lit(0)) + F.col("k") - 1).alias("rank"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for i, j in zip(cuts[:-1], cuts[1:]):
                rows = order[i:j]
                first, base, copies, at = plan.value[int(length[rows[0]])]
                k = np.searchsorted(first, rank[rows], "right") - 1
                inside = rank[rows] - first[k]
                sequence[rows] = base[k] + inside // copies[k]
                offset[rows] = at[k] + inside % copies[k] * length[rows]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
