"""Removal of long byte strings that an earlier document holds already, with a logarithmic family of suffix arrays.

To keep what is shuffled in proportion to the text, suffixes travel in runs: consecutive
suffixes whose windows have the same least k-gram (their anchor) form one run, named by a
128-bit BLAKE2 digest of its bytes. Runs that an earlier document has too are settled as a
whole. Where an anchor occurs with different runs, the bytes of these runs follow in a second
round: every task takes the runs of its share of the anchors batch by batch, orders the
suffixes of a batch by their bytes, scans this suffix array against the arrays it holds
(`Levels`) for matches over the full length, and merges arrays of like size. The 64-bit
hashes of k-grams choose anchors and tasks only; equality is a matter of bytes or digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, fresh_names, mix, parts_of, prefix_hash, slices, small_batches, stored, utf8

PLACE_BITS = 36  # positions inside a slice of texts; equal hashes above them go to the first
SLICE = 1 << 19
DIGEST = "S16"
RESULT = "doc_id long, whole boolean, key long, more long"
OPEN_RUN = "place int, doc_id long, text binary"


def digests(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests of the byte ranges [first, end)."""
    raw = memoryview(np.ascontiguousarray(data))
    return np.frombuffer(b"".join([hashlib.blake2b(raw[a:z], digest_size=16).digest() for a, z in zip(first.tolist(), end.tolist())]), DIGEST)


def _halves(keys: np.ndarray) -> np.ndarray:
    """Digests as two columns of 64-bit integers."""
    return np.ascontiguousarray(keys).view(np.int64).reshape(-1, 2)


class Levels:
    """Sorted key arrays whose sizes fall geometrically; of the documents that meet at a key only the smallest stays."""

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []

    def add(self, keys: np.ndarray, docs: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scan a batch (sorted distinct keys) against all levels, then keep what is new; returns documents and keys that lost to a smaller document."""
        lost_docs, lost_keys = [], []
        for level in self.levels:
            if not len(keys):
                break
            at = np.minimum(np.searchsorted(level[0], keys), len(level[0]) - 1)
            hit = level[0][at] == keys
            if hit.any():
                old, new, at = level[1][at[hit]], docs[hit], at[hit]
                differ = old != new
                lost_docs.append(np.maximum(old, new)[differ])
                lost_keys.append(keys[hit][differ])
                level[1][at] = np.minimum(old, new)
                keys, docs, extra = keys[~hit], docs[~hit], extra[~hit]
        if len(keys):
            self.levels.append([keys, docs.copy(), extra])
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            a, b = self.levels.pop(), self.levels.pop()
            both = [np.concatenate(x) for x in zip(b, a)]
            order = np.argsort(both[0], kind="stable")
            self.levels.append([x[order] for x in both])
        return _joined(lost_docs, np.int64), _joined(lost_keys, keys.dtype)

    def all(self) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*self.levels)] if self.levels else [np.zeros(0, t) for t in (DIGEST, np.int64, np.uint32)]


def _joined(parts: list[np.ndarray], kind: np.dtype | str) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Runs of suffix starts [first, last] that share an anchor, with their row, the data and the anchor's hash."""
    gram = length // 2 + 1
    window, n = length - gram + 1, len(data)
    sums, inverse = prefix_hash(data)
    empty = {"first": np.zeros(0, np.int64), "last": np.zeros(0, np.int64), "row": np.zeros(0, np.int64), "anchor": np.zeros(0, np.uint64), "data": data}
    if n < length:
        return empty
    h = mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    least = (h & ~U64((1 << PLACE_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
    ends = np.zeros(n + 1, np.int32)
    np.add.at(ends, np.maximum(offsets[1:] - length + 1, offsets[:-1]), 1)
    np.add.at(ends, offsets[1:], -1)
    start = np.flatnonzero(np.cumsum(ends[: len(least)]) == 0)
    if not len(start):
        return empty
    place = (least[start] & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
    cut = np.concatenate([[0], np.flatnonzero((np.diff(start) != 1) | (np.diff(place) != 0)) + 1, [len(start)]])
    first, last = start[cut[:-1]], start[cut[1:] - 1]
    return empty | {
        "first": first, "last": last, "row": np.searchsorted(offsets, first, "right") - 1,
        "anchor": mix(h[place[cut[:-1]]] + U64(1)),
    }


def _batch_runs(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    data, offsets = utf8(batch.column("text"))
    for i, j in slices(offsets, SLICE):
        off = offsets[i : j + 1] - offsets[i]
        yield np.arange(i, j), runs(data[offsets[i] : offsets[j]], off, length)


def _narrow(docs: np.ndarray) -> tuple[int, bytes]:
    """Ids relative to the least one, in four bytes where they fit."""
    base = int(docs.min()) if len(docs) else 0
    rest = docs - base
    return base, (rest.astype(np.uint32) if not len(rest) or rest.max() < 1 << 32 else rest).tobytes()


def _wide(base: int, raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.int64 if n and len(raw) == 8 * n else np.uint32).astype(np.int64) + base


def least_per_key(keys: np.ndarray, docs: np.ndarray, extra: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The sorted distinct keys with their least document, and the documents and keys that lost inside the batch."""
    order = np.lexsort((docs, keys))
    keys, docs, extra = keys[order], docs[order], extra[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    least = docs[first][np.cumsum(first) - 1]
    beaten = docs > least
    repeat = beaten & np.concatenate([[False], (keys[1:] == keys[:-1]) & (docs[1:] == docs[:-1])]) if len(keys) else beaten
    beaten &= ~repeat
    return [keys[first], docs[first], extra[first]], [docs[beaten], keys[beaten]]


PAYLOAD = "bucket int, n int, base long, keys binary, docs binary, extra binary, lost_base long, lost_docs binary, lost_keys binary"


def _payload(keys: np.ndarray, docs: np.ndarray, extra: np.ndarray, place: np.ndarray, buckets: int, turn: int) -> Iterator[dict]:
    """One row per bucket that the batch has keys for: only its least document per key travels; what lost already goes along."""
    (keys, docs, extra), (lost_docs, lost_keys) = least_per_key(keys, docs, np.stack([extra, place]).T if len(keys) else np.zeros((0, 2), np.uint64))
    extra, place = extra[:, 0].astype(np.uint32), extra[:, 1].astype(np.int64)
    order = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[order], np.arange(buckets + 1))
    lost_base, lost = _narrow(lost_docs)
    for b in range(buckets):
        at, with_lost = order[cuts[b] : cuts[b + 1]], b == turn % buckets
        if len(at) or with_lost and len(lost_docs):
            base, ids = _narrow(docs[at])
            yield {"bucket": b, "n": len(at), "base": base, "keys": keys[at].tobytes(), "docs": ids, "extra": extra[at].tobytes(),
                   "lost_base": lost_base, "lost_docs": lost if with_lost else b"", "lost_keys": lost_keys.tobytes() if with_lost else b""}


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """Feed a bucket's batches to its levels. Whole: documents whose run a smaller document has; the rest: least documents of anchors with several runs."""
    family, docs, keys = Levels(), [], []
    for r in rows.itertuples():
        docs.append(_wide(r.lost_base, r.lost_docs, len(r.lost_keys) // 16))
        keys.append(np.frombuffer(r.lost_keys, DIGEST))
        lost = family.add(np.frombuffer(r.keys, DIGEST), _wide(r.base, r.docs, r.n), np.frombuffer(r.extra, np.uint32))
        docs.append(lost[0])
        keys.append(lost[1])
    key, doc, anchor = family.all()
    order = np.lexsort((doc, anchor))
    key, doc, anchor = key[order], doc[order], anchor[order]
    cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
    last = np.append(cut[1:], len(anchor)) - 1
    several = np.repeat(doc[cut] != doc[last], last + 1 - cut)
    settled = sum(map(len, docs))
    out = pd.DataFrame({"doc_id": np.concatenate([*docs, doc[several]])})
    out["whole"] = np.arange(len(out)) < settled
    both = _halves(_joined([*keys, key[several]], DIGEST))
    out["key"], out["more"] = both[:, 0], both[:, 1]
    return out


def suffix_arrays(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Open runs (OPEN_RUN) of one task: documents and digests of suffixes, cut at `length` bytes, that a smaller document of the task has.

    Each batch's suffixes are ordered by their bytes, which gives the batch's suffix array; it is scanned against those of the batches before.
    """
    family = Levels()
    for b in batches:
        data, offsets = utf8(b.column("text"))
        at, run = _spread(offsets[:-1], offsets[1:] - length)
        if not len(at):
            continue
        suffixes = np.ascontiguousarray(sliding_window_view(data, length)[at]).view(f"S{length}")[:, 0]
        (keys, least, extra), (docs, lost) = least_per_key(suffixes, b.column("doc_id").to_numpy(zero_copy_only=False)[run], np.zeros(len(at), np.uint8))
        more_docs, more = family.add(keys, least, extra)
        docs, lost = np.concatenate([docs, more_docs]), np.concatenate([lost, more])
        if len(docs):
            start = np.arange(len(docs)) * length
            both = _halves(digests(np.frombuffer(lost.tobytes(), np.uint8), start, start + length))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["doc_id", "key", "more"])


def _record_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [("bucket", pa.int32()), ("n", pa.int32()), ("base", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("extra", pa.binary()), ("lost_base", pa.int64()), ("lost_docs", pa.binary()), ("lost_keys", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds], [k for k, _ in kinds])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Digests of a column of lists of (key, more), and the row of each."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten()
    both = np.stack([flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2)], axis=1)
    return both.view(DIGEST)[:, 0], np.repeat(np.arange(len(column)), sizes)


def _with_row(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    out = np.empty((len(key), 3), np.int64)
    out[:, 0], out[:, 1:] = row, _halves(key)
    return out.view("S24")[:, 0]


def _member(row: np.ndarray, key: np.ndarray, set_row: np.ndarray, set_key: np.ndarray) -> np.ndarray:
    """Whether (row, key) is among the given pairs."""
    pairs = np.unique(_with_row(set_row, set_key))
    if not len(pairs):
        return np.zeros(len(key), bool)
    want = _with_row(row, key)
    return pairs[np.minimum(np.searchsorted(pairs, want), len(pairs) - 1)] == want


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every start of the runs [first, last], and the run of each."""
    n = last - first + 1
    run = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[run], run


def repeated(docs: DataFrame, length: int = 50) -> tuple[DataFrame, DataFrame]:
    """(runs, suffixes): documents' runs by digest (key, more), whole (a smaller doc_id has the run) or open, and digests of single suffixes that a smaller doc_id has."""
    buckets = 4 * parts_of(docs)

    def deal_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, b in enumerate(small_batches(batches)):
            ids, found = b.column("doc_id").to_numpy(zero_copy_only=False), []
            for rows, r in _batch_runs(b, length):
                if len(r["row"]):
                    found.append((digests(r["data"], r["first"], r["last"] + length), ids[rows[r["row"]]], r["anchor"]))
            if found:
                key, doc, anchor = (np.concatenate(x) for x in zip(*found))
                place = (anchor >> U64(32)) * U64(buckets) >> U64(32)
                if out := list(_payload(key, doc, anchor & U64(0xFFFFFFFF), place, buckets, turn)):
                    yield _record_batch(out)

    def deal_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            set_key, set_row = _lists(b.column("open_runs"))
            for rows, r in _batch_runs(b, length):
                inside = (set_row >= rows[0]) & (set_row <= rows[-1])
                key = digests(r["data"], r["first"], r["last"] + length)
                mine = np.flatnonzero(_member(r["row"], key, set_row[inside] - rows[0], set_key[inside]))
                mine = mine[np.unique(_with_row(r["row"][mine], key[mine]), return_index=True)[1]]
                if len(mine):
                    at, _ = _spread(r["first"][mine], r["last"][mine] + length - 1)
                    ends = np.cumsum(r["last"][mine] + length - r["first"][mine])
                    offsets = np.concatenate([[0], ends]).astype(np.int32)
                    texts = pa.Array.from_buffers(pa.binary(), len(mine), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(r["data"][at].tobytes())])
                    place = (r["anchor"][mine] >> U64(33)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(ids[rows[r["row"][mine]]], pa.int64()), texts], ["place", "doc_id", "text"])

    named = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    dealt = named.mapInArrow(deal_runs, PAYLOAD).repartition(max(1, buckets // 4), "bucket")
    by_run = stored(dealt.groupBy("bucket").applyInPandas(_settle, RESULT))
    opened = by_run.where("not whole").groupBy("doc_id").agg(F.collect_list(F.struct("key", "more")).alias("open_runs"))
    open_runs = named.join(opened, "doc_id").mapInArrow(deal_open, OPEN_RUN).repartition(buckets, "place")
    return by_run, stored(open_runs.mapInArrow(lambda batches: suffix_arrays(batches, length), "doc_id long, key long, more long"))


def dedup(docs: DataFrame, length: int = 50, keep_text: bool = False, report: bool = True) -> DataFrame:
    """Remove every byte covered by a `length`-byte string (of the UTF-8 text) that also starts in a document with a smaller doc_id.

    All columns of docs come back with n_bytes, n_removed, n_spans, kept_sha256 (columns of
    these names are replaced; without report, the columns are those of docs alone); with
    keep_text, text is what remains (bytes of a letter cut in two are dropped). Null texts are empty (and stay null); rows with a null doc_id lose
    nothing and take nothing from others; rows of one doc_id do not count as earlier for
    each other. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if not report or c not in ("n_bytes", "n_removed", "n_spans", "kept_sha256")]
    rows = docs.select(*names)
    core = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = fresh_names(rows, 4)
    by_run, by_suffix = repeated(core, length)
    keys = by_run.withColumn("of", F.when(F.col("whole"), 0).otherwise(1)).select("doc_id", "of", "key", "more").unionByName(by_suffix.withColumn("of", F.lit(2)))
    keys = keys.groupBy(F.col("doc_id").alias(own[3])).agg(*(F.collect_list(F.when(F.col("of") == i, F.struct("key", "more"))).alias(own[i]) for i in range(3)))
    joined = rows.join(keys, rows["doc_id"].cast("long") == keys[own[3]], "left").drop(own[3])
    extra = [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")] if report else []
    schema = ", ".join(f"`{c}` {t}" for c, t in [*rows.dtypes, *extra])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            data, offsets = utf8(b.column("text").cast(pa.string()))
            sets = [_lists(b.column(own[i])) for i in range(3)]
            removed, spans, kept_digests, kept_texts = [], [], [], []
            for i, j in slices(offsets, SLICE):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                mine = [(k[(r >= i) & (r < j)], r[(r >= i) & (r < j)] - i) for k, r in sets]
                gone = np.zeros(len(part) + 1, np.int32)
                if any(len(k) for k, _ in mine):
                    r = runs(part, off, length)
                    named = np.flatnonzero(np.isin(r["row"], np.concatenate([rows for _, rows in mine])))
                    row, first, last = r["row"][named], r["first"][named], r["last"][named]
                    key = digests(part, first, last + length)
                    whole = _member(row, key, mine[0][1], mine[0][0])
                    opened = _member(row, key, mine[1][1], mine[1][0]) & ~whole
                    at, run = _spread(first[opened], last[opened])
                    single = at[_member(row[opened][run], digests(part, at, at + length), mine[2][1], mine[2][0])]
                    np.add.at(gone, np.concatenate([first[whole], single]), 1)
                    np.add.at(gone, np.concatenate([last[whole], single]) + length, -1)
                gone = np.cumsum(gone[:-1]) > 0
                for a, z in zip(off[:-1], off[1:]):
                    mask = gone[a:z]
                    kept = part[a:z][~mask].tobytes() if mask.any() else part[a:z].tobytes()
                    removed.append(int(mask.sum()))
                    spans.append(int(np.count_nonzero(mask[1:] & ~mask[:-1]) + (z > a and mask[0])))
                    kept_digests.append(hashlib.sha256(kept).hexdigest())
                    if keep_text:
                        kept_texts.append(kept.decode("utf-8", "ignore"))
            cols = {c: b.column(c) for c in names}
            if keep_text:
                missing = b.column("text").is_null().to_pylist()
                cols["text"] = pa.array([None if m else t for m, t in zip(missing, kept_texts)], pa.string())
            if report:
                cols |= {"n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(kept_digests, pa.string())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return joined.mapInArrow(strip, schema)
