"""SentencePiece encoding and decoding of whole texts by suffix-array matching.

A batch's text is cut into chunks where no piece reaches over: before a run of blanks, and
where letters meet other characters that no piece holds beside them. Its distinct chunks
are laid end to end and indexed by a suffix array. Every vocabulary piece
is binary-searched for its range of occurrences; the edges found (position, length, piece)
are sorted by position. Relaxation then follows the vocabulary's own rule, which for a
byte-pair model is the order of merges and not the best path: as long as two neighbouring
symbols span an edge, the best-scored of these (leftmost in a tie) becomes one symbol.
Letters without a piece become byte pieces.
"""

from __future__ import annotations

import heapq
import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BLANK = "▁"
LONG = 48  # letters from which on a chunk is merged by a heap on its own
NONE = np.int32(2**31 - 1)


def chunk_pattern(pieces: list[str]) -> re.Pattern:
    """Blanks and the letters, or the other characters, after them. Letters that some piece holds beside another character count as other; if pieces mix both all the same, chunks end at blanks only."""
    pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:]) if BLANK not in (a, b)}
    odd = ""
    while True:
        letter = re.compile(f"[^\\W\\d_{odd}]")
        mixed = {c for a, b in pairs if bool(letter.match(a)) != bool(letter.match(b)) for c in (a, b) if letter.match(c)}
        if not mixed:
            return re.compile(f"{BLANK}*[^\\W\\d_{odd}]+|{BLANK}*(?:(?!{BLANK})[\\W\\d_{odd}])+|{BLANK}+")
        odd += "".join(re.escape(c) for c in sorted(mixed))
        if len(odd) > 100:
            return re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class Vocabulary:
    """Pieces that match text, in the order of their merges, and what each id decodes to."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        order = sorted(plain, key=lambda i: -model.get_score(i))
        self.rank = np.full(n, NONE, np.int32)
        self.rank[order] = np.arange(len(order))
        self.id_of_rank = np.array(order, np.int32)
        self.texts = [pieces[i].encode() for i in order]
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.chunk = chunk_pattern([pieces[i] for i in plain])
        self.decoded = [pieces[i].replace(BLANK, " ").encode() if self.rank[i] != NONE else bytes([int(pieces[i][3:5], 16)]) if model.is_byte(i) else b"" for i in range(n)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def words_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one big-endian number; zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : len(data) + k]
    return out


def suffix_array(first: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the `depth` bytes that follow (first: words_of the text), by prefix doubling."""
    order = np.argsort(first)
    have = 8
    values = first
    while True:
        rank = np.zeros(len(first), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], values[order][1:] != values[order][:-1]])) if len(first) else 0
        if have >= depth or not len(first) or rank[order[-1]] == len(first) - 1:
            return order
        later = np.full(len(first), 0, np.int64)
        later[:-have] = rank[have:] + 1
        values = rank * (len(first) + 1) + later
        order = np.argsort(values)
        have *= 2


def occurrences(order: np.ndarray, first: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every piece the range [low, high) of the suffix array that begins with it."""
    width = -(-max(map(len, pieces)) // 8)

    def words(fill: bytes) -> np.ndarray:
        flat = np.frombuffer(b"".join(p + fill * (8 * width - len(p)) for p in pieces), np.uint8)
        return flat.reshape(len(pieces), width, 8).view(">u8")[:, :, 0].astype(np.uint64)

    first = np.concatenate([first, np.zeros(8 * width, np.uint64)])
    found = []
    for key, right in ((words(b"\0"), False), (words(b"\xff"), True)):
        low, high = np.zeros(len(pieces), np.int64), np.full(len(pieces), len(order), np.int64)
        while (low < high).any():
            mid = (low + high) // 2
            at = order[np.minimum(mid, len(order) - 1)]
            before, same = np.zeros(len(pieces), bool), np.ones(len(pieces), bool)
            for k in range(width):
                w = first[at + 8 * k]
                before |= same & (w < key[:, k])
                same &= w == key[:, k]
            go = (before | (same & right)) & (low < high)
            low, high = np.where(go, mid + 1, low), np.where(go | (low >= high), high, mid)
        found.append(low)
    return found[0], found[1]


class Edges:
    """All places where a piece matches, sorted by position and length."""

    def __init__(self, data: np.ndarray, vocab: Vocabulary):
        first = words_of(data)
        order = suffix_array(first, max(map(len, vocab.texts)))
        low, high = occurrences(order, first, vocab.texts)
        n = high - low
        rank = np.repeat(np.arange(len(n)), n)
        at = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[rank]]
        edge = np.sort(((at * 256 + np.array([len(x) for x in vocab.texts])[rank]) << 20) | rank)
        self.key, self.rank = edge >> 20, (edge & 0xFFFFF).astype(np.int32)

    def look(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rank of the piece from start to end, or NONE."""
        if not len(self.key):
            return np.full(start.shape, NONE)
        want = start * 256 + np.minimum(end - start, 255)
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.rank[at], NONE)


def relax(bounds: np.ndarray, edges: Edges) -> list[np.ndarray]:
    """Final symbol bounds of chunks of equally many letters, given the bounds of their letters [chunk, letter]."""
    done: list[np.ndarray] = [None] * len(bounds)
    rows = np.arange(len(bounds))
    ranks = edges.look(bounds[:, :-2], bounds[:, 2:])
    while len(rows):
        best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
        over = ranks[np.arange(len(rows)), best] == NONE if ranks.shape[1] else np.ones(len(rows), bool)
        for r, b in zip(rows[over], bounds[over]):
            done[r] = b
        rows, bounds, ranks, best = rows[~over], bounds[~over], ranks[~over], best[~over]
        if not len(rows):
            break
        m = ranks.shape[1]
        at = np.arange(m + 1)
        bounds = np.take_along_axis(bounds, at + (at > best[:, None]), 1)
        at = np.arange(m - 1)
        ranks = np.take_along_axis(ranks, at + (at >= best[:, None]), 1)
        here = np.arange(len(rows))
        for near in (best - 1, best):
            ok = (near >= 0) & (near < m - 1)
            ranks[here[ok], near[ok]] = edges.look(bounds[here[ok], near[ok]], bounds[here[ok], near[ok] + 2])
    return done


def relax_long(bounds: np.ndarray, edges: Edges) -> np.ndarray:
    """The same for one long chunk, with a heap."""
    n = len(bounds) - 1
    before, after, end = list(range(-1, n - 1)), list(range(1, n + 1)), bounds[1:].tolist()
    start, alive = bounds[:-1].tolist(), [True] * n
    heap = [(r, i, i + 1, start[i], end[i + 1]) for i, r in enumerate(edges.look(bounds[:-2], bounds[2:]).tolist()) if r != NONE]
    heapq.heapify(heap)
    while heap:
        _, i, j, a, z = heapq.heappop(heap)
        if not (alive[i] and j < n and alive[j] and after[i] == j and start[i] == a and end[j] == z):
            continue
        alive[j], end[i], after[i] = False, end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n:
                r = int(edges.look(np.array([start[x]]), np.array([end[y]]))[0])
                if r != NONE:
                    heapq.heappush(heap, (r, x, y, start[x], end[y]))
    return np.array([s for s, k in zip(start, alive) if k] + [bounds[-1]])


def encode_chunks(chunks: list[str], vocab: Vocabulary) -> list[bytes]:
    """Ids of each chunk, as bytes of little-endian unsigned 32-bit numbers."""
    raw = [c.encode() for c in chunks]
    data = np.frombuffer(b"\xff".join([*raw, b""]), np.uint8)
    edges = Edges(data, vocab)
    base = np.cumsum([0] + [len(x) + 1 for x in raw])
    letter = np.flatnonzero((data & 0xC0) != 0x80)  # the byte between chunks counts as one
    cut = np.searchsorted(letter, base)
    size = np.diff(cut) - 1
    bounds: list[np.ndarray] = [None] * len(chunks)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        if n > LONG:
            for r in rows:
                bounds[r] = relax_long(letter[cut[r] : cut[r] + n + 1], edges)
        else:
            for r, b in zip(rows, relax(letter[cut[rows][:, None] + np.arange(n + 1)], edges)):
                bounds[r] = b
    sizes = [len(b) - 1 for b in bounds]
    start, end = np.concatenate([b[:-1] for b in bounds]), np.concatenate([b[1:] for b in bounds])
    rank = edges.look(start, end)
    missing = rank == NONE
    count = np.where(missing, end - start, 1)
    ids = np.repeat(np.where(missing, 0, vocab.id_of_rank[np.where(missing, 0, rank)]), count)
    lost = np.repeat(missing, count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
    ids[lost] = vocab.byte_ids[data[place[lost]]]
    cuts = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(sizes)])]
    flat = ids.astype(np.uint32)
    return [flat[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:])]


class Coder:
    """Encodes and decodes texts; chunks are remembered up to a bound, and those of the bound before it as long as they are used."""

    def __init__(self, path: str, most: int = 100_000):
        self.vocab, self.known, self.before, self.most = vocabulary(path), {}, {}, most

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.vocab.chunk.findall((BLANK + t).replace(" ", BLANK)) if t else [] for t in texts]
        needed = set(chain.from_iterable(cut))
        if len(self.known) + len(needed - self.known.keys()) > self.most:
            self.known, self.before = {}, self.known
        missing = needed - self.known.keys()
        again = missing & self.before.keys()
        self.known.update((c, self.before[c]) for c in again)
        if new := list(missing - again):
            self.known.update(zip(new, encode_chunks(new, self.vocab)))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, chunks)), np.uint32) for chunks in cut]

    def decode(self, ids: np.ndarray) -> str:
        table = self.vocab.decoded
        text = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def code_documents(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256 and exact (whether the ids decode to the text) of every row of docs; with_ids also the ids.

    Null and empty texts have no ids. Repeated rows each get their row, null doc_ids stay.
    U+2581 in a text decodes as a blank, so such a text is not exact. Other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model)
        for b in small_batches(batches, 4 << 20):
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids = coder.encode(texts)
            back = [coder.decode(x) for x in ids]
            cols = [b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]), pa.array([a == z for a, z in zip(texts, back)])]
            names = ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "exact"]
            if with_ids:
                cols.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc_id {kind}, n_ids long, ids_crc32 long, decoded_sha256 string, exact boolean" + (", ids array<long>" if with_ids else "")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
