"""A gated recurrent language model over words, scoring whole documents.

Words fall into classes: frequent words (the head) into classes of their own, by rank;
all others by their last two bytes into tail classes. The model gives
P(word) = P(class | state) * P(word | class, state): a softmax over the class's members
for head classes, smoothed corpus counts inside a tail class. The state is a gated
recurrence (a simple recurrent unit: gates from the token, no product of states with a
matrix), trained by truncated backpropagation and carried from window to window, so that
a document's score is the sum over all of its tokens.

Every count comes from all training documents by Spark aggregation. The weights too are
learned from all of them, data-parallel and in one pass: every round takes its own share
(by a hash of doc_id and text, so that copies of a text are spread over the rounds), every
shard of it trains a network, and these are averaged after each round.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, small_batches, stored, utf8

LOG10 = np.log(10.0)


@dataclass(frozen=True)
class Settings:
    head: int = 2048  # frequent words with a vector of their own; the end is one more
    members: int = 64  # words of a head class
    tails: int = 32  # classes of the other words
    hidden: int = 24
    window: int = 32  # steps of truncated backpropagation
    train_windows: int = 256  # side by side
    score_windows: int = 1024
    shard_bytes: int = 16 << 20  # text that one network of the average learns from in a round
    frequent: int = 65_536  # words whose counts go with every task; the others' are joined
    rounds: int = 2
    rate: float = 0.01
    smoothing: float = 0.1


def tokens(data: np.ndarray, a: int, z: int) -> list[bytes]:
    return data[a:z].tobytes().translate(LOWER_BYTES).split()


def tail_class(word: bytes, tails: int) -> int:
    return int.from_bytes(word[-2:], "little") * 2654435761 % (1 << 32) * tails >> 32


def is_held_out() -> Column:
    """crc32 of doc_id as text, modulo 10, is 0; a null doc_id is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0, F.lit(False))


def word_counts(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """(word binary, n) over the words of docs (text); a task sends its counts on when it holds `most` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in small_batches(batches, 4 << 20):
            data, off = utf8(b.column("text"))
            for a, z in zip(off[:-1], off[1:]):  # a word cannot run over two texts: each is split on its own
                held.update(tokens(data, a, z))
            if len(held) > most:
                yield sent()
        yield sent()

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


MISSING = -(1 << 40)


class Lexicon:
    """The frequent words (the head first), and the totals of the corpus. Head id 0 is the end."""

    def __init__(self, words: list[tuple[bytes, int]], ends: int, total: int, distinct: int, tail: dict[int, tuple[int, int]], s: Settings):
        self.settings, self.total, self.distinct = s, total, distinct
        head, rest = words[: s.head], words[s.head :]
        self.ids = {w: i + 1 for i, (w, _) in enumerate(head)} | {w: -1 - i for i, (w, _) in enumerate(rest)}
        self.counts = np.array([ends, *(n for _, n in head)], np.float64)
        self.rest_class = np.array([tail_class(w, s.tails) for w, _ in rest], np.int64)
        self.rest_counts = np.array([n for _, n in rest], np.float64)
        self.heads = -(-len(self.counts) // s.members)
        self.tail_n = np.array([tail.get(c, (0, 0))[0] for c in range(s.tails)], np.float64)
        self.tail_v = np.array([tail.get(c, (0, 0))[1] for c in range(s.tails)], np.float64)
        self.log_mass = np.log10(total + 0.1 * (distinct + 1))
        self.base, self.rest_base = np.log10(self.counts + 0.1) - self.log_mass, np.log10(self.rest_counts + 0.1) - self.log_mass
        self.rest_score = np.log10(self.rest_counts + s.smoothing)
        # one more, never seen word is reserved in every tail class
        self.tail_mass = self.tail_n + s.smoothing * (self.tail_v + 1)
        self.class_of_ending = (np.arange(1 << 16, dtype=np.uint64) * np.uint64(2654435761) % np.uint64(1 << 32) * np.uint64(s.tails) >> np.uint64(32)).astype(np.int64)

    @property
    def classes(self) -> int:
        return self.heads + self.settings.tails

    def codes(self, words: list[bytes]) -> np.ndarray:
        """Head ids, -1 - place for other frequent words, or MISSING."""
        return np.fromiter(map(self.ids.get, words, repeat(MISSING)), np.int64, len(words))

    def encode(self, words: list[bytes], codes: np.ndarray) -> np.ndarray:
        """Head ids, or -1 - tail class."""
        out = codes.copy()
        rest = np.flatnonzero((codes < 0) & (codes != MISSING))
        out[rest] = -1 - self.rest_class[-1 - codes[rest]]
        missing = np.flatnonzero(codes == MISSING)
        out[missing] = -1 - self.class_of_ending[np.frombuffer(b"".join([(words[i][-2:] + b"\0")[:2] for i in missing.tolist()]), "<u2")]
        return out


def all_tokens(column: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The words of all rows, one after the other, and how many each row has."""
    data, off = utf8(column)
    rows = [tokens(data, a, z) for a, z in zip(off[:-1], off[1:])]  # a word cannot run over two texts: each is split on its own
    return list(chain.from_iterable(rows)), np.array([len(x) for x in rows], np.int64)


def with_ends(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The rows' ids with the end, 0, after each row."""
    out = np.zeros(len(ids) + len(sizes), np.int64)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
    return out


class Network:
    """Weights and steps of the gated recurrence and its class-factored output.

    Every token brings a gate f and a candidate g (rows of two tables): the state after it is
    f * state + (1 - f) * g. Gates depend on the token alone, so a document's windows are run
    side by side, each from zero, and what the windows before it left is added afterwards:
    the state is carried over the whole document, exactly.
    """

    NAMES = ("gate", "candidate", "classes", "class_bias", "members", "member_bias")

    def __init__(self, lexicon: Lexicon, weights: dict[str, np.ndarray] | None = None):
        s, self.lexicon = lexicon.settings, lexicon
        rng, h, c, v = np.random.default_rng(1), s.hidden, lexicon.classes, len(lexicon.counts) + s.tails
        if weights is None:
            counts = np.zeros(lexicon.heads * s.members)
            counts[: len(lexicon.counts)] = lexicon.counts + s.smoothing
            mass = np.concatenate([counts.reshape(lexicon.heads, s.members).sum(1), lexicon.tail_mass])
            weights = {
                "gate": np.tile(np.linspace(-2, 3, h, dtype=np.float32), (v, 1)), "candidate": rng.standard_normal((v, h)).astype(np.float32),
                "classes": np.zeros((h, c), np.float32), "class_bias": np.log(mass / mass.sum()).astype(np.float32),
                "members": np.zeros((lexicon.heads, h, s.members), np.float32), "member_bias": np.where(counts > 0, np.log(np.maximum(counts, 1e-9)), -1e9).reshape(lexicon.heads, s.members).astype(np.float32),
            }
        self.w, self.tables = weights, None

    def step_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """For every token what the state is multiplied with, and what is added."""
        keep = 1 / (1 + np.exp(-np.clip(self.w["gate"], -30, 30)))
        return keep, (1 - keep) * self.w["candidate"]

    def frozen(self) -> "Network":
        """With the tables worked out once, for scoring."""
        self.tables = self.step_tables()
        return self

    def inputs(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids >= 0, ids, len(self.lexicon.counts) - 1 - ids)

    def targets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = self.lexicon.settings.members
        return np.where(ids >= 0, ids // m, self.lexicon.heads - 1 - ids), np.where(ids >= 0, ids % m, 0)

    def forward(self, ids: np.ndarray, first: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States before each token of ids[step, window], the gates, and the state after the last window.

        Windows follow each other; first marks those that begin a document, before is the state that the first window finds if it does not.
        """
        keep, add = self.tables or self.step_tables()
        rows, h = self.inputs(ids), keep.shape[1]
        f, b = keep[rows], add[rows]
        states, left = np.empty((len(ids) + 1, ids.shape[1], h), keep.dtype), np.empty((len(ids) + 1, ids.shape[1], h), keep.dtype)
        states[0], left[0] = 0, 1
        for t in range(len(ids)):
            np.multiply(f[t], states[t], out=states[t + 1])
            states[t + 1] += b[t]
            np.multiply(f[t], left[t], out=left[t + 1])
        found, zero = np.empty((ids.shape[1], h), keep.dtype), np.zeros(h, keep.dtype)
        for k in range(ids.shape[1]):  # what each window finds from those before
            found[k] = now = zero if first[k] else before
            before = states[-1, k] + left[-1, k] * now
        return states[:-1] + left[:-1] * found, f, before

    def log_probs(self, states: np.ndarray, ids: np.ndarray, learn: bool = False):
        """Natural log P(class) + log P(member | class) of flat states and ids; with learn also the gradients of their negative sum."""
        w, (cls, member) = self.w, self.targets(ids)
        logits = states @ w["classes"] + w["class_bias"]
        logits -= logits.max(1, keepdims=True)
        at = np.arange(len(ids))
        out = logits[at, cls].astype(np.float64)
        e = np.exp(logits, out=logits)
        total = e.sum(1)
        out -= np.log(total)
        grad = None
        if learn:
            e /= total[:, None]
            e[at, cls] -= 1
            grad = {"classes": states.T @ e, "class_bias": e.sum(0), "members": np.zeros_like(w["members"]), "member_bias": np.zeros_like(w["member_bias"])}
            back = e @ w["classes"].T
        order = np.argsort(cls, kind="stable")
        cut = np.searchsorted(cls[order], np.arange(self.lexicon.heads + 1))
        for c in range(self.lexicon.heads):
            rows = order[cut[c] : cut[c + 1]]
            if len(rows):
                own, at = states[rows], np.arange(len(rows))
                part = own @ w["members"][c] + w["member_bias"][c]
                part -= part.max(1, keepdims=True)
                out[rows] += part[at, member[rows]]
                e = np.exp(part, out=part)
                total = e.sum(1)
                out[rows] -= np.log(total)
                if learn:
                    e /= total[:, None]
                    e[at, member[rows]] -= 1
                    grad["members"][c], grad["member_bias"][c] = own.T @ e, e.sum(0)
                    back[rows] += e @ w["members"][c].T
        return (out, grad, back) if learn else out

    def backward(self, ids: np.ndarray, states: np.ndarray, f: np.ndarray, back: np.ndarray, grad: dict[str, np.ndarray]) -> None:
        """Through each window's steps: back[step] is the gradient of the state before that step's token; it becomes that of the state after it."""
        w, h = self.w, states.shape[2]
        d = np.zeros_like(back[0])
        for t in range(len(back) - 1, -1, -1):
            after = d
            d = back[t] + f[t] * d
            back[t] = after
        at = self.inputs(ids).ravel()
        order = np.argsort(at, kind="stable")
        begin = np.flatnonzero(np.diff(at[order], prepend=-1))
        both = np.concatenate([(back * states).reshape(-1, h), back.reshape(-1, h)], 1)[order]
        sums, rows = np.add.reduceat(both, begin), at[order][begin]
        keep = f.reshape(-1, h)[order[begin]]
        grad |= {"gate": np.zeros_like(w["gate"]), "candidate": np.zeros_like(w["candidate"])}
        grad["gate"][rows] = keep * (1 - keep) * (sums[:, :h] - w["candidate"][rows] * sums[:, h:])
        grad["candidate"][rows] = (1 - keep) * sums[:, h:]

    def windows(self, flat: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Up to `most` windows of the documents (their ids one after the other, and how many each has): ids [step, window], whether there is a token, the window's document, whether it begins it."""
        s = self.lexicon.settings
        off = np.cumsum(sizes) - sizes
        n = -(-sizes // s.window)
        doc = np.repeat(np.arange(len(sizes)), n)
        turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        steps = np.arange(s.window)[:, None]
        for i in range(0, len(doc), most):
            own, k = doc[i : i + most], turn[i : i + most]
            place = steps + k * s.window
            there = place < sizes[own]
            yield flat[np.minimum(off[own] + place, len(flat) - 1)], there, own, k == 0

    def scores(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Natural log P of each document's classes and members."""
        s, out = self.lexicon.settings, np.zeros(len(sizes))
        state = np.zeros(s.hidden, np.float32)
        for ids, there, doc, first in self.windows(flat, sizes, s.score_windows):
            states, _, state = self.forward(ids, first, state)
            p = self.log_probs(states[there], ids[there])
            out += np.bincount(np.broadcast_to(doc, there.shape)[there], p, len(sizes))
        return out

    def train(self, flat: np.ndarray, sizes: np.ndarray, rate: float) -> int:
        """One pass by Adam, its gradients truncated to windows; returns the number of tokens."""
        s, w, seen, turn = self.lexicon.settings, self.w, 0, 0
        m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
        state = np.zeros(s.hidden, np.float32)
        for ids, there, _, first in self.windows(flat, sizes, s.train_windows):
            states, f, state = self.forward(ids, first, state)
            _, grad, part = self.log_probs(states[there], ids[there], True)
            back = np.zeros_like(states)
            back[there] = part
            self.backward(ids, states, f, back, grad)
            many = int(there.sum())
            seen, turn = seen + many, turn + 1
            for k, x in w.items():
                g = np.clip(grad[k] / many, -1, 1)
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                x -= rate / (1 - 0.9**turn) * m[k] / (np.sqrt(v[k] / (1 - 0.99**turn)) + 1e-8)
        return seen


def lexicon_of(counts: DataFrame, ends: int, s: Settings) -> Lexicon:
    """The most frequent words and all totals; at most frequent + tails + 1 rows reach the driver."""
    # the counts that at most `frequent` words reach, by a histogram of at most a few hundred rows; of the next size a share by hash
    sized = counts.withColumn("size", F.floor(F.log2("n") * 8))
    least, edge, share, so_far = 1 << 40, -1, 0.0, 0
    for r in sorted(sized.groupBy("size").agg(F.count("*").alias("k")).collect(), key=lambda r: -r["size"]):
        if so_far + r["k"] > s.frequent:
            edge, share = r["size"], (s.frequent - so_far) / r["k"]
            break
        least, so_far = r["size"], so_far + r["k"]
    some = (F.col("size") == edge) & (F.shiftrightunsigned(F.xxhash64("word"), 33) < int(share * 2**31))
    words = [(bytes(r["word"]), r["n"]) for r in sized.where((F.col("size") >= least) | some).collect()]
    words.sort(key=lambda x: (-x[1], x[0]))
    own = {w for w, _ in words[: s.head]}

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(s.tails + 1, np.int64), np.zeros(s.tails + 1, np.int64)
        for b in batches:
            for word, k in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
                c = s.tails if word in own else tail_class(word, s.tails)
                n[c] += k
                v[c] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(s.tails + 1)), pa.array(n), pa.array(v)], ["cls", "n", "v"])

    rows = {r["cls"]: (r["n"], r["v"]) for r in counts.mapInArrow(tails, "cls long, n long, v long").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    total = sum(n for n, _ in rows.values()) + ends
    distinct = sum(v for _, v in rows.values()) + (ends > 0)
    return Lexicon(words, ends, total, distinct, rows, s)


def learn(training: DataFrame, lexicon: Lexicon) -> Network:
    """Average of the shards' networks over training (doc_id, text), round by round.

    Every round takes its own share of the documents. They are dealt to shards of about
    shard_bytes by a hash of doc_id and text and are read in the order of that hash, and sums
    are taken in the order of the shards: the network depends on the data and not on how
    Spark has partitioned them.
    """
    spark, s, network = training.sparkSession, lexicon.settings, Network(lexicon)
    total = training.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-total // (s.rounds * s.shard_bytes)) or 1
    dealt = training.select(F.xxhash64("doc_id", "text").alias("h"), "text").selectExpr("h", "text", f"pmod(h, {s.rounds}) as turn", f"pmod(shiftrightunsigned(h, 8), {shards}) as shard")
    shapes = {k: (x.shape, x.size) for k, x in network.w.items()}
    kind = "shard long, block int, seen double, w binary"
    for turn in range(s.rounds):
        shared = spark.sparkContext.broadcast((lexicon, network.w))

        def run(table: pa.Table) -> pa.Table:
            lex, w = shared.value
            own = Network(lex, {k: x.copy() for k, x in w.items()})
            order = np.argsort(table.column("h").to_numpy(), kind="stable")
            words, sizes = all_tokens(table.column("text").cast(pa.large_string()).combine_chunks().take(pa.array(order)))
            seen = own.train(with_ends(lex.encode(words, lex.codes(words)), sizes), sizes + 1, s.rate / (1 + 2 * turn))
            flat = np.concatenate([own.w[k].ravel() for k in Network.NAMES]).astype(np.float64) * seen
            blocks = [flat[i : i + 4096].tobytes() for i in range(0, len(flat), 4096)]
            shard = np.full(len(blocks), table.column("shard")[0].as_py())
            return pa.table([pa.array(shard), pa.array(np.arange(len(blocks)), pa.int32()), pa.array(np.full(len(blocks), float(seen))), pa.array(blocks, pa.binary())], ["shard", "block", "seen", "w"])

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("shard")
            w = np.sum([np.frombuffer(x) for x in rows["w"]], axis=0)
            return pd.DataFrame({"shard": [rows["shard"].iloc[0] // 256], "block": [rows["block"].iloc[0]], "seen": [rows["seen"].sum()], "w": [w.tobytes()]})

        summed, left = dealt.where(f"turn = {turn}").groupBy("shard").applyInArrow(run, kind), shards
        while True:  # 256 shards at a time
            summed, left = summed.groupBy("block", F.expr("shard div 256")).applyInPandas(add, kind), -(-left // 256)
            if left == 1:
                break
        summed = summed.orderBy("block").collect()  # one network
        if summed:
            flat = np.concatenate([np.frombuffer(r["w"]) for r in summed]) / summed[0]["seen"]
            at, new = 0, {}
            for k in Network.NAMES:
                new[k] = flat[at : at + shapes[k][1]].reshape(shapes[k][0]).astype(np.float32)
                at += shapes[k][1]
            network = Network(lexicon, new)
    return network


def score_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs (doc_id, text).

    Null texts are empty: their only token is the end. Repeated rows each get their row. A
    null doc_id is learned from. With no training rows at all the counts are zero and both
    scores come from the smoothing alone. Other columns are ignored.
    """
    spark, s = docs.sparkSession, settings
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    training = rows.where(~is_held_out())
    counts = stored(word_counts(training.select("text")))
    lexicon = lexicon_of(counts, training.count(), s)
    network = learn(training, lexicon)
    shared = spark.sparkContext.broadcast((lexicon, network.w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in small_batches(batches, 4 << 20):
            model = model or Network(*shared.value).frozen()
            lex = model.lexicon
            words, sizes = all_tokens(b.column("text"))
            codes = lex.codes(words)
            ids, row = lex.encode(words, codes), np.repeat(np.arange(len(sizes)), sizes)
            head, missing = codes >= 0, codes == MISSING
            rest, tail = ~head & ~missing, ids < 0
            place = -1 - codes[rest]
            base, score = np.zeros(len(codes)), np.zeros(len(codes))
            base[head], base[rest] = lex.base[codes[head]], lex.rest_base[place]
            score[rest] = lex.rest_score[place]
            score[tail] -= np.log10(lex.tail_mass)[-1 - ids[tail]]
            total = lambda x: np.bincount(row, x, len(sizes))
            known = total(~missing).astype(np.int64) + int(lex.counts[0] > 0)
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(total(missing))]), pa.int32()), pa.array([words[i] for i in np.flatnonzero(missing).tolist()], pa.binary()))
            yield pa.RecordBatch.from_arrays([
                b.column("row"), b.column("doc_id"), b.column("held_out"), pa.array(sizes + 1), pa.array(known), pa.array(total(base) + lex.base[0]),
                pa.array(model.scores(with_ends(ids, sizes), sizes + 1) / LOG10 + total(score)), rare],
                ["row", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "head_score", "rare"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, head_known long, head_base double, head_score double, rare array<binary>"
    parts = rows.withColumns({"row": F.monotonically_increasing_id(), "held_out": is_held_out()}).select("row", "doc_id", "held_out", "text").mapInArrow(run, schema)
    parts = stored(parts)
    words = parts.select("row", F.explode("rare").alias("word")).join(counts, "word", "left").select("row", F.coalesce("n", F.lit(0)).alias("n"))
    sums = words.groupBy("row").agg(
        F.count_if(F.col("n") > 0).alias("rare_known"), F.sum(F.log10(F.col("n") + 0.1) - F.lit(float(lexicon.log_mass))).alias("rare_base"), F.sum(F.log10(F.col("n") + F.lit(s.smoothing))).alias("rare_score"))
    total = lexicon.total
    zero = F.lit(0.0)
    return parts.drop("rare").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("rare_base", zero)).alias("base_score"), (F.col("head_score") + F.coalesce("rare_score", zero)).alias("score"))
