"""Licence scans: a generalised suffix automaton of licence notices, matching statistics, chained spans.

The words of all notices and phrases make one suffix automaton (a fixed number of states, sent to
the tasks). A text's words stream through it: at every word the automaton holds the longest run of
words ending there that stands in some notice. A phrase stands where its state is the current one
or an ancestor by suffix links; matches with a notice of `least` words or more are extended along
their diagonal to the full, and matches that lie close together in text and notice alike are
chained. A chain that covers enough of its notice is a span with the notice's label; of spans that
overlap the one with the greater coverage stays.

Words are runs of digits, letters (A-Z lowered) and bytes beyond ASCII. Only runs of words whose
neighbours stand side by side in some notice enter the automaton; anywhere else the longest match
is of one word at most. Hashes only find words, the words themselves are compared.

Every row gives one row, repeated rows too; null and empty texts have no words; a null doc_id
stays null. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, prefix_hash, range_hash, slices, small_batches, utf8, words
from .licence_texts import NOTICES, PHRASES

SCAN = "doc_id bigint, n_words bigint, phrases array<struct<label:string,phrase:string,word:bigint>>, spans array<struct<label:string,notice:int,first_word:bigint,last_word:bigint,coverage:double>>, best double"

#: Letters lowered; all ASCII but digits and letters parts words and becomes a space.
PLAIN = LOWER.copy()
PLAIN[0x00:0x30] = PLAIN[0x3A:0x41] = PLAIN[0x5B:0x61] = PLAIN[0x7B:0x80] = 0x20


def tokens(text: str) -> list[bytes]:
    data = PLAIN[np.frombuffer(text.encode(), np.uint8)]
    start, end, _ = words(data, np.array([0, len(data)]))
    return [data[i:j].tobytes() for i, j in zip(start, end)]


@dataclass(frozen=True)
class Scanner:
    """What a match has to be, and the texts looked for."""

    notices: list[tuple[str, str]] = field(default_factory=lambda: list(NOTICES))
    phrases: dict[str, str] = field(default_factory=lambda: dict(PHRASES))
    least: int = 3  # words of a match with a notice
    gap: int = 8  # words that two chained matches may lie apart, in text or notice
    coverage: float = 0.8  # of a notice's words, for its label


class Automaton:
    """Suffix automaton of several word sequences; next word, suffix link and length per state, and the places where the state's words end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((number, place))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):  # a state ends wherever its descendants do
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.link) - 1

    def _cloned(self, above: int, word: int) -> int:
        """The state of above's longest words and one more: the one there, if it is no longer, else a copy of it that takes over the shorter words."""
        there = self.next[above][word]
        if self.length[there] == self.length[above] + 1:
            return there
        copy = self._state(self.length[above] + 1, dict(self.next[there]), self.link[there])
        self.link[there] = copy
        while above >= 0 and self.next[above].get(word) == there:
            self.next[above][word] = copy
            above = self.link[above]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # these words stand in an earlier sequence already
            return self._cloned(last, word)
        state = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            self.link[state] = self._cloned(at, word)
        return state

    def walk(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: for every word the state and length of the longest match that ends there."""
        state, length = 0, 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield state, length


class Matcher:
    """The automaton of a scanner's texts and what a task needs beside it."""

    def __init__(self, scanner: Scanner):
        self.scanner = scanner
        self.labels = [label for label, _ in scanner.notices]
        self.phrases = list(scanner.phrases)
        notices, phrases = [tokens(t) for _, t in scanner.notices], [tokens(p) for p in self.phrases]
        self.words = sorted({w for s in [*notices, *phrases] for w in s})
        number = {w: k for k, w in enumerate(self.words)}
        sequences = [[number[w] for w in s] for s in [*notices, *phrases]]
        self.automaton, self.sizes, n = Automaton(sequences), [len(s) for s in sequences], len(notices)
        a, count = self.automaton, len(self.words)
        # for each state: phrases that end with it, and matches with notices as (notice, place, longest)
        self.whole: list[list[tuple[int, int]]] = []
        self.matches: list[list[tuple[int, int, int]]] = []
        for state in range(len(a.link)):
            whole, longest, up = [], {}, state
            while up > 0:
                for t, place in a.ends[up]:
                    if t < n and a.length[up] >= scanner.least:
                        longest.setdefault((t, place), a.length[up])
                    if t >= n and place == self.sizes[t] - 1 and a.length[a.link[up]] < self.sizes[t] <= a.length[up]:
                        whole.append((t - n, self.sizes[t]))
                up = a.link[up]
            self.whole.append(whole)
            self.matches.append([(t, place, k) for (t, place), k in longest.items()])
        pairs = {(x, y) for s in sequences for x, y in zip(s, s[1:])}
        self.beside, self.phrase_pair = np.zeros((count + 1, count + 1), bool), np.zeros((count + 1, count + 1), bool)
        for x, y in pairs:
            self.beside[x, y] = True
        for s in sequences[n:]:
            for x, y in zip(s, s[1:]):
                self.phrase_pair[x, y] = len(s) == 2
        # phrases of one word have no neighbours
        self.single = {s[0]: k for k, s in enumerate(sequences[n:]) if len(s) == 1}
        joined = np.frombuffer(b"".join(self.words), np.uint8)
        ends = np.cumsum([len(w) for w in self.words])
        sums, inverse = prefix_hash(joined)
        hashes = range_hash(sums, inverse, ends - [len(w) for w in self.words], ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Each word's number; len(self.words) for words that stand nowhere in the notices, as far as hashes tell."""
        sums, inverse = prefix_hash(data)
        h = range_hash(sums, inverse, start, end)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], len(self.words))

    def scan_run(self, first: int, sequence: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """(phrase, word) and (notice, place, word, length) of the full matches in a run of words that begins at word `first`."""
        whole, found, live = [], [], {}
        for k, (state, length) in enumerate(self.automaton.walk(sequence)):
            whole += [(p, first + k - size + 1) for p, size in self.whole[state] if size <= length]
            now = {}
            if length >= self.scanner.least:
                for t, place, longest in self.matches[state]:
                    now[t, k - place] = (place, min(longest, length))
            found += [(t, place - size + 1, first + place + d - size + 1, size) for (t, d), (place, size) in live.items() if (t, d) not in now]
            live = now
        found += [(t, place - size + 1, first + place + d - size + 1, size) for (t, d), (place, size) in live.items()]
        return whole, found

    def chained(self, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(notice, first word, last word, coverage) of the best chain that ends in each match and is part of no longer one."""
        out, gap = [], self.scanner.gap
        for t in sorted({f[0] for f in found}):
            mine = sorted((word, place, size) for n, place, word, size in found if n == t)
            score, begin, goes_on, back = [], [], [False] * len(mine), 0
            widest = max(s for *_, s in mine)
            for k, (word, place, size) in enumerate(mine):
                while mine[back][0] + widest + gap < word:
                    back += 1
                top, via = size, -1
                for j in range(back, k):
                    w, p, s = mine[j]
                    if w >= word or p >= place or word - (w + s) > gap or place - (p + s) > gap:
                        continue
                    shared = max(0, w + s - word, p + s - place)
                    if shared < size and score[j] + size - shared > top:
                        top, via = score[j] + size - shared, j
                score.append(top)
                begin.append(begin[via] if via >= 0 else word)
                if via >= 0:
                    goes_on[via] = True
            out += [(t, begin[k], mine[k][0] + mine[k][2] - 1, min(1.0, score[k] / self.sizes[t])) for k in range(len(mine)) if not goes_on[k]]
        return out

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, list, list, float]]:
        """(n_words, phrases, spans, best coverage) of each text; runs of words are looked for in buffers of some megabytes."""
        raw, offsets = utf8(texts)
        for i, j in slices(offsets):
            data = PLAIN[raw[offsets[i] : offsets[j]]]
            start, end, row = words(data, offsets[i : j + 1] - offsets[i])
            number = self.numbers(data, start, end)
            together = np.zeros(len(number) + 1, bool)  # word k stands beside word k - 1
            if len(number):
                together[1:-1] = self.beside[number[:-1], number[1:]]
            together[row] = False
            edges = np.flatnonzero(np.diff(np.concatenate([[False], together, [False]]).astype(np.int8)))
            first, last = edges[0::2] - 1, edges[1::2] - 1
            size = last - first + 1
            useful = size >= self.scanner.least
            useful |= self.phrase_pair[number[np.minimum(first, len(number) - 1)], number[np.minimum(first + 1, len(number) - 1)]] if len(number) else False
            first, last = first[useful], last[useful]
            where = np.searchsorted(row, first, "right") - 1
            at = np.searchsorted(where, np.arange(j - i + 1))
            single = np.flatnonzero(np.isin(number, list(self.single)))
            of = np.searchsorted(single, row)
            for k in range(j - i):
                whole, found = [(self.single[int(number[w])], int(w - row[k])) for w in single[of[k] : of[k + 1]] if data[start[w] : end[w]].tobytes() == self.words[number[w]]], []
                for a, b in zip(first[at[k] : at[k + 1]].tolist(), last[at[k] : at[k + 1]].tolist()):
                    run = number[a : b + 1].tolist()
                    run = [w if data[start[x] : end[x]].tobytes() == self.words[w] else len(self.words) for x, w in zip(range(a, b + 1), run)]
                    more, matches = self.scan_run(a - int(row[k]), run)
                    whole += more
                    found += matches
                chains = self.chained(found)
                yield int(row[k + 1] - row[k]), whole, apart([c for c in chains if c[3] >= self.scanner.coverage]), max((c[3] for c in chains), default=0.0)


def apart(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Of spans that overlap in the text the one that covers more of its notice stays; then the longer, the earlier and the first notice."""
    kept: list[tuple[int, int]] = []  # in the order of the text
    out = []
    for span in sorted(spans, key=lambda s: (-s[3], s[1] - s[2], s[1], s[0])):
        at = bisect(kept, (span[2], span[2]))
        if not (at and kept[at - 1][1] >= span[1]):
            insort(kept, (span[1], span[2]))
            out.append(span)
    return out


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, n_words, phrases (label, phrase, word), spans (label, notice, first_word, last_word, coverage) and best, the coverage of the best chain even where it is too little for a label."""
    scanner = scanner or Scanner()
    matcher = docs.sparkSession.sparkContext.broadcast(Matcher(scanner))  # its size follows from the notices

    def run(batches):
        m = matcher.value
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("phrases", pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.string()), ("word", pa.int64())]))),
                            ("spans", pa.list_(pa.struct([("label", pa.string()), ("notice", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())]))), ("best", pa.float64())])
        for b in small_batches(batches):
            rows = list(m.scan(b.column("text")))
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()),
                pa.array([[{"label": scanner.phrases[m.phrases[p]], "phrase": m.phrases[p], "word": w} for p, w in sorted(r[1], key=lambda x: (x[1], x[0]))] for r in rows], schema.field("phrases").type),
                pa.array([[{"label": m.labels[t], "notice": t, "first_word": a, "last_word": z, "coverage": c} for t, a, z, c in sorted(r[2], key=lambda x: x[1])] for r in rows], schema.field("spans").type),
                pa.array([r[3] for r in rows], pa.float64())], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCAN)


def report(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and n_spans: what scan() found, in short.

    score is 1 where a phrase stands, else the coverage of the best chain.
    """
    found = scan(docs, scanner)
    word = F.transform("phrases", lambda p: p["word"])
    base = F.transform("phrases", lambda p: p["label"])
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select("doc_id", "n_words", F.size("phrases").cast("bigint").alias("n_base"), F.array_min(word).alias("first_word"), F.array_max(word).alias("last_word"), text(base).alias("base_labels"),
                        text(F.concat(base, F.transform("spans", lambda s: s["label"]))).alias("labels"), F.when(F.size("phrases") > 0, 1.0).otherwise(F.col("best")).alias("score"), F.size("spans").cast("bigint").alias("n_spans"))
