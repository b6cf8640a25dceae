"""Scores of all pairs of two lists of rows, in numpy: letters rule most pairs out, what is left is measured exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .blocks import ratios

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE = np.uint64(1)


def edit_distance(a: str, b: str) -> int:
    """The edit distance by bit vectors of any length."""
    if not a:
        return len(b)
    full, at = (1 << len(a)) - 1, {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    up, down, far, top = full, 0, len(a), 1 << (len(a) - 1)
    for c in b:
        eq = at.get(c, 0)
        xv, xh = eq | down, (((eq & up) + up) ^ up) | eq
        ph, mh = (down | ~(xh | up)) & full, up & xh
        far += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & full, (mh << 1) & full
        up, down = (mh | ~(xv | ph)) & full, ph & xv
    return far


class Likeness:
    """Likeness of pairs among some texts, by place in `texts`: fuzzy (texts as given) or blocks (trimmed, in lower case, the order of a pair counts). Values below `least` may come as 0."""

    def __init__(self, texts: list[str], kind: str, least: float):
        self.texts, self.kind, self.least = texts, kind, least
        plain = self.plain = [x.strip().lower() for x in texts] if kind == "blocks" else texts
        self.lengths = np.array([len(x) for x in plain], dtype=np.int64)
        codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        signs, codes = np.unique(codes, return_inverse=True)
        rows = np.repeat(np.arange(len(plain)), self.lengths)
        places = np.arange(len(codes)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        # letters beyond those that all texts have, in 16 kinds with four bits each: bits of one that the other lacks are letters it lacks
        kinds = np.zeros((len(plain), 16), dtype=np.int64)
        order = np.argsort(-np.bincount(codes, minlength=len(signs)), kind="stable")
        each = {}
        for rank, sign in enumerate(order.tolist()):
            each[sign] = np.bincount(rows[codes == sign], minlength=len(plain)) if rank < 64 else None
        spare = [(sign, n - n.min()) for sign, n in each.items() if n is not None]
        spare.sort(key=lambda x: -int(x[1].sum()))
        for k, (_, n) in enumerate(spare):
            kinds[:, k % 16] += n
        self.bits = np.zeros(len(plain), dtype=np.uint64)
        for k in range(16):
            self.bits |= ((_ONE << np.minimum(kinds[:, k], 4).astype(np.uint64)) - _ONE) << np.uint64(4 * k)
        # by text and letter where it stands; of texts of more than 64 letters, or with very many letters, no table
        self.short = (self.lengths <= 64) & (len(plain) * (len(signs) + 1) <= 8_000_000)
        self.at = np.zeros((len(plain) if self.short.any() else 0, len(signs) + 1), dtype=np.uint64)
        self.letters = np.full((len(plain), int(self.lengths[self.short].max(initial=0))), len(signs), dtype=np.int64)
        some = self.short[rows]
        np.bitwise_or.at(self.at, (rows[some], codes[some]), _ONE << places[some].astype(np.uint64)) if some.any() else None
        self.letters[rows[some], places[some]] = codes[some]

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of places, -1 for null."""
        out = np.zeros(len(a))
        if not self.texts:
            return out
        n, m, p, q = self.lengths[a], self.lengths[b], self.bits[a], self.bits[b]
        more, less = np.bitwise_count(p & ~q), np.bitwise_count(q & ~p)
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.kind == "fuzzy":
                able = 1 - np.maximum(np.maximum(more, less), np.abs(n - m)) / np.maximum(n, m) >= self.least
            else:
                able = 2.0 * np.minimum(n - more, m - less) / (n + m) >= self.least
        left = np.flatnonzero(able & (a >= 0) & (b >= 0) & (n > 0) & (m > 0))
        a, b = a[left], b[left]
        out[left] = self._fuzzy(a, b) if self.kind == "fuzzy" else self._blocks(a, b)
        return out

    def _fuzzy(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        far, short = np.zeros(len(a), dtype=np.int64), self.short[a] & self.short[b]
        far[short] = self._distances(a[short], b[short])
        for k in np.flatnonzero(~short).tolist():
            far[k] = edit_distance(self.texts[a[k]], self.texts[b[k]])
        return 1 - far / np.maximum(self.lengths[a], self.lengths[b])

    def _distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, m = self.lengths[a], self.lengths[b]
        far, top = n.copy(), (n - 1).astype(np.uint64)
        up, down = np.full(len(a), _ALL), np.zeros(len(a), dtype=np.uint64)
        for j in range(int(m.max(initial=0))):
            eq = self.at[a, self.letters[b, j]]
            xv, xh = eq | down, (((eq & up) + up) ^ up) | eq
            ph, mh = down | ~(xh | up), up & xh
            far += np.where(j < m, ((ph >> top) & _ONE).astype(np.int64) - ((mh >> top) & _ONE).astype(np.int64), 0)
            ph, mh = (ph << _ONE) | _ONE, mh << _ONE
            up, down = mh | ~(xv | ph), ph & xv
        return far

    def _blocks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Matching blocks are a common subsequence, so its longest is a bound of theirs."""
        out, able = np.zeros(len(a)), np.ones(len(a), dtype=bool)
        short = np.flatnonzero(self.short[a] & self.short[b])
        if len(short):
            x, y = a[short], b[short]
            free = np.full(len(x), _ALL)
            for j in range(int(self.lengths[y].max())):
                eq = free & self.at[x, self.letters[y, j]]
                free = (free + eq) | (free - eq)
            able[short] = 2.0 * np.bitwise_count(~free & (_ALL >> (64 - self.lengths[x]).astype(np.uint64))) / (self.lengths[x] + self.lengths[y]) >= self.least
        left = np.flatnonzero(able)
        out[left] = ratios([self.texts[k] for k in a[left].tolist()], [self.texts[k] for k in b[left].tolist()], self.least)
        return out


def tile_scores(matches: list[tuple[str, float, str, float]], named: bool, pairs_a_batch: int = 200_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over the rows of a tile (_side 0 or 1, _i, _j, _key, _m0, _m1, ...), for (column, weight, kind, threshold) of each match, that gives a, b, score and, if named, matched_on."""
    total = float(sum(m[1] for m in matches))
    names = [sorted(m[0] for k, m in enumerate(matches) if hits >> k & 1) for hits in range(1 << len(matches))] if named else None

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        if not rows.num_rows:
            return
        side, apart = rows["_side"].to_numpy(), rows["_i"][0].as_py() < rows["_j"][0].as_py()
        keys, held = rows["_key"].combine_chunks(), rows["_key"].to_pylist()
        rank = {x: k for k, x in enumerate(sorted(set(held)))}
        order = np.array([rank[x] for x in held])
        texts, alike = [], []
        for k, (_, _, kind, least) in enumerate(matches):
            place: dict[str, int] = {}
            texts.append(np.array([-1 if x is None else place.setdefault(x, len(place)) for x in rows[f"_m{k}"].to_pylist()]))
            alike.append(None if kind == "exact" else Likeness(list(place), kind, least))
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        step = max(1, pairs_a_batch // max(1, len(second)))
        for k in range(0, len(first), step):
            x, y = np.repeat(first[k:k + step], len(second)), np.tile(second, len(first[k:k + step]))
            right = order[x] < order[y]
            kept = order[x] != order[y] if apart else right
            x, y, right = x[kept], y[kept], right[kept]
            a, b = np.where(right, x, y), np.where(right, y, x)
            score, hits = np.zeros(len(a)), np.zeros(len(a), dtype=np.int64)
            for bit, ((_, weight, kind, least), at, like) in enumerate(zip(matches, texts, alike)):
                p, q = at[a], at[b]
                value = ((p == q) & (p >= 0)).astype(float) if like is None else like(p, q)
                hit = value >= (1.0 if kind == "exact" else least)
                score += np.where(hit, weight * value, 0.0)
                hits |= hit.astype(np.int64) << bit
            out = [keys.take(pa.array(a)), keys.take(pa.array(b)), pa.array(score / total)]
            if named:
                out.append(pa.array(names, pa.list_(pa.string())).take(pa.array(hits)))
            yield pa.RecordBatch.from_arrays(out, ["a", "b", "score", "matched_on"][:len(out)])

    return scores
