"""The ratio of matching blocks of two texts, for those who need it instead of edit distance."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ratios(first: list[str | None], second: list[str | None], least: float = 0.0) -> list[float]:
    """For each pair twice the letters in matching blocks over all letters of both, texts trimmed and in lower case; null and blank give 0.

    The longest common block is found first, then those left and right of it, and so on. Pairs
    that cannot reach `least`, by their lengths or by their letters, give 0 unexamined. Pairs
    with one second text follow each other, so its index is built once.
    """
    out = [0.0] * len(first)
    texts = [tuple("" if x is None else x.strip().lower() for x in pair) for pair in zip(first, second)]
    matcher, letters, held = SequenceMatcher(), Counter(), None
    for k in sorted(range(len(texts)), key=lambda k: texts[k][1]):
        a, b = texts[k]
        if not a or not b or 2 * min(len(a), len(b)) < least * (len(a) + len(b)):
            continue
        if a == b:
            out[k] = 1.0
            continue
        if b != held:
            matcher.set_seq2(b)
            letters, held = Counter(b), b
        if least and 2 * sum(min(n, letters[c]) for c, n in Counter(a).items()) < least * (len(a) + len(b)):
            continue
        matcher.set_seq1(a)
        out[k] = matcher.ratio()
    return out


def matching_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """Ratio of matching blocks of two columns, a before b as it can depend on their order; values that stay below `least` may come as 0."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        plain = lambda s: s.astype(object).where(s.notna(), None).tolist()
        return pd.Series(ratios(plain(x), plain(y), least), dtype="float64")

    return ratio(a.cast("string"), b.cast("string"))
