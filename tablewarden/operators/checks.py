"""Checks of one's own for rules of kind aggregate: functions over frames, gaps in a calendar, check digits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from .rules import BatchCheck


@dataclass
class FrameCheck(BatchCheck):
    """A function of a pandas frame that gives (rows that count, bad rows), applied to one batch after another and added up; so it has to judge rows one by one."""

    columns: list[str]
    check: Callable[[pd.DataFrame], tuple[int, int]]

    def add(self, state, batch):
        n, bad = self.check(batch.to_pandas())
        return [state[0] + int(n), state[1] + int(bad)]


@dataclass
class GapCheck(BatchCheck):
    """Days from the first to the last of a date column that have no row; the state holds each day once."""

    column: str

    @property
    def columns(self):
        return [self.column]

    def start(self):
        return np.zeros(0, np.int32)

    def add(self, state, batch):
        days = pc.drop_null(pc.unique(batch.column(0).cast(pa.date32())))
        return np.union1d(state, np.asarray(days.cast(pa.int32())))

    def merge(self, a, b):
        return np.union1d(a, b)

    def result(self, state):
        if not len(state):
            return 0, 0
        span = int(state[-1]) - int(state[0]) + 1
        return span, span - len(state)


@dataclass
class CheckDigit(BatchCheck):
    """Whole numbers whose last digit is not the check digit of the others (every second digit from the right doubled, its digits added, the sum a multiple of ten); null and negative ones are bad."""

    column: str

    @property
    def columns(self):
        return [self.column]

    def add(self, state, batch):
        values = batch.column(0).cast(pa.int64())
        x = np.asarray(pc.fill_null(values, -1))
        rest, total, place = np.maximum(x, 0), np.zeros(len(x), np.int64), 0
        while rest.any():
            digit = rest % 10
            total += np.where(place % 2 == 1, digit * 2 - 9 * (digit > 4), digit)
            rest, place = rest // 10, place + 1
        return [state[0] + len(x), state[1] + int(((x < 0) | (total % 10 != 0)).sum())]
