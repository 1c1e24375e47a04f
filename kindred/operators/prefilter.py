"""Bloom filters: which rows may have a key of a list that is too long to send to every task.

Tasks turn keys into bit positions, and Spark puts the bits together by word with an aggregate that
merges, so no list of keys meets anywhere. The filter has a bounded size; how often it lets a row
pass in error follows from how full it is, and is reported."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rate of false positives that is asked for, and its bounds; bits of a filter at most (32 MB).
RATE, LEAST_RATE, MOST_RATE = 0.01, 0.0001, 0.1
MOST_BITS = 1 << 28


def _positions(columns: list[Column], bits: int, hashes: int) -> Column:
    """The bits of a key. Nulls are values like others."""
    first, step = (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(bits)) for seed in (0, 1))
    return F.array(*[F.pmod(first + i * (step + 1), F.lit(bits)) for i in range(hashes)])


@dataclass
class BloomFilter:
    """words: the bits, 64 each; hashes: of a key; keys: how many were put in."""

    words: np.ndarray
    hashes: int
    keys: int

    @classmethod
    def of(cls, keys: DataFrame, rate: float = RATE, count: int | None = None) -> BloomFilter:
        """The filter of the rows of ``keys`` at a rate between LEAST_RATE and MOST_RATE, or at a
        higher one where its size reaches its bound. ``count``: of the rows, if it is known."""
        n = keys.count() if count is None else count
        rate = min(max(rate, LEAST_RATE), MOST_RATE)
        bits = 64 * ceil(min(MOST_BITS, max(64, -n * log(rate) / log(2) ** 2)) / 64)
        hashes = max(1, round(bits / max(1, n) * log(2))) if n * 64 > bits else 8
        at = keys.select(F.explode(_positions([F.col(f"`{c}`") for c in keys.columns], bits, hashes)).alias("at"))
        bit = F.expr("shiftleft(1L, CAST(at % 64 AS int))")
        found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()  # bits / 64 rows at most
        words = np.zeros(bits // 64, np.uint64)
        words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
        return cls(words, hashes, n)

    @property
    def rate(self) -> float:
        """The share of other keys that pass, by how full the filter is."""
        return float(np.bitwise_count(self.words).sum() / (64 * len(self.words))) ** self.hashes

    def may_hold(self, df: DataFrame, *columns: str) -> Column:
        """Whether a row's key may be in; never false for one that is."""
        sent = df.sparkSession.sparkContext.broadcast(self.words)  # MOST_BITS at most

        @F.pandas_udf("boolean")
        def test(positions: pd.Series) -> pd.Series:
            if not len(positions):
                return pd.Series([], dtype=bool)
            at = np.stack(positions.to_numpy())
            return pd.Series(((sent.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1))

        return test(_positions([F.col(f"`{c}`") for c in columns], 64 * len(self.words), self.hashes))
