"""Smoothed rates of progress samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from kindred.operators.ranking import ranked
from kindred.plans.tables import bounded, materialize

ALPHA, WEEK = 0.1, 7 * 24 * 3600


def smoothed(samples: DataFrame, keys: list[str], order: list[str], rate: str) -> DataFrame:
    """(keys, ema, samples): the exponential moving average of each key's rates in their order, of
    which the first one starts it. Samples without a rate do not count.

    The average is a sum in which a sample's weight depends on its place alone, so places are taken
    (of hot keys in parts) and weighted rates are summed; no key's samples meet in one row."""
    rows = samples.filter(F.col(rate).isNotNull()).select(*keys, *order, F.col(rate).cast("double").alias("_rate"))
    counts = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "samples")
    placed = ranked(rows, keys, order, "_place", counts)
    told = placed.join(bounded(counts), keys)
    after = F.col("n") - F.col("_place")
    weight = F.pow(F.lit(1 - ALPHA), after.cast("double")) * F.when(F.col("_place") == 1, 1.0).otherwise(ALPHA)
    return told.groupBy(*keys).agg(F.sum(F.col("_rate") * weight).alias("ema"), F.max("n").alias("samples"))


def smoothed_stream(samples: DataFrame, key: str, order: str, rate: str) -> DataFrame:
    """The same over a stream, in the order of its micro-batches and inside each by ``order``:
    (key as string, ema, samples) in update mode. A key's state is one average and one count."""
    def step(at: tuple, batches, state) -> Iterator[pd.DataFrame]:
        ema, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        for v in rows["rate"].tolist():
            ema, n = v if ema is None else ema + ALPHA * (v - ema), n + 1
        state.update((ema, n))
        yield pd.DataFrame({"key": [at[0]], "ema": [ema], "samples": [n]})

    rows = samples.filter(F.col(rate).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(order).alias("at"), F.col(rate).cast("double").alias("rate"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, ema double, samples long", "ema double, samples long", "update", GroupStateTimeout.NoTimeout)


def remaining_seconds(left: Column, rate: Column) -> Column:
    """Null without a rate, and beyond a week."""
    seconds = F.when(rate > 0, left / rate)
    return F.when(seconds <= WEEK, seconds)
