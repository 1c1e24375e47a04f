"""Plumbing that the corpus operators share: gapless ranks, and the package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.plans.tables import bounded, discard, drop, materialize, scratch, shared_dir

__all__ = ["bounded", "discard", "drop", "gapless_rank", "materialize", "scratch", "shared_dir", "ship"]


def gapless_rank(df: DataFrame, group: list[str], cell: str, order: list[Column], name: str) -> DataFrame:
    """Number the rows of each ``group`` from 0 without gaps, as ``name``.

    ``cell`` splits a group into parts small enough for one task each. Rows are numbered inside
    their cell; the cells' starts come from running sums over the (group, cell) counts, so no
    task ever holds a whole hot group. The rows are shuffled once, by (group, cell).
    """
    keys = [*group, cell]
    starts = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_n")
    )
    for k in keys:
        starts = starts.withColumnRenamed(k, f"_g_{k}")
    numbered = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    on = [numbered[k].eqNullSafe(starts[f"_g_{k}"]) for k in keys]
    return numbered.join(starts, on).withColumn(name, F.col("_start") + F.col("_rn") - 1).drop("_rn", "_start", *[f"_g_{k}" for k in keys])


#: Rows and bytes of an Arrow batch. Texts may be long, and a worker holds a batch and what it
#: makes of it; a batch ends with the row that goes over its bytes.
BATCH_ROWS, DEFAULT_BATCH_ROWS, BATCH_BYTES = 1000, 10_000, 16 << 20
_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Let the executors import this package: send it to them, once a session. Arrow batches are
    made smaller for the rest of the session, where it has not chosen their size: plans read that
    setting when they run, which is after an operator has returned."""
    sc = spark.sparkContext
    if int(spark.conf.get(_BATCH, str(DEFAULT_BATCH_ROWS))) == DEFAULT_BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
        spark.conf.set(_BYTES, str(BATCH_BYTES))
    if getattr(sc, "_kindred_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="kindred-")) / "kindred.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(to))
    sc._kindred_shipped = True
