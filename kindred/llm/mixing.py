"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Tokens are summed by source and by the leading bits of each row's hash. Running sums over that
histogram find the bucket in which a source's budget ends; only that bucket is split further, 15
bits a round, until one hash value is left. Rows below the threshold are in, rows above are out:
a filter, no sort. A target of more than once the source is whole copies plus such a threshold,
so the rows of a smaller budget are always among those of a larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import discard, gapless_rank, materialize

DIGIT_BITS, DIGITS = 15, 4
#: Of a digit, the bits of a run of buckets that is summed in one task.
RUN_BITS = 8
#: A word, for counting.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(*cols: Column) -> Column:
    """60 bits of an MD5 over the columns, null apart from any text."""
    joined = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\u0001")) for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, DIGIT_BITS * DIGITS // 4), 16, 10).cast("long")


def targets(totals: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """From (source, source_size): the target of every source.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all
    sizes. A target stops at ``most`` times its source; what is above goes to the rest by weight.
    The stopped sources are the first by most * size / weight, so one pass of running sums finds
    the level at which the others stand."""
    by_name, all_rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    w = F.array(*[F.lit(float(x)) for x in weights])
    return (
        totals.withColumn("_rank", F.row_number().over(by_name))
        .withColumn("_w", F.element_at(w, F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1))
        .withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("_level", (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("_cap").over(by_ratio), F.lit(0.0))) / (F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(by_ratio), F.lit(0.0))))
        .withColumn("_level", F.max("_level").over(all_rows))
        .select("source", "source_size", F.least(F.col("_cap"), F.col("_level") * F.col("_w")).alias("target"))
    )


def running(hist: DataFrame) -> DataFrame:
    """Add upto, the sum of s up to each prefix of its source. A source's buckets are summed in
    runs of a few hundred, and the runs' sums are run up apart, so no task holds a whole source."""
    hist = hist.withColumn("_run", F.shiftright("prefix", RUN_BITS))
    inside = F.sum("s").over(Window.partitionBy("source", "_run").orderBy("prefix"))
    runs = hist.groupBy(F.col("source").alias("_s"), F.col("_run").alias("_r")).agg(F.sum("s").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("_s").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("_before", before).drop("_sum")
    found = hist.withColumn("_inside", inside).join(runs, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_run") == F.col("_r")))
    return found.withColumn("upto", F.col("_before") + F.col("_inside")).drop("_run", "_inside", "_s", "_r", "_before")


def thresholds(rows: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """From rows (source, size, h): for each source its target, whole copies, the hash below which
    a row counts once more, and how many of the rows at that hash do."""
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    goal = materialize(
        goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")),
        "mix_goal",
    )
    state = goal.select("source", "rest", F.lit(0).cast("long").alias("prefix"))
    hists = []
    for level in range(DIGITS):
        shift = DIGIT_BITS * (DIGITS - 1 - level)
        at = state.select(F.col("source").alias("_s"), "rest", "prefix")
        hist = (
            rows.join(at, rows["source"].eqNullSafe(at["_s"]) & (F.shiftright("h", shift + DIGIT_BITS) == F.col("prefix")))
            .groupBy("source", "rest", F.shiftright("h", shift).alias("prefix"))
            .agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
        )
        hists.append(materialize(hist, "mix_histogram"))  # summed up twice below, in each further round
        hist = hists[-1]
        state = running(hist).filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("s") <= F.col("rest"))).select("source", (F.col("rest") - (F.col("upto") - F.col("s"))).alias("rest"), "prefix", "s", "n")
    end = state.select(F.col("source").alias("_s"), F.col("prefix").alias("bound"), F.least("n", F.floor(F.col("rest") / (F.col("s") / F.col("n")) + 0.5)).alias("ties"), F.col("n").alias("tied"))
    out = goal.join(end, goal["source"].eqNullSafe(end["_s"]), "left")
    ends = F.when(out["rest"] > 0, F.col("bound"))  # else whole copies are all, even for rows without words
    plan = materialize(out.select("source", "source_size", "target", "whole", F.coalesce(ends, F.lit(0)).alias("bound"), F.coalesce("ties", F.lit(0)).cast("long").alias("ties"), F.coalesce("tied", F.lit(0)).cast("long").alias("tied")), "mix_plan")
    discard(goal, *hists)
    return plan


def apply_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add source_size, target and copies to rows (source, size, h, ...). Only where several rows
    share the very hash at which a budget ends are those rows, and no others, ranked."""
    p = plan.withColumnRenamed("source", "_s")
    marked = rows.join(p, rows["source"].eqNullSafe(p["_s"])).drop("_s")
    split = (F.col("h") == F.col("bound")) & (F.col("ties") > 0) & (F.col("ties") < F.col("tied"))
    sure = marked.filter(~split).withColumn("copies", F.col("whole") + F.when((F.col("h") < F.col("bound")) | ((F.col("h") == F.col("bound")) & (F.col("ties") > 0)), 1).otherwise(0))
    if plan.filter((F.col("ties") > 0) & (F.col("ties") < F.col("tied"))).isEmpty():
        return sure.drop("whole", "bound", "ties", "tied")
    cols = [c for c in marked.columns]
    tied = materialize(marked.filter(split).withColumn("_uid", F.monotonically_increasing_id()), "mix_ties").withColumn("_cell", F.shiftright("_uid", 12))
    tied = gapless_rank(tied, ["source"], "_cell", [F.col("_uid")], "_rank")
    return sure.unionByName(tied.withColumn("copies", F.col("whole") + F.when(F.col("_rank") < F.col("ties"), 1).otherwise(0)).select(*cols, "copies")).drop("whole", "bound", "ties", "tied")


def mix(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = (5, 2, 1), most: float = 3) -> DataFrame:
    """Every row of ``df`` with ``size`` (words of its text), ``source_size``, ``target`` and
    ``copies``: how often the mix takes the row, 0 to ``most``.

    A null text has no words, a null source is a source of its own. Which rows are in depends on a
    hash of key, source and text alone, so runs agree; repeated rows share a hash, and as many of
    them are taken as the budget asks for. A source ends within half a row of its target. Columns
    of the input that are named like an added one are replaced. Empty tables give empty results.
    """
    added = ("size", "source_size", "target", "copies")
    keep = [c for c in df.columns if c not in added]
    names = {c: f"c{i}" for i, c in enumerate(keep)}
    given = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    rows = given.withColumn("source", F.col(names[source])).withColumn("size", words(F.col(names[text]))).withColumn("h", row_hash(F.col(names[key]), F.col(names[source]), F.col(names[text])))
    plan = thresholds(materialize(rows.select("source", "size", "h"), "mix_rows"), weights, most)
    return apply_plan(rows, plan).select(*[F.col(n).alias(c) for c, n in names.items()], *added)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    slim = materialize(docs.select("doc_id", "source", words(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("source"), F.col("text")).alias("h")), "mix_rows")
    out = apply_plan(slim, thresholds(slim.select("source", "size", "h"), (5, 2, 1), 3))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, chr(1)), coalesce(source, chr(1)), coalesce(text, chr(1)))), 1, 15))::BIGINT AS h
  FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 3.0::DOUBLE * source_size AS cap FROM t),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM g),
c AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN size > 0 AND before <= rest AND (before + size <= rest OR floor((rest - before) / size + 0.5) >= 1) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
