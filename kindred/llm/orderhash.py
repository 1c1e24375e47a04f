"""Order MinHash fingerprints, whose likeness follows the edit distance, in SQL functions only.

A text is the sequence of its k-word runs. Equal runs are numbered by occurrence, so that counts
matter, and every (run, occurrence) is hashed once. Each entry of the fingerprint has an order of
its own on these hashes and takes the two least runs of the whole text; put in text order, they
are hashed together. Two texts share an entry when they share both runs and their order, so
moving text costs likeness even where a plain MinHash would not see it.

The order of entry i: the hash deals a run to one of as many cells as there are entries; cell i
comes first, the other cells follow by a hash of i and the cell, and runs of one cell by their
own hash. The two least runs of each cell are therefore all that any entry can ask for, and every
text of two runs or more has order in all entries, however short it is. The orders of the cells
are the same for all rows: one literal of the plan.

Everything happens inside a row, in sorted arrays of packed longs (32 bits of hash, 31 of
position, as many as an array can have): occurrence numbers come from a galloping search in the
sorted runs, so time is n log n for any text, and nothing is exploded or shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN_WORDS, ENTRIES = 3, 64
#: Cells of an order that are looked at first; where they hold less than two runs, all are.
NEAR_CELLS = 6
HASH_BITS, POS_BITS = 32, 31
SPACE = r"[\x20\x09-\x0D]+"
#: Rows between two of the places at which the table is cut for the walk to the next document;
#: beyond so many places there are more rows between them, up to the most. The buckets are also
#: what the fingerprints are computed by, so there are more of them than tasks even in small tables.
LEAST_ROWS, PLACES, BUCKET_ROWS = 500, 10_000, 1 << 17


def _high(x: Column) -> Column:
    return F.shiftright(x, POS_BITS)


def _pos(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << POS_BITS) - 1))


def _pack(h: Column, pos: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(h, 64 - HASH_BITS), POS_BITS).bitwiseOR(pos)


def cell_orders(entries: int = ENTRIES) -> list[list[int]]:
    """The order of the cells for each entry: its own, then by the hash of entry and cell."""

    def rank(i: int, c: int) -> tuple[bool, int, int]:
        h = 42
        for x in (i, c):
            h = xxhash.xxh64_intdigest(x.to_bytes(4, "little"), h)
        return c != i, h >> 24, c

    return [sorted(range(entries), key=lambda c: rank(i, c)) for i in range(entries)]


def with_entries(df: DataFrame, text: str, out: str, entries: int = ENTRIES, run: int = RUN_WORDS) -> DataFrame:
    """Add ``out``: the entries of ``text`` in order, entry number above 32 bits of hash;
    ``entries`` is a power of two.

    Null and wordless texts have no entries. Runs that the text's end cuts short are runs too. A
    text with a single run has it in every entry. Two runs whose 32 bits of hash agree count as
    equal, which is one chance in four thousand millions for each pair."""
    cell_bits = entries.bit_length() - 1
    words, runs, numbered, least, cells, firsts, pairs = (f"_{out}_{x}" for x in ("words", "runs", "numbered", "least", "cells", "firsts", "pairs"))

    def at(name: str, i: Column) -> Column:
        return F.get(F.col(name), i)

    def occurrence(x: Column, i: Column) -> Column:
        same = lambda back: F.coalesce(_high(at(runs, i - back)) == _high(x), F.lit(False))
        gallop = F.aggregate(
            F.array(*[F.lit(1 << b) for b in reversed(range(POS_BITS))]),
            F.lit(0),
            lambda c, step: F.when(same(c + step), c + step).otherwise(c),
        )
        return F.when(~same(F.lit(1)), 0).when(~same(F.lit(2)), 1).when(~same(F.lit(3)), 2).otherwise(gallop)

    cell = lambda x: F.shiftright(x, POS_BITS + HASH_BITS - cell_bits).cast("int")

    # Read from a constant text, the orders are one literal of the plan.
    orders = F.from_json(F.lit(json.dumps(cell_orders(entries))), "array<array<int>>")

    def two_least(i: Column) -> Column:
        """The two runs that come first for entry i, from the first cells of its order that have any."""
        order = F.get(orders, i)
        both = lambda c: F.coalesce(at(cells, at(firsts, c)) == c, F.lit(False))
        runs_of = lambda c: F.slice(F.col(least), at(firsts, c), F.when(both(c), 2).otherwise(1))
        held = lambda cs: F.filter(cs, lambda c: at(firsts, c) > 0)
        near = held(F.slice(order, 1, NEAR_CELLS))
        return F.flatten(F.transform(F.slice(F.when(F.size(near) > 1, near).otherwise(held(order)), 1, 2), runs_of))

    def pair(first: Column, i: Column) -> Column:
        """``first``: where the entry's own cell begins, from 1; 0 if it has no run."""
        whole = (first > 0) & F.coalesce(at(cells, first) == i, F.lit(False))
        return F.when(whole, F.array(at(least, first - 1), at(least, first))).otherwise(two_least(i))

    def signature(p: Column, i: Column) -> Column:
        """A null second run is left out of the hash."""
        a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        h = F.when(_pos(b) < _pos(a), F.xxhash64(_high(b), _high(a))).otherwise(F.xxhash64(_high(a), _high(b)))
        return F.shiftleft(i.cast("long"), HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - HASH_BITS))

    return (
        df.withColumn(words, F.transform(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), ""), lambda w: F.xxhash64(w)))
        .withColumn(runs, F.sort_array(F.transform(F.col(words), lambda w, i: _pack(F.xxhash64(w, *[at(words, i + j) for j in range(1, run)]), i.cast("long")))))
        .withColumn(numbered, F.sort_array(F.transform(F.col(runs), lambda x, i: _pack(F.xxhash64(_high(x), occurrence(x, i).cast("int")), _pos(x)))))
        .withColumn(least, F.filter(F.col(numbered), lambda x, i: ~F.coalesce(cell(at(numbered, i - 2)) == cell(x), F.lit(False))))
        .withColumn(cells, F.transform(F.col(least), cell))
        .withColumn(firsts, F.when(F.size(least) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(entries - 1)), lambda i: F.array_position(F.col(cells), i).cast("int"))))
        .withColumn(pairs, F.transform(F.col(firsts), pair))
        .withColumn(out, F.transform(F.col(pairs), signature))
        .drop(words, runs, numbered, least, cells, firsts, pairs)
    )


def digest(entries: Column) -> Column:
    """The fingerprint as text: eight hex digits for each entry, in order."""
    return F.array_join(F.transform(entries, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit((1 << HASH_BITS) - 1))), 8, "0")), "")


def likeness(a: Column, b: Column, entries: int = ENTRIES) -> Column:
    """0 to 1, from the share of entries that agree. Both runs of an entry must survive for it to
    agree, so the square root estimates the share of runs that do. Two texts without entries are
    alike (1), one without and one with are not (0)."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.sqrt(F.size(F.array_intersect(a, b)) / F.lit(float(entries))))


def with_next(df: DataFrame, key: str, columns: list[str], tie: str, dealt_with: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Add ``next_<column>`` of the next row by descending ``key`` (null last); after the last
    comes the first. ``dealt_with`` adds columns to the rows once they are dealt to their buckets,
    so they need not be shuffled; ``columns`` may name them. Rows with equal keys follow each other by the hash of ``tie``, then by
    ``tie``, so a key that many rows share is cut like any other; only rows that repeat in both
    stay together.

    The table is cut at rows of its own, one for each bucket that a range partitioning of the keys
    alone makes, so buckets follow the number of rows. A row at a cut is dealt to the bucket before
    it too, so each side sees its last row's follower, and no window spans the table."""
    low = -(1 << 63)
    k = F.bitwise_not(F.coalesce(F.col(key).cast("long"), F.lit(low)))  # ascending where the key descends
    place = F.struct(k.alias("k"), F.col(key).isNull().cast("int").alias("z"), F.xxhash64(tie).alias("h"))
    keys = df.select(place.alias("_o"))
    total = keys.count()
    buckets = max(1, total // BUCKET_ROWS, min(total // LEAST_ROWS, PLACES))
    found = keys.repartitionByRange(buckets, "_o").groupBy(F.spark_partition_id()).agg(F.min("_o").alias("o")).collect()  # a row for each bucket
    cuts = sorted({tuple(r["o"]) for r in found}) or [(0, 0, 0)]
    # Read from a constant text, the cuts are one literal of the plan however many they are.
    held = F.from_json(F.lit(json.dumps([{"k": a, "z": z, "h": h} for a, z, h in cuts])), "array<struct<k:bigint,z:int,h:bigint>>")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
    upto = F.aggregate(steps, F.lit(0), lambda c, s: F.when(F.coalesce(F.get(held, c + s - 1) <= F.col("_o"), F.lit(False)), c + s).otherwise(c))
    b = F.col("_b")
    own = F.struct(b.alias("b"), F.lit(0).alias("ghost"))
    before = F.struct(F.when(b == 0, len(cuts) - 1).otherwise(b - 1).alias("b"), F.lit(1).alias("ghost"))
    dealt = (
        df.withColumn("_o", place).withColumn("_b", upto - 1)
        .withColumn("_to", F.explode(F.when(F.col("_o") == F.get(held, b), F.array(own, before)).otherwise(F.array(own))))
        .withColumn("_b", F.col("_to.b")).withColumn("_ghost", F.col("_to.ghost")).drop("_to")
    )
    w = Window.partitionBy("_b").orderBy("_ghost", "_o", tie)
    dealt = dealt_with(dealt.repartition("_b"))
    for c in columns:
        dealt = dealt.withColumn(f"next_{c}", F.lead(c).over(w))
    return dealt.filter(F.col("_ghost") == 0).drop("_o", "_b", "_ghost")


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of
    every row: its text (null: empty), and the text whose last third gives way to the start of the
    next row's by descending key. Other columns of the input are left out. Rows with one key follow
    each other by a hash of their texts; a table of one row is followed by itself; repeated rows
    are rows of their own; texts of any length are read whole; an empty table stays empty."""
    rows = df.select(F.col(f"`{key}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    rows = with_next(rows, "_id", ["_text", "_own"], "_text", lambda held: with_entries(held, "_text", "_own"))
    n = F.length("_text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.col("_text").substr(F.lit(1), n - third), F.col("next__text").substr(F.lit(1), third))
    rows = rows.select("_id", n.cast("long").alias("n_chars"), edited.alias("_edited"), "_own", "next__own").transform(with_entries, "_edited", "_new")
    return rows.select(
        F.col("_id").alias(key), "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), digest(F.col("_own")).alias("fingerprint"), digest(F.col("_new")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_new")).alias("near_edited"), likeness(F.col("_own"), F.col("next__own")).alias("near_next"),
    )


def op9_order_minhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
