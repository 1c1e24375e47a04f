"""Hamming joins at larger distances: few wide bands of bits, looked up within a radius.

Deal radii to the bands so that the sum of radius + 1 is ``most`` + 1. Two fingerprints within
``most`` then agree in some band but for its radius (if each band differed by more, they would
differ by more in all). So each fingerprint is stored once a band and probes the values around its
own. The upper bits of a band, its region, decide which task a row goes to: a probe visits only the
few regions within the radius, and looks up what lies around it inside the task. That keeps the
rows that move to a few dozens for a fingerprint, however many values lie within the radius.

How many bands there are and how radii are dealt is a matter of cost: what a band would give as
candidates is measured on a sample, so a band in which fingerprints hardly differ gets a small
radius, or none. The result does not depend on it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from math import ceil, comb, inf, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 64
#: Fingerprints, and pairs of them, that the costs are measured on.
SAMPLE, SAMPLE_PAIRS = 20_000, 1_000_000
#: Microseconds to move a row, to look up a value (by a table of values, or by search), to compare
#: a candidate, and to begin with a value in a task.
MOVE, LOOK, SEARCH, COMPARE, BEGIN = 1.0, 0.02, 0.15, 0.01, 25.0
WIDEST_RADIUS, TABLE_BITS = 4, 16
#: Stored fingerprints and probes of a task, beyond which a region is cut into blocks; candidates
#: that a task holds at a time; fingerprints from which on regions are told apart at all.
STORED, PROBES, CHUNK, SMALL = 1 << 20, 1 << 22, 1 << 21, 20_000
MOST_REGION_BITS = 10


def around(bits: int, radius: int) -> int:
    """How many values of so many bits lie within a radius."""
    return sum(comb(bits, k) for k in range(radius + 1))


@cache
def flips(bits: int, radius: int) -> tuple[int, ...]:
    """These values, around 0."""
    out, last = [0], [(0, 0)]
    for _ in range(min(radius, bits)):
        last = [(v | 1 << b, b + 1) for v, low in last for b in range(low, bits)]
        out += [v for v, _ in last]
    return tuple(out)


@dataclass(frozen=True)
class Band:
    """Bits start to start + width - 1, looked up within ``radius`` (-1: not at all); the upper
    ``region`` bits of it choose the task."""

    start: int
    width: int
    radius: int
    region: int = 0

    @property
    def mask(self) -> int:
        return ((1 << self.width) - 1) << self.start


def _costs(values: int, band: Band, share: list[float]) -> float:
    """Seconds of one core, about, for a band; ``share``: of all pairs, by radius."""
    r = band.radius
    if r < 0:
        return 0.0
    if r > band.width:
        return inf
    tried = around(band.width, r)
    look = LOOK if band.width - band.region <= TABLE_BITS else SEARCH
    moved = 1 + around(band.region, min(r, band.region)) / 2
    return (values * moved * MOVE + values * tried / 2 * look + tried * BEGIN * 2**band.region + values * values / 2 * share[r] * COMPARE) / 1e6


def dealt(values: int, most: int, sample: np.ndarray) -> list[Band]:
    """The bands that cost least for so many fingerprints, of which ``sample`` (longs) are some."""
    rng = np.random.default_rng(1)
    sample = sample.astype(np.int64).view(np.uint64)
    a, b = rng.integers(0, max(1, len(sample)), (2, SAMPLE_PAIRS)) if len(sample) > 1 else np.zeros((2, 0), int)
    differ = sample[a[a != b]] ^ sample[b[a != b]] if len(a) else np.zeros(0, np.uint64)
    region = max(ceil(log2(max(1, values / STORED))), min(4, ceil(log2(max(1, values / SMALL)))))
    best, cost = [], inf
    for m in range(1, most + 2):
        edges = [round(i * BITS / m) for i in range(m + 1)]
        options = []
        for low, high in zip(edges, edges[1:]):
            width, bits = high - low, min(region, high - low, MOST_REGION_BITS)
            seen = np.bincount(np.bitwise_count((differ >> np.uint64(low)) & np.uint64((1 << width) - 1)), minlength=WIDEST_RADIUS + 1)
            share = [max(s, around(width, r) / 2**width) for r, s in enumerate(np.cumsum(seen)[: WIDEST_RADIUS + 1] / max(1, len(differ)))]
            options.append([(Band(low, width, r, bits), _costs(values, Band(low, width, r, bits), share)) for r in range(-1, min(WIDEST_RADIUS, most) + 1)])
        found: dict[int, tuple[float, list[Band]]] = {0: (0.0, [])}  # by the sum of radius + 1 so far
        for option in options:
            after: dict[int, tuple[float, list[Band]]] = {}
            for used, (so_far, bands) in found.items():
                for band, more in option:
                    now = used + band.radius + 1
                    if now <= most + 1 and so_far + more < after.get(now, (inf, []))[0]:
                        after[now] = (so_far + more, [*bands, band])
            found = after
        if most + 1 in found and found[most + 1][0] < cost:
            cost, best = found[most + 1]
    return [b for b in best if b.radius >= 0]


def keys_of(bands: list[Band]) -> float:
    """Rows that a fingerprint is sent as, on the average: a region is probed by one of two."""
    return sum(1 + (1 + around(b.region, min(b.radius, b.region))) / 2 for b in bands)


def _matched(bands: list[Band], most: int):
    """What a task finds among the stored and the probes of one cell."""
    def of(key: tuple, rows: pa.Table) -> pa.Table:
        at = key[0].as_py() >> 32
        band = bands[at]
        role, hashes = rows["role"].to_numpy(), rows["hash"].to_numpy().view(np.uint64)
        bits = band.width - band.region
        low = lambda h: ((h >> np.uint64(band.start)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        stored = hashes[role < 0]
        order = np.argsort(low(stored), kind="stable")
        stored = stored[order]
        values = low(stored)
        starts = np.searchsorted(values, np.arange((1 << bits) + 1)) if bits <= TABLE_BITS else None
        before = [(np.uint64(b.mask), b.radius) for b in bands[:at]]
        out = []

        def compare(probes: np.ndarray, begin: np.ndarray, counts: np.ndarray, equal: bool) -> None:
            ends = np.cumsum(counts)
            offset = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
            a, b = np.repeat(probes, counts), stored[np.repeat(begin, counts) + offset]
            x = a ^ b
            near = np.bitwise_count(x) <= most
            if equal:  # these two meet twice
                near &= a < b
            for mask, radius in before:  # a pair comes out of its first band only
                near &= np.bitwise_count(x & mask) > radius
            if near.any():
                out.append((a[near], b[near]))

        for d in np.unique(role[role >= 0]).tolist():
            probes = hashes[role == d]
            own = low(probes)
            for flip in flips(bits, band.radius - d.bit_count()):
                p, t = probes, own ^ flip
                if not d and flip:  # of two values the smaller one looks up the other
                    up = t > own
                    p, t = p[up], t[up]
                begin, end = (starts[t], starts[t + 1]) if starts is not None else (np.searchsorted(values, t), np.searchsorted(values, t, "right"))
                some = end > begin
                p, begin, counts = p[some], begin[some], (end - begin)[some]
                full = np.searchsorted(np.cumsum(counts), np.arange(CHUNK, counts.sum() + CHUNK, CHUNK)) + 1
                cuts = [0, *np.unique(np.minimum(full, len(counts))).tolist()] if len(counts) else []
                for start, cut in zip(cuts, cuts[1:]):
                    compare(p[start:cut], begin[start:cut], counts[start:cut], not d and not flip)
        a, b = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.uint64) for i in (0, 1))
        x, y = a.view(np.int64), b.view(np.int64)
        return pa.table({"hash_a": np.minimum(x, y), "hash_b": np.maximum(x, y), "distance": np.bitwise_count(a ^ b).astype(np.int32)})

    return of


def _blocks(counts: dict[tuple[int, int], int], bands: list[Band]) -> list[tuple[int, int, int]]:
    """(cell, blocks of stored, blocks of probes) of the cells that are cut."""
    out = []
    for i, b in enumerate(bands):
        near = flips(b.region, min(b.radius, b.region))
        for region in range(1 << b.region):
            probes = sum(counts.get((i, region ^ d), 0) for d in near if region ^ d <= region)
            s, p = ceil(counts.get((i, region), 0) / STORED), ceil(probes / PROBES)
            if s > 1 or p > 1:
                out.append((i << 32 | region, max(1, s), max(1, p)))
    return out


def probed_pairs(distinct: DataFrame, most: int, values: int) -> DataFrame:
    """(hash_a, hash_b, distance) within ``most`` of different values of ``hash`` (long, each once,
    never null; read three times), a before b, each pair once. ``values``: how many there are.

    Regions with more rows than a task should hold are cut into pairs of blocks by their counts,
    which are at most 1024 for each band."""
    spark = distinct.sparkSession
    sample = [r["hash"] for r in distinct.orderBy(F.xxhash64("hash")).limit(SAMPLE).select("hash").collect()]
    bands = dealt(values, most, np.array(sample, np.int64))
    value = lambda b: F.shiftrightunsigned("hash", b.start).bitwiseAND(F.lit((1 << b.width) - 1 if b.width < BITS else -1).cast("long"))
    region = lambda b: F.shiftrightunsigned(value(b), b.width - b.region) if b.region else F.lit(0).cast("long")

    def rows(i: int, b: Band):
        """The row that is stored, and those that probe: a region above, or one's own."""
        base = F.lit(i << 32).cast("long")
        probes = F.transform(F.array(*[F.lit(d).cast("long") for d in flips(b.region, min(b.radius, b.region))]), lambda d: F.struct(base.bitwiseOR(region(b).bitwiseXOR(d)).alias("cell"), d.cast("int").alias("role")))
        upward = F.filter(probes, lambda p: p["cell"] >= base.bitwiseOR(region(b)))
        return F.concat(F.array(F.struct(base.bitwiseOR(region(b)).alias("cell"), F.lit(-1).alias("role"))), upward)

    sent = distinct.select("hash", F.explode(F.concat(*[rows(i, b) for i, b in enumerate(bands)])).alias("_r")).select("hash", "_r.cell", "_r.role")
    by_region = distinct.select(F.explode(F.array(*[F.lit(i << 32).cast("long").bitwiseOR(region(b)) for i, b in enumerate(bands)])).alias("cell")).groupBy("cell").count()
    counts = {divmod(r["cell"], 1 << 32): r["count"] for r in by_region.collect()}  # of 1024 regions a band at most
    sent = sent.withColumn("part", F.lit(0).cast("long"))
    if cut := _blocks(counts, bands):
        blocks = F.broadcast(spark.createDataFrame(cut, "cell long, s long, p long"))  # no more rows than counts
        sent = sent.drop("part").join(blocks, "cell", "left").withColumns({"s": F.coalesce("s", F.lit(1)), "p": F.coalesce("p", F.lit(1))})
        mine = F.pmod(F.xxhash64("hash", F.lit(1)), F.when(F.col("role") < 0, F.col("s")).otherwise(F.col("p")))
        others = F.sequence(F.lit(0).cast("long"), F.when(F.col("role") < 0, F.col("p")).otherwise(F.col("s")) - 1)
        sent = sent.withColumn("_mine", mine).withColumn("_other", F.explode(others))
        sent = sent.withColumn("part", F.when(F.col("role") < 0, F.col("_mine") * F.col("p") + F.col("_other")).otherwise(F.col("_other") * F.col("p") + F.col("_mine")))
    return sent.select("cell", "part", "role", "hash").groupBy("cell", "part").applyInArrow(_matched(bands, most), "hash_a long, hash_b long, distance int")
