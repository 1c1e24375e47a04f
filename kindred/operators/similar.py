"""Near-duplicates: pairs within a Hamming distance, greedy clusters, what exact groups cover.

Everything works on distinct fingerprints. Files of one fingerprint are a class: they are counted,
never paired, and join their class's group at the end."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.greedy import greedy
from kindred.operators.probing import CHUNK, SAMPLE, probed_pairs
from kindred.operators.ranking import MOST_PARTS, ranked, tallied
from kindred.plans.tables import bounded, discard, materialize

BITS = 64
#: Distances up to which fingerprints are joined on equal choices of bands; beyond, bands are probed.
CHOSEN = 3
#: Rows of keys that a task gets, about; rows of one key from which on it is cut into blocks.
KEY_ROWS, HOT = 1 << 18, 1 << 14


def bands_for(values: int, most: int) -> int:
    """The number of bands of bits that costs least for so many distinct fingerprints: two within
    ``most`` agree in all but ``most`` of m bands, whichever these are, so a fingerprint has a key
    for each choice of m - most bands. More bands mean more keys, of more bits each."""
    def cost(m: int) -> float:
        return comb(m, most) * (1 + values / 2 ** (BITS * (m - most) / m))

    return min(range(most + 1, most + 7), key=cost)


def _hot_keys(distinct: DataFrame, chosen: list[tuple[int, ...]], edges: list[int], values: int) -> list[tuple[int, int]]:
    """(key, blocks) of the keys that more than ``HOT`` fingerprints seem to have, by a sample. Which
    ones are told, and in how many blocks, decides the work of a task, never the pairs."""
    if values <= HOT:
        return []
    sample = np.array([r["hash"] for r in distinct.orderBy(F.xxhash64("hash")).limit(SAMPLE).select("hash").collect()], np.int64).view(np.uint64)
    out = []
    for index, c in enumerate(chosen):
        packed = np.zeros(len(sample), np.uint64)
        for i in c:
            width = edges[i + 1] - edges[i]
            packed = (packed << np.uint64(width) if i != c[0] else packed) | (sample >> np.uint64(edges[i])) & np.uint64((1 << width) - 1)
        keys, counts = np.unique((packed << np.uint64((len(chosen) - 1).bit_length()) | np.uint64(index)).view(np.int64), return_counts=True)
        blocks = np.ceil(counts * (values / max(1, len(sample))) / HOT).astype(int)
        out += zip(keys[(blocks > 1) & (counts > 1)].tolist(), blocks[(blocks > 1) & (counts > 1)].tolist())
    return out


def _met(most: int, chosen: list[tuple[int, ...]], edges: list[int]):
    """What a task finds among rows (key, hash): pairs of one key, once the first that they share. Of
    a key in blocks, rows (part, block) too: a part holds two blocks, or one (``alone``)."""
    sets = np.array([sum(1 << i for i in c) for c in chosen])
    upto = np.array([(1 << (max(c) + 1)) - 1 for c in chosen])
    masks = [np.uint64((1 << high) - (1 << low)) for low, high in zip(edges, edges[1:])]
    index = np.int64((1 << (len(chosen) - 1).bit_length()) - 1)

    def of(batches):
        tables = list(batches)
        if not tables:
            return
        rows = pa.Table.from_batches(tables)
        told = {c: rows[c].to_numpy() for c in rows.column_names}
        order = np.lexsort([told[c] for c in ("hash", "part", "key") if c in told])
        told = {c: v[order] for c, v in told.items()}
        key, hashes = told["key"], told["hash"].view(np.uint64)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        if "part" in told:
            new[1:] |= told["part"][1:] != told["part"][:-1]
        starts = np.flatnonzero(new)
        ends = np.r_[starts[1:], len(key)]
        counts = np.repeat(ends, ends - starts) - np.arange(len(key)) - 1  # the rows after a row, of its key
        sums = np.cumsum(counts)
        total = int(sums[-1]) if len(sums) else 0
        cuts = [0, *np.unique(np.minimum(np.searchsorted(sums, np.arange(CHUNK, total + CHUNK, CHUNK)) + 1, len(key))).tolist()]
        for start, cut in zip(cuts, cuts[1:]):
            n = counts[start:cut]
            a = np.repeat(np.arange(start, cut), n)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            differ = hashes[a] ^ hashes[b]
            near = np.bitwise_count(differ) <= most
            if "part" in told:
                near &= told["alone"][a] | (told["block"][a] != told["block"][b])
            a, b, differ = a[near], b[near], differ[near]
            # The first key that two share has no band on which they agree below its last one but its own.
            agree = sum((differ & mask == 0).astype(np.int64) << i for i, mask in enumerate(masks))
            at = key[a] & index
            first = agree & upto[at] == sets[at]
            a, b, differ = a[first], b[first], differ[first]
            if len(a):
                yield pa.record_batch({"hash_a": hashes[a].view(np.int64), "hash_b": hashes[b].view(np.int64), "distance": np.bitwise_count(differ).astype(np.int32)})

    return of


def hamming_pairs(hashes: DataFrame, most: int, values: int | None = None) -> DataFrame:
    """(hash_a, hash_b, distance) of different values of ``hash`` (long) at distance ``most`` or
    less, a before b, each pair once. ``values``: how many there are, if that is known.

    Up to a distance of ``CHOSEN`` fingerprints meet by equality of a key; they come out of the
    first of all keys that they share, so the pairs need not be made distinct. The rows of the keys
    are dealt over as many tasks as their number asks for, so a task holds no more of them when the
    input grows. Beyond that distance they are looked up around each other. Equal values were made
    one before, so copies cost nothing here."""
    given = hashes.select("hash").filter("hash IS NOT NULL")
    if values is None or most > CHOSEN:
        given = materialize(given.distinct(), "fingerprints")
        values = given.count() if values is None else values
    if most > CHOSEN:
        return probed_pairs(given, most, values)
    m = bands_for(values, most)
    edges = [round(i * BITS / m) for i in range(m + 1)]
    chosen = list(combinations(range(m), m - most))

    def key(index: int, c: tuple[int, ...]) -> Column:
        """The bits of the bands, then the number of the choice: 64 bits at most."""
        of = F.lit(0).cast("long")
        for i in c:
            width = edges[i + 1] - edges[i]
            bits = F.shiftrightunsigned("hash", edges[i]).bitwiseAND(F.lit((1 << width) - 1 if width < BITS else -1).cast("long"))
            of = F.shiftleft(of, width).bitwiseOR(bits)
        return F.shiftleft(of, (len(chosen) - 1).bit_length()).bitwiseOR(F.lit(index).cast("long"))

    rows = values * len(chosen)
    # Values are dealt by the number of their keys. They are so short that else one task gets them all, and makes all keys.
    distinct = given.repartition(min(MOST_PARTS, 1 + rows // KEY_ROWS), "hash").distinct()
    cut = distinct.select("hash", F.explode(F.array(*[key(i, c) for i, c in enumerate(chosen)])).alias("key"))
    by = ["key"]
    if hot := _hot_keys(distinct, chosen, edges, values):
        blocks = F.broadcast(hashes.sparkSession.createDataFrame(hot, "key long, s long"))  # of a sample
        cut = cut.join(blocks, "key", "left").withColumn("s", F.coalesce("s", F.lit(1).cast("long"))).withColumn("block", F.pmod(F.xxhash64("hash"), F.col("s")))
        cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)))
        part = F.least("block", "_other") * F.col("s") + F.greatest("block", "_other")
        cut = cut.select("hash", "key", part.alias("part"), "block", (F.col("block") == F.col("_other")).alias("alone"))
        by, rows = ["key", "part"], rows + sum(HOT * s * s for _, s in hot)
    # A number that is given is kept: parts that are merged up to some bytes would be sorted, and held, in one task.
    dealt = cut.repartition(min(MOST_PARTS, 1 + rows // KEY_ROWS), *by)
    return dealt.mapInArrow(_met(most, chosen, edges), "hash_a long, hash_b long, distance int")


def file_links(files: DataFrame, most: int) -> DataFrame:
    """(path, class_path, copies, near_classes, near_files) of files with a ``hash``: the first path
    of the same hash, how many other files have it, and how many other hashes, and files of these,
    are within ``most``. Links are counted by class; no pairs of files are made."""
    held = files.select("path", "hash").filter("hash IS NOT NULL")
    classes = materialize(tallied(held, "hash", held.count(), "class_path"), "classes")
    pairs = materialize(hamming_pairs(classes, most, classes.count()), "hamming_pairs")  # read twice
    both = pairs.select("hash_a", "hash_b").unionByName(pairs.select(F.col("hash_b").alias("hash_a"), F.col("hash_a").alias("hash_b")))
    sizes = classes.select(F.col("hash").alias("hash_b"), F.col("n").alias("_m"))
    near = both.join(sizes, "hash_b").groupBy(F.col("hash_a").alias("hash")).agg(F.count(F.lit(1)).alias("near_classes"), F.sum("_m").alias("near_files"))
    told = classes.join(near, "hash", "left").withColumn("copies", F.col("n") - 1)
    zero = F.lit(0).cast("long")
    told = materialize(told.select("hash", "class_path", "copies", F.coalesce("near_classes", zero).alias("near_classes"), F.coalesce("near_files", zero).alias("near_files")), "links")
    return files.select("path", "hash").join(bounded(told), "hash").drop("hash")


def leader_groups(files: DataFrame, most: int, least: int = 2) -> DataFrame:
    """Greedy clusters of files (path, hash, ...): in path order, a file not yet taken gathers all
    files not yet taken within ``most`` of it; ``least`` or more make a group, fewer stay free.

    Adds leader (the group's first path) and drops files outside of groups. Files of one hash are
    taken together, and a hash that once finds too few will not find more, so the walk is over
    distinct hashes in the order of their first paths."""
    files = files.filter("hash IS NOT NULL")
    nodes = materialize(tallied(files, "hash", files.count(), "first"), "nodes")
    many = nodes.count()
    pairs = materialize(hamming_pairs(nodes, most, many).select(F.col("hash_a").alias("a"), F.col("hash_b").alias("b")), "hamming_pairs")
    ends = pairs.select(F.col("a").alias("hash")).union(pairs.select(F.col("b").alias("hash"))).distinct()
    linked = nodes.join(ends, "hash", "left_semi").withColumnRenamed("hash", "id")
    alone = nodes.join(ends, "hash", "left_anti").filter(F.col("n") >= least).select("hash", F.col("first").alias("leader"))
    walked = greedy(linked, pairs, least, many=many)
    firsts = nodes.select(F.col("hash").alias("_h"), F.col("first").alias("_leader"))
    led = walked.join(firsts, F.col("leader") == F.col("_h")).select(F.col("id").alias("_hash"), F.col("_leader").alias("leader"))
    led = materialize(led.unionByName(alone.withColumnRenamed("hash", "_hash")), "leaders")
    discard(nodes, pairs, walked)
    return files.join(bounded(led), files["hash"] == led["_hash"]).drop("_hash")


def not_covered(similar: DataFrame, exact: DataFrame) -> DataFrame:
    """Similar groups (leader, path) without those whose files all stand in one exact group
    (hash, path)."""
    tagged = similar.select("leader", "path").join(exact.select("path", F.col("hash").alias("_exact")), "path", "left")
    covered = tagged.groupBy("leader").agg(F.count(F.lit(1)).alias("n"), F.count("_exact").alias("m"), F.min("_exact").alias("low"), F.max("_exact").alias("high")).filter("n = m AND low = high")
    return similar.join(covered.select("leader"), "leader", "left_anti")


def all_groups(exact: DataFrame, similar: DataFrame) -> DataFrame:
    """Members of exact and similar groups: group_id, is_similar, path, size, rank_in_group. A
    similar group's id is its leader's hash, filled up to 64 digits with ``fill`` (0, if there is no
    such column), which keeps groups of images and of documents apart."""
    fill = F.col("fill") if "fill" in similar.columns else F.lit("0")
    heads = similar.filter("leader = path").select("leader", F.rpad(F.lower(F.lpad(F.hex("hash"), 16, "0")), 64, fill).alias("group_id"))
    near = similar.join(heads, "leader").select("group_id", F.lit(True).alias("is_similar"), "path", "size")
    near = ranked(materialize(near, "similar"), ["group_id"], ["path"], "rank_in_group")
    same = exact.select(F.col("hash").alias("group_id"), F.lit(False).alias("is_similar"), "path", "size", "rank_in_group")
    return same.unionByName(near)
