"""N-gram Jaccard self-join with Bayesian pruning of MinHash candidates.

Texts are sets of five-word runs. 160 MinHash values of 16 bits make 32 bands of five; texts that
agree in a band are candidates (at a similarity of 0.8 all but 3 in a million pairs agree in one).

1. Equal word sequences become one class, whose copies are only counted from here on.
2. In each band's bucket, pairs are compared 32 MinHash values at a time. With a uniform prior the
   matches so far give the posterior probability that the similarity reaches the threshold; a pair
   below ``TOLERANCE`` is dropped. What survives is emitted as a spanning forest, never as pairs.
   A bucket of more than a block is first compared inside its blocks, which are others in every
   band. Only pairs that this has not yet brought together are compared between blocks: of a large
   group of near copies none are left, so its rows move once a band and not once a block.
3. The forests' components hold every surviving pair. In each component the texts' run sets are
   intersected exactly, which gives every class its links, and again a forest of them.
4. Components of the exact links are the groups of near copies.

Buckets and components of any size are dealt out in blocks, of texts and of bytes: a task sees two
blocks at most and compares all pairs between them, so the pairs of a hot group spread over the
cluster and none is lost. Rows that leave a task grow with the rows it read, not with their pairs.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import bounded, discard, materialize, ship
from kindred.operators.graph import components, least_labels

RUN_WORDS, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS, TOLERANCE = 32, 5, 1e-6
STEP = 32
#: Members of a bucket, and texts and their bytes of a component, that one block holds.
BUCKET_BLOCK, TEXT_BLOCK, TEXT_BYTES = 2048, 768, 16 << 20
#: Pairs compared at a time, and distinct runs at a time.
PAIRS, COLUMNS = 1 << 17, 4096

_odd = np.random.default_rng(20_240).integers(0, 1 << 32, (2, BANDS * BAND_ROWS), np.uint32)
_A, _B = (_odd[0] | 1)[:, None], _odd[1][:, None]
_C, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M
    return h ^ (h >> np.uint64(29))


def runs(words: list[bytes], run: int = RUN_WORDS) -> np.ndarray:
    """64-bit hashes of the runs of ``run`` words, in order; fewer words make one run."""
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(run, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = h * _C + w[j : len(w) - k + 1 + j]
    return mixed(h)


def signature(h: np.ndarray) -> np.ndarray:
    """The 16 low bits of each MinHash value."""
    x, least = (h >> np.uint64(32)).astype(np.uint32), np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        v = _A * x[None, at : at + 2048]
        v += _B
        np.minimum(least, v.min(axis=1), out=least)
    return (least ^ (least >> np.uint32(16))).astype("<u2")


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(texts, BANDS) hashes of the bands, the band's number among them."""
    s = sig.reshape(len(sig), BANDS, BAND_ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), s.shape[:2])
    for j in range(BAND_ROWS):
        h = mixed(h * _C + s[:, :, j] + np.uint64(1))
    return h.view(np.int64)


@lru_cache
def least_matches(threshold: float, tolerance: float, step: int = STEP, most: int = BANDS * BAND_ROWS) -> tuple[int, ...]:
    """By number of steps done: the fewest matches at which P(similarity >= threshold) is at least
    ``tolerance``, under a uniform prior: the tail of Beta(m + 1, n - m + 1)."""
    def tail(m: int, n: int) -> float:
        return sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))

    return tuple(next(m for m in range(n + 1) if tail(m, n) >= tolerance) for n in range(step, most + 1, step))


def survivors(sig: np.ndarray, a: np.ndarray, b: np.ndarray, band: np.ndarray, once: np.ndarray, threshold: float) -> np.ndarray:
    """Indices of the pairs that pruning leaves; where ``once``, of those that first agree in
    ``band``."""
    left, matches = np.arange(len(a)), np.zeros(len(a), int)
    for k, need in enumerate(least_matches(threshold, TOLERANCE)):
        cols = slice(k * STEP, (k + 1) * STEP)
        matches = matches + np.count_nonzero(sig[a[left], cols] == sig[b[left], cols], axis=1)
        on = matches >= need
        left, matches = left[on], matches[on]
    agree = (sig[a[left]] == sig[b[left]]).reshape(-1, BANDS, BAND_ROWS).all(axis=2)
    return left[(agree.argmax(axis=1) == band[left]) | ~once[left]]


def cell_runs(batches, cell: list[str]):
    """Tables of whole cells, from batches that are sorted by cell."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not len(t):
            continue
        t = t if held is None else pa.concat_tables([held, t])
        same = np.ones(len(t), bool)
        for c in cell:
            v = t[c].to_numpy()
            same &= v == v[-1]
        cut = len(t) - int(same[::-1].argmin()) if not same.all() else 0
        held = t.slice(cut)
        if cut:
            yield t.slice(0, cut)
    if held is not None:
        yield held


def pairs_of(cell: np.ndarray, side: np.ndarray, across: np.ndarray):
    """(a, b) index arrays of all pairs in each run of equal ``cell``; where it is ``across``, of
    the pairs between its two sides. At most about ``PAIRS`` at a time."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    small = sizes <= 64
    two = across[starts]
    for size in np.unique(sizes[small & ~two]):
        i, j = np.triu_indices(size, 1)
        at = starts[(sizes == size) & ~two]
        for k in range(0, len(at), step := max(1, PAIRS // max(1, len(i)))):
            yield (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
    for start, size in zip(starts[~small | two], sizes[~small | two]):
        rows = np.arange(start, start + size)
        left, right = (rows[side[rows] == 0], rows[side[rows] == 1]) if across[start] else (rows, rows)
        for k in range(0, len(left), step := max(1, PAIRS // max(1, len(right)))):
            a, b = np.repeat(left[k : k + step], len(right)), np.tile(right, len(left[k : k + step]))
            yield (a, b) if left is not right else (a[a < b], b[a < b])


def linked_in(batches, threshold: float):
    """Spanning forests (a, b) of the surviving pairs of each bucket or pair of its blocks."""
    for t in cell_runs(batches, ["bucket", "low", "high"]):
        uid, low, high, block, band, once = (t[c].to_numpy() for c in ("uid", "low", "high", "block", "band", "once"))
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), "<u2").reshape(len(t), -1)
        cell = np.cumsum(np.r_[0, (t["bucket"].to_numpy()[1:] != t["bucket"].to_numpy()[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
        nodes, node = np.unique(uid, return_inverse=True)
        a, b = [], []
        for x, y in pairs_of(cell, (block != low).astype(int), low != high):
            if len(x):
                on = survivors(sig, x, y, band[x], once[x], threshold)
                a.append(node[x[on]])
                b.append(node[y[on]])
        label = least_labels(len(nodes), np.concatenate([*a, np.array([], int)]), np.concatenate([*b, np.array([], int)]))
        tree = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[tree]), pa.array(nodes[label[tree]])], names=["a", "b"])


def shared_runs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of the left with the right sets."""
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    new = np.cumsum(n > 1) - 1
    keep = n[column] > 1
    of, column = of[keep], new[column[keep]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    out = np.zeros((len(left), len(right)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [at, at + COLUMNS])
        m = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - at)), np.float32)
        m[of[i:j], column[i:j] - at] = 1
        out += m[left] @ m[right].T
    return out


def verified(batches, threshold: float, run: int):
    """Exact links inside each component, or pair of its blocks: for each class the linked texts
    and documents, and a node it hangs together with."""
    names = ("uid", "texts", "docs", "to")
    for t in cell_runs(batches, ["label", "low", "high"]):
        ids = list(zip(*(t[c].to_pylist() for c in ("label", "low", "high"))))
        starts = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]] + [len(ids)]
        out = [[], [], [], []]
        for s, e in zip(starts, starts[1:]):
            part = t.slice(s, e - s)
            sets = [np.unique(runs(text.as_py().encode().split(), run)) for text in part["text"]]
            uid, mult, block, low, high = (part[c].to_numpy() for c in ("uid", "mult", "block", "low", "high"))
            own = len(uid) and low[0] == high[0]
            left = np.arange(len(uid)) if own else np.flatnonzero(block == low)
            right = left if own else np.flatnonzero(block != low)
            if not len(left) or not len(right):
                continue
            n = np.array([len(x) for x in sets], float)
            both = shared_runs(sets, left, right)
            link = both >= threshold * (n[left][:, None] + n[right][None, :] - both) - 1e-9
            if own:
                np.fill_diagonal(link, False)
            texts, docs = np.zeros(len(uid), np.int64), np.zeros(len(uid), np.int64)
            texts[left] += link.sum(axis=1)
            docs[left] += link @ mult[right]
            if not own:
                texts[right] += link.sum(axis=0)
                docs[right] += mult[left] @ link
            order = np.argsort(uid)
            rank = np.empty(len(uid), int)
            rank[order] = np.arange(len(uid))
            a, b = np.nonzero(link)
            label = least_labels(len(uid), rank[left[a]], rank[right[b]])
            for to, x in zip(out, (uid, texts, docs, uid[order][label[rank]])):
                to.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=list(names))


def _dealt(df: DataFrame, block: Column, others: Column, cell: list[str]) -> DataFrame:
    """Rows of a group dealt to the pairs (low, high) of their own block and each of ``others``,
    and sorted by cell."""
    df = df.withColumn("block", block).withColumn("_other", F.explode(others))
    df = df.withColumn("low", F.least("block", "_other")).withColumn("high", F.greatest("block", "_other")).drop("_other")
    return df.repartition(*cell).sortWithinPartitions(*cell)


def _spread(blocks: Column, node: str) -> tuple[Column, Column]:
    """A block of each row among ``blocks`` of them, and all blocks."""
    return F.pmod(F.xxhash64(node), blocks).cast("int"), F.sequence(F.lit(0), blocks - 1)


def _once_each(members: DataFrame) -> DataFrame:
    """Rows (uid, band, bucket, size) without the buckets whose members are just those of a bucket of
    an earlier band, where all their pairs are compared. Near copies share most of their bands, so
    this spares most signatures the way. Sets are told apart by two sums of 64-bit hashes, size and
    least member."""
    sums = [F.bit_xor(F.xxhash64("uid", F.lit(seed))).alias(f"_x{seed}") for seed in (1, 2)]
    sets = members.groupBy("bucket").agg(F.first("size").alias("_size"), F.first("band").alias("band"), F.min("uid").alias("_least"), *sums)
    kept = sets.groupBy("_size", "_least", "_x1", "_x2").agg(F.min(F.struct("band", "bucket")).alias("_kept")).select("_kept.bucket")
    out = materialize(members.join(kept, "bucket", "left_semi"), "members")
    discard(members)
    return out


def candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """From (uid, sig) the component (node, label) of every node that has a surviving pair."""
    def banded(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(batch.num_rows, -1)
            band = np.tile(np.arange(BANDS, dtype=np.int32), len(sig))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(band), pa.array(band_keys(sig).ravel())], names=["uid", "band", "bucket"])

    def signed(of: DataFrame) -> DataFrame:
        return of.join(classes.select("uid", "sig"), "uid")

    def linked(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(lambda b: linked_in(b, threshold), "a long, b long")

    bands = classes.select("uid", "sig").mapInArrow(banded, "uid long, band int, bucket long")
    shared = bands.groupBy(F.col("bucket").alias("_bucket")).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = _once_each(materialize(bands.join(shared, bands["bucket"] == shared["_bucket"]).drop("_bucket"), "members"))
    cell = ["bucket", "low", "high"]
    blocks = F.ceil(F.col("size") / BUCKET_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("uid", "band"), blocks).cast("int")
    rows = signed(members).withColumn("once", F.col("size") <= BUCKET_BLOCK)  # in a block of a hot bucket every band's pairs help to join the blocks
    inside = materialize(linked(_dealt(rows, own, F.array("block"), cell).drop("size")), "candidates")
    groups = components(inside)
    hot = members.filter(F.col("size") > BUCKET_BLOCK)
    if hot.isEmpty():
        discard(members, inside)
        return groups
    # In each hot bucket the members of the commonest component need no more comparisons among each
    # other; the others are compared with them and with each other.
    groups = materialize(groups, "groups")
    marked = signed(hot.drop("size")).join(groups, F.col("uid") == F.col("node"), "left").withColumn("label", F.coalesce("label", "uid")).drop("node")
    counts = marked.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(F.col("bucket").alias("_bucket")).agg(F.max_by("label", F.struct("n", "label")).alias("_main"), F.max("n").alias("_most"), F.sum("n").alias("_all")).filter("_all > _most")
    rows = marked.join(totals, marked["bucket"] == totals["_bucket"]).withColumn("_is_main", F.col("label") == F.col("_main"))
    main, rest = (F.ceil(n / BUCKET_BLOCK).cast("int") for n in (F.col("_most"), F.col("_all") - F.col("_most")))
    of_main, of_rest = (F.sequence(F.lit(0), n - 1) for n in (main, rest))
    block = F.when(F.col("_is_main"), rest + F.pmod(F.xxhash64("uid"), main)).otherwise(F.pmod(F.xxhash64("uid"), rest)).cast("int")
    others = F.when(F.col("_is_main"), of_rest).otherwise(F.concat(of_rest, F.transform(of_main, lambda i: i + rest)))
    dealt = _dealt(rows.withColumn("once", F.lit(False)).drop("label", "_bucket"), block, others, cell)
    across = linked(dealt.drop("_main", "_most", "_all", "_is_main"))
    edges = materialize(groups.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(across), "candidates")
    joined = components(edges)
    discard(members, inside, groups, edges)
    return joined


def near_links(df: DataFrame, text: str = "text", key: str = "doc_id", uid: str | None = None, threshold: float = THRESHOLD, run: int = RUN_WORDS) -> DataFrame:
    """One row per row of ``df``: doc_id, class_id, links, text_links, uid, stays.

    Words are what stands between space, tab and line ends. ``links`` counts the other documents
    whose run sets reach the threshold (equal word sequences among them), ``text_links`` the
    different word sequences they have. ``class_id`` is the least doc_id of all that hang together
    by links, its own where there are none; ``stays`` marks one row of each such group. A null or
    wordless text has no runs: it links to nothing and stays. Rows repeated whole are copies of
    each other. Columns of ``df`` other than the named ones are not read. ``uid`` names a column
    of distinct longs, the same whenever ``df`` is read again; without one the rows are numbered
    here, in a copy of key and text. Texts of any length are read whole; no rows give no rows.
    """
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), (F.col(f"`{uid}`") if uid else F.monotonically_increasing_id()).alias("uid"))
    if not uid:
        docs = materialize(docs, "numbered")  # texts are found again by these numbers

    def sketch(batches):
        for batch in batches:
            keys, sigs, sizes = [], [], []
            for x in batch.column(1):
                raw = (x.as_py() or "").encode()
                words = raw.split()
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                sigs.append(signature(runs(words, run)).tobytes() if words else None)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())], names=["doc_id", "uid", "key", "sig", "bytes"])

    rows = materialize(docs.mapInArrow(sketch, "doc_id long, uid long, key binary, sig binary, bytes long"), "sketches")
    classes = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("mult"))
    classes = materialize(classes.join(rows.select("uid", "sig", "bytes"), "uid"), "classes")

    groups = materialize(candidates(classes, threshold), "candidate_groups")
    wanted = groups.join(classes.select(F.col("uid").alias("node"), "mult", "bytes"), "node").withColumnRenamed("node", "uid")
    sizes = wanted.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TEXT_BLOCK), F.ceil(F.sum("bytes") / TEXT_BYTES)).cast("int").alias("_n"))
    wanted = materialize(wanted.join(sizes, "label").drop("bytes"), "wanted")
    found = docs.select("uid", "text").join(bounded(wanted), "uid")
    dealt = _dealt(found, *_spread(F.col("_n"), "uid"), ["label", "low", "high"]).drop("_n")
    exact = materialize(dealt.mapInArrow(lambda b: verified(b, threshold, run), "uid long, texts long, docs long, to long"), "links")
    discard(groups, wanted, *([] if uid else [docs]))

    group = components(exact.filter("uid <> to").select(F.col("uid").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "uid")
    counts = exact.groupBy("uid").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    info = classes.select("uid", "key", "doc_id", "mult").join(counts, "uid", "left").join(group, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    info = materialize(info, "classes_linked")
    discard(classes, exact)
    heads = info.groupBy("label").agg(F.min("doc_id").alias("class_id")).filter("class_id IS NOT NULL")
    linked = info.filter("texts > 0").select("uid", "label")
    heads = linked.join(heads, "label").select("uid", "class_id")
    info = info.withColumnRenamed("doc_id", "_rep").join(heads, "uid", "left").select(
        F.col("key").alias("_key"), F.col("uid").alias("_head"), "label", F.coalesce("class_id", "_rep").alias("_class"),
        (F.col("mult") - 1 + F.coalesce("docs", F.lit(0))).alias("_links"), F.coalesce("texts", F.lit(0)).alias("_texts"),
    )
    out = rows.drop("sig", "bytes").join(info, F.col("key") == F.col("_key"), "left")
    return out.select(
        "doc_id", F.when(F.col("_key").isNull(), F.col("doc_id")).otherwise(F.col("_class")).alias("class_id"),
        F.coalesce("_links", F.lit(0)).alias("links"), F.coalesce("_texts", F.lit(0)).alias("text_links"),
        "uid", (F.col("_key").isNull() | (F.col("uid") == F.col("label"))).alias("stays"),
    )


def distinct_documents(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` without all but one of each group of near copies; columns unchanged,
    whatever their names. Rows as in ``near_links``: null and wordless texts stay, of repeated rows
    one does; an empty table stays empty."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    held = materialize(df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.monotonically_increasing_id().alias("_uid")), "documents")
    gone = materialize(near_links(held, names[text], names[key], "_uid").filter("NOT stays").select("uid"), "copies")
    left = held.join(bounded(gone), held["_uid"] == gone["uid"], "left_anti")
    return left.select(*[F.col(n).alias(c) for c, n in names.items()])


def op4_near_join(spark, sf_dir: str) -> DataFrame:
    """For each document its group of near copies and how many documents it links to."""
    return near_links(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "links", "text_links")


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, array_to_string(w, ' ') AS t, w FROM w WHERE len(w) > 0),
c AS (SELECT min(doc_id) AS rep, count(*) AS mult, t, any_value(w) AS w FROM k GROUP BY t),
s AS (SELECT DISTINCT rep, array_to_string(w[i : i + 4], ' ') AS run FROM (SELECT rep, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM c)),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS inter FROM s a JOIN s b ON a.run = b.run AND a.rep <> b.rep GROUP BY a.rep, b.rep),
l AS (SELECT a, b FROM p JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE inter >= 0.8 * (x.n + y.n - inter) - 1e-9),
g(rep, head) AS (SELECT rep, rep FROM c UNION SELECT l.b, g.head FROM g JOIN l ON l.a = g.rep),
h AS (SELECT rep, min(head) AS head FROM g GROUP BY rep),
d AS (SELECT l.a AS rep, count(*) AS texts, sum(mult) AS docs FROM l JOIN c ON c.rep = l.b GROUP BY l.a)
SELECT k.doc_id, h.head AS class_id, (c.mult - 1 + coalesce(d.docs, 0))::BIGINT AS links, coalesce(d.texts, 0)::BIGINT AS text_links
FROM k JOIN c ON c.t = k.t JOIN h ON h.rep = c.rep LEFT JOIN d ON d.rep = c.rep
UNION ALL
SELECT doc_id, doc_id, 0::BIGINT, 0::BIGINT FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM k)
"""
