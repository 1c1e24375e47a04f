"""Best-fit packing of token sequences by the linear grouping scheme.

Lengths are small integers, so the whole packing problem is a histogram of at most ``capacity``
counts, however many documents there are. On that histogram:

1. large pieces (over a quarter of a sequence) are sorted by length and cut into groups of equal
   cardinality; every length in a group is rounded up to the group's largest;
2. the few-size problem is solved over configurations: column generation on its linear
   programme, with an exact knapsack for pricing, and its whole parts are used;
3. the actual pieces of each group take the places of the rounded ones, in all configurations;
4. the few large pieces of the programme's fractional parts, and then all small pieces, go by best
   fit, longest first, into what is left of the sequences.

The plan says which ranks of each length go to which sequences. Pieces look their rank up in it;
no text or token moves between tasks.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import deque
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import gapless_rank, materialize, ship

CAPACITY, GROUPS, LARGE = 4096, 48, 4
#: Pieces of one length that one task may rank together.
CELL_ROWS = 1 << 10
#: Distinct words and parts of words that a worker keeps the ids of, and their longest length.
WORDS_KEPT, PARTS_KEPT, WORD_CHARS = 250_000, 350_000, 40
CHARS_AT_ONCE = 300_000
END = (1).to_bytes(4, "little")

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Token ids as little-endian 32-bit strings.

    The tokenizer's pre-tokens never span a space, so a text's ids are those of its words between
    spaces, which repeat and are looked up. An unknown word of plain Latin letters is lower-cased
    and split as the tokenizer does it, and its parts are looked up; only unknown parts, and
    words with any other character, are encoded."""

    PLAIN = re.compile(r"[!-~\u00c0-\u012f\u0131-\u024f]+")
    PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def encode_parts(self, parts: list[str]) -> dict[str, bytes]:
        """Each part is one pre-token and ends with a token that ends a word, so many are encoded
        as one text and told apart by those."""
        if not parts:
            return {}
        ids = self.encode(" ".join(parts))
        raw, at = ids.tobytes(), [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
        if len(at) != len(parts) + 1 or at[-1] != len(raw):
            return {p: self.encode(p).tobytes() for p in parts}
        return {p: raw[i:j] for p, i, j in zip(parts, at, at[1:])}

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words that are not known yet."""
        part, known, room = self.PART.findall, self.parts, PARTS_KEPT - len(self.parts)
        plain = {w: part(w.lower()) for w in filter(self.PLAIN.fullmatch, words) if "<|" not in w}
        ids = self.encode_parts(list(set(chain.from_iterable(plain.values())).difference(known)))
        known.update(ids)
        find = known.__getitem__
        out = {w: find(parts[0]) if len(parts) == 1 else b"".join(map(find, parts)) for w, parts in plain.items()}
        for w in words.difference(plain):
            out[w] = self.encode(w).tobytes()
        if room <= 0:
            for p in ids:
                del known[p]
        return out

    def texts(self, texts: list[str]) -> list[bytes]:
        lists = [t.replace("\n", " ").split(" ") for t in texts]
        words = self.words
        new = self.learn(set().union(*lists).difference(words))
        words.update(new)
        out = [b"".join(map(words.__getitem__, x)) for x in lists]
        if len(words) > WORDS_KEPT:
            for w in new:
                del words[w]
        else:
            for w in new:
                if len(w) > WORD_CHARS:
                    del words[w]
        return out


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(enc: Encoder, texts: pa.Array):
    """The ids of each text and the end, some ``CHARS_AT_ONCE`` of text at a time."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size > CHARS_AT_ONCE:
            yield from (x + END for x in enc.texts(held))
            held, size = [], 0
    yield from (x + END for x in enc.texts(held))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut(df: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, row: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, on request, ids and ``row``,
    a column of longs that tells documents of one key apart.

    A document's ids end with id 1, so a null or empty text is one piece of length 1. Only
    documents over ``capacity`` are cut, into full pieces and a last shorter one; texts of any
    length are read whole. Repeated rows are documents of their own, a null key stays null, no rows
    give no pieces, and other columns of ``df`` are not read."""
    ship(df.sparkSession)
    path = path or tokenizer_path()
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + f", `{row}` long" * bool(row) + ", ids binary" * with_ids

    def pieces(batches):
        enc, step = encoder(path), 4 * capacity
        for batch in batches:
            rows = [[] for _ in range(5 + with_ids)]
            for i, ids in enumerate(encoded(enc, batch.column(1))):
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for to, x in zip(rows, (i, k, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        to.append(x)
            of = pa.array(rows[0], pa.int64())
            cols = [batch.column(0).take(of), *[pa.array(x, t) for x, t in zip(rows[1:5], (pa.int32(), pa.int64(), pa.int32(), pa.int64()))]]
            cols += [c.take(of) for c in batch.columns[2:]] + [pa.array(x, pa.binary()) for x in rows[5:]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", *[row] * bool(row), *["ids"] * with_ids])

    given = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), *[F.col(f"`{row}`").cast("long").alias("row")] * bool(row))
    return given.mapInArrow(pieces, schema)


def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int, most: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration of at most ``most`` items; its value and counts by size."""
    value, took = np.zeros(capacity + 1), []
    for _ in range(most):
        best, which = value.copy(), np.full(capacity + 1, -1)
        for i, (s, w) in enumerate(zip(sizes, worth)):
            cand = value[: capacity + 1 - s] + w
            better = cand > best[s:] + 1e-12
            best[s:][better] = cand[better]
            which[s:][better] = i
        took.append(which)
        value = best
    counts, room = np.zeros(len(sizes), int), capacity
    for which in reversed(took):
        if (i := which[room]) >= 0:
            counts[i] += 1
            room -= sizes[i]
    return float(value[capacity]), counts


def configurations(sizes: list[int], need: list[int], capacity: int, rounds: int = 2000) -> list[tuple[int, list[int]]]:
    """Whole numbers of configurations that cover most of ``need``: (times, count by size)."""
    s, n = np.array(sizes), np.array(need, float)
    k, most = len(s), capacity // min(sizes)
    base = np.diag((capacity // s).astype(float))
    x = n / (capacity // s)
    for _ in range(rounds):
        dual = np.linalg.solve(base.T, np.ones(k))
        value, column = knapsack(s, np.maximum(dual, 0), capacity, most)
        if value <= 1 + 1e-6:
            break
        d = np.linalg.solve(base, column.astype(float))
        ratio = np.full(k, np.inf)
        np.divide(x, d, out=ratio, where=d > 1e-9)
        out = int(np.argmin(ratio))
        step = max(0.0, ratio[out])
        x = x - step * d
        x[out] = step
        base[:, out] = column
    return [(int(t + 1e-6), base[:, j].astype(int).tolist()) for j, t in enumerate(np.maximum(x, 0)) if int(t + 1e-6)]


class Blocks:
    """Open sequences with equal contents, by the room that is left in them."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room, self.rooms, self.full = capacity, {}, [], []

    def add(self, times: int, items: list[tuple[int, int]], room: int) -> None:
        if not times:
            return
        if not room:
            self.full.append((times, items))
            return
        if room not in self.by_room:
            self.by_room[room] = []
            insort(self.rooms, room)
        self.by_room[room].append((times, items))

    def put(self, length: int, count: int) -> None:
        """Best fit for ``count`` pieces: always the tightest room, which a piece makes tighter still."""
        while count:
            i = bisect_left(self.rooms, length)
            if i == len(self.rooms):
                room, times, items = self.capacity, -(-count // (self.capacity // length)), []
            else:
                room = self.rooms[i]
                times, items = self.by_room[room].pop()
                if not self.by_room[room]:
                    del self.by_room[room], self.rooms[i]
            each = room // length
            used = min(times, count // each)
            self.add(used, [*items, (length, each)], room - each * length)
            count -= used * each
            times -= used
            if times and count:  # fewer than ``each`` are left: one sequence takes them
                self.add(1, [*items, (length, count)], room - count * length)
                times, count = times - 1, 0
            if items or i < len(self.rooms) or room != self.capacity:
                self.add(times, items, room)


def grouped(large: list[tuple[int, int]], groups: int) -> tuple[list[int], list[list[tuple[int, int]]]]:
    """Cut (length, count), longest first, into ``groups`` of equal cardinality: the length that
    each group is rounded up to, and its actual lengths. Groups that round alike are one."""
    each = -(-sum(c for _, c in large) // groups)
    runs: dict[int, list[tuple[int, int]]] = {}
    room = 0
    for length, count in large:
        while count:
            if not room:
                top, room = length, each
            take = min(count, room)
            runs.setdefault(top, []).append((length, take))
            room -= take
            count -= take
    return list(runs), list(runs.values())


def substituted(patterns: list[tuple[int, list[int]]], runs: list[list[tuple[int, int]]]):
    """(times, {length: count}) of the configurations with actual pieces in their places."""
    queues = [deque([n, c] for n, c in r) for r in runs]
    for times, counts in patterns:
        slots = [(g, c) for g, c in enumerate(counts) if c]
        while times and all(sum(n for _, n in queues[g]) >= c for g, c in slots):
            each = min(times, *(max(1, queues[g][0][1] // c) for g, c in slots))
            items: dict[int, int] = {}
            for g, left in slots:
                while left:
                    run = queues[g][0]
                    take = min(left, run[1] // each)
                    items[run[0]] = items.get(run[0], 0) + take
                    run[1] -= take * each
                    left -= take
                    if not run[1]:
                        queues[g].popleft()
            yield each, items
            times -= each


def configured(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, dict[int, int]]]:
    """The sequences that the linear grouping scheme fills with large pieces: (times, {length:
    count}). All large pieces are in them but for the fractional parts of the programme's solution,
    which are less than one sequence for each group."""
    large = [(n, c) for n, c in sorted(histogram.items(), reverse=True) if capacity // LARGE < n < capacity and c]
    if not large:
        return []
    sizes, runs = grouped(large, groups)
    patterns = configurations(sizes, [sum(c for _, c in r) for r in runs], capacity)
    return list(substituted(patterns, runs))


def pack(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, list[tuple[int, int]]]]:
    """Sequences for all pieces: (times, [(length, count), ...]). Full pieces fill sequences of
    their own, large ones stand where their configurations put them, and the rest goes by best fit
    into what these leave free."""
    blocks, rest = Blocks(capacity), dict(histogram)
    blocks.add(rest.pop(capacity, 0), [(capacity, 1)], 0)
    for times, items in configured(histogram, capacity, groups):
        blocks.add(times, list(items.items()), capacity - sum(n * c for n, c in items.items()))
        for n, c in items.items():
            rest[n] -= times * c
    for length, count in sorted(rest.items(), reverse=True):
        blocks.put(length, count)
    return [*blocks.full, *(b for room in blocks.rooms for b in blocks.by_room[room])]


def places(blocks: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, count in a sequence, first sequence, offset), by length and rank."""
    out, rank, sequence = [], {}, 0
    for times, items in blocks:
        offset = 0
        for length, each in items:
            first = rank.get(length, 0)
            out.append((length, first, each, sequence, offset))
            rank[length] = first + each * times
            offset += each * length
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def place(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Add sequence_id and offset to pieces (length int, ...): no sequence holds over ``capacity``.

    Pieces of one length are interchangeable, so a hot length is ranked in cells of bounded size.
    The plan that all tasks get has a row for each length and kind of sequence that meet, whatever
    the number of pieces. Columns named sequence_id or offset are replaced; no rows give no rows."""
    spark = pieces.sparkSession
    ship(spark)
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = materialize(pieces.select(*[F.col(f"`{c}`") for c in keep], F.monotonically_increasing_id().alias("_uid")), "pieces")
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # a row for each length at most
    plan = places(pack(histogram, capacity, groups))
    hot = {n: -(-c // CELL_ROWS) for n, c in histogram.items() if c > CELL_ROWS}  # ``capacity`` lengths at most
    cells = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv]), F.col("length")), F.lit(1)) if hot else F.lit(1)
    ranked = gapless_rank(rows.withColumn("_cell", F.pmod(F.xxhash64("_uid"), cells).cast("int")), ["length"], "_cell", [F.col("_uid")], "_rank").drop("_cell", "_uid")
    sent = spark.sparkContext.broadcast(plan)

    def look_up(batches):
        length, first, each, sequence, offset = sent.value.T
        starts = (length << 44) + first
        for batch in batches:
            t = pa.Table.from_batches([batch])
            n, rank = (t[c].to_numpy().astype(np.int64) for c in ("length", "_rank"))
            i = np.searchsorted(starts, (n << 44) + rank, "right") - 1
            j = rank - first[i]
            t = t.drop_columns(["_rank"]).append_column("sequence_id", pa.array(sequence[i] + j // each[i])).append_column("offset", pa.array(offset[i] + j % each[i] * n))
            yield from t.to_batches()

    schema = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(look_up, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """From placed pieces with ids: (sequence_id, ids), the ids of its pieces end to end. A
    sequence is of bounded length, so no group is large."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("_p")).select("sequence_id", F.expr("aggregate(_p, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, cut and packed into as few sequences of 4096 tokens as the scheme finds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = place(cut(docs))
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
