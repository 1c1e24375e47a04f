"""A similarity index of fingerprints: written once, asked by tables of queries.

A few fingerprints are centres. Each row is kept with the centre that is nearest and its distance to
it; rows of one centre and about one distance, a ring, are a leaf, a folder of Parquet files. By the
triangle inequality a row within the radius of a query lies in a ring whose distances differ from
the query's own distance to that centre by no more than the radius, and it cannot be with a centre
that is farther from the query than the nearest one is by more than twice the radius. What is left
is read and compared; other folders are not opened."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.hashing import hamming
from kindred.plans.tables import materialize

#: Distances of a ring, from a multiple of it on; rows that centres are chosen from.
RING, SAMPLE = 2, 4096


def _distances(value: Column, centres: list[int]) -> Column:
    """Distances to all centres, in their order."""
    return F.transform(F.array(*[F.lit(c).cast("long") for c in centres]), lambda c: hamming(value, c))


def chosen_centres(hashes: DataFrame, many: int) -> list[int]:
    """Centres that lie far apart, out of a bounded sample: each next one is the farthest from those
    chosen before. They decide how much is read, not what is found."""
    sample = [r["hash"] & (2**64 - 1) for r in hashes.filter("hash IS NOT NULL").select("hash").distinct().orderBy(F.xxhash64("hash"), "hash").limit(SAMPLE).collect()]
    if not sample:
        return [0]
    chosen, apart = [sample[0]], [(h ^ sample[0]).bit_count() for h in sample]
    while len(chosen) < many and max(apart):
        far = sample[apart.index(max(apart))]
        chosen.append(far)
        apart = [min(a, (h ^ far).bit_count()) for a, h in zip(apart, sample)]
    return [c - (1 << 64) if c >= 1 << 63 else c for c in chosen]


@dataclass
class SimilarityIndex:
    """An index at ``path``; ``columns`` are those of its rows, ``hash`` (long) among them."""

    spark: SparkSession
    path: str
    centres: list[int]
    columns: str

    @classmethod
    def build(cls, rows: DataFrame, path: str, centres: int = 32) -> SimilarityIndex:
        """Write an index of ``rows``, which have a column ``hash``; rows without a hash are left
        out. An index that is there already is not overwritten."""
        spark = rows.sparkSession
        clash = {"_centre", "_ring", "_apart"} & {c.lower() for c in rows.columns}
        if clash:
            raise ValueError(f"columns of the index itself: {', '.join(sorted(clash))}")
        out = cls(spark, path.rstrip("/"), chosen_centres(rows, centres), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))
        spark.createDataFrame([(i, c, out.columns) for i, c in enumerate(out.centres)], "at int, centre long, columns string").coalesce(1).write.parquet(f"{out.path}/centres")
        out._written(rows, "error")
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SimilarityIndex:
        """The index that ``build`` wrote at ``path``."""
        path = path.rstrip("/")
        rows = sorted(spark.read.parquet(f"{path}/centres").collect())
        return cls(spark, path, [r["centre"] for r in rows], rows[0]["columns"])

    def add(self, rows: DataFrame) -> None:
        """More rows of the same columns, as files of their own in the leaves they belong to."""
        self._written(rows, "append")

    def _written(self, rows: DataFrame, mode: str) -> None:
        near = _distances(F.col("hash"), self.centres)
        least = F.array_min(F.transform(near, lambda d, i: F.struct(d.alias("d"), i.cast("int").alias("i"))))
        placed = rows.filter("hash IS NOT NULL").withColumn("_near", least).select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_near.d").alias("_apart"), F.col("_near.i").alias("_centre"), (F.floor(F.col("_near.d") / RING) * RING).cast("int").alias("_ring"))
        # Leaves are files of their own without a leaf going through one task.
        placed.sortWithinPartitions("_centre", "_ring").write.partitionBy("_centre", "_ring").mode(mode).parquet(f"{self.path}/leaves", compression="zstd")

    def rows(self) -> DataFrame:
        """All rows with _apart (from the centre), _centre and _ring."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/leaves")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        columns = f"{self.columns}, _apart int, _centre int, _ring int"
        return self.spark.read.schema(columns).parquet(f"{self.path}/leaves") if fs.exists(p) else self.spark.createDataFrame([], columns)

    def leaves_of(self, queries: DataFrame, radius: int) -> DataFrame:
        """``queries`` (with ``_query``, a hash), a row for each leaf that may hold an answer:
        _from (the distance to the centre), _centre, _ring."""
        away = queries.filter("_query IS NOT NULL").withColumn("_away", _distances(F.col("_query"), self.centres))
        away = away.withColumn("_least", F.array_min("_away")).select("*", F.posexplode("_away").alias("_centre", "_from")).filter(F.col("_from") <= F.col("_least") + 2 * radius)
        low = F.floor(F.greatest(F.col("_from") - radius, F.lit(0)) / RING) * RING
        high = F.floor(F.least(F.col("_from") + radius, F.lit(64)) / RING) * RING
        return away.withColumn("_ring", F.explode(F.sequence(low.cast("int"), high.cast("int"), F.lit(RING)))).drop("_away", "_least")

    def search(self, queries: DataFrame, radius: int, hash_column: str = "hash") -> DataFrame:
        """Rows of the index within ``radius`` of each query: the queries' columns with ``query_``
        before their names, the index's columns, distance. A query without a hash finds nothing.

        Only the leaves that some query asks for are read (there are few kinds of leaves, however
        many rows); inside a leaf each row is told by its own distance from the centre before it is
        compared."""
        names = {c: f"query_{c}" for c in queries.columns}
        asked = queries.withColumnsRenamed(names).withColumn("_query", F.col(f"`query_{hash_column}`"))
        asked = materialize(self.leaves_of(asked, radius), "asked")
        wanted = [(r["_centre"], r["_ring"]) for r in asked.select("_centre", "_ring").distinct().collect()]  # at most centres x 33
        by_centre: dict[int, list[int]] = {}
        for centre, ring in wanted:
            by_centre.setdefault(centre, []).append(ring)
        reached = F.lit(False)
        for centre, rings in sorted(by_centre.items()):
            reached = reached | ((F.col("_centre") == centre) & F.col("_ring").isin(sorted(rings)))
        rows = self.rows()
        held = [F.col(f"`{c}`") for c in rows.columns if c not in ("_apart", "_centre", "_ring")]
        met = rows.filter(reached).join(asked, ["_centre", "_ring"])
        met = met.filter(F.abs(F.col("_apart") - F.col("_from")) <= radius).withColumn("distance", hamming(F.col("hash"), F.col("_query")))
        return met.filter(F.col("distance") <= radius).select(*[F.col(f"`{n}`") for n in names.values()], *held, "distance")
