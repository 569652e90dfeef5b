"""Comparing tables by digests: sums of row hashes per bucket of a key, the same whatever the order of rows.

A row counts with four 31-bit pieces of two 64-bit hashes; a bucket is the number of its rows and the sums of the pieces,
so repeats count and swapped rows do not. Digests are one aggregate, combined before the shuffle. Two tables with equal
digests (a count and 124 bits) are taken to be equal. Columns of other types than a hash takes (maps, variants) must be
left out.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from roamlog.operators.maintain import TRACKED, diff_snapshots
from roamlog.sources.snapshots import Snapshots

SUMS = ["n", "s0", "s1", "s2", "s3"]
#: Buckets that share a node of the level above.
FAN = 64


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _pieces(cols: list[str]) -> list[Column]:
    """A one and the hash pieces of a row. NULL and its neighbours are told apart by flags."""
    def half(seed: int) -> Column:
        return F.xxhash64(F.lit(seed), *[x for c in cols for x in (F.col(c).isNull(), F.col(c))])

    low, mask = F.lit((1 << 31) - 1).cast("bigint"), []
    for seed in (1, 2):
        mask += [half(seed).bitwiseAND(low), F.shiftrightunsigned(half(seed), 33)]
    return [F.lit(1).cast("bigint"), *mask]


def digests(df: DataFrame, key: str | None = None, buckets: int = 1, cols: list[str] | None = None) -> DataFrame:
    """(bucket, sums) of the rows of ``df`` over ``cols``, one row per bucket that has any."""
    bucket = bucket_of(key, buckets) if key else F.lit(0)
    return df.groupBy(bucket.alias("bucket")).agg(*[F.sum(p).alias(s) for s, p in zip(SUMS, _pieces(cols or df.columns))])


def differs(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, ``changed``: whether the tables differ as multisets of rows. One pass over each, no shuffle of rows."""
    cols = a.columns
    both = a.withColumn("_side", F.lit(1)).unionByName(b.select(*cols).withColumn("_side", F.lit(-1)))
    sums = both.agg(*[F.sum(F.col("_side") * p).alias(s) for s, p in zip(SUMS, _pieces(cols))])
    return sums.select(reduce(lambda x, y: x | y, [F.coalesce(F.col(s), F.lit(0)) != 0 for s in SUMS]).alias("changed"))


def unequal_buckets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Buckets whose digests differ: first the nodes above, then the buckets under unequal nodes only."""
    def level(x: DataFrame) -> DataFrame:
        return x.groupBy(F.floor(F.col("bucket") / FAN).alias("node")).agg(*[F.sum(s).alias(s) for s in SUMS])

    def apart(x: DataFrame, y: DataFrame, at: str) -> DataFrame:
        same = reduce(lambda p, q: p & q, [F.col(f"x.{s}").eqNullSafe(F.col(f"y.{s}")) for s in SUMS])
        return x.alias("x").join(y.alias("y"), at, "full_outer").filter(~same).select(at)

    nodes = apart(level(a), level(b), "node")
    under = [x.withColumn("node", F.floor(F.col("bucket") / FAN)).join(nodes, "node", "left_semi") for x in (a, b)]
    return apart(*under, "bucket")


@dataclass(frozen=True)
class DigestedTable:
    """A table with one row per key, kept in versions whose rows lie in buckets of the key, with the buckets' digests."""

    path: str
    key: str = "venue_id"
    buckets: int = 1024

    @property
    def versions(self) -> Snapshots:
        return Snapshots(self.path)

    def write(self, df: DataFrame) -> int:
        """A new version. Its digests are taken from the rows as written."""
        spark = df.sparkSession

        def fill(folder: str) -> None:
            placed = df.withColumn("_bucket", bucket_of(self.key, self.buckets))
            placed.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{folder}/rows")
            written = spark.read.schema(df.schema).parquet(f"{folder}/rows")
            digests(written, self.key, self.buckets).coalesce(1).write.parquet(f"{folder}/digests")

        return self.versions.publish(spark, fill)

    def rows(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        return self.versions.read(spark, version, "rows")

    def changed_buckets(self, spark: SparkSession, old: int, new: int) -> list[int]:
        """At most ``buckets`` numbers, from the two digest tables alone."""
        one, two = (self.versions.read(spark, v, "digests") for v in (old, new))
        return sorted(r.bucket for r in unequal_buckets(one, two).collect())

    def diff(self, spark: SparkSession, old: int, new: int, tracked: list[str] | None = None) -> DataFrame:
        """As :func:`roamlog.operators.maintain.diff_snapshots`, reading only the folders of unequal buckets."""
        at = F.col("_bucket").isin(self.changed_buckets(spark, old, new))
        one, two = (self.rows(spark, v).filter(at).drop("_bucket") for v in (old, new))
        return diff_snapshots(one, two, self.key, tracked or TRACKED)


def diff_snapshots_by_digest(old: DataFrame, new: DataFrame, key: str = "venue_id", tracked: list[str] | None = None,
                             buckets: int = 1024) -> DataFrame:
    """The same for tables that are not kept in buckets: digests first, then only rows of unequal buckets are joined."""
    tracked = tracked or TRACKED
    cols = [key, *tracked]
    apart = unequal_buckets(digests(old, key, buckets, cols), digests(new, key, buckets, cols))
    wanted = F.col("_bucket").isin(sorted(r.bucket for r in apart.collect()))
    one, two = (d.withColumn("_bucket", bucket_of(key, buckets)).filter(wanted).drop("_bucket") for d in (old, new))
    return diff_snapshots(one, two, key, tracked)
