"""Substring search by an index of trigrams, for tables that are searched more often than written.

The texts of a row repeat (a venue with its city, country and category), so what is indexed are the distinct combinations
of the searched columns. A posting list holds the combinations with a trigram, in buckets of about ``BUCKET`` of them; the
lists of all trigrams of a query are intersected bucket by bucket, and the survivors are put to the exact test. The rows
themselves lie in the order of their combination, so those of a few combinations are read from few files. A query of under
three characters has no trigram and is tested on all combinations, which are still far fewer than the rows.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from roamlog.operators.filters import matches
from roamlog.sources.snapshots import Snapshots

GRAM, BUCKET = 3, 100_000
ROWS_PER_FILE = 1_000_000
#: Most combinations that are named in the filter of a scan; more are joined.
NAMED = 1000


def grams(text: Column) -> Column:
    """Distinct trigrams of a lower-cased text; none for a shorter one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    starts = F.sequence(F.lit(1), F.length(low) - GRAM + 1)
    return F.when(F.length(low) >= GRAM, F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(GRAM))))).otherwise(
        F.array().cast("array<string>"))


@dataclass(frozen=True)
class TextIndex:
    """A searchable copy of a table under ``path``, published as a whole."""

    path: str
    cols: tuple[str, ...]

    @property
    def versions(self) -> Snapshots:
        return Snapshots(self.path)

    def _id(self) -> Column:
        return F.xxhash64(*[x for c in self.cols for x in (F.col(c).isNull(), F.col(c))])

    def write(self, df: DataFrame) -> int:
        """Index ``df``. Rows of one combination may fill many files; a combination is one row everywhere else."""
        spark = df.sparkSession

        def fill(folder: str) -> None:
            rows = df.withColumn("_combo", self._id())
            parts = max(1, -(-df.count() // ROWS_PER_FILE))
            rows.repartitionByRange(parts, "_combo", F.xxhash64(*df.columns)).sortWithinPartitions("_combo").write.parquet(f"{folder}/rows")
            rows.select("_combo", *self.cols).distinct().write.parquet(f"{folder}/combos")
            combos = spark.read.parquet(f"{folder}/combos")
            buckets = max(1, -(-combos.count() // BUCKET))
            found = combos.select("_combo", F.explode(F.array_distinct(F.flatten(F.array(*[grams(F.col(c)) for c in self.cols])))).alias("gram"))
            lists = found.groupBy("gram", F.pmod(F.col("_combo"), F.lit(buckets)).cast("int").alias("bucket")).agg(
                F.sort_array(F.collect_list("_combo")).alias("ids"))
            lists.repartitionByRange("gram", "bucket").sortWithinPartitions("gram", "bucket").write.parquet(f"{folder}/postings")

        return self.versions.publish(spark, fill)

    def candidates(self, spark: SparkSession, q: str) -> DataFrame:
        """(_combo, cols) of the combinations that hold every trigram of ``q``."""
        combos, low = self.versions.read(spark, table="combos"), q.lower()
        wanted = sorted({low[k : k + GRAM] for k in range(len(low) - GRAM + 1)})
        if not wanted:
            return combos
        lists = self.versions.read(spark, table="postings").filter(F.col("gram").isin(wanted))
        every = lists.groupBy("bucket").agg(F.collect_list("ids").alias("l")).filter(F.size("l") == len(wanted))
        both = F.aggregate(F.slice("l", F.lit(2), F.size("l")), F.col("l")[0], lambda a, b: F.array_intersect(a, b))
        return combos.join(every.select(F.explode(both).alias("_combo")), "_combo", "left_semi")

    def search(self, spark: SparkSession, q: str) -> DataFrame:
        """As :func:`roamlog.operators.filters.search` over the indexed table."""
        rows, q = self.versions.read(spark, table="rows"), q.strip()
        if not q:
            return rows.drop("_combo")
        near = self.candidates(spark, q)
        hits = near.filter(matches(near, list(self.cols), q)).select("_combo")
        few = hits.limit(NAMED + 1).collect()
        if len(few) <= NAMED:
            return rows.filter(F.col("_combo").isin([r[0] for r in few])).drop("_combo")
        return rows.join(hits, "_combo", "left_semi").drop("_combo")
