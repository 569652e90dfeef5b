"""Rows of users in sorted runs of files, merged level by level.

A batch is one run of level 0. ``fanout`` runs of a level are merged into one of the next, so a row is rewritten once per
level and small files do not pile up. Rows of a run lie in the order of a 64-bit slot of their user, cut into files of
about ``file_rows`` rows (a busy user over many of them, by time). A list of the files with their ranges is published as a
snapshot after each change, so readers see whole batches only, and rows of given users are read from their files alone.
"""
from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from roamlog.session import delete_paths, stage_apart
from roamlog.sources.snapshots import Snapshots, names_in

SLOT, AT = "_slot", "_at"
_FILES = "run string, level int, file string, n long, lo long, hi long, lo_at long, hi_at long"


@dataclass(frozen=True)
class UserRuns:
    """Runs under ``path``. Rows carry ``user`` and a number ``_at`` (a time or a version) to order them by."""

    path: str
    user: str = "user_id"
    fanout: int = 8
    file_rows: int = 1_000_000

    @property
    def catalog(self) -> Snapshots:
        return Snapshots(f"{self.path}/files")

    def slot(self) -> Column:
        return F.xxhash64(F.col(self.user).cast("string"))

    def files(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The files of the current (or a kept) version with their runs, levels, rows and ranges."""
        version = self.catalog.current(spark) if version is None else version
        return spark.createDataFrame([], _FILES) if version is None else self.catalog.read(spark, version)

    def read_files(self, spark: SparkSession, files: list[str], schema: str | None = None) -> DataFrame | None:
        return (spark.read.schema(schema) if schema else spark.read).parquet(*files) if files else None

    def read(self, spark: SparkSession) -> DataFrame | None:
        """All rows with their ``_slot`` and ``_at``; None before the first run."""
        return self.read_files(spark, self._names(self.files(spark)))

    def files_of(self, touched: DataFrame) -> list[str]:
        """Files that may hold rows of the users ``touched``.

        With ``lo_at`` and ``hi_at`` beside the user, only files that reach into that range of ``_at``. A run of k files
        covers the slots once, so in cells of a k-th of them its files meet few cells and a user few files.
        """
        spark = touched.sparkSession
        cells = F.greatest(F.lit(1), F.ceil(F.log2(F.count("*").over(Window.partitionBy("run"))))).cast("int")
        files = self.files(spark).withColumn("bits", cells)
        widths = [r.bits for r in files.select("bits").distinct().collect()]
        if not widths:
            return []
        files = files.select("file", "lo", "hi", "lo_at", "hi_at", "bits", F.explode(
            F.expr("sequence(shiftright(lo, 64 - bits), shiftright(hi, 64 - bits))")).alias("cell"))
        bounds = ["lo_at", "hi_at"] if "lo_at" in touched.columns else []
        users = touched.select(self.slot().alias(SLOT), *[F.col(c).alias(f"_{c}") for c in bounds]).withColumn(
            "bits", F.explode(F.array(*map(F.lit, widths)))).withColumn("cell", F.expr(f"shiftright({SLOT}, 64 - bits)"))
        met = F.col(SLOT).between(F.col("lo"), F.col("hi"))
        if bounds:
            met = met & (F.col("_lo_at") <= F.col("hi_at")) & (F.col("_hi_at") >= F.col("lo_at"))
        return self._names(files.join(users, ["bits", "cell"]).filter(met))

    def _names(self, files: DataFrame) -> list[str]:
        return sorted(f"{self.path}/runs/{r.file}" for r in files.select("file").distinct().collect())

    def _write_run(self, rows: DataFrame, n: int, level: int) -> tuple[str, DataFrame]:
        """``n`` rows as a run of its own; returns its entries for the list of files, staged, and their path."""
        run = f"{level}-{uuid.uuid4().hex}"
        order = [SLOT, self.user, AT]
        folder = f"{self.path}/runs/{run}"
        rows.repartitionByRange(max(1, math.ceil(n / self.file_rows)), *order).sortWithinPartitions(*order).write.parquet(folder)
        file = F.concat(F.lit(f"{run}/"), F.col("_metadata.file_name"))
        return stage_apart(rows.sparkSession.read.parquet(folder).groupBy(file.alias("file")).agg(
            F.count("*").alias("n"), F.min(SLOT).alias("lo"), F.max(SLOT).alias("hi"), F.min(AT).alias("lo_at"), F.max(AT).alias("hi_at")
        ).select(F.lit(run).alias("run"), F.lit(level).alias("level"), "file", "n", "lo", "hi", "lo_at", "hi_at"), "run-files")

    def append(self, rows: DataFrame) -> None:
        """Add staged ``rows`` (with ``_at``) as a run of level 0 and merge the levels that are full, as one new version."""
        spark, base = rows.sparkSession, self.catalog.current(rows.sparkSession)
        n = rows.count()
        if not n:
            return
        path, fresh = self._write_run(rows.withColumn(SLOT, self.slot()), n, 0)
        paths, files = [path], self.files(spark, base).unionByName(fresh)
        while (due := self._full_level(files)) is not None:
            level, n = due
            merged = self.merged(self.read_files(spark, self._names(files.filter(F.col("level") == level))))
            path, fresh = self._write_run(merged, n, level + 1)
            paths.append(path)
            files = files.filter(F.col("level") != level).unionByName(fresh)
        self.catalog.write(files, base=base or 0)
        delete_paths(spark, paths)
        self.sweep(spark)

    def _full_level(self, files: DataFrame) -> tuple[int, int] | None:
        """The lowest level with ``fanout`` runs, and its rows."""
        due = files.groupBy("level").agg(F.count_distinct("run").alias("runs"), F.sum("n").alias("n")).filter(
            F.col("runs") >= self.fanout).orderBy("level").first()
        return None if due is None else (due.level, due.n)

    def merged(self, rows: DataFrame) -> DataFrame:
        """What of the rows of several runs goes into the run made of them."""
        return rows

    def sweep(self, spark: SparkSession) -> None:
        """Delete runs that no kept version names: replaced ones, and those of writers that were lost."""
        named = {r.run for v in self.catalog.versions(spark) for r in self.files(spark, v).select("run").distinct().collect()}
        delete_paths(spark, [f"{self.path}/runs/{r}" for r in names_in(spark, f"{self.path}/runs") if r not in named])


@dataclass(frozen=True)
class UserResults(UserRuns):
    """A result per user, replaced for whole users: a newer run hides all older rows of the users it names.

    A run holds one row without values for each user it replaces, so that a user whose result is now empty loses the
    old one. Merging runs drops the rows they hide from each other.
    """

    def replace(self, rows: DataFrame, touched: DataFrame) -> None:
        """``rows`` become the whole result of the users ``touched``; other users keep theirs. Both should be staged."""
        version = F.lit((self.catalog.current(rows.sparkSession) or 0) + 1).cast("bigint")
        marks = touched.select(F.col(self.user).cast(rows.schema[self.user].dataType).alias(self.user)).distinct()
        every = rows.withColumn("_row", F.lit(True)).unionByName(marks.withColumn("_row", F.lit(False)), allowMissingColumns=True)
        self.append(every.withColumn(AT, version))

    def merged(self, rows: DataFrame) -> DataFrame:
        last = rows.filter("NOT _row").groupBy(SLOT, self.user).agg(F.max(AT).alias("_last"))
        return rows.join(last, [SLOT, self.user]).filter(F.col(AT) == F.col("_last")).drop("_last")

    def _shown(self, rows: DataFrame) -> DataFrame:
        return self.merged(rows).filter("_row").drop("_row", SLOT, AT)

    def results(self, spark: SparkSession) -> DataFrame | None:
        """The current result of all users; None before the first."""
        rows = self.read(spark)
        return None if rows is None else self._shown(rows)

    def results_of(self, touched: DataFrame) -> DataFrame | None:
        """The current result of some users, from their files."""
        rows = self.read_files(touched.sparkSession, self.files_of(touched))
        return None if rows is None else self._shown(rows.join(touched.select(self.user).distinct(), self.user, "left_semi"))
