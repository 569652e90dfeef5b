"""Tables that are replaced as a whole: each version in a folder of its own, published by one empty marker file.

``claims/<n>`` is created first and gives a writer its number, ``data/<n>`` holds the version, ``versions/<n>`` is created
last and makes it visible. Creating one file is atomic where renaming a folder is not, so a reader finds the version
before or after a write, and a writer that is lost at any step leaves only files nobody reads. Readers hold on to the
version they began with: the newest ``keep`` stay. Whoever writes what it read passes ``base``; one such writer at a time.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from roamlog.session import delete_paths


class StaleBase(RuntimeError):
    """Another version was published since the one a writer started from."""


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of ``path``, and its path object."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the entries of a folder, none if it is absent."""
    fs, path = file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


@dataclass(frozen=True)
class Snapshots:
    path: str
    keep: int = 2

    def _numbers(self, spark: SparkSession, kind: str) -> list[int]:
        return [int(n) for n in names_in(spark, f"{self.path}/{kind}") if n.isdigit()]

    def _create(self, spark: SparkSession, kind: str, version: int) -> bool:
        fs, path = file_system(spark, f"{self.path}/{kind}/{version:012d}")
        return fs.createNewFile(path)

    def versions(self, spark: SparkSession) -> list[int]:
        """Published versions that are still kept, oldest first."""
        return self._numbers(spark, "versions")

    def current(self, spark: SparkSession) -> int | None:
        return max(self.versions(spark), default=None)

    def folder(self, version: int) -> str:
        return f"{self.path}/data/{version:012d}"

    def publish(self, spark: SparkSession, write: Callable[[str], None], base: int | None = None) -> int:
        """Let ``write`` fill a new folder, then make it the current version. Returns its number."""
        version = max([*self._numbers(spark, "claims"), *self.versions(spark)], default=0) + 1
        while not self._create(spark, "claims", version):
            version += 1
        write(self.folder(version))
        if base is not None and (self.current(spark) or 0) != base:
            raise StaleBase(f"{self.path} moved on from version {base}")
        self._create(spark, "versions", version)
        self.expire(spark)
        return version

    def write(self, df: DataFrame, fmt: str = "parquet", base: int | None = None, **options: str) -> int:
        """A new version with the rows of ``df``, which may be read from an older one."""
        return self.publish(df.sparkSession, lambda folder: df.write.options(**options).format(fmt).save(folder), base)

    def write_all(self, tables: dict[str, DataFrame], fmt: str = "parquet") -> int:
        """A new version with several tables, which become visible together."""
        def each(folder: str) -> None:
            for name, df in tables.items():
                df.write.format(fmt).save(f"{folder}/{name}")

        return self.publish(next(iter(tables.values())).sparkSession, each)

    def read(self, spark: SparkSession, version: int | None = None, table: str | None = None, fmt: str = "parquet") -> DataFrame:
        """The current version (or a kept older one); ``table`` names one of several."""
        version = self.current(spark) if version is None else version
        if version is None:
            raise FileNotFoundError(f"{self.path} has no version yet")
        return spark.read.format(fmt).load(self.folder(version) + (f"/{table}" if table else ""))

    def expire(self, spark: SparkSession) -> None:
        """Delete versions beyond the newest ``keep``, marker first, and what lost writers before them left."""
        kept = self.versions(spark)[-self.keep :]
        if not kept:
            return
        for kind in ("versions", "data", "claims"):
            delete_paths(spark, [f"{self.path}/{kind}/{n:012d}" for n in self._numbers(spark, kind) if n < kept[0]])
