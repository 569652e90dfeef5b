"""Session settings and the one place where intermediate tables are staged."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "roamlog", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on (UTC, AQE with skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Trip detection compiles more than the default 100 stages; keep them between runs.
        "spark.sql.codegen.cache.maxEntries": "1000",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir``, read from the session.

    Only a local master may fall back to a temporary folder of its own; a cluster without
    the setting is an error, since a machine-local path is invisible to other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    fallback = os.path.join(tempfile.gettempdir(), f"roamlog-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


_WRITTEN: list[str] = []


def stage(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage of a plan that is read by several later branches. The files are
    durable, so a lost executor costs only its own tasks, and each reader prunes columns.
    ``options`` are those of the Parquet writer.
    """
    path, table = stage_apart(df, name, **options)
    _WRITTEN.append(path)
    return table


def stage_apart(df: DataFrame, name: str, **options: object) -> tuple[str, DataFrame]:
    """The same for a table whose path the caller keeps, and deletes with :func:`delete_paths`."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def keep_staged(paths: list[str]) -> None:
    """Hand tables of :func:`stage_apart` over to :func:`drop_staged`."""
    _WRITTEN.extend(paths)


def staged_count() -> int:
    return len(_WRITTEN)


def take_staged(after: int = 0) -> list[str]:
    """Paths staged since there were ``after`` of them; the caller now owns them and deletes them."""
    taken = _WRITTEN[after:]
    del _WRITTEN[after:]
    return taken


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(spark: SparkSession, after: int = 0) -> None:
    """Delete the tables this application staged, once the results built on them are written.

    ``after`` (from :func:`staged_count`) keeps what was staged before.
    """
    delete_paths(spark, take_staged(after))
