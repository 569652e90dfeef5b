"""Writers: stored tables, result sets, page payloads and reports."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from roamlog.functions import scalars as S
from roamlog.operators.common import utc_date
from roamlog.operators.counters import category_list
from roamlog.schema import CHECKIN_FIELDS


def write_checkins(df: DataFrame, path: str, fmt: str = "parquet", extra: list[str] | None = None,
                   mode: str = "errorifexists") -> None:
    """Stored columns in fixed order, in order of time from file to file; Parquet is partitioned by UTC year.

    Ranges of time are dealt to tasks by their rows, so a full year is spread over many of them.
    """
    cols = [*CHECKIN_FIELDS, *(extra or [])]
    out = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    time, tie = S.to_long(F.col("date")), F.xxhash64("venue_id", "checkin_id")
    if fmt == "csv":
        out.repartitionByRange(time, tie).sortWithinPartitions(time, tie).write.mode(mode).csv(
            path, header=True, escape='"', emptyValue="", encoding="UTF-8")
        return
    year = F.coalesce(F.year(utc_date(S.to_long(F.col("date")))), F.lit(0))
    out.withColumn("year", year).repartitionByRange("year", time, tie).sortWithinPartitions("year", time, tie).write.mode(mode).partitionBy("year").format(fmt).save(path)


def write_atomic(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    """Write beside ``path`` and swap by rename, so readers see the old or the new table."""
    spark = df.sparkSession
    tag = uuid.uuid4().hex
    fresh, old = f"{path}.new-{tag}", f"{path}.old-{tag}"
    df.write.options(**options).format(fmt).save(fresh)
    make = spark._jvm.org.apache.hadoop.fs.Path
    target = make(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(target)
    if had and not fs.rename(target, make(old)):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(make(fresh), target):
        if had:
            fs.rename(make(old), target)
        raise OSError(f"cannot move the new table to {path}")
    if had:
        fs.delete(make(old), True)


def write_gold(tables: dict[str, DataFrame], out: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One dataset per named result."""
    for name, df in tables.items():
        df.write.mode(mode).format(fmt).save(f"{out}/{name}")


def write_payload(df: DataFrame, path: str, order: list | None = None, mode: str = "overwrite") -> None:
    """Rows as one JSON text per line, globally sorted when ``order`` is given."""
    rows = df.orderBy(*order) if order else df
    rows.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def category_report(ck: DataFrame) -> DataFrame:
    """Report lines in order: heading, then one line per category, most frequent first."""
    cats = category_list(ck)
    lines = cats.select(
        F.concat(F.lit("  "), F.lpad(F.format_number("n", 0), 6, " "), F.lit("  "), F.col("name")).alias("value"),
        (-F.col("n")).alias("o1"), F.col("first_ts").alias("o2"),
    )
    total = cats.agg(F.concat(F.lit("Total unique categories: "), F.count("*").cast("string")).alias("value"))
    head = total.select(
        F.posexplode(F.array(F.lit("FULL CATEGORY LIST"), F.lit("=" * 60), F.col("value"), F.lit(""))).alias("p", "value")
    ).select("value", (F.lit(-(1 << 62)) + F.col("p")).cast("bigint").alias("o1"), F.lit(0).cast("bigint").alias("o2"))
    return head.unionByName(lines).orderBy("o1", "o2", "value").select("value")


def write_category_report(ck: DataFrame, path: str) -> None:
    category_report(ck).write.mode("overwrite").text(path)


def write_anomalies(ledger: DataFrame, path: str) -> None:
    """Anomaly ledger by kind, sorted by time inside each file."""
    out = ledger.withColumn("_t", F.coalesce(S.to_long(F.col("date")), F.lit(0))).sortWithinPartitions("kind", "_t").drop("_t")
    write_atomic(out, path)
