"""Small building blocks shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_LATE = (1 << 63) - 1


def when_seen(ts: str = "ts") -> Column:
    """Time used for first-seen order; undated rows come last."""
    return F.coalesce(F.col(ts), F.lit(_LATE))


def utc_date(ts: Column) -> Column:
    """UTC calendar day of unix seconds, whatever the session time zone."""
    return F.date_from_unix_date(F.floor(ts / 86_400).cast("int"))


def utc_hour(ts: Column) -> Column:
    return F.floor(F.pmod(ts, F.lit(86_400)) / 3600).cast("int")


def utc_month(ts: Column) -> Column:
    return F.date_format(utc_date(ts), "yyyy-MM")


def place_key() -> Column:
    """Venue id, or the venue name where the id is blank; NULL when both are."""
    return F.coalesce(F.nullif(F.col("venue_id"), F.lit("")), F.nullif(F.col("venue"), F.lit("")))


def first_seen(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Row count and earliest ``values`` per key; equal times go to the smallest values.

    Rows are first counted per distinct (key, values), which hashes with long buffers and
    combines before the shuffle; the ordered pick then runs over those few combinations. A key
    with a third of all rows therefore sends only its distinct values to one task.
    """
    combos = df.groupBy(*keys, *values).agg(F.count("*").alias("_n"), F.min(when_seen()).alias("_t"))
    return combos.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        F.min("_t").alias("first_ts"),
        F.min_by(F.struct(*values), F.struct("_t", *values)).alias("_v"),
    ).select(*keys, "n", "first_ts", *[F.col(f"_v.{v}").alias(v) for v in values])


def last_seen(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Row count and latest ``values`` per key; equal times go to the largest values."""
    t = F.coalesce(F.col("ts"), F.lit(0))
    combos = df.groupBy(*keys, *values).agg(F.count("*").alias("_n"), F.max(t).alias("_t"))
    return combos.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        F.max_by(F.struct(*values), F.struct("_t", *values)).alias("_v"),
    ).select(*keys, "n", *[F.col(f"_v.{v}").alias(v) for v in values])


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per ``by`` in ``order``; each map task sends at most ``k`` rows per key."""
    if not by:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def with_max(df: DataFrame, by: list[str], col: str, name: str) -> DataFrame:
    """Largest ``col`` of the ``by`` group on every row, without one task per group."""
    if not by:
        return df.withColumn(name, df.select(F.max(col)).scalar())
    return df.join(df.groupBy(*by).agg(F.max(col).alias(name)), by)
