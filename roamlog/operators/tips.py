"""Tips: tabs per country and city, the newest ones, and display fields."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roamlog.functions import scalars as S
from roamlog.operators.cleaning import norm_country, norm_tip_city
from roamlog.operators.common import top_k


def normalised(tips: DataFrame, merge: DataFrame | None = None) -> DataFrame:
    """Tips with English country ``nc``, merged city ``nci``, UTC ``date`` and ``time``."""
    t = norm_tip_city(norm_country(tips), merge)
    has_ts = F.coalesce(F.col("ts"), F.lit(0)) != 0
    at = F.timestamp_seconds("ts")
    return t.withColumns(
        {
            "date": F.when(has_ts, S.fmt_day(at)).otherwise(""),
            "time": F.when(has_ts, S.fmt_time(at)).otherwise(""),
        }
    )


def tips_tabs(norm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per country and city: tips there and in the whole country. Blank cities count only in the total."""
    by = by or []
    cells = norm.filter("nc <> ''").groupBy(*by, F.col("nc").alias("country"), F.col("nci").alias("city")).agg(
        F.count("*").alias("n"))
    totals = cells.groupBy(*by, "country").agg(F.sum("n").alias("total"))
    listed = cells.filter("city <> ''")
    return totals.join(listed, [*by, "country"], "left").select(
        *by, "country", "total", F.coalesce("city", F.lit("")).alias("city"), F.coalesce("n", F.lit(0)).alias("n"))


def tips_recent(norm: DataFrame, by: list[str] | None = None, k: int = 30) -> DataFrame:
    """Newest ``k`` tips with the number of all tips."""
    by = by or []
    newest = top_k(norm, by, [F.desc(F.coalesce("ts", F.lit(0))), F.asc("id")], k)
    if by:
        newest = newest.join(norm.groupBy(*by).agg(F.count("*").alias("total")), by)
    else:
        newest = newest.withColumn("total", norm.select(F.count("*")).scalar())
    return newest.select(
        *by, "total", "id", "ts", "date", "text", "venue", "venue_id", "city", "country", "nc", "nci", "category",
        F.coalesce("agree_count", F.lit(0)).alias("agree_count"), F.coalesce("closed", F.lit(False)).alias("closed"),
    )


def uncovered_venues(ck: DataFrame, tips: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Venues visited that no tip belongs to."""
    from roamlog.operators.places import venue_ids

    by = by or []
    covered = tips.filter("venue_id <> ''").select(*by, "venue_id").distinct()
    return venue_ids(ck, by).join(covered, [*by, "venue_id"], "left_anti")
