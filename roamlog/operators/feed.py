"""Newest-first feed: local times, gaps to the newer neighbour, month index, weather."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from roamlog.functions import scalars as S
from roamlog.operators.common import top_k, utc_month
from roamlog.operators.ordered import DAY, with_previous
from roamlog.operators.skew import left_join_skewed

FEED_COLUMNS = ["ts", "date", "time", "venue", "city", "country", "category", "venue_id", "lat", "lng"]


def feed(ck: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Dated rows with local date and time. Order is ``ts`` then ``checkin_id``, both descending."""
    at = S.localise(F.col("ts"), S.tz_for(F.col("country"), F.col("lat"), F.col("lng"), policy="bands"))
    return ck.filter("ts IS NOT NULL AND ts <> 0").withColumn("_at", at).select(
        *(by or []), "checkin_id", "ts", S.fmt_day(F.col("_at")).alias("date"), S.fmt_time(F.col("_at")).alias("time"),
        "venue", "city", "country", "category", "venue_id",
        F.round("lat", 4).alias("lat"), F.round("lng", 4).alias("lng"),
    )


def feed_gaps(feed_: DataFrame, by: list[str] | None = None, chunk_seconds: int | None = None) -> DataFrame:
    """Seconds and distance from each row to the next newer one.

    The newer neighbour is the previous row when time is read backwards, so the chunked lag
    runs on negated time.
    """
    by = by or []
    back = feed_.withColumn("_neg", -F.col("ts"))
    w = with_previous(back, by, ["ts", "lat", "lng", "checkin_id"], ts="_neg", tie="checkin_id",
                      chunk_seconds=chunk_seconds, prefix="newer_").drop("_neg")
    seconds = F.col("newer_ts") - F.col("ts")
    km = S.haversine_km(F.col("newer_lat"), F.col("newer_lng"), F.col("lat"), F.col("lng"))
    return w.select(
        *feed_.columns, seconds.alias("gap_seconds"), F.round(km, 6).alias("gap_km"),
        S.gap_bucket(seconds).alias("gap"), S.gap_label(seconds).alias("gap_label"),
        F.coalesce(S.distance_label(km), F.lit("")).alias("distance"),
    )


def month_index(feed_: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Position (0-based) of the newest row of each UTC month: the number of rows in later months."""
    by = by or []
    counts = feed_.groupBy(*by, utc_month(F.col("ts")).alias("month")).agg(F.count("*").alias("n"))
    later = Window.partitionBy(*([F.col(c) for c in by] or [F.lit(0)])).orderBy(F.desc("month")).rowsBetween(
        Window.unboundedPreceding, -1)
    return counts.withColumn("pos", F.coalesce(F.sum("n").over(later), F.lit(0))).drop("n")


def local_months(feed_: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Check-ins per local calendar month."""
    month = F.date_format(F.to_date("date", "dd MMM yyyy"), "yyyy-MM")
    return feed_.groupBy(*(by or []), month.alias("month")).agg(F.count("*").alias("n"))


def recent(ck: DataFrame, by: list[str] | None = None, k: int = 30) -> DataFrame:
    """Newest ``k`` rows with local time, zone, and how often their venue occurs among them."""
    by = by or []
    newest = top_k(ck.filter("ts IS NOT NULL"), by, [F.desc("ts"), F.asc("checkin_id")], k)
    lat, lng = F.round("lat", 5), F.round("lng", 5)
    shown = newest.withColumn("tz_name", S.tz_for(F.col("country"), lat, lng)).withColumn(
        "_at", S.localise(F.col("ts"), F.col("tz_name")))
    again = F.count(F.when(F.col("venue_id") != "", 1)).over(Window.partitionBy(*by, "venue_id"))
    return shown.select(
        *by, "checkin_id", "ts", S.fmt_date(F.col("_at")).alias("date"), S.fmt_time(F.col("_at")).alias("time"),
        S.fmt_datetime(F.col("_at")).alias("datetime"), "venue", "venue_id", "city", "country", "category",
        lat.alias("lat"), lng.alias("lng"), "tz_name",
        F.when(F.col("venue_id") != "", again).otherwise(0).alias("streak"),
    )


def weather_join(ck: DataFrame, hourly: DataFrame, by: list[str] | None = None, utc_day: bool = True) -> DataFrame:
    """Temperature and weather code of each located row from an hourly table.

    ``hourly(lat1, lng1, utc_date, hour, temp, code)``: rows meet on rounded place, day and
    **local** hour; the day is the UTC day unless ``utc_day`` is false (then the local one). Rows
    of a busy place and hour are dealt to several tasks; rows without a place have no weather.
    """
    tz = S.tz_for(F.col("country"), F.col("lat"), F.col("lng"), policy="bands")
    local = S.localise(F.col("ts"), tz)
    day = F.date_from_unix_date(F.floor(F.col("ts") / DAY).cast("int")) if utc_day else F.to_date(local)
    rows = ck.filter("ts IS NOT NULL").withColumns(
        {"lat1": F.round("lat", 1), "lng1": F.round("lng", 1), "utc_date": day.cast("string"), "hour": F.hour(local)}
    )
    label = S.weather_label(F.col("code"), F.col("hour"))
    met = left_join_skewed(rows, hourly, ["lat1", "lng1", "utc_date", "hour"], spread=["ts", "checkin_id"])
    return met.withColumn("_w", label).select(
        *(by or []), "checkin_id", "ts", "utc_date", "hour", "temp", "code",
        F.col("_w.icon").alias("icon"), F.col("_w.description").alias("description"),
    )
