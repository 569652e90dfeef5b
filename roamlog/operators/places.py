"""Venues: top lists, loyalty, explorer groups, unique places and heat weights."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roamlog.operators.common import first_seen, last_seen, top_k, utc_date, when_seen, with_max
from roamlog.operators.counters import list_order

_HAS_ID = "venue_id <> ''"
_HAS_ID_AND_NAME = "venue_id <> '' AND venue <> ''"


def venue_counts(ck: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per venue id: first name and city seen, and rows."""
    by = by or []
    v = first_seen(ck.filter(_HAS_ID_AND_NAME), [*by, "venue_id"], ["venue", "city"])
    return v.withColumnRenamed("venue", "name")


def top_venues(ck: DataFrame, by: list[str] | None = None, k: int = 500) -> DataFrame:
    return top_k(venue_counts(ck, by), by or [], [*list_order(), F.asc("venue_id")], k)


def venues_page(ck: DataFrame, by: list[str] | None = None, k: int = 500) -> DataFrame:
    """Per venue id: last name, city, country and category seen, rows, distinct years."""
    by = by or []
    rows = ck.filter(_HAS_ID_AND_NAME)
    keys = [*by, "venue_id"]
    last = last_seen(rows, keys, ["venue", "city", "country", "category"])
    years = (
        rows.groupBy(*keys, F.year(utc_date(F.col("ts"))).alias("year")).agg(F.min(when_seen()).alias("_t"))
        .groupBy(*keys).agg(F.array_sort(F.collect_set("year")).alias("years"), F.min("_t").alias("first_ts"))
    )
    page = last.join(years, keys).withColumnRenamed("venue", "name")
    return top_k(page, by, [*list_order(), F.asc("venue_id")], k)


VENUE_SORTS = {
    "count": lambda d: [F.desc("n") if d > 0 else F.asc("n")],
    "years": lambda d: [F.desc(F.size("years")) if d > 0 else F.asc(F.size("years")), F.desc("n")],
    "name": lambda d: [F.asc("name") if d > 0 else F.desc("name")],
}


def sort_venues(page: DataFrame, key: str = "count", direction: int = 1) -> DataFrame:
    return page.orderBy(*VENUE_SORTS[key](direction), F.asc("venue_id"))


def venue_loyalty(ck: DataFrame, by: list[str] | None = None, min_years: int = 3, k: int = 100) -> DataFrame:
    """Venues seen in at least ``min_years`` UTC years, most years first."""
    by = by or []
    keys = [*by, "venue_id"]
    yearly = (
        ck.filter(_HAS_ID).filter("ts IS NOT NULL")
        .groupBy(*keys, "venue", "city", F.year(utc_date(F.col("ts"))).alias("year"))
        .agg(F.count("*").alias("_n"), F.min("ts").alias("_t"))
    )
    loyal = yearly.groupBy(*keys).agg(
        F.array_sort(F.collect_set("year")).alias("years"), F.sum("_n").alias("n"), F.min("_t").alias("first_ts"),
        F.min_by(F.struct("venue", "city"), F.struct("_t", "venue", "city")).alias("_v"),
    ).filter(F.size("years") >= min_years).select(
        *keys, F.col("_v.venue").alias("name"), F.col("_v.city").alias("city"), "years", "n", "first_ts"
    )
    return top_k(loyal, by, [F.desc(F.size("years")), *list_order(), F.asc("venue_id")], k)


def category_explorer(ck: DataFrame, groups: DataFrame, by: list[str] | None = None, k: int = 50) -> DataFrame:
    """Top venues of each display group.

    ``groups(category, group, group_ord, cat_ord)`` may list a category in several groups. The
    name shown is the first one seen under the group's first matching category.
    """
    by = by or []
    combos = (
        ck.filter(_HAS_ID_AND_NAME).filter("category <> ''")
        .groupBy(*by, "category", "venue_id", "venue", "city")
        .agg(F.count("*").alias("_n"), F.min(when_seen()).alias("_t"))
    )
    keys = [*by, "group", "group_ord", "venue_id"]
    rolled = combos.join(groups, "category").groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        F.min(F.struct("cat_ord", "_t", "venue", "city")).alias("_v"),
    ).select(*keys, F.col("_v.venue").alias("name"), F.col("_v.city").alias("city"), "n", "_v")
    order = [F.desc("n"), F.asc("_v"), F.asc("venue_id")]
    return top_k(rolled, [*by, "group", "group_ord"], order, k).drop("_v")


def unique_places(ck: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One point per venue at its first sighting, one per coordinate for rows without an id."""
    by = by or []
    rows = ck.select(*by, "ts", "venue_id", "venue", F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng"))
    located = "lat IS NOT NULL AND lng IS NOT NULL"
    venues = first_seen(rows.filter(_HAS_ID), [*by, "venue_id"], ["lat", "lng", "venue"]).filter(located)
    points = first_seen(rows.filter(f"NOT ({_HAS_ID})").filter(located), [*by, "lat", "lng"], ["venue"])
    cols = [*by, "lat", "lng", "venue"]
    return venues.select(*cols).unionByName(points.select(*cols))


def unique_places_count(ck: DataFrame, by: list[str] | None = None) -> DataFrame:
    from roamlog.operators.counters import summary

    return summary(ck, by).select(*(by or []), F.col("unique_places").alias("n"))


def venue_heatmap(ck: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per venue: first coordinates and a log weight relative to the busiest venue."""
    by = by or []
    rows = ck.filter(_HAS_ID).filter("lat IS NOT NULL AND lng IS NOT NULL")
    counts = with_max(first_seen(rows, [*by, "venue_id"], ["lat", "lng"]), by, "n", "_max")
    return counts.select(
        *by, "venue_id", "lat", "lng", F.round(F.log1p("n") / F.log1p("_max"), 4).alias("weight")
    )


def venue_ids(ck: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct venue ids with the time first seen."""
    return ck.filter(_HAS_ID).groupBy(*(by or []), "venue_id").agg(F.min(when_seen()).alias("first_ts"))


def latest_by_venue(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Newest row of each venue; an unparsable time counts as 0. Map tasks keep one row per venue."""
    order = [F.desc(F.coalesce("ts", F.lit(0))), F.asc("checkin_id")]
    return top_k(df.filter(_HAS_ID), [*(by or []), "venue_id"], order, 1)
