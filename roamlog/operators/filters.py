"""Search and facet filters over result tables."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from roamlog import fixed

CHECKIN_SEARCH = ["venue", "city", "country", "category"]
VENUE_SEARCH = ["name", "city", "country", "category"]
TIP_SEARCH = ["text", "venue", "city", "country", "category"]
TRIP_SEARCH = ["name", "countries", "cities", "start_date"]


def matches(df: DataFrame, cols: list[str], q: str) -> Column:
    needle = F.lower(F.lit(q))
    arrays = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}
    return reduce(
        lambda a, b: a | b,
        [
            F.exists(c, lambda x: F.lower(x).contains(needle)) if c in arrays
            else F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False))
            for c in cols
        ],
    )


def search(df: DataFrame, cols: list[str], q: str) -> DataFrame:
    """Rows where any of ``cols`` contains ``q``, ignoring case; a blank query keeps all."""
    q = q.strip()
    return df if not q else df.filter(matches(df, cols, q))


def filter_by(df: DataFrame, **facets: object) -> DataFrame:
    """Equality on each facet that is set."""
    return reduce(lambda d, kv: d if kv[1] in (None, "") else d.filter(F.col(kv[0]) == kv[1]), facets.items(), df)


def search_country_groups(cities_: DataFrame, q: str) -> DataFrame:
    """City rows of a country list: all of a matching country, else the cities that match."""
    hit = F.lower("primary_country").contains(q.lower()) | F.lower(F.col("name")).contains(q.lower())
    return cities_.filter("primary_country <> ''").filter(hit)


def visited_city_map(cities_: DataFrame, centroids: DataFrame, by: list[str] | None = None, min_n: int = 5) -> DataFrame:
    """Cities with enough check-ins and a known centre."""
    return cities_.filter(F.col("n") >= min_n).join(centroids, [*(by or []), "name"])


def mappable(tips: DataFrame) -> DataFrame:
    return tips.filter("lat IS NOT NULL AND lng IS NOT NULL")


def search_world(world: DataFrame, q: str) -> DataFrame:
    """World-city rows by name, shown name or continent."""
    from roamlog.functions.scalars import lookup

    label = lookup(fixed.CONTINENT_NAMES, F.col("continent"), F.col("continent"))
    return search(world.withColumn("_label", label), ["name", "display_name", "_label"], q).drop("_label")


def sort_world(world: DataFrame) -> DataFrame:
    return world.orderBy(F.desc("pop_m"), F.asc("name"))


TRIP_SORTS = {"date": "trip_id", "checkins": "checkin_count", "days": "duration"}


def sort_trips(summary: DataFrame, by: list[str], key: str = "date") -> DataFrame:
    order = [F.asc("trip_id")] if key == "date" else [F.desc(TRIP_SORTS[key]), F.asc("trip_id")]
    return summary.orderBy(*by, *order)


def sort_tips(tips: DataFrame, key: str = "date") -> DataFrame:
    lead = {"date": [], "agree": [F.desc("agree_count")]}[key]
    return tips.orderBy(*lead, F.desc("ts"), F.asc("id"))
