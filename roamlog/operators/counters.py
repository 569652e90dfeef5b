"""Counts by time and place. ``by`` prefixes every grouping; ``[]`` means one log in all."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from roamlog.functions import scalars as S
from roamlog.operators.common import first_seen, place_key, top_k, utc_date, utc_hour, utc_month, when_seen, with_max
from roamlog.operators.ordered import Desc, chunk_of, numbered
from roamlog.session import stage


def _dated(ck: DataFrame) -> DataFrame:
    return ck.filter(F.col("ts").isNotNull())


def _count(ck: DataFrame, by: list[str], name: str, key: Column) -> DataFrame:
    return _dated(ck).groupBy(*by, key.alias(name)).agg(F.count("*").alias("n"))


def summary(ck: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Total rows, first and last UTC day, distinct countries, cities and places.

    Rows are counted per distinct place first, so the distinct counts copy those and not all rows.
    """
    by = by or []
    located_without_id = (F.col("venue_id") == "") & F.col("lat").isNotNull() & F.col("lng").isNotNull()
    places = ck.groupBy(
        *by, F.nullif("country", F.lit("")).alias("_country"), F.nullif("city", F.lit("")).alias("_city"),
        F.nullif("venue_id", F.lit("")).alias("_venue"),
        F.when(located_without_id, F.struct(F.round("lat", 5), F.round("lng", 5))).alias("_spot"),
    ).agg(F.count("*").alias("_n"), F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    return places.groupBy(*by).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total"),
        utc_date(F.min("_first")).cast("string").alias("date_min"),
        utc_date(F.max("_last")).cast("string").alias("date_max"),
        F.count_distinct("_country").alias("countries"),
        F.count_distinct("_city").alias("cities"),
        (F.count_distinct("_venue") + F.count_distinct("_spot")).alias("unique_places"),
    )


def by_year(ck: DataFrame, by: list[str] | None = None) -> DataFrame:
    return _count(ck, by or [], "year", F.year(utc_date(F.col("ts"))))


def by_month(ck: DataFrame, by: list[str] | None = None) -> DataFrame:
    return _count(ck, by or [], "month", utc_month(F.col("ts")))


def by_hour(ck: DataFrame, by: list[str] | None = None) -> DataFrame:
    return _count(ck, by or [], "hour", utc_hour(F.col("ts")))


def by_dow(ck: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts per weekday, Monday = 0."""
    return _count(ck, by or [], "dow", F.weekday(utc_date(F.col("ts"))))


def _named(ck: DataFrame, by: list[str], col: str) -> DataFrame:
    return (
        ck.filter(F.col(col) != "").groupBy(*by, F.col(col).alias("name"))
        .agg(F.count("*").alias("n"), F.min(when_seen()).alias("first_ts"))
    )


def countries(ck: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``name, n, first_ts``; list order is ``n`` descending, then first seen."""
    return _named(ck, by or [], "country")


def city_primary_country(ck: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Most frequent country of each city; equal counts go to the one seen first."""
    by = by or []
    pairs = ck.filter((F.col("city") != "") & (F.col("country") != "")).groupBy(*by, "city", "country").agg(
        F.count("*").alias("_n"), F.min(when_seen()).alias("_t")
    )
    return pairs.groupBy(*by, F.col("city").alias("name")).agg(
        F.min_by("country", F.struct(-F.col("_n"), "_t", "country")).alias("primary_country")
    )


def cities(ck: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``name, n, first_ts, primary_country`` from one count per (city, country)."""
    by = by or []
    pairs = ck.filter(F.col("city") != "").groupBy(*by, "city", "country").agg(
        F.count("*").alias("_n"), F.min(when_seen()).alias("_t")
    )
    named = F.struct(-F.col("_n"), "_t", "country")
    return pairs.groupBy(*by, F.col("city").alias("name")).agg(
        F.sum("_n").alias("n"), F.min("_t").alias("first_ts"),
        F.coalesce(F.min_by("country", F.when(F.col("country") != "", named)), F.lit("")).alias("primary_country"),
    )


def list_order() -> list[Column]:
    return [F.desc("n"), F.asc("first_ts"), F.asc("name")]


def _centroids(ck: DataFrame, by: list[str], col: str) -> DataFrame:
    return (
        ck.filter((F.col(col) != "") & F.col("lat").isNotNull() & F.col("lng").isNotNull())
        .groupBy(*by, F.col(col).alias("name"))
        .agg(F.round(F.avg("lat"), 3).alias("lat"), F.round(F.avg("lng"), 3).alias("lng"), F.count("*").alias("n"))
    )


def city_centroids(ck: DataFrame, by: list[str] | None = None) -> DataFrame:
    return _centroids(ck, by or [], "city").drop("n")


def country_centroids(ck: DataFrame, by: list[str] | None = None) -> DataFrame:
    return _centroids(ck, by or [], "country")


def country_markers(centroids: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Marker size 18 to 42 by the root of the share of the busiest country."""
    sized = with_max(centroids, by or [], "n", "_max")
    size = F.floor(18 + F.sqrt(F.col("n") / F.col("_max")) * 24 + 0.5).cast("int")
    return sized.withColumn("size", size).drop("_max")


def _distinct_places(ck: DataFrame, by: list[str], col: str) -> DataFrame:
    return (
        ck.filter(F.col(col) != "").withColumn("_place", place_key()).filter("_place IS NOT NULL")
        .groupBy(*by, F.col(col).alias("name")).agg(F.count_distinct("_place").alias("n"))
    )


def countries_by_venues(ck: DataFrame, by: list[str] | None = None) -> DataFrame:
    return _distinct_places(ck, by or [], "country")


def cities_by_venues(ck: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return (
        _distinct_places(ck, by, "city").join(city_primary_country(ck, by), [*by, "name"], "left")
        .withColumn("primary_country", F.coalesce("primary_country", F.lit("")))
    )


def all_coords(ck: DataFrame, by: list[str] | None = None) -> DataFrame:
    return ck.filter("lat IS NOT NULL AND lng IS NOT NULL").select(
        *(by or []), F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng")
    )


def heat_level(n: Column) -> Column:
    return (
        F.when(n.isNull() | (n == 0), 0).when(n <= 2, 1).when(n <= 5, 2).when(n <= 10, 3).when(n <= 20, 4).otherwise(5)
    )


def day_heatmap(ck: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Every day of each year seen: count, level 0 to 5, and its cell (week column, weekday row)."""
    by = by or []
    days = _dated(ck).groupBy(*by, utc_date(F.col("ts")).alias("day")).agg(F.count("*").alias("n"))
    first = F.make_date("year", F.lit(1), F.lit(1))
    spine = days.select(*by, F.year("day").alias("year")).distinct().select(
        *by, "year", F.explode(F.sequence(first, F.make_date("year", F.lit(12), F.lit(31)))).alias("day")
    )
    week = F.floor((F.dayofyear("day") - 1 + F.weekday(first)) / 7).cast("int")
    return (
        spine.join(days, [*by, "day"], "left")
        .select(
            *by, "year", F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"),
            heat_level(F.col("n")).alias("level"), week.alias("week"), F.weekday("day").alias("dow"),
        )
    )


def discovery_rate(ck: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per UTC month: visits to places never seen before, and visits to known ones."""
    by = by or []
    monthly = (
        _dated(ck).withColumn("_place", place_key()).filter("_place IS NOT NULL")
        .groupBy(*by, "_place", utc_month(F.col("ts")).alias("month")).agg(F.count("*").alias("_n"))
    )
    opened = F.col("month") == F.min("month").over(Window.partitionBy(*by, "_place"))
    return monthly.withColumn("_new", opened.cast("int")).groupBy(*by, "month").agg(
        F.sum("_new").cast("bigint").alias("new"), (F.sum("_n") - F.sum("_new")).alias("revisit")
    )


def max_timestamp(df: DataFrame, by: list[str] | None = None, col: str = "date") -> DataFrame:
    """Largest all-digit time, 0 when there is none."""
    digits = S.py_strip(F.col(col).cast("string"))
    value = F.when(digits.rlike("^[0-9]+$"), digits.try_cast("bigint"))
    return df.groupBy(*(by or [])).agg(F.coalesce(F.max(value), F.lit(0)).alias("max_ts"))


def category_list(ck: DataFrame, by: list[str] | None = None) -> DataFrame:
    return _named(ck, by or [], "category")


def category_groups(ck: DataFrame, groups: dict[str, list[str]], by: list[str] | None = None) -> DataFrame:
    """Rows per category group. Categories are counted first, so grouping sees only distinct ones."""
    from roamlog.operators.cleaning import group_of

    counts = _named(ck, by or [], "category")
    return (
        counts.withColumn("group", group_of(F.col("name"), groups)).filter("group IS NOT NULL")
        .groupBy(*(by or []), "group").agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"))
    )


def by_country(cities_: DataFrame, countries_: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Country list over its cities: number of cities and check-ins (the country's own count if known)."""
    by = by or []
    own = countries_.select(*by, F.col("name").alias("country"), F.col("n").alias("_own"))
    grouped = cities_.filter("primary_country <> ''").groupBy(*by, F.col("primary_country").alias("country")).agg(
        F.count("*").alias("cities"), F.sum("n").alias("_sum")
    )
    return grouped.join(own, [*by, "country"], "left").select(
        *by, "country", "cities", F.coalesce("_own", "_sum").alias("n")
    )


COUNTRY_SORTS = {
    "alpha": lambda: [F.asc("country")],
    "checkins": lambda: [F.desc("n"), F.asc("country")],
    "cities": lambda: [F.desc("cities"), F.asc("country")],
}


def rank_list(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rank and share of the top value for a ``name, n, first_ts`` list of any length."""
    by = by or []
    # Staged: rows, offsets and the maximum would each compute the list anew.
    df = stage(df, "list")
    ranked = numbered(
        df, by, [Desc(F.col("n")), chunk_of(F.col("first_ts"))], [F.asc("first_ts"), F.asc("name")], "rank"
    )
    share = with_max(ranked, by, "n", "_max")
    return share.withColumn("pct", F.round(F.col("n") / F.col("_max") * 100, 1)).drop("_max")


def top_list(df: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    return top_k(df, by or [], list_order(), k)


def _row_key(keys: list[str]) -> list[Column]:
    """Key columns as text, stripped, NULL read as blank."""
    return [S.text(F.col(k).cast("string")) for k in keys]


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs more than once.

    Keys are counted with map-side combining and joined back, so the copies of one key are
    never gathered in one task (the adaptive skew join splits the row side).
    """
    norm = _row_key(keys)
    tagged = df.withColumns({f"_d{i}": c for i, c in enumerate(norm)})
    cols = [f"_d{i}" for i in range(len(keys))]
    twice = tagged.groupBy(*cols).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return tagged.join(twice, cols, "left_semi").drop(*cols)


def duplicate_key_count(df: DataFrame, keys: list[str]) -> DataFrame:
    named = [c.alias(f"_d{i}") for i, c in enumerate(_row_key(keys))]
    return df.groupBy(*named).agg(F.count("*").alias("_n")).filter("_n > 1").agg(F.count("*").alias("keys"))
