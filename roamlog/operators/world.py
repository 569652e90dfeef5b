"""Matching a world-city list with the cities visited."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from roamlog import fixed
from roamlog.functions import scalars as S


def alias_table(spark, aliases: dict[str, list[str]]) -> DataFrame:
    rows = [(name, a, i + 1) for name, others in aliases.items() for i, a in enumerate(others)]
    return spark.createDataFrame(rows, "name string, other string, priority int")


def continent_table(spark, mapping: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(list((mapping or fixed.COUNTRY_CONTINENT).items()), "country string, known string")


def match_world_cities(
    world: DataFrame, visited: DataFrame, aliases: DataFrame, continents: DataFrame,
    ignore_case: bool = True, by: list[str] | None = None,
) -> DataFrame:
    """World cities with the visited city they stand for, if any.

    Tries the name, then each alias in order; a visited city whose country is on another
    continent does not count. ``visited`` is a city list (``name, n, primary_country, first_ts``);
    with ``by``, the list is matched once per log that visited the city.
    """
    by = by or []

    def key(c: str) -> Column:
        return F.lower(F.col(c)) if ignore_case else F.col(c)

    names = world.select("name", "continent", key("name").alias("_k"), F.lit(0).alias("priority"))
    others = world.join(aliases, "name").select("name", "continent", key("other").alias("_k"), "priority")
    wanted = names.unionByName(others)
    seen = visited.join(continents, F.col("primary_country") == F.col("country"), "left").select(
        *by, key("name").alias("_k"), F.col("name").alias("_v"), "n", "first_ts", "known")
    if ignore_case:
        # Names that differ only in case share a slot; the last of the list order keeps it.
        seen = seen.groupBy(*by, "_k").agg(
            F.min_by(F.struct("_v", "n", "known"), F.struct("n", -F.col("first_ts"), "_v")).alias("s")
        ).select(*by, "_k", "s._v", "s.n", "s.known")
    hits = wanted.join(seen, "_k").filter(
        F.col("known").isNull() | F.col("continent").isNull() | (F.col("known") == F.col("continent"))
    )
    best = hits.groupBy(*by, "name", "continent").agg(
        F.min_by(F.struct(F.col("_v").alias("v"), "n"), F.struct("priority", F.col("_v"))).alias("_b"))
    matched = world.join(best, ["name", "continent"], "left" if not by else "inner")
    return matched.select(
        *by, *world.columns, F.col("_b").isNotNull().alias("visited"), F.coalesce("_b.n", F.lit(0)).alias("n"),
        F.coalesce("_b.v", "name").alias("display_name"), S.population_label(F.col("pop_m")).alias("population"),
    )


def world_coverage(matched: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Visited and total cities per continent."""
    return matched.groupBy(*(by or []), "continent").agg(
        F.count_if("visited").alias("visited"), F.count("*").alias("total"))


def add_population(cities_: DataFrame, world: DataFrame) -> DataFrame:
    """Population by city name ignoring case (NULL when unknown); the largest entry of a name wins."""
    pops = world.groupBy(F.lower("name").alias("_k")).agg(F.max("pop_m").alias("pop_m"))
    label = F.when(F.coalesce("pop_m", F.lit(0.0)) > 0, S.population_label(F.col("pop_m"))).otherwise("")
    return (
        cities_.withColumn("_k", F.lower("name")).join(pops, "_k", "left").drop("_k").withColumn("population", label)
    )
