"""From files to result tables: configuration folder, cleaning, results, name registry."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from roamlog.operators.cleaning import Mappings, Resolver
from roamlog.plans import dashboard, trips as TR
from roamlog.session import drop_staged, staged_count
from roamlog.sources import readers as R, sinks


@dataclass(frozen=True)
class Config:
    mappings: Mappings
    resolver: Resolver | None
    settings: dashboard.Settings


def load_config(spark: SparkSession, folder: str) -> Config:
    """Tables of a configuration folder; absent files mean absent tables.

    The trip tables of such a folder belong to one log (no key columns).
    """
    def lookup(name: str) -> DataFrame | None:
        table = R.read_lookup(spark, f"{folder}/{name}")
        return None if table.isEmpty() else table

    def times(name: str, value: str) -> DataFrame | None:
        table = lookup(name)
        return table and table.select(F.col("key").cast("bigint").alias("start_ts"), F.col("value").cast("bigint").alias(value))

    names, exclude = lookup("trip_names.json"), R.read_lookup(spark, f"{folder}/trip_exclude.json", "list")
    tags = R.read_lookup(spark, f"{folder}/trip_tags.json", "tags")
    tables = TR.TripTables(
        names=names and names.select(F.col("key").cast("bigint").alias("name_ts"), F.col("value").alias("name")),
        tags=None if tags.isEmpty() else tags,
        exclude=None if exclude.isEmpty() else exclude.select(F.col("value").cast("bigint").alias("start_ts")),
        end_overrides=times("trip_end_overrides.json", "end_ts"),
        start_overrides=times("trip_start_overrides.json", "new_start_ts"),
    )
    found = R.read_settings(spark, f"{folder}/settings.yaml")
    groups = R.read_lookup(spark, f"{folder}/categories.json", "groups", "explorer_groups")
    review = R.read_blank_city_review(spark, f"{folder}/city_merge_normalized_review.csv")
    return Config(
        Mappings(lookup("country_fixes.json"), lookup("city_fixes.json"), lookup("city_merge.yaml")),
        Resolver(*review) if R.exists(spark, f"{folder}/city_merge_normalized_review.csv") else None,
        dashboard.Settings(
            found["home_city"], found["min_checkins"], R.read_groups(spark, f"{folder}/categories.json", "category_groups"),
            None if groups.isEmpty() else groups, tables,
        ),
    )


def build(spark: SparkSession, source: DataFrame, config: Config, out: str, by: list[str] | None = None,
          tips: DataFrame | None = None) -> None:
    """Write every result of a raw log under ``out``, with set-aside rows and the name registry."""
    by, before = by or [], staged_count()
    ck, bad = dashboard.clean(source, config.mappings, config.resolver)
    found = TR.detect(ck, by, config.settings.home_city, config.settings.min_checkins, config.settings.tables)
    tables = dashboard.results(ck, config.settings, by, tips, config.mappings.city_merge, found)
    registry = config.settings.tables.names
    if registry is None:
        registry = spark.createDataFrame([], "name_ts bigint, name string").select(
            *[F.lit(None).cast(ck.schema[c].dataType).alias(c) for c in by], "name_ts", "name")
    named = TR.named_with_icon(found, tables["trips"])
    sinks.write_gold({**tables, "quarantine": bad, "trip_names": TR.update_trip_names(registry, named, by)}, out)
    drop_staged(spark, after=before)
