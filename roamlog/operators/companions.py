"""People met on check-ins: counts, feeds, ids and profiles."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from roamlog.functions import scalars as S
from roamlog.session import stage
from roamlog.operators.common import top_k, utc_date, when_seen
from roamlog.operators.counters import list_order
from roamlog.operators.ordered import DAY, Desc, chunk_of, numbered


def companion_names() -> Column:
    """Names on one row: every "with" entry, then the creator, then overlaps not yet named."""
    named = S.split_list(F.col("with_name"))
    creator = F.filter(F.array(S.text(F.col("created_by_name"))), lambda x: (x != "") & ~F.array_contains(named, x))
    overlaps = F.filter(S.split_list(F.col("overlaps_name")), lambda x: x != "-")
    return F.concat(named, creator, F.array_except(overlaps, F.concat(named, creator)))


def companions(ck: DataFrame, by: list[str] | None = None, k: int = 30) -> DataFrame:
    by = by or []
    counts = (
        ck.select(*by, "ts", F.explode(companion_names()).alias("name"))
        .groupBy(*by, "name").agg(F.count("*").alias("n"), F.min(when_seen()).alias("first_ts"))
    )
    return top_k(counts, by, list_order(), k)


def companion_ids(ck: DataFrame, by: list[str] | None = None) -> DataFrame:
    """First id seen for each name, from the paired name and id lists."""
    by = by or []

    def pairs(names: Column, ids: Column) -> Column:
        zipped = F.transform(
            F.arrays_zip(names.alias("a"), ids.alias("b")),
            lambda x: F.struct(x["a"].alias("name"), x["b"].alias("id")),
        )
        return F.filter(zipped, lambda x: x["name"].isNotNull() & x["id"].isNotNull())

    creator = F.array(F.struct(S.text(F.col("created_by_name")).alias("name"), S.text(F.col("created_by_id")).alias("id")))
    every = F.concat(
        pairs(S.split_list(F.col("with_name")), S.split_list(F.col("with_id"))),
        F.filter(creator, lambda x: (x["name"] != "") & (x["id"] != "")),
        pairs(S.split_list(F.col("overlaps_name")), S.split_list(F.col("overlaps_id"))),
    )
    # First by time, then by place in the row; undated rows come last.
    seen = F.struct(F.coalesce(F.col("ts"), F.lit(1 << 40)).alias("ts"), F.col("slot"))
    return (
        ck.select(*by, "ts", F.posexplode(every).alias("slot", "p"))
        .filter("p.name <> '-'")
        .groupBy(*by, F.col("p.name").alias("name"), F.col("p.id").alias("id")).agg(F.min(seen).alias("_o"))
        .groupBy(*by, "name").agg(F.min_by("id", F.struct("_o", "id")).alias("id"))
    )


def companion_feed(ck: DataFrame, by: list[str] | None = None, k: int = 30) -> DataFrame:
    """Check-ins of the top companions, newest first (``pos``), with total and id."""
    by = by or []
    top = companions(ck, by, k).select(*by, "name", F.col("n").alias("total"))
    ids = companion_ids(ck, by)
    rows = ck.filter(F.col("ts").isNotNull()).select(
        *by, "ts", "checkin_id", "venue", "city", "country", "category", "venue_id",
        F.explode(companion_names()).alias("name"),
    )
    # Staged, so that the one join with all rows is planned with the size of the list known.
    head = stage(top.join(ids, [*by, "name"], "left").withColumn("id", F.coalesce("id", F.lit(""))), "companions")
    feed = rows.join(head, [*by, "name"])
    at = F.timestamp_seconds("ts")
    return numbered(
        feed, [*by, "name"], [Desc(chunk_of(F.col("ts")))], [F.desc("ts"), F.desc("checkin_id")], "pos"
    ).select(
        *by, "name", "total", "id", "pos", "ts", S.fmt_day(at).alias("date"), S.fmt_time(at).alias("time"),
        "checkin_id", "venue", "city", "country", "category", "venue_id",
    )


def companion_profile(feed: DataFrame, by: list[str] | None = None, overrides: dict[str, str] | None = None,
                      k: int = 4) -> DataFrame:
    """Top places of each companion and the country whose flag is shown."""
    keys = [*(by or []), "name"]
    place = F.when(F.col("city") != "", F.col("city")).otherwise(F.col("country"))
    counts = feed.groupBy(*keys, place.alias("place")).agg(F.count("*").alias("n"), F.min("pos").alias("_p"))
    top = top_k(counts, keys, [F.desc("n"), F.asc("_p")], k)
    places = top.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "_p", "place"))).alias("_l")
    )
    # Newest country per name, from a count per (name, country) rather than from rows.
    newest = (
        feed.filter("country <> ''").groupBy(*keys, "country").agg(F.min("pos").alias("_p"))
        .groupBy(*keys).agg(F.min_by("country", "_p").alias("_c"))
    )
    country = F.col("_c") if not overrides else F.coalesce(S.lookup(overrides, F.col("name")), "_c")
    return places.join(newest, keys, "left").select(
        *keys, F.concat_ws(" · ", F.transform("_l", lambda x: x["place"])).alias("places"),
        F.coalesce(country, F.lit("")).alias("country"),
        S.flag(country).alias("flag"),
    )
