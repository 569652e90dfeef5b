"""Cleaning: keyed overrides, city-name folding, nearest-centroid inference, category groups."""
from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from roamlog.functions import scalars as S
from roamlog.session import stage

TEXT_COLUMNS = [
    "venue", "venue_id", "city", "state", "country", "neighborhood", "address", "category",
    "with_name", "with_id", "created_by_name", "created_by_id", "overlaps_name", "overlaps_id", "checkin_id",
]


@dataclass(frozen=True)
class Mappings:
    """Lookup tables ``(key, value)``; any may be absent. Small ones are broadcast by size."""

    country_fixes: DataFrame | None = None
    city_fixes: DataFrame | None = None
    city_merge: DataFrame | None = None


@dataclass(frozen=True)
class Resolver:
    """Blank-city tables: exact times ``(key, value)`` and ``(country, lat, lng, city, seq)``."""

    times: DataFrame
    centroids: DataFrame
    max_km: float = 90.0


def typed(raw: DataFrame) -> DataFrame:
    """Text columns stripped, ``ts``, ``lat`` and ``lng`` parsed (NULL when unusable)."""
    have = set(raw.columns)
    return raw.withColumns(
        {
            **{c: S.text(F.col(c)) for c in TEXT_COLUMNS if c in have},
            "ts": S.to_long(F.col("date")),
            "lat": S.to_coord(F.col("lat")),
            "lng": S.to_coord(F.col("lng")),
        }
    )


def overlaps_state(c: Column) -> Column:
    return F.when(S.text(c) == "", "unchecked").when(S.text(c) == "-", "none").otherwise("some")


def _lookup_join(df: DataFrame, table: DataFrame | None, key: Column, out: str, by: list[str] | None = None) -> DataFrame:
    """``out`` = mapped value of ``key`` or NULL, per log if the table has the columns ``by``.

    Spark broadcasts the table when its size allows. Rows without a key get one that no table has,
    spread by a hash, so that a shuffle does not gather them in one partition.
    """
    if table is None:
        return df.withColumn(out, F.lit(None).cast("string"))
    by = by or []
    none = F.concat(F.lit("\x00"), F.xxhash64(*[F.col(c) for c in ("date", "venue_id", "city") if c in df.columns]).cast("string"))
    t = table.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("key").alias("_key"), F.col("value").alias(out))
    on = F.col("_lk") == F.col("_key")
    for c in by:
        on = on & (F.col(c) == F.col(f"_by_{c}"))
    return df.withColumn("_lk", F.coalesce(key, none)).join(t, on, "left").drop("_lk", "_key", *[f"_by_{c}" for c in by])


def _by_date(df: DataFrame, tables: dict[str, DataFrame | None], by: list[str] | None = None) -> DataFrame:
    """One column per table keyed by time, its value or NULL. The tables are laid side by side, so the rows are joined once."""
    by, present = by or [], {n: t for n, t in tables.items() if t is not None}
    if present:
        each = [t.select(*by, "key", F.lit(n).alias("_which"), F.col("value").cast("string").alias("value")) for n, t in present.items()]
        wide = reduce(DataFrame.unionByName, each).groupBy(*by, "key").agg(*[
            F.max(F.when(F.col("_which") == n, F.col("value"))).alias(n) for n in present])
        held = wide.select(*by, "key", F.struct(*present).alias("value"))
        df = _lookup_join(df, held, S.py_strip(F.col("date")), "_held", by)
        df = df.withColumns({n: F.col(f"_held.{n}") for n in present}).drop("_held")
    return df.withColumns({n: F.lit(None).cast("string") for n, t in tables.items() if t is None})


def fix_country(df: DataFrame, fixes: DataFrame | None, by: list[str] | None = None) -> DataFrame:
    """Country override by time (``key``, ``value``), within the log that ``by`` names."""
    j = _lookup_join(df, fixes, S.py_strip(F.col("date")), "_fix", by)
    return j.withColumn("country", F.coalesce("_fix", "country")).drop("_fix")


def fix_city(df: DataFrame, fixes: DataFrame | None, by: list[str] | None = None) -> DataFrame:
    """City override by time; ``city_fixed`` marks rows that skip every later city step."""
    j = _lookup_join(df, fixes, S.py_strip(F.col("date")), "_fix", by)
    return j.withColumns({"city_fixed": F.col("_fix").isNotNull(), "city": F.coalesce("_fix", "city")}).drop("_fix")


def fold_apostrophes(c: Column) -> Column:
    return F.translate(c, "‘’", "''")


def merge_city(df: DataFrame, merge: DataFrame | None, unless: Column | None = None) -> DataFrame:
    """One lookup of the folded name, then of the raw name; chains are not followed."""
    if merge is None:
        return df
    raw = F.col("city") if unless is None else F.when(~unless, F.col("city"))
    j = _lookup_join(df, merge, fold_apostrophes(raw), "_folded")
    j = _lookup_join(j, merge, F.when(F.col("_folded").isNull(), raw), "_raw")
    return j.withColumn("city", F.coalesce("_folded", "_raw", "city")).drop("_folded", "_raw")


def _cells(max_km: float) -> tuple[float, Column]:
    """Grid whose cells are at least ``max_km`` wide: latitude step and columns per band."""
    reach = math.degrees(max_km / S.EARTH_RADIUS_KM) * (1 + 1e-9)
    half = math.sin(math.radians(reach) / 2)
    edge = F.least(F.lit(90.0), F.greatest(F.abs((F.col("_band") - 1) * reach), F.abs((F.col("_band") + 2) * reach)))
    ratio = half / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12))
    width = F.when(ratio >= 1, F.lit(360.0)).otherwise(F.degrees(2 * F.asin(F.least(ratio, F.lit(1.0)))) * (1 + 1e-9))
    return reach, F.greatest(F.lit(1), F.floor(360 / width)).cast("int")


def nearest(points: DataFrame, centroids: DataFrame, max_km: float = 90.0) -> DataFrame:
    """Nearest centroid of the same country within ``max_km`` for ``(country, lat, lng)`` points.

    Centroids are copied to the neighbouring cells of a grid, so the join is an equality on
    country and cell and a point meets only the centroids around it, in any country however
    full. Equal distances go to the lower ``seq``. Adds ``city`` and ``km``.
    """
    step, columns = _cells(max_km)
    turn = F.pmod(F.col("lng") + 180, F.lit(360.0)) / 360
    placed = points.withColumn("_band", F.floor(F.col("lat") / step).cast("int"))
    placed = placed.withColumn("_cols", columns).withColumn(
        "_cell", F.least(F.floor(turn * F.col("_cols")), F.col("_cols") - 1).cast("int")
    )
    spread = centroids.withColumn(
        "_band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)),
                                       lambda d: (F.floor(F.col("lat") / step) + d).cast("int")))
    ).withColumn("_cols", columns).withColumn(
        "_at", F.least(F.floor(turn * F.col("_cols")), F.col("_cols") - 1).cast("int")
    ).withColumn(
        "_cell", F.explode(F.array_distinct(F.transform(
            F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(F.col("_at") + d, F.col("_cols")))))
    ).select("country", "_band", "_cell", F.col("lat").alias("_clat"), F.col("lng").alias("_clng"), "city", "seq")
    keys = ["country", "lat", "lng"]
    km = S.haversine_km(F.col("lat"), F.col("lng"), F.col("_clat"), F.col("_clng"))
    return (
        placed.join(spread, ["country", "_band", "_cell"])
        .withColumn("km", km).filter(F.col("km") <= max_km)
        .groupBy(*keys)
        .agg(F.min_by(F.struct("city", "km"), F.struct("km", "seq")).alias("_b"))
        .select(*keys, "_b.city", "_b.km")
    )


def infer_city(df: DataFrame, resolver: Resolver, by: list[str] | None = None) -> DataFrame:
    """Fill blank cities: exact time first, else the nearest centroid (on distinct points)."""
    return _filled(_by_date(df, {"_by_time": resolver.times}, by), resolver)


def _filled(df: DataFrame, resolver: Resolver) -> DataFrame:
    """Blank cities from the column ``_by_time``, else from the nearest centroid."""
    blank = (F.col("city") == "") & ~F.col("city_fixed")
    need = blank & F.col("_by_time").isNull() & F.col("lat").isNotNull() & F.col("lng").isNotNull()
    points = df.filter(need).select("country", "lat", "lng").distinct()
    # Staged, so that the join with all rows is planned with the size of the answer known.
    found = stage(nearest(points, resolver.centroids, resolver.max_km).select(
        F.col("country").alias("_c"), F.col("lat").alias("_la"), F.col("lng").alias("_ln"), F.col("city").alias("_near")
    ), "inferred")
    on = need & (F.col("country") == F.col("_c")) & (F.col("lat") == F.col("_la")) & (F.col("lng") == F.col("_ln"))
    return (
        df.join(found, on, "left")
        .withColumn("city", F.when(blank, F.coalesce("_by_time", "_near", "city")).otherwise(F.col("city")))
        .drop("_by_time", "_near", "_c", "_la", "_ln")
    )


def clean_checkins(raw: DataFrame, mappings: Mappings, resolver: Resolver | None = None, by: list[str] | None = None) -> DataFrame:
    """All cleaning steps in order over raw text rows; keeps undated rows (see :func:`quarantine`).

    With ``by``, the tables keyed by time have these columns too, and apply to their own log.
    """
    tables = {"_country": mappings.country_fixes, "_city": mappings.city_fixes}
    if resolver is not None:
        tables["_by_time"] = resolver.times
    df = _by_date(typed(raw), tables, by).withColumns({
        "country": F.coalesce("_country", "country"), "city_fixed": F.col("_city").isNotNull(), "city": F.coalesce("_city", "city"),
    }).drop("_country", "_city")
    if resolver is not None:
        df = _filled(df, resolver)
    return merge_city(df, mappings.city_merge, unless=F.col("city_fixed")).drop("city_fixed")


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a usable time, and rows whose non-blank time is not a number."""
    text = S.text(F.col("date"))
    bad = (text != "") & S.to_long(F.col("date")).isNull()
    return df.filter(~bad), df.filter(bad)


def keywords(groups: dict[str, list[str]]) -> list[tuple[str, str]]:
    """Ordered ``(keyword, group)`` of a group -> keywords configuration.

    A keyword listed twice keeps its first place and its last group, as a dictionary would.
    """
    flat: dict[str, str] = {}
    for group, words in groups.items():
        flat.update({w.lower(): group for w in words})
    return list(flat.items())


def group_of(category: Column, groups: dict[str, list[str]]) -> Column:
    """Group of a category: exact keyword, else the first keyword that contains it or is in it.

    The configured list becomes one constant array, so a category is compared with the
    keywords where it is, without a join. Apply it to distinct categories.
    """
    flat = keywords(groups)
    if not flat:
        return F.lit(None).cast("string")
    low = F.lower(category)
    exact = S.lookup(dict(flat), low)
    table = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(g).alias("g")) for w, g in flat])
    loose = F.filter(table, lambda x: low.contains(x["w"]) | x["w"].contains(low))
    return F.coalesce(exact, F.try_element_at(loose, F.lit(1))["g"])


def categorize(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Adds ``category_group``; each distinct category is matched once and joined back.

    The matched list is staged, so its size is known when the join with all rows is planned:
    a small one is broadcast and the rows stay where they are.
    """
    kinds = df.filter("category <> ''").select("category").distinct()
    matched = stage(kinds.withColumn("category_group", group_of(F.col("category"), groups)), "categories")
    return df.join(matched, "category", "left")


def category_icons(df: DataFrame, icons: DataFrame) -> DataFrame:
    """Adds the columns of a supplied ``(category, ...)`` icon table; NULL where it has none."""
    return df.join(icons, "category", "left")


def norm_country(df: DataFrame, col: str = "country", out: str = "nc") -> DataFrame:
    """English country name for a local one; others are kept."""
    from roamlog import fixed

    c = F.coalesce(F.col(col), F.lit(""))
    return df.withColumn(out, S.lookup(fixed.COUNTRY_ENGLISH, c, c))


def norm_tip_city(df: DataFrame, merge: DataFrame | None, col: str = "city", out: str = "nci") -> DataFrame:
    """Raw lookup only (no apostrophe folding)."""
    j = _lookup_join(df, merge, F.col(col), "_m")
    return j.withColumn(out, F.coalesce("_m", col, F.lit(""))).drop("_m")
