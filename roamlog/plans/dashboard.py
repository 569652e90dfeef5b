"""The full result set over one cleaned log: clean once, stage, then independent results."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from roamlog.operators import companions as P, counters as C, feed as FD, places as V, tips as T
from roamlog.operators.cleaning import Mappings, Resolver, clean_checkins, quarantine
from roamlog.plans import trips as TR
from roamlog.session import stage


@dataclass(frozen=True)
class Settings:
    home_city: str
    min_checkins: int = 5
    category_groups: dict[str, list[str]] = field(default_factory=dict)
    explorer_groups: DataFrame | None = None
    tables: TR.TripTables = field(default_factory=TR.TripTables)


def clean(raw: DataFrame, mappings: Mappings, resolver: Resolver | None = None) -> tuple[DataFrame, DataFrame]:
    """Cleaned log, written once in the shared folder, and the rows set aside for a bad time.

    Every result reads the staged columns it needs; none repeats the cleaning joins.
    """
    good, bad = quarantine(raw)
    return stage(clean_checkins(good, mappings, resolver), "checkins"), bad


def results(ck: DataFrame, s: Settings, by: list[str] | None = None, tips: DataFrame | None = None,
            city_merge: DataFrame | None = None, found: TR.Trips | None = None) -> dict[str, DataFrame]:
    """Named result tables of a cleaned log. Each is its own plan over ``ck``."""
    by = by or []
    found = found or TR.detect(ck, by, s.home_city, s.min_checkins, s.tables)
    summary = TR.trip_summary(found)
    feed = FD.feed(ck, by)
    companion_feed = P.companion_feed(ck, by)
    cities, countries = C.cities(ck, by), C.countries(ck, by)
    country_centroids = C.country_centroids(ck, by)
    out = {
        "summary": C.summary(ck, by),
        "trips_count": found.intervals.groupBy(*by).agg(F.count("*").alias("n")),
        "by_year": C.by_year(ck, by),
        "by_month": C.by_month(ck, by),
        "by_hour": C.by_hour(ck, by),
        "by_dow": C.by_dow(ck, by),
        "countries": countries,
        "countries_by_venues": C.countries_by_venues(ck, by),
        "cities": cities,
        "cities_by_venues": C.cities_by_venues(ck, by),
        "by_country": C.by_country(cities, countries, by),
        "city_centroids": C.city_centroids(ck, by),
        "country_centroids": country_centroids,
        "country_markers": C.country_markers(country_centroids, by),
        "venues": V.top_venues(ck, by),
        "venues_page": V.venues_page(ck, by),
        "unique_places": V.unique_places(ck, by),
        "all_coords": C.all_coords(ck, by),
        "venues_heatmap": V.venue_heatmap(ck, by),
        "companions": P.companions(ck, by),
        "companion_feed": companion_feed,
        "companion_profile": P.companion_profile(companion_feed, by),
        "heatmap": C.day_heatmap(ck, by),
        "discovery_rate": C.discovery_rate(ck, by),
        "venue_loyalty": V.venue_loyalty(ck, by),
        "timeline": TR.timeline(summary, by),
        "trips": summary,
        "trip_checkins": TR.trip_checkins(found),
        "trip_categories": TR.trip_categories(found),
        "trip_unique_points": TR.trip_unique_points(found),
        "recent": FD.recent(ck, by),
        "feed": feed,
        "month_index": FD.month_index(feed, by),
    }
    if s.category_groups:
        out["category_groups"] = C.category_groups(ck, s.category_groups, by)
    if s.explorer_groups is not None:
        out["explorer"] = V.category_explorer(ck, s.explorer_groups, by)
    if tips is not None:
        norm = T.normalised(tips, city_merge)
        out["tips"] = norm
        out["tips_tabs"] = T.tips_tabs(norm)
        out["tips_recent"] = T.tips_recent(norm)
    return out
