"""Venues, explorer groups, unique places, world cities."""
from __future__ import annotations

from pyspark.sql import functions as F

from roamlog import fixed
from roamlog.catalog import query
from roamlog.catalog.views import ck, world
from roamlog.operators import cleaning, counters as C, filters, places as P, world as W
from roamlog.sources import fixtures as X

U = ["user_id"]

_FIRST = """fst AS (
  SELECT venue_id, venue AS name, city FROM (
    SELECT venue_id, venue, city, row_number() OVER (PARTITION BY venue_id ORDER BY ts, venue, city) AS r
    FROM c WHERE venue_id <> '' AND venue <> '') WHERE r = 1
), vc AS (
  SELECT venue_id, name, city, n, first_ts FROM fst JOIN (
    SELECT venue_id, count(*) AS n, min(ts) AS first_ts FROM c WHERE venue_id <> '' AND venue <> '' GROUP BY 1) USING (venue_id)
)"""


@query("top_venues", ck(
    "SELECT venue_id, n, first_ts, name, city FROM vc ORDER BY n DESC, first_ts, name, venue_id LIMIT 20", extra=_FIRST))
def _(spark, sf):
    return P.top_venues(X.checkins(spark, sf), k=20)


@query("top_venues_by_user", ck("""
SELECT user_id, venue_id, n, first_ts, name, city FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_ts, name, venue_id) AS r FROM (
    SELECT user_id, venue_id, count(*) AS n, min(ts) AS first_ts, arg_min(venue, ts) AS name, arg_min(city, ts) AS city
    FROM c WHERE venue_id <> '' AND venue <> '' GROUP BY 1, 2)) WHERE r <= 5"""))
def _(spark, sf):
    return P.top_venues(X.checkins(spark, sf), U, k=5)


@query("venues_page", ck("""
SELECT venue_id, n, name, city, country, category, years, first_ts FROM (
  SELECT venue_id, count(*) AS n, min(ts) AS first_ts, array_to_string(list_sort(list(DISTINCT year(t))), ' | ') AS years
  FROM c WHERE venue_id <> '' AND venue <> '' GROUP BY 1) JOIN (
  SELECT venue_id, venue AS name, city, country, category FROM (
    SELECT *, row_number() OVER (PARTITION BY venue_id ORDER BY ts DESC, venue DESC, city DESC, country DESC, category DESC) AS r
    FROM c WHERE venue_id <> '' AND venue <> '') WHERE r = 1) USING (venue_id)
ORDER BY n DESC, first_ts, name, venue_id LIMIT 500""", years=5))
def _(spark, sf):
    return P.sort_venues(P.venues_page(X.checkins(spark, sf, years=5)), "years")


@query("venue_loyalty", ck("""
SELECT venue_id, name, city, years, n, first_ts FROM (
  SELECT venue_id, count(*) AS n, min(ts) AS first_ts, len(list(DISTINCT year(t))) AS ny,
    array_to_string(list_sort(list(DISTINCT year(t))), ' | ') AS years FROM c WHERE venue_id <> '' GROUP BY 1) JOIN fst USING (venue_id)
WHERE ny >= 3 ORDER BY ny DESC, n DESC, first_ts, name, venue_id LIMIT 100""", years=5, extra=_FIRST))
def _(spark, sf):
    return P.venue_loyalty(X.checkins(spark, sf, years=5))


@query("venue_loyalty_by_user", ck("""
SELECT user_id, venue_id, name, city, years, n, first_ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ny DESC, n DESC, first_ts, name, venue_id) AS r FROM (
    SELECT user_id, venue_id, count(*) AS n, min(ts) AS first_ts, arg_min(venue, ts) AS name, arg_min(city, ts) AS city,
      len(list(DISTINCT year(t))) AS ny, array_to_string(list_sort(list(DISTINCT year(t))), ' | ') AS years
    FROM c WHERE venue_id <> '' GROUP BY 1, 2) WHERE ny >= 2) WHERE r <= 100""", years=5))
def _(spark, sf):
    return P.venue_loyalty(X.checkins(spark, sf, years=5), U, min_years=2)


# Category groups of the example queries.
GROUPS = {
    "Travel": ["airport", "station", "bus"],
    "Home": ["Home (private)", "neighborhood area"],
    "Going out": ["Pub", "Coffee Shop", "Bar"],
    "Outdoors": ["Park", "Road and Rail"],
}
_GROUP_CASE = """CASE
  WHEN lower(category) IN ('airport') THEN 'Travel' WHEN lower(category) = 'home (private)' THEN 'Home'
  WHEN lower(category) IN ('pub', 'coffee shop') THEN 'Going out' WHEN lower(category) = 'park' THEN 'Outdoors'
  WHEN contains(lower(category), 'station') OR contains(lower(category), 'bus') THEN 'Travel'
  WHEN contains('neighborhood area', lower(category)) THEN 'Home'
  WHEN contains('road and rail', lower(category)) THEN 'Outdoors' END"""


@query("category_groups", ck(f"""
SELECT g AS "group", count(*) AS n, min(ts) AS first_ts FROM (SELECT *, {_GROUP_CASE} AS g FROM c WHERE category <> '') WHERE g IS NOT NULL GROUP BY 1"""))
def _(spark, sf):
    return C.category_groups(X.checkins(spark, sf), GROUPS)


@query("categorize", ck(f"SELECT user_id, checkin_id, category, {_GROUP_CASE} AS category_group FROM c"))
def _(spark, sf):
    view = X.checkins(spark, sf).select("user_id", "checkin_id", "category")
    return cleaning.categorize(view, GROUPS)


# Display groups of the example query, as (category, group, group_ord, cat_ord).
EXPLORER = [
    ("Rail Station", "Trains", 0, 0), ("Airport", "Planes", 1, 0), ("Pub", "Drinks", 2, 0), ("Coffee Shop", "Drinks", 2, 1),
    ("Airport", "Transport", 3, 0), ("Rail Station", "Transport", 3, 1), ("Bus Station", "Transport", 3, 2),
    ("Zoo", "Animals", 4, 0),
]
_EXPLORER_VALUES = ", ".join(f"('{c}', '{g}', {go}, {co})" for c, g, go, co in EXPLORER)


@query("category_explorer", ck(f"""
SELECT "group", CAST(group_ord AS BIGINT) AS group_ord, venue_id, name, city, n FROM (
  SELECT g.grp AS "group", g.group_ord, venue_id, count(*) AS n, row_number() OVER (
      PARTITION BY g.grp ORDER BY count(*) DESC, min((g.cat_ord, ts, venue, city)), venue_id) AS r,
    arg_min(venue, (g.cat_ord, ts, venue, city)) AS name, arg_min(city, (g.cat_ord, ts, venue, city)) AS city
  FROM c JOIN (VALUES {_EXPLORER_VALUES}) g(category, grp, group_ord, cat_ord) ON g.category = c.category
  WHERE venue_id <> '' AND venue <> '' GROUP BY 1, 2, 3) WHERE r <= 10"""))
def _(spark, sf):
    groups = spark.createDataFrame(EXPLORER, "category string, group string, group_ord int, cat_ord int")
    return P.category_explorer(X.checkins(spark, sf), groups, k=10)


@query("unique_places", ck("""
SELECT lat, lng, venue FROM (SELECT round(lat,5) AS lat, round(lng,5) AS lng, venue,
    row_number() OVER (PARTITION BY venue_id ORDER BY ts, lat, lng, venue) AS r FROM c WHERE venue_id <> '') WHERE r = 1
UNION ALL
SELECT lat, lng, venue FROM (SELECT round(lat,5) AS lat, round(lng,5) AS lng, venue,
    row_number() OVER (PARTITION BY round(lat,5), round(lng,5) ORDER BY ts, venue) AS r FROM c WHERE venue_id = '') WHERE r = 1"""))
def _(spark, sf):
    return P.unique_places(X.checkins(spark, sf))


@query("unique_places_count", ck("""
SELECT count(DISTINCT nullif(venue_id,'')) + count(DISTINCT CASE WHEN venue_id='' THEN (round(lat,5), round(lng,5)) END) AS n FROM c"""))
def _(spark, sf):
    return P.unique_places_count(X.checkins(spark, sf))


@query("venue_heatmap", ck("""
SELECT venue_id, lat, lng, round(ln(1 + n) / ln(1 + max(n) OVER ()), 4) AS weight FROM (
  SELECT venue_id, count(*) AS n, arg_min(lat, ts) AS lat, arg_min(lng, ts) AS lng FROM c WHERE venue_id <> '' GROUP BY 1)"""))
def _(spark, sf):
    return P.venue_heatmap(X.checkins(spark, sf))


@query("venue_heatmap_by_user", ck("""
SELECT user_id, venue_id, lat, lng, round(ln(1 + n) / ln(1 + max(n) OVER (PARTITION BY user_id)), 4) AS weight FROM (
  SELECT user_id, venue_id, count(*) AS n, arg_min(lat, ts) AS lat, arg_min(lng, ts) AS lng FROM c WHERE venue_id <> '' GROUP BY 1, 2)"""))
def _(spark, sf):
    return P.venue_heatmap(X.checkins(spark, sf), U)


@query("venue_ids", ck("SELECT venue_id, min(ts) AS first_ts FROM c WHERE venue_id <> '' GROUP BY 1"))
def _(spark, sf):
    return P.venue_ids(X.checkins(spark, sf))


@query("latest_by_venue", ck("""
SELECT venue_id, checkin_id, ts, city, category FROM (
  SELECT *, row_number() OVER (PARTITION BY venue_id ORDER BY ts DESC, checkin_id) AS r FROM c WHERE venue_id <> '') WHERE r = 1"""))
def _(spark, sf):
    return P.latest_by_venue(X.checkins(spark, sf)).select("venue_id", "checkin_id", "ts", "city", "category")


@query("search_venues", ck(
    "SELECT venue_id, n, first_ts, name, city FROM vc WHERE lower(name) LIKE '%e 3%' OR lower(city) LIKE '%e 3%'", extra=_FIRST))
def _(spark, sf):
    return filters.search(P.venue_counts(X.checkins(spark, sf)), ["name", "city"], "E 3")


_ALIASES = {"Old City 12": ["City 13", "City 3"], "Old City 13": ["City 3", "HOME"], "Old City 15": ["HOME"]}
_CONTINENTS = {"NATION_3": "EU", "NATION_8": "AS", "NATION_13": "SA", "NATION_7": "EU"}
_MATCH = """vis AS (
  SELECT city AS v, count(*) AS n, min(ts) AS f FROM c WHERE city <> '' GROUP BY 1
), visp AS (
  SELECT v, n, (SELECT country FROM c x WHERE x.city = vis.v AND x.country <> '' GROUP BY country ORDER BY count(*) DESC, min(ts), country LIMIT 1) AS pc FROM vis
), vk AS (
  SELECT v, n, CASE pc WHEN 'NATION_3' THEN 'EU' WHEN 'NATION_8' THEN 'AS' WHEN 'NATION_13' THEN 'SA' WHEN 'NATION_7' THEN 'EU' END AS known FROM visp
), al AS (
  SELECT name, continent, name AS other, 0 AS p FROM world
  UNION ALL SELECT w.name, w.continent, a.other, a.p FROM world w JOIN (VALUES
    ('Old City 12','City 13',1), ('Old City 12','City 3',2), ('Old City 13','City 3',1), ('Old City 13','HOME',2), ('Old City 15','HOME',1)) a(name, other, p) ON a.name = w.name
), best AS (
  SELECT al.name, al.continent, arg_min(vk.v, (p, vk.v)) AS v, arg_min(vk.n, (p, vk.v)) AS n
  FROM al JOIN vk ON {cmp} WHERE vk.known IS NULL OR vk.known = al.continent GROUP BY 1, 2
), matched AS (
  SELECT w.name, w.lat, w.lng, w.pop_m, w.continent, b.name IS NOT NULL AS visited, coalesce(b.n, 0) AS n, coalesce(b.v, w.name) AS display_name,
    CASE WHEN w.pop_m >= 1 THEN printf('%.1f', w.pop_m) || 'M' ELSE CAST(CAST(floor(w.pop_m * 1000 + 0.5) AS BIGINT) AS VARCHAR) || 'K' END AS population
  FROM world w LEFT JOIN best b ON b.name = w.name AND b.continent = w.continent
)"""
_FOLDED = _MATCH.replace("{cmp}", "lower(al.other) = lower(vk.v)")
_EXACT = _MATCH.replace("{cmp}", "al.other = vk.v")


def _matched(spark, sf, ignore_case=True):
    return W.match_world_cities(
        X.world_cities(spark, sf), C.cities(X.checkins(spark, sf)), W.alias_table(spark, _ALIASES),
        W.continent_table(spark, _CONTINENTS), ignore_case)


@query("match_world_cities", world("SELECT * FROM matched", _FOLDED))
def _(spark, sf):
    return _matched(spark, sf)


@query("match_world_cities_exact_case", world("SELECT * FROM matched", _EXACT))
def _(spark, sf):
    return _matched(spark, sf, ignore_case=False)


@query("world_coverage", world(
    "SELECT continent, count(*) FILTER (visited) AS visited, count(*) AS total FROM matched GROUP BY 1", _FOLDED))
def _(spark, sf):
    return W.world_coverage(_matched(spark, sf))


@query("visited_world_cities", world("""
SELECT * FROM matched WHERE visited AND (lower(name) LIKE '%o%' OR lower(display_name) LIKE '%o%' OR lower(
  CASE continent WHEN 'AS' THEN 'Asia' WHEN 'EU' THEN 'Europe' WHEN 'NA' THEN 'North America' WHEN 'SA' THEN 'South America' WHEN 'AF' THEN 'Africa' WHEN 'OC' THEN 'Oceania' END) LIKE '%o%')""", _FOLDED))
def _(spark, sf):
    return filters.search_world(filters.filter_by(_matched(spark, sf), visited=True), "O")


@query("add_population", world("""
SELECT name, n, first_ts, pop_m, CASE WHEN pop_m IS NULL THEN '' WHEN pop_m >= 1 THEN printf('%.1f', pop_m) || 'M'
    ELSE CAST(CAST(floor(pop_m * 1000 + 0.5) AS BIGINT) AS VARCHAR) || 'K' END AS population
FROM (SELECT name, n, first_ts, coalesce(p, -1) AS pm, p AS pop_m FROM
  (SELECT city AS name, count(*) AS n, min(ts) AS first_ts FROM c WHERE city <> '' GROUP BY 1) v
  LEFT JOIN (SELECT lower(name) AS k, max(pop_m) AS p FROM world GROUP BY 1) w ON w.k = lower(v.name)) WHERE pop_m IS NOT NULL"""))
def _(spark, sf):
    cities = C.cities(X.checkins(spark, sf)).drop("primary_country")
    return W.add_population(cities, X.world_cities(spark, sf)).filter("pop_m IS NOT NULL")
