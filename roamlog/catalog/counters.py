"""Counts by time and place."""
from __future__ import annotations

from pyspark.sql import functions as F

from roamlog.catalog import query
from roamlog.catalog.views import ck
from roamlog.operators import counters as C, filters
from roamlog.sources import fixtures as X, sinks

U = ["user_id"]


@query("summary", ck("""
SELECT count(*) AS total, CAST(min(d) AS VARCHAR) AS date_min, CAST(max(d) AS VARCHAR) AS date_max,
  count(DISTINCT nullif(country,'')) AS countries, count(DISTINCT nullif(city,'')) AS cities,
  count(DISTINCT nullif(venue_id,'')) + count(DISTINCT CASE WHEN venue_id='' THEN (round(lat,5), round(lng,5)) END) AS unique_places
FROM c"""))
def _(spark, sf):
    return C.summary(X.checkins(spark, sf))


@query("summary_by_user", ck("""
SELECT user_id, count(*) AS total, CAST(min(d) AS VARCHAR) AS date_min, CAST(max(d) AS VARCHAR) AS date_max,
  count(DISTINCT nullif(country,'')) AS countries, count(DISTINCT nullif(city,'')) AS cities,
  count(DISTINCT nullif(venue_id,'')) + count(DISTINCT CASE WHEN venue_id='' THEN (round(lat,5), round(lng,5)) END) AS unique_places
FROM c GROUP BY user_id"""))
def _(spark, sf):
    return C.summary(X.checkins(spark, sf), U)


@query("by_year", ck("SELECT year(t) AS year, count(*) AS n FROM c GROUP BY 1", years=5))
def _(spark, sf):
    return C.by_year(X.checkins(spark, sf, years=5))


@query("by_month", ck("SELECT strftime(t, '%Y-%m') AS month, count(*) AS n FROM c GROUP BY 1", years=5))
def _(spark, sf):
    return C.by_month(X.checkins(spark, sf, years=5))


@query("by_hour", ck("SELECT hour(t) AS hour, count(*) AS n FROM c GROUP BY 1"))
def _(spark, sf):
    return C.by_hour(X.checkins(spark, sf))


@query("by_dow", ck("SELECT isodow(t) - 1 AS dow, count(*) AS n FROM c GROUP BY 1"))
def _(spark, sf):
    return C.by_dow(X.checkins(spark, sf))


@query("countries", ck("SELECT country AS name, count(*) AS n, min(ts) AS first_ts FROM c WHERE country <> '' GROUP BY 1"))
def _(spark, sf):
    return C.countries(X.checkins(spark, sf))


_PRIMARY = """prim AS (
  SELECT name, country AS primary_country FROM (
    SELECT city AS name, country, row_number() OVER (PARTITION BY city ORDER BY count(*) DESC, min(ts), country) AS r
    FROM c WHERE city <> '' AND country <> '' GROUP BY city, country) WHERE r = 1
)"""


@query("cities", ck("""
SELECT name, n, first_ts, primary_country FROM
 (SELECT city AS name, count(*) AS n, min(ts) AS first_ts FROM c WHERE city <> '' GROUP BY 1) JOIN prim USING (name)""",
    extra=_PRIMARY))
def _(spark, sf):
    return C.cities(X.checkins(spark, sf))


@query("cities_by_user", ck("""
SELECT user_id, city AS name, count(*) AS n, min(ts) AS first_ts,
  (SELECT country FROM c x WHERE x.user_id = c.user_id AND x.city = c.city GROUP BY country ORDER BY count(*) DESC, min(ts), country LIMIT 1) AS primary_country
FROM c WHERE city <> '' GROUP BY user_id, city"""))
def _(spark, sf):
    return C.cities(X.checkins(spark, sf), U)


@query("city_primary_country", ck("SELECT name, primary_country FROM prim", extra=_PRIMARY))
def _(spark, sf):
    return C.city_primary_country(X.checkins(spark, sf))


@query("city_centroids", ck(
    "SELECT city AS name, round(avg(lat),3) AS lat, round(avg(lng),3) AS lng FROM c WHERE city <> '' GROUP BY 1"))
def _(spark, sf):
    return C.city_centroids(X.checkins(spark, sf))


@query("country_centroids", ck("""
SELECT country AS name, round(avg(lat),3) AS lat, round(avg(lng),3) AS lng, count(*) AS n FROM c WHERE country <> '' GROUP BY 1"""))
def _(spark, sf):
    return C.country_centroids(X.checkins(spark, sf))


@query("country_markers", ck("""
SELECT *, CAST(floor(18 + sqrt(n / CAST(max(n) OVER () AS DOUBLE)) * 24 + 0.5) AS BIGINT) AS size FROM (
  SELECT country AS name, round(avg(lat),3) AS lat, round(avg(lng),3) AS lng, count(*) AS n FROM c WHERE country <> '' GROUP BY 1)"""))
def _(spark, sf):
    return C.country_markers(C.country_centroids(X.checkins(spark, sf)))


@query("countries_by_venues", ck("SELECT country AS name, count(DISTINCT place) AS n FROM c WHERE country <> '' GROUP BY 1"))
def _(spark, sf):
    return C.countries_by_venues(X.checkins(spark, sf))


@query("cities_by_venues", ck("""
SELECT name, n, coalesce(primary_country, '') AS primary_country FROM
 (SELECT city AS name, count(DISTINCT place) AS n FROM c WHERE city <> '' GROUP BY 1) LEFT JOIN prim USING (name)""",
    extra=_PRIMARY))
def _(spark, sf):
    return C.cities_by_venues(X.checkins(spark, sf))


@query("all_coords", ck("SELECT round(lat,5) AS lat, round(lng,5) AS lng FROM c"))
def _(spark, sf):
    return C.all_coords(X.checkins(spark, sf))


@query("day_heatmap", ck("""
SELECT y.year, CAST(s.d AS VARCHAR) AS day, coalesce(k.n, 0) AS n,
  CAST(CASE WHEN k.n IS NULL THEN 0 WHEN k.n <= 2 THEN 1 WHEN k.n <= 5 THEN 2 WHEN k.n <= 10 THEN 3 WHEN k.n <= 20 THEN 4 ELSE 5 END AS BIGINT) AS level,
  CAST(floor((dayofyear(s.d) - 1 + isodow(make_date(y.year, 1, 1)) - 1) / 7) AS BIGINT) AS week, isodow(s.d) - 1 AS dow
FROM (SELECT DISTINCT year(d) AS year FROM c) y,
  LATERAL (SELECT CAST(unnest(generate_series(CAST(make_date(y.year,1,1) AS TIMESTAMP), CAST(make_date(y.year,12,31) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d) s
  LEFT JOIN (SELECT d, count(*) AS n FROM c GROUP BY 1) k ON k.d = s.d""", years=5))
def _(spark, sf):
    return C.day_heatmap(X.checkins(spark, sf, years=5))


@query("discovery_rate", ck("""
SELECT strftime(t, '%Y-%m') AS month, CAST(sum(CASE WHEN r = 1 THEN 1 ELSE 0 END) AS BIGINT) AS new,
  CAST(sum(CASE WHEN r > 1 THEN 1 ELSE 0 END) AS BIGINT) AS revisit
FROM (SELECT t, row_number() OVER (PARTITION BY place ORDER BY ts, checkin_id) AS r FROM c WHERE place IS NOT NULL) GROUP BY 1""", years=5))
def _(spark, sf):
    return C.discovery_rate(X.checkins(spark, sf, years=5))


@query("discovery_rate_by_user", ck("""
SELECT user_id, strftime(t, '%Y-%m') AS month, CAST(sum(CASE WHEN r = 1 THEN 1 ELSE 0 END) AS BIGINT) AS new,
  CAST(sum(CASE WHEN r > 1 THEN 1 ELSE 0 END) AS BIGINT) AS revisit
FROM (SELECT user_id, t, row_number() OVER (PARTITION BY user_id, place ORDER BY ts, checkin_id) AS r FROM c WHERE place IS NOT NULL) GROUP BY 1, 2""", years=5))
def _(spark, sf):
    return C.discovery_rate(X.checkins(spark, sf, years=5), U)


@query("max_timestamp", ck("SELECT coalesce(max(ts), 0) AS max_ts FROM c"))
def _(spark, sf):
    return C.max_timestamp(X.checkins(spark, sf))


@query("category_list", ck("SELECT category AS name, count(*) AS n, min(ts) AS first_ts FROM c WHERE category <> '' GROUP BY 1"))
def _(spark, sf):
    return C.category_list(X.checkins(spark, sf))


@query("category_report", ck("""
SELECT value FROM (SELECT unnest(['FULL CATEGORY LIST', repeat('=', 60), 'Total unique categories: ' || CAST(count(DISTINCT category) AS VARCHAR), '']) AS value
                   FROM c WHERE category <> '')
UNION ALL
SELECT '  ' || lpad(format('{:,}', count(*)), 6, ' ') || '  ' || category FROM c WHERE category <> '' GROUP BY category"""))
def _(spark, sf):
    return sinks.category_report(X.checkins(spark, sf))


@query("by_country", ck("""
SELECT p.primary_country AS country, count(*) AS cities, any_value(o.n) AS n
FROM prim p JOIN (SELECT country, count(*) AS n FROM c WHERE country <> '' GROUP BY 1) o ON o.country = p.primary_country GROUP BY 1""",
    extra=_PRIMARY))
def _(spark, sf):
    view = X.checkins(spark, sf)
    out = C.by_country(C.cities(view), C.countries(view))
    return out.orderBy(*C.COUNTRY_SORTS["checkins"]())


@query("country_group_search", ck("""
SELECT name, n, first_ts, primary_country FROM
 (SELECT city AS name, count(*) AS n, min(ts) AS first_ts FROM c WHERE city <> '' GROUP BY 1) JOIN prim USING (name)
WHERE lower(primary_country) LIKE '%nation_1%' OR lower(name) LIKE '%nation_1%'""", extra=_PRIMARY))
def _(spark, sf):
    return filters.search_country_groups(C.cities(X.checkins(spark, sf)), "Nation_1")


@query("visited_city_map", ck("""
SELECT name, n, first_ts, primary_country, lat, lng FROM
 (SELECT city AS name, count(*) AS n, min(ts) AS first_ts, round(avg(lat),3) AS lat, round(avg(lng),3) AS lng FROM c WHERE city <> '' GROUP BY 1)
 JOIN prim USING (name) WHERE n >= 5""", extra=_PRIMARY))
def _(spark, sf):
    view = X.checkins(spark, sf)
    return filters.visited_city_map(C.cities(view), C.city_centroids(view))


@query("rank_countries", ck("""
SELECT name, n, first_ts, row_number() OVER (ORDER BY n DESC, first_ts, name) AS rank, round(n / CAST(max(n) OVER () AS DOUBLE) * 100, 1) AS pct
FROM (SELECT country AS name, count(*) AS n, min(ts) AS first_ts FROM c WHERE country <> '' GROUP BY 1)"""))
def _(spark, sf):
    return C.rank_list(C.countries(X.checkins(spark, sf)))


@query("rank_cities_by_user", ck("""
SELECT user_id, name, n, first_ts, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_ts, name) AS rank,
  round(n / CAST(max(n) OVER (PARTITION BY user_id) AS DOUBLE) * 100, 1) AS pct
FROM (SELECT user_id, city AS name, count(*) AS n, min(ts) AS first_ts FROM c WHERE city <> '' GROUP BY 1, 2)"""))
def _(spark, sf):
    return C.rank_list(C.cities(X.checkins(spark, sf), U).drop("primary_country"), U)


@query("top_cities_by_user", ck("""
SELECT user_id, name, n, first_ts FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_ts, name) AS r
 FROM (SELECT user_id, city AS name, count(*) AS n, min(ts) AS first_ts FROM c WHERE city <> '' GROUP BY 1, 2)) WHERE r <= 3"""))
def _(spark, sf):
    return C.top_list(C.cities(X.checkins(spark, sf), U).drop("primary_country"), 3, U)


@query("duplicate_rows", ck("""
SELECT user_id, checkin_id, venue_id, date FROM lg
WHERE (venue_id, date) IN (SELECT (venue_id, date) FROM lg GROUP BY venue_id, date HAVING count(*) > 1)""",
    extra="lg AS (SELECT * FROM c UNION ALL SELECT * FROM c WHERE CAST(checkin_id AS BIGINT) % 20 = 0)"))
def _(spark, sf):
    log = X.checkins(spark, sf).select("user_id", "checkin_id", "venue_id", "date")
    again = log.filter(F.col("checkin_id").cast("bigint") % 20 == 0)
    return C.duplicate_rows(log.unionAll(again), ["venue_id", "date"])


@query("duplicate_rows_by_place", ck("""
SELECT user_id, checkin_id, venue_id, country FROM c
WHERE (user_id, venue_id) IN (SELECT (user_id, venue_id) FROM c GROUP BY user_id, venue_id HAVING count(*) > 1)"""))
def _(spark, sf):
    view = X.checkins(spark, sf).select("user_id", "checkin_id", "venue_id", "country")
    return C.duplicate_rows(view, ["user_id", "venue_id"])


@query("duplicate_key_count", ck("""
SELECT count(*) AS keys FROM (SELECT user_id, venue_id FROM c GROUP BY 1, 2 HAVING count(*) > 1)"""))
def _(spark, sf):
    return C.duplicate_key_count(X.checkins(spark, sf), ["user_id", "venue_id"])


@query("search_checkins", ck("""
SELECT user_id, checkin_id, venue, city, country, category FROM c
WHERE lower(venue) LIKE '%e 1%' OR lower(city) LIKE '%e 1%' OR lower(country) LIKE '%e 1%' OR lower(category) LIKE '%e 1%'"""))
def _(spark, sf):
    view = X.checkins(spark, sf).select("user_id", "checkin_id", "venue", "city", "country", "category")
    return filters.search(view, filters.CHECKIN_SEARCH, " E 1 ")


@query("filter_by_facets", ck("SELECT user_id, checkin_id, city, country FROM c WHERE city = 'HOME' AND country = 'NATION_8'"))
def _(spark, sf):
    view = X.checkins(spark, sf).select("user_id", "checkin_id", "city", "country")
    return filters.filter_by(view, city="HOME", country="NATION_8", category=None)


@query("distinct_years", ck("SELECT DISTINCT year(t) AS year FROM c", years=5))
def _(spark, sf):
    return C.by_year(X.checkins(spark, sf, years=5)).select("year").distinct()
