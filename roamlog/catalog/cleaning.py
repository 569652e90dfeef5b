"""Cleaning steps over text rows derived from the events."""
from __future__ import annotations

from pyspark.sql import functions as F

from roamlog.catalog import query
from roamlog.catalog.views import ck
from roamlog.operators import cleaning as C
from roamlog.sources import fixtures as X

# City lookup of the example queries (one entry is a chain, which is not followed).
MERGE = [("City 1", "Town One"), ("Town One", "Never"), ("O'City 7", "Town Seven"), ("O’City 9", "Town Nine"), ("Near", "Town Near")]


def _raw(spark, sf):
    """Text rows: some cities with a curly apostrophe, some padded, some dates unusable."""
    view = X.checkins(spark, sf)
    city = F.when(F.col("city").isin("City 7", "City 9"), F.concat(F.lit("O’"), "city")).when(
        F.col("city") == "City 1", "  City 1 ").otherwise(F.col("city"))
    return view.withColumns({
        "city": city, "lat": F.col("lat").cast("string"), "lng": F.col("lng").cast("string"),
        "date": F.when(F.col("user_id") % 50 == 7, F.concat(F.lit("x"), "date")).otherwise(F.concat(F.lit(" "), "date")),
    })


_RAW = """raw AS (
  SELECT user_id, checkin_id, ts, venue_id, country, lat, lng, user_id % 50 = 7 AS bad,
    CASE WHEN city IN ('City 7', 'City 9') THEN 'O’' || city ELSE city END AS city FROM c
)"""
_MERGED = """CASE replace({c}, '’', chr(39)) WHEN 'City 1' THEN 'Town One' WHEN 'Town One' THEN 'Never' WHEN 'O''City 7' THEN 'Town Seven' WHEN 'Near' THEN 'Town Near'
  ELSE CASE {c} WHEN 'O’City 9' THEN 'Town Nine' ELSE {c} END END"""


def _merge(spark):
    return spark.createDataFrame(MERGE, "key string, value string")


def _fixes(spark, sf, prefix):
    """Override table keyed by the time of some rows of the log."""
    rows = X.checkins(spark, sf).filter("CAST(checkin_id AS BIGINT) % 37 = 0").groupBy("date").agg(F.min("checkin_id").alias("c"))
    return rows.select(F.col("date").alias("key"), F.concat(F.lit(prefix), "c").alias("value"))


_FIX = "fx AS (SELECT date AS fk, min(checkin_id) AS fc FROM c WHERE CAST(checkin_id AS BIGINT) % 37 = 0 GROUP BY 1)"


@query("merge_city", ck(f"SELECT user_id, checkin_id, {_MERGED.format(c='city')} AS city FROM raw", extra=_RAW))
def _(spark, sf):
    return C.merge_city(C.typed(_raw(spark, sf)), _merge(spark)).select("user_id", "checkin_id", "city")


@query("fix_country", ck("""
SELECT user_id, checkin_id, CASE WHEN NOT bad AND fc IS NOT NULL THEN 'Land ' || fc ELSE country END AS country
FROM raw LEFT JOIN fx ON fk = CAST(ts AS VARCHAR)""", extra=_RAW + ", " + _FIX))
def _(spark, sf):
    return C.fix_country(_raw(spark, sf), _fixes(spark, sf, "Land ")).select("user_id", "checkin_id", "country")


@query("fix_city_by_user", ck("""
SELECT raw.user_id, raw.checkin_id, CASE WHEN NOT bad AND f.checkin_id IS NOT NULL THEN 'Town ' || f.checkin_id ELSE raw.city END AS city
FROM raw LEFT JOIN (SELECT user_id, date, min(checkin_id) AS checkin_id FROM c WHERE CAST(checkin_id AS BIGINT) % 37 = 0 GROUP BY 1, 2) f
  ON f.date = CAST(raw.ts AS VARCHAR) AND f.user_id = raw.user_id""", extra=_RAW))
def _(spark, sf):
    """An override applies to the log it names, though others have a row in that second."""
    rows = X.checkins(spark, sf).filter("CAST(checkin_id AS BIGINT) % 37 = 0").groupBy("user_id", "date").agg(F.min("checkin_id").alias("c"))
    fixes = rows.select("user_id", F.col("date").alias("key"), F.concat(F.lit("Town "), "c").alias("value"))
    others = fixes.withColumns({"user_id": F.col("user_id") + 1, "value": F.lit("wrong")}).join(fixes.select("user_id", "key"), ["user_id", "key"], "left_anti")
    return C.fix_city(C.typed(_raw(spark, sf)), fixes.unionByName(others.withColumn("user_id", -F.col("user_id"))), by=["user_id"]).select(
        "user_id", "checkin_id", "city")


@query("fix_city", ck("""
SELECT user_id, checkin_id, CASE WHEN NOT bad AND fc IS NOT NULL THEN 'Town ' || fc ELSE city END AS city, NOT bad AND fc IS NOT NULL AS city_fixed
FROM raw LEFT JOIN fx ON fk = CAST(ts AS VARCHAR)""", extra=_RAW + ", " + _FIX))
def _(spark, sf):
    fixed = C.fix_city(C.typed(_raw(spark, sf)), _fixes(spark, sf, "Town "))
    return fixed.select("user_id", "checkin_id", "city", "city_fixed")


def _centroids(spark, sf):
    """Centres near the log's own points: one per country and latitude step, from named rows."""
    named = X.checkins(spark, sf).filter("city <> ''").groupBy("country", "lat", "lng").agg(F.min("city").alias("city"))
    lat, lng = F.col("lat") + 0.25, F.col("lng") + F.length("city") / F.lit(8.0)
    return named.select("country", lat.alias("lat"), lng.alias("lng"), F.when(F.col("lat") > 0, "Near").otherwise(
        F.col("city")).alias("city"), (F.col("lng") * 1000 + F.col("lat")).alias("seq"))


_CENTRES = """cen AS (
  SELECT country, lat + 0.25 AS clat, lng + length(city) / 8.0e0 AS clng, CASE WHEN lat > 0 THEN 'Near' ELSE city END AS ccity, lng * 1000 + lat AS seq
  FROM (SELECT country, lat, lng, min(city) AS city FROM c WHERE city <> '' GROUP BY 1, 2, 3)
), pts AS (SELECT DISTINCT country, lat, lng FROM c), dist AS (
  SELECT p.country, p.lat, p.lng, ccity, seq, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(clat - lat) / 2), 2)
    + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clng - lng) / 2), 2)))) AS km
  FROM pts p JOIN cen ON cen.country = p.country
), near AS (
  SELECT country, lat, lng, arg_min(ccity, (km, seq)) AS city, min(km) AS km FROM dist WHERE km <= {max_km} GROUP BY 1, 2, 3
)"""


@query("nearest_centroid", ck("SELECT country, lat, lng, city, round(km, 6) AS km FROM near", extra=_CENTRES.format(max_km=600)))
def _(spark, sf):
    points = X.checkins(spark, sf).select("country", "lat", "lng").distinct()
    return C.nearest(points, _centroids(spark, sf), 600).withColumn("km", F.round("km", 6))


_TIMES = "tm AS (SELECT date AS tk, max(venue) AS tv FROM c WHERE city = '' AND CAST(checkin_id AS BIGINT) % 5 = 0 GROUP BY 1)"


def _resolver(spark, sf):
    times = X.checkins(spark, sf).filter("city = '' AND CAST(checkin_id AS BIGINT) % 5 = 0").groupBy(F.col("date").alias("key")).agg(
        F.max("venue").alias("value"))
    return C.Resolver(times, _centroids(spark, sf), 600)


_INFERRED = "CASE WHEN r.city <> '' THEN r.city WHEN NOT bad AND tv IS NOT NULL THEN tv WHEN near.city IS NOT NULL THEN near.city ELSE '' END"


@query("infer_city", ck(f"""
SELECT user_id, checkin_id, {_INFERRED} AS city FROM raw r LEFT JOIN tm ON tk = CAST(ts AS VARCHAR)
LEFT JOIN near ON near.country = r.country AND near.lat = r.lat AND near.lng = r.lng""", extra=", ".join([_RAW, _CENTRES.format(max_km=600), _TIMES])))
def _(spark, sf):
    rows = C.fix_city(C.typed(_raw(spark, sf)), None)
    return C.infer_city(rows, _resolver(spark, sf)).select("user_id", "checkin_id", "city")


@query("clean_checkins", ck(f"""
SELECT user_id, checkin_id, CASE WHEN bad THEN -1 ELSE ts END AS ts, CASE WHEN NOT bad AND lf.fc IS NOT NULL THEN 'Land ' || lf.fc ELSE k.country END AS country,
  CASE WHEN NOT bad AND lf.fc IS NOT NULL THEN 'Town ' || lf.fc ELSE {_MERGED.format(c='icity')} END AS city, venue_id
FROM (SELECT r.*, {_INFERRED.replace('near.', 'nx.')} AS icity FROM raw r LEFT JOIN tm ON tk = CAST(ts AS VARCHAR)
  LEFT JOIN fx f0 ON f0.fk = CAST(ts AS VARCHAR) AND NOT bad
  LEFT JOIN near nx ON nx.country = CASE WHEN f0.fc IS NOT NULL THEN 'Land ' || f0.fc ELSE r.country END AND nx.lat = r.lat AND nx.lng = r.lng) k
LEFT JOIN fx lf ON lf.fk = CAST(ts AS VARCHAR)""", extra=", ".join([_RAW, _FIX, _CENTRES.format(max_km=600), _TIMES])))
def _(spark, sf):
    maps = C.Mappings(_fixes(spark, sf, "Land "), _fixes(spark, sf, "Town "), _merge(spark))
    done = C.clean_checkins(_raw(spark, sf), maps, _resolver(spark, sf))
    return done.select("user_id", "checkin_id", F.coalesce("ts", F.lit(-1)).alias("ts"), "country", "city", "venue_id")


@query("quarantine", ck("SELECT user_id, checkin_id FROM raw WHERE bad", extra=_RAW))
def _(spark, sf):
    return C.quarantine(_raw(spark, sf))[1].select("user_id", "checkin_id")


@query("norm_country", ck("""
SELECT user_id, checkin_id, CASE user_id % 3 WHEN 0 THEN 'Poland' WHEN 1 THEN 'Georgia' ELSE country END AS nc FROM c"""))
def _(spark, sf):
    local = F.when(F.col("user_id") % 3 == 0, "Polska").when(F.col("user_id") % 3 == 1, "საქართველო").otherwise(F.col("country"))
    return C.norm_country(X.checkins(spark, sf).withColumn("country", local)).select("user_id", "checkin_id", "nc")
