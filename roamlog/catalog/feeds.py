"""Feed, recent list, weather, tips."""
from __future__ import annotations

from pyspark.sql import functions as F

from roamlog.catalog import query
from roamlog.catalog.views import ck, tips
from roamlog.functions import scalars as S
from roamlog.operators import cleaning, feed as FD, filters, tips as T
from roamlog.sources import fixtures as X

U = ["user_id"]

# Countries the feed queries give to rows, so that every zone rule is met.
FEED_COUNTRIES = ["Belarus", "Russia", "United States", "Brazil", "Australia", "Atlantis", "India"]


def _world_log(spark, sf):
    k = F.length("venue_id") * 3 + F.length("category") + F.col("user_id")
    name = F.element_at(F.array(*[F.lit(c) for c in FEED_COUNTRIES]), (k % len(FEED_COUNTRIES) + 1).cast("int"))
    return X.checkins(spark, sf).withColumn("country", name)


_CASE = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(FEED_COUNTRIES))
_LOG = f"""lg AS (
  SELECT * EXCLUDE (country), CASE (length(venue_id) * 3 + length(category) + user_id) % {len(FEED_COUNTRIES)} {_CASE} END AS country FROM c
)"""
_HOURS = "CAST(round_even(lng / 15, 0) AS INTEGER)"
_BANDS = f"""CASE country WHEN 'Belarus' THEN 'Europe/Minsk' WHEN 'India' THEN 'Asia/Kolkata'
  WHEN 'Russia' THEN CASE WHEN lng < 60 THEN 'Europe/Moscow' WHEN lng < 73 THEN 'Asia/Yekaterinburg' WHEN lng < 84 THEN 'Asia/Omsk'
    WHEN lng < 98 THEN 'Asia/Krasnoyarsk' WHEN lng < 115 THEN 'Asia/Irkutsk' WHEN lng < 130 THEN 'Asia/Yakutsk' WHEN lng < 142 THEN 'Asia/Vladivostok' ELSE 'Asia/Magadan' END
  WHEN 'Brazil' THEN CASE WHEN lng > -40 THEN 'America/Fortaleza' WHEN lng > -48 THEN 'America/Sao_Paulo' ELSE 'America/Manaus' END
  WHEN 'United States' THEN CASE WHEN lng > -75 THEN 'America/New_York' WHEN lng > -90 THEN 'America/Chicago' WHEN lng > -110 THEN 'America/Denver' ELSE 'America/Los_Angeles' END
  WHEN 'Australia' THEN CASE WHEN lng < 129 THEN 'Australia/Perth' WHEN lng < 138 THEN 'Australia/Darwin' WHEN lng < 142 THEN 'Australia/Adelaide' ELSE 'Australia/Sydney' END
  ELSE CASE WHEN {_HOURS} > 14 OR {_HOURS} < -12 THEN 'UTC' WHEN {_HOURS} > 0 THEN 'Etc/GMT-' || CAST({_HOURS} AS VARCHAR) ELSE 'Etc/GMT+' || CAST(-{_HOURS} AS VARCHAR) END END"""
_COUNTRY = f"""CASE country WHEN 'Belarus' THEN 'Europe/Minsk' WHEN 'India' THEN 'Asia/Kolkata' ELSE
  CASE WHEN {_HOURS} = 0 THEN 'Etc/GMT' WHEN {_HOURS} > 0 THEN 'Etc/GMT-' || CAST(least(14, {_HOURS}) AS VARCHAR) ELSE 'Etc/GMT+' || CAST(-greatest(-12, {_HOURS}) AS VARCHAR) END END"""
_FEED = _LOG + f""", feed AS (
  SELECT user_id, checkin_id, ts, t, strftime(timezone(tz, to_timestamp(ts)), '%d %b %Y') AS date, strftime(timezone(tz, to_timestamp(ts)), '%H:%M') AS time,
    strftime(timezone(tz, to_timestamp(ts)), '%Y-%m') AS lm, hour(timezone(tz, to_timestamp(ts))) AS lh,
    venue, city, country, category, venue_id, round(lat, 4) AS lat, round(lng, 4) AS lng
  FROM (SELECT *, {_BANDS} AS tz FROM lg)
)"""


@query("feed", ck("SELECT * EXCLUDE (t, lm, lh) FROM feed", extra=_FEED))
def _(spark, sf):
    return FD.feed(_world_log(spark, sf), U)


_KM = """2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - nlat) / 2), 2)
  + cos(radians(nlat)) * cos(radians(lat)) * pow(sin(radians(lng - nlng) / 2), 2)))"""


@query("feed_gaps", ck(f"""
SELECT user_id, checkin_id, ts, coalesce(gap_seconds, -1) AS gap_seconds, coalesce(round(km, 6), -1.0) AS gap_km,
  CASE WHEN gap_seconds IS NULL OR gap_seconds < 1800 THEN 'none' WHEN gap_seconds < 28800 THEN 'sm' WHEN gap_seconds < 129600 THEN 'md' ELSE 'lg' END AS gap,
  CASE WHEN gap_seconds IS NULL OR gap_seconds < 1800 THEN ''
    WHEN gap_seconds < 7200 THEN CAST(CAST(floor(gap_seconds / 60 + 0.5) AS BIGINT) AS VARCHAR) || 'm later'
    WHEN gap_seconds < 129600 THEN CAST(CAST(floor(gap_seconds / 3600 + 0.5) AS BIGINT) AS VARCHAR) || 'h later'
    ELSE CAST(CAST(floor(gap_seconds / 86400 + 0.5) AS BIGINT) AS VARCHAR) || 'd later' END AS gap_label,
  CASE WHEN km IS NULL THEN '' WHEN km < 1 THEN CAST(CAST(floor(km * 1000 + 0.5) AS BIGINT) AS VARCHAR) || 'm'
    WHEN km < 10 THEN printf('%.1f', km) || 'km' ELSE CAST(CAST(floor(km + 0.5) AS BIGINT) AS VARCHAR) || 'km' END AS distance
FROM (SELECT *, nts - ts AS gap_seconds, {_KM} AS km FROM (
  SELECT *, lag(ts) OVER w AS nts, lag(lat) OVER w AS nlat, lag(lng) OVER w AS nlng
  FROM feed WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, checkin_id)))""", extra=_FEED))
def _(spark, sf):
    gaps = FD.feed_gaps(FD.feed(_world_log(spark, sf), U), U)
    return gaps.select(
        "user_id", "checkin_id", "ts", F.coalesce("gap_seconds", F.lit(-1)).alias("gap_seconds"),
        F.coalesce("gap_km", F.lit(-1.0)).alias("gap_km"), "gap", "gap_label", "distance")


@query("month_index", ck("""
SELECT user_id, month, min(pos) AS pos FROM (
  SELECT user_id, strftime(t, '%Y-%m') AS month, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, checkin_id) - 1 AS pos FROM c) GROUP BY 1, 2""", years=5))
def _(spark, sf):
    return FD.month_index(FD.feed(X.checkins(spark, sf, years=5), U), U)


@query("local_months", ck("SELECT user_id, lm AS month, count(*) AS n FROM feed GROUP BY 1, 2", years=5, extra=_FEED))
def _(spark, sf):
    log = X.checkins(spark, sf, years=5).withColumn("country", F.col("country"))
    k = F.length("venue_id") * 3 + F.length("category") + F.col("user_id")
    name = F.element_at(F.array(*[F.lit(c) for c in FEED_COUNTRIES]), (k % len(FEED_COUNTRIES) + 1).cast("int"))
    return FD.local_months(FD.feed(log.withColumn("country", name), U), U)


@query("recent", ck(f"""
SELECT user_id, checkin_id, ts, strftime(l, '%Y-%m-%d') AS date, strftime(l, '%H:%M') AS time, strftime(l, '%d %b %Y, %H:%M') AS datetime,
  venue, venue_id, city, country, category, round(lat, 5) AS lat, round(lng, 5) AS lng, tz AS tz_name,
  CASE WHEN venue_id = '' THEN 0 ELSE count(*) OVER (PARTITION BY user_id, venue_id) END AS streak
FROM (SELECT *, timezone(tz, to_timestamp(ts)) AS l FROM (SELECT *, {_COUNTRY} AS tz FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, checkin_id) AS r FROM lg) WHERE r <= 30))""", extra=_LOG))
def _(spark, sf):
    return FD.recent(_world_log(spark, sf), U)


@query("feed_by_newest", ck("""
SELECT user_id, checkin_id, ts, date, time FROM feed
WHERE lower(venue) LIKE '%ue 7%' OR lower(city) LIKE '%ue 7%' OR lower(country) LIKE '%ue 7%' OR lower(category) LIKE '%ue 7%'""", extra=_FEED))
def _(spark, sf):
    found = filters.search(FD.feed(_world_log(spark, sf), U), filters.CHECKIN_SEARCH, "UE 7")
    return found.select("user_id", "checkin_id", "ts", "date", "time").orderBy(F.desc("ts"), F.asc("checkin_id"))


_WEATHER = """wx AS (
  SELECT lat1, lng1, utc_date, hour, CAST(any_value(h) AS DOUBLE) / 4 AS temp, any_value(h2) AS code FROM (
    SELECT lat1, lng1, utc_date, hour, max(hh) AS h, max(hh % 4) AS h2 FROM (
      SELECT round(lat, 1) AS lat1, round(lng, 1) AS lng1, CAST(CAST(t AS DATE) AS VARCHAR) AS utc_date, hour(t) AS hour, length(venue) + hour(t) AS hh FROM feed)
    GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3, 4
)"""


def _weather(spark, sf):
    """Hourly table made of the log's own places and UTC hours."""
    hh = F.length("venue") + F.col("hour")
    return (
        _world_log(spark, sf).select(
            F.round("lat", 1).alias("lat1"), F.round("lng", 1).alias("lng1"),
            F.date_from_unix_date(F.floor(F.col("ts") / 86400).cast("int")).cast("string").alias("utc_date"),
            F.floor(F.col("ts") % 86400 / 3600).cast("int").alias("hour"), "venue")
        .groupBy("lat1", "lng1", "utc_date", "hour")
        .agg((F.max(hh).cast("double") / 4).alias("temp"), F.max(hh % 4).cast("int").alias("code"))
    )


@query("weather_join", ck("""
SELECT user_id, checkin_id, ts, utc_date, lh AS hour, temp, code,
  CASE WHEN code IN (0, 1) AND (lh < 6 OR lh >= 22) THEN '🌙'
    WHEN code IN (0, 1) AND lh < 9 THEN CASE code WHEN 0 THEN '🌅' ELSE '🌤️' END
    WHEN code IN (0, 1) AND lh >= 18 THEN CASE code WHEN 0 THEN '🌇' ELSE '🌤️' END
    WHEN code = 0 THEN '☀️' WHEN code = 1 THEN '🌤️' WHEN code = 2 THEN '⛅' WHEN code = 3 THEN '☁️' ELSE '' END AS icon,
  CASE code WHEN 0 THEN 'Clear' WHEN 1 THEN 'Mainly clear' WHEN 2 THEN 'Partly cloudy' WHEN 3 THEN 'Overcast' ELSE '' END AS description
FROM (SELECT f.*, CAST(CAST(f.t AS DATE) AS VARCHAR) AS utc_date, wx.temp, wx.code FROM feed f LEFT JOIN wx
  ON wx.lat1 = round(f.lat, 1) AND wx.lng1 = round(f.lng, 1) AND wx.utc_date = CAST(CAST(f.t AS DATE) AS VARCHAR) AND wx.hour = f.lh)""",
    extra=_FEED + ", " + _WEATHER))
def _(spark, sf):
    return FD.weather_join(_world_log(spark, sf), _weather(spark, sf), U)


_MERGE = [("City 1", "Town One"), ("City 2", "Town Two"), ("City 3", "Town One")]
_NORM = """norm AS (
  SELECT *, CASE country WHEN 'Italia' THEN 'Italy' WHEN 'Polska' THEN 'Poland' WHEN 'España' THEN 'Spain' WHEN 'Беларусь' THEN 'Belarus' ELSE country END AS nc,
    CASE city WHEN 'City 1' THEN 'Town One' WHEN 'City 3' THEN 'Town One' WHEN 'City 2' THEN 'Town Two' ELSE city END AS nci,
    strftime(make_timestamp(ts * 1000000), '%d %b %Y') AS date, strftime(make_timestamp(ts * 1000000), '%H:%M') AS time FROM tips
)"""


def _norm(spark, sf):
    return T.normalised(X.tips(spark, sf), spark.createDataFrame(_MERGE, "key string, value string"))


@query("tips_normalised", tips("SELECT id, ts, date, time, country, city, nc, nci, length(text) AS chars FROM norm", _NORM))
def _(spark, sf):
    return _norm(spark, sf).select("id", "ts", "date", "time", "country", "city", "nc", "nci", F.length("text").alias("chars"))


@query("tips_tabs", tips("""
SELECT a.country, total, city, n FROM (SELECT nc AS country, count(*) AS total FROM norm WHERE nc <> '' GROUP BY 1) a
JOIN (SELECT nc AS country, nci AS city, count(*) AS n FROM norm WHERE nc <> '' AND nci <> '' GROUP BY 1, 2) b ON a.country = b.country""", _NORM))
def _(spark, sf):
    return T.tips_tabs(_norm(spark, sf))


@query("tips_recent", tips("""
SELECT (SELECT count(*) FROM norm) AS total, id, ts, date, text, venue, venue_id, city, country, nc, nci, category, agree_count, closed
FROM norm ORDER BY ts DESC, id LIMIT 30""", _NORM))
def _(spark, sf):
    return T.tips_recent(_norm(spark, sf))


@query("tips_search", tips("""
SELECT id, ts, nc, nci FROM norm WHERE nc = 'Italy' AND (lower(text) LIKE '%the%' OR lower(venue) LIKE '%the%' OR lower(city) LIKE '%the%' OR lower(country) LIKE '%the%' OR lower(category) LIKE '%the%')""", _NORM))
def _(spark, sf):
    found = filters.search(filters.filter_by(_norm(spark, sf), nc="Italy", nci=""), filters.TIP_SEARCH, "the")
    return filters.sort_tips(found, "agree").select("id", "ts", "nc", "nci")


@query("tips_mappable", tips("""
SELECT id, lat, lng, CASE WHEN length(text) > 90 THEN substr(text, 1, 90) || '…' ELSE text END AS preview FROM tips WHERE lat IS NOT NULL AND lng IS NOT NULL"""))
def _(spark, sf):
    return filters.mappable(X.tips(spark, sf)).select("id", "lat", "lng", S.preview(F.col("text")).alias("preview"))


@query("uncovered_venues", f"WITH {X.checkins_sql()}, {X.TIPS_SQL.strip()}" + """
SELECT venue_id, min(ts) AS first_ts FROM ck WHERE venue_id <> '' AND venue_id NOT IN (SELECT venue_id FROM tips WHERE venue_id <> '' AND agree_count > 5) GROUP BY 1""")
def _(spark, sf):
    return T.uncovered_venues(X.checkins(spark, sf), X.tips(spark, sf).filter("agree_count > 5"))


@query("scalar_labels", ck("""
SELECT user_id, checkin_id, lower(replace(venue, ' ', '-')) AS slug, concat_ws(', ', nullif(city, ''), nullif(country, '')) AS place,
  CAST(floor((lng + 180) / 360 * 16384) AS BIGINT) AS tile_x,
  CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384) AS BIGINT) AS tile_y,
  CASE WHEN venue_id = '' THEN '' ELSE 'https://example.org/v/' || lower(replace(venue, ' ', '-')) || '/' || venue_id END AS url FROM c"""))
def _(spark, sf):
    slug = S.venue_slug(F.col("venue"))
    tile = S.tile_xy(F.col("lat"), F.col("lng"))
    url = F.coalesce(S.url_of("https://example.org/v/", slug, F.col("venue_id")), F.lit(""))
    return X.checkins(spark, sf).select(
        "user_id", "checkin_id", slug.alias("slug"), S.location_label(F.col("city"), F.col("country")).alias("place"),
        tile["x"].alias("tile_x"), tile["y"].alias("tile_y"), url.alias("url"))
