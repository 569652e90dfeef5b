"""Companions."""
from __future__ import annotations

from roamlog.catalog import query
from roamlog.catalog.views import ck
from roamlog.operators import companions as P
from roamlog.sources import fixtures as X

U = ["user_id"]

_NAMES = """nm AS (
  SELECT *, list_filter(string_split(with_name, ', '), lambda x: x <> '') AS w,
    list_filter(string_split(overlaps_name, ', '), lambda x: x <> '' AND x <> '-') AS o FROM c
), nn AS (
  SELECT *, CASE WHEN created_by_name <> '' AND NOT list_contains(w, created_by_name) THEN [created_by_name] ELSE [] END AS cb FROM nm
), ex AS (
  SELECT * EXCLUDE (name), name FROM (SELECT *, unnest(list_concat(w, cb, list_filter(list_distinct(o),
    lambda x: NOT list_contains(w, x) AND NOT list_contains(cb, x)))) AS name FROM nn)
)""".replace("* EXCLUDE (name), name", "*")


@query("companions", ck("""
SELECT name, count(*) AS n, min(ts) AS first_ts FROM ex GROUP BY 1 ORDER BY n DESC, first_ts, name LIMIT 30""", extra=_NAMES))
def _(spark, sf):
    return P.companions(X.checkins(spark, sf))


@query("companions_by_user", ck("""
SELECT user_id, name, n, first_ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_ts, name) AS r FROM (
  SELECT user_id, name, count(*) AS n, min(ts) AS first_ts FROM ex GROUP BY 1, 2)) WHERE r <= 2""", extra=_NAMES))
def _(spark, sf):
    return P.companions(X.checkins(spark, sf), U, k=2)


_IDS = """ids AS (
  SELECT name, arg_min(id, (o, id)) AS id FROM (
    SELECT ts * 4096 + i - 1 AS o, string_split(nl, ', ')[i] AS name, string_split(il, ', ')[i] AS id FROM (
      SELECT *, unnest(generate_series(1, len(string_split(nl, ', ')))) AS i FROM (
        SELECT ts, array_to_string(list_filter([with_name, created_by_name, overlaps_name], lambda x: x <> ''), ', ') AS nl,
          array_to_string(list_filter([with_id, created_by_id, overlaps_id], lambda x: x <> ''), ', ') AS il FROM c) WHERE nl <> '')
  ) WHERE name <> '-' GROUP BY 1
)"""


@query("companion_ids", ck("SELECT name, id FROM ids", extra=_IDS))
def _(spark, sf):
    return P.companion_ids(X.checkins(spark, sf))


_FEED = _NAMES + ", " + _IDS + """, tops AS (
  SELECT name, count(*) AS total, min(ts) AS f FROM ex GROUP BY 1 ORDER BY total DESC, f, name LIMIT 3
), feed AS (
  SELECT ex.name, total, coalesce(ids.id, '') AS id, row_number() OVER (PARTITION BY ex.name ORDER BY ts DESC, checkin_id DESC) AS pos, ts,
    strftime(t, '%d %b %Y') AS date, strftime(t, '%H:%M') AS time, checkin_id, venue, city, country, category, venue_id
  FROM ex JOIN tops ON tops.name = ex.name LEFT JOIN ids ON ids.name = ex.name
)"""


@query("companion_feed", ck("SELECT * FROM feed", extra=_FEED))
def _(spark, sf):
    return P.companion_feed(X.checkins(spark, sf), k=3)


@query("companion_profile", ck("""
SELECT pl.name, pl.places, coalesce(CASE WHEN pl.name = 'Bob B' THEN 'Poland' END, nc.country, '') AS country,
  CASE WHEN pl.name = 'Bob B' THEN '🇵🇱' ELSE '🌍' END AS flag
FROM (SELECT name, string_agg(place, ' · ' ORDER BY n DESC, p) AS places FROM (
        SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, p) AS r FROM (
          SELECT name, CASE WHEN city <> '' THEN city ELSE country END AS place, count(*) AS n, min(pos) AS p FROM feed GROUP BY 1, 2)) WHERE r <= 4 GROUP BY 1) pl
JOIN (SELECT name, arg_min(country, pos) AS country FROM feed WHERE country <> '' GROUP BY 1) nc ON nc.name = pl.name""", extra=_FEED))
def _(spark, sf):
    return P.companion_profile(P.companion_feed(X.checkins(spark, sf), k=3), overrides={"Bob B": "Poland"})
