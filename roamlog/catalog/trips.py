"""Trip queries. The DuckDB text follows the rules run by run with sub-queries and a recursive walk."""
from __future__ import annotations

from pyspark.sql import functions as F

from roamlog import fixed
from roamlog.catalog import query
from roamlog.catalog.views import DATED, ck
from roamlog.operators import filters, ordered as O
from roamlog.plans import trips as T
from roamlog.sources import fixtures as X

U = ["user_id"]


def _in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_RULES = f"""o AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, checkin_id) AS idx, city = 'HOME' AS home, city NOT IN ('', 'HOME') AS abroad,
    city = 'HOME' AND category IN {_in(fixed.TRANSPORT_HUBS)} AS hub FROM log
), g AS (
  SELECT *, sum(CAST(home AS INT)) OVER (PARTITION BY user_id ORDER BY idx) AS grp FROM o
), runs AS (
  SELECT * FROM (SELECT user_id, min(idx) AS fp, max(idx) AS lp, count(*) AS n, min(ts) AS s_ts, max(ts) AS l_ts FROM g WHERE NOT home GROUP BY user_id, grp) WHERE n >= 4
), a1 AS (
  SELECT r.*,
    (SELECT min(idx) FROM o WHERE o.user_id = r.user_id AND o.idx > r.lp AND o.hub AND o.ts <= r.l_ts + 86400) AS h,
    (SELECT min(idx) FROM o WHERE o.user_id = r.user_id AND o.idx > r.lp AND o.home AND o.category = 'Neighborhood' AND o.ts <= r.l_ts + 86400) AS nb,
    (SELECT min(idx) FROM o WHERE o.user_id = r.user_id AND o.idx > r.lp AND (o.abroad OR (o.home AND o.category = 'Home (private)'))) AS bl,
    (SELECT max(idx) FROM o WHERE o.user_id = r.user_id AND o.idx < r.fp AND o.abroad) AS pf
  FROM runs r
), a2 AS (
  SELECT *, coalesce(h, CASE WHEN nb IS NOT NULL AND (bl IS NULL OR bl > nb) THEN nb END) AS arr FROM a1
), a3 AS (
  SELECT a.*, x.idx AS end1, x.ts AS e_ts FROM a2 a JOIN o x ON x.user_id = a.user_id AND x.idx = coalesce(a.arr, a.lp)
), a4 AS (
  SELECT a.*,
    (SELECT min(idx) FROM o WHERE o.user_id = a.user_id AND o.idx > a.end1 AND o.home AND o.category = 'Home (private)'
       AND o.ts <= a.e_ts + CASE WHEN a.arr IS NULL THEN 43200 ELSE 18000 END) AS hp,
    (SELECT min(idx) FROM o WHERE o.user_id = a.user_id AND o.idx > a.end1
       AND ((o.abroad AND o.category NOT IN {_in(fixed.ROADSIDE)}) OR o.category IN {_in(fixed.NIGHTLIFE)})) AS st
  FROM a3 a
), ends AS (
  SELECT *, coalesce(lag(end_idx) OVER (PARTITION BY user_id ORDER BY fp), 0) AS prev_end FROM (
    SELECT *, CASE WHEN hp IS NOT NULL AND (st IS NULL OR st > hp) THEN hp ELSE end1 END AS end_idx FROM a4)
), cand AS (
  SELECT e.user_id, e.fp, e.s_ts, o.idx, o.ts, o.hub, o.venue_id, o.category
  FROM ends e JOIN o ON o.user_id = e.user_id AND o.idx < e.fp AND o.idx > e.prev_end AND o.idx > coalesce(e.pf, 0) AND o.ts >= e.s_ts - 86400
), step AS (
  SELECT h.user_id, h.fp, h.idx, h.ts, max(p.idx) AS nx, max(p.ts) AS nts
  FROM cand h JOIN cand p ON p.user_id = h.user_id AND p.fp = h.fp AND p.hub AND h.hub AND p.idx < h.idx AND NOT (p.venue_id = h.venue_id AND h.venue_id <> '')
  GROUP BY 1, 2, 3, 4
), walk AS (
  SELECT user_id, fp, max(idx) AS idx FROM cand WHERE hub GROUP BY 1, 2
  UNION ALL
  SELECT w.user_id, w.fp, s.nx FROM walk w JOIN step s ON s.user_id = w.user_id AND s.fp = w.fp AND s.idx = w.idx AND s.ts - s.nts <= 10800
), dep AS (
  SELECT user_id, fp, min(idx) AS d FROM walk GROUP BY 1, 2
), ride AS (
  SELECT user_id, fp, CASE WHEN s_ts - coalesce(svc_ts, fuel_ts) <= 14400 THEN coalesce(svc, fuel) END AS d FROM (
    SELECT user_id, fp, s_ts, min(idx) FILTER (category IN {_in(fixed.DEPARTURE_SERVICES)}) AS svc, min(ts) FILTER (category IN {_in(fixed.DEPARTURE_SERVICES)}) AS svc_ts,
      max(idx) FILTER (category = 'Fuel Station') AS fuel, max(ts) FILTER (category = 'Fuel Station') AS fuel_ts
    FROM cand WHERE ts // 86400 = s_ts // 86400 GROUP BY 1, 2, 3)
), iv AS (
  SELECT e.user_id, e.fp, coalesce(dep.d, ride.d, e.fp) AS start_idx, e.end_idx
  FROM ends e LEFT JOIN dep ON dep.user_id = e.user_id AND dep.fp = e.fp LEFT JOIN ride ON ride.user_id = e.user_id AND ride.fp = e.fp
), trips AS (
  SELECT iv.user_id, row_number() OVER (PARTITION BY iv.user_id ORDER BY o.ts, iv.fp) AS trip_id, start_idx, end_idx, o.ts AS start_ts
  FROM iv JOIN o ON o.user_id = iv.user_id AND o.idx = iv.start_idx WHERE end_idx - start_idx + 1 >= 5
)"""

_H = "CAST(round_even(round(lng, 5) / 15, 0) AS INTEGER)"
_ROWS = f""", tr AS (
  SELECT t.trip_id, t.start_idx, t.end_idx, x.*, timezone(CASE WHEN {_H} = 0 THEN 'Etc/GMT' WHEN {_H} > 0 THEN 'Etc/GMT-' || CAST(least(14, {_H}) AS VARCHAR)
      ELSE 'Etc/GMT+' || CAST(-greatest(-12, {_H}) AS VARCHAR) END, to_timestamp(x.ts)) AS l
  FROM trips t JOIN o x ON x.user_id = t.user_id AND x.idx BETWEEN t.start_idx AND t.end_idx
), fc AS (
  SELECT user_id, trip_id, facet, value, count(*) AS n, min(idx) AS fi FROM (
    SELECT user_id, trip_id, idx, 'country' AS facet, country AS value FROM tr UNION ALL SELECT user_id, trip_id, idx, 'city', city FROM tr
    UNION ALL SELECT user_id, trip_id, idx, 'category', category FROM tr) WHERE value <> '' GROUP BY 1, 2, 3, 4
), nm AS (
  SELECT user_id, trip_id, string_agg(value, ' | ' ORDER BY n DESC, fi) FILTER (facet = 'country') AS countries, string_agg(value, ' | ' ORDER BY n DESC, fi) FILTER (facet = 'city') AS cities,
    list(value ORDER BY n DESC, fi) FILTER (facet = 'country') AS cl, list(value ORDER BY n DESC, fi) FILTER (facet = 'city') AS tl FROM fc GROUP BY 1, 2
), sm AS (
  SELECT b.*, nm.countries, coalesce(nm.cities, '') AS cities, CAST(left(start_date, 4) AS BIGINT) AS start_year, CAST(end_date AS DATE) - CAST(start_date AS DATE) + 1 AS duration,
    CASE len(cl) WHEN 1 THEN coalesce(tl[1], cl[1]) || ', ' || cl[1] WHEN 2 THEN cl[1] || ' & ' || cl[2] ELSE cl[1] || ' + ' || cl[2] || ' + ' || CAST(len(cl) - 2 AS VARCHAR) || ' more' END AS name, cl
  FROM (SELECT user_id, trip_id, count(*) AS checkin_count, strftime(arg_min(l, idx), '%Y-%m-%d') AS start_date, strftime(arg_max(l, idx), '%Y-%m-%d') AS end_date,
      count(DISTINCT nullif(venue_id, '')) AS unique_places, min(round(lat, 5)) AS min_lat, max(round(lat, 5)) AS max_lat, min(round(lng, 5)) AS min_lng, max(round(lng, 5)) AS max_lng
    FROM tr GROUP BY 1, 2) b JOIN nm ON nm.user_id = b.user_id AND nm.trip_id = b.trip_id
)"""


def _sql(body: str, log: str = "SELECT * FROM c", rows: bool = False) -> str:
    return f"WITH RECURSIVE {X.checkins_sql()}, {DATED}, log AS ({log}), {_RULES}{_ROWS if rows else ''}\n{body}"


def _detect(spark, sf):
    return T.detect(X.checkins(spark, sf), U, "HOME")


@query("trips", _sql("SELECT user_id, trip_id, start_idx, end_idx, start_ts FROM trips"))
def _(spark, sf):
    return _detect(spark, sf).intervals.drop("name_ts")


@query("trips_excluded", _sql("""
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY trip_id) AS trip_id, start_idx, end_idx, start_ts FROM trips WHERE start_ts % 3 <> 0"""))
def _(spark, sf):
    """Trips named in the exclusion table are gone, and numbering closes the gaps."""
    gone = _detect(spark, sf).intervals.filter("start_ts % 3 = 0").select(*U, "start_ts")
    return T.detect(X.checkins(spark, sf), U, "HOME", tables=T.TripTables(exclude=gone)).intervals.drop("name_ts")


@query("trips_forced_starts", _sql("""
, ov AS (SELECT user_id, start_ts, start_ts - 40000 AS wanted FROM trips WHERE start_ts % 3 = 0)
, st AS (SELECT iv.*, o.ts AS ts1 FROM iv JOIN o ON o.user_id = iv.user_id AND o.idx = iv.start_idx)
, nw AS (SELECT st.*, (SELECT count(*) + 1 FROM o WHERE o.user_id = st.user_id AND o.ts < ov.wanted) AS first FROM st LEFT JOIN ov ON ov.user_id = st.user_id AND ov.start_ts = st.ts1)
, fs AS (SELECT user_id, fp, end_idx, CASE WHEN first < start_idx AND ts1 % 3 = 0 AND EXISTS (SELECT 1 FROM ov WHERE ov.user_id = nw.user_id AND ov.start_ts = nw.ts1) THEN first ELSE start_idx END AS start_idx FROM nw)
SELECT fs.user_id, row_number() OVER (PARTITION BY fs.user_id ORDER BY o.ts, fs.fp) AS trip_id, fs.start_idx, fs.end_idx, o.ts AS start_ts
FROM fs JOIN o ON o.user_id = fs.user_id AND o.idx = fs.start_idx WHERE fs.end_idx - fs.start_idx + 1 >= 5""".lstrip()))
def _(spark, sf):
    """Named trips start at the first row of an earlier time."""
    wanted = _detect(spark, sf).intervals.filter("start_ts % 3 = 0").select(*U, "start_ts", (F.col("start_ts") - 40000).alias("new_start_ts"))
    return T.detect(X.checkins(spark, sf), U, "HOME", tables=T.TripTables(start_overrides=wanted)).intervals.drop("name_ts")


def _forced_sql(keys: str, log: str = "SELECT * FROM c") -> str:
    """Trips whose ends are forced by ``keys``, a text that gives (user_id, k, wanted): run by run from the first."""
    ride = f"category IN {_in(fixed.DEPARTURE_SERVICES)}"
    return _sql(f"""
, fo AS (SELECT user_id, k, (SELECT max(idx) FROM o WHERE o.user_id = ov.user_id AND o.ts <= ov.wanted) AS forced FROM ({keys}) ov)
, rn AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY fp) AS rn, coalesce(lag(lp) OVER (PARTITION BY user_id ORDER BY fp), 0) AS before FROM a3)
, cd AS (
  SELECT e.user_id, e.fp, e.s_ts, o.idx, o.ts, o.hub, o.venue_id, o.category
  FROM rn e JOIN o ON o.user_id = e.user_id AND o.idx < e.fp AND o.idx > e.before AND o.idx > coalesce(e.pf, 0) AND o.ts >= e.s_ts - 86400
  WHERE o.hub OR o.category = 'Fuel Station' OR o.{ride}
), sp AS (
  SELECT h.user_id, h.fp, h.idx, h.ts, max(p.idx) AS nx, max(p.ts) AS nts
  FROM cd h JOIN cd p ON p.user_id = h.user_id AND p.fp = h.fp AND p.hub AND h.hub AND p.idx < h.idx AND NOT (p.venue_id = h.venue_id AND h.venue_id <> '') GROUP BY 1, 2, 3, 4
), wk AS (
  SELECT user_id, fp, max(idx) AS idx FROM cd WHERE hub GROUP BY 1, 2
  UNION ALL
  SELECT w.user_id, w.fp, s.nx FROM wk w JOIN sp s ON s.user_id = w.user_id AND s.fp = w.fp AND s.idx = w.idx AND s.ts - s.nts <= 10800
), pc AS (
  SELECT user_id, fp, lo, lead(lo, 1, 1000000000) OVER (PARTITION BY user_id, fp ORDER BY lo) AS hi
  FROM (SELECT user_id, fp, 0 AS lo FROM rn UNION SELECT user_id, fp, idx FROM cd)
), hb AS (
  SELECT pc.user_id, pc.fp, pc.lo, min(w.idx) AS d FROM pc JOIN wk w ON w.user_id = pc.user_id AND w.fp = pc.fp AND w.idx > pc.lo GROUP BY 1, 2, 3
), rd AS (
  SELECT user_id, fp, lo, CASE WHEN s_ts - coalesce(svc_ts, fuel_ts) <= 14400 THEN coalesce(svc, fuel) END AS d FROM (
    SELECT pc.user_id, pc.fp, pc.lo, s_ts, min(idx) FILTER ({ride}) AS svc, min(ts) FILTER ({ride}) AS svc_ts,
      max(idx) FILTER (category = 'Fuel Station') AS fuel, max(ts) FILTER (category = 'Fuel Station') AS fuel_ts
    FROM pc JOIN cd ON cd.user_id = pc.user_id AND cd.fp = pc.fp AND cd.idx > pc.lo WHERE ts // 86400 = s_ts // 86400 GROUP BY 1, 2, 3, 4)
), ps AS (
  SELECT pc.*, rn.rn, rn.arr, rn.end1, coalesce(hb.d, rd.d, pc.fp) AS start_idx FROM pc JOIN rn ON rn.user_id = pc.user_id AND rn.fp = pc.fp
  LEFT JOIN hb ON hb.user_id = pc.user_id AND hb.fp = pc.fp AND hb.lo = pc.lo LEFT JOIN rd ON rd.user_id = pc.user_id AND rd.fp = pc.fp AND rd.lo = pc.lo
), pe AS (
  SELECT ps.*, o.ts AS start_ts, greatest(ps.end1, coalesce(fo.forced, 0)) AS end2 FROM ps JOIN o ON o.user_id = ps.user_id AND o.idx = ps.start_idx
  LEFT JOIN fo ON fo.user_id = ps.user_id AND fo.k = o.ts
), nx AS (
  SELECT user_id, idx, ts, min(CASE WHEN home AND category = 'Home (private)' THEN idx END) OVER w AS hp, min(CASE WHEN home AND category = 'Home (private)' THEN ts END) OVER w AS hp_ts,
    min(CASE WHEN (abroad AND category NOT IN {_in(fixed.ROADSIDE)}) OR category IN {_in(fixed.NIGHTLIFE)} THEN idx END) OVER w AS st
  FROM o WINDOW w AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), pf AS MATERIALIZED (
  SELECT pe.*, CASE WHEN nx.hp_ts - nx.ts <= CASE WHEN pe.arr IS NULL THEN 43200 ELSE 18000 END AND (nx.st IS NULL OR nx.st > nx.hp) THEN nx.hp ELSE pe.end2 END AS end_idx
  FROM pe JOIN nx ON nx.user_id = pe.user_id AND nx.idx = pe.end2
), sol AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS start_idx, CAST(0 AS BIGINT) AS end_idx, CAST(0 AS BIGINT) AS start_ts FROM rn
  UNION ALL
  SELECT pf.user_id, pf.rn, pf.fp, pf.start_idx, pf.end_idx, pf.start_ts FROM sol JOIN pf ON pf.user_id = sol.user_id AND pf.rn = sol.rn + 1 AND sol.end_idx >= pf.lo AND sol.end_idx < pf.hi
)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start_ts, fp) AS trip_id, start_idx, end_idx, start_ts FROM sol WHERE rn > 0 AND end_idx - start_idx + 1 >= 5""".lstrip(), log)


@query("trips_forced_ends", _forced_sql("SELECT user_id, ts AS k, max(ts) + 90000 AS wanted FROM o WHERE ts % 3 > 0 GROUP BY user_id, ts"))
def _(spark, sf):
    """Two thirds of all times name an end a day later, so that forced ends follow each other along each log."""
    ck = X.checkins(spark, sf)
    ends = ck.filter("ts % 3 > 0").select(*U, F.col("ts").alias("start_ts"), (F.col("ts") + 90000).alias("end_ts"))
    return T.detect(ck, U, "HOME", tables=T.TripTables(end_overrides=ends)).intervals.drop("name_ts")


@query("trips_forced_ends_one_log", "SELECT * EXCLUDE (user_id) FROM (" + _forced_sql(
    "SELECT user_id, ts AS k, max(ts) + 4000 AS wanted FROM o WHERE ts % 3 > 0 GROUP BY user_id, ts", "SELECT 0 AS user_id, * EXCLUDE (user_id) FROM c") + ")")
def _(spark, sf):
    """The same over the rows of all users as one log, where a chain runs through all its trips."""
    ck = X.checkins(spark, sf).drop("user_id")
    ends = ck.filter("ts % 3 > 0").select(F.col("ts").alias("start_ts"), (F.col("ts") + 4000).alias("end_ts"))
    return T.detect(ck, [], "HOME", tables=T.TripTables(end_overrides=ends)).intervals.drop("name_ts")


@query("trips_bicycle", _sql(f"""
, st AS (SELECT iv.*, e.prev_end, o.ts AS ts1, (SELECT max(x.idx) FROM o x WHERE x.user_id = iv.user_id AND x.idx < iv.start_idx AND x.abroad) AS pf
    FROM iv JOIN ends e ON e.user_id = iv.user_id AND e.fp = iv.fp JOIN o ON o.user_id = iv.user_id AND o.idx = iv.start_idx)
, bc AS (SELECT st.user_id, st.fp, st.end_idx, st.ts1, CASE WHEN ts1 % 3 > 0 THEN coalesce((SELECT min(x.idx) FROM o x WHERE x.user_id = st.user_id AND x.idx < st.start_idx AND x.idx > st.prev_end
    AND x.idx > coalesce(st.pf, 0) AND x.ts >= st.ts1 - 14400 AND x.home AND x.category IN {_in(fixed.BICYCLE_START)}), start_idx) ELSE start_idx END AS start_idx FROM st)
SELECT bc.user_id, row_number() OVER (PARTITION BY bc.user_id ORDER BY o.ts, bc.fp) AS trip_id, bc.start_idx, bc.end_idx, o.ts AS start_ts, bc.ts1 AS name_ts
FROM bc JOIN o ON o.user_id = bc.user_id AND o.idx = bc.start_idx WHERE bc.end_idx - bc.start_idx + 1 >= 5""".lstrip(), "SELECT * REPLACE (CASE WHEN ts % 5 < 2 THEN 'Park' ELSE category END AS category) FROM c"))
def _(spark, sf):
    """Trips tagged as rides begin at the park or road passed in the four hours before; their name keeps its key."""
    ck = X.checkins(spark, sf).withColumn("category", F.when(F.col("ts") % 5 < 2, "Park").otherwise(F.col("category")))
    tags = ck.filter("ts % 3 > 0").select(*U, F.col("ts").alias("start_ts")).distinct().withColumn("tags", F.array(F.lit("bicycle")))
    return T.detect(ck, U, "HOME", tables=T.TripTables(tags=tags)).intervals


@query("trips_one_log", _sql("SELECT trip_id, start_idx, end_idx, start_ts FROM trips", "SELECT 0 AS user_id, * EXCLUDE (user_id) FROM c"))
def _(spark, sf):
    return T.detect(X.checkins(spark, sf).drop("user_id"), [], "HOME").intervals.drop("name_ts")


@query("trip_summary", _sql("""
SELECT user_id, trip_id, checkin_count, start_date, end_date, unique_places, min_lat, max_lat, min_lng, max_lng, countries, cities, start_year, duration, name FROM sm""", rows=True))
def _(spark, sf):
    return T.trip_summary(_detect(spark, sf)).drop("tags", "start_idx", "end_idx", "start_ts", "name_ts")


@query("trip_summary_curated", _sql("""
SELECT sm.user_id, sm.trip_id, checkin_count, start_date, end_date, countries, cities, start_year, duration, unique_places, t.start_idx, t.end_idx, t.start_ts, t.start_ts AS name_ts,
  CASE WHEN t.start_ts % 3 = 0 THEN 'Tour ' || CAST(t.start_ts AS VARCHAR) ELSE name END AS name, CASE WHEN t.start_ts % 5 = 0 THEN 'hiking | sea' ELSE '' END AS tags
FROM sm JOIN trips t ON t.user_id = sm.user_id AND t.trip_id = sm.trip_id""", rows=True))
def _(spark, sf):
    """Names and tags from curated tables, with the positions and times of the trips."""
    found = _detect(spark, sf)
    starts = found.intervals.select(*U, "start_ts").distinct()
    names = starts.filter("start_ts % 3 = 0").select(*U, F.col("start_ts").alias("name_ts"), F.concat(F.lit("Tour "), "start_ts").alias("name"))
    tags = starts.filter("start_ts % 5 = 0").withColumn("tags", F.array(F.lit("hiking"), F.lit("sea")))
    return T.trip_summary(T.curated(found, names, tags)).drop("min_lat", "max_lat", "min_lng", "max_lng")


@query("trip_checkins", _sql("""
SELECT user_id, trip_id, idx, ts, checkin_id, strftime(l, '%Y-%m-%d') AS date, strftime(l, '%H:%M') AS time, strftime(l, '%d %b %Y, %H:%M') AS datetime,
  venue, venue_id, city, country, category, round(lat, 5) AS lat, round(lng, 5) AS lng FROM tr""", rows=True))
def _(spark, sf):
    return T.trip_checkins(_detect(spark, sf))


@query("trip_unique_points", _sql("""
SELECT user_id, trip_id, venue_id, round(arg_min(lat, idx), 5) AS lat, round(arg_min(lng, idx), 5) AS lng, arg_min(venue, idx) AS venue
FROM tr WHERE venue_id <> '' GROUP BY 1, 2, 3""", rows=True))
def _(spark, sf):
    return T.trip_unique_points(_detect(spark, sf))


@query("trip_categories", _sql("""
SELECT user_id, trip_id, pos, value AS category, n FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, trip_id ORDER BY n DESC, fi) AS pos FROM fc WHERE facet = 'category') WHERE pos <= 10""", rows=True))
def _(spark, sf):
    return T.trip_categories(_detect(spark, sf))


@query("trip_days", _sql("SELECT user_id, trip_id, strftime(l, '%Y-%m-%d') AS date, count(*) AS n FROM tr GROUP BY 1, 2, 3", rows=True))
def _(spark, sf):
    return T.trip_days(_detect(spark, sf))


@query("route_order", _sql("""
SELECT user_id, trip_id, row_number() OVER (PARTITION BY user_id, trip_id ORDER BY idx) AS pos, ts, round(lat, 5) AS lat, round(lng, 5) AS lng FROM tr""", rows=True))
def _(spark, sf):
    return T.route_order(_detect(spark, sf))


@query("timeline", _sql("""
SELECT user_id, trip_id, name, start_date AS start, end_date AS "end", duration AS days, array_to_string(cl[1:6], ' | ') AS countries, checkin_count AS n, start_year AS year,
  round(greatest(0.0, (epoch(CAST(start_date AS TIMESTAMP)) - epoch(make_timestamp(start_year, 1, 1, 0, 0, 0))) / (epoch(make_timestamp(start_year + 1, 1, 1, 0, 0, 0)) - 1 - epoch(make_timestamp(start_year, 1, 1, 0, 0, 0))) * 100), 3) AS left_pct,
  round(greatest(0.1, (epoch(CAST(end_date AS TIMESTAMP)) + 86399 - epoch(CAST(start_date AS TIMESTAMP))) / (epoch(make_timestamp(start_year + 1, 1, 1, 0, 0, 0)) - 1 - epoch(make_timestamp(start_year, 1, 1, 0, 0, 0))) * 100), 3) AS width_pct
FROM sm""", rows=True))
def _(spark, sf):
    return T.timeline(T.trip_summary(_detect(spark, sf)), U)


@query("timeline_totals", _sql("SELECT user_id, start_year AS year, CAST(sum(checkin_count) AS BIGINT) AS n FROM sm GROUP BY 1, 2", rows=True))
def _(spark, sf):
    return T.timeline_totals(T.trip_summary(_detect(spark, sf)), U)


@query("trip_icons", _sql("""
SELECT sm.user_id, sm.trip_id, sm.name, coalesce(i.icon, '') AS icon, sm.name || ' ' || coalesce(i.icon, '🚗') AS display_name FROM sm LEFT JOIN (
  SELECT user_id, trip_id, CASE max(CASE category WHEN 'Airport' THEN 4 WHEN 'Rail Station' THEN 3 WHEN 'Bus Station' THEN 1 WHEN 'Fuel Station' THEN 0 END)
    WHEN 4 THEN '✈️' WHEN 3 THEN '🚂' WHEN 1 THEN '🚌' WHEN 0 THEN '🚗' END AS icon
  FROM tr WHERE idx < start_idx + 5 OR idx > end_idx - 5 GROUP BY 1, 2) i ON i.user_id = sm.user_id AND i.trip_id = sm.trip_id""", rows=True))
def _(spark, sf):
    t = _detect(spark, sf)
    return T.named_with_icon(t, T.trip_summary(t)).select("user_id", "trip_id", "name", "icon", "display_name")


@query("trip_name_registry", _sql("""
SELECT user_id, name_ts, name FROM (
  SELECT t.user_id, t.start_ts AS name_ts, CASE WHEN t.trip_id % 3 = 0 THEN 'Own name 🚂' ELSE arg_max(sm.name || ' ' || coalesce(i.icon, '🚗'), t.trip_id) END AS name
  FROM trips t JOIN sm ON sm.user_id = t.user_id AND sm.trip_id = t.trip_id LEFT JOIN (
  SELECT user_id, trip_id, CASE max(CASE category WHEN 'Airport' THEN 4 WHEN 'Rail Station' THEN 3 WHEN 'Bus Station' THEN 1 WHEN 'Fuel Station' THEN 0 END)
    WHEN 4 THEN '✈️' WHEN 3 THEN '🚂' WHEN 1 THEN '🚌' WHEN 0 THEN '🚗' END AS icon
  FROM tr WHERE idx < start_idx + 5 OR idx > end_idx - 5 GROUP BY 1, 2) i ON i.user_id = sm.user_id AND i.trip_id = sm.trip_id GROUP BY t.user_id, t.start_ts, t.trip_id)""", rows=True))
def _(spark, sf):
    t = _detect(spark, sf)
    named = T.named_with_icon(t, T.trip_summary(t))
    kept = named.filter("trip_id % 3 < 2").select("user_id", "name_ts", F.when(
        F.col("trip_id") % 3 == 0, "Own name 🚂").otherwise("Own name").alias("name"))
    return T.update_trip_names(kept, named, U)


@query("trip_search", _sql("""
SELECT user_id, trip_id, name, start_year FROM sm WHERE start_year = 2024 AND (lower(name) LIKE '%city 1%' OR lower(countries) LIKE '%city 1%'
  OR len(list_filter(string_split(cities, ' | '), lambda x: lower(x) LIKE '%city 1%')) > 0 OR start_date LIKE '%city 1%')""", rows=True))
def _(spark, sf):
    s = filters.filter_by(T.trip_summary(_detect(spark, sf)), start_year=2024)
    return filters.sort_trips(filters.search(s, filters.TRIP_SEARCH, "city 1"), U, "checkins").select(
        "user_id", "trip_id", "name", "start_year")


@query("raw_runs", f"WITH RECURSIVE {X.checkins_sql()}, {DATED}, log AS (SELECT * FROM c), {_RULES}" + "\nSELECT user_id, fp, lp, s_ts AS start_ts, l_ts AS last_ts FROM runs")
def _(spark, sf):
    marked = T.mark_log(X.checkins(spark, sf), U, "HOME", 5, T.TripTables())
    return T.runs_of(T.link_runs(marked, U), U).select("user_id", "fp", "lp", "start_ts", "last_ts")


@query("order_rows", ck("SELECT user_id, checkin_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, checkin_id) AS idx FROM c"))
def _(spark, sf):
    return O.order_rows(X.checkins(spark, sf).select("user_id", "checkin_id", "ts"), U)


@query("next_markers", ck("""
SELECT user_id, checkin_id, row_number() OVER w AS idx, count(*) OVER (PARTITION BY user_id) AS log_rows,
  coalesce(min(CASE WHEN city = 'HOME' THEN ts END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -1) AS next_home_ts,
  coalesce(max(CASE WHEN city NOT IN ('', 'HOME') THEN ts END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS prev_foreign_ts
FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, checkin_id)"""))
def _(spark, sf):
    rows = O.scan_log(
        X.checkins(spark, sf).select("user_id", "checkin_id", "ts", "city"), U,
        {"home": F.col("city") == "HOME"}, {"foreign": ~F.col("city").isin("", "HOME")}, timed={"home", "foreign"})
    return rows.select("user_id", "checkin_id", "idx", "log_rows", F.coalesce("next_home_ts", F.lit(-1)).alias("next_home_ts"),
                       F.coalesce("prev_foreign_ts", F.lit(-1)).alias("prev_foreign_ts"))
