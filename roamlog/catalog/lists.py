"""Lists in a checked order with ranks and pages, kept versions and their comparison, and the remaining file readers."""
from __future__ import annotations

from pyspark.sql import functions as F

from roamlog import fixed
from roamlog.catalog import query
from roamlog.catalog.feeds import _FEED, _world_log
from roamlog.catalog.files import _path
from roamlog.catalog.maintenance import _SNAP
from roamlog.catalog.trips import _detect, _sql
from roamlog.catalog.views import ck, tips, world
from roamlog.functions import scalars as S
from roamlog.operators import counters as C, digests as DG, feed as FD, filters, listed as L, maintain as M, places as P, textindex as TX
from roamlog.plans import trips as T
from roamlog.sources import fixtures as X, readers as R, snapshots

U = ["user_id"]


@query("venues_by_name", ck("""
SELECT row_number() OVER (ORDER BY name DESC, venue_id) AS rank, venue_id, name, n FROM (
  SELECT venue_id, count(*) AS n, arg_max(venue, ts) AS name FROM c WHERE venue_id <> '' AND venue <> '' GROUP BY 1)"""))
def _(spark, sf):
    """All venues by name, backwards, with their place in the list."""
    page = P.venues_page(X.checkins(spark, sf), k=1 << 30)
    order = [*P.VENUE_SORTS["name"](-1), F.asc("venue_id")]
    return L.ranked(page, order, range_rows=20).select("rank", "venue_id", "name", "n")


@query("venues_by_years", ck("""
SELECT row_number() OVER (ORDER BY len(ys) DESC, n DESC, venue_id) AS rank, venue_id, n, len(ys) AS years FROM (
  SELECT venue_id, count(*) AS n, list(DISTINCT year(t)) AS ys FROM c WHERE venue_id <> '' AND venue <> '' GROUP BY 1)""", years=5))
def _(spark, sf):
    page = P.venues_page(X.checkins(spark, sf, years=5), k=1 << 30)
    order = [*P.VENUE_SORTS["years"](1), F.asc("venue_id")]
    return L.ranked(page, order, range_rows=20).select("rank", "venue_id", "n", F.size("years").alias("years"))


@query("trips_sorted", _sql("""
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY checkin_count DESC, trip_id) AS rank, trip_id, checkin_count FROM sm""", rows=True))
def _(spark, sf):
    """Each user's trips by size, with their place."""
    order = [F.desc(filters.TRIP_SORTS["checkins"]), F.asc("trip_id")]
    return L.ranked(T.trip_sizes(_detect(spark, sf)), order, U, range_rows=200).select("user_id", "rank", "trip_id", "checkin_count")


@query("tips_sorted", tips("SELECT row_number() OVER (ORDER BY agree_count DESC, ts DESC, id) AS rank, id, agree_count FROM tips"))
def _(spark, sf):
    order = [F.desc("agree_count"), F.desc("ts"), F.asc("id")]
    return L.ranked(X.tips(spark, sf), order, range_rows=100).select("rank", "id", "agree_count")


_PAGES = ", pg AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, checkin_id DESC) AS rank FROM feed)"


def _feed_pages(spark, sf, size=7):
    rows = L.ranked(FD.feed(_world_log(spark, sf), U), [F.desc("ts"), F.desc("checkin_id")], U, range_rows=1000)
    return L.paged(rows, size)


@query("feed_pages", ck("SELECT user_id, checkin_id, ts, date, time, rank, (rank - 1) // 7 + 1 AS page FROM pg", extra=_FEED + _PAGES))
def _(spark, sf):
    """Every row of each user's feed with its place and page, newest first."""
    return _feed_pages(spark, sf).select("user_id", "checkin_id", "ts", "date", "time", "rank", "page")


@query("feed_page_index", ck("""
SELECT user_id, (rank - 1) // 7 + 1 AS page, count(*) AS n, arg_min(ts, rank) AS first_ts, arg_min(checkin_id, rank) AS first_checkin_id FROM pg GROUP BY 1, 2""", extra=_FEED + _PAGES))
def _(spark, sf):
    return L.page_index(_feed_pages(spark, sf), ["ts", "checkin_id"], U)


@query("feed_payloads", ck("""
SELECT user_id, (rank - 1) // 7 + 1 AS page, '[' || string_agg('{"ts":' || ts || ',"date":"' || date || '","venue":"' || venue || '","city":"' || city || '"}', ',' ORDER BY rank) || ']' AS payload
FROM pg GROUP BY 1, 2""", extra=_FEED + _PAGES))
def _(spark, sf):
    """The JSON body of every page."""
    return L.page_payloads(_feed_pages(spark, sf), ["ts", "date", "venue", "city"], U)


_PAIRS = {"same": "a", "more": "(SELECT * FROM a UNION ALL SELECT * FROM a WHERE id % 7 = 0)", "less": "(SELECT * FROM a WHERE id % 7 > 0)",
          "other": "(SELECT id, CASE WHEN id % 50 = 3 THEN city || '!' ELSE city END AS city, venue FROM a)",
          "blank": "(SELECT id, CASE WHEN id % 50 = 3 THEN NULL ELSE city END AS city, venue FROM a)", "swapped": "(SELECT id, venue AS city, city AS venue FROM a)"}
_CHANGED = " UNION ALL ".join(
    f"SELECT '{n}' AS pair, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM {t})) + (SELECT count(*) FROM (SELECT * FROM {t} EXCEPT ALL SELECT * FROM a)) > 0 AS changed"
    for n, t in _PAIRS.items())


@query("has_changed", ck(_CHANGED, extra="a AS (SELECT CAST(checkin_id AS BIGINT) AS id, city, venue FROM c)"))
def _(spark, sf):
    """Pairs of tables: the same rows in another order, more, fewer, other, blanked and swapped values."""
    a = X.checkins(spark, sf).select(F.col("checkin_id").cast("bigint").alias("id"), "city", "venue")
    hit, gone = F.col("id") % 50 == 3, F.lit(None).cast("string")
    pairs = {
        "same": a.repartition(7, "city"), "more": a.unionAll(a.filter("id % 7 = 0")), "less": a.filter("id % 7 > 0"),
        "other": a.withColumn("city", F.when(hit, F.concat("city", F.lit("!"))).otherwise(F.col("city"))),
        "blank": a.withColumn("city", F.when(hit, gone).otherwise(F.col("city"))),
        "swapped": a.select("id", F.col("venue").alias("city"), F.col("city").alias("venue")),
    }
    every = [DG.differs(a, b).select(F.lit(n).alias("pair"), "changed") for n, b in pairs.items()]
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out


def _snapshots(spark, sf):
    view = X.checkins(spark, sf)
    return P.latest_by_venue(view.filter(F.col("checkin_id").cast("bigint") % 2 == 0)), P.latest_by_venue(view)


@query("diff_snapshots_by_digest", ck("SELECT * FROM ch", extra=_SNAP))
def _(spark, sf):
    return DG.diff_snapshots_by_digest(*_snapshots(spark, sf), buckets=256)


@query("diff_kept_versions", ck("SELECT * FROM ch", extra=_SNAP))
def _(spark, sf):
    """Two kept versions of the venues compared by their stored digests."""
    table = DG.DigestedTable(_path(spark, "venues"), buckets=16)
    old, new = (table.write(d.select("venue_id", *M.TRACKED)) for d in _snapshots(spark, sf))
    return table.diff(spark, old, new)


@query("kept_versions", ck("""
SELECT 'first' AS version, country AS name, count(*) AS n FROM c WHERE city = 'HOME' GROUP BY 2 UNION ALL SELECT 'last', country, count(*) FROM c GROUP BY 2"""))
def _(spark, sf):
    """A table replaced while a reader holds on to the version before."""
    view, table = X.checkins(spark, sf), snapshots.Snapshots(_path(spark, "kept"))
    first = table.write(C.countries(view.filter("city = 'HOME'")).drop("first_ts"))
    table.write(C.countries(view).drop("first_ts"))
    return table.read(spark, first).withColumn("version", F.lit("first")).unionByName(table.read(spark).withColumn("version", F.lit("last")))


@query("published_results", ck("""
SELECT 'countries' AS result, country AS key, count(*) AS n FROM c GROUP BY 2 UNION ALL SELECT 'by_hour', CAST(hour(t) AS VARCHAR), count(*) FROM c GROUP BY 2"""))
def _(spark, sf):
    """Several results that become visible together."""
    view, table = X.checkins(spark, sf), snapshots.Snapshots(_path(spark, "results"))
    table.write_all({"countries": C.countries(view).select(F.col("name").alias("key"), "n"),
                     "by_hour": C.by_hour(view).select(F.col("hour").cast("string").alias("key"), "n")})
    names = ("countries", "by_hour")
    one, two = (table.read(spark, table=n).withColumn("result", F.lit(n)) for n in names)
    return one.unionByName(two)


@query("read_world_cities", world("SELECT * FROM world"))
def _(spark, sf):
    """World cities from a file that assigns a nested array to a variable."""
    rows = X.world_cities(spark, sf)
    cells = F.to_json(F.array(*[F.col(c).cast("string") for c in rows.columns]))
    body = rows.agg(F.concat(F.lit("const CITIES = ["), F.array_join(F.collect_list(cells), ","), F.lit("];")).alias("value"))
    path = _path(spark, "world")
    body.coalesce(1).write.text(path)
    return R.read_world_cities(spark, path, "CITIES")


@query("venue_ids_from_urls", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN substr(md5(url), 1, 24) WHEN page_id % 3 = 1 THEN 'place-' || page_id ELSE '' END AS id FROM pages""")
def _(spark, sf):
    """Ids in the urls of venue pages: 24 hexadecimal digits, else the last part; trailing slashes do not count."""
    p = X.table(spark, sf, "pages")
    hexa, plain = F.md5("url").substr(1, 24), F.concat(F.lit("place-"), F.col("page_id").cast("string"))
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" https://example.org/v/name/"), hexa, F.lit("?ref=x"))).when(
        F.col("page_id") % 3 == 1, F.concat(F.lit("https://example.org/v/"), plain, F.lit("//"))).otherwise("")
    return p.select("page_id", S.venue_id_from_url(url).alias("id"))


_PLACES = ["Belarus", "Poland", "Italy", "United States", "Atlantis", ""]


def _label_case(values):
    return "CASE length(venue) * 7 % 6 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


@query("country_labels", ck(f"""
SELECT checkin_id, {_label_case([fixed.COUNTRY_ISO2.get(c, '') for c in _PLACES])} AS iso2, {_label_case([fixed.COUNTRY_CONTINENT.get(c, '') for c in _PLACES])} AS continent,
  {_label_case([fixed.COUNTRY_FLAG.get(c, fixed.DEFAULT_FLAG) for c in _PLACES])} AS flag FROM c"""))
def _(spark, sf):
    at = (F.length("venue") * 7 % 6 + 1).cast("int")
    name = F.element_at(F.array(*map(F.lit, _PLACES)), at)
    return X.checkins(spark, sf).select("checkin_id", S.iso2(name).alias("iso2"), S.continent(name).alias("continent"), S.flag(name).alias("flag"))


def _one_file(spark, df, name):
    """Path of the single text file that holds the one row of ``df``."""
    path = _path(spark, name)
    df.coalesce(1).write.text(path)
    part = next(n for n in snapshots.names_in(spark, path) if n.startswith("part-"))
    return f"{path}/{part}"


@query("lookup_list", ck("SELECT country AS value, row_number() OVER (ORDER BY country) - 1 AS ord FROM (SELECT DISTINCT country FROM c)"))
def _(spark, sf):
    names = X.checkins(spark, sf).agg(F.to_json(F.array_sort(F.collect_set("country"))).alias("value"))
    return R.read_lookup(spark, _one_file(spark, names, "list"), "list")


@query("lookup_groups", ck("""
SELECT g AS "group", dense_rank() OVER (ORDER BY g) - 1 AS group_ord, category, row_number() OVER (PARTITION BY g ORDER BY category) - 1 AS cat_ord
FROM (SELECT DISTINCT 'G' || CAST(length(category) % 3 AS VARCHAR) AS g, category FROM c)"""))
def _(spark, sf):
    pairs = X.checkins(spark, sf).select(F.concat(F.lit("G"), (F.length("category") % 3).cast("string")).alias("g"), "category").distinct()
    lists = pairs.groupBy("g").agg(F.array_sort(F.collect_list("category")).alias("l"))
    body = lists.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("g", "l"))))).alias("value"))
    return R.read_lookup(spark, _one_file(spark, body, "groups"), "groups")


@query("lookup_tags", ck("SELECT DISTINCT user_id AS start_ts, 'a | u' || CAST(user_id AS VARCHAR) AS tags FROM c"))
def _(spark, sf):
    tags = F.array(F.lit("a"), F.concat(F.lit("u"), F.col("user_id").cast("string")))
    body = X.checkins(spark, sf).select("user_id").distinct().agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("user_id").cast("string"), tags)))).alias("value"))
    return R.read_lookup(spark, _one_file(spark, body, "tags"), "tags")


@query("read_tips_array", tips("SELECT id, ts, text, venue, venue_id, city, country, category, lat, lng, agree_count, disagree_count, closed FROM tips"))
def _(spark, sf):
    """Tips from JSON arrays, many files of one array each, every column."""
    rows = X.tips(spark, sf)
    # Arrays of about 2,000 tips, whatever the size of the table.
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(5, rows.count() // 2000))))
    body = rows.groupBy("part").agg(F.to_json(F.collect_list(F.struct(*[c for c in rows.columns if c != "part"])), {"ignoreNullFields": "false"}).alias("value"))
    path = _path(spark, "arrays")
    body.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return R.read_tips(spark, path)


_TERMS = ["UE 7", "City 1", "é", "m", "zzz", "go Ü", ""]
_INDEXED = "(SELECT checkin_id, CASE WHEN CAST(checkin_id AS BIGINT) % 9 = 0 THEN 'Cargo Über ' || venue ELSE venue END AS venue, city, country, CASE WHEN CAST(checkin_id AS BIGINT) % 31 = 0 THEN NULL ELSE category END AS category FROM c)"


@query("search_checkins_indexed", ck(" UNION ALL ".join(
    f"SELECT '{t}' AS term, checkin_id, venue FROM {_INDEXED} WHERE " + " OR ".join(f"coalesce(contains(lower({c}), lower('{t}')), false)" for c in ("venue", "city", "country", "category"))
    for t in _TERMS)))
def _(spark, sf):
    """Searches by the trigram index: several hits, none, short terms, letters beyond ASCII, and a blank one."""
    i = F.col("checkin_id").cast("bigint")
    view = X.checkins(spark, sf).select(
        "checkin_id", F.when(i % 9 == 0, F.concat(F.lit("Cargo Über "), "venue")).otherwise(F.col("venue")).alias("venue"), "city", "country",
        F.when(i % 31 != 0, F.col("category")).alias("category"))
    index = TX.TextIndex(_path(spark, "index"), tuple(filters.CHECKIN_SEARCH))
    index.write(view)
    found = [index.search(spark, t).select(F.lit(t).alias("term"), "checkin_id", "venue") for t in _TERMS]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
