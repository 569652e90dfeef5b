"""Append, merge, diff, patch, remap, anomalies, documents and page mining."""
from __future__ import annotations

from pyspark.sql import functions as F

from roamlog.catalog import query
from roamlog.catalog.views import ck, tips
from roamlog.operators import maintain as M, pages as PG, places as P
from roamlog.sources import documents as D, fixtures as X

_COLS = ["user_id", "checkin_id", "venue_id", "date", "venue", "city"]
_EX = """ex AS (SELECT user_id, checkin_id, venue_id, date, venue, city FROM c WHERE CAST(checkin_id AS BIGINT) % 10 < 7),
  fe AS (SELECT user_id, checkin_id, venue_id, date, 'New ' || venue AS venue, city FROM c WHERE CAST(checkin_id AS BIGINT) % 10 >= 4)"""


def _existing(spark, sf):
    return X.checkins(spark, sf).filter(F.col("checkin_id").cast("bigint") % 10 < 7).select(*_COLS)


def _fetched(spark, sf):
    rows = X.checkins(spark, sf).filter(F.col("checkin_id").cast("bigint") % 10 >= 4).select(*_COLS)
    return rows.withColumn("venue", F.concat(F.lit("New "), "venue"))


def _twins(rows):
    """Rows with a copy of some under another user, at the same venue and second."""
    twin = rows.filter(F.col("checkin_id").cast("bigint") % 4 == 1)
    return rows.unionByName(twin.withColumns({"user_id": F.col("user_id") + 1_000_000, "city": F.concat(F.lit("Twin "), "city")}))


_EXT = """ex0 AS (SELECT user_id, checkin_id, venue_id, date, venue, city FROM c WHERE CAST(checkin_id AS BIGINT) % 10 < 7),
  fe0 AS (SELECT user_id, checkin_id, venue_id, date, 'New ' || venue AS venue, city FROM c WHERE CAST(checkin_id AS BIGINT) % 10 >= 4),
  ex AS (SELECT * FROM ex0 UNION ALL SELECT user_id + 1000000, checkin_id, venue_id, date, venue, 'Twin ' || city FROM ex0 WHERE CAST(checkin_id AS BIGINT) % 4 = 1),
  fe AS (SELECT * FROM fe0 UNION ALL SELECT user_id + 1000000, checkin_id, venue_id, date, venue, 'Twin ' || city FROM fe0 WHERE CAST(checkin_id AS BIGINT) % 4 = 1)"""


@query("new_rows", ck("SELECT * FROM fe WHERE (venue_id, date) NOT IN (SELECT (venue_id, date) FROM ex)", extra=_EX))
def _(spark, sf):
    return M.new_rows(_fetched(spark, sf), _existing(spark, sf))


@query("append_new", ck("SELECT * FROM ex UNION ALL SELECT * FROM fe WHERE (venue_id, date) NOT IN (SELECT (venue_id, date) FROM ex)", extra=_EX))
def _(spark, sf):
    return M.append_new(_existing(spark, sf), _fetched(spark, sf))


@query("full_merge", ck("""
SELECT coalesce(n.user_id, ex.user_id) AS user_id, coalesce(n.checkin_id, ex.checkin_id) AS checkin_id, ex.venue_id, ex.date, coalesce(n.venue, ex.venue) AS venue, coalesce(n.city, ex.city) AS city
FROM ex LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY venue_id, date ORDER BY checkin_id DESC) AS r FROM fe) WHERE r = 1) n ON n.venue_id = ex.venue_id AND n.date = ex.date
UNION ALL SELECT * FROM fe WHERE (venue_id, date) NOT IN (SELECT (venue_id, date) FROM ex)""", extra=_EX))
def _(spark, sf):
    return M.full_merge(_existing(spark, sf), _fetched(spark, sf), seq="checkin_id")


@query("missing_rows", ck("""
SELECT user_id, checkin_id, venue_id, date, venue, city FROM (SELECT *, row_number() OVER (PARTITION BY venue_id, date ORDER BY checkin_id) AS r FROM ex
WHERE (venue_id, date) NOT IN (SELECT (venue_id, date) FROM fe)) WHERE r = 1""", extra=_EX))
def _(spark, sf):
    return M.missing_rows(_existing(spark, sf), _fetched(spark, sf), seq="checkin_id")


@query("full_merge_by_user", ck("""
SELECT ex.user_id, coalesce(n.checkin_id, ex.checkin_id) AS checkin_id, ex.venue_id, ex.date, coalesce(n.venue, ex.venue) AS venue, coalesce(n.city, ex.city) AS city
FROM ex LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, venue_id, date ORDER BY checkin_id DESC) AS r FROM fe) WHERE r = 1) n
  ON n.user_id = ex.user_id AND n.venue_id = ex.venue_id AND n.date = ex.date
UNION ALL SELECT * FROM fe WHERE (user_id, venue_id, date) NOT IN (SELECT (user_id, venue_id, date) FROM ex)""", extra=_EXT))
def _(spark, sf):
    """Users who share a venue and a second keep their own rows."""
    return M.full_merge(_twins(_existing(spark, sf)), _twins(_fetched(spark, sf)), seq="checkin_id", by=["user_id"])


@query("append_new_by_user", ck("SELECT * FROM ex UNION ALL SELECT * FROM fe WHERE (user_id, venue_id, date) NOT IN (SELECT (user_id, venue_id, date) FROM ex)", extra=_EXT))
def _(spark, sf):
    return M.append_new(_twins(_existing(spark, sf)), _twins(_fetched(spark, sf)), by=["user_id"])


@query("missing_rows_by_user", ck("""
SELECT user_id, checkin_id, venue_id, date, venue, city FROM (SELECT *, row_number() OVER (PARTITION BY user_id, venue_id, date ORDER BY checkin_id) AS r FROM ex
WHERE (user_id, venue_id, date) NOT IN (SELECT (user_id, venue_id, date) FROM fe)) WHERE r = 1""", extra=_EXT))
def _(spark, sf):
    return M.missing_rows(_twins(_existing(spark, sf)), _twins(_fetched(spark, sf)), seq="checkin_id", by=["user_id"])


@query("anomalies", ck("""
SELECT kind, venue_id, date, checkin_id FROM (
  SELECT 'missing' AS kind, venue_id, date, min(checkin_id) AS checkin_id FROM ex WHERE (venue_id, date) NOT IN (SELECT (venue_id, date) FROM fe) GROUP BY 2, 3
  UNION ALL SELECT 'duplicate', venue_id, date, max(checkin_id) FROM ex GROUP BY 2, 3 HAVING count(*) > 1
  UNION ALL SELECT 'duplicate', 'old', date, checkin_id FROM ex WHERE city = 'HOME' AND venue_id = 'v8')""", extra=_EX.replace(
    "fe AS", "ex0 AS (SELECT 1), fe AS")))
def _(spark, sf):
    ex, cols = _existing(spark, sf), ["venue_id", "date", "checkin_id"]
    from roamlog.operators.counters import duplicate_rows

    dups = duplicate_rows(ex.select(*cols), M.ROW_KEYS).withColumn("kind", F.lit("duplicate"))
    gone = M.missing_rows(ex, _fetched(spark, sf), seq="checkin_id").select(*cols).withColumn("kind", F.lit("missing"))
    stored = ex.filter("city = 'HOME' AND venue_id = 'v8'").select(*cols)
    ledger = stored.withColumns({"venue_id": F.lit("old"), "kind": F.lit("duplicate")}).unionByName(
        gone.withColumn("checkin_id", F.lit("0")))
    return M.merge_anomalies(ledger, dups.unionByName(gone)).select("kind", *cols)


_SNAP = """old AS (SELECT venue_id, venue, city, country, lat, lng, category FROM (SELECT *, row_number() OVER (PARTITION BY venue_id ORDER BY ts DESC, checkin_id) AS r FROM c
    WHERE venue_id <> '' AND CAST(checkin_id AS BIGINT) % 2 = 0) WHERE r = 1),
  new AS (SELECT venue_id, venue, city, country, lat, lng, category FROM (SELECT *, row_number() OVER (PARTITION BY venue_id ORDER BY ts DESC, checkin_id) AS r FROM c
    WHERE venue_id <> '') WHERE r = 1),
  ch AS (SELECT n.venue_id, n.venue AS name, 'category' AS field, o.category AS old_value, n.category AS new_value FROM old o JOIN new n ON n.venue_id = o.venue_id WHERE o.category <> n.category)"""


def _changes(spark, sf):
    view = X.checkins(spark, sf)
    old = P.latest_by_venue(view.filter(F.col("checkin_id").cast("bigint") % 2 == 0))
    return M.diff_snapshots(old, P.latest_by_venue(view))


@query("diff_snapshots", ck("SELECT * FROM ch", extra=_SNAP))
def _(spark, sf):
    return _changes(spark, sf)


_PATCH = f"{X.checkins_sql()}, c AS (SELECT * FROM ck), {_SNAP}, {X.TIPS_SQL.strip()}"


@query("patch_tips", f"WITH {_PATCH}" + """
SELECT id, venue_id, coalesce(ch.new_value, category) AS category, city FROM tips LEFT JOIN ch USING (venue_id)""")
def _(spark, sf):
    return M.patch(X.tips(spark, sf), _changes(spark, sf))[0].select("id", "venue_id", "category", "city")


@query("patch_log", f"WITH {_PATCH}" + """
SELECT id, venue_id, 'category' AS field, category AS old_value, ch.new_value FROM tips JOIN ch USING (venue_id) WHERE category <> ch.new_value""")
def _(spark, sf):
    return M.patch(X.tips(spark, sf), _changes(spark, sf))[1]


@query("remap_venue", ck("""
SELECT user_id, checkin_id, CASE WHEN CAST(substr(venue_id, 2) AS BIGINT) % 5 = 0 THEN 'w' || venue_id ELSE venue_id END AS venue_id,
  CASE WHEN CAST(substr(venue_id, 2) AS BIGINT) % 5 = 0 THEN 'Merged ' || venue_id ELSE venue END AS venue, city FROM c WHERE venue_id <> ''
UNION ALL SELECT user_id, checkin_id, venue_id, venue, city FROM c WHERE venue_id = ''"""))
def _(spark, sf):
    view = X.checkins(spark, sf).select("user_id", "checkin_id", "venue_id", "venue", "city")
    merged = P.venue_ids(view.withColumn("ts", F.lit(0))).filter(F.substring("venue_id", 2, 9).cast("bigint") % 5 == 0).select(
        F.col("venue_id").alias("old_id"), F.concat(F.lit("w"), "venue_id").alias("venue_id"), F.concat(F.lit("Merged "), "venue_id").alias("venue"))
    return M.remap_venue(view, merged)


_TIP_SETS = """st AS (SELECT id, ts, venue_id, closed FROM tips WHERE CAST(id AS BIGINT) % 10 < 5),
  fx AS (SELECT id, ts + 1 AS ts, venue_id, closed FROM tips WHERE CAST(id AS BIGINT) % 10 BETWEEN 3 AND 6),
  sw AS (SELECT id, ts + 2 AS ts, venue_id, true AS closed FROM tips WHERE CAST(id AS BIGINT) % 10 > 5)"""


@query("merge_tips", tips("""
SELECT * FROM fx UNION ALL SELECT * FROM st WHERE id NOT IN (SELECT id FROM fx)
UNION ALL SELECT * FROM sw WHERE id NOT IN (SELECT id FROM fx) AND id NOT IN (SELECT id FROM st)""", _TIP_SETS))
def _(spark, sf):
    t, i = X.tips(spark, sf).select("id", "ts", "venue_id", "closed"), F.col("id").cast("bigint") % 10
    return M.merge_tips(t.filter(i < 5), t.filter(i.between(3, 6)).withColumn("ts", F.col("ts") + 1),
                        t.filter(i > 5).withColumn("ts", F.col("ts") + 2))


@query("unknown_tip_ids", tips("SELECT id FROM sw WHERE id NOT IN (SELECT id FROM fx)", _TIP_SETS))
def _(spark, sf):
    t, i = X.tips(spark, sf).select("id"), F.col("id").cast("bigint") % 10
    return M.unknown_ids(t.filter(i > 5), t.filter(i.between(3, 6)))


@query("pending_overlaps", ck("SELECT checkin_id, ts FROM c WHERE overlaps_id = ''"))
def _(spark, sf):
    return M.pending_overlaps(X.checkins(spark, sf))


@query("apply_overlaps", ck("""
SELECT user_id, checkin_id, CASE WHEN overlaps_id = '' AND CAST(checkin_id AS BIGINT) % 3 = 0 AND CAST(checkin_id AS BIGINT) % 2 = 0 THEN 'Zed Z' ELSE overlaps_name END AS overlaps_name,
  CASE WHEN overlaps_id <> '' THEN overlaps_id WHEN CAST(checkin_id AS BIGINT) % 3 = 0 THEN CASE WHEN CAST(checkin_id AS BIGINT) % 2 = 0 THEN 'z26' ELSE '-' END
    WHEN CAST(checkin_id AS BIGINT) % 3 = 1 THEN '-' ELSE '' END AS overlaps_id FROM c"""))
def _(spark, sf):
    view = X.checkins(spark, sf).select("user_id", "checkin_id", "overlaps_name", "overlaps_id")
    i = F.col("checkin_id").cast("bigint")
    met = (i % 2) == 0
    responses = view.select(
        "checkin_id", F.when(i % 3 == 0, 200).when(i % 3 == 1, 403).otherwise(500).alias("status"),
        F.when(met, "Zed Z").otherwise("").alias("overlaps_name"), F.when(met, "z26").otherwise("").alias("overlaps_id"))
    return M.apply_overlaps(view, responses)


def _documents(spark, sf):
    """Nested check-in documents built from the log."""
    c = X.checkins(spark, sf)

    def person(i, first, last):
        return F.struct(F.lit(i).alias("id"), F.lit(first).alias("firstName"), F.lit(last).alias("lastName"))

    people = F.when(F.col("with_name") == "Ann A, Bob B", F.array(person("a1", "Ann", "A"), person("b2", "Bob", "B"))).when(
        F.col("with_name") == "Bob B", F.array(person("b2", "Bob", "B")))
    met = F.when(F.col("overlaps_name") == "Ann A, Cy C", F.array(
        F.struct(person("a1", "Ann", "A").alias("user")), F.struct(person("c3", "Cy", "C").alias("user"))))
    owner = F.col("user_id").cast("string")
    creator = F.when(F.col("created_by_name") != "", person("d4", "Dee", "D")).otherwise(
        F.struct(owner.alias("id"), F.lit("Own").alias("firstName"), F.lit("Er").alias("lastName")))
    cats = F.array(F.struct(F.lit("Other").alias("name"), F.lit(False).alias("primary")),
                   F.struct(F.col("category").alias("name"), (F.length("category") % 2 == 0).alias("primary")))
    venue = F.struct(
        F.nullif("venue_id", F.lit("")).alias("id"), F.col("venue").alias("name"), (F.length("city") == 4).alias("closed"),
        F.struct("city", F.lit(None).cast("string").alias("state"), "country", F.lit(None).cast("string").alias("neighborhood"),
                 "lat", "lng", F.lit(None).cast("string").alias("address")).alias("location"), cats.alias("categories"))
    return c.select(
        F.col("checkin_id").alias("id"), F.col("ts").alias("createdAt"), F.lit(None).cast("string").alias("shout"),
        F.struct(owner.alias("id")).alias("user"), creator.alias("createdBy"),
        F.struct(F.lit("app").alias("name"), F.lit("u").alias("url")).alias("source"), people.alias("with"),
        F.struct(met.alias("items")).alias("overlaps"), venue.alias("venue"))


_DOC_CAT = "CASE WHEN length(category) % 2 = 0 THEN category ELSE 'Other' END"


@query("flatten_checkins", ck(f"""
SELECT checkin_id, date, venue_id, CASE WHEN venue_id = '' THEN '' ELSE 'https://example.org/v/' || venue_id END AS venue_url, venue, city, country, CAST(lat AS VARCHAR) AS lat,
  {_DOC_CAT} AS category, with_name, with_id, created_by_name, created_by_id, nullif(overlaps_name, '-') AS overlaps_name, 'app' AS source_app
FROM c WHERE overlaps_name <> '-' UNION ALL
SELECT checkin_id, date, venue_id, CASE WHEN venue_id = '' THEN '' ELSE 'https://example.org/v/' || venue_id END AS venue_url, venue, city, country, CAST(lat AS VARCHAR) AS lat,
  {_DOC_CAT} AS category, with_name, with_id, created_by_name, created_by_id, '' AS overlaps_name, 'app' AS source_app FROM c WHERE overlaps_name = '-'"""))
def _(spark, sf):
    flat = D.flatten_checkins(_documents(spark, sf), "https://example.org")
    return flat.select("checkin_id", "date", "venue_id", "venue_url", "venue", "city", "country", "lat", "category", "with_name",
                       "with_id", "created_by_name", "created_by_id", "overlaps_name", "source_app")


@query("flatten_venue", ck(f"""
SELECT venue_id AS doc_venue_id, venue, CASE WHEN CAST(substr(venue_id, 2) AS BIGINT) % 7 = 0 THEN 'n' || venue_id ELSE venue_id END AS venue_id, city, country, CAST(lat AS VARCHAR) AS lat, {_DOC_CAT} AS category
FROM (SELECT *, row_number() OVER (PARTITION BY venue_id ORDER BY ts DESC, checkin_id) AS r FROM c WHERE venue_id <> '') WHERE r = 1"""))
def _(spark, sf):
    newest = D.newest_venues(_documents(spark, sf))
    new_id = F.when(F.substring("doc_venue_id", 2, 9).cast("bigint") % 7 == 0, F.concat(F.lit("n"), "doc_venue_id")).otherwise("")
    return D.flatten_venue(newest, new_id).select("doc_venue_id", "venue", "venue_id", "city", "country", "lat", "category")


@query("flatten_tips", tips("""
SELECT id, ts, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS text, venue_id, city, round(lat, 5) AS lat, category, agree_count, closed FROM tips WHERE CAST(id AS BIGINT) % 2 = 0"""))
def _(spark, sf):
    t = X.tips(spark, sf)
    docs = t.select(
        "id", F.col("ts").alias("createdAt"), "text", F.col("agree_count").alias("agreeCount"), F.col("disagree_count").alias("disagreeCount"),
        F.struct((F.col("id").cast("bigint") % 2).cast("string").alias("id")).alias("user"),
        F.struct(F.col("venue_id").alias("id"), F.col("venue").alias("name"), "closed",
                 F.struct("city", "country", "lat", "lng").alias("location"),
                 F.array(F.struct(F.col("category").alias("name"), F.lit(None).cast("boolean").alias("primary"))).alias("categories")).alias("venue"))
    return D.flatten_tips(D.owned_by(docs, "0")).select("id", "ts", "text", "venue_id", "city", "lat", "category", "agree_count", "closed")


def _pages(spark, sf):
    """The pages with a data script that holds nested tips, and a static tip link of owner 7."""
    p = X.table(spark, sf, "pages")

    def tip(n, owner):
        return F.struct(F.sha2(F.concat(F.col("page_id").cast("string"), F.lit(n)), 256).substr(1, 24).alias("id"), F.col("url").alias("text"),
                        F.lit(1).alias("createdAt"), F.struct(owner.cast("string").alias("id")).alias("user"))

    owner = F.when(F.col("page_id") % 3 == 0, 7).otherwise(8)
    doc = F.to_json(F.struct(F.struct(F.array(tip("a", owner), tip("b", F.lit(8))).alias("list")).alias("props"), tip("c", owner).alias("one")))
    script = F.concat(F.lit('<script type="application/json" id="__NEXT_DATA__">'), doc, F.lit("</script>"))
    broken = F.lit('<script id="__NEXT_DATA__">{"a": </script>')
    static = F.concat(F.lit('<a data-id="'), F.md5("url").substr(1, 24), F.lit('" href="/user/7">x</a>'))
    link = F.when(F.col("page_id") % 4 == 0, static).otherwise("")
    html = F.concat(link, F.col("html"), F.when(F.col("page_id") % 5 == 4, broken).otherwise(script))
    return p.select("page_id", html.alias("html"))


_SHA = "substr(sha256(CAST(page_id AS VARCHAR) || '{n}'), 1, 24)"
_OWNED = " UNION ALL ".join(
    f"SELECT page_id, {_SHA.format(n=n)} AS id FROM pages WHERE page_id % 5 <> 4 AND page_id % 3 = 0" for n in "ac")
_NEAR = "SELECT page_id, substr(md5(url), 1, 24) AS id FROM pages WHERE page_id % 4 = 0"


@query("embedded_json", """SELECT page_id FROM pages WHERE page_id % 5 <> 4""")
def _(spark, sf):
    return _pages(spark, sf).filter(PG.embedded_json(F.col("html")).isNotNull()).select("page_id")


@query("ids_near", _NEAR)
def _(spark, sf):
    return PG.ids_near(_pages(spark, sf), "/user/7", reach=60)


@query("objects_where", _OWNED)
def _(spark, sf):
    docs = _pages(spark, sf).select("page_id", PG.embedded_json(F.col("html")).alias("doc"))
    return PG.objects_where(docs, "7")


@query("discover_ids", f"""
SELECT DISTINCT id FROM ({_OWNED} UNION ALL {_NEAR}) WHERE id NOT IN (SELECT {_SHA.format(n='a')} FROM pages WHERE page_id % 6 = 0)""")
def _(spark, sf):
    known = X.table(spark, sf, "pages").filter("page_id % 6 = 0").select(
        F.sha2(F.concat(F.col("page_id").cast("string"), F.lit("a")), 256).substr(1, 24).alias("id"))
    return PG.discover_ids(_pages(spark, sf), "7", "/user/7", known)
