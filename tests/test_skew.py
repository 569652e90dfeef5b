"""Joins on crowded keys, comparison by digests, lists in order."""
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from roamlog.operators import digests as D, feed, listed as L, maintain as M, ordered as O, skew


def test_a_busy_place_does_not_fill_a_task(spark):
    """Half of all rows at one place and hour, a tenth without a place: all rows kept, tasks even."""
    n = 20_000
    i = F.col("id")
    log = spark.range(n).select(
        F.col("id").cast("string").alias("checkin_id"), (1_700_000_000 + F.when(i % 2 == 0, 0).otherwise(i * 977)).alias("ts"), F.lit("Belarus").alias("country"),
        F.when(i % 2 == 0, 10.0).when(i % 10 != 1, (i % 97) / 2.0).alias("lat"), F.when(i % 10 != 1, 20.0).alias("lng"))
    hourly = spark.createDataFrame([(10.0, 20.0, "2023-11-14", h, 1.5, 3) for h in range(24)] + [(None, None, "2023-11-14", 1, 9.0, 0)],
                                   "lat1 double, lng1 double, utc_date string, hour int, temp double, code int")
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = feed.weather_join(log, hourly)
        sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep[0])
        spark.conf.set("spark.sql.adaptive.enabled", keep[1])
    assert sum(sizes) == n and sizes[-1] < 2 * sizes[len(sizes) // 2]
    assert got.filter("temp IS NOT NULL").count() == log.filter("lat = 10 AND lng = 20 AND ts = 1700000000").count()
    assert got.filter("lat1 IS NULL" if "lat1" in got.columns else "temp = 9.0").count() == 0


def test_skewed_join_equals_the_plain_one(spark):
    rng = random.Random(4)
    left = spark.createDataFrame([(k, rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice(["a", None])) for k in range(3000)], "id long, x long, y string")
    right = spark.createDataFrame([(1, "a", 10), (1, "a", 11), (2, "a", 12), (9, "a", 13), (None, "a", 14)], "x long, y string, v long")
    got = skew.left_join_skewed(left, right, ["x", "y"], ["id"])
    want = left.join(right, ["x", "y"], "left")
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(tuple(r) for r in got.select("id", "x", "y", "v").collect()) == Counter(tuple(r) for r in want.select("id", "x", "y", "v").collect())


VENUES = [(f"v{k}", f"Name {k}", "Rome", "Italy", 1.0 * k, 2.0, "Park") for k in range(400)]
VENUE_DDL = "venue_id string, venue string, city string, country string, lat double, lng double, category string"


def edited(changes):
    return [tuple(changes.get(r[0], {}).get(c, v) for c, v in zip(VENUE_DDL.replace(" string", "").replace(" double", "").split(", "), r)) for r in VENUES]


@pytest.mark.parametrize("changes", [{}, {"v7": {"city": "Milan"}}, {f"v{k}": {"category": "Pub", "lat": None} for k in range(0, 400, 37)}])
def test_diff_by_digest(spark, tmp_path, changes):
    old, new = spark.createDataFrame(VENUES, VENUE_DDL), spark.createDataFrame(edited(changes)[::-1] + [("new", *VENUES[0][1:])], VENUE_DDL)
    want = Counter(tuple(r) for r in M.diff_snapshots(old, new).collect())
    assert Counter(tuple(r) for r in D.diff_snapshots_by_digest(old, new, buckets=48).collect()) == want
    table = D.DigestedTable(str(tmp_path / "t"), buckets=48)
    v1, v2 = table.write(old), table.write(new)
    assert Counter(tuple(r) for r in table.diff(spark, v1, v2).collect()) == want
    assert 1 <= len(table.changed_buckets(spark, v1, v2)) <= 1 + len(changes)
    v3 = table.write(new.repartition(5))
    assert table.changed_buckets(spark, v2, v3) == [] and table.diff(spark, v2, v3).count() == 0


def test_only_unequal_buckets_are_read(spark, tmp_path):
    table = D.DigestedTable(str(tmp_path / "t"), buckets=16)
    v1 = table.write(spark.createDataFrame(VENUES, VENUE_DDL))
    v2 = table.write(spark.createDataFrame(edited({"v7": {"city": "Milan"}}), VENUE_DDL))
    assert len(table.changed_buckets(spark, v1, v2)) == 1
    scans = [line for line in table.diff(spark, v1, v2)._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
    assert len(scans) == 2 and all(re.search(r"PartitionFilters: \[[^]]*_bucket", line) for line in scans)


def test_digests_tell_multisets_apart(spark):
    ddl = "a string, b string, c double"
    base = [("x", "y", 1.0), ("x", "y", 1.0), (None, "y", 0.0), ("y", None, None)]

    def changed(rows, other=base):
        return M.has_changed(spark.createDataFrame(other, ddl), spark.createDataFrame(rows, ddl))

    assert not changed(base[::-1]) and not changed([("x", "y", 1.0), *base[1:2], (None, "y", -0.0), base[3]])
    for rows in (base[1:], base + base[:1], base[:2] + [("y", None, 0.0), base[3]], [("y", "x", 1.0), *base[1:]], []):
        assert changed(rows) and changed(base, rows)
    assert not changed([], [])


@pytest.mark.parametrize("group", [2, 512])
def test_ranks_and_pages(spark, monkeypatch, group):
    """Ranks by text and number, both ways, with ties and blanks, over many ranges."""
    monkeypatch.setattr(O, "GROUP", group)
    rng = random.Random(group)
    rows = [(rng.choice("uvw"), rng.choice([None, "", "a", "b", "Éa", "zz"]), rng.randrange(5), k) for k in range(700)]
    df = spark.createDataFrame(rows, "u string, name string, n long, id long")
    got = L.ranked(df, [F.desc("n"), F.asc("name"), F.desc("id")], ["u"], range_rows=40)
    want = set()
    for u in "uvw":
        mine = sorted((r for r in rows if r[0] == u), key=lambda r: (-r[2], r[1] is not None, (r[1] or "").encode(), -r[3]))
        want |= {(*r, k) for k, r in enumerate(mine, 1)}
    assert {tuple(r) for r in got.collect()} == want
    pages = L.paged(got, 25)
    index = {(r.u, r.page): (r.n, r.first_id) for r in L.page_index(pages, ["id"], ["u"]).collect()}
    assert index == {(u, p): (sum(w[0] == u and (w[4] - 1) // 25 + 1 == p for w in want), next(w[3] for w in want if w[0] == u and w[4] == 25 * p - 24)) for u, p in index}
    assert sum(n for n, _ in index.values()) == 700
    assert L.ranked(df.limit(0), [F.asc("id")]).count() == 0


def test_short_ranges_grow_with_a_long_list(spark, monkeypatch):
    """Ranges asked for by a few rows are no more than shuffle partitions, until these would hold too many rows."""
    from roamlog import session

    def ranges(n, rows):
        before = session.staged_count()
        got = L.ranked(spark.range(n), [F.desc("id")], range_rows=rows)
        assert got.count() == n and got.filter(F.col("rank") != n - F.col("id")).count() == 0
        return max(len(spark.read.parquet(p).inputFiles()) for p in session._WRITTEN[before:] if "/ranges-" in p)

    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 1 < ranges(most * 10, 20) <= most
    assert ranges(most * 400, 10) <= most
    monkeypatch.setattr(L, "RANGE_ROWS", 100)
    assert most < ranges(most * 400, 10) <= most * 4
