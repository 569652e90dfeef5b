import json

import pytest
from pyspark.sql import functions as F

from roamlog.operators import places, tips
from roamlog.schema import CHECKIN_DOC_DDL, CHECKIN_FIELDS, TIP_DOC_DDL
from roamlog.sources import documents as D, readers as R, sinks


def test_csv_with_bom_quotes_line_breaks_and_missing_columns(spark, tmp_path):
    p = tmp_path / "log.csv"
    p.write_text('﻿date,venue,shout,extra\n1,"A ""b""","x,\ny",z\n2,,,\n', encoding="utf-8")
    rows = R.read_checkins(spark, str(p)).orderBy("date").collect()
    assert [(r.date, r.venue, r.shout, r.city) for r in rows] == [("1", 'A "b"', "x,\ny", ""), ("2", "", "", "")]
    assert rows[0].__fields__ == CHECKIN_FIELDS


def test_missing_files_are_empty(spark, tmp_path):
    gone = str(tmp_path / "none")
    assert R.read_checkins(spark, gone).isEmpty() and R.read_tips(spark, gone).isEmpty()
    assert R.read_lookup(spark, gone + ".json").isEmpty() and R.read_groups(spark, gone + ".json", "g") == {}
    assert R.read_settings(spark, gone + ".yaml") == {"home_city": "", "min_checkins": 5}


def test_tips_array_and_broken_file(spark, tmp_path):
    p = tmp_path / "tips.json"
    p.write_text(json.dumps([{"id": "1", "ts": 5, "text": "t", "lat": 1.5, "closed": True}, {"id": "2", "city": None}]))
    got = {r.id: (r.ts, r.lat, r.closed, r.city) for r in R.read_tips(spark, str(p)).collect()}
    assert got == {"1": (5, 1.5, True, None), "2": (None, None, None, None)}
    p.write_text("{ not json")
    assert R.read_tips(spark, str(p)).collect() == []


def test_lookup_kinds(spark, tmp_path):
    y = tmp_path / "m.yaml"
    y.write_text("﻿A: B\n# note\n\"c\": D\nA: E\n", encoding="utf-8")
    assert {r.key: r.value for r in R.read_lookup(spark, str(y)).collect()} == {"A": "E", "c": "D"}
    j = tmp_path / "g.json"
    j.write_text(json.dumps({"groups": {"X": ["a", "b"], "Y": ["a"]}, "tags": {"5": ["bicycle"]}, "list": [7, 8]}))
    got = {(r.group, r.group_ord, r.category, r.cat_ord) for r in R.read_lookup(spark, str(j), "groups", "groups").collect()}
    assert got == {("X", 0, "a", 0), ("X", 0, "b", 1), ("Y", 1, "a", 0)}
    assert [tuple(r) for r in R.read_lookup(spark, str(j), "tags", "tags").collect()] == [(5, ["bicycle"])]
    assert [tuple(r) for r in R.read_lookup(spark, str(j), "list", "list").collect()] == [("7", 0), ("8", 1)]
    s = tmp_path / "s.yaml"
    s.write_text("trip_detection:\n  home_city: Rome\n  min_checkins: 3\n")
    assert R.read_lookup(spark, f"file://{j}", "list", "list").count() == 2
    with pytest.raises(Exception, match="scheme"):
        R.read_lookup(spark, "nosuch://host/a.json")
    assert R.read_settings(spark, str(s)) == {"home_city": "Rome", "min_checkins": 3}


def test_review_rows(spark, tmp_path):
    p = tmp_path / "review.csv"
    p.write_text(
        "﻿decision_source,resolved_city,country,lat,lng,low_volume_checkins_detail\n"
        "BLANK_CITY_INFERRED,Rome,Italy,41.9,12.5,2024-01-01T00:00:00Z::Bar || 2024-01-01T00:00:01Z::A::B || junk || bad::x\n"
        "BLANK_CITY_INFERRED,(BLANK) sea,Italy,1,1,2024-01-01T00:00:02Z::Bar\n"
        "MANUAL,Pisa,Italy,43.7,10.4,2024-01-01T00:00:03Z::Bar\n"
        "BLANK_CITY_INFERRED,Bari,Italy,,,2024-01-01T00:00:01Z::C\n", encoding="utf-8")
    times, centroids = R.read_blank_city_review(spark, str(p))
    assert {r.key: r.value for r in times.collect()} == {"1704067200": "Rome", "1704067201": "Bari"}
    assert [(r.country, r.lat, r.city) for r in centroids.collect()] == [("Italy", 41.9, "Rome")]


def test_world_cities(spark, tmp_path):
    data = '[["Rome",41.9,12.5,2.8,"EU"],["Bari (x]",41.1,16.9,0.3,"EU"]]'
    (tmp_path / "a.json").write_text(data)
    (tmp_path / "b.txt").write_text(f"var q=[[1]];\nconst CITIES={data};\nconst z=[[2]];")
    want = [("Rome", 41.9, 12.5, 2.8, "EU"), ("Bari (x]", 41.1, 16.9, 0.3, "EU")]
    assert [tuple(r) for r in R.read_world_cities(spark, str(tmp_path / "a.json")).collect()] == want
    assert [tuple(r) for r in R.read_world_cities(spark, str(tmp_path / "b.txt"), "CITIES").collect()] == want


def docs(spark, tmp_path, ddl, items):
    p = tmp_path / "docs.json"
    p.write_text("\n".join(json.dumps(i) for i in items))
    return spark.read.schema(ddl).json(str(p))


def test_flatten_checkin_documents(spark, tmp_path):
    full = {
        "id": "c1", "createdAt": 9, "shout": "hi", "user": {"id": "1"}, "createdBy": {"id": "2", "firstName": "Dee", "lastName": "D"},
        "source": {"name": "app", "url": "u"}, "with": [{"id": "3", "firstName": "Ann"}, {"id": "4", "firstName": "Bob", "lastName": "B"}],
        "overlaps": {"items": [{"user": {"id": "5", "firstName": "Cy", "lastName": "C"}}, {}]},
        "venue": {"id": "v", "name": "V", "location": {"city": "Rome", "lat": 1.5, "lng": 2.0},
                  "categories": [{"name": "x"}, {"name": "y", "primary": True}]},
    }
    own = {"id": "c2", "createdAt": 8, "user": {"id": "1"}, "createdBy": {"id": "1", "firstName": "Me"}, "venue": {"categories": [{"name": "x"}]}}
    got = {r.checkin_id: r for r in D.flatten_checkins(docs(spark, tmp_path, CHECKIN_DOC_DDL, [full, own, {}]), "https://x.org").collect()}
    a, b, c = got["c1"], got["c2"], got[""]
    assert (a.date, a.venue_url, a.category, a.with_name, a.with_id, a.created_by_name, a.overlaps_name, a.overlaps_id, a.lat, a.state) == (
        "9", "https://x.org/v/v", "y", "Ann, Bob B", "3, 4", "Dee D", "Cy C", "5", "1.5", "")
    assert (b.created_by_name, b.created_by_id, b.category, b.venue_url, b.with_name) == ("", "", "x", "", "")
    assert set(c) == {""}


def test_flatten_tips_and_venues(spark, tmp_path):
    tip = {"id": "t", "createdAt": 5, "text": " hey\n", "agreeCount": 2, "user": {"id": "7"},
           "venue": {"id": "v", "closed": True, "location": {"lat": 1.123456789, "city": " Rome "}, "categories": []}}
    other = {"id": "u", "user": {"id": "8"}}
    d = docs(spark, tmp_path, TIP_DOC_DDL, [tip, other])
    r = D.flatten_tips(D.owned_by(d, "7")).collect()
    assert [(x.id, x.ts, x.text, x.lat, x.lng, x.city, x.agree_count, x.disagree_count, x.closed, x.category) for x in r] == [
        ("t", 5, "hey", 1.12346, None, "Rome", 2, 0, True, "")]
    assert [x.closed for x in D.flatten_tips(d, closed=True).collect()] == [True, True]
    v = D.flatten_venue(d.filter("id = 't'").select("venue"), F.lit("new"), "https://x.org").first()
    assert (v.venue_id, v.venue_url, v.city, v.lat, v.lng, v.category) == ("new", "https://x.org/v/new", "Rome", "1.123456789", "", "")


def test_newest_venue_document(spark, tmp_path):
    items = [{"id": str(i), "createdAt": i, "venue": {"id": "v", "name": f"N{i}"}} for i in (3, 9, 5)] + [{"id": "x", "venue": {}}]
    got = D.newest_venues(docs(spark, tmp_path, CHECKIN_DOC_DDL, items)).collect()
    assert [(r.doc_venue_id, r.venue.name) for r in got] == [("v", "N9")]


def small_log(spark, n=30):
    rows = [(f"{i}", f"v{i % 3}", str(1_700_000_000 + i), "Pub" if i % 2 else "Bar, \"old\"", i) for i in range(n)]
    df = spark.createDataFrame(rows, "checkin_id string, venue_id string, date string, category string, ts long")
    return df.withColumns({c: F.lit("") for c in CHECKIN_FIELDS if c not in df.columns})


def test_writers(spark, tmp_path):
    log = small_log(spark)
    for fmt in ("csv", "parquet"):
        p = str(tmp_path / fmt)
        sinks.write_checkins(log, p, fmt)
        back = R.read_checkins(spark, p) if fmt == "csv" else R.read_checkins_parquet(spark, p)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, log.select(*CHECKIN_FIELDS).collect()))
    p = str(tmp_path / "payload")
    sinks.write_payload(spark.createDataFrame([(2, "b", None), (1, "a", "x")], "n int, s string, m string"), p, [F.asc("n")])
    assert [json.loads(r.value) for r in spark.read.text(p).collect()] == [{"n": 1, "s": "a", "m": "x"}, {"n": 2, "s": "b", "m": None}]


def test_swap_keeps_readers_whole(spark, tmp_path):
    p = str(tmp_path / "t")
    sinks.write_atomic(spark.range(3), p)
    grown = spark.read.parquet(p).unionAll(spark.range(3, 5))
    sinks.write_atomic(grown, p)
    assert spark.read.parquet(p).count() == 5
    assert [x.name for x in tmp_path.iterdir() if not x.name.startswith(".")] == ["t"]


def test_category_report(spark, tmp_path):
    p = str(tmp_path / "cats")
    sinks.write_category_report(small_log(spark, 5).filter("category <> ''"), p)
    lines = [r.value for r in spark.read.text(p).collect()]
    assert lines == ["FULL CATEGORY LIST", "=" * 60, "Total unique categories: 2", "", '       3  Bar, "old"', "       2  Pub"]


def test_latest_and_uncovered(spark):
    log = small_log(spark)
    assert sorted(r.checkin_id for r in places.latest_by_venue(log).collect()) == ["27", "28", "29"]
    t = spark.createDataFrame([("v1",), ("",)], "venue_id string")
    assert sorted(r.venue_id for r in tips.uncovered_venues(log, t).collect()) == ["v0", "v2"]


def test_broken_tip_lines_are_set_aside(spark, tmp_path):
    p = tmp_path / "tips.json"
    p.write_text('{"id": "1", "ts": 5}\nnot json\n\n{"id": "2", "ts": "x"}\n')
    assert [r.id for r in R.read_tips(spark, str(p), multiline=False).collect()] == ["1"]
    assert sorted(r.line for r in R.broken_tips(spark, str(p)).collect()) == sorted(["not json", '{"id": "2", "ts": "x"}'])


def test_every_tip_array_is_a_file_of_its_own(spark, sf_dir):
    """However the arrays are spread over tasks, none shares a file, where the reader would see only the first."""
    import __spark_entry__ as E

    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert len(E.queries()["read_tips_array"](spark, sf_dir).collect()) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
