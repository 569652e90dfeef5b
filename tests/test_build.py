import json

from pyspark.sql import functions as F

from roamlog import session
from roamlog.functions import scalars as S
from roamlog.operators import cleaning, filters, maintain as M
from roamlog.plans import build as B
from roamlog.sources import readers as R, sinks

BASE, H = 1_700_006_400, 3600


def write_log(path):
    rows = ["date,venue,venue_id,city,country,lat,lng,category,with_name,checkin_id"]
    def add(ts, venue, city, cat, country="Italy"):
        rows.append(f'{ts},{venue},id-{venue},{city},{country},41.9,12.5,{cat},"Ann, Bob",{len(rows):03d}')
    add(BASE, "Airport", "Rome", "Airport")
    for i in range(6):
        add(BASE + (5 + i) * H, f"m{i}", "Bari’s", "Museum")
    add(BASE + 40 * H, "Cafe", "Rome", "Coffee Shop")
    add("oops", "Bad", "Rome", "Bar")
    path.write_text("\n".join(rows) + "\n", encoding="utf-8")


def test_build_from_files(spark, tmp_path):
    cfg = tmp_path / "config"
    cfg.mkdir()
    (cfg / "settings.yaml").write_text("trip_detection:\n  home_city: Rome\n  min_checkins: 5\n")
    (cfg / "city_merge.yaml").write_text("\"Bari's\": Bari\n")
    (cfg / "categories.json").write_text(json.dumps({"category_groups": {"Art": ["museum"]}, "explorer_groups": {"Art": ["Museum"]}}))
    (cfg / "trip_names.json").write_text(json.dumps({"5": "Old one"}))
    write_log(tmp_path / "log.csv")
    out = str(tmp_path / "gold")
    config = B.load_config(spark, str(cfg))
    assert config.resolver is None and config.settings.tables.tags is None
    B.build(spark, R.read_checkins(spark, str(tmp_path / "log.csv")), config, out)

    def read(name):
        return spark.read.parquet(f"{out}/{name}")

    t = read("trips").first()
    assert (t.name, t.checkin_count, t.start_ts, t.cities) == ("Bari, Italy", 7, BASE, ["Bari", "Rome"])
    assert {r.name_ts: r.name for r in read("trip_names").collect()} == {5: "Old one", BASE: "Bari, Italy ✈️"}
    assert [r.venue for r in read("quarantine").collect()] == ["Bad"]
    assert {r.name: r.n for r in read("companions").collect()} == {"Ann": 8, "Bob": 8}
    assert read("category_groups").first().n == 6 and read("explorer").count() == 6
    assert read("summary").first().total == 8 and read("trips_count").first().n == 1


def test_only_own_staged_tables_are_dropped(spark):
    kept = session.stage(spark.range(3), "kept")
    mark = session.staged_count()
    gone = session.stage(spark.range(2), "gone").inputFiles()[0]
    session.drop_staged(spark, after=mark)
    assert kept.count() == 3 and not R.exists(spark, gone)


def test_curated_trip_files(spark, tmp_path):
    (tmp_path / "trip_tags.json").write_text(json.dumps({str(BASE): ["bicycle"]}))
    (tmp_path / "trip_exclude.json").write_text(json.dumps([BASE]))
    (tmp_path / "trip_end_overrides.json").write_text(json.dumps({str(BASE): BASE + 5}))
    (tmp_path / "trip_start_overrides.json").write_text(json.dumps({str(BASE): BASE - 5}))
    t = B.load_config(spark, str(tmp_path)).settings.tables
    assert tuple(t.tags.first()) == (BASE, ["bicycle"]) and t.exclude.first().start_ts == BASE
    assert tuple(t.end_overrides.first()) == (BASE, BASE + 5) and tuple(t.start_overrides.first()) == (BASE, BASE - 5)


def test_country_lookups_and_icons(spark):
    df = spark.createDataFrame([("Italy", "Pub"), ("Atlantis", "Zoo")], "country string, category string")
    got = df.select(S.iso2(F.col("country")), S.continent(F.col("country")), S.flag(F.col("country"))).collect()
    assert [tuple(r) for r in got] == [("it", "EU", "🇮🇹"), ("", "", "🌍")]
    icons = spark.createDataFrame([("Pub", "🍺")], "category string, icon string")
    assert {r.category: r.icon for r in cleaning.category_icons(df, icons).collect()} == {"Pub": "🍺", "Zoo": None}


def test_sorts(spark):
    tips = spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("c", 3, 1)], "id string, ts long, agree_count long")
    assert [r.id for r in filters.sort_tips(tips).collect()] == ["c", "b", "a"]
    assert [r.id for r in filters.sort_tips(tips, "agree").collect()] == ["b", "a", "c"]
    trips = spark.createDataFrame([(1, 5, 9), (2, 7, 1)], "trip_id long, checkin_count long, duration long")
    assert [[r.trip_id for r in filters.sort_trips(trips, [], k).collect()] for k in ("date", "checkins", "days")] == [[1, 2], [2, 1], [1, 2]]
    world = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "name string, pop_m double")
    assert [r.name for r in filters.sort_world(world).collect()] == ["b", "a"]


def test_remap_log(spark):
    df = spark.createDataFrame([("1", "a", "A"), ("2", "b", "B")], "id string, venue_id string, venue string")
    m = spark.createDataFrame([("a", "c", "A")], "old_id string, venue_id string, venue string")
    assert [tuple(r) for r in M.remap_log(df, m, ["id"]).collect()] == [("1", "venue_id", "a", "c")]


def test_anomaly_ledger_file(spark, tmp_path):
    p = str(tmp_path / "ledger")
    rows = spark.createDataFrame([("missing", "a", "20"), ("missing", "b", "3")], "kind string, venue_id string, date string")
    sinks.write_anomalies(rows.coalesce(1), p)
    sinks.write_anomalies(M.merge_anomalies(spark.read.parquet(p), rows.withColumn("date", F.lit("3"))), p)
    assert sorted(tuple(r) for r in spark.read.parquet(p).collect()) == [("missing", "a", "20"), ("missing", "a", "3"), ("missing", "b", "3")]
