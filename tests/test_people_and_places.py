from pyspark.sql import functions as F

from roamlog.operators import companions as P, counters as C, feed as FD, places as V, world as W

DDL = ("checkin_id string, ts long, venue_id string, venue string, city string, country string, category string, lat double, lng double, "
       "with_name string, with_id string, created_by_name string, created_by_id string, overlaps_name string, overlaps_id string")


def log(spark, rows):
    base = dict(venue_id="", venue="", city="", country="", category="", lat=None, lng=None, with_name="", with_id="",
                created_by_name="", created_by_id="", overlaps_name="", overlaps_id="")
    return spark.createDataFrame([{**base, "checkin_id": f"{i:03d}", "ts": 1000 + i, **r} for i, r in enumerate(rows)], DDL)


def test_names_on_one_row(spark):
    df = log(spark, [
        {"with_name": "A, B ,A", "created_by_name": "B", "overlaps_name": "A, C, C, -"}, {"created_by_name": " D "},
        {"overlaps_name": "-"}, {"overlaps_name": "D, E"}])
    assert [r.n for r in df.orderBy("checkin_id").select(P.companion_names().alias("n")).collect()] == [
        ["A", "B", "A", "C"], ["D"], [], ["D", "E"]]
    assert [(r.name, r.n) for r in P.companions(df, k=2).collect()] == [("A", 2), ("D", 2)]


def test_first_id_of_a_name(spark):
    df = log(spark, [
        {"with_name": "A, B", "with_id": "1"}, {"with_name": "B", "with_id": "2", "overlaps_name": "A", "overlaps_id": "9"},
        {"created_by_name": "C", "created_by_id": ""}, {"created_by_name": "C", "created_by_id": "3", "overlaps_name": "C", "overlaps_id": "4"},
        {"overlaps_name": "-", "overlaps_id": "-"}])
    assert {r.name: r.id for r in P.companion_ids(df).collect()} == {"A": "1", "B": "2", "C": "3"}


def test_feed_total_counts_undated_rows(spark):
    df = log(spark, [{"with_name": "A", "country": "Italy"}, {"with_name": "A", "ts": None}, {"with_name": "A", "city": "Rome", "country": "France"}])
    feed = P.companion_feed(df)
    assert [(r.pos, r.total, r.ts) for r in feed.orderBy("pos").collect()] == [(1, 3, 1002), (2, 3, 1000)]
    p = P.companion_profile(feed).first()
    assert (p.places, p.country, p.flag) == ("Rome · Italy", "France", "🇫🇷")


def test_ties_go_to_the_one_seen_first(spark):
    df = log(spark, [{"country": "B", "city": "x"}, {"country": "A", "city": "x"}, {"country": "A", "city": ""}, {"country": "B", "city": "y"}])
    assert [r.name for r in C.top_list(C.countries(df), 5).collect()] == ["B", "A"]
    assert {r.name: r.primary_country for r in C.cities(df).collect()} == {"x": "B", "y": "B"}


def test_first_and_last_seen(spark):
    df = log(spark, [{"venue_id": "v", "venue": "Old", "city": "a"}, {"venue_id": "v", "venue": "New", "city": "b"},
                     {"venue_id": "v", "venue": "Undated", "ts": None}])
    r = V.top_venues(df).first()
    assert (r.name, r.city, r.n) == ("Old", "a", 3)
    assert V.venues_page(df).first().name == "New"


def test_unique_places_by_first_sighting(spark):
    df = log(spark, [
        {"venue_id": "v", "venue": "V"}, {"venue_id": "v", "venue": "V", "lat": 1.0, "lng": 1.0}, {"venue": "P", "lat": 2.0, "lng": 2.0},
        {"venue": "Q", "lat": 2.0000001, "lng": 2.0}, {"venue_id": "w", "venue": "W", "lat": 0.0, "lng": 0.0}])
    assert sorted(r.venue for r in V.unique_places(df).collect()) == ["P", "W"]
    assert V.unique_places_count(df).first().n == 3


def test_invariants_of_counts(spark):
    df = log(spark, [{"venue_id": f"v{i % 7}", "venue": "x", "ts": None if i % 11 == 0 else i * 3_000_000} for i in range(80)])
    dated = df.filter("ts IS NOT NULL").count()
    for fn, key in ((C.by_year, "year"), (C.by_month, "month"), (C.by_hour, "hour"), (C.by_dow, "dow")):
        assert sum(r.n for r in fn(df).collect()) == dated, key
    rate = C.discovery_rate(df).collect()
    assert sum(r.new for r in rate) == 7 and sum(r.new + r.revisit for r in rate) == dated


def test_heatmap_grid_starts_on_monday(spark):
    rows = {r.day: r for r in C.day_heatmap(log(spark, [{"ts": 1_704_067_200}] * 6)).collect()}  # Monday 2024-01-01
    assert len(rows) == 366 and (rows["2024-01-01"].n, rows["2024-01-01"].level, rows["2024-01-01"].week, rows["2024-01-01"].dow) == (6, 3, 0, 0)
    assert (rows["2024-01-08"].week, rows["2024-12-31"].level) == (1, 0)


def test_gaps_and_months(spark):
    df = log(spark, [{"ts": 1_704_067_200 + s, "lat": 0.0, "lng": x} for s, x in ((0, 0.0), (600, 0.001), (7200, 1.0), (3_000_000, 1.0))])
    gaps = [(r.gap, r.gap_label, r.distance) for r in FD.feed_gaps(FD.feed(df)).orderBy(F.desc("ts")).collect()]
    assert gaps == [("none", "", ""), ("lg", "35d later", "0m"), ("sm", "110m later", "111km"), ("none", "", "111m")]
    assert {r.month: r.pos for r in FD.month_index(FD.feed(df)).collect()} == {"2024-02": 0, "2024-01": 1}


def test_world_aliases_in_order_and_continents(spark):
    world = spark.createDataFrame([("Rabat", 1.0, 1.0, 0.5, "AF"), ("Delhi", 1.0, 1.0, 32.9, "AS"), ("rome", 1.0, 1.0, 2.8, "EU")], "name string, lat double, lng double, pop_m double, continent string")
    visited = spark.createDataFrame([("Rabat", 5, "Malta", 1), ("New Delhi", 3, "India", 2), ("Rome", 2, "", 3), ("Dilli", 9, "India", 0)], "name string, n long, primary_country string, first_ts long")
    aliases = W.alias_table(spark, {"Delhi": ["New Delhi", "Dilli"]})
    cont = W.continent_table(spark)
    got = {r.name: (r.visited, r.n, r.display_name) for r in W.match_world_cities(world, visited, aliases, cont).collect()}
    assert got == {"Rabat": (False, 0, "Rabat"), "Delhi": (True, 3, "New Delhi"), "rome": (True, 2, "Rome")}
    exact = {r.name: r.visited for r in W.match_world_cities(world, visited, aliases, cont, ignore_case=False).collect()}
    assert exact == {"Rabat": False, "Delhi": True, "rome": False}
