import math
import random

from pyspark.sql import functions as F

from roamlog.operators import cleaning as C


def kv(spark, rows):
    return spark.createDataFrame(rows, "key string, value string")


def raw(spark, rows):
    base = {"date": "", "city": "", "country": "", "lat": "", "lng": "", "venue_id": "v"}
    return spark.createDataFrame([{**base, **r, "n": i} for i, r in enumerate(rows)],
                                 "date string, city string, country string, lat string, lng string, venue_id string, n long")


def cities(df):
    return [r.city for r in df.orderBy("n").collect()]


def test_merge_folds_apostrophes_and_does_not_follow_chains(spark):
    merge = kv(spark, [("Kazan'", "Kazan"), ("A", "B"), ("B", "C"), ("Raw’s", "Raw")])
    rows = raw(spark, [{"city": c} for c in ["Kazan’", "Kazan‘ ", "A", "B", "Raw’s", "Else", "", " A "]])
    assert cities(C.clean_checkins(rows, C.Mappings(city_merge=merge))) == ["Kazan", "Kazan", "B", "C", "Raw", "Else", "", "B"]


def test_city_override_wins_over_merge_and_inference(spark):
    maps = C.Mappings(kv(spark, [("5", "Land")]), kv(spark, [("5", "A"), ("6", "")]), kv(spark, [("A", "B")]))
    resolver = C.Resolver(kv(spark, [("6", "Wrong"), ("7", "A"), ("8", "Right")]),
                          spark.createDataFrame([], "country string, lat double, lng double, city string, seq long"))
    rows = raw(spark, [{"date": " 5 ", "city": "A", "country": "X"}, {"date": "6"}, {"date": "7"}, {"date": "8", "city": "A"}])
    done = C.clean_checkins(rows, maps, resolver)
    assert cities(done) == ["A", "", "B", "B"]
    assert [r.country for r in done.orderBy("n").collect()] == ["Land", "", "", ""]


def km_north(km):
    return math.degrees(km / 6371.0)


def test_centroid_limits_and_missing_coordinates(spark):
    cen = spark.createDataFrame([("X", 0.0, 0.0, "Mid", 0), ("Y", 0.0, 0.0, "Far", 1)],
                                "country string, lat double, lng double, city string, seq long")
    resolver = C.Resolver(kv(spark, []), cen)
    rows = raw(spark, [
        {"country": "X", "lat": str(km_north(89.9)), "lng": "0"}, {"country": "X", "lat": str(km_north(90.1)), "lng": "0"},
        {"country": "Z", "lat": "0", "lng": "0"}, {"country": "X", "lat": "nan", "lng": "0"},
        {"country": "X", "lat": "", "lng": "0"}, {"country": "X", "lat": "0", "lng": "0"},
    ])
    assert cities(C.clean_checkins(rows, C.Mappings(), resolver)) == ["Mid", "", "", "", "", "Mid"]


def hav(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def test_nearest_matches_brute_force_everywhere(spark):
    rng = random.Random(4)

    def place():
        lat = rng.choice([rng.uniform(-90, 90), rng.uniform(84, 90), rng.uniform(-90, -86), rng.uniform(-1, 1)])
        return lat, rng.choice([rng.uniform(-180, 180), rng.uniform(178, 180), rng.uniform(-180, -178), rng.uniform(-1, 1)])

    cen = [("X", *place(), f"c{i}", i) for i in range(400)]
    pts = [("X", *place()) for _ in range(600)] + [("X", 90.0, 0.0), ("X", -90.0, 10.0), ("X", 0.0, 180.0), ("X", 0.0, -180.0)]
    for max_km in (90.0, 400.0):
        want = {}
        for _, la, ln in pts:
            d, seq, name = min((hav(la, ln, c[1], c[2]), c[4], c[3]) for c in cen)
            if d <= max_km:
                want[la, ln] = name
        got = C.nearest(spark.createDataFrame(pts, "country string, lat double, lng double"),
                        spark.createDataFrame(cen, "country string, lat double, lng double, city string, seq long"), max_km)
        assert {(r.lat, r.lng): r.city for r in got.collect()} == want
        assert len(want) > 50


def test_quarantine_splits_bad_times(spark):
    rows = raw(spark, [{"date": d} for d in ["12", " 13 ", "x", "", "-5", "1.5"]])
    good, bad = C.quarantine(rows)
    assert sorted(r.date for r in bad.collect()) == ["1.5", "x"]
    assert good.count() == 4


def test_category_groups_prefer_exact_then_order(spark):
    groups = {"Food": ["Coffee Shop", "Bar"], "Fun": ["Barn Dance", "coffee"], "Late": ["bar"]}
    names = ["BAR", "Wine Bar", "coffee", "Big Coffee Shop", "Barn", "Zoo", "Barn Dance"]
    df = spark.createDataFrame([(n,) for n in names], "c string").select("c", C.group_of(F.col("c"), groups).alias("g"))
    # "bar" is listed twice: it keeps its early place and takes the later group.
    assert {r.c: r.g for r in df.collect()} == {
        "BAR": "Late", "Wine Bar": "Late", "coffee": "Fun", "Big Coffee Shop": "Food", "Barn": "Late", "Zoo": None,
        "Barn Dance": "Fun",
    }


def test_overlap_states(spark):
    df = spark.createDataFrame([("",), ("-",), ("a",), (None,)], "o string").select(C.overlaps_state(F.col("o")).alias("s"))
    assert [r.s for r in df.collect()] == ["unchecked", "none", "some", "unchecked"]
