import random

import pytest
from pyspark.sql import functions as F

from roamlog.operators import ordered as O
from roamlog.plans import trips as T
from trip_model import Row, Rules, Walk

BASE = 1_700_006_400  # a UTC midnight
H = 3600
CATS = [
    "Airport", "Rail Station", "Bus Station", "Home (private)", "Neighborhood", "Fuel Station", "Bus Line",
    "Park", "Road", "Pub", "Coffee Shop", "Museum", "Parking",
]


def frame(spark, logs):
    rows = [
        (u, f"{i:05d}", r.ts, r.city, r.category, r.venue_id, "V" + r.venue_id, "C" + r.city if r.city else "", 1.0, 2.0)
        for u, log in logs.items() for i, r in enumerate(log)
    ]
    return spark.createDataFrame(
        rows, "user_id long, checkin_id string, ts long, city string, category string, venue_id string, "
        "venue string, country string, lat double, lng double"
    )


def table(spark, schema, rows):
    return spark.createDataFrame(rows, schema) if rows else None


def tables(spark, rules):
    """Curated tables of all users from ``{user: Rules}``."""
    ends = [(u, k, v) for u, r in rules.items() for k, v in r.ends.items()]
    starts = [(u, k, v) for u, r in rules.items() for k, v in r.starts.items()]
    tags = [(u, k, ["bicycle"]) for u, r in rules.items() for k in r.bicycle]
    excl = [(u, k) for u, r in rules.items() for k in r.exclude]
    return T.TripTables(
        end_overrides=table(spark, "user_id long, start_ts long, end_ts long", ends),
        start_overrides=table(spark, "user_id long, start_ts long, new_start_ts long", starts),
        tags=table(spark, "user_id long, start_ts long, tags array<string>", tags),
        exclude=table(spark, "user_id long, start_ts long", excl),
    )


def detect(spark, logs, rules=None, minimum=5, **kw):
    t = T.detect(frame(spark, logs), ["user_id"], "H", minimum, tables(spark, rules or {}), **kw)
    out = {}
    for r in t.intervals.orderBy("user_id", "trip_id").collect():
        out.setdefault(r.user_id, []).append((r.start_idx - 1, r.end_idx - 1, r.name_ts))
    return out


def random_log(rng, n):
    ts, log, city = BASE + rng.randrange(86400), [], "H"
    for _ in range(n):
        ts += rng.choice([0, 600, 1800, H, 2 * H, 3 * H, 5 * H, 11 * H, 24 * H])
        if rng.random() < 0.35:
            city = rng.choice(["H", "H", "", "X", "Y"])
        log.append(Row(ts, city, rng.choice(CATS), rng.choice(["", "a", "b"])))
    return log


def with_distinct_times(log):
    for a, b in zip(log, log[1:]):
        if b.ts <= a.ts:
            b.ts = a.ts + 1
    return log


def test_random_logs_match_the_row_by_row_model(spark):
    rng = random.Random(7)
    logs = {u: random_log(rng, rng.randrange(1, 90)) for u in range(300)}
    want = {u: Walk(log, Rules()).trips() for u, log in logs.items()}
    got = detect(spark, logs)
    assert sum(map(len, want.values())) > 300
    assert {u: w for u, w in want.items() if w} == got


def test_random_logs_with_curated_tables(spark):
    rng = random.Random(11)
    logs, rules = {}, {}
    for u in range(250):
        log = with_distinct_times(random_log(rng, rng.randrange(10, 80)))
        logs[u], rules[u] = log, Rules()
        for _ in range(3):
            plain = Walk(log, rules[u]).trips()
            if not plain:
                break
            for s, e, name in plain:
                if rng.random() < 0.4:
                    rules[u].ends[log[s].ts] = log[e].ts + rng.choice([0, H, 20 * H, 60 * H])
                if rng.random() < 0.3:
                    rules[u].starts[log[s].ts] = log[s].ts - rng.choice([H, 10 * H, 50 * H])
                if rng.random() < 0.4:
                    rules[u].bicycle.add(name)
            if rng.random() < 0.3:
                rules[u].exclude.add(log[plain[0][0]].ts)
    want = {u: Walk(log, rules[u]).trips() for u, log in logs.items()}
    assert {u: w for u, w in want.items() if w} == detect(spark, logs, rules)


def dominoes(n):
    """Runs two days apart, each with a hub a few hours before it. A run that begins at its first row (its hub is taken)
    is made to end behind the next hub; the first run is forced to, so all others follow. Without that none does."""
    log, rules = [], Rules()
    for k in range(n + 1):
        t = BASE + k * 100 * H
        log += [home(t, "Airport", f"a{k}")] * (k > 0) + away(t + 5 * H, 5)
        rules.ends[t + 5 * H] = t + 100 * H
    return log, rules


def test_chains_of_forced_ends(spark):
    """Chains of 2 and of 40: the model's trips, from the same number of jobs."""
    jobs = {}
    for n in (2, 40):
        log, rules = dominoes(n)
        loose = Rules(ends={k: v for k, v in rules.ends.items() if k > BASE + 5 * H})
        spark.sparkContext.setJobGroup(f"chain-{n}", "chain")
        got = detect(spark, {1: log, 2: log}, {1: rules, 2: loose})
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain-{n}"))
        assert got == {1: Walk(log, rules).trips(), 2: Walk(log, loose).trips()}
        assert got[1][-1][0] == got[2][-1][0] + 1 and len(got[1]) == n + 1
    spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs[2] == jobs[40]


def test_chain_over_several_groups(spark, monkeypatch):
    monkeypatch.setattr(O, "LINKS", 4)
    log, rules = dominoes(30)
    assert detect(spark, {1: log}, {1: rules}) == {1: Walk(log, rules).trips()}


def test_chunk_width_does_not_change_trips(spark):
    rng = random.Random(3)
    logs = {u: random_log(rng, 60) for u in range(40)}
    assert detect(spark, logs, chunk_seconds=3600) == detect(spark, logs, chunk_seconds=10**9)


def away(t0, n, city="X", step=H, category="Museum"):
    return [Row(t0 + i * step, city, category, f"x{i}") for i in range(n)]


def home(ts, category="Coffee Shop", venue="h"):
    return Row(ts, "H", category, venue)


SCENARIOS = {
    "plain run": ([home(BASE)] + away(BASE + 30 * H, 5) + [home(BASE + 90 * H)], [(1, 5)]),
    "four away rows plus one hub": (
        [home(BASE + 28 * H, "Airport")] + away(BASE + 30 * H, 4) + [home(BASE + 90 * H)], [(0, 4)]),
    "hubs two hours apart chain": (
        [home(BASE, "Bus Station", "b"), home(BASE + 2 * H, "Airport", "a")] + away(BASE + 5 * H, 5), [(0, 6)]),
    "hubs four hours apart do not": (
        [home(BASE, "Bus Station", "b"), home(BASE + 4 * H, "Airport", "a")] + away(BASE + 5 * H, 5), [(1, 6)]),
    "same station twice keeps the later visit": (
        [home(BASE, "Bus Station", "b"), home(BASE + H, "Bus Station", "b")] + away(BASE + 5 * H, 5), [(1, 6)]),
    "hub exactly a day before": ([home(BASE, "Airport")] + away(BASE + 24 * H, 5), [(0, 5)]),
    "hub more than a day before": ([home(BASE, "Airport")] + away(BASE + 25 * H, 5), [(1, 5)]),
    "bus line wins over fuel": (
        [home(BASE, "Bus Line"), home(BASE + 2 * H, "Fuel Station")] + away(BASE + 3 * H, 5), [(0, 6)]),
    "late bus line is not replaced by fuel": (
        [home(BASE, "Bus Line"), home(BASE + 4 * H, "Fuel Station")] + away(BASE + 5 * H, 5), [(2, 6)]),
    "arrival hub is not a departure hub again": (
        away(BASE, 5) + [home(BASE + 6 * H, "Airport")] + away(BASE + 9 * H, 5), [(0, 5), (6, 10)]),
    "neighborhood ends a trip": (away(BASE, 5) + [home(BASE + 6 * H, "Neighborhood")], [(0, 5)]),
    "home before the neighborhood": (
        away(BASE, 5) + [home(BASE + 20 * H, "Home (private)"), home(BASE + 21 * H, "Neighborhood")], [(0, 4)]),
    "home six hours after the hub": (
        away(BASE, 5) + [home(BASE + 5 * H, "Airport"), home(BASE + 11 * H, "Home (private)")], [(0, 5)]),
    "home six hours after a drive": (away(BASE, 5) + [home(BASE + 10 * H, "Home (private)")], [(0, 5)]),
    "a pub on the way": (
        away(BASE, 5) + [home(BASE + 6 * H, "Pub"), home(BASE + 7 * H, "Home (private)")], [(0, 4)]),
    "blank rows alone make a run": ([home(BASE)] + away(BASE + 30 * H, 5, city=""), [(1, 5)]),
    "too short": ([home(BASE)] + away(BASE + 30 * H, 3), []),
    "overlapping trips": (
        away(BASE, 5) + [home(BASE + 5 * H)] + away(BASE + 6 * H, 5) + [home(BASE + 12 * H, "Airport")],
        [(0, 11), (6, 11)]),
}


def test_scenarios(spark):
    names = list(SCENARIOS)
    got = detect(spark, {i: SCENARIOS[n][0] for i, n in enumerate(names)})
    assert {n: [x[:2] for x in got.get(i, [])] for i, n in enumerate(names)} == {
        n: SCENARIOS[n][1] for n in names
    }


def test_membership_covers_long_intervals(spark, monkeypatch):
    monkeypatch.setattr(T, "_SLOT", 4)
    monkeypatch.setattr(T, "_BLOCK", 16)
    logs = {1: away(BASE, 150), 2: SCENARIOS["overlapping trips"][0]}
    t = T.detect(frame(spark, logs), ["user_id"], "H")
    got = {(r.user_id, r.trip_id): r.n for r in T.membership(t).groupBy("user_id", "trip_id").agg(
        F.count_distinct("idx").alias("n")).collect()}
    assert got == {(1, 1): 150, (2, 1): 12, (2, 2): 6}


def test_single_log_without_keys(spark):
    log = SCENARIOS["plain run"][0]
    t = T.detect(frame(spark, {1: log}).drop("user_id"), [], "H")
    assert [(r.start_idx, r.end_idx, r.trip_id) for r in t.intervals.collect()] == [(2, 6, 1)]
    s = T.trip_summary(t).collect()[0]
    assert (s.name, s.checkin_count, s.duration, s.cities) == ("X, CX", 5, 1, ["X"])


def test_names_tags_and_registry(spark):
    log = {1: [home(BASE, "Airport")] + away(BASE + 5 * H, 5), 2: away(BASE, 5, city=""), 3: away(BASE, 6)}
    t = T.detect(frame(spark, log), ["user_id"], "H", tables=T.TripTables(
        names=spark.createDataFrame([(3, BASE, "Ride 🚗")], "user_id long, name_ts long, name string"),
        tags=spark.createDataFrame([(3, BASE, ["bicycle"])], "user_id long, start_ts long, tags array<string>"),
    ))
    s = T.trip_summary(t)
    named = T.named_with_icon(t, s)
    got = {r.user_id: (r.name, r.display_name, r.tags) for r in named.collect()}
    assert got == {
        1: got[1], 2: ("Unknown", "Unknown 🚗", []),
        3: ("Ride 🚗", "Ride", ["bicycle"]),
    }
    assert got[1][1].endswith(" ✈️")
    reg = spark.createDataFrame([(1, BASE, "Kept ✈️"), (3, BASE, "Ride 🚗"), (9, 5, "old")], "user_id long, name_ts long, name string")
    out = {(r.user_id, r.name_ts): r.name for r in T.update_trip_names(reg, named, ["user_id"]).collect()}
    assert out == {(1, BASE): "Kept ✈️", (2, BASE): "Unknown 🚗", (3, BASE): "Ride", (9, 5): "old"}


@pytest.mark.parametrize("n, want", [(0, "Rome"), (1, "Rome, A"), (2, "A & B"), (4, "A + B + 2 more")])
def test_auto_name(spark, n, want):
    df = spark.createDataFrame([(list("ABCD"[:n]), ["Rome"])], "c array<string>, t array<string>")
    assert df.select(T.auto_name(F.col("c"), F.col("t"))).first()[0] == want


def test_curated_summary_finds_the_trips_once(spark, sf_dir, monkeypatch):
    import __spark_entry__ as E
    from roamlog.plans import trips as T

    calls, mark = [], T.mark_log
    monkeypatch.setattr(T, "mark_log", lambda *a, **k: (calls.append(1), mark(*a, **k))[1])
    rows = E.queries()["trip_summary_curated"](spark, sf_dir).collect()
    assert rows and len(calls) == 1
    ride = spark.createDataFrame([(1, 5, ["bicycle"])], "user_id long, start_ts long, tags array<string>")
    with pytest.raises(ValueError, match="detect"):
        T.curated(T.Trips(["user_id"], ride, ride, T.TripTables()), tags=ride)


def test_sizes_are_those_of_the_summary(spark):
    logs = {i: random_log(random.Random(i), 150) for i in range(6)}
    logs |= {9: SCENARIOS["overlapping trips"][0], 10: away(BASE, 5), 11: [home(BASE)]}
    t = T.detect(frame(spark, logs), ["user_id"], "H")
    keys = ["user_id", "trip_id", "checkin_count"]
    sizes = {tuple(r) for r in T.trip_sizes(t).select(*keys).collect()}
    assert len(sizes) > 10 and sizes == {tuple(r) for r in T.trip_summary(t).select(*keys).collect()}


def test_sorted_trips_read_no_rows_of_trips(spark, sf_dir, monkeypatch):
    import __spark_entry__ as E
    from roamlog.plans import trips as T

    monkeypatch.setattr(T, "_trip_rows", None)
    assert E.queries()["trips_sorted"](spark, sf_dir).count() > 0
