import random

import pytest
from pyspark.sql import functions as F

from roamlog.operators import ordered as O


def make_log(seed, users=6, rows=400):
    """One user holds a third of the rows; times repeat."""
    rng, out = random.Random(seed), []
    for i in range(rows):
        u = 0 if rng.random() < 0.33 else rng.randrange(1, users)
        out.append((u, rng.randrange(0, 90 * O.DAY, 3600) if u else rng.randrange(0, 5 * O.DAY, 900), f"{i:04d}", rng.choice("abc")))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "u long, ts long, checkin_id string, kind string")


def brute(rows):
    out = {}
    for u in {r[0] for r in rows}:
        log = sorted((r for r in rows if r[0] == u), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(log):
            nxt = next((j for j in range(i + 1, len(log)) if log[j][3] == "a"), None)
            prv = next((j for j in range(i - 1, -1, -1) if log[j][3] == "b"), None)
            out[r[2]] = (i + 1, len(log), nxt and nxt + 1, log[nxt][1] if nxt is not None else None,
                         prv + 1 if prv is not None else None, log[i - 1][2] if i else None)
    return out


@pytest.mark.parametrize("chunk", [None, 3600, 7 * O.DAY, 10**9])
@pytest.mark.parametrize("heavy", [20, 10**6])
def test_scan_log_matches_brute_force(spark, monkeypatch, chunk, heavy):
    monkeypatch.setattr(O, "CHUNK_ROWS", heavy)
    rows = make_log(1)
    df = frame(spark, rows)
    got = O.scan_log(df, ["u"], {"a": F.col("kind") == "a"}, {"b": F.col("kind") == "b"}, timed={"a"}, chunk_seconds=chunk)
    prev = {r.checkin_id: r.prev_checkin_id for r in O.with_previous(df, ["u"], ["checkin_id"], chunk_seconds=chunk).collect()}
    assert {
        r.checkin_id: (r.idx, r.log_rows, r.next_a, r.next_a_ts, r.prev_b, prev[r.checkin_id]) for r in got.collect()
    } == brute(rows)


def test_marks_on_numbered_rows_agree_with_the_scan(spark):
    df = O.order_rows(frame(spark, make_log(2)), ["u"])
    marks = {"a": F.col("kind") == "a"}, {"b": F.col("kind") == "b"}
    one = O.mark_neighbours(df, ["u"], *marks).select("checkin_id", "idx", "next_a", "prev_b")
    two = O.scan_log(df.drop("idx"), ["u"], *marks).select("checkin_id", "idx", "next_a", "prev_b")
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)


def test_a_burst_in_a_quiet_log_is_split(spark, monkeypatch):
    monkeypatch.setattr(O, "CHUNK_ROWS", 20)
    rng = random.Random(5)
    rows = [(1, rng.randrange(4000 * O.DAY), f"q{i:03d}", "a") for i in range(100)]
    rows += [(1, 2000 * O.DAY + rng.randrange(7200), f"x{i:03d}", rng.choice("ab")) for i in range(400)]
    cut = O.with_chunk(frame(spark, rows), ["u"])
    assert max(r["count"] for r in cut.groupBy("_chunk").count().collect()) < 60
    order = [r._chunk for r in cut.orderBy("ts").collect()]
    assert order == sorted(order)
    got = O.scan_log(frame(spark, rows), ["u"], {"a": F.col("kind") == "a"}, {"b": F.col("kind") == "b"}).collect()
    assert {r.checkin_id: (r.idx, r.next_a, r.prev_b) for r in got} == {k: (v[0], v[2], v[4]) for k, v in brute(rows).items()}


def test_heavy_logs_get_narrow_chunks(spark, monkeypatch):
    monkeypatch.setattr(O, "CHUNK_ROWS", 50)
    cut = O.with_chunk(frame(spark, make_log(3)), ["u"]).groupBy("u", "_chunk").count().collect()
    assert max(r["count"] for r in cut if r.u == 0) < 100
    assert len([r for r in cut if r.u == 0]) >= 2
    whole = O.with_chunk(frame(spark, make_log(3)).drop("u"), []).groupBy("_chunk").count().collect()
    assert len(whole) > 3


def test_probes_are_not_numbered(spark):
    rows = [(1, 10, "a", True), (1, 20, "b", True), (1, 20, None, False), (1, 15, None, False), (1, 5, None, False), (1, 99, None, False)]
    df = spark.createDataFrame(rows, "u long, ts long, checkin_id string, real boolean")
    got = {(r.ts, r.real): r.idx for r in O.scan_log(df, ["u"], real=F.col("real")).collect()}
    assert got == {(10, True): 1, (20, True): 2, (20, False): 1, (15, False): 1, (5, False): 0, (99, False): 2}


def test_numbered_positions(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), rng.randrange(5), rng.randrange(200000), f"n{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "g long, n long, t long, name string")
    got = O.numbered(df, ["g"], [O.Desc(F.col("n")), O.chunk_of(F.col("t"))], [F.asc("t"), F.asc("name")], "pos")
    want = {}
    for g in range(3):
        for i, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2], r[3]))):
            want[r[3]] = i + 1
    assert {r.name: r.pos for r in got.collect()} == want


def _functions(rng, n):
    """Functions over states 0, 1, 2; some give one state whatever came before."""
    return [[rng.randrange(3) for _ in range(rng.choice([1, 3, 3, 3]))] for _ in range(n)]


@pytest.mark.parametrize("links", [2, 5, 512])
def test_carried_states(spark, monkeypatch, links):
    monkeypatch.setattr(O, "LINKS", links)
    rng = random.Random(links)
    logs = {u: _functions(rng, n) for u, n in enumerate([1, 2, 7, 40, 130])}
    rows = [(u, k, f, f"x{k}") for u, log in logs.items() for k, f in enumerate(log, 1)]
    rng.shuffle(rows)
    got = O.carried_states(spark.createDataFrame(rows, "user_id long, pos long, step array<int>, name string"), ["user_id"])
    assert got.columns == ["user_id", "pos", "step", "name", "before"]
    want = set()
    for u, log in logs.items():
        state = 0
        for k, f in enumerate(log, 1):
            want.add((u, k, tuple(f), f"x{k}", state))
            state = f[state if len(f) > 1 else 0]
    assert {(r.user_id, r.pos, tuple(r.step), r.name, r.before) for r in got.collect()} == want
    one = O.carried_states(spark.createDataFrame([(1, [2, 0, 1]), (2, [1])], "pos long, step array<int>"), [])
    assert [(r.pos, r.before) for r in one.orderBy("pos").collect()] == [(1, 0), (2, 2)]


def test_no_task_carries_a_whole_log(spark, monkeypatch):
    """One log of 100,000 chunks: every task sweeps under 1 % of them, and all results are right."""
    largest, real = [], O.stage

    def stage(df, name, **options):
        out = real(df, name, **options)
        if name == "groups":
            largest.append(out.groupBy("_g").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(O, "stage", stage)
    n = 100_000
    log = spark.range(n).select((F.col("id") * 7).alias("ts"), F.col("id").cast("string").alias("checkin_id"), (F.col("id") % 1000 == 5).alias("hit"))
    got = O.scan_log(log, [], {"hit": F.col("hit")}, {"hit": F.col("hit")}, timed={"hit"}, chunk_seconds=7)
    i = F.col("ts") / 7
    nxt = i + F.pmod(5 - i, F.lit(1000)) + F.when(F.pmod(i, F.lit(1000)) == 5, 1000).otherwise(0)
    prev = i - F.pmod(i - 5, F.lit(1000)) - F.when(F.pmod(i, F.lit(1000)) == 5, 1000).otherwise(0)
    wrong = got.filter(
        (F.col("idx") != i + 1) | (F.col("log_rows") != n)
        | ~F.col("next_hit").eqNullSafe(F.when(nxt < n, (nxt + 1).cast("long"))) | ~F.col("next_hit_ts").eqNullSafe(F.when(nxt < n, (nxt * 7).cast("long")))
        | ~F.col("prev_hit").eqNullSafe(F.when(prev >= 0, (prev + 1).cast("long"))))
    assert got.count() == n and wrong.count() == 0
    before = O.with_previous(log, [], ["checkin_id"], chunk_seconds=7)
    assert before.filter(~F.col("prev_checkin_id").eqNullSafe(F.when(i > 0, (i - 1).cast("long").cast("string")))).count() == 0
    ranked = O.numbered(log, [], [O.Desc(F.col("ts"))], [F.col("checkin_id")], many=True)
    assert ranked.filter(F.col("rank") != n - i).count() == 0
    assert len(largest) >= 3 and max(largest) < n / 100


@pytest.mark.parametrize("group", [1, 3])
def test_groups_of_chunks_do_not_change_results(spark, monkeypatch, group):
    """Several users, several levels of groups."""
    log = frame(spark, make_log(5))
    marks = {"following": {"a": F.col("kind") == "a"}, "preceding": {"b": F.col("kind") == "b"}, "timed": {"a", "b"}}
    want = sorted(map(tuple, O.scan_log(log, ["u"], **marks).collect()), key=str)
    monkeypatch.setattr(O, "GROUP", group * 20)
    assert sorted(map(tuple, O.scan_log(log, ["u"], chunk_seconds=3600, **marks).collect()), key=str) == want
    assert sorted(map(tuple, O.with_previous(log, ["u"], ["ts", "kind"], chunk_seconds=3600).collect()), key=str) == sorted(
        map(tuple, O.with_previous(log, ["u"], ["ts", "kind"]).collect()), key=str)
