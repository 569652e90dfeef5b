import json
import os

import pytest
from pyspark.sql import functions as F

from roamlog.sources.snapshots import Snapshots, StaleBase
from roamlog.streaming import ingest
from roamlog.streaming.runs import UserResults


def doc(i, venue, ts, user="u"):
    return {"user_id": user, "id": str(i), "createdAt": ts, "user": {"id": user}, "venue": {"id": venue, "name": "N" + venue}}


DOCS = [doc(i, f"v{i % 4}", 1_700_000_000 + i * 60, f"u{i % 4}") for i in range(40)]


def land(path, batches):
    path.mkdir(exist_ok=True)
    for i, b in enumerate(batches):
        (path / f"{i:03d}-{len(list(path.iterdir()))}.json").write_text("\n".join(map(json.dumps, b)))


def drain(spark, landed, store, offsets, refresh=None, **kw):
    stream = ingest.stream_checkins(spark, str(landed), max_files=1, **kw)
    ingest.run(stream, store, str(offsets), refresh).awaitTermination()


def keys(spark, store):
    return sorted((r.venue_id, r.date) for r in store.read(spark).collect())


def test_split_batches_equal_one_batch(spark, tmp_path):
    want = sorted((d["venue"]["id"], str(d["createdAt"])) for d in DOCS)
    for name, batches in {"one": [DOCS], "many": [DOCS[:7], DOCS[5:20], DOCS[20:], DOCS[:3]]}.items():
        store = ingest.LogStore(str(tmp_path / f"store-{name}"), fanout=2)
        land(tmp_path / name, batches)
        drain(spark, tmp_path / name, store, tmp_path / f"off-{name}")
        assert keys(spark, store) == want


def test_late_rows_and_other_users_are_stored_at_default_settings(spark, tmp_path):
    store = ingest.LogStore(str(tmp_path / "store"))
    land(tmp_path / "in", [[doc(1, "v", 1_700_000_000)], [doc(2, "v", 1_600_000_000)], [doc(3, "v", 1_700_000_000, "w"), doc(4, "v", 1_700_000_000)]])
    drain(spark, tmp_path / "in", store, tmp_path / "off")
    assert sorted((r.user_id, r.date) for r in store.read(spark).collect()) == [
        ("u", "1600000000"), ("u", "1700000000"), ("w", "1700000000")]


def test_restart_continues_and_late_rows_are_merged(spark, tmp_path):
    store = ingest.LogStore(str(tmp_path / "store"))
    land(tmp_path / "in", [DOCS[20:]])
    drain(spark, tmp_path / "in", store, tmp_path / "off")
    land(tmp_path / "in", [DOCS[:25]])
    drain(spark, tmp_path / "in", store, tmp_path / "off")
    assert len(keys(spark, store)) == 40


def test_failed_refresh_is_repeated_for_the_same_users(spark, tmp_path):
    store, out = ingest.LogStore(str(tmp_path / "store"), fanout=2), UserResults(str(tmp_path / "counts"), fanout=2)
    seen = []
    replace = ingest.refresher(lambda rows: rows.groupBy("user_id").agg(F.count("*").alias("n")), out)

    def failing(rows, touched):
        seen.append(sorted(r.user_id for r in touched.collect()))
        if len(seen) == 1:
            raise RuntimeError("lost")
        replace(rows, touched)

    land(tmp_path / "in", [DOCS[:10]])
    with pytest.raises(Exception, match="lost"):
        drain(spark, tmp_path / "in", store, tmp_path / "off", failing)
    drain(spark, tmp_path / "in", store, tmp_path / "off", failing)
    assert seen[0] == seen[1] == ["u0", "u1", "u2", "u3"] and len(keys(spark, store)) == 10
    land(tmp_path / "in", [[doc(99, "v1", 1_800_000_000, "u1")]])
    drain(spark, tmp_path / "in", store, tmp_path / "off", failing)
    assert seen[2] == ["u1"]
    assert {r.user_id: r.n for r in out.results(spark).collect()} == {"u0": 3, "u1": 4, "u2": 2, "u3": 2}
    assert {r.user_id for r in store.changed_since(spark, 0).collect()} == {"u1"}
    store.forget_changes(spark, 1)
    assert store.changed_since(spark, -1).count() == 0


def stored_rows(spark, users, each, first=0):
    """Rows in the stored layout: ``each`` a user, a minute apart."""
    rows = spark.range(users * each).select(
        F.concat(F.lit("u"), (F.col("id") % users + first).cast("string")).alias("user_id"), F.lit("v").alias("venue_id"),
        (1_700_000_000 + F.col("id") * 60).cast("string").alias("date"))
    return rows.select("user_id", *[F.col(c) if c in ("venue_id", "date") else F.lit("").alias(c) for c in ingest.CHECKIN_FIELDS])


def test_a_batch_reads_only_the_files_of_its_users(spark, tmp_path):
    """Ten users of 2,000 in 40 files: at most one file each, and nothing but their rows is handed on."""
    store = ingest.LogStore(str(tmp_path / "store"), file_rows=500)
    store.merge(stored_rows(spark, 2000, 10), 0)
    files = store.files(spark).collect()
    assert sum(f.n for f in files) == 20_000 and len(files) == 40
    handed, read = {}, set()
    original = ingest.LogStore.read_files

    def counted(self, spark, names, schema=None):
        read.update(names)
        return original(self, spark, names, schema)

    ingest.LogStore.read_files = counted
    try:
        batch = stored_rows(spark, 10, 1, first=700).withColumn("date", F.lit("1800000000"))
        touched = store.merge(batch, 1)
        assert not read  # no stored row of these users is as late as the batch
        handed = store.read_users(touched).groupBy("user_id").count().collect()
    finally:
        ingest.LogStore.read_files = original
    assert {r.user_id: r["count"] for r in handed} == {f"u{k}": 11 for k in range(700, 710)}
    rows = {f"{store.path}/runs/{f.file}": f.n for f in store.files(spark).collect()}
    assert sum(rows[name] for name in read) <= 10 * 600 + 10


def test_levels_are_merged_and_old_runs_deleted(spark, tmp_path):
    store = ingest.LogStore(str(tmp_path / "store"), fanout=3)
    for k in range(10):
        store.merge(stored_rows(spark, 5, 1, first=k), k)
    runs = {(f.run, f.level) for f in store.files(spark).collect()}
    assert sorted(level for _, level in runs) == [0, 2]
    assert store.read(spark).select("user_id").distinct().count() == 14
    kept = {r.run for v in store.catalog.versions(spark) for r in store.files(spark, v).collect()}
    assert {p.name for p in (tmp_path / "store" / "runs").iterdir()} == kept and len(kept) <= 6


def test_results_are_replaced_by_user(spark, tmp_path):
    """Replaced, emptied and kept users, before and after their runs are merged."""
    out = UserResults(str(tmp_path / "out"), fanout=3)
    want = {}
    for k in range(8):
        users = [f"u{(k * 3 + j) % 7}" for j in range(3)]
        rows = [(u, k * 10 + j) for u in users[k % 2:] for j in range(k % 3)]
        want.update({u: sorted(v for x, v in rows if x == u) for u in users})
        out.replace(spark.createDataFrame(rows, "user_id string, v long"), spark.createDataFrame([(u,) for u in users], "user_id string"))
        got = {}
        for r in out.results(spark).collect():
            got.setdefault(r.user_id, []).append(r.v)
        assert {u: sorted(v) for u, v in got.items()} == {u: v for u, v in want.items() if v}
    two = spark.createDataFrame([("u1",), ("u2",)], "user_id string")
    assert sorted((r.user_id, r.v) for r in out.results_of(two).collect()) == sorted((u, v) for u in ("u1", "u2") for v in want[u])


STEPS = ["claim", "data", "half", "marker", "expire"]


@pytest.mark.parametrize("lost", STEPS)
def test_a_lost_writer_leaves_the_old_or_the_new_version(spark, tmp_path, monkeypatch, lost):
    table = Snapshots(str(tmp_path / "t"))
    for n in (1, 2, 3):
        table.write(spark.range(n))
    pinned = table.read(spark)

    class Lost(Exception):
        pass

    with monkeypatch.context() as patch:
        def fail(*_, **__):
            raise Lost

        def publish():
            if lost == "claim":
                patch.setattr(Snapshots, "_create", fail)
            elif lost == "marker":
                create = Snapshots._create
                patch.setattr(Snapshots, "_create", lambda self, s, kind, v: fail() if kind == "versions" else create(self, s, kind, v))
            elif lost == "expire":
                patch.setattr(Snapshots, "expire", fail)
            if lost == "data":
                return table.publish(spark, fail)
            if lost == "half":
                return table.publish(spark, lambda folder: (spark.range(9).write.parquet(folder), fail()))
            return table.write(spark.range(9))

        with pytest.raises(Lost):
            publish()
    assert table.read(spark).count() == (9 if lost == "expire" else 3)
    assert pinned.count() == 3
    table.write(spark.range(5))
    assert table.read(spark).count() == 5 and len(table.versions(spark)) == 2
    kept = {f"{n:012d}" for n in table.versions(spark)}
    assert {p.name for p in (tmp_path / "t" / "data").iterdir() if p.name > min(kept)} >= kept - {min(kept)}


def test_a_stale_writer_is_told(spark, tmp_path):
    table = Snapshots(str(tmp_path / "t"))
    base = table.write(spark.range(1))
    table.write(spark.range(2), base=base)
    with pytest.raises(StaleBase):
        table.write(spark.range(3), base=base)
    assert table.read(spark).count() == 2


def test_results_of_one_build_appear_together(spark, tmp_path):
    table = Snapshots(str(tmp_path / "t"))
    table.write_all({"a": spark.range(1), "b": spark.range(2)})
    assert [table.read(spark, table=n).count() for n in "ab"] == [1, 2]
    with pytest.raises(FileNotFoundError):
        Snapshots(str(tmp_path / "none")).read(spark)


def test_check_ins_of_one_second_are_told_apart_by_their_id(spark, tmp_path):
    store = ingest.LogStore(str(tmp_path / "store"), keys=("venue_id", "date", "checkin_id"))
    land(tmp_path / "in", [[doc(1, "v", 1_700_000_000), doc(2, "v", 1_700_000_000)], [doc(2, "v", 1_700_000_000), doc(3, "v", 1_700_000_000)]])
    drain(spark, tmp_path / "in", store, tmp_path / "off")
    assert sorted(r.checkin_id for r in store.read(spark).collect()) == ["1", "2", "3"]


@pytest.fixture(scope="module")
def far_users(spark, sf_dir, tmp_path_factory):
    """The events of every second user again, under users a million further, where twins lie; some ids begin with 9."""
    folder = tmp_path_factory.mktemp("far")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    far = e.filter("user_id % 2 = 0").withColumns({"user_id": F.col("user_id") + 1_000_000, "event_id": F.col("event_id") + 9_000_000})
    e.unionByName(far).coalesce(1).write.parquet(str(folder / "events.parquet"))
    for name in os.listdir(sf_dir):
        if name != "events.parquet":
            os.symlink(f"{sf_dir}/{name}", folder / name)
    return str(folder)


@pytest.mark.parametrize("name", ["stream_checkins", "stream_refresh", "stream_trips"])
def test_streams_equal_their_sql_where_users_lie_among_twins(spark, far_users, name):
    import duckdb
    from check_queries import compare

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{far_users}/events.parquet/*.parquet'")
    assert compare(spark, con, name, far_users) == ""
