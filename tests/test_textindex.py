"""The trigram index against a scan."""
import random

import pytest

from roamlog.operators import filters, textindex as TX

DDL = "id long, a string, b string"


@pytest.mark.parametrize("bucket", [7, 100_000])
def test_index_equals_the_scan(spark, tmp_path, monkeypatch, bucket):
    monkeypatch.setattr(TX, "BUCKET", bucket)
    monkeypatch.setattr(TX, "ROWS_PER_FILE", 100)
    rng = random.Random(bucket)
    words = ["Rome", "München", "Straße", "ABBA", "abab", "İstanbul", "x", "", None, "東京駅", "a%b_c", "Saint-Étienne"]
    rows = [(k, " ".join(filter(None, rng.choices(words, k=2))) if rng.random() < 0.9 else None, rng.choice(words)) for k in range(500)]
    df = spark.createDataFrame(rows, DDL)
    index = TX.TextIndex(str(tmp_path / "i"), ("a", "b"))
    index.write(df)
    for q in ["rome", "ROME x", "ab", "aba", "abab", "é", "saint-é", "京駅", "東京駅", "%b_", "nothing", "strasse", " Rome ", "", "ß", "e m"]:
        want = sorted(r.id for r in filters.search(df, ["a", "b"], q).collect())
        assert sorted(r.id for r in index.search(spark, q).collect()) == want, q
    near = index.candidates(spark, "abab")
    assert near.count() < index.versions.read(spark, table="combos").count() / 2


def test_few_hits_read_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(TX, "ROWS_PER_FILE", 500)
    rows = [(k, f"name {k % 2000:04d}", "b") for k in range(10_000)]
    index = TX.TextIndex(str(tmp_path / "i"), ("a", "b"))
    index.write(spark.createDataFrame(rows, DDL))
    found = index.search(spark, "E 0042")
    assert sorted(r.id for r in found.collect()) == list(range(42, 10_000, 2000))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(_combo), EqualTo(_combo" in plan or "PushedFilters: [In(_combo" in plan
    index.write(spark.createDataFrame(rows[:3], DDL))
    assert index.search(spark, "name").count() == 3
