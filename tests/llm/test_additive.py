"""The additive model: lookup against a plain sum, interactions, held-out accuracy, and what may not matter."""
import zlib

import numpy as np
from pyspark.sql import functions as F

from edge import ROWS, documents, labels
from roamlog.llm import additive as A


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def test_scores_are_sums_of_bins():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3)).round(2)
    y = ((x[:, 0] + x[:, 1] > 0.3) | (x[:, 2] > 1.5)).astype(float)
    m = A.fit_tables(x, y)
    for row in [*x[:40], np.full(3, 99.0), np.full(3, -99.0)]:
        z = m.base
        for k, v in enumerate(row):
            z += m.tables[k][sum(c <= v for c in m.cuts[k])]
        for (a, b), t in zip(m.pairs, m.pair_tables):
            z += t[sum(c <= row[a] for c in m.coarse[a]), sum(c <= row[b] for c in m.coarse[b])]
        assert abs(m.score(row[None])[0] - 1 / (1 + np.exp(-np.clip(z, -A.LIMIT, A.LIMIT)))) < 1e-8


def test_interactions_are_found():
    """Neither of two features tells anything alone; only their pair does."""
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, size=(3000, 4))
    y = (x[:, 1] * x[:, 3] > 0).astype(float)
    m = A.fit_tables(x[:2000], y[:2000])
    assert (1, 3) in m.pairs
    assert ((m.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.93
    m.pairs, m.pair_tables = [], []
    assert ((m.score(x[2000:]) >= 0.5) == y[2000:]).mean() < 0.7


def test_tree_of_three_leaves_is_the_best_greedy_one():
    rng = np.random.default_rng(11)
    g, h = rng.normal(size=9), rng.uniform(1, 2, 9)

    def gain(edges):
        return sum(g[a:b].sum() ** 2 / (h[a:b].sum() + A.RIDGE) for a, b in zip(edges, edges[1:]))

    first = max(range(1, 9), key=lambda c: gain([0, c, 9]))
    edges = max((sorted([0, first, c, 9]) for c in range(1, 9) if c != first), key=gain)
    want = np.concatenate([np.full(b - a, g[a:b].sum() / (h[a:b].sum() + A.RIDGE)) for a, b in zip(edges, edges[1:])])
    assert np.allclose(A.tree_step(g, h), want)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = A.classify(docs, marks).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    truth = {r.doc_id: r.quality for r in marks.collect()}
    known = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    for label in (0, 1):
        assert np.mean([p == t for t, p in known if t == label]) > 0.95

    # Labels of held-out rows, other columns and the order of rows play no part.
    flipped = marks.withColumn("quality", F.when(A.fold(), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")}).orderBy(F.rand(1))
    again = {r.doc_id: r.score for r in A.classify(other, flipped).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)


def test_awkward_rows(spark):
    docs = documents(spark)
    got = A.classify(docs, labels(spark, [(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 1)]))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == len(ROWS) and {(r.score, r.predicted) for r in rows} == {(0.5, 1)}
    ids = [i for i, *_ in ROWS if i is not None and not held(i)]
    rows = A.classify(docs, labels(spark, [(i, i % 2, 0) for i in set(ids)])).collect()
    assert all(0 < r.score < 1 for r in rows) and sum(r.held_out for r in rows) == sum(held(i) for i, *_ in ROWS)
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[4] == by_id[5] and by_id[7] == by_id[8]


def test_empty_table(spark):
    assert A.classify(documents(spark, []), labels(spark)).count() == 0


def test_one_kind_of_label_gives_its_share():
    assert A.fit_tables(np.zeros((9, len(A.FEATURES))), np.ones(9)).score(np.zeros((1, len(A.FEATURES))))[0] == round(10 / 11, 9)
    assert A.fit_tables(np.zeros((0, len(A.FEATURES))), np.zeros(0)).score(np.zeros((1, len(A.FEATURES))))[0] == 0.5
    assert len(A.text_features(b"")) == len(A.FEATURES) and np.isfinite(A.text_features(b"")).all()
