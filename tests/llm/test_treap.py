"""Ranked search against scores computed one by one, and the grid against a dense one."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from edge import BASE, benchmark, documents
from roamlog.llm import treap as K


def terms(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def plain(docs, items, k=10):
    """Best ``k`` per item row as (score, id) lists, of all documents scored one by one."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m))
                    for t in set(terms(text)) if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item or 0, r, 0 if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def got(df):
    return sorted((r.item_id or 0, r["rank"], r.doc_id or 0, r.score) for r in df.collect())


@pytest.mark.parametrize("block", [3, 64])
def test_ranks_equal_plain_scores(spark, monkeypatch, block):
    """Many copies and ties, over blocks of few documents and several tasks."""
    monkeypatch.setattr(K, "BLOCK_DOCS", block)
    monkeypatch.setattr(K, "GROUP_ITEMS", 7)
    rng = random.Random(block)
    words = [f"w{int(rng.expovariate(0.05))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 20, 60])))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(90)] + [(None, docs[7][1]), (5, docs[8][1])]
    rng.shuffle(docs)
    items = [(j, " ".join(rng.choices(words, k=rng.choice([1, 4, 30])))) for j in range(16)] + [(50, docs[7][1]), (50, "w1 W2"), (None, "w3")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(K.search(table, benchmark(spark, items))) == plain(docs, items)
    assert got(K.search(table, benchmark(spark, items[:3]), k=1000)) == plain(docs, items[:3], 1000)


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(1, BASE), (2, None), (3, ""), (4, "?!"), (5, "É" * 30), (None, "one"), (7, "🙂 WORD"), (8, "absent")]
    assert got(K.search(docs, benchmark(spark, items))) == plain(rows, items)


def test_empty_tables(spark):
    for docs, items in (([], [(1, "one")]), ([(1, None, "en", "s"), (2, " ", "en", "s")], [(1, "one")]), ([(1, "one", "en", "s")], [])):
        found = K.search(documents(spark, docs), benchmark(spark, items))
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


@pytest.mark.parametrize("rows, cols, share", [(1, 1, 1), (1, 40, 0.5), (300, 9, 0.05), (33, 257, 0.9)])
def test_grid_holds_every_cell(rows, cols, share):
    rng = np.random.default_rng(rows)
    dense = np.where(rng.random((rows, cols)) < share, rng.integers(1, 1_000_000, (rows, cols)), 0)
    dense[0, 0] = 7
    r, c = np.nonzero(dense)
    height, masks, drops = K.build_treap(r, c, dense[r, c])
    t = K.Treap(height, len(masks), len(r), K.pack(masks, drops))
    assert t.best[1] == dense.max()
    for row in range(rows):
        scores, at = K.best_columns(t, np.array([row]), np.array([3]), cols, cols, (0, 0))
        want = sorted(((-3 * int(v), k) for k, v in enumerate(dense[row]) if v), key=lambda x: x)
        assert [(-int(s), int(k)) for s, k in zip(scores, at)] == want


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(K, "_PIECE", 10)
    text = "Alpha beta-gamma  ÉÜ 42x" * 30
    assert [w.decode() for p in K.terms_of(text.encode()) for w in p] == terms(text)
    assert [K.count_terms(t.encode()) for t in (text, "", " ", "a", " é,1 ", "-")] == [len(terms(text)), 0, 0, 1, 2, 0]


def test_index_covers_all_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n, total = K.totals(docs)
    index = K.build_index(docs, n, total)
    assert sum(len(b.ids) // 8 for b in index.select("ids").collect()) == docs.count()
    pairs = sum(len(set(terms(r.text))) for r in docs.select("text").collect())
    assert index.agg(F.sum("cells")).first()[0] == pairs
