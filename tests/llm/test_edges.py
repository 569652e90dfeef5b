"""Every operator and stage over awkward rows and over empty tables."""
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from edge import BASE, CLASHES, ROWS, benchmark, documents, labels
from roamlog.llm import bpe, decontaminate, hmm, html, licenses, minhash, quality, secrets, suffixes, tokenids

N = len(ROWS)
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def token_ids(spark, docs, path):
    tokenids.write(docs, WORDS, path)
    return tokenids.read(spark, path)


OPERATORS = {
    "op1": lambda s, d, p: secrets.scan(d),
    "op3": lambda s, d, p: minhash.near_duplicates(d, 4),
    "op4": lambda s, d, p: hmm.score(d, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, states=3, rounds=1),
    "op5": lambda s, d, p: token_ids(s, d, p),
    "op6": lambda s, d, p: licenses.scan(d, licenses.default_templates(s)),
    "op7": lambda s, d, p: suffixes.repeated_strings(d),
    "op8": lambda s, d, p: decontaminate.contamination(d, benchmark(s, [(1, BASE), (2, None), (None, "one"), (3, "")])),
    "op9": lambda s, d, p: quality.assess(d, labels(s, [(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 0)])),
    "op10": lambda s, d, p: bpe.encode_digests(d, BYTES),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, tmp_path, name):
    got = OPERATORS[name](spark, documents(spark), str(tmp_path / "out")).collect()
    assert len(got) == {"op1": 1, "op6": 0}.get(name, N)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, tmp_path, name):
    assert OPERATORS[name](spark, documents(spark, []), str(tmp_path / "out")).count() == 0


def test_repeated_rows_and_ids(spark):
    rows = minhash.near_duplicates(documents(spark), 4).collect()
    by = sorted((r.doc_id, r.component_id, r.kept, r.n_shingles) for r in rows if r.doc_id is not None)
    assert [x[:3] for x in by if x[0] <= 3] == [(1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False)]
    assert [x for x in by if x[0] in (4, 5, 6)] == [(4, 4, True, 0), (5, 5, True, 0), (6, 6, True, 0)]
    assert [x for x in by if x[0] in (7, 8)] == [(7, 7, True, 1), (8, 7, False, 1)]
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)


def test_stages_keep_columns_and_rows(spark, tmp_path, monkeypatch):
    for name, rows in (("labels", labels(spark, [(1, 1, 0)])), ("benchmark", benchmark(spark, [(1, "no id here"), (2, None)]))):
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = documents(spark)
    out = {name: stage(spark, docs, str(tmp_path)) for name, stage in corpus_pipeline.STAGES[:1]}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, docs, str(tmp_path))
        assert result.columns == docs.columns
        kept[name] = result.collect()
        assert all(r[c] == "mine" for r in kept[name] for c in CLASHES)
    assert out and len(kept["secret_scan"]) == N
    assert sum(secrets.REDACTED in (r.text or "") for r in kept["secret_scan"]) == 1
    assert all(r.n_chars == len(r.text) for r in kept["secret_scan"] if r.text is not None)
    assert len(kept["benchmark_decontamination"]) == N - 1
    assert sorted(r.doc_id for r in kept["near_duplicates"] if r.doc_id is not None) == [1, 4, 5, 6, 7, 9, 10, 11]
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(coded) == N and all(r.round_trip for r in coded)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_empty_tables(spark, tmp_path, k):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.STAGES[k][1](spark, documents(spark, []), str(tmp_path)).count() == 0


def test_pages(spark):
    rows = [(1, None, None, "x", "y"), (2, "http://a.com", "", "x", "y"), (2, "http://a.com", "", "x", "y"),
            (None, "::", "<p>one &am", "x", "y"), (3, "http://a.com/z", "<article><p>" + "long " * 100_000, "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string")
    got = html.extract(pages)
    assert got.columns == ["page_id", "url", "host", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text[:8], r.n_chars) for r in got.collect()) == [
        (0, "one &am", 7), (1, "", 0), (2, "", 0), (2, "", 0), (3, "long lon", 499_999)]
    assert html.extract(pages.limit(0)).count() == 0


def test_pages_with_clashing_columns(spark):
    names = ["page", "lines", "places", "hashes", "parents", "digest", "section", "gone", "_row"]
    rows = [(k, f"http://a.com/{k}", f"<article><div><p>box</p></div><p>own {k}</p></article>", *["mine"] * len(names)) for k in range(8)]
    pages = spark.createDataFrame(rows, ["page_id", "url", "html", *names])
    got = html.extract(pages)
    assert got.columns == ["page_id", "url", *names, "text", "n_chars"]
    assert all(r.text == f"own {r.page_id}" and all(r[c] == "mine" for c in names) for r in got.collect())
