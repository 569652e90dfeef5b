"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Benchmark items are cut into windows of ``WINDOW`` words (a shorter item is one window), a window into shingles of three
words (fewer, if it has fewer). A window is contained in a document only if all its shingles are, so one of them, the
first in the order of rarity, is a sufficient prefix for the join. Rarity is counted over all documents; a window with a
shingle that no document has is out before the join. Matches must leave room for the window on both sides (positional
and length bounds), and the words of the window are then compared themselves.

The small side is broadcast only while it has at most ``BROADCAST_ROWS`` rows, counted beforehand; beyond that the same
join shuffles. Words are runs of 0-9, a-z and characters beyond ASCII, after A-Z is lower-cased.

Null or empty texts and items have no words. Items with a null id mark words but are not listed. Rows that repeat an id
are judged by their own text. An empty benchmark leaves all documents clean.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from roamlog.llm.common import ascii_lower, query, table, with_row_key
from roamlog.session import stage

WINDOW, SHINGLE = 10, 3
#: Most rows of benchmark shingles that are broadcast (about 300 bytes each).
BROADCAST_ROWS = 100_000
#: Words kept around a matched shingle: as many before and after as a window can reach.
BEFORE, AROUND = WINDOW - SHINGLE, 2 * WINDOW - SHINGLE

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATORS), ""), F.array().cast("array<string>"))


def _key(words: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from the 0-based position ``at``."""
    return F.xxhash64(F.lit(size), *[F.get(words, at + k) for k in range(size)])


def windows_of(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, window_id, window, m): the distinct windows of each item."""
    it = items.select(F.col(item_id).alias("item"), words_of(F.col(text)).alias("w")).filter("size(w) > 0")
    starts = F.expr(f"sequence(1, greatest(size(w) - {WINDOW} + 1, 1))")
    cut = it.select("item", "w", F.explode(starts).alias("s")).select("item", F.expr(f"slice(w, s, {WINDOW})").alias("window"))
    return cut.distinct().select("item", F.xxhash64("window").alias("window_id"), "window", F.size("window").alias("m"))


def _document_shingles(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """Every shingle of every document: (_key, n, at, key, context, base)."""
    # An outer generate: the inner kind would push a test on the words below their split and split twice.
    each = docs.select("_key", F.size("_words").alias("n"), "_words", F.posexplode_outer("_words").alias("at", "_w"))
    if len(sizes) == 1:
        keyed = each.withColumn("size", F.lit(sizes[0])).withColumn("key", _key(F.col("_words"), F.col("at"), sizes[0]))
    else:
        keys = F.array(*[F.struct(F.lit(s).alias("size"), _key(F.col("_words"), F.col("at"), s).alias("key")) for s in sizes])
        keyed = each.withColumn("_k", F.explode(keys)).select("*", "_k.size", "_k.key")
    base = F.greatest(F.col("at") - BEFORE, F.lit(0))
    return keyed.filter("at + size <= n").select(
        "_key", "n", "at", "key", base.alias("base"), F.slice("_words", base + 1, F.lit(AROUND)).alias("context"))


def find_windows(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Occurrences (_key, start, m, window_id) of benchmark windows in ``docs`` (_key, text), and (item, window_id)."""
    windows = stage(windows_of(items.select(item_id, text), item_id, text), "windows")
    each = windows.select("window_id", "window", "m").dropDuplicates(["window_id"])
    offsets = F.expr(f"sequence(0, m - least(m, {SHINGLE}))")
    cut = each.select("*", F.explode(offsets).alias("offset"), F.least("m", F.lit(SHINGLE)).alias("size"))
    key = F.coalesce(*[F.when(F.col("size") == s, _key(F.col("window"), F.col("offset"), s)) for s in range(1, SHINGLE + 1)])
    shingles = stage(cut.withColumn("key", key), "shingles")
    small = F.broadcast if shingles.count() <= BROADCAST_ROWS else (lambda df: df)
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect()) or [SHINGLE]
    worded = docs.select("_key", words_of(F.col("text")).alias("_words"))
    found = _document_shingles(worded, sizes)
    counts = found.select("key").join(small(shingles.select("key").distinct()), "key").groupBy("key").agg(F.count("*").alias("df"))
    # The rarest shingle of each window; absent ones rule the window out.
    rare = shingles.join(stage(counts, "shingle-counts"), "key", "left").groupBy("window_id").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key", "offset")).alias("p"), F.first("window").alias("window"),
        F.first("m").alias("m")).filter("p.df > 0")
    prefix = stage(rare.select("window_id", "window", "m", "p.key", "p.offset"), "prefixes")
    start = F.col("at") - F.col("offset")
    hits = found.join(small(prefix), "key").filter((start >= 0) & (start + F.col("m") <= F.col("n"))).filter(
        F.slice("context", start - F.col("base") + 1, F.col("m")) == F.col("window"))
    return stage(hits.select("_key", start.alias("start"), "m", "window_id"), "occurrences"), windows.select("item", "window_id")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: words, hit words, and the items whose windows occur in it (ids as sorted strings)."""
    keyed = with_row_key(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text")), "_id", "text")
    at, names = find_windows(keyed.select("_key", "text"), items, item_id, item_text)
    words = at.select("_key", F.explode(F.expr("sequence(start, start + m - 1)")).alias("p")).distinct().groupBy("_key").agg(
        F.count("*").alias("n_hit"))
    listed = at.select("_key", "window_id").distinct().join(names, "window_id").select(
        "_key", F.col("item").cast("string").alias("item")).distinct().groupBy("_key").agg(
        F.count("item").alias("n_items"), F.array_sort(F.collect_list("item")).alias("items"))
    hit = stage(words.join(listed, "_key"), "contaminated")
    out = keyed.select("_id", "_key", F.size(words_of(F.col("text"))).cast("long").alias("n_words")).join(hit, "_key", "left")
    zero, none = F.lit(0).cast("long"), F.array().cast("array<string>")
    return out.select(F.col("_id").alias(id_col), "n_words", F.coalesce("n_hit", zero).alias("n_hit"),
                      F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items", none).alias("items"),
                      F.col("n_hit").isNotNull().alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any benchmark window."""
    rows = docs.select(F.struct("*").alias("row")).withColumn("_key", F.xxhash64(f"row.{id_col}", f"row.{text}"))
    at, _ = find_windows(rows.select("_key", F.col(f"row.{text}").alias("text")), items)
    return rows.join(stage(at.select("_key").distinct(), "contaminated"), "_key", "left_anti").select("row.*")


SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
cut AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS s FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS k FROM cut),
sizes AS (SELECT DISTINCT m FROM win),
spans AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, sizes WHERE len(w) >= m),
found AS (SELECT a.doc_id, a.s, a.m, win.item_id FROM (SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS k FROM spans) a JOIN win ON win.k = a.k AND win.m = a.m),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


@query("op8_prefix_decontamination", SQL)
def _(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items")
