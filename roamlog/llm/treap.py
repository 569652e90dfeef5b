"""Ranked lexical search: K2-treaps over term-document grids, descended best-first by all terms of an item at once.

The index is a table of blocks of documents. A block is a grid, terms by documents in ascending order of id, whose cells
hold impacts (the part of a score that does not depend on the item). The grid is cut into quadrants again and again; a
node exists where its square holds a cell, and keeps the largest impact in it. Nodes are stored level by level as four
bits for their children and the difference from the maximum of their parent, both compressed.

A search starts at the root with one pointer per term of the item. A range of documents is bounded by the weighted sum of
the maxima its pointers see; the ranges with the greatest bounds are halved next, each pointer following the bits of its
row, and a range of one document carries its exact score. It ends when no bound can enter the best ``k``. What a task
found in its earlier blocks counts for its later ones. Ranks are exact, with no list or candidate cut short.

Items are read in groups of at most ``GROUP_ITEMS`` rows and ``GROUP_BYTES`` of text (one longer item is a group), each
sent to one pass over the index. Weights need the document frequencies of a group's own terms only.

Terms are runs of 0-9, a-z and characters beyond ASCII, after A-Z is lower-cased. Documents without terms, null ones
included, are not found; items without terms have no rows. Null ids are found like others and come last among equal
scores. Rows that repeat a document or an item id are ranked each on their own. An empty table finds nothing.
"""
from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from roamlog.llm.common import chunks, query, table, utf8
from roamlog.session import stage

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_DOCS = 2048
GROUP_ITEMS, GROUP_BYTES = 1024, 8 << 20
#: Bytes of a row group of the index, and so of what a task reads at once.
INDEX_ROW_GROUP = 16 << 20
#: Ranges halved at once at the start of a search (doubled each time), and most pointers moved at once.
FIRST_RANGES, MOST_POINTERS = 8, 1 << 20

_WORD = [c < 128 and chr(c).isalnum() or c >= 128 for c in range(256)]
#: Each byte lower-cased if it belongs to a term, else a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if _WORD[c] else 32 for c in range(256))
_PIECE = 4 << 20
_BITS = np.array([bin(c).count("1") for c in range(16)], np.int8)
#: ``_RANK[mask, q]``: children of a node before quadrant ``q``; ``_HAS[mask, q]``: whether it has that one.
_RANK = np.array([[bin(m & ((1 << q) - 1)).count("1") for q in range(4)] for m in range(16)], np.int32)
_HAS = np.array([[m >> q & 1 for q in range(4)] for m in range(16)], bool)


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text in order, in lists of bounded size."""
    folded, start = text.translate(_FOLD), 0
    while start < len(folded):
        end = folded.find(b" ", start + _PIECE)
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


def count_terms(text: bytes) -> int:
    """How many terms a UTF-8 text has: bytes of a term that follow none."""
    inside = np.frombuffer(b" " + text.translate(_FOLD), np.uint8) != 32
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]))


def totals(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Documents with a term, and the terms of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = terms = 0
        for batch in chunks(batches, text):
            n = [count_terms(t) for t in utf8(batch.column(text))]
            found, terms = found + sum(k > 0 for k in n), terms + sum(n)
        yield pa.RecordBatch.from_arrays([pa.array([found]), pa.array([terms])], names=["docs", "terms"])

    got = docs.select(text).mapInArrow(run, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return int(got.docs or 0), int(got.terms or 0)


# --------------------------------------------------------------------------------------------
# Building


def spread_bits(x: np.ndarray) -> np.ndarray:
    """Bit ``k`` of each value moved to bit ``2k``."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def build_treap(rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """``(height, masks, drops)`` of the cells ``(rows, cols)``, which must differ.

    Both arrays list the nodes level by level: ``masks`` those above the cells, ``drops`` every node and cell, as the
    difference between its parent's maximum and its own (the root as its own maximum).
    """
    height = max(1, int(max(rows.max(), cols.max())).bit_length())
    code = spread_bits(rows) << np.uint64(1) | spread_bits(cols)
    order = np.argsort(code)
    code, best = code[order], values[order].astype(np.int32)
    masks, drops = [], []
    for _ in range(height):
        up = code >> np.uint64(2)
        first = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
        bits = np.left_shift(1, (code & np.uint64(3)).astype(np.uint8), dtype=np.uint8)
        masks.append(np.bitwise_or.reduceat(bits, first))
        top = np.maximum.reduceat(best, first)
        drops.append(np.repeat(top, np.diff(np.append(first, len(code)))) - best)
        code, best = up[first], top
    return height, np.concatenate(masks[::-1]), np.concatenate([best, *drops[::-1]])


def pack(masks: np.ndarray, drops: np.ndarray) -> bytes:
    """Two masks a byte, differences as three planes of bytes; compressed."""
    even = np.append(masks, np.zeros(len(masks) % 2, np.uint8))
    raw = np.concatenate([even[::2] | even[1::2] << 4, *[(drops >> s & 255).astype(np.uint8) for s in (0, 8, 16)]])
    return pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


class Treap:
    """A block's nodes with absolute pointers. Node 0 is the empty square, node 1 the root."""

    def __init__(self, height: int, nodes: int, cells: int, packed: bytes) -> None:
        half = (nodes + 1) // 2
        raw = np.frombuffer(pa.decompress(packed, half + 3 * (nodes + cells), codec="zstd", asbytes=True), np.uint8)
        self.height = height
        masks = np.empty(2 * half, np.uint8)
        masks[::2], masks[1::2] = raw[:half] & 15, raw[:half] >> 4
        low, mid, high = raw[half:].reshape(3, nodes + cells).astype(np.int32)
        drops = low | mid << 8 | high << 16
        total = nodes + cells
        self.mask = np.zeros(total + 1, np.uint8)
        self.mask[1 : nodes + 1] = masks[:nodes]
        self.first = np.zeros(total + 1, np.int32)
        children = _BITS[masks[:nodes]].astype(np.int32)
        self.first[1 : nodes + 1] = 2 + np.cumsum(children) - children
        self.best = np.zeros(total + 1, np.int32)
        self.best[1] = drops[0]
        lo, hi = 1, 2
        for _ in range(height):
            below = np.repeat(self.best[lo:hi], children[lo - 1 : hi - 1])
            lo, hi = hi, hi + len(below)
            self.best[lo:hi] = below - drops[lo - 1 : hi - 1]


def index_block(ids: list, texts: list[bytes], n_docs: int, n_terms: int) -> dict | None:
    """One row of the index, or none if no text has a term."""
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
    number = defaultdict(count().__next__)
    seen, lengths = [], []
    for col, k in enumerate(order):
        n = 0
        for words in terms_of(texts[k]):
            seen.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)) << 32 | col)
            n += len(words)
        lengths.append(n)
    if not number:
        return None
    cell, tf = np.unique(np.concatenate(seen), return_counts=True)
    rows, cols = cell >> 32, cell & 0xFFFFFFFF
    length = np.array([100 - 90 + 90 * n * n_docs // n_terms for n in lengths], np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * length[cols])
    # Frequent terms lie next to each other, so that a square's maximum says most about its own rows.
    df = np.bincount(rows)
    names = list(number)
    by_df = sorted(range(len(names)), key=lambda r: (-df[r], names[r]))
    place = np.empty(len(names), np.int64)
    place[by_df] = np.arange(len(names))
    height, masks, drops = build_treap(place[rows], cols, impact)
    return {
        "ids": np.array([ids[k] or 0 for k in order], np.int64).tobytes(), "unnamed": sum(i is None for i in ids),
        "terms": b" ".join(names[r] for r in by_df), "df": df[by_df].astype(np.int32).tobytes(),
        "height": height, "nodes": len(masks), "cells": len(cell), "grid": pack(masks, drops),
    }


_INDEX = {"ids": "binary", "unnamed": "int", "terms": "binary", "df": "binary", "height": "int", "nodes": "int", "cells": "int", "grid": "binary"}


def build_index(docs: DataFrame, n_docs: int, n_terms: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all ``docs`` as a staged table of blocks. Documents stay in the task that read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block():
            got = index_block(ids, texts, n_docs, n_terms)
            return [] if got is None else [pa.RecordBatch.from_pylist([got], schema=schema)]

        schema = pa.schema([(c, pa.binary() if t == "binary" else pa.int32()) for c, t in _INDEX.items()])
        ids, texts, size = [], [], 0
        for batch in chunks(batches, text):
            for i, t in zip(batch.column(id_col).to_pylist(), utf8(batch.column(text))):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if len(ids) == BLOCK_DOCS or size >= 2 * _PIECE:
                    yield from block()
                    ids, texts, size = [], [], 0
        if ids:
            yield from block()

    ids_of = docs.select(F.col(id_col).cast("long").alias(id_col), text)
    return stage(ids_of.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in _INDEX.items())), "treap-index",
                 **{"parquet.block.size": INDEX_ROW_GROUP})


# --------------------------------------------------------------------------------------------
# Searching


def best_columns(treap: Treap, rows: np.ndarray, weights: np.ndarray, width: int, k: int,
                 floor: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best columns by (score descending, column), of those that beat ``floor``.

    ``rows`` are the grid rows of the item's terms; ``floor`` is a score and the first column that may not equal it.
    """
    scores, cols = np.zeros(0, np.int64), np.zeros(0, np.int64)
    level, start = np.zeros(1, np.int64), np.zeros(1, np.int64)
    at, bound = np.ones((1, len(rows)), np.int32), np.array([weights.sum() * treap.best[1]], np.int64)
    batch, most = FIRST_RANGES, max(1, MOST_POINTERS // max(1, len(rows)))
    while True:
        open_ = (bound > floor[0]) | ((bound == floor[0]) & (start << (treap.height - level) < floor[1]))
        if not open_.all():
            level, start, at, bound = level[open_], start[open_], at[open_], bound[open_]
        if not len(bound):
            return scores, cols
        take = np.ones(len(bound), bool)
        if len(bound) > batch:
            take[np.argpartition(bound, len(bound) - batch)[: len(bound) - batch]] = False
        batch = min(2 * batch, most)
        down = level[take]
        bit = (rows[None, :] >> (treap.height - 1 - down)[:, None]) & 1
        mask, first = treap.mask[at[take]], treap.first[at[take]]
        new = []
        for side in (0, 1):
            quadrant = 2 * bit + side
            child = np.where(_HAS[mask, quadrant], first + _RANK[mask, quadrant], 0)
            new.append((down + 1, 2 * start[take] + side, child, treap.best[child].astype(np.int64) @ weights))
        level, start, at, bound = (
            np.concatenate([old[~take], *[n[i] for n in new]]) for i, old in enumerate((level, start, at, bound)))
        done = (level == treap.height) & (bound > 0)
        if done.any():
            scores, cols = np.concatenate([scores, bound[done]]), np.concatenate([cols, start[done]])
            top = np.lexsort((cols, -scores))[:k]
            scores, cols = scores[top], cols[top]
            if len(scores) == k:
                floor = max(floor, (int(scores[-1]), int(cols[-1])), key=lambda f: (f[0], -f[1]))
            level, start, at, bound = level[~done], start[~done], at[~done], bound[~done]


def _ordinal(ids: np.ndarray, named: int, doc) -> int:
    """Columns of a block that come before the document id ``doc``."""
    return named if doc is None else int(np.searchsorted(ids[:named], doc))


def document_frequencies(index: DataFrame, wanted: list[bytes]) -> dict[int, int]:
    """Documents that hold each of the ``wanted`` terms, by its place in that list."""
    sent = index.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(wanted)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = sent.value, np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for terms, df in zip(batch.column("terms").to_pylist(), batch.column("df").to_pylist()):
                for t, n in zip(terms.split(b" "), np.frombuffer(df, np.int32)):
                    if t in place:
                        total[place[t]] += n
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["term", "df"])

    found = index.select("terms", "df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {int(r.term): int(r.df) for r in found.collect()}


def _groups(items: DataFrame) -> Iterator[list[tuple]]:
    """Items as (id, terms), read by the driver in groups of bounded size."""
    group, size = [], 0
    for i, text in items.toLocalIterator():
        raw = (text or "").encode("utf-8", "surrogatepass")
        terms = sorted({t for words in terms_of(raw) for t in words})
        if not terms:
            continue
        if group and (len(group) == GROUP_ITEMS or size + len(raw) > GROUP_BYTES):
            yield group
            group, size = [], 0
        group.append((i, terms))
        size += len(raw)
    if group:
        yield group


def _search_group(index: DataFrame, group: list[tuple], n_docs: int, k: int, id_type: T.DataType, doc_type: T.DataType) -> DataFrame:
    wanted = sorted({t for _, terms in group for t in terms})
    place = {t: j for j, t in enumerate(wanted)}
    df = document_frequencies(index, wanted)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[j] + 1))) if j in df else 0 for j in range(len(wanted))], np.int64)
    ask = []
    for _, terms in group:
        mine = np.array([place[t] for t in terms])
        ask.append(mine[weight[mine] > 0])
    sent = index.sparkSession.sparkContext.broadcast((wanted, weight, ask, [i for i, _ in group]))
    id_kind = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight, ask, item_ids = sent.value
        best: list[list[tuple]] = [[] for _ in ask]  # (-score, id is null, id), the least first
        for batch in batches:
            for b in range(batch.num_rows):
                block = batch.slice(b, 1).to_pylist()[0]
                ids = np.frombuffer(block["ids"], np.int64)
                named = len(ids) - block["unnamed"]
                row_of = {t: r for r, t in enumerate(block["terms"].split(b" "))}
                row = np.array([row_of.get(t, -1) for t in wanted])
                treap = Treap(block["height"], block["nodes"], block["cells"], block["grid"])
                for j, mine in enumerate(ask):
                    here = mine[row[mine] >= 0]
                    if not len(here):
                        continue
                    floor = (0, 0)
                    if len(best[j]) == k:
                        score, _, doc = best[j][-1]
                        floor = (-score, _ordinal(ids, named, doc))
                    scores, cols = best_columns(treap, row[here], weight[here], len(ids), k, floor)
                    if len(scores):
                        found = [(-int(s), bool(c >= named), None if c >= named else int(ids[c])) for s, c in zip(scores, cols)]
                        best[j] = sorted(best[j] + found, key=lambda f: (f[0], f[1], f[2] or 0))[:k]
        rows = [(j, doc, -s) for j, top in enumerate(best) for s, _, doc in top]
        item, doc, score = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int64()), pa.array([item_ids[j] for j in item], id_kind), pa.array(doc, pa.int64()),
             pa.array(score, pa.int64())], names=["item", "item_id", "doc", "score"])

    found = index.mapInArrow(run, f"item long, item_id {id_type.simpleString()}, doc long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "item_id", "rank", F.col("doc").cast(doc_type).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, over all ``docs``."""
    n_docs, n_terms = totals(docs, text)
    id_type, doc_type = items.schema[item_id].dataType, docs.schema[doc_id].dataType
    index = build_index(docs, n_docs, n_terms, doc_id, text) if n_docs else None
    found = [_search_group(index, g, n_docs, k, id_type, doc_type) for g in _groups(items.select(item_id, text))] if n_docs else []
    if not found:
        schema = T.StructType([T.StructField("item_id", id_type), T.StructField("rank", T.IntegerType()),
                               T.StructField("doc_id", doc_type), T.StructField("score", T.LongType())])
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found)


_FOLDED = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + TERM + "')"
_SQL = f"""
WITH w AS (
  SELECT r, doc_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS r, doc_id, {_FOLDED} AS t FROM documents)
), lengths AS (
  SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM w GROUP BY r
), g AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths
), tf AS (
  SELECT r, term, count(*) AS tf FROM w GROUP BY r, term
), df AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
), q AS (
  SELECT i, item_id, unnest(list_distinct(t)) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_FOLDED} AS t FROM benchmark)
), s AS (
  SELECT q.i, q.item_id, l.doc_id, tf.r, CAST(sum(CAST(floor(1000 * ln(CAST(2 * g.docs + 2 AS DOUBLE) / (2 * df.df + 1))) AS BIGINT)
    * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + (90 * l.n * g.docs) // g.terms)))) AS BIGINT) AS score
  FROM q JOIN tf ON tf.term = q.term JOIN df ON df.term = q.term JOIN lengths l ON l.r = tf.r, g GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""


@query("op12_k2_treap_search", _SQL)
def _(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
