"""Filter interaction audit: what each filter removes, and what it would have removed, in every order of five filters.

A document is a mask of the filters it fails. Documents with the same part, mask and labels count as one weighted row of
a mask matrix, 0 where a filter fails and infinite elsewhere. The position matrix holds for each order the step at which
each filter runs (the inverse permutation). Their min-plus product is the step that removes a row in an order; rows are
scattered by it with their weights, and a filter that fails a row at a later step than that is redundant for it.

Filter E (identical to a smaller id's text anywhere in the table) is counted without moving texts: rows are counted by
text digest, part, mask and labels in the map tasks, so a group of copies of any size reaches its digest as a few rows.
Digests are SHA-256, taken for equality of texts.

Null text counts as empty, null ``lang`` as the part ''. A row with a null id takes part, but has no labels, is nobody's
smaller id and has none itself. Rows that repeat an id and text are equal, not smaller. A label that any row of an id
sets to 1 holds for the id. An empty table has no parts.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from roamlog.llm.common import query, table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
#: ``POSITION[f, o]``: the step (1-5) at which order ``o`` runs filter ``f``.
POSITION = np.array([[order.index(f) + 1 for order in ORDERS] for f in FILTERS])
_NEVER = len(FILTERS) + 1


def text_masks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, digest, mask): filters A to D as bits 0 to 3, from one pass over the whole texts."""
    t = docs.select(F.col(id_col).alias("id"), F.coalesce(part, F.lit("")).alias("part"), F.coalesce(text, F.lit("")).alias("t"))
    n = t.withColumn("w", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), "")).select(
        "id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("distinct"),
        F.regexp_count("t", F.lit("[A-Z]")).alias("upper"), F.length("t").alias("points"),
        F.col("t").rlike(r"[#$%&*|]").alias("symbol"))
    fails = [F.col("n") < 200, 100 * F.col("distinct") < 50 * F.col("n"), 100 * F.col("upper") > 3 * F.col("points"), F.col("symbol")]
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails)), F.lit(0))
    return n.select("id", "part", "digest", mask.alias("mask"))


def mask_classes(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): documents counted by what they fail and how they are labelled, at most 128 rows a part."""
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).withColumn("at", F.col("id"))
    # Rows without an id meet no label; their digest spreads them over the tasks.
    rows = text_masks(docs, id_col, text, part).withColumn("at", F.coalesce("id", F.xxhash64("digest"))).join(
        known, ["id", "at"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    keys = ["digest", "part", "mask", "good", "toxic"]
    # An id may be repeated: rows of one id are counted first, which needs no shuffle after the join on it.
    same = rows.groupBy("id", "at", *keys).agg(F.count("*").alias("n"))
    counted = same.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNotNull(), F.col("n"))), F.lit(0)).alias("named"),
        F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"))
    first = F.min("least").over(Window.partitionBy("digest"))
    split = counted.withColumn("first", first).withColumn(
        "copies", F.col("named") - F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0))
    both = F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("copies")).alias("n")),
                   F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), F.col("copies").alias("n")))
    return split.select("part", "good", "toxic", F.inline(both)).filter("n > 0").groupBy("part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"))


def removal_steps(masks: np.ndarray) -> np.ndarray:
    """``steps[r, o]``: the step at which order ``o`` removes a row with mask ``masks[r]`` (6: never).

    The min-plus product of the rows' mask matrix with ``POSITION``.
    """
    fails = (masks[:, None] >> np.arange(len(FILTERS))) & 1
    cost = np.where(fails > 0, 0, _NEVER)
    steps = np.full((len(masks), len(ORDERS)), _NEVER)
    for f in range(len(FILTERS)):
        np.minimum(steps, cost[:, f, None] + POSITION[f], out=steps)
    return steps


def audit_classes(masks: np.ndarray, good: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Counts per (order, step) of one part, whose classes are ``masks`` with ``n`` documents each."""
    steps, orders = removal_steps(masks), np.arange(len(ORDERS))
    shape = (len(ORDERS), _NEVER + 1)

    def scatter(at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Weights summed by (order, step)."""
        out = np.zeros(shape, np.int64)
        np.add.at(out, (np.broadcast_to(orders, at.shape), at), np.broadcast_to(weights[:, None], at.shape))
        return out[:, 1:_NEVER]

    removed = scatter(steps, n)
    redundant = np.zeros_like(removed)
    shapley, alone = np.zeros(len(FILTERS), np.int64), np.zeros(len(FILTERS), np.int64)
    for f in range(len(FILTERS)):
        failing = (masks >> f) & 1 > 0
        at = np.broadcast_to(POSITION[f], (int(failing.sum()), len(ORDERS)))
        late = steps[failing] < at
        redundant += scatter(np.where(late, at, 0), n[failing])
        shapley[f] = (np.where(late, 0, 1) * n[failing][:, None]).sum()
        alone[f] = n[masks == 1 << f].sum()
    which = np.argsort(POSITION.T, axis=1)
    return {
        "kept": n.sum() - np.cumsum(removed, axis=1), "removed": removed, "redundant": redundant,
        "unique_fails": alone[which], "good_lost": scatter(steps, n * good), "toxic_lost": scatter(steps, n * toxic),
        "shapley": shapley[which],
    }


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, counts): 600 rows per part, from its at most 128 classes."""
    classes = mask_classes(docs, labels, id_col, text, part).groupBy("part").agg(
        F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("classes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, rows in zip(batch.column("part").to_pylist(), batch.column("classes").to_pylist()):
                table = np.array([[r["mask"], r["good"], r["toxic"], r["n"]] for r in rows], np.int64)
                counts = audit_classes(*table.T)
                cells = len(ORDERS) * len(FILTERS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * cells), pa.array(np.repeat(ORDERS, len(FILTERS)).tolist()),
                     pa.array(np.tile(np.arange(1, _NEVER, dtype=np.int32), len(ORDERS))),
                     *[pa.array(counts[c].ravel()) for c in COUNTS]],
                    names=["part", "filter_order", "step", *COUNTS])

    return classes.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


_SQL = r"""
WITH RECURSIVE w AS (
  SELECT d.doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1) AS good,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) AS toxic FROM documents d
), m AS (
  SELECT part, good, toxic, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM w
), c AS (
  SELECT part, fails, good, toxic, count(*) AS n FROM m GROUP BY ALL
), o(o) AS (
  SELECT '' UNION ALL SELECT o || f FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f) WHERE position(f IN o) = 0
), p AS (
  SELECT o AS filter_order, s AS step, o[s:s] AS f, o[1:s - 1] AS earlier FROM o, range(1, 6) r(s) WHERE length(o) = 5
), x AS (
  SELECT c.*, p.*, position(f IN fails) > 0 AS hit, len(list_filter(string_split(earlier, ''), lambda e: position(e IN fails) > 0 AND e <> '')) > 0 AS gone FROM c, p
), a AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
    coalesce(sum(n) FILTER (hit AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (hit AND NOT gone AND toxic), 0) AS toxic_lost
  FROM x GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM a"""


@query("op11_min_plus_audit", _SQL)
def _(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
