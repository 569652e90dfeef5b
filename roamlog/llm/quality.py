"""Quality rules: an isolation forest over rule statistics, with a threshold calibrated from labelled rows.

A document is described by rates of plain rules (symbols, punctuation, repeated lines and word windows, upper case,
short words). An isolation forest is a set of trees of random splits; a document whose path to a leaf is short on
average is easy to set apart and so unusual. Trees hold labelled good rows; labelled rows say how short is too short.

The forest is fitted on at most ``SAMPLE_ROWS`` labelled rows, chosen by a hash of the id (the one bound here). The
threshold is calibrated on all labelled rows, and statistics and verdicts cover every document.

Null or empty text has no words and fails the base rule. Without usable labels there is no forest, and the base rules
decide alone. Labels that are null, or that contradict each other for an id, are not used.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from roamlog.llm.common import bounded_sample, query, table, utf8
from roamlog.session import stage

#: Most labelled rows the forest is fitted on.
SAMPLE_ROWS = 20_000
TREES, PER_TREE = 256, 256
#: Largest share of labelled good rows, among those the base rules keep, that the threshold may reject.
MAX_FALSE_REJECTS = 0.002
#: Fewer labelled good rows than this fit no forest.
MIN_GOOD = 8
#: Scores are in (0, 1); the calibration counts them in steps of this width.
SCORE_STEP = 1e-4

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
OTHER = ["n_lines", "n_upper", "n_punct", "n_short"]

_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
_SPACE = list(b" \t\n\x0b\x0c\r")
_PUNCT = [i for i in range(33, 127) if not chr(i).isalnum() and i not in _SYMBOLS]


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which is found at least twice in the text (windows by 64-bit hash)."""
    n = len(words)
    if n < 4:
        return 0
    a = np.fromiter(map(hash, words), np.int64, n)
    windows = (a[:-2] * 0x2545F4914F6CDD1D + a[1:-1]) * 0x5851F42D4C957F2D + a[2:]
    _, at, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[at] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum())


def text_stats(text: bytes) -> tuple[int, ...]:
    """The counts ``COUNTS + OTHER`` of one UTF-8 text."""
    words = text.split()
    n = len(words)
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = len(text) - int(by_byte[0x80:0xC0].sum())
    seen: set[bytes] = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dup += line in seen
            seen.add(line)
    lengths = np.fromiter(map(len, words), np.int64, n)
    return (
        n, points - int(by_byte[_SPACE].sum()), int(by_byte[_SYMBOLS].sum()), dup, repeat_words(words), lines,
        int(by_byte[65:91].sum()), int(by_byte[_PUNCT].sum()), int((lengths < 3).sum()),
    )


def features(counts: np.ndarray) -> np.ndarray:
    """Rates of the rules, from the columns ``COUNTS + OTHER``."""
    c = counts.astype(float)
    words, chars, lines = np.maximum(c[:, 0], 1), np.maximum(c[:, 1], 1), np.maximum(c[:, 5], 1)
    return np.column_stack([
        np.log1p(20 * c[:, 2] / words), np.log1p(5 * c[:, 3] / lines), np.log1p(5 * c[:, 4] / words),
        np.log1p(20 * c[:, 6] / chars), np.log1p(20 * c[:, 7] / words), c[:, 8] / words,
    ])


@dataclass
class Forest:
    """Trees as flat arrays: a node sends ``x[feature] < cut`` to ``child`` and the rest to ``child + 1``."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray  # 0 at a leaf
    depth: np.ndarray  # expected path length of rows that end here
    per_tree: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 is anomalous, under 0.5 is usual."""
        total = np.zeros(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), int)
            while (inner := self.child[t, at] > 0).any():
                rows = np.flatnonzero(inner)
                node = at[rows]
                right = x[rows, self.feature[t, node]] >= self.cut[t, node]
                at[rows] = self.child[t, node] + right
            total += self.depth[t, at]
        return np.round(2.0 ** (-total / len(self.feature) / expected_path(self.per_tree)), 9)


def expected_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a random binary tree of ``n`` rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def fit_forest(x: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE,
               seed: int = 7) -> Forest:
    """Trees over the good rows ``x``, split at random inside the box ``low``..``high`` of good and bad rows alike.

    Cuts beyond the good rows leave an empty side, so a document out there is set apart after few splits.
    """
    per_tree = min(per_tree, len(x))
    limit = int(np.ceil(np.log2(max(per_tree, 2))))
    size = 2 << limit
    out = Forest(np.zeros((trees, size), int), np.zeros((trees, size)), np.zeros((trees, size), int),
                 np.zeros((trees, size)), per_tree)
    rng = np.random.default_rng(seed)
    for t in range(trees):
        todo, used = [(0, x[rng.choice(len(x), per_tree, replace=False)], low, high, 0)], 1
        while todo:
            node, rows, a, b, depth = todo.pop()
            f = rng.integers(x.shape[1])
            if depth >= limit or len(rows) < 2 or b[f] <= a[f]:
                out.depth[t, node] = depth + expected_path(len(rows))
                continue
            cut = rng.uniform(a[f], b[f])
            right = rows[:, f] >= cut
            up, down = a.copy(), b.copy()
            up[f] = down[f] = cut
            out.feature[t, node], out.cut[t, node], out.child[t, node] = f, cut, used
            todo += [(used, rows[~right], a, down, depth + 1), (used + 1, rows[right], up, b, depth + 1)]
            used += 2
    return out


def _stat_batches(keep: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([text_stats(t) for t in utf8(batch.column(text))], np.int64)
            stats = stats.reshape(batch.num_rows, len(COUNTS + OTHER))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(stats[:, k]) for k in range(stats.shape[1])],
                names=keep + [f"_{c}" for c in COUNTS + OTHER])

    return run


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: the id and the counts ``_<name>`` of ``COUNTS + OTHER``."""
    ddl = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"_{c} long" for c in COUNTS + OTHER)
    return docs.select(id_col, text).mapInArrow(_stat_batches([id_col], text), ddl)


def base_failed() -> Column:
    return (F.col("_n_words") < 50) | (100 * F.col("_n_repeat_words") > 50 * F.col("_n_words"))


@dataclass
class QualityModel:
    forest: Forest | None
    threshold: float

    def score(self, counts: np.ndarray) -> np.ndarray:
        return self.forest.score(features(counts)) if self.forest and len(counts) else np.zeros(len(counts))


def with_score(stats: DataFrame, model: QualityModel) -> DataFrame:
    """Adds ``_score``; the model is a few thousand numbers and travels with the tasks."""
    names = [f"_{c}" for c in COUNTS + OTHER]
    schema = T.StructType([*stats.schema.fields, T.StructField("_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in names])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(counts))], names=[*b.schema.names, "_score"])

    return stats.mapInArrow(run, schema)


def labelled(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """Statistics of labelled rows with one agreed label per id."""
    agreed = labels.filter(F.col(label).isNotNull()).groupBy(id_col).agg(
        F.min(label).alias("_label"), F.max(label).alias("_other")).filter("_label = _other").drop("_other")
    return stats.join(agreed, id_col)


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality",
        sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Forest from a bounded sample of labelled rows, threshold from all of them.

    ``stats`` is read several times; pass a staged table. The threshold is the lowest score that rejects no more than
    ``MAX_FALSE_REJECTS`` of the good rows the base rules keep.
    """
    names = [f"_{c}" for c in COUNTS + OTHER]
    rows = labelled(stats, labels, id_col, label).filter(~base_failed())
    picked = bounded_sample(rows, sample_rows, id_col, "_label", *names).select("_label", *names).collect()
    sample = np.array(picked, np.int64).reshape(len(picked), 1 + len(names))
    if np.count_nonzero(sample[:, :1] > 0) < MIN_GOOD:
        return QualityModel(None, 1.0)
    x, good = features(sample[:, 1:]), sample[:, 0] > 0
    model = QualityModel(fit_forest(x[good], x.min(axis=0), x.max(axis=0)), 1.0)
    step = F.ceil(F.col("_score") / SCORE_STEP).alias("step")
    counted = with_score(rows, model).groupBy(step).agg(F.sum((F.col("_label") > 0).cast("long")).alias("good")).collect()
    good = {int(r.step): int(r.good) for r in counted}
    allowed, above = int(MAX_FALSE_REJECTS * sum(good.values())), 0
    for s in sorted(good, reverse=True):
        above += good[s]
        if above > allowed:
            model.threshold = s * SCORE_STEP
            break
    return model


def verdicts(stats: DataFrame, model: QualityModel) -> DataFrame:
    """``base_failed``, ``score`` and ``kept`` beside the counts."""
    scored = with_score(stats, model)
    failed = base_failed()
    return scored.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("_score") <= model.threshold))


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: id, the rule counts, anomaly score, ``base_failed`` and ``kept``."""
    stats = stage(rule_statistics(docs, id_col, text), "quality-stats")
    model = fit(stats, labels.select(id_col, "quality"), id_col)
    return verdicts(stats, model).select(
        id_col, *[F.col(f"_{c}").alias(c) for c in COUNTS], F.col("_score").alias("score"), "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, in their own columns.

    The model needs one narrow pass; the texts then pass through the same map once more instead of being shuffled.
    """
    stats = stage(rule_statistics(docs, id_col, text), "quality-stats")
    model = fit(stats, labels.select(id_col, "quality"), id_col)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            counts = np.array([text_stats(t) for t in utf8(b.column(text))], np.int64)
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            yield b.filter(pa.array(~failed & (model.score(counts) <= model.threshold)))

    return docs.mapInArrow(run, schema)


@query("op9_quality_rules")
def _(spark, sf_dir):
    return assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", *COUNTS, "base_failed", "kept", "score")
