"""Quality classifier: a generalised additive model with pairwise interactions over statistics of the text.

Each feature is cut into bins at quantiles of the training rows. Features take turns: a tree of at most three leaves over
the bins of one feature is fitted to the gradients of the log loss, and a small step of it is added to that feature's
table. When a set of rows kept aside gains no more, the pairs of features with the greatest gain on what is left are
found on coarse bins, and trees with one cut on each side add to the tables of the pairs in the same way. Several models,
each with other rows kept aside, are averaged table by table. A score is a sum of bins looked up in the tables.

The model is fitted on at most ``TRAIN_ROWS`` labelled rows, chosen by a hash of the id (the one bound here); statistics
and scores cover every whole text. Only statistics of the text are inputs.

Null text counts as empty and is scored like any other. Labels that are null, or that contradict each other for an id, are
not used. Rows that repeat an id are scored each on their own; a null id is never held out and has no label. Without
labels of both kinds every score is the same: the smoothed share of good rows, 0.5 without any.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from roamlog.llm.common import bounded_sample, chunks, query, table, utf8
from roamlog.session import stage

#: Most labelled rows the model is fitted on.
TRAIN_ROWS = 20_000
BINS, COARSE = 48, 12
PAIRS, BAGS = 8, 4
RATE, ROUNDS, PATIENCE = 0.08, 400, 25
#: Ridge on leaf values, and least sum of second derivatives in a leaf.
RIDGE, LEAST = 1.0, 0.5
LIMIT = 12.0

FEATURES = [
    "words", "word_length", "longest", "symbols", "marks", "stops", "upper", "capitals", "digits", "beyond_ascii",
    "short_words", "distinct", "most_frequent", "repeated_windows", "repeated_lines", "line_words", "byte_entropy",
]
_SPACE = list(b" \t\n\x0b\x0c\r")
_SYMBOLS = list(b"#*$%&|<>@^~=_\\/{}[]")
_MARKS = list(b"!?,;:")


def text_features(text: bytes) -> list[float]:
    """``FEATURES`` of one UTF-8 text: rates and logarithms, 0 where there is nothing to divide by."""
    words = text.split()
    n = len(words)
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = len(text) - int(by_byte[0x80:0xC0].sum())
    chars = points - int(by_byte[_SPACE].sum())
    each, per = max(n, 1), max(chars, 1)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    share = by_byte[by_byte > 0] / max(len(text), 1)
    windows = 0
    if n > 2:
        h = np.fromiter(map(hash, words), np.int64, n)
        _, found = np.unique((h[:-2] * 0x2545F4914F6CDD1D + h[1:-1]) * 0x5851F42D4C957F2D + h[2:], return_counts=True)
        windows = int(found[found > 1].sum())
    return [
        float(np.log1p(n)), chars / each, float(np.log1p(lengths.max(initial=0))), by_byte[_SYMBOLS].sum() / each,
        by_byte[_MARKS].sum() / each, by_byte[ord(".")] / each, by_byte[65:91].sum() / per,
        sum(65 <= w[0] <= 90 for w in words) / each, by_byte[48:58].sum() / per, (points - by_byte[:128].sum()) / per,
        float((lengths < 4).sum()) / each, len(counts) / each, max(counts.values(), default=0) / each,
        windows / max(n - 2, 1), 1 - len(set(lines)) / max(len(lines), 1), float(np.log1p(n / max(len(lines), 1))),
        float(-(share * np.log2(share)).sum()),
    ]


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: the id and one column ``_<feature>`` each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            x = np.array([text_features(t) for t in utf8(batch.column(text))], np.float64).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), *[pa.array(np.ascontiguousarray(c)) for c in x.T]], names=[id_col, *[f"_{f}" for f in FEATURES]])

    ddl = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"_{f} double" for f in FEATURES)
    return docs.select(id_col, text).mapInArrow(run, ddl)


def cuts_of(x: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins - 1`` cuts at quantiles; a value goes to the bin of the cuts that are not above it."""
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="higher")) if len(x) else np.zeros(0)


@dataclass
class Additive:
    """Tables over bins: one per feature, one per pair. The score is a logistic function of their sum."""

    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, (cuts, values) in enumerate(zip(self.cuts, self.tables)):
            out += values[np.searchsorted(cuts, x[:, k], side="right")]
        at = {k: np.searchsorted(self.coarse[k], x[:, k], side="right") for k in {k for pair in self.pairs for k in pair}}
        for (a, b), values in zip(self.pairs, self.pair_tables):
            out += values[at[a], at[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(logistic(self.raw(x)), 9)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -LIMIT, LIMIT)))


def log_loss(y: np.ndarray, z: np.ndarray) -> float:
    p = logistic(z)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.where(h >= LEAST, g * g / (h + RIDGE), -np.inf)


def tree_step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per bin of the best tree of at most three leaves (two cuts, the second inside either side)."""
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    edges = [0, len(g)]
    for _ in range(2):
        best, at = 1e-9, None
        for lo, hi in zip(edges, edges[1:]):
            if hi - lo < 2:
                continue
            mid = np.arange(lo + 1, hi)
            gain = _gain(G[mid] - G[lo], H[mid] - H[lo]) + _gain(G[hi] - G[mid], H[hi] - H[mid]) - _gain(G[hi] - G[lo], H[hi] - H[lo])
            if gain.max() > best:
                best, at = gain.max(), int(mid[gain.argmax()])
        if at is None:
            break
        edges = sorted([*edges, at])
    out = np.zeros(len(g))
    if len(edges) > 2:
        for lo, hi in zip(edges, edges[1:]):
            out[lo:hi] = (G[hi] - G[lo]) / (H[hi] - H[lo] + RIDGE)
    return out


def quadrant_step(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values per cell of the best tree with one cut on each axis of the grid."""
    def sums(a: np.ndarray) -> np.ndarray:
        out = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
        out[1:, 1:] = a.cumsum(0).cumsum(1)
        return out

    out = np.zeros(g.shape)
    if min(g.shape) < 2:
        return 0.0, out
    G, H = sums(g), sums(h)
    inner = (slice(1, -1), slice(1, -1))

    def quarters(s: np.ndarray) -> list[np.ndarray]:
        left, top, whole = s[1:-1, -1:], s[-1:, 1:-1], s[-1, -1]
        return [s[inner], left - s[inner], top - s[inner], whole - left - top + s[inner]]

    gq, hq = quarters(G), quarters(H)
    # Against the better of the two single cuts, so that only what needs both features counts.
    rows = _gain(G[1:-1, -1:], H[1:-1, -1:]) + _gain(G[-1, -1] - G[1:-1, -1:], H[-1, -1] - H[1:-1, -1:])
    cols = _gain(G[-1:, 1:-1], H[-1:, 1:-1]) + _gain(G[-1, -1] - G[-1:, 1:-1], H[-1, -1] - H[-1:, 1:-1])
    total = sum(np.where(b >= LEAST, a * a / (b + RIDGE), 0) for a, b in zip(gq, hq))
    gain = total - np.maximum(np.maximum(rows, cols).max(), 0)
    r, c = np.unravel_index(int(total.argmax()), total.shape)
    value = [a[r, c] / (b[r, c] + RIDGE) for a, b in zip(gq, hq)]
    out[: r + 1, : c + 1], out[: r + 1, c + 1 :], out[r + 1 :, : c + 1], out[r + 1 :, c + 1 :] = value
    return float(gain[r, c]), out


def _boost(y, z, held, at, sizes, step) -> list[np.ndarray]:
    """Cyclic boosting of the tables whose bins are ``at``; returns them as of the best round on the rows ``held``."""
    tables = [np.zeros(n) for n in sizes]
    best, kept, since = log_loss(y[held], z[held]), [t.copy() for t in tables], 0
    live = ~held
    for _ in range(ROUNDS):
        for k, bins in enumerate(at):
            p = logistic(z)
            g = np.bincount(bins[live], (y - p)[live], sizes[k])
            h = np.bincount(bins[live], (p * (1 - p))[live], sizes[k])
            values = RATE * step(k, g, h)
            tables[k] += values
            z += values[bins]
        loss = log_loss(y[held], z[held])
        if loss < best - 1e-7:
            best, kept, since = loss, [t.copy() for t in tables], 0
        else:
            since += 1
            if since == PATIENCE:
                break
    return kept


def fit_tables(x: np.ndarray, y: np.ndarray) -> Additive:
    """The averaged model of ``BAGS`` fits to the features ``x`` and labels ``y`` (0 or 1)."""
    n, good = len(y), float(y.sum())
    base = float(np.log((good + 1) / (n - good + 1)))
    if good in (0, n) or n < 2 * BAGS:
        return Additive(base)
    cuts, coarse = [cuts_of(c, BINS) for c in x.T], [cuts_of(c, COARSE) for c in x.T]
    at = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(cuts)]
    rough = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(coarse)]
    sizes, steps = [len(c) + 1 for c in cuts], [len(c) + 1 for c in coarse]
    total, starts = [np.zeros(s) for s in sizes], []
    for bag in range(BAGS):
        held = np.arange(n) % BAGS == bag
        z = np.full(n, base)
        tables = _boost(y, z, held, at, sizes, lambda k, g, h: tree_step(g, h))
        z = base + sum(t[b] for t, b in zip(tables, at))
        starts.append((held, z))
        total = [a + t / BAGS for a, t in zip(total, tables)]

    def gain(pair: tuple[int, int]) -> float:
        a, b = pair
        shape, cell, out = (steps[a], steps[b]), rough[a] * steps[b] + rough[b], 0.0
        for held, z in starts:
            p = logistic(z)
            g = np.bincount(cell, np.where(held, 0, y - p), shape[0] * shape[1]).reshape(shape)
            h = np.bincount(cell, np.where(held, 0, p * (1 - p)), shape[0] * shape[1]).reshape(shape)
            out += quadrant_step(g, h)[0]
        return out

    pairs = sorted(sorted(combinations(range(x.shape[1]), 2), key=gain, reverse=True)[:PAIRS])
    cells = [rough[a] * steps[b] + rough[b] for a, b in pairs]
    shapes = [(steps[a], steps[b]) for a, b in pairs]
    both = [np.zeros(s) for s in shapes]
    for held, z in starts:
        tables = _boost(y, z.copy(), held, cells, [s[0] * s[1] for s in shapes],
                        lambda k, g, h: quadrant_step(g.reshape(shapes[k]), h.reshape(shapes[k]))[1].ravel())
        both = [a + t.reshape(s) / BAGS for a, t, s in zip(both, tables, shapes)]
    return Additive(base, cuts, total, pairs, coarse, both)


def fold(id_col: str = "doc_id") -> Column:
    """Whether a row is held out: the remainder of its id's checksum by 3 is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", train_rows: int = TRAIN_ROWS) -> Additive:
    """Model of the labelled rows of ``stats`` that are not held out. ``stats`` is read twice; pass a staged table."""
    agreed = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.min(label).alias("_label"), F.max(label).alias("_other")).filter("_label = _other").drop("_other")
    names = [f"_{f}" for f in FEATURES]
    rows = stats.filter(~fold(id_col)).join(agreed, id_col)
    picked = bounded_sample(rows, train_rows, id_col, *names).select(*names, (F.col("_label") > 0).cast("int")).collect()
    both = np.array(picked, np.float64).reshape(len(picked), len(names) + 1)
    return fit_tables(both[:, :-1], both[:, -1])


def with_score(stats: DataFrame, model: Additive) -> DataFrame:
    """Adds ``_score``; the tables are some thousand numbers and travel with the tasks."""
    names = [f"_{f}" for f in FEATURES]
    schema = T.StructType([*stats.schema.fields, T.StructField("_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in names])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x))], names=[*b.schema.names, "_score"])

    return stats.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``held_out``, ``score`` and ``predicted``."""
    stats = stage(text_statistics(docs, id_col, text), "additive-stats")
    model = fit(stats, labels.select(F.col("doc_id").alias(id_col), "quality"), id_col)
    return with_score(stats, model).select(
        id_col, fold(id_col).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


@query("op13_additive_quality")
def _(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
