"""Hidden Markov language model: Baum-Welch on counts summed across partitions, exact likelihood by forward recursion.

States emit word classes. The ``OWN_WORDS`` most frequent training words and the end of a text are classes of their own;
every other word, seen or not, falls into one of ``BUCKETS`` classes by its hash and is drawn within it in proportion to
its count plus one (an unseen word as if its count were 0). So the model gives a probability to every text, its tables
have a fixed size, and word counts, which grow with the corpus, stay in a table that is joined by word.

Training: each round turns class sequences into expected counts of states, transitions and emissions, one row per class
and partition, which Spark adds up. Texts are cut into segments of ``SEGMENT`` tokens for this; scoring runs the scaled
forward recursion over whole texts, so its likelihood is that of the whole sequence.

Null, empty and blank texts are the end token alone. Rows that repeat an id are scored one by one. Without training
rows there are no counts, and every word is unseen.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from roamlog.llm.common import chunks, query, table, utf8
from roamlog.session import stage

STATES, ROUNDS, SEGMENT = 8, 4, 512
OWN_WORDS, BUCKETS = 16_384, 4_096
#: Most words, by falling frequency, whose counts go to every task (about 30 bytes each); those of others are joined.
TOP_WORDS = 200_000
#: Distinct words a task counts before it passes them on.
COUNTER_WORDS = 500_000
#: Weight of the overall class distribution in each state's emissions: in tokens, and as a share.
PRIOR, SHARE = 100.0, 0.1


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all rows; words are counted in the tasks first."""

    def flush(counter: Counter) -> pa.RecordBatch:
        words = pa.array(list(counter), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counter.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter = Counter()
        for b in chunks(batches, text):
            for t in utf8(b.column(text)):
                counter.update(t.lower().split())
            if len(counter) > COUNTER_WORDS:
                yield flush(counter)
                counter = Counter()
        yield flush(counter)

    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    """What tasks need to know of the training counts; its size does not grow with the corpus."""

    own: dict[bytes, int]  # word -> class
    top: dict[bytes, int]  # word -> count
    bucket_mass: np.ndarray  # per bucket: counts and distinct words, plus one for an unseen word
    class_counts: np.ndarray
    tokens: int
    distinct: int

    @property
    def end(self) -> int:
        return OWN_WORDS

    @property
    def classes(self) -> int:
        return OWN_WORDS + 1 + BUCKETS


def _frequency_bin() -> Column:
    """Exact below 1024, then 64 bins for each doubling: a few thousand bins at any size."""
    n = F.col("n")
    return F.when(n < 1024, n).otherwise(1024 + F.floor(64 * (F.log2(n) - 10))).cast("long")


def summarise(vocabulary: DataFrame, n_docs: int) -> Counts:
    """``vocabulary`` (word, n) is a staged table; only its frequent head and sums per bucket reach the driver."""
    # Frequencies are counted in bins to find how frequent a word must be to belong to the head.
    bins = vocabulary.groupBy(_frequency_bin().alias("b")).agg(F.count("*").alias("words")).orderBy(F.desc("b")).collect()
    room, least = TOP_WORDS, None
    for r in bins:
        room -= r.words
        if room < 0:
            break
        least = r.b
    head = [] if least is None else [(r.word.encode(), r.n) for r in vocabulary.filter(_frequency_bin() >= least).collect()]
    head.sort(key=lambda x: (-x[1], x[0]))
    total = vocabulary.agg(F.count("*").alias("words"), F.sum("n").alias("n")).head()
    own = {w: k for k, (w, _) in enumerate(head[:OWN_WORDS])}
    bucket = (F.crc32(F.col("word").cast("binary")) % BUCKETS).alias("bucket")
    mass, counts = np.ones(BUCKETS), np.zeros(OWN_WORDS + 1 + BUCKETS)
    for r in vocabulary.groupBy(bucket).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        mass[r.bucket] += r.n + r.words
        counts[OWN_WORDS + 1 + r.bucket] += r.n
    for w, n in head[:OWN_WORDS]:
        b = zlib.crc32(w) % BUCKETS
        mass[b] -= n + 1
        counts[OWN_WORDS + 1 + b] -= n
        counts[own[w]] = n
    counts[OWN_WORDS] = n_docs
    return Counts(own, dict(head), mass, counts, (total.n or 0) + n_docs, total.words + (n_docs > 0))


def sequences(docs: DataFrame, counts: Counts) -> DataFrame:
    """Per row of ``docs`` (row, id, held_out, text): its class sequence, sums over its frequent words, its other words.

    ``log_counts`` is the sum of log10(c + 1), ``log_in_class`` that of log10 P(word | class), each over the tokens whose
    counts are at hand; ``rare`` holds Spark's xxhash64 of the remaining tokens.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vars(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counts(**sent.value)
        first = OWN_WORDS + 1
        log_mass = np.log10(c.bucket_mass)
        # Per distinct word: class, log10(c + 1), log10 P(word | class) without the count of rare words, known here?
        memory: dict[bytes, int] = {}
        kinds: list[int] = []
        logs: list[float] = []
        inside: list[float] = []
        hashes: list[int] = []  # 0 where the count is at hand

        def learn(words: set[bytes]) -> None:
            for w in words:
                memory[w] = len(kinds)
                n, k = c.top.get(w), c.own.get(w)
                log = np.log10(n + 1) if n is not None else 0.0
                if k is None:
                    b = zlib.crc32(w) % BUCKETS
                    k = first + b
                    inside.append(log - log_mass[b])
                else:
                    inside.append(0.0)
                kinds.append(k)
                logs.append(log)
                hashes.append(0 if n is not None else xxhash.xxh64_intdigest(w, 42) or 1)

        for b in chunks(batches, "text"):
            cut = [t.lower().split() for t in utf8(b.column("text"))]
            fresh = set().union(*cut).difference(memory)
            if len(memory) + len(fresh) > COUNTER_WORDS:
                for x in (memory, kinds, logs, inside, hashes):
                    x.clear()
                fresh = set().union(*cut)
            learn(fresh)
            kind, log, within = np.array(kinds, np.uint16), np.array(logs), np.array(inside)
            rare_hash = np.array(hashes, np.uint64).view(np.int64)
            out: list[list] = [[], [], [], [], [], []]
            for words in cut:
                k = np.fromiter(map(memory.__getitem__, words), np.int64, len(words))
                h = rare_hash[k]
                rare = h[h != 0]
                row = (np.append(kind[k], OWN_WORDS).astype("<u2").tobytes(), len(words) + 1,
                       len(words) - len(rare) + (c.class_counts[OWN_WORDS] > 0),
                       float(log[k].sum() + np.log10(c.class_counts[OWN_WORDS] + 1)), float(within[k].sum()), rare)
                for x, v in zip(out, row):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([
                *[b.column(x) for x in ("row", "id", "held_out")], pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()),
                pa.array(np.array(out[2], np.int64)), pa.array(out[3]), pa.array(out[4]), pa.array(out[5], pa.list_(pa.int64()))],
                names=["row", "id", "held_out", "classes", "n_tokens", "n_known", "log_counts", "log_in_class", "rare"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"row long, id {kind}, held_out boolean, classes binary, n_tokens long, n_known long, "
                                "log_counts double, log_in_class double, rare array<long>")


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes x states


def first_model(counts: Counts, states: int = STATES, seed: int = 3) -> Model:
    """States that tend to stay, with the overall class distribution disturbed differently in each."""
    rng = np.random.default_rng(seed)
    p = (counts.class_counts + 1)[:, None] * np.exp(1.5 * rng.standard_normal((counts.classes, states)))
    move = np.full((states, states), 0.05 / max(states - 1, 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, p / p.sum(axis=0))


class Ragged:
    """Sequences side by side, longest first: step t is one slice over the sequences that reach it."""

    def __init__(self, parts: list[np.ndarray]):
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        self.order = np.argsort(-size, kind="stable")
        size = size[self.order]
        self.width = np.searchsorted(-size, -np.arange(size[0]), side="left")  # sequences longer than t
        self.at = np.concatenate([[0], np.cumsum(self.width)])
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        place = self.at[step] + np.repeat(np.arange(len(parts)), size)
        self.symbols = np.empty(len(step), np.int64)
        self.symbols[place] = np.concatenate([parts[k] for k in self.order])


def log_likelihoods(parts: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 of the probability of each class sequence, by the scaled forward recursion."""
    r = Ragged(parts)
    out = np.zeros(len(parts))
    a = np.broadcast_to(model.start, (len(parts), len(model.start)))
    for t, n in enumerate(r.width):
        a = (a[:n] @ model.move if t else a[:n]) * model.emit[r.symbols[r.at[t] : r.at[t] + n]]
        scale = a.sum(axis=1)
        out[:n] += np.log10(scale)
        a = a / scale[:, None]
    back = np.empty(len(parts))
    back[r.order] = out
    return back


def expected_counts(parts: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected (start, transition, emission) counts of the sequences under the model."""
    r = Ragged(parts)
    emit = model.emit[r.symbols]
    alpha = np.empty_like(emit)
    scales = np.empty(len(emit))
    a = np.broadcast_to(model.start, (len(parts), len(model.start)))
    for t, n in enumerate(r.width):
        s = slice(r.at[t], r.at[t] + n)
        a = (a[:n] @ model.move if t else a[:n]) * emit[s]
        scales[s] = a.sum(axis=1)
        a = a / scales[s, None]
        alpha[s] = a
    gamma = alpha  # becomes alpha * beta in place, from the end
    moves = np.zeros_like(model.move)
    beta = None
    for t in range(len(r.width) - 1, -1, -1):
        n = r.width[t]
        s = slice(r.at[t], r.at[t] + n)
        here = np.ones((n, len(model.start)))
        if beta is not None:
            m = r.width[t + 1]
            u = slice(r.at[t + 1], r.at[t + 1] + m)
            w = emit[u] * beta / scales[u, None]
            moves += alpha[s][:m].T @ w
            here[:m] = w @ model.move.T
        beta = here
        if t + 1 < len(r.width):
            u = slice(r.at[t + 1], r.at[t + 1] + r.width[t + 1])
            gamma[u] *= later
        later = here
    gamma[: r.width[0]] *= later
    emissions = np.column_stack([np.bincount(r.symbols, weights=gamma[:, k], minlength=len(model.emit)) for k in range(len(model.start))])
    return gamma[: r.width[0]].sum(axis=0), moves * model.move, emissions


def _segments(blobs: list[bytes]) -> list[np.ndarray]:
    whole = [np.frombuffer(x, "<u2") for x in blobs]
    return [w[k : k + SEGMENT] for w in whole for k in range(0, len(w), SEGMENT)]


def improve(training: DataFrame, model: Model, counts: Counts) -> Model:
    """One round of Baum-Welch over ``training`` (classes)."""
    sent = training.sparkSession.sparkContext.broadcast(vars(model))
    states = len(model.start)
    names = [f"s{k}" for k in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**sent.value)
        total = [np.zeros(states), np.zeros((states, states)), np.zeros((len(m.emit), states))]
        for b in chunks(batches, "classes", 2 << 20):
            for x, y in zip(total, expected_counts(_segments(b.column("classes").to_pylist()), m)):
                x += y
        rows = np.vstack([total[0][None], *total[1:]])
        seen = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen)] + [pa.array(rows[seen, k]) for k in range(states)], names=["k", *names])

    found = training.select("classes").mapInArrow(run, "k long, " + ", ".join(f"{n} double" for n in names)).groupBy("k").agg(
        *[F.sum(n).alias(n) for n in names]).collect()
    rows = np.zeros((1 + states + counts.classes, states))
    for r in found:
        rows[r.k] = r[1:]
    share = (counts.class_counts + 1) / (counts.class_counts + 1).sum()
    start, move, emit = rows[0] + 1, rows[1 : 1 + states] + 1, rows[1 + states :] + PRIOR * share[:, None]
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), (1 - SHARE) * emit / emit.sum(axis=0) + SHARE * share[:, None])


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text: str = "text", states: int = STATES,
          rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs``: id, ``held_out``, token numbers, the unigram ``base_score`` and the model's ``score``.

    The model is trained on the rows that are not held out; both scores are log10 probabilities.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    training = rows.filter("NOT held_out")
    vocabulary = stage(word_counts(training), "vocabulary")
    counts = summarise(vocabulary, training.count())
    coded = stage(sequences(rows.withColumn("row", F.monotonically_increasing_id()), counts), "class-sequences")
    model = first_model(counts, states)
    for _ in range(rounds if counts.tokens else 0):
        model = improve(coded.filter("NOT held_out"), model, counts)
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**sent.value)
        for b in chunks(batches, "classes", 4 << 20):
            logs = log_likelihoods([np.frombuffer(x, "<u2") for x in b.column("classes").to_pylist()], m)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in b.schema.names if c != "classes"] + [pa.array(logs)],
                                             names=[c for c in b.schema.names if c != "classes"] + ["log_classes"])

    known = coded.drop("rare")
    kind = known.schema["id"].dataType.simpleString()
    forward = known.select("row", "id", "held_out", "n_tokens", "n_known", "log_counts", "log_in_class", "classes").mapInArrow(
        run, f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, log_counts double, log_in_class double, log_classes double")
    tokens = coded.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count("*").alias("times"))
    found = tokens.join(vocabulary.select(F.xxhash64("word").alias("h"), "n"), "h").groupBy("row").agg(
        F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_logs"))
    zero = F.lit(0).cast("long")
    out = forward.join(found, "row", "left").withColumn("more", F.coalesce("rare_logs", F.lit(0.0)))
    per_token = float(np.log10(counts.tokens + counts.distinct + 1))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", zero)).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") + F.col("more") - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("log_classes") + F.col("log_in_class") + F.col("more")).alias("score"))


@query("op4_hidden_markov_lm")
def _(spark, sf_dir):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score(table(spark, sf_dir, "documents"), held)
