"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

A string of ``LENGTH`` bytes is represented by the suffix that starts at its minimizer: of the ``ANCHOR``-byte strings in
it, the one with the smallest hash. Equal strings have equal minimizers, so suffixes that start elsewhere need not be
indexed; about one position in 75 remains. Suffixes are kept in the order of the hash of their first ``ANCHOR`` bytes
(rather than of the bytes: only equality matters here), which is the order a merge-scan needs.

New documents come in batches. A batch gets its own suffix array, is merge-scanned against the levels so far for shared
anchors, and becomes a level; before the next batch, levels of equal size merge into one of twice the size, so that a
corpus of N batches is spread over log N levels and every suffix is rewritten log N times.

Suffixes whose anchor is shared are then judged: consecutive strings with one minimizer form a run, and a run whose
whole stretch of bytes occurs twice is repeated in full. The others, and one copy of each repeated run beside them, are cut
into pieces of ``PIECE`` offsets from their anchor. Strings of a piece have its core in common: a core found once under its
anchor repeats no string, and pieces equal in all their bytes repeat them all. Of what is left, the pieces that straddle
the end of a repeat, and of one copy of each repeated piece beside them, single strings are compared. All comparisons are
on 64-bit hashes.

Null, empty and short texts lose nothing. Matches never cross documents. Rows that repeat are occurrences of their own.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from roamlog.llm.common import chunks, query, table, utf8, with_row_key
from roamlog.llm.minhash import mixed
from roamlog.session import delete_paths, stage, stage_apart

LENGTH, ANCHOR = 200, 48
BATCHES = 4
#: Offsets from an anchor that are judged together before single strings are.
PIECE = 16

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW = np.uint64(0xFFFFFFFF)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], done, step = 1, 1, base
    while done < n:  # base ** (done + i) = base ** done * base ** i
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


class Hasher:
    """Hashes of all strings of a text: prefix sums of byte values times powers of an odd base, modulo 2**64."""

    def __init__(self, seed: int = 5):
        self.value = np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)
        self.power, self.inverse = np.empty(0, np.uint64), np.empty(0, np.uint64)

    def prefix(self, text: bytes) -> np.ndarray:
        n = len(text)
        if n + 1 > len(self.power):
            size = max(n + 1, 2 * len(self.power), 1 << 16)
            self.power, self.inverse = _powers(_BASE, size), _powers(_INVERSE, size)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[np.frombuffer(text, np.uint8)] * self.power[:n], out=out[1:])
        return out

    def strings(self, prefix: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.inverse[: len(prefix)][start]


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, from running minima to the left and right inside blocks of ``width``."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    cut = padded.reshape(-1, width)
    left = np.minimum.accumulate(cut, axis=1).ravel()
    right = np.minimum.accumulate(cut[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


class Runs:
    """Runs of consecutive strings of a text with one minimizer: ``low``..``high`` are the starts of the strings."""

    def __init__(self, text: bytes, hasher: Hasher):
        n = len(text)
        self.low = self.high = self.at = np.empty(0, np.int64)
        self.key = self.stretch = np.empty(0, np.int64)
        self.prefix = np.zeros(1, np.uint64)
        self.hasher = hasher
        if n < LENGTH:
            return
        self.prefix = hasher.prefix(text)
        anchors = mixed(hasher.strings(self.prefix, slice(0, n - ANCHOR + 1), slice(ANCHOR, n + 1)))
        order = (anchors & ~_LOW) | np.arange(len(anchors), dtype=np.uint64)
        at = (sliding_minimum(order, LENGTH - ANCHOR + 1) & _LOW).astype(np.int64)
        cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
        self.low = np.concatenate([[0], cuts])
        self.high = np.concatenate([cuts - 1, [len(at) - 1]])
        self.at = at[self.low]
        self.key = anchors[self.at].view(np.int64)
        whole = hasher.strings(self.prefix, self.low, self.high + LENGTH)
        shape = ((self.high - self.low) << 20 | (self.at - self.low)).astype(np.uint64)
        self.stretch = mixed(whole + mixed(shape)).view(np.int64)

    def piece_hashes(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the cores and of all bytes of the pieces of ``runs``, in the order of :func:`_pieces`."""
        at, low, high = self.at[runs], self.low[runs], self.high[runs]
        run, piece, first, last = _pieces(at, low, high)
        core = at[run] - PIECE * piece
        under = mixed(self.key[runs][run].view(np.uint64) + piece.astype(np.uint64))
        cores = self.hasher.strings(self.prefix, core, core - (PIECE - 1) + LENGTH)
        whole = self.hasher.strings(self.prefix, first, last + LENGTH)
        shape = ((last - first) << 20 | (at[run] - first)).astype(np.uint64)
        return mixed(cores + under).view(np.int64), mixed(whole + mixed(shape)).view(np.int64)


def string_hashes(text: bytes, hasher: Hasher, start: np.ndarray) -> np.ndarray:
    return mixed(hasher.strings(hasher.prefix(text), start, start + LENGTH)).view(np.int64)


def _pieces(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per piece of the runs (anchors ``at``, starts of strings ``low``..``high``): its run, its number, and the first and
    last start of its strings. Piece p holds the strings that begin p * ``PIECE`` bytes before the anchor or a little more."""
    nearest, farthest = (at - high) // PIECE, (at - low) // PIECE
    size = farthest - nearest + 1
    run = np.repeat(np.arange(len(at)), size)
    piece = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + nearest[run]
    return run, piece, np.maximum(low[run], at[run] - PIECE * piece - (PIECE - 1)), np.minimum(high[run], at[run] - PIECE * piece)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def suffix_samples(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (_key, text): the keys of its runs in order, and hashes of their stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in chunks(batches, "text"):
            found = [Runs(t, hasher) for t in utf8(b.column("text"))]
            yield pa.RecordBatch.from_arrays([
                b.column("_key"), _lists([r.key for r in found], pa.int64()), _lists([r.stretch for r in found], pa.int64())],
                names=["_key", "keys", "stretches"])

    return docs.select("_key", "text").mapInArrow(run, "_key long, keys array<long>, stretches array<long>")


class SuffixLevels:
    """The family of levels: tables (key, n) of anchors in the shared folder, each with its size in batches."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[tuple[int, str, DataFrame]] = []

    def drop(self) -> None:
        """Delete the files of the family."""
        delete_paths(self.spark, [path for _, path, _ in self.levels])
        self.levels = []

    def add(self, keys: DataFrame) -> DataFrame:
        """Take in a batch of suffixes (key); returns the keys it shares with itself or with an earlier level."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, one, a), (_, other, b) = self.levels.pop(), self.levels.pop()
            both = a.unionByName(b).groupBy("key").agg(F.sum("n").alias("n"))
            self.levels.append((2 * size, *stage_apart(both, "suffix-level")))
            delete_paths(self.spark, [one, other])
        path, new = stage_apart(keys.groupBy("key").agg(F.count("*").alias("n")), "suffix-level")
        shared = new.filter("n > 1").select("key")
        for _, _, level in self.levels:
            shared = shared.unionByName(new.select("key").join(level.select("key"), "key"))
        self.levels.append((1, path, new))
        return stage(shared.distinct(), "shared-anchors")


def repeated_strings(docs: DataFrame, batches: int = BATCHES, id_col: str = "doc_id", text: str = "text",
                     with_text: bool = True) -> DataFrame:
    """Per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if ``with_text``, ``spans``
    (starts and ends of removed runs, in bytes) and ``kept`` (the remaining bytes)."""
    spark = docs.sparkSession
    rows = with_row_key(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "id", "text")
    samples_path, samples = stage_apart(suffix_samples(rows), "suffixes")
    family, shared = SuffixLevels(spark), []
    for k in range(batches):
        batch = samples.filter(F.pmod(F.xxhash64("_key"), F.lit(batches)) == k)
        shared.append(family.add(batch.select(F.explode("keys").alias("key"))))
    anchors = shared[0]
    for more in shared[1:]:
        anchors = anchors.unionByName(more)
    anchors_path, anchors = stage_apart(anchors.distinct(), "shared-anchors")
    family.drop()
    # Runs with a shared anchor, counted by their whole stretch.
    each = samples.select("_key", F.posexplode(F.arrays_zip("keys", "stretches")).alias("i", "r")).select(
        "_key", "i", F.col("r.keys").alias("key"), F.col("r.stretches").alias("stretch"))
    some_path, some = stage_apart(each.join(anchors, "key"), "shared-runs")
    delete_paths(spark, [samples_path, anchors_path])
    stretches = some.groupBy("key", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("_key", "i")).alias("one"))
    kinds = stretches.groupBy("key").agg(F.count("*").alias("kinds"))
    stretches_path, stretches = stage_apart(stretches.join(kinds, "key"), "stretches")
    judged = some.join(stretches, ["key", "stretch"]).select(
        "_key", "i", (F.col("n") > 1).alias("whole"),
        ((F.col("kinds") > 1) & ((F.col("n") == 1) | (F.struct("_key", "i") == F.col("one")))).alias("look"))
    per_row = stage(judged.distinct().groupBy("_key").agg(F.collect_list(F.struct("i", "whole", "look")).alias("runs")), "runs-of-rows")
    delete_paths(spark, [some_path, stretches_path])
    id_type = docs.schema[id_col].dataType.simpleString()

    def first(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finish rows without runs to look into; others keep their text and the hashes of the pieces of those runs."""
        hasher = Hasher()
        for b in chunks(batches_, "text"):
            out = _Results()
            texts, sought, cores, wholes, spans = [], [], [], [], []
            for t, runs in zip(utf8(b.column("text")), b.column("runs")):
                low = high = wanted = core = bytes_ = np.empty(0, np.int64)
                places = np.empty((3, 0), np.int64)
                if runs.is_valid:
                    r = Runs(t, hasher)
                    i, whole, seek = (v.to_numpy(zero_copy_only=False) for v in runs.values.flatten())
                    low, high = r.low[i[whole]], r.high[i[whole]] + LENGTH
                    wanted = np.unique(i[seek])
                    if len(wanted):
                        places = np.stack([r.at[wanted], r.low[wanted], r.high[wanted]])
                        core, bytes_ = r.piece_hashes(wanted)
                if len(wanted):
                    out.skip()
                else:
                    out.add(t, low, high)
                texts.append(t if len(wanted) else None)
                sought.append(places.ravel())
                cores.append(core)
                wholes.append(bytes_)
                spans.append(np.concatenate([low, high]))
            yield pa.RecordBatch.from_arrays([
                b.column("_key"), b.column("id"), *out.arrays(), pa.array(texts, pa.binary()), _lists(sought, pa.int64()),
                _lists(cores, pa.int64()), _lists(wholes, pa.int64()), _lists(spans, pa.int64())],
                names=["_key", "id", *_Results.NAMES, "text", "sought", "cores", "pieces", "whole"])

    # Texts are shuffled once, at every size alike, and streamed past what is known of their runs.
    half = stage(rows.join(per_row.hint("shuffle_hash"), "_key", "left").select("_key", "id", "text", "runs").mapInArrow(
        first, f"_key long, id {id_type}, {_Results.DDL}, text binary, sought array<long>, cores array<long>, pieces array<long>, whole array<long>"), "judged-rows")
    cut = half.filter("text IS NOT NULL").select("_key", F.posexplode(F.arrays_zip("cores", "pieces")).alias("i", "p")).select(
        "_key", "i", F.col("p.cores").alias("core"), F.col("p.pieces").alias("piece"))
    kinds = cut.groupBy("core", "piece").agg(F.count("*").alias("n"), F.min(F.struct("_key", "i")).alias("one"))
    kinds_path, kinds = stage_apart(kinds, "pieces")
    often = kinds.groupBy("core").agg(F.sum("n").alias("on")).filter("on > 1")
    judged_pieces = cut.join(kinds.join(often, "core"), ["core", "piece"]).select(
        "_key", "i", (F.col("n") > 1).alias("whole"),
        ((F.col("n") == 1) | ((F.col("on") > F.col("n")) & (F.struct("_key", "i") == F.col("one")))).alias("look"))
    pieces_of = stage(judged_pieces.distinct().groupBy("_key").agg(F.collect_list(F.struct("i", "whole", "look")).alias("found")), "pieces-of-rows")
    delete_paths(spark, [kinds_path])

    def second(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finish rows without pieces to look into; others keep their text and the hashes of the strings of those pieces."""
        hasher = Hasher()
        for b in chunks(batches_, "text"):
            out = _Results()
            texts, sought, hashes, spans = [], [], [], []
            for t, whole, runs, found in zip(b.column("text").to_pylist(), *(b.column(c) for c in ("whole", "sought", "found"))):
                low, high = whole.values.to_numpy().reshape(2, -1)
                look_low = look_high = hashed = np.empty(0, np.int64)
                if found.is_valid:
                    *_, start, end = _pieces(*runs.values.to_numpy().reshape(3, -1))
                    i, repeated, seek = (v.to_numpy(zero_copy_only=False) for v in found.values.flatten())
                    low, high = np.concatenate([low, start[i[repeated]]]), np.concatenate([high, end[i[repeated]] + LENGTH])
                    look = np.unique(i[seek])
                    look_low, look_high = start[look], end[look]
                    if len(look):
                        hashed = string_hashes(t, hasher, _starts(look_low, look_high))
                if len(hashed):
                    out.skip()
                else:
                    out.add(t, low, high)
                texts.append(t if len(hashed) else None)
                sought.append(np.concatenate([look_low, look_high]))
                hashes.append(hashed)
                spans.append(np.concatenate([low, high]))
            yield pa.RecordBatch.from_arrays([
                b.column("_key"), b.column("id"), *out.arrays(), pa.array(texts, pa.binary()), _lists(sought, pa.int64()),
                _lists(hashes, pa.int64()), _lists(spans, pa.int64())],
                names=["_key", "id", *_Results.NAMES, "text", "sought", "hashes", "whole"])

    looked = stage(half.filter("text IS NOT NULL").join(pieces_of.hint("shuffle_hash"), "_key", "left").select(
        "_key", "id", "text", "sought", "whole", "found").mapInArrow(
        second, f"_key long, id {id_type}, {_Results.DDL}, text binary, sought array<long>, hashes array<long>, whole array<long>"), "looked-rows")
    strings = looked.filter("text IS NOT NULL").select("_key", F.posexplode("hashes").alias("i", "hash"))
    twice = stage(strings.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "repeated-strings")
    found = strings.join(twice, "hash").select("_key", "i").distinct().groupBy("_key").agg(F.collect_list("i").alias("found"))

    def third(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches_, "text"):
            out = _Results()
            for t, spans, sought, found_ in zip(b.column("text").to_pylist(), *(b.column(c) for c in ("whole", "sought", "found"))):
                (low, high), (look_low, look_high) = (v.values.to_numpy().reshape(2, -1) for v in (spans, sought))
                more = _starts(look_low, look_high)[found_.values.to_numpy()] if found_.is_valid else low[:0]
                out.add(t, np.concatenate([low, more]), np.concatenate([high, more + LENGTH]))
            yield pa.RecordBatch.from_arrays([b.column("id"), *out.arrays()], names=["id", *_Results.NAMES])

    rest = looked.filter("text IS NOT NULL").join(stage(found, "found-strings").hint("shuffle_hash"), "_key", "left").select(
        "id", "text", "whole", "sought", "found").mapInArrow(third, f"id {id_type}, {_Results.DDL}")
    rest = rest.unionByName(looked.filter("text IS NULL").select("id", *_Results.NAMES))
    out = half.filter("text IS NULL").select("id", *_Results.NAMES).unionByName(rest)
    extra = ["spans", "kept"] if with_text else []
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *extra)


def _starts(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All starts of strings in the runs ``low``..``high``, in order."""
    size = high - low + 1
    return np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class _Results:
    """Columns of the result, row by row."""

    NAMES = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
    DDL = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary"

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def skip(self) -> None:
        self.rows.append((None,) * 6)

    def add(self, text: bytes, low: np.ndarray, high: np.ndarray) -> None:
        edge = np.zeros(len(text) + 1, np.int64)
        np.add.at(edge, low, 1)
        np.add.at(edge, high, -1)
        gone = np.cumsum(edge[:-1]) > 0
        turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if len(turns) else text
        self.rows.append((len(text), len(text) - len(kept), len(turns) // 2, hashlib.sha256(kept).hexdigest(), turns, kept))

    def arrays(self) -> list[pa.Array]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()]
        return [pa.array([r[k] for r in self.rows], kind) for k, kind in enumerate(kinds)]


@query("op7_suffix_levels")
def _(spark, sf_dir):
    return repeated_strings(table(spark, sf_dir, "documents"), with_text=False)
