"""Near-duplicate documents by circulant MinHash, banding and exact verification.

A document is its set of word shingles. Two permutations make the whole signature: sigma places a shingle on a circle
of ``CIRCLE`` positions, and coordinate k is the smallest value of pi among the places moved by k. With pi stored once
round the circle (and a little further), the values of one shingle for all coordinates are one slice of it.

Copies with equal sets become one class first. Signatures of the classes are cut into bands; classes that agree in a
band are candidates, and every link is confirmed on full sets. At a similarity of 0.8 a pair misses all 48 bands of 6
rows with probability 5e-7.

A bucket is never turned into all its pairs. Its members are compared with one hub first, the member that shares most
places in buckets and so is nearest the centre, which costs a row per member and links most of a group of near copies.
Only members outside their bucket's largest component then meet the rest of their bucket. They do so in blocks of at
most about ``BLOCK`` members: one-bit minima of ``SKETCH`` coordinates give the similarity of all pairs of two blocks at
once, to within 0.014 (one standard deviation at 0.8), and pairs ``SKETCH_MARGIN`` or more below the bound are out
(probability 1e-5 for a pair at the bound). No pair of different components goes unchecked.

Null, empty and blank texts have no shingles and link with nothing. Texts with fewer words than a shingle are one
shingle. Rows with a null id link with nothing. Rows that repeat an id are one node of the graph and get one component.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from roamlog.llm.common import chunks, query, table, utf8
from roamlog.llm.links import components, joined
from roamlog.session import stage

BANDS, ROWS = 48, 6
CIRCLE = 1 << 20
#: Members in a block, and coordinates of the one-bit sketch that blocks are compared by.
BLOCK, SKETCH, SKETCH_MARGIN = 256, 2048, 0.057

_MUL = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_MUL[0])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_MUL[1])
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words (A-Z in lower case)."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(width, n)
    h = np.full(n - size + 1, size if n < width else 0, np.uint64)
    for k in range(size):
        h = mixed(h + ids[k : n - size + 1 + k])
    return np.unique(h)


class Signer:
    """The two permutations, drawn from a seed, and signatures made with them."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, k = bands, rows, bands * rows
        self.sigma = rng.permutation(CIRCLE).astype(np.uint32)
        pi = rng.permutation(CIRCLE).astype(np.uint32)
        self.most = max(k, SKETCH)
        round_ = np.concatenate([pi, pi[: self.most]])
        self.short = np.lib.stride_tricks.sliding_window_view(round_, k)
        self.long = np.lib.stride_tricks.sliding_window_view(round_, self.most)

    def signature(self, shingles: np.ndarray, slices: np.ndarray | None = None) -> np.ndarray:
        """Smallest value of every coordinate; ``slices`` are the views of pi to use."""
        slices = self.short if slices is None else slices
        at = self.sigma[(shingles & np.uint64(CIRCLE - 1)).astype(np.int64)]
        out = np.full(slices.shape[1], CIRCLE, np.uint32)
        for start in range(0, len(at), 256):
            np.minimum(out, slices[at[start : start + 256]].min(axis=0), out=out)
        return out

    def sketch(self, shingles: np.ndarray) -> tuple[bytes, bytes]:
        """The lowest bit of ``SKETCH`` minima, and the band keys (of the first minima)."""
        minima = self.signature(shingles, self.long)
        bits = np.packbits((minima[:SKETCH] & 1).astype(np.uint8)).tobytes()
        return bits, self.band_keys(minima[: self.bands * self.rows]).tobytes()

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        """One 64-bit key per row and band, different for different bands."""
        cut = signatures.reshape(-1, self.bands, self.rows).astype(np.uint64)
        h = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), cut.shape[:2])
        for k in range(self.rows):
            h = mixed(h + cut[:, :, k])
        return h.view(np.int64)


@cache
def _signer(bands: int, rows: int) -> Signer:
    """Drawn once in each Python worker."""
    return Signer(bands, rows)


def _signatures(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = _signer(bands, rows)
        for b in chunks(batches, "text"):
            sets = [shingle_set(t, width) for t in utf8(b.column("text"))]
            keys = signer.band_keys(np.stack([signer.signature(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([
                b.column("id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(keys.ravel())),
            ], names=["id", "n", "set_hash", "keys"])

    return run


def _sets(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = _signer(bands, rows)
        for b in chunks(batches, "text"):
            sets = [shingle_set(t, width) for t in utf8(b.column("text"))]
            same = pa.array([xxhash.xxh3_128_digest(s.tobytes()) == h for s, h in zip(sets, b.column("set_hash").to_pylist())])
            sketches = [signer.sketch(s) for s in sets]
            yield pa.RecordBatch.from_arrays([
                b.column("id"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([x for x, _ in sketches], pa.binary()),
                pa.array([x for _, x in sketches], pa.binary())], names=["id", "set", "sketch", "bands"]).filter(same)

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of distinct candidate pairs (a, b), those whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(
        _linked(percent), pairs.select("a", "b").schema)


def _near_in_blocks(percent: int):
    """Pairs across two blocks of members whose sizes and sketches allow a link, in different components.

    A pair that shares several buckets is reported in that of its first common band.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # 1-bit minima of unlike shingles agree half of the time.
        most = int(SKETCH * (1 - percent / 100 + SKETCH_MARGIN) / 2)
        for batch in batches:
            pairs = [(np.empty(0, np.int64), np.empty(0, np.int64))]
            for row, bucket in enumerate(batch.column("bucket").to_pylist()):
                x, y = (batch.column(c)[row].values.flatten() for c in ("outside", "members"))
                (xi, xn, xc), (yi, yn, yc) = ([v[k].to_numpy(zero_copy_only=False) for k in range(3)] for v in (x, y))
                xs, ys = (np.frombuffer(b"".join(v[3].to_pylist()), np.uint64).reshape(len(v[0]), -1) for v in (x, y))
                xb, yb = (np.frombuffer(b"".join(v[4].to_pylist()), np.int64).reshape(len(v[0]), -1) for v in (x, y))
                small, large = np.minimum(xn[:, None], yn), np.maximum(xn[:, None], yn)
                at, to = np.nonzero((xc[:, None] != yc) & (100 * small >= percent * large))
                near = np.bitwise_count(xs[at] ^ ys[to]).sum(axis=1) <= most
                at, to = at[near], to[near]
                first = (xb[at] == yb[to]).argmax(axis=1)
                here = xb[at, first] == bucket
                a, b = xi[at[here]], yi[to[here]]
                pairs.append((np.minimum(a, b), np.maximum(a, b)))
            a, b = (np.concatenate(v) for v in zip(*pairs))
            kept = np.unique(np.column_stack([a, b]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 1])], names=["a", "b"])

    return run


def link_classes(buckets: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Components (id, component) of the links with hubs, and the links (a, b) found beyond them.

    Together they connect what is connected through similar classes sharing a bucket.

    ``buckets`` (bucket, rows, id, n) and ``sets`` (id, set, sketch, bands) are staged tables; ``rows`` is the bucket's size.
    """
    central = buckets.groupBy("id").agg(F.sum("rows").alias("weight"))
    known = buckets.join(central, "id")
    hubs = known.groupBy("bucket").agg(F.min(F.struct((-F.col("weight")).alias("w"), "id", "n")).alias("hub")).select(
        "bucket", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"))
    fits = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    tested = stage(buckets.join(hubs, "bucket").filter("id <> hub").filter(fits).select(
        F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), "hub-pairs")
    labels = stage(components(confirm(tested, sets, percent)), "labels")
    # What is left: members outside their bucket's largest component, against the whole bucket.
    known = stage(buckets.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "labelled")
    parts = known.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    main = parts.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("size"))
    open_ = stage(main.filter("size > top.size").select("bucket", F.col("top.component").alias("main")), "open-buckets")
    members = known.join(open_, "bucket").join(sets.select("id", "sketch", "bands"), "id")
    member = F.struct("id", "n", "component", "sketch", "bands")
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block")
    dealt = members.groupBy("bucket", "main", block).agg(F.collect_list(member).alias("members"))
    outside = dealt.select("bucket", F.expr("filter(members, x -> x.component <> main)").alias("outside")).filter("size(outside) > 0")
    pairs = outside.join(dealt.select("bucket", "members"), "bucket").mapInArrow(
        _near_in_blocks(percent), tested.schema)
    rest = stage(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "rest-pairs")
    return labels, confirm(rest, sets, percent)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
                    id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``n_shingles``, ``component_id`` and ``kept``.

    Links have 100 * intersection >= percent * union of their shingle sets of ``width`` words. A row with a null id has
    a null component and is kept.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    signed = stage(texts.mapInArrow(
        _signatures(width, bands, rows), f"id {id_type}, n long, set_hash binary, keys array<long>"), "signatures")
    usable = signed.filter("id IS NOT NULL AND n > 0")
    # Members with one set are a class under their smallest id; its keys go on alone.
    classes = stage(usable.groupBy("set_hash").agg(
        F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")), "classes")
    cut = classes.select(F.explode("keys").alias("bucket"), F.col("rep").alias("id"), "n", "set_hash")
    shared = cut.groupBy("bucket").agg(F.count("*").alias("rows")).filter("rows > 1")
    buckets = stage(cut.join(shared, "bucket"), "buckets")
    wanted = stage(buckets.select("id", "set_hash").distinct(), "wanted")
    # Texts are shuffled and streamed past the wanted ids, at every size alike.
    sets = stage(texts.join(wanted.hint("shuffle_hash"), "id").select("id", "text", "set_hash").mapInArrow(
        _sets(width, bands, rows), f"id {id_type}, set binary, sketch binary, bands binary").dropDuplicates(["id"]), "sets")
    labels, links = link_classes(buckets.select("bucket", "rows", "id", "n"), sets, percent)
    # An id that repeats with several texts joins their classes.
    again = usable.join(classes.select("set_hash", "rep"), "set_hash").filter("id <> rep").select("id", "set_hash", "rep")
    twice = again.groupBy("id").agg(F.countDistinct("set_hash").alias("sets"))
    same_id = again.join(twice.filter("sets > 1"), "id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = stage(joined(labels, links.unionByName(same_id)), "components")
    class_of = classes.select("set_hash", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select(
        "set_hash", F.coalesce("component", "rep").alias("component"))
    out = signed.select("id", "n", "set_hash").join(class_of, "set_hash", "left")
    component = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group, under the smallest id of the group; repeated ids count once."""
    found = stage(near_duplicates(docs, width, percent, id_col=id_col, text=text), "groups")
    gone = stage(found.filter("NOT kept").select(id_col).distinct(), "copies")
    left = docs.join(gone, id_col, "left_anti")
    twice = stage(found.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").select(id_col), "twice")
    if not twice.take(1):
        return left.select(docs.columns)
    once = left.join(twice, id_col).dropDuplicates([id_col])
    return left.join(twice, id_col, "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


@query("op3_circulant_minhash")
def _(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
