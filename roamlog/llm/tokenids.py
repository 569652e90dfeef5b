"""Token-id output: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

Ids are replaced by their rank in the corpus, so the frequent ones take one byte. A rank takes one to four bytes; two
bits for each, four to a control byte, say how many. Control and data bytes are separate columns of the files, and the
reader turns control bytes into lengths and offsets with two tables of 256 rows.

Files: ``<path>/docs`` holds a row per document in ascending id order (part, start in the part, id, n_tokens, control,
data), ``<path>/ranks`` the id of each rank. Both are Parquet, so any file system Spark writes to will do, and a lost
executor's part is written again by the commit protocol. Part k of the files precedes part k + 1 in id order.

The tokenizer must drop white space and mark the ends of its pieces (any other raises an error).

Null and empty texts have the end id alone. Null ids come first. Rows that repeat an id are ordered by their tokens.
"""
from __future__ import annotations

import itertools
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from roamlog.llm.bpe import byte_letters, load_rules
from roamlog.llm.common import chunks, kept, query, table, utf8
from roamlog.session import drop_staged, stage, stage_root, staged_count

END_ID = 1
#: Pieces whose ids a task remembers; the memory starts anew beyond that.
CACHE_PIECES = 250_000
#: Pieces handed to the tokenizer at once; its results are bulky until their ids are taken.
SLICE_PIECES = 5_000
#: Bytes of ids a part of the files should hold.
PART_BYTES = 32 << 20

_CODES = np.array(list(itertools.product(range(4), repeat=4)), np.int64)[:, ::-1]  # row = control byte
LENGTHS = _CODES + 1
OFFSETS = np.cumsum(LENGTHS, axis=1) - LENGTHS
TOTALS = LENGTHS.sum(axis=1)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of a sequence of ranks below 2**32."""
    r = ranks.astype(np.uint32)
    code = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    padded = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    padded[: len(r)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    size = code + np.int64(1)
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    data[at] = r & 0xFF
    for k in range(1, 4):
        more = code >= k
        if not more.any():
            break
        data[at[more] + k] = r[more] >> np.uint32(8 * k) & 0xFF
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks behind control and data bytes."""
    c = np.frombuffer(control, np.uint8)
    d = np.frombuffer(data, np.uint8)
    total = TOTALS[c]
    at = ((np.cumsum(total) - total)[:, None] + OFFSETS[c]).ravel()[:n]
    size = LENGTHS[c].ravel()[:n]
    out = d[at].astype(np.uint32)
    for k in range(1, 4):
        more = size > k
        if not more.any():
            break
        out[more] |= d[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


#: Bytes of Latin-1 that are neither ASCII nor plain letters; texts with them, or beyond Latin-1, are cut into words only.
_ODD = bytes([*range(0x80, 0xC0), 0xD7, 0xF7])
_LOWER = bytes(c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
#: The tokenizer's own split, for lower-case Latin-1.
_PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\x09-\x0d\x20a-z0-9\xdf-\xf6\xf8-\xff]+")


class _Numbers(dict):
    """Numbers keys as they are first asked for; ``fresh`` lists the new ones."""

    def __init__(self) -> None:
        self.fresh: list = []

    def __missing__(self, key: bytes | str) -> int:
        self.fresh.append(key)
        self[key] = n = len(self)
        return n


class WordCoder:
    """Ids of texts from the word tokenizer of the library: lower case, white space dropped, pieces with an end mark.

    White space ends every piece, so texts can be encoded piece by piece, each distinct piece once. Plain texts (ASCII
    and Latin-1 letters) are put in lower case and split here, and the library's model gets the pieces in bulk; words
    with other characters go through the library's whole chain.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.spec, self.whole = spec, None
        self.model = Tokenizer.from_str(spec)
        self.model.no_truncation()
        self.model.no_padding()
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        letters = {b: c for c, b in byte_letters().items()}
        self.shown = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        self.special = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.index = _Numbers()
        self.flat = np.empty(0, np.uint32)
        self.begin = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)

    def _learn(self, pieces: list) -> None:
        """Ids of the pieces that were numbered last."""
        plain = [k for k, p in enumerate(pieces) if isinstance(p, bytes)]
        odd = [k for k, p in enumerate(pieces) if isinstance(p, str)]
        sizes, flats = [np.empty(0, np.int64)], [self.flat]
        for k in range(0, len(plain), SLICE_PIECES):
            shown = [pieces[j].decode("latin-1").translate(self.shown) for j in plain[k : k + SLICE_PIECES]]
            lines = [" ".join(shown[j : j + 50]) for j in range(0, len(shown), 50)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(lines, add_special_tokens=False)])
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(shown):
                raise ValueError("the tokenizer's pieces have no end mark")
            sizes.append(np.diff(np.concatenate([[-1], last])))
            flats.append(ids)
        if odd and self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_str(self.spec)
            self.whole.no_truncation()
            self.whole.no_padding()
        for k in range(0, len(odd), SLICE_PIECES):
            for e in self.whole.encode_batch_fast([pieces[j] for j in odd[k : k + SLICE_PIECES]], add_special_tokens=False):
                sizes.append(np.array([len(e.ids)]))
                flats.append(np.array(e.ids, np.uint32))
        size = np.concatenate(sizes)
        begin = len(self.flat) + np.cumsum(size) - size
        order = np.argsort(np.array(plain + odd), kind="stable")
        self.begin, self.size = np.concatenate([self.begin, begin[order]]), np.concatenate([self.size, size[order]])
        self.flat = np.concatenate(flats)

    def _cut(self, text: bytes) -> list[bytes | str]:
        if any(x in text for x in self.special):
            return [w.decode() for w in text.split()]
        try:
            latin = text if text.isascii() else text.decode().encode("latin-1")
        except UnicodeEncodeError:
            latin = None
        if latin is not None and len(latin.translate(None, _ODD)) == len(latin):
            return _PIECE.findall(latin.translate(_LOWER))
        out: list[bytes | str] = []
        for w in text.split():
            if w.isascii():
                out += _PIECE.findall(w.lower())
            else:
                out.append(w.decode())
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text with the end id after them."""
        if len(self.index) > CACHE_PIECES:
            self.clear()
        numbers = []
        for t in texts:
            pieces = self._cut(t)
            numbers.append(np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces)))
        if self.index.fresh:
            self._learn(self.index.fresh)
            self.index.fresh = []
        out = []
        for k in numbers:
            size = self.size[k]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(k) else 0
            ids = np.empty(total + 1, np.uint32)
            if total:
                ids[:total] = self.flat[np.arange(total) + np.repeat(self.begin[k] - (ends - size), size)]
            ids[total] = END_ID
            out.append(ids)
        return out


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids): ids as little-endian 16-bit (or, for a larger vocabulary, 32-bit) integers."""
    spec = load_rules(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept(spec, WordCoder)
        kind = id_type(coder.model.get_vocab_size())
        for b in chunks(batches, "text", 4 << 20):
            ids = coder.encode(utf8(b.column("text")))
            yield pa.RecordBatch.from_arrays([
                b.column("id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())],
                names=["id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids binary")


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def ranking(coded: DataFrame, vocabulary: int) -> np.ndarray:
    """Ids by falling frequency over the whole corpus; the result is as long as the vocabulary."""
    kind = id_type(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for x in b.column("ids").to_pylist():
                total += np.bincount(np.frombuffer(x, kind), minlength=vocabulary) if len(x) > 1000 else 0
                if len(x) <= 1000:
                    np.add.at(total, np.frombuffer(x, kind), 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["token", "n"])

    found = coded.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(vocabulary, np.int64)
    for r in found:
        n[r.token] = r.n
    return np.argsort(-n, kind="stable")


def write(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text: str = "text") -> None:
    """Encode ``docs`` and write the files under ``path``."""
    spark, before = docs.sparkSession, staged_count()
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_str(load_rules(spark, tokenizer).value).get_vocab_size()
    kind = id_type(vocabulary)
    coded = stage(encoded(docs, tokenizer, id_col, text), "coded")
    by_rank = ranking(coded, vocabulary)
    rank_of = np.empty(vocabulary, np.uint32)
    rank_of[by_rank] = np.arange(vocabulary, dtype=np.uint32)
    total = coded.agg(F.sum("n_tokens")).head()[0] or 0
    parts = max(1, -(-int(total) * int(kind[-1]) // PART_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column("n_tokens").to_pylist()
            codes = [pack(rank_of[np.frombuffer(x, kind)]) for x in b.column("ids").to_pylist()]
            starts = start + np.cumsum([0, *n[:-1]])
            start += sum(n)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(n), part, np.int32)), pa.array(starts.astype(np.int64)), b.column("id"), b.column("n_tokens"),
                pa.array([c for c, _ in codes], pa.binary()), pa.array([d for _, d in codes], pa.binary())],
                names=["part", "start", "id", "n_tokens", "control", "data"])

    order = [F.col("id"), F.xxhash64("ids"), F.col("n_tokens")]
    shape = f"part int, start long, id {coded.schema['id'].dataType.simpleString()}, n_tokens long, control binary, data binary"
    coded.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(packed, shape).write.parquet(f"{path}/docs")
    spark.createDataFrame([(k, int(i)) for k, i in enumerate(by_rank)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    drop_staged(spark, before)


def read(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Per document in the files: id, ``start``, ``n_tokens``, ``ids_crc32`` and, if ``with_ids``, ``ids`` as an array.

    Where a part begins is the sum of the parts before it: one number per part.
    """
    ids = np.zeros(spark.read.parquet(f"{path}/ranks").count(), np.uint32)
    for r in spark.read.parquet(f"{path}/ranks").collect():
        ids[r["rank"]] = r["id"]
    files = spark.read.parquet(f"{path}/docs")
    sums = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    begin, so_far = {}, 0
    for part in sorted(sums):
        begin[part] = so_far
        so_far += sums[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("n_tokens").to_pylist()
            rows = [ids[unpack(c, d, k)] for c, d, k in zip(b.column("control").to_pylist(), b.column("data").to_pylist(), n)]
            starts = [begin[p] + s for p, s in zip(b.column("part").to_pylist(), b.column("start").to_pylist())]
            columns = [b.column("id"), pa.array(starts, pa.int64()), b.column("n_tokens"),
                       pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in rows], pa.int64())]
            if with_ids:
                columns.append(pa.array([x.astype(np.int64) for x in rows], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    kind = files.schema["id"].dataType.simpleString()
    return files.mapInArrow(run, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


@query("op5_control_byte_ids")
def _(spark, sf_dir):
    import public_tokenizers

    path = f"{stage_root(spark)}/token-ids-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read(spark, path, with_ids=False)
