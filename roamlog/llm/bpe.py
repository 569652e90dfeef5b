"""Byte-level BPE by a pair occurrence index: encoding and decoding.

Texts are cut into pieces by the tokenizer's pattern, with array operations on character classes. The distinct pieces of
a chunk of a partition are laid out as one sequence of symbols, and every adjacent pair is listed with all its positions.
Active pairs are then applied in ascending order of their merge rank: all positions of a pair merge at once, and the
lists of the pairs next to them are updated. A merge can only create pairs of a later rank, so one ascending sweep
applies every merge where the tokenizer would.

Rules come from a tokenizers JSON file (byte-level BPE without normalizer); its path is a parameter, and the file is
read on the driver and broadcast (its size is checked). Added special tokens in a text become their own ids.

Null and empty texts have no tokens and decode to an empty text. Texts of any length are encoded whole; a text longer
than a chunk is a chunk of its own.
"""
from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from roamlog.llm.common import chunks, kept, query, table, utf8

#: Largest tokenizer file that is broadcast.
MAX_FILE_BYTES = 64 << 20

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table_, extra = {chr(b): b for b in shown}, 0
    for b in range(256):
        if b not in shown:
            table_[chr(256 + extra)] = b
            extra += 1
    return table_


def character_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            for c in m.group():
                out[ord(c)] = kind
    return out


class Rules:
    """Vocabulary, merges in order and special tokens of a tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letters, model = byte_letters(), spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in self.vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.first = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.first[b] = self.vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = ([self.vocab[p[k]] for p in pairs] for k in (0, 1))
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        self.merged = np.array([self.vocab[a + b] for a, b in pairs], np.int32)
        self.size = size
        keys = self.left * size + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.classes = character_classes()
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where the pair has none."""
        wanted = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], -1)


def piece_starts(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pieces of a text begin, given its code points.

    Runs of one class are pieces. A space before another class belongs to the next piece; the rest of a white-space run,
    or its last character if that is no space, is a piece of its own. An apostrophe that begins a piece takes the
    contraction after it, and what follows begins a new piece.
    """
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = classes[points]
    begins = np.ones(n, bool)
    begins[1:] = kind[1:] != kind[:-1]
    space = kind == SPACE
    last = np.zeros(n, bool)  # last of a white-space run that is followed by something
    last[:-1] = space[:-1] & ~space[1:]
    lead = last & (points == 32)
    begins |= last
    begins[1:] &= ~lead[:-1]
    quote = np.flatnonzero((points == 39) & begins)
    if len(quote):
        end = np.concatenate([points, [0, 0]])
        a, b = end[quote + 1], end[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for size, at in ((1, quote[one]), (2, quote[two])):
            begins[at + 1] = False
            after = at + size + 1
            begins[after[after < n]] = True
    return np.flatnonzero(begins)


def apply_merges(sym: np.ndarray, joined: np.ndarray, rules: Rules) -> np.ndarray:
    """Merge the symbols ``sym``; ``joined[i]`` says that i and i + 1 are in one piece. Dead positions become -1."""
    n = len(sym)
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    nxt[~joined] = n
    prv[1:][~joined[:-1]] = -1
    lists: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(at: np.ndarray) -> None:
        """List the pairs that begin at ``at`` under their ranks."""
        ranks = rules.ranks(sym[at], sym[nxt[at]])
        good = ranks >= 0
        at, ranks = at[good], ranks[good]
        if not len(at):
            return
        if len(at) > 1:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            groups = zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts))
        else:
            groups = ((int(ranks[0]), at),)
        for rank, positions in groups:
            if rank in lists:
                lists[rank].append(positions)
            else:
                lists[rank] = [positions]
                heapq.heappush(active, rank)

    add(np.flatnonzero(nxt < n))
    while active:
        rank = heapq.heappop(active)
        found = lists.pop(rank)
        at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        a, b = rules.left[rank], rules.right[rank]
        at = at[(sym[at] == a) & (nxt[at] < n)]
        at = at[sym[nxt[at]] == b]
        if a == b and len(at) > 1:  # in a run of one symbol every other pair merges, from the left
            at.sort()
            runs = np.flatnonzero(np.concatenate([[True], at[1:] != nxt[at[:-1]]]))
            nth = np.arange(len(at)) - np.repeat(runs, np.diff(np.append(runs, len(at))))
            at = at[nth % 2 == 0]
        if not len(at):
            continue
        gone = nxt[at]
        after = nxt[gone]
        sym[at] = rules.merged[rank]
        sym[gone] = -1
        nxt[at] = after
        inner = after < n
        prv[after[inner]] = at[inner]
        before = prv[at]
        changed = np.concatenate([before[before >= 0], at[inner]])
        if len(changed):
            add(np.unique(changed) if len(changed) > 1 else changed)
    return sym


def encode_pieces(pieces: list[bytes], rules: Rules) -> list[np.ndarray]:
    """Token ids of each piece."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    joined = np.ones(len(data), bool)
    joined[ends - 1] = False
    sym = apply_merges(rules.first[data], joined, rules)
    alive = sym >= 0
    return np.split(sym[alive], np.cumsum(np.add.reduceat(alive, np.concatenate([[0], ends[:-1]])))[:-1]) if len(pieces) else []


def cut_text(text: str, rules: Rules) -> list[bytes | int]:
    """Pieces of a text in order; a special token is its id."""
    out: list[bytes | int] = []
    for part in rules.split_special.split(text) if rules.split_special else [text]:
        if part in rules.special:
            out.append(rules.special[part])
        elif part:
            points = np.frombuffer(part.encode("utf-32-le"), np.uint32)
            starts = piece_starts(points, rules.classes).tolist()
            whole = part.encode()
            if len(whole) != len(part):  # byte offsets of the code points
                size = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
                at = np.cumsum(size) - size
                starts = at[starts].tolist()
            out += [whole[a:b] for a, b in zip(starts, [*starts[1:], len(whole)])]
    return out


def encode_texts(texts: list[str], rules: Rules) -> list[np.ndarray]:
    """Token ids of each text; the distinct pieces of all texts are encoded together."""
    cut = [cut_text(t, rules) for t in texts]
    index = {p: k for k, p in enumerate(dict.fromkeys(p for c in cut for p in c))}
    plain = [p for p in index if isinstance(p, bytes)]
    done = dict(zip(plain, encode_pieces(plain, rules)))
    ids = [done[p] if isinstance(p, bytes) else np.array([p], np.int32) for p in index]
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
    begin = np.cumsum(lengths) - lengths
    out = []
    for c in cut:
        k = np.fromiter(map(index.__getitem__, c), np.int64, len(c))
        size = lengths[k]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(c) else 0
        out.append(flat[np.arange(total) + np.repeat(begin[k] - (ends - size), size)])
    return out


def decode_ids(ids: np.ndarray, rules: Rules) -> str:
    return b"".join(map(rules.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def load_rules(spark: SparkSession, path: str):
    """The tokenizer file as a broadcast text, after a check of its size."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if len(text) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is too large to broadcast")
    return spark.sparkContext.broadcast(text)


def encode(docs: DataFrame, tokenizer: str, keep: list[str], text: str = "text", decode: bool = True) -> DataFrame:
    """``keep`` columns, ``ids`` and, if ``decode``, ``decoded``: the text read back from the ids."""
    rules_text = load_rules(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = kept(rules_text, Rules)
        for b in chunks(batches, text):
            ids = encode_texts([t.decode() for t in utf8(b.column(text))], rules)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            columns = [*[b.column(c) for c in keep], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))]
            if decode:
                columns.append(pa.array([decode_ids(x, rules) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "ids", *["decoded"] * decode])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, f"{fields}, ids array<int>" + ", decoded string" * decode)


def encode_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens``, and digests of the ids in decimal, joined by commas, and of the decoded text."""
    rules_text = load_rules(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = kept(rules_text, Rules)
        decimal = [str(i) for i in range(rules.size)]
        for b in chunks(batches, text):
            ids = encode_texts([t.decode() for t in utf8(b.column(text))], rules)
            joined = (",".join(map(decimal.__getitem__, x.tolist())).encode() for x in ids)
            yield pa.RecordBatch.from_arrays([
                b.column(id_col), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(j).hexdigest() for j in joined]),
                pa.array([hashlib.sha256(decode_ids(x, rules).encode()).hexdigest() for x in ids]),
            ], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text).mapInArrow(
        run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op10_pair_index_bpe")
def _(spark, sf_dir):
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
