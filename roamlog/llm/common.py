"""Reading, registration and small array helpers shared by the operators of this package."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Characters that separate words in the word-based operators.
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of text that a task turns into arrays at once.
CHUNK_BYTES = 8 << 20


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a named query of this package, with its DuckDB text where SQL can say it."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, every other character unchanged (``lower`` alone would also fold É)."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, lower))


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``text`` (one longer text stays whole)."""
    for batch in batches:
        start = size = 0
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0))
        for row, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += int(n)
        if batch.num_rows > start:
            yield batch.slice(start)


def bounded_sample(df: DataFrame, rows: int, *columns: str, total: int | None = None) -> DataFrame:
    """At most ``rows`` rows of ``df``, chosen and ordered by a hash of ``columns``, the same on every run.

    Rows with equal ``columns`` are chosen together, so the columns must tell the rows apart. A share is kept by the hash
    first, so that the ordered pick sees little more than it returns. ``total`` is the number of rows, if it is known.
    """
    total, steps = df.count() if total is None else total, 1 << 20
    h = F.xxhash64(*columns)
    if total > rows:
        share = max(1.05 * rows, rows + 7 * rows**0.5) / total
        df = df.filter(F.pmod(h, F.lit(steps)) < max(1, int(share * steps)))
    return df.orderBy(h, *columns).limit(rows)


def kept(sent: Broadcast, make: Callable):
    """``make(sent.value)``, made once in each Python worker and kept with the broadcast for its later tasks."""
    if not hasattr(sent, "made"):
        sent.made = make(sent.value)
    return sent.made


def with_row_key(df: DataFrame, *columns: str) -> DataFrame:
    """``_key``: one value per distinct (doc_id, text), so that a repeated id with another text stays apart."""
    return df.withColumn("_key", F.xxhash64(*columns))
