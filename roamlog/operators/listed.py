"""Lists in a checked order: ranks and pages of any table by any sort expressions.

Rows are dealt to ranges by splitters that Spark samples from the sort keys, text included, and sorted inside their range;
a rank is the number of rows in earlier ranges and the place inside its own. No task sorts a whole list, and a key that
many rows share is split by the tie-breakers behind it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from roamlog.operators.ordered import _BEFORE, _by, _swept
from roamlog.session import stage

#: Rows that one task sorts.
RANGE_ROWS = 1_000_000


def ranked(df: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "rank", range_rows: int | None = None) -> DataFrame:
    """Adds the 1-based position of each row of its list, in ``order``, which should end in a key.

    Ranges of ``range_rows`` spread a short list. There are no more of them than shuffle partitions, unless these would
    hold over ``RANGE_ROWS`` rows each: a task and a file for every few rows would cost more than the rows themselves.
    """
    by = by or []
    table = stage(df, "list")
    n = table.count()
    most = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    parts = min(-(-n // (range_rows or RANGE_ROWS)), most) or 1
    ranged = stage(table.repartitionByRange(parts, *by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    offsets = _swept(counts, by, [("_range", False)], {"_off": ("sum", "_n", _BEFORE)}, many=True)
    place = F.row_number().over(Window.partitionBy(*_by([*by, "_range"])).orderBy(*order))
    return ranged.withColumn("_place", place).join(
        offsets.select(*by, "_range", F.coalesce("_off", F.lit(0)).alias("_off")), [*by, "_range"]
    ).select(*df.columns, (F.col("_off") + F.col("_place")).alias(name))


def paged(ranked_: DataFrame, size: int, name: str = "rank") -> DataFrame:
    """Adds ``page`` (from 1): ``size`` rows each, the last one fewer."""
    return ranked_.withColumn("page", F.floor((F.col(name) - 1) / size) + 1)


def page_index(paged_: DataFrame, keys: list[str], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Per page the number of its rows and the ``keys`` of its first one, to find the page of a key by."""
    first = F.min_by(F.struct(*keys), F.col(name))
    return paged_.groupBy(*(by or []), "page").agg(F.count("*").alias("n"), first.alias("_f")).select(
        *(by or []), "page", "n", *[F.col(f"_f.{k}").alias(f"first_{k}") for k in keys])


def page_payloads(paged_: DataFrame, columns: list[str], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """One JSON array per page, its rows in order. A page holds as many rows as :func:`paged` gave it."""
    row = F.struct(F.col(name).alias("o"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("j"))
    lines = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["j"])
    return paged_.groupBy(*(by or []), "page").agg(F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]")).alias("payload"))
