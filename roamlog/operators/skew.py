"""Left joins on keys that a few values may crowd.

A sketch of bounded counters (one per task, merged) finds keys that would fill a task. Rows of such a key are dealt to
several parts, to each of which the key's rows of the right side are copied. Rows whose key has a NULL match nothing, but
crowd in the same way and are dealt in the same way.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Keys the sketch may name, and counters it holds: a key with more than a 7500th of all rows is always named.
HOT_KEYS, COUNTERS = 1000, 10_000
#: Parts of an even task's load that one piece of a hot key may hold.
PIECE = 16


def hot_keys(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """(_key, _salts): hashes of keys with more rows than a piece of a task of ``parts``, at most ``HOT_KEYS`` of them."""
    sketch = F.expr(f"approx_top_k(_key, {HOT_KEYS}, {COUNTERS})")
    found = df.select(F.xxhash64(*keys).alias("_key")).agg(sketch.alias("top"), F.count("*").alias("rows"))
    piece = F.greatest(F.floor(F.col("rows") / (parts * PIECE)), F.lit(1))
    return found.select("rows", piece.alias("piece"), F.inline("top")).filter(F.col("count") > F.col("piece")).select(
        F.col("item").alias("_key"), F.ceil(F.col("count") / F.col("piece")).cast("int").alias("_salts"))


def left_join_skewed(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, every row of ``left`` kept.

    ``spread`` are columns of ``left`` whose hash deals the rows of one hot key to its parts.
    """
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A thousand pairs of numbers at most.
    hot = spark.createDataFrame(hot_keys(left, keys, parts).collect(), "_key long, _salts int")
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    dealt = left.withColumn("_key", F.xxhash64(*keys)).join(F.broadcast(hot), "_key", "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("_key", "_salts")
    copies = right.withColumn("_key", F.xxhash64(*keys)).join(F.broadcast(hot), "_key", "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_key", "_salts")
    return dealt.join(copies, [*keys, "_salt"], "left").drop("_salt")
