"""Connected components of a link table, as a few joins and aggregates per round."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roamlog.session import stage


def _to_minimum(pairs: DataFrame) -> DataFrame:
    """Per ``u`` of (u, v): every v, and u itself, beside the smallest id among them. A hub is one aggregated row."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return pairs.join(low, "u")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): component is the smallest id reachable.

    Alternates two steps on the links, both of which keep components: each node sends its larger neighbours to its
    smallest one, then its smaller neighbours and itself. Links turn into stars around the smallest id in a number of
    rounds that grows with the logarithm of a component's diameter. Links are written to the shared folder each round.
    Empty links give an empty table; repeated links and self-links do no harm.
    """
    now = stage(edges.filter("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "links")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _to_minimum(large)
        now = stage(small.select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "links")
    roots = now.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _stars(links: DataFrame) -> bool:
    """Whether every u of distinct links (u, v), v < u, has one v, which is no u itself."""
    ends = links.select(F.col("u").alias("id"), F.lit(1).alias("low"), F.lit(False).alias("high")).unionByName(
        links.select(F.col("v").alias("id"), F.lit(0).alias("low"), F.lit(True).alias("high")))
    met = ends.groupBy("id").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
    return not met.agg(F.bool_or((F.col("low") > 1) | ((F.col("low") > 0) & F.col("high")))).head()[0]


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) after more ``edges`` (a, b) join components ``labels`` (id, component), staged, of :func:`components`.

    Only the edges between different components are solved, on the smallest ids that stand for these.
    """
    def root(edges: DataFrame, end: str) -> DataFrame:
        known = labels.select(F.col("id").alias(end), F.col("component").alias("_root"))
        return edges.join(known, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")

    over = stage(components(root(root(edges.select("a", "b"), "a"), "b")), "joined")
    moved = over.select(F.col("id").alias("component"), F.col("component").alias("_to"))
    kept = labels.join(moved, "component", "left").select("id", F.coalesce("_to", "component").alias("component"))
    return kept.unionByName(over.join(labels, "id", "left_anti").select("id", "component"))
