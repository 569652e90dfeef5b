"""Mining saved pages for tip ids."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from roamlog.session import keep_staged, stage_apart

# Script that holds a page's data, and the shape of an id.
SCRIPT_ID = "__NEXT_DATA__"
ID_PATTERN = "[0-9a-f]{24}"
ID_LENGTH = 24
REACH = 300

#: Levels of a document that are opened one by one, and how many of the deeper ones at once.
SHALLOW, LEVELS = 12, 8


def embedded_json(html: Column, script_id: str = SCRIPT_ID) -> Column:
    """Body of the data script, NULL when absent or not valid JSON."""
    body = F.regexp_extract(html, rf'(?s)<script[^>]+id="{script_id}"[^>]*>(.*?)</script>', 1)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def ids_near(pages: DataFrame, anchor: str, id_pattern: str = ID_PATTERN, id_length: int = ID_LENGTH,
             reach: int = REACH) -> DataFrame:
    """Distinct ids that lie wholly within ``reach`` characters before an anchor match."""
    gap = reach - id_length
    pattern = rf"({id_pattern})(?=[\s\S]{{0,{gap}}}?{anchor})"
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(pattern), 1)).alias("id")).distinct()


def _is_set(node: Column, path: str) -> Column:
    """Whether a field holds something: text that is not empty, a number but 0, true, or a list or object with content."""
    value = F.try_variant_get(node, path, "variant")
    kind, text = F.schema_of_variant(value), F.try_variant_get(node, path, "string")
    empty = (text == "") | text.isin("{}", "[]") | ((kind == "BOOLEAN") & (text == "false")) | (
        (kind != "STRING") & (F.try_variant_get(node, path, "double") == 0))
    return value.isNotNull() & (kind != "VOID") & ~F.coalesce(empty, F.lit(False))


def objects_where(docs: DataFrame, owner: str, col: str = "doc") -> DataFrame:
    """Distinct ids of objects with id, text, time and ``user.id = owner`` at any depth.

    ``docs(page_id, <col>)`` holds JSON text. Documents are opened level by level, each level one
    step of plain expressions over the objects and lists of the level before, so a document's size
    is spread over tasks and its depth costs only rounds: one per level, and from ``SHALLOW`` on
    one per ``LEVELS``. A document that is no JSON, names a field twice or is deeper than the JSON
    parser goes (1,000 levels) has no objects.
    """
    spark, node = docs.sparkSession, F.col("node")
    kind = F.schema_of_variant("node")

    def opened(level: DataFrame) -> DataFrame:
        inner = level.lateralJoin(spark.tvf.variant_explode(node.outer())).select("page_id", F.col("value").alias("node"))
        return containers(inner)

    def containers(nodes: DataFrame) -> DataFrame:
        return nodes.filter(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY")))

    def hits(level: DataFrame) -> DataFrame:
        wanted = (F.try_variant_get(node, "$.user.id", "string") == owner) & _is_set(node, "$.id") & _is_set(
            node, "$.text") & _is_set(node, "$.createdAt")
        found = level.filter(F.startswith(kind, F.lit("OBJECT"))).filter(wanted)
        return found.select("page_id", F.try_variant_get(node, "$.id", "string").alias("id"), F.parse_json(F.lit(None)).alias("node"))

    # Parsed once: a filter on the parsed value would otherwise parse the text again for each of its parts.
    parsed = docs.select("page_id", F.try_parse_json(F.col(col)).alias("node"))
    parsed_path, parsed = stage_apart(parsed, "documents")
    level, paths, depth = containers(parsed.filter(F.col("node").isNotNull())), [], 0
    while True:
        levels = [level]
        while len(levels) < (LEVELS if depth >= SHALLOW else 1):
            levels.append(opened(levels[-1]))
        last = levels[-1].select("page_id", F.lit(None).cast("string").alias("id"), "node")
        path, seen = stage_apart(reduce(DataFrame.unionByName, [*map(hits, levels), last]), "nodes")
        paths.append(path)
        level, depth = opened(seen.filter("node IS NOT NULL").select("page_id", "node")), depth + len(levels)
        if seen.filter("node IS NOT NULL").isEmpty():
            break
    keep_staged([parsed_path, *paths])
    return spark.read.schema(seen.schema).parquet(*paths).filter("id IS NOT NULL").select("page_id", "id").distinct()


def discover_ids(pages: DataFrame, owner: str, anchor: str, known: DataFrame) -> DataFrame:
    """Ids found on pages either way that are not known yet."""
    docs = pages.select("page_id", embedded_json(F.col("html")).alias("doc"))
    found = ids_near(pages, anchor).unionByName(objects_where(docs, owner)).select("id").distinct()
    return found.join(known.select("id").distinct(), "id", "left_anti")
