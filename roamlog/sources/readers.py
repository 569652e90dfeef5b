"""Scans of check-in, tip, lookup, review and world-city files."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from roamlog.functions import scalars as S
from roamlog.schema import CHECKIN_FIELDS, CHECKIN_SCHEMA, REVIEW_FIELDS, TIP_SCHEMA, WORLD_SCHEMA


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def read_csv(spark: SparkSession, path: str, fields: list[str], extra: list[str] | None = None) -> DataFrame:
    """Header CSV by column name; absent columns are blank, quoted line breaks are kept.

    ``multiLine`` reads one file per task, so a large table should be many files (or Parquet).
    """
    wanted = [*fields, *(extra or [])]
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in wanted]))
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    return raw.select(*[
        F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in wanted
    ])


def read_checkins(spark: SparkSession, path: str, extra: list[str] | None = None) -> DataFrame:
    """Raw check-in rows, all text, blank for missing. ``extra`` names key columns such as a user."""
    return read_csv(spark, path, CHECKIN_FIELDS, extra)


def read_checkins_parquet(spark: SparkSession, path: str, extra: list[str] | None = None) -> DataFrame:
    """The same from Parquet, where column pruning and filters reach the scan."""
    raw = spark.read.parquet(path)
    wanted = [*CHECKIN_FIELDS, *(extra or [])]
    return raw.select(*[
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c)
        for c in wanted
    ])


def empty_checkins(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CHECKIN_SCHEMA)


def read_tips(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Tips from a JSON array (or one object per line); a missing or broken file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], TIP_SCHEMA)
    schema = T.StructType([*TIP_SCHEMA.fields, T.StructField("_bad", T.StringType())])
    raw = spark.read.json(path, schema=schema, multiLine=multiline, mode="PERMISSIVE",
                          columnNameOfCorruptRecord="_bad", encoding="UTF-8")
    return raw.filter("_bad IS NULL").drop("_bad")


def broken_tips(spark: SparkSession, path: str) -> DataFrame:
    """Lines that :func:`read_tips`, reading one object per line, sets aside: ``line``, as they are."""
    schema = T.StructType([*TIP_SCHEMA.fields, T.StructField("_bad", T.StringType())])
    if not exists(spark, path):
        return spark.createDataFrame([], "line string")
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.withColumn("_p", parsed).filter("_p._bad IS NOT NULL").select(F.col("value").alias("line"))


def _load(spark: SparkSession, path: str) -> object:
    """A small JSON or YAML file from any file system Spark reads; None only if it is absent."""
    if not exists(spark, path):
        return None
    text = spark.read.text(path, wholetext=True).head()
    body = text[0].removeprefix("\ufeff") if text else ""
    if not path.endswith((".yaml", ".yml")):
        return json.loads(body)
    try:
        import yaml
    except ImportError as exc:
        raise ImportError("YAML lookups need PyYAML; JSON lookups do not") from exc
    return yaml.safe_load(body)


_KINDS = {
    "map": "key string, value string",
    "list": "value string, ord int",
    "groups": "group string, group_ord int, category string, cat_ord int",
    "tags": "start_ts bigint, tags array<string>",
}


def read_lookup(spark: SparkSession, path: str, kind: str = "map", section: str | None = None) -> DataFrame:
    """Small configuration file -> table. Kinds: ``map``, ``list``, ``groups``, ``tags``.

    The parsed rows are a local relation whose exact size Spark knows, so joins broadcast it
    only while it is below ``spark.sql.autoBroadcastJoinThreshold``. Repeated keys: last wins.
    """
    data = _load(spark, path) or {}
    if section is not None:
        data = data.get(section, {})
    if kind == "map":
        rows = [(str(k), str(v)) for k, v in data.items()]
    elif kind == "list":
        rows = [(str(v), i) for i, v in enumerate(data)]
    elif kind == "tags":
        rows = [(int(k), [str(x) for x in v]) for k, v in data.items()]
    elif kind == "groups":
        rows = [(g, gi, c, ci) for gi, (g, cs) in enumerate(data.items()) for ci, c in enumerate(cs)]
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return spark.createDataFrame(rows, _KINDS[kind])


def read_groups(spark: SparkSession, path: str, section: str) -> dict[str, list[str]]:
    """Group -> categories of a configuration section, in file order."""
    data = _load(spark, path) or {}
    return {g: [str(c) for c in cs] for g, cs in data.get(section, {}).items()}


def read_settings(spark: SparkSession, path: str) -> dict[str, object]:
    """Home city and minimum trip length."""
    data = _load(spark, path) or {}
    found = data.get("trip_detection", data)
    return {"home_city": found.get("home_city", ""), "min_checkins": int(found.get("min_checkins", 5))}


def review_tables(review: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blank-city tables from the review rows: exact times ``(key, value)`` and centroids."""
    inferred = review.withColumn("_seq", F.monotonically_increasing_id()) if "seq" not in review.columns \
        else review.withColumnRenamed("seq", "_seq")
    inferred = inferred.filter(
        (F.col("decision_source") == "BLANK_CITY_INFERRED") & (S.text(F.col("resolved_city")) != "")
        & ~F.col("resolved_city").startswith("(BLANK")
    )
    items = inferred.select(
        "_seq", "resolved_city",
        F.posexplode(F.split(F.coalesce("low_volume_checkins_detail", F.lit("")), r" \|\| ")).alias("_p", "_item"),
    ).filter(F.col("_item").contains("::"))
    at = F.try_to_timestamp(S.py_strip(F.split("_item", "::", 2)[0]), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    times = (
        items.withColumn("key", F.unix_timestamp(at).cast("string")).filter("key IS NOT NULL")
        .groupBy("key").agg(F.max_by("resolved_city", F.struct("_seq", "_p")).alias("value"))
    )
    centroids = inferred.select(
        "country", S.to_coord(F.col("lat")).alias("lat"), S.to_coord(F.col("lng")).alias("lng"),
        F.col("resolved_city").alias("city"), F.col("_seq").alias("seq"),
    ).filter("lat IS NOT NULL AND lng IS NOT NULL")
    return times, centroids


def read_blank_city_review(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return review_tables(read_csv(spark, path, REVIEW_FIELDS))


def read_world_cities(spark: SparkSession, path: str, variable: str | None = None) -> DataFrame:
    """World cities from a file with an array of ``[name, lat, lng, pop_m, continent]``.

    The file is the bare JSON array, or text that assigns it to ``variable``.
    """
    lead = rf"const {variable}\s*=\s*" if variable else r"^\s*"
    body = F.regexp_extract("value", rf"(?s){lead}(\[.*?\]\s*\])", 1)
    rows = spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json(body, "array<array<string>>")).alias("r"))
    names = [f.name for f in T._parse_datatype_string(WORLD_SCHEMA).fields]
    types = [f.dataType for f in T._parse_datatype_string(WORLD_SCHEMA).fields]
    return rows.select(*[F.col("r")[i].try_cast(t).alias(n) for i, (n, t) in enumerate(zip(names, types, strict=True))])
