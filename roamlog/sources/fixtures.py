"""Check-in, tip and world-city views over the driver's generic tables."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from roamlog.session import stage_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Categories the event rows are spread over.
CATEGORIES = [
    "Airport", "Rail Station", "Bus Station", "Home (private)", "Neighborhood", "Fuel Station",
    "Bus Line", "Park", "Road", "Pub", "Coffee Shop", "Museum",
]


_STAGED: dict[tuple[str, str, int], tuple[str, object]] = {}


def checkins(spark: SparkSession, sf_dir: str, years: int = 1) -> DataFrame:
    """The check-in view of the ``events`` table, written once per application and read back.

    A stored log is what the operators are for: many files, plain columns. The rows are spread
    over files by user and time, since ``events`` may be a single file.
    """
    from roamlog.sources.readers import exists

    key = (spark.sparkContext.applicationId, sf_dir, years)
    path, schema = _STAGED.get(key, ("", None))
    if not path or not exists(spark, path):
        view = checkins_view(spark, sf_dir, years)
        path, schema = f"{stage_root(spark)}/log-{uuid.uuid4().hex}", view.schema
        view.repartition(spark.sparkContext.defaultParallelism, "user_id", "ts").write.parquet(path)
        _STAGED[key] = (path, schema)
    return spark.read.schema(schema).parquet(path)


def checkins_view(spark: SparkSession, sf_dir: str, years: int = 1) -> DataFrame:
    """The ``events`` table read as a clean check-in log.

    ``years`` > 1 moves a row back by ``event_id % years`` years of 365 days, so that
    results keyed by calendar year have something to group.
    """
    e = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.unix_timestamp("ts").alias("ts"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    if years > 1:
        e = e.withColumn("ts", F.col("ts") - (F.col("event_id") % years) * 31_536_000)
    k, eid, uid = F.col("k"), F.col("event_id"), F.col("user_id")
    kk = k.cast("string")
    category = F.element_at(
        F.array(*[F.lit(c) for c in CATEGORIES]), ((eid * 7 + k) % 12 + 1).cast("int")
    )
    return e.select(
        "user_id",
        eid.cast("string").alias("checkin_id"),
        "ts",
        F.col("ts").cast("string").alias("date"),
        F.when(k % 17 == 0, "").otherwise(F.concat(F.lit("v"), kk)).alias("venue_id"),
        F.concat(F.lit("Venue "), kk).alias("venue"),
        F.when(k % 13 == 0, "").when(k % 4 == 0, "HOME")
        .otherwise(F.concat(F.lit("City "), (k % 20).cast("string"))).alias("city"),
        F.concat(F.lit("NATION_"), (k % 25).cast("string")).alias("country"),
        (((k * 37) % 140 - 70).cast("double") + k / F.lit(8.0)).alias("lat"),
        (((k * 91) % 340 - 170).cast("double") + k / F.lit(16.0)).alias("lng"),
        category.alias("category"),
        F.when(uid % 3 == 0, "Ann A, Bob B").when(uid % 3 == 1, "Bob B").otherwise("").alias("with_name"),
        F.when(uid % 3 == 0, "a1, b2").when(uid % 3 == 1, "b2").otherwise("").alias("with_id"),
        F.when(eid % 11 == 0, "Dee D").otherwise("").alias("created_by_name"),
        F.when(eid % 11 == 0, "d4").otherwise("").alias("created_by_id"),
        F.when(k % 10 == 0, "-").when(k % 7 == 0, "Ann A, Cy C").otherwise("").alias("overlaps_name"),
        F.when(k % 10 == 0, "-").when(k % 7 == 0, "a1, c3").otherwise("").alias("overlaps_id"),
    )


CHECKINS_SQL = """
ck AS (
  SELECT user_id, CAST(event_id AS VARCHAR) AS checkin_id, ts, CAST(ts AS VARCHAR) AS date,
    CASE WHEN k%17=0 THEN '' ELSE 'v' || CAST(k AS VARCHAR) END AS venue_id,
    'Venue ' || CAST(k AS VARCHAR) AS venue,
    CASE WHEN k%13=0 THEN '' WHEN k%4=0 THEN 'HOME' ELSE 'City ' || CAST(k%20 AS VARCHAR) END AS city,
    'NATION_' || CAST(k%25 AS VARCHAR) AS country,
    CAST((k*37)%140-70 AS DOUBLE) + k/8.0e0 AS lat, CAST((k*91)%340-170 AS DOUBLE) + k/16.0e0 AS lng,
    CASE (event_id*7+k)%12 WHEN 0 THEN 'Airport' WHEN 1 THEN 'Rail Station' WHEN 2 THEN 'Bus Station'
      WHEN 3 THEN 'Home (private)' WHEN 4 THEN 'Neighborhood' WHEN 5 THEN 'Fuel Station' WHEN 6 THEN 'Bus Line'
      WHEN 7 THEN 'Park' WHEN 8 THEN 'Road' WHEN 9 THEN 'Pub' WHEN 10 THEN 'Coffee Shop' ELSE 'Museum' END AS category,
    CASE user_id%3 WHEN 0 THEN 'Ann A, Bob B' WHEN 1 THEN 'Bob B' ELSE '' END AS with_name,
    CASE user_id%3 WHEN 0 THEN 'a1, b2' WHEN 1 THEN 'b2' ELSE '' END AS with_id,
    CASE WHEN event_id%11=0 THEN 'Dee D' ELSE '' END AS created_by_name,
    CASE WHEN event_id%11=0 THEN 'd4' ELSE '' END AS created_by_id,
    CASE WHEN k%10=0 THEN '-' WHEN k%7=0 THEN 'Ann A, Cy C' ELSE '' END AS overlaps_name,
    CASE WHEN k%10=0 THEN '-' WHEN k%7=0 THEN 'a1, c3' ELSE '' END AS overlaps_id
  FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) - (event_id % {years}) * 31536000 AS ts,
               CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events)
)"""


def checkins_sql(years: int = 1) -> str:
    """The same view as a DuckDB common table expression named ``ck``."""
    return CHECKINS_SQL.format(years=years)


def tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table read as tips (venue, place and votes derived from the id)."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    country = F.element_at(
        F.array(*[F.lit(c) for c in ("Italia", "Polska", "Germany", "España", "Беларусь")]),
        (i % 5 + 1).cast("int"),
    )
    return d.select(
        i.cast("string").alias("id"),
        (F.lit(1_600_000_000) + i * 7919).alias("ts"),
        "text",
        F.col("source").alias("venue"),
        F.concat(F.lit("v"), (i % 97).cast("string")).alias("venue_id"),
        F.when(i % 9 == 0, "").otherwise(F.concat(F.lit("City "), (i % 20).cast("string"))).alias("city"),
        country.alias("country"),
        F.when(i % 6 != 0, (i % 160 - 80) / F.lit(2.0)).alias("lat"),
        F.when(i % 7 != 0, (i % 340 - 170) / F.lit(2.0)).alias("lng"),
        F.col("lang").alias("category"),
        (i % 13).alias("agree_count"),
        (i % 3).alias("disagree_count"),
        (i % 4 == 0).alias("closed"),
    )


TIPS_SQL = """
tips AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, 1600000000 + doc_id * 7919 AS ts, text, source AS venue,
    'v' || CAST(doc_id % 97 AS VARCHAR) AS venue_id,
    CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'City ' || CAST(doc_id % 20 AS VARCHAR) END AS city,
    CASE doc_id % 5 WHEN 0 THEN 'Italia' WHEN 1 THEN 'Polska' WHEN 2 THEN 'Germany' WHEN 3 THEN 'España' ELSE 'Беларусь' END AS country,
    CASE WHEN doc_id % 6 <> 0 THEN (doc_id % 160 - 80) / 2.0e0 END AS lat,
    CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 340 - 170) / 2.0e0 END AS lng,
    lang AS category, doc_id % 13 AS agree_count, doc_id % 3 AS disagree_count, doc_id % 4 = 0 AS closed
  FROM documents
)"""


def world_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``customer`` table read as a world-city list; some names match visited cities."""
    c, i = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(
        F.when(i < 12, F.concat(F.lit("city "), i.cast("string")))
        .when(i < 24, F.concat(F.lit("Old City "), i.cast("string"))).otherwise(F.col("c_name")).alias("name"),
        ((i % 160 - 80) / F.lit(1.0)).alias("lat"),
        ((i % 340 - 170) / F.lit(1.0)).alias("lng"),
        ((i * 7 % 3000) / F.lit(100.0) + 0.003).alias("pop_m"),
        F.element_at(
            F.array(*[F.lit(x) for x in ("AS", "EU", "NA", "SA", "AF", "OC")]), (i % 6 + 1).cast("int")
        ).alias("continent"),
    )


WORLD_SQL = """
world AS (
  SELECT CASE WHEN c_custkey < 12 THEN 'city ' || CAST(c_custkey AS VARCHAR)
              WHEN c_custkey < 24 THEN 'Old City ' || CAST(c_custkey AS VARCHAR) ELSE c_name END AS name,
    (c_custkey % 160 - 80) / 1.0e0 AS lat, (c_custkey % 340 - 170) / 1.0e0 AS lng,
    (c_custkey * 7 % 3000) / 100.0e0 + 0.003e0 AS pop_m,
    CASE c_custkey % 6 WHEN 0 THEN 'AS' WHEN 1 THEN 'EU' WHEN 2 THEN 'NA' WHEN 3 THEN 'SA' WHEN 4 THEN 'AF' ELSE 'OC' END AS continent
  FROM customer
)"""
