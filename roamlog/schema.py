"""Record layouts of the check-in and tip tables."""
from __future__ import annotations

from pyspark.sql import types as T

# Column order of the stored check-in table (all text).
CHECKIN_FIELDS = [
    "date", "venue", "venue_id", "venue_url", "city", "state", "country", "neighborhood",
    "lat", "lng", "address", "category", "shout", "source_app", "source_url",
    "with_name", "with_id", "created_by_name", "created_by_id",
    "overlaps_name", "overlaps_id", "checkin_id",
]

CHECKIN_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in CHECKIN_FIELDS])

TIP_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("ts", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("venue", T.StringType()),
        T.StructField("venue_id", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lng", T.DoubleType()),
        T.StructField("category", T.StringType()),
        T.StructField("agree_count", T.LongType()),
        T.StructField("disagree_count", T.LongType()),
        T.StructField("closed", T.BooleanType()),
    ]
)

_PERSON = "struct<id:string,firstName:string,lastName:string>"
_LOCATION = (
    "struct<city:string,state:string,country:string,neighborhood:string,"
    "lat:double,lng:double,address:string>"
)
_VENUE = (
    f"struct<id:string,name:string,closed:boolean,location:{_LOCATION},"
    "categories:array<struct<name:string,primary:boolean>>>"
)

# Nested documents as landed by an outside fetcher, one JSON object per line.
CHECKIN_DOC_DDL = (
    "id string, createdAt bigint, shout string, user struct<id:string>, "
    f"createdBy {_PERSON}, source struct<name:string,url:string>, "
    f"with array<{_PERSON}>, overlaps struct<items:array<struct<user:{_PERSON}>>>, venue {_VENUE}"
)
TIP_DOC_DDL = (
    "id string, createdAt bigint, text string, agreeCount bigint, disagreeCount bigint, "
    f"user struct<id:string>, venue {_VENUE}"
)

REVIEW_FIELDS = [
    "decision_source", "resolved_city", "country", "lat", "lng", "low_volume_checkins_detail",
]

WORLD_SCHEMA = "name string, lat double, lng double, pop_m double, continent string"
WEATHER_SCHEMA = "lat1 double, lng1 double, utc_date string, hour int, temp double, code int"
