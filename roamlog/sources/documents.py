"""Nested check-in, tip and venue documents -> flat rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from roamlog.functions import scalars as S
from roamlog.schema import CHECKIN_FIELDS


def _blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def primary_category(cats: Column) -> Column:
    """Name of the first primary category, else of the first one, else blank."""
    first_primary = F.try_element_at(F.filter(cats, lambda c: F.coalesce(c["primary"], F.lit(False))), F.lit(1))
    return _blank(F.coalesce(first_primary["name"], F.when(first_primary.isNull(), F.try_element_at(cats, F.lit(1))["name"])))


def _full_name(p: Column) -> Column:
    return S.py_strip(F.concat(_blank(p["firstName"]), F.lit(" "), _blank(p["lastName"])))


def _joined(people: Column, what) -> Column:
    return F.array_join(F.transform(F.coalesce(people, F.array()), what), ", ")


def _people(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<struct<id:string,firstName:string,lastName:string>>"))


def flatten_checkins(docs: DataFrame, venue_base: str = "", keep: list[str] | None = None) -> DataFrame:
    """Documents (see ``CHECKIN_DOC_DDL``) -> the columns ``keep`` and the 22 stored text columns."""
    met = F.transform(
        F.filter(F.coalesce(F.col("overlaps.items"), F.array().cast(
            "array<struct<user:struct<id:string,firstName:string,lastName:string>>>")), lambda x: x["user"].isNotNull()),
        lambda x: x["user"],
    )
    creator = _blank(F.col("createdBy.id"))
    by_friend = (creator != "") & (creator != _blank(F.col("user.id")))
    vid = _blank(F.col("venue.id"))
    loc = "venue.location"
    out = {
        "date": _blank(F.col("createdAt")),
        "venue": _blank(F.col("venue.name")),
        "venue_id": vid,
        "venue_url": F.coalesce(S.url_of(venue_base, F.lit("v"), vid), F.lit("")),
        **{c: _blank(F.col(f"{loc}.{c}")) for c in ("city", "state", "country", "neighborhood", "lat", "lng", "address")},
        "category": primary_category(F.col("venue.categories")),
        "shout": _blank(F.col("shout")),
        "source_app": _blank(F.col("source.name")),
        "source_url": _blank(F.col("source.url")),
        "with_name": S.py_strip(_joined(_people("with"), _full_name)),
        "with_id": _joined(_people("with"), lambda p: _blank(p["id"])),
        "created_by_name": F.when(by_friend, _full_name(F.col("createdBy"))).otherwise(""),
        "created_by_id": F.when(by_friend, creator).otherwise(""),
        "overlaps_name": S.py_strip(_joined(met, _full_name)),
        "overlaps_id": _joined(met, lambda p: _blank(p["id"])),
        "checkin_id": _blank(F.col("id")),
    }
    return docs.select(*(keep or []), *[out[c].alias(c) for c in CHECKIN_FIELDS])


def flatten_tips(docs: DataFrame, closed: bool | None = None) -> DataFrame:
    """Documents (see ``TIP_DOC_DDL``) -> tips. ``closed`` forces the flag instead of the venue's."""
    loc = "venue.location"
    flag = F.coalesce(F.col("venue.closed"), F.lit(False)) if closed is None else F.lit(closed)
    return docs.select(
        _blank(F.col("id")).alias("id"),
        F.coalesce("createdAt", F.lit(0)).alias("ts"),
        S.text(F.col("text")).alias("text"),
        S.text(F.col("venue.name")).alias("venue"),
        _blank(F.col("venue.id")).alias("venue_id"),
        S.text(F.col(f"{loc}.city")).alias("city"),
        S.text(F.col(f"{loc}.country")).alias("country"),
        F.round(f"{loc}.lat", 5).alias("lat"),
        F.round(f"{loc}.lng", 5).alias("lng"),
        S.text(primary_category(F.col("venue.categories"))).alias("category"),
        F.coalesce("agreeCount", F.lit(0)).cast("bigint").alias("agree_count"),
        F.coalesce("disagreeCount", F.lit(0)).cast("bigint").alias("disagree_count"),
        flag.alias("closed"),
    )


def owned_by(docs: DataFrame, owner: str) -> DataFrame:
    """Tip documents written by ``owner``."""
    return docs.filter(F.col("user.id") == owner)


def flatten_venue(docs: DataFrame, override_id: Column | None = None, venue_base: str = "") -> DataFrame:
    """Venue documents (``venue`` column) -> the 11 venue fields of the stored table.

    ``override_id`` replaces the document's id where it is not blank (a merged venue).
    """
    own = _blank(F.col("venue.id"))
    vid = own if override_id is None else F.coalesce(S.blank_to_null(override_id), own)
    loc = "venue.location"
    return docs.select(
        *[c for c in docs.columns if c != "venue"],
        S.text(F.col("venue.name")).alias("venue"),
        vid.alias("venue_id"),
        F.coalesce(S.url_of(venue_base, F.lit("v"), vid), F.lit("")).alias("venue_url"),
        *[S.text(F.col(f"{loc}.{c}")).alias(c) for c in ("city", "state", "country", "neighborhood")],
        *[_blank(F.col(f"{loc}.{c}")).alias(c) for c in _COORDS],
        S.text(F.col(f"{loc}.address")).alias("address"),
        S.text(primary_category(F.col("venue.categories"))).alias("category"),
    )


_COORDS = ("lat", "lng")


def newest_venues(docs: DataFrame) -> DataFrame:
    """Venue object of the newest check-in document per venue id."""
    from roamlog.operators.common import top_k

    rows = docs.filter(_blank(F.col("venue.id")) != "").select(
        F.col("venue.id").alias("doc_venue_id"), F.coalesce("createdAt", F.lit(0)).alias("_t"), "id", "venue")
    return top_k(rows, ["doc_venue_id"], [F.desc("_t"), F.asc("id")], 1).select("doc_venue_id", "venue")
