"""DuckDB building blocks shared by the query texts."""
from __future__ import annotations

from roamlog.sources.fixtures import TIPS_SQL, WORLD_SQL, checkins_sql

DATED = """c AS (
  SELECT *, make_timestamp(ts * 1000000) AS t, CAST(make_timestamp(ts * 1000000) AS DATE) AS d,
         coalesce(nullif(venue_id, ''), nullif(venue, '')) AS place FROM ck
)"""


def ck(body: str, years: int = 1, extra: str = "") -> str:
    """Text over ``ck`` (check-ins) and ``c`` (the same with ``t``, ``d`` and ``place``)."""
    more = f", {extra}" if extra else ""
    return f"WITH {checkins_sql(years)}, {DATED}{more}\n{body}"


def tips(body: str, extra: str = "") -> str:
    more = f", {extra}" if extra else ""
    return f"WITH {TIPS_SQL}{more}\n{body}"


def world(body: str, extra: str = "") -> str:
    more = f", {extra}" if extra else ""
    return f"WITH {checkins_sql()}, {DATED}, {WORLD_SQL}{more}\n{body}"
