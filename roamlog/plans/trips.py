"""Trip detection: maximal runs of rows away from home, widened by departure and arrival rules.

A trip is an interval ``[start_idx, end_idx]`` over the ordinals of one log. Every rule is a
lookup of the nearest marked row before or after a position, so two chunked scans
(:func:`roamlog.operators.ordered.scan_log`) provide all of them. Ends depend only on the run's
last row; starts depend on the previous run's end. Only the table of forced ends couples a
start back to an end: each run is then a small function from the end before it to its own, and
these functions are composed along the log (:func:`roamlog.operators.ordered.carried_states`).

Intervals may overlap (an arrival may reach past a later short run), so membership is a join.
"""
from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, functions as F

from roamlog import fixed
from roamlog.functions import scalars as S
from roamlog.operators.ordered import DAY, carried_states, chunk_of, mark_neighbours, numbered, scan_log, with_chunk
from roamlog.session import stage

HOUR = 3600
_ROW = ["venue", "venue_id", "city", "country", "category", "lat", "lng"]


@dataclass(frozen=True)
class TripTables:
    """Optional curated tables. Each carries the ``by`` columns and is keyed by a trip start.

    ``names(name_ts, name)``, ``tags(start_ts, tags array)``, ``exclude(start_ts)``,
    ``end_overrides(start_ts, end_ts)``, ``start_overrides(start_ts, new_start_ts)``.
    """

    names: DataFrame | None = None
    tags: DataFrame | None = None
    exclude: DataFrame | None = None
    end_overrides: DataFrame | None = None
    start_overrides: DataFrame | None = None


@dataclass(frozen=True)
class Trips:
    """Detected trips: ``intervals`` over the numbered log ``ordered``."""

    by: list[str]
    ordered: DataFrame
    intervals: DataFrame
    tables: TripTables

    @cached_property
    def rows(self) -> DataFrame:
        """Rows of every trip with local times, staged at first use: each per-trip result reads it."""
        return stage(_trip_rows(self), "trip-rows")


def _within(later: Column, earlier: Column, seconds: int) -> Column:
    return (later - earlier) <= seconds


def mark_log(ck: DataFrame, by: list[str], home: str, min_checkins: int, tables: TripTables,
             chunk_seconds: int | None = None) -> DataFrame:
    """Numbered log with the neighbour lookups all trip rules need (plus probe rows), staged.

    Columns next to the row fields: ``idx``, the neighbours of each mark, ``is_*`` flags, and
    ``fp`` (first position of the run) on the last row of every run that is long enough.
    """
    city, cat = F.col("city"), F.col("category")
    rows = ck.filter(F.col("ts").isNotNull()).select(
        *by, "ts", F.coalesce("checkin_id", F.lit("")).alias("checkin_id"),
        *[S.text(F.col(c)).alias(c) for c in _ROW[:5]], "lat", "lng",
        F.lit(True).alias("real"),
    )
    for probe in _probes(by, tables):
        rows = rows.unionByName(probe, allowMissingColumns=True)

    real = F.col("real")
    at_home = real & (city == home)
    foreign = real & (city != home) & (city != "")
    hub = at_home & cat.isin(fixed.TRANSPORT_HUBS)
    on_ride = at_home & cat.isin(fixed.BICYCLE_START)
    bicycle = {"pass": on_ride} if tables.tags is not None else {}
    scanned = scan_log(
        with_chunk(rows, by, chunk_seconds=chunk_seconds), by,
        following={
            "home": at_home,
            "hub": hub,
            "nbhd": at_home & (cat == fixed.NEIGHBORHOOD_CATEGORY),
            "hp": at_home & (cat == fixed.HOME_CATEGORY),
            "foreign": foreign,
            "stop": (foreign & ~cat.isin(fixed.ROADSIDE)) | (real & cat.isin(fixed.NIGHTLIFE)),
            **bicycle,
        },
        preceding={"home": at_home, "foreign": foreign},
        timed={"hub", "nbhd", "hp", *bicycle}, real=real,
    )
    run_first = F.coalesce("prev_home", F.lit(0)) + 1
    run_last = F.coalesce(F.col("next_home") - 1, F.col("log_rows"))
    kept = real & (city != home) & ((run_last - run_first + 1) >= max(1, min_checkins - 1))
    return stage(
        scanned.withColumns(
            {
                "is_hub": hub,
                "is_foreign": foreign,
                "is_pass": on_ride,
                "run_start": kept & (F.col("idx") == run_first),
                "fp": F.when(kept & (F.col("idx") == run_last), run_first),
            }
        ).drop("log_rows", "next_home", "prev_home"),
        "ordered",
    )


def _probes(by: list[str], t: TripTables) -> list[DataFrame]:
    """Positions asked for by the curated tables, as unnumbered rows that sort before ties."""
    def probe(df: DataFrame, ts: Column) -> DataFrame:
        return df.select(*by, ts.cast("bigint").alias("ts"), F.lit(None).cast("string").alias("checkin_id"),
                         F.lit(False).alias("real"))

    out = []
    if t.end_overrides is not None:
        out.append(probe(t.end_overrides, F.col("end_ts") + 1))
    if t.start_overrides is not None:
        out.append(probe(t.start_overrides, F.col("new_start_ts")))
    if t.tags is not None:
        out.append(probe(t.tags.filter(F.array_contains("tags", "bicycle")), F.col("start_ts") - 4 * HOUR))
    return out


def _rank_at(ordered: DataFrame, by: list[str], points: DataFrame, ts: Column, name: str) -> DataFrame:
    """``points`` plus the number of log rows before time ``ts`` (from the probe rows)."""
    probes = ordered.filter(~F.col("real")).select(*by, F.col("ts").alias("_at"), F.col("idx").alias(name)).distinct()
    return points.withColumn("_at", ts.cast("bigint")).join(probes, [*by, "_at"]).drop("_at")


def _row_at(ordered: DataFrame, by: list[str], position: str, cols: dict[str, str]) -> DataFrame:
    return ordered.filter("real").select(*by, F.col("idx").alias(position), *[F.col(c).alias(n) for c, n in cols.items()])


def link_runs(ordered: DataFrame, by: list[str]) -> DataFrame:
    """Run ends with the start time of their run and the run before; departure candidates with
    the run they may open. Only those rows take part, not the whole log."""
    ride = F.col("category").isin([*fixed.DEPARTURE_SERVICES, fixed.DEPARTURE_FUEL])
    candidate = ~F.col("is_foreign") & (F.col("is_hub") | ride)
    rows = ordered.filter(F.col("real") & (F.col("run_start") | F.col("fp").isNotNull() | candidate)).select(
        *by, "_chunk", "idx", "ts", "venue_id", "category", "is_hub", candidate.alias("candidate"), "run_start", "fp",
        "next_hub", "next_hub_ts", "next_nbhd", "next_nbhd_ts", "next_hp", "next_foreign",
    )
    return mark_neighbours(
        rows, by,
        following={"kept": F.col("run_start")},
        preceding={"run": F.col("run_start"), "kept_end": F.col("fp").isNotNull()},
        timed={"kept", "run"},
    )


def runs_of(linked: DataFrame, by: list[str]) -> DataFrame:
    """One row per long-enough run with its arrival: ``fp, lp, start_ts, end1, found``."""
    r = linked.filter(F.col("fp").isNotNull()).select(
        *by, "fp", F.col("idx").alias("lp"), F.col("prev_kept_end").alias("prev_lp"),
        F.when(F.col("fp") == F.col("idx"), F.col("ts")).otherwise(F.col("prev_run_ts")).alias("start_ts"),
        F.col("ts").alias("last_ts"),
        "next_hub", "next_hub_ts", "next_nbhd", "next_nbhd_ts", "next_hp", "next_foreign",
    )
    hub_ok = _within(F.col("next_hub_ts"), F.col("last_ts"), DAY)
    clear = (F.col("next_foreign").isNull() | (F.col("next_foreign") > F.col("next_nbhd"))) & (
        F.col("next_hp").isNull() | (F.col("next_hp") > F.col("next_nbhd"))
    )
    nbhd_ok = _within(F.col("next_nbhd_ts"), F.col("last_ts"), DAY) & clear
    arrival = F.when(hub_ok, F.col("next_hub")).when(nbhd_ok, F.col("next_nbhd"))
    return r.select(
        *by, "fp", "lp", "prev_lp", "start_ts", "last_ts",
        F.coalesce(arrival, "lp").alias("end1"), arrival.isNotNull().alias("found"),
    )


def _home_arrival(runs: DataFrame, ordered: DataFrame, by: list[str], position: str) -> DataFrame:
    """Adds ``end_idx``: the way home from ``position`` when it is direct enough."""
    # An arrival without a forced end is a hub, a neighbourhood or the run's own last row.
    places = ordered if position != "end1" else ordered.filter(
        F.col("is_hub") | (F.col("category") == fixed.NEIGHBORHOOD_CATEGORY) | F.col("fp").isNotNull())
    at = _row_at(places, by, position, {"ts": "_ts", "next_hp": "_hp", "next_hp_ts": "_hp_ts", "next_stop": "_stop"})
    window = F.when(F.col("found"), 5 * HOUR).otherwise(12 * HOUR)
    direct = ((F.col("_hp_ts") - F.col("_ts")) <= window) & (F.col("_stop").isNull() | (F.col("_stop") > F.col("_hp")))
    return (
        runs.join(at, [*by, position])
        .withColumn("end_idx", F.when(direct, F.col("_hp")).otherwise(F.col(position)))
        .drop("_ts", "_hp", "_hp_ts", "_stop")
    )


def _after(runs: DataFrame, ends: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``prev_end``, the final end of the run before (0 for the first). ``ends(lp, end_idx)``."""
    before = ends.select(*by, F.col("lp").alias("prev_lp"), F.col("end_idx").alias("prev_end"))
    return runs.join(before, [*by, "prev_lp"], "left").withColumn("prev_end", F.coalesce("prev_end", F.lit(0)))


def _starts(runs: DataFrame, linked: DataFrame, by: list[str], variant: list[str] | None = None) -> DataFrame:
    """Adds ``start1`` and ``start1_ts`` (departure rules) to ``runs``, which carry ``prev_end``.

    ``variant`` names the columns that tell apart rows of one run with different ends before it.
    """
    # A row can only open the next kept run, so candidates never multiply.
    services = F.col("category").isin(fixed.DEPARTURE_SERVICES)
    fuel = F.col("category") == fixed.DEPARTURE_FUEL
    near = linked.filter(
        F.col("candidate") & F.col("next_kept").isNotNull()
        & _within(F.col("next_kept_ts"), F.col("ts"), DAY)
        & (F.col("next_foreign").isNull() | (F.col("next_foreign") >= F.col("next_kept")))
    ).select(*by, F.col("next_kept").alias("fp"), "idx", "ts", "venue_id", "is_hub",
             services.alias("is_service"), fuel.alias("is_fuel"))
    keys = [*by, "fp", *(variant or [])]
    near = near.join(runs.select(*keys, "prev_end", "start_ts"), [*by, "fp"]).filter(F.col("idx") > F.col("prev_end"))

    back = Window.partitionBy(*keys).orderBy(F.desc("idx"))
    later_venue = F.lag("venue_id").over(back)
    hubs = (
        near.filter("is_hub")
        .withColumn("_again", F.coalesce((F.col("venue_id") == later_venue) & (F.col("venue_id") != ""), F.lit(False)))
        .filter("NOT _again")
        .withColumn("_gap", F.lag("ts").over(back) - F.col("ts"))
        .withColumn("_broken", F.sum(F.when(F.col("_gap") > 3 * HOUR, 1).otherwise(0)).over(
            back.rowsBetween(Window.unboundedPreceding, 0)))
        .filter("_broken = 0")
        .groupBy(*keys)
        .agg(F.min("idx").alias("hub_idx"), F.min("ts").alias("hub_ts"))
    )
    same_day = F.floor(F.col("ts") / DAY) == F.floor(F.col("start_ts") / DAY)
    rides = (
        near.filter((F.col("is_service") | F.col("is_fuel")) & same_day)
        .groupBy(*keys)
        .agg(
            F.min(F.when(F.col("is_service"), F.col("idx"))).alias("svc_idx"),
            F.min(F.when(F.col("is_service"), F.col("ts"))).alias("svc_ts"),
            F.max(F.when(F.col("is_fuel"), F.col("idx"))).alias("fuel_idx"),
            F.max(F.when(F.col("is_fuel"), F.col("ts"))).alias("fuel_ts"),
        )
    )
    out = runs.join(hubs, keys, "left").join(rides, keys, "left")
    ride_ts = F.coalesce("svc_ts", "fuel_ts")
    ride_ok = _within(F.col("start_ts"), ride_ts, 4 * HOUR)
    ride = F.when(ride_ok, F.coalesce("svc_idx", "fuel_idx"))
    return out.withColumns(
        {
            "start1": F.coalesce("hub_idx", ride, "fp"),
            "start1_ts": F.coalesce("hub_ts", F.when(ride_ok, ride_ts), "start_ts"),
        }
    ).drop("hub_idx", "hub_ts", "svc_idx", "svc_ts", "fuel_idx", "fuel_ts")


def _forced_ends(runs: DataFrame, ordered: DataFrame, linked: DataFrame, by: list[str],
                 overrides: DataFrame) -> DataFrame:
    """Solve starts and forced ends together, however many follow each other.

    A forced end is keyed by a start, and a moved end can move the start of the next run only. So a
    run has few possible ends: its own (state 0), and one per forced end keyed by a row that may
    open it. For each possible end of the run before, its start, and by it its own state, are found
    at once; what is left is to carry states through these functions. Several ends for one start:
    the latest counts.
    """
    run = [*by, "fp"]
    keyed = overrides.groupBy(*by, F.col("start_ts").cast("bigint").alias("start1_ts")).agg(F.max("end_ts").alias("end_ts"))
    forced = _rank_at(ordered, by, keyed, F.col("end_ts") + 1, "forced").select(*by, "start1_ts", "forced")

    own = linked.filter("run_start").select(*by, F.col("ts").alias("start1_ts"), F.col("idx").alias("fp"))
    opening = linked.filter(F.col("candidate") & F.col("next_kept").isNotNull()).select(
        *by, F.col("ts").alias("start1_ts"), F.col("next_kept").alias("fp"))
    ends = own.unionByName(opening).join(forced, [*by, "start1_ts"]).distinct().join(runs.drop("end_idx"), run).withColumns({
        "end2": F.greatest("end1", "forced"),
        "state": F.row_number().over(Window.partitionBy(*run).orderBy("start1_ts")),
    })
    ends = _home_arrival(ends, ordered, by, "end2").select(*run, "lp", "state", "start1_ts", "end_idx")
    states = stage(ends.unionByName(runs.select(
        *run, "lp", F.lit(0).alias("state"), F.lit(None).cast("bigint").alias("start1_ts"), "end_idx")), "run-states")

    before = states.select(*by, F.col("lp").alias("prev_lp"), F.col("state").alias("prev_state"), F.col("end_idx").alias("prev_end"))
    variants = runs.drop("end_idx").join(before, [*by, "prev_lp"], "left").withColumns(
        {"prev_state": F.coalesce("prev_state", F.lit(0)), "prev_end": F.coalesce("prev_end", F.lit(0))})
    keyed_state = states.filter("state > 0").select(*run, "start1_ts", "state")
    steps = stage(_starts(variants, linked, by, ["prev_state"]).join(keyed_state, [*run, "start1_ts"], "left").withColumn(
        "state", F.coalesce("state", F.lit(0))), "run-steps")

    # Only runs with several possible ends before them wait for the run before. A step of one
    # value starts anew whatever came before it.
    table = F.transform(F.array_sort(F.collect_list(F.struct("prev_state", "state"))), lambda x: x["state"])
    functions = steps.groupBy(*run).agg(table.alias("step"), F.first("prev_lp").alias("prev_lp"))
    waiting = functions.filter(F.size("step") > 1)
    heads = functions.join(runs.select(*run, "lp"), run).join(
        waiting.select(*by, F.col("prev_lp").alias("lp")), [*by, "lp"], "left_semi").filter(F.size("step") == 1)
    chain = numbered(waiting.select(*run, "step").unionByName(heads.select(*run, "step")), by,
                     [F.floor(F.col("fp") / _BLOCK)], [F.col("fp")], "pos")
    solved = carried_states(chain, by).withColumn("waits", F.size("step") > 1)
    chosen = steps.join(solved.filter("waits").select(*run, F.col("before").alias("_before")), run, "left").filter(
        F.coalesce(F.col("_before") == F.col("prev_state"), F.lit(True))).drop("_before", "prev_state")
    return chosen.join(states.select(*run, "state", "end_idx"), [*run, "state"]).drop("state")


def detect(
    ck: DataFrame,
    by: list[str],
    home: str,
    min_checkins: int = 5,
    tables: TripTables | None = None,
    chunk_seconds: int | None = None,
) -> Trips:
    """Find the trips of every log. ``ck`` needs ``by``, ``ts``, ``checkin_id`` and the row fields."""
    t = tables or TripTables()
    ordered = mark_log(ck, by, home, min_checkins, t, chunk_seconds)
    linked = stage(link_runs(ordered, by), "runs")
    runs = _home_arrival(runs_of(linked, by), ordered, by, "end1")
    if t.end_overrides is None:
        found = _starts(_after(runs, runs, by), linked, by)
    else:
        found = _forced_ends(stage(runs, "run-ends"), ordered, linked, by, t.end_overrides)
    found = found.withColumns({"start_idx": F.col("start1"), "name_ts": F.col("start1_ts")})
    if t.start_overrides is not None:
        found = _forced_starts(found, ordered, by, t.start_overrides)
    found = found.withColumn("start_ts", F.col("name_ts"))
    if t.tags is not None:
        found = _bicycle_starts(found, ordered, by, t.tags)
    found = found.filter((F.col("end_idx") - F.col("start_idx") + 1) >= min_checkins)
    if t.exclude is not None:
        found = found.join(t.exclude.select(*by, "start_ts").distinct(), [*by, "start_ts"], "left_anti")
    trips = numbered(
        found.select(*by, "fp", "start_idx", "end_idx", "start_ts", "name_ts"),
        by, [chunk_of(F.col("start_ts"), chunk_seconds or DAY)], [F.col("start_ts"), F.col("fp")], "trip_id",
    )
    intervals = stage(
        trips.select(*by, "trip_id", "start_idx", "end_idx", "start_ts", "name_ts"), "intervals"
    )
    return Trips(by, ordered.filter("real"), intervals, t)


def curated(t: Trips, names: DataFrame | None = None, tags: DataFrame | None = None) -> Trips:
    """Trips already found with curated names and tags. Tags of rides move starts, so only :func:`detect` can take them."""
    if tags is not None and not tags.filter(F.array_contains("tags", "bicycle")).isEmpty():
        raise ValueError("give tags of rides to detect")
    return replace(t, tables=replace(t.tables, names=names, tags=tags))


def _forced_starts(runs: DataFrame, ordered: DataFrame, by: list[str], overrides: DataFrame) -> DataFrame:
    ranked = _rank_at(ordered, by, overrides, F.col("new_start_ts"), "_before").select(
        *by, F.col("start_ts").alias("start1_ts"), (F.col("_before") + 1).alias("_first")
    )
    earlier = (
        runs.select(*by, "fp", "start_idx", "start1_ts").join(ranked, [*by, "start1_ts"])
        .filter(F.col("_first") < F.col("start_idx"))
        .select(*by, "fp", "_first")
        .join(_row_at(ordered, by, "_first", {"ts": "_first_ts"}), [*by, "_first"])
    )
    return (
        runs.join(earlier, [*by, "fp"], "left")
        .withColumns({
            "start_idx": F.coalesce("_first", "start_idx"),
            "name_ts": F.coalesce("_first_ts", "name_ts"),
        })
        .drop("_first", "_first_ts")
    )


def _bicycle_starts(runs: DataFrame, ordered: DataFrame, by: list[str], tags: DataFrame) -> DataFrame:
    tagged = tags.filter(F.array_contains("tags", "bicycle")).select(*by, F.col("start_ts").alias("name_ts")).distinct()
    tagged = _rank_at(ordered, by, tagged, F.col("name_ts") - 4 * HOUR, "_before")
    begin = (
        runs.select(*by, "fp", "prev_end", "start_idx", "name_ts")
        .join(tagged, [*by, "name_ts"])
        .join(_row_at(ordered, by, "start_idx", {"prev_foreign": "_foreign"}), [*by, "start_idx"])
        .withColumn("_lo", F.greatest("_before", "prev_end", F.coalesce("_foreign", F.lit(0))) + 1)
        .join(
            _row_at(ordered, by, "_lo", {"ts": "_ts", "is_pass": "_is", "next_pass": "_np", "next_pass_ts": "_np_ts"}),
            [*by, "_lo"],
        )
        .withColumns({
            "_anchor": F.when(F.col("_is"), F.col("_lo")).otherwise(F.col("_np")),
            "_anchor_ts": F.when(F.col("_is"), F.col("_ts")).otherwise(F.col("_np_ts")),
        })
        .filter(F.col("_anchor") < F.col("start_idx"))
        .select(*by, "fp", "_anchor", "_anchor_ts")
    )
    return (
        runs.join(begin, [*by, "fp"], "left")
        .withColumns({
            "start_idx": F.coalesce("_anchor", "start_idx"),
            "start_ts": F.coalesce("_anchor_ts", "start_ts"),
        })
        .drop("_anchor", "_anchor_ts")
    )


# ---------------------------------------------------------------------------------------------
# Results per trip


_SLOT = 64
_BLOCK = 1 << 20


def membership(t: Trips) -> DataFrame:
    """Rows of each trip (a row may belong to two). Intervals meet rows on slots of 64 ordinals.

    A long interval is cut in two steps, blocks and then slots, so that no row ever holds the
    whole list of its slots.
    """
    blocks = t.intervals.select(
        *t.by, "trip_id", "start_idx", "end_idx",
        F.explode(F.sequence(F.floor(F.col("start_idx") / _BLOCK), F.floor(F.col("end_idx") / _BLOCK))).alias("_b"),
    )
    lo = F.greatest(F.floor(F.col("start_idx") / _SLOT), F.col("_b") * (_BLOCK // _SLOT))
    hi = F.least(F.floor(F.col("end_idx") / _SLOT), (F.col("_b") + 1) * (_BLOCK // _SLOT) - 1)
    slots = blocks.select(*t.by, "trip_id", "start_idx", "end_idx", F.explode(F.sequence(lo, hi)).alias("_slot"))
    rows = t.ordered.select(*t.by, "idx", "ts", "checkin_id", *_ROW, F.floor(F.col("idx") / _SLOT).alias("_slot"))
    return rows.join(slots, [*t.by, "_slot"]).filter(F.col("idx").between(F.col("start_idx"), F.col("end_idx"))).drop("_slot")


def _trip_rows(t: Trips) -> DataFrame:
    lat, lng = F.round("lat", 5), F.round("lng", 5)
    local = S.localise(F.col("ts"), S.tz_for(F.col("country"), lat, lng))
    return membership(t).withColumn("local", local).withColumns({"lat": lat, "lng": lng})


def trip_checkins(t: Trips) -> DataFrame:
    """Rows of each trip with local date and time."""
    local = F.col("local")
    return t.rows.select(
        *t.by, "trip_id", "idx", "ts", "checkin_id",
        S.fmt_date(local).alias("date"), S.fmt_time(local).alias("time"), S.fmt_datetime(local).alias("datetime"), *_ROW,
    )


def trip_unique_points(t: Trips) -> DataFrame:
    """First row per venue of a trip, where that row has coordinates."""
    first = t.rows.filter("venue_id <> ''").groupBy(*t.by, "trip_id", "venue_id").agg(
        F.min_by(F.struct("lat", "lng", "venue"), F.col("idx")).alias("p")
    )
    return first.filter(F.col("p.lat").isNotNull() & F.col("p.lng").isNotNull()).select(
        *t.by, "trip_id", "venue_id", "p.lat", "p.lng", "p.venue"
    )


def _facets(t: Trips) -> DataFrame:
    """Counts per trip of country, city and category, with the first appearance."""
    facet = F.array(*[
        F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in ("country", "city", "category")
    ])
    return (
        t.rows.select(*t.by, "trip_id", "idx", F.explode(facet).alias("f"))
        .filter("f.value <> ''")
        .groupBy(*t.by, "trip_id", F.col("f.facet").alias("facet"), F.col("f.value").alias("value"))
        .agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))
    )


def trip_categories(t: Trips, k: int = 10) -> DataFrame:
    """Top categories per trip, with their position."""
    w = Window.partitionBy(*t.by, "trip_id").orderBy(F.desc("n"), "first_idx")
    return (
        _facets(t).filter("facet = 'category'").withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)
        .select(*t.by, "trip_id", "pos", F.col("value").alias("category"), "n")
    )


def _ranked_values(facet: str) -> Column:
    """Values of one facet, most frequent first (a vocabulary, not rows)."""
    items = F.array_sort(F.collect_list(F.when(
        F.col("facet") == facet, F.struct((-F.col("n")).alias("o"), "first_idx", "value"))))
    return F.transform(items, lambda x: x["value"])


def trip_sizes(t: Trips) -> DataFrame:
    """``checkin_count`` of each trip, as in :func:`trip_summary`: ordinals have no gaps, so an interval tells its rows."""
    return t.intervals.select(*t.by, "trip_id", (F.col("end_idx") - F.col("start_idx") + 1).alias("checkin_count"))


def trip_summary(t: Trips) -> DataFrame:
    """One row per trip: dates, places by frequency, counts, extent, name and tags."""
    keys = [*t.by, "trip_id"]
    # Days as numbers keep this a hash aggregate.
    day = F.unix_date(F.to_date("local"))
    base = t.rows.groupBy(*keys).agg(
        F.count("*").alias("checkin_count"),
        F.min_by(day, "idx").alias("_d0"), F.max_by(day, "idx").alias("_d1"),
        F.count_distinct(S.blank_to_null(F.col("venue_id"))).alias("unique_places"),
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.min("lng").alias("min_lng"), F.max("lng").alias("max_lng"),
    ).withColumns({
        "start_date": F.date_from_unix_date("_d0").cast("string"), "end_date": F.date_from_unix_date("_d1").cast("string"),
    }).drop("_d0", "_d1")
    places = _facets(t).filter("facet <> 'category'").groupBy(*keys).agg(
        _ranked_values("country").alias("countries"), _ranked_values("city").alias("cities")
    )
    empty = F.array().cast("array<string>")
    out = t.intervals.join(base, keys).join(places, keys, "left").withColumns(
        {
            "countries": F.coalesce("countries", empty),
            "cities": F.coalesce("cities", empty),
            "start_year": F.left("start_date", F.lit(4)).cast("int"),
            "duration": S.duration_days(F.col("start_date"), F.col("end_date")),
        }
    ).withColumn("name", auto_name(F.col("countries"), F.col("cities")))
    if t.tables.names is not None:
        custom = t.tables.names.select(*t.by, F.col("name_ts").cast("bigint").alias("name_ts"), F.col("name").alias("_name"))
        out = out.join(custom, [*t.by, "name_ts"], "left").withColumn("name", F.coalesce("_name", "name")).drop("_name")
    if t.tables.tags is None:
        return out.withColumn("tags", empty)
    tags = t.tables.tags.select(*t.by, F.col("start_ts").alias("_at"), F.col("tags").alias("_t"))
    on_name = tags.withColumnsRenamed({"_at": "name_ts", "_t": "_tn"})
    on_start = tags.withColumnsRenamed({"_at": "start_ts", "_t": "_ts"})
    return (
        out.join(on_name, [*t.by, "name_ts"], "left").join(on_start, [*t.by, "start_ts"], "left")
        .withColumn("tags", F.coalesce(F.when(F.size("_tn") > 0, F.col("_tn")), "_ts", empty)).drop("_tn", "_ts")
    )


def auto_name(countries: Column, cities: Column) -> Column:
    n = F.size(countries)
    first = F.try_element_at(countries, F.lit(1))
    second = F.try_element_at(countries, F.lit(2))
    city = F.try_element_at(cities, F.lit(1))
    return (
        F.when(n == 0, F.coalesce(city, F.lit("Unknown")))
        .when(n == 1, F.concat_ws(", ", F.coalesce(city, first), first))
        .when(n == 2, F.concat_ws(" & ", first, second))
        .otherwise(F.concat(first, F.lit(" + "), second, F.lit(" + "), (n - 2).cast("string"), F.lit(" more")))
    )


def route_order(t: Trips) -> DataFrame:
    """Located rows of each trip in travel order. ``pos`` is 1-based."""
    located = t.rows.filter("lat IS NOT NULL AND lng IS NOT NULL")
    return numbered(
        located, [*t.by, "trip_id"], [F.floor(F.col("idx") / 4096)], [F.col("idx")], "pos"
    ).select(*t.by, "trip_id", "pos", "ts", "lat", "lng")


def trip_days(t: Trips) -> DataFrame:
    """Check-ins of each trip per local day."""
    return t.rows.groupBy(*t.by, "trip_id", S.fmt_date(F.col("local")).alias("date")).agg(F.count("*").alias("n"))


def timeline(summary: DataFrame, by: list[str], countries: int = 6) -> DataFrame:
    """Trips as bars on their start year: offset and width in per cent of the year."""
    start = F.unix_timestamp(F.to_timestamp("start_date"))
    end = F.unix_timestamp(F.to_timestamp("end_date")) + 86_399
    jan1 = F.unix_timestamp(F.to_timestamp(F.make_date("start_year", F.lit(1), F.lit(1))))
    span = F.unix_timestamp(F.to_timestamp(F.make_date(F.col("start_year") + 1, F.lit(1), F.lit(1)))) - 1 - jan1
    return summary.select(
        *by, "trip_id", "name", F.col("start_date").alias("start"), F.col("end_date").alias("end"),
        F.col("duration").alias("days"), F.slice("countries", 1, countries).alias("countries"),
        F.col("checkin_count").alias("n"), F.col("start_year").alias("year"),
        F.round(F.greatest(F.lit(0.0), (start - jan1) / span * 100), 3).alias("left_pct"),
        F.round(F.greatest(F.lit(0.1), (end - start) / span * 100), 3).alias("width_pct"),
    )


def timeline_totals(summary: DataFrame, by: list[str]) -> DataFrame:
    return summary.groupBy(*by, F.col("start_year").alias("year")).agg(F.sum("checkin_count").alias("n"))


def infer_icon(t: Trips, summary: DataFrame, probe: int = 5) -> DataFrame:
    """Strongest transport icon among the first and last rows of each trip ('' when none)."""
    icon = S.lookup(fixed.TRANSPORT_ICONS, F.col("category"))
    rank = S.lookup({k: str(v) for k, v in fixed.ICON_RANK.items()}, icon).cast("int")
    by_rank = {str(v): k for k, v in fixed.ICON_RANK.items()}
    best = (
        t.rows.filter((F.col("idx") < F.col("start_idx") + probe) | (F.col("idx") > F.col("end_idx") - probe))
        .groupBy(*t.by, "trip_id").agg(F.max(rank).alias("_rank"))
        .select(*t.by, "trip_id", S.lookup(by_rank, F.col("_rank").cast("string")).alias("icon"))
    )
    return summary.join(best, [*t.by, "trip_id"], "left").withColumn("icon", F.coalesce("icon", F.lit("")))


def named_with_icon(t: Trips, summary: DataFrame) -> DataFrame:
    """``display_name`` per trip: bare for bicycle trips, else with an icon (a car by default)."""
    bicycle = F.array_contains("tags", "bicycle")
    bare = S.strip_icon(F.col("name"))
    icon = F.when(F.col("icon") == "", "🚗").otherwise(F.col("icon"))
    return infer_icon(t, summary).withColumn(
        "display_name", F.when(bicycle, bare).otherwise(F.concat_ws(" ", bare, icon))
    )


def update_trip_names(registry: DataFrame, named: DataFrame, by: list[str]) -> DataFrame:
    """Name registry plus the trips it lacks, or whose icon it lacks or should not have."""
    keys = [*by, "name_ts"]
    new = named.groupBy(*keys).agg(
        F.max_by("display_name", "trip_id").alias("_new"),
        F.max_by(F.array_contains("tags", "bicycle"), "trip_id").alias("_bike"),
    )
    both = registry.select(*keys, "name").join(new, keys, "full_outer")
    stale = F.col("_new").isNotNull() & (F.col("name").isNull() | (F.col("_bike") == S.has_icon(F.col("name"))))
    return both.select(*keys, F.when(stale, F.col("_new")).otherwise(F.col("name")).alias("name"))
