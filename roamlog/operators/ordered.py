"""Ordered operators over event logs of any size per key.

``Window.partitionBy(user)`` puts a whole user in one task. Here a log is cut into time chunks
``(by, floor(ts / width))``: windows run inside a chunk, one summary row per chunk carries the
running state across chunks, and the two are joined on the chunk key. Chunks are wide where rows are sparse,
so summaries are few, and narrow where they are dense, so that one user with a third of all
rows, or a burst of them in one day, is spread over as many tasks as the rows need. Summaries of a
log with dense stretches are carried in groups in turn (:func:`_swept`), so they fill no task either.
"""
from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from roamlog.session import stage

DAY = 86_400
#: Widths of chunks in seconds, each cut into the next where it is dense.
WIDTHS = [28 * DAY, DAY, 3600, 60, 1]
CHUNK_ROWS = 1_000_000
#: Summary rows that one task carries a state over.
GROUP = 512
_CHUNK = "_chunk"
#: Mark on the chunk column of a log that may have more chunks than the calendar has four weeks.
_DENSE = {"dense": True}


def chunk_of(ts: Column, chunk_seconds: int = DAY) -> Column:
    return F.floor(ts / F.lit(chunk_seconds)).cast("bigint")


def _by(by: Iterable[str]) -> list[Column]:
    return [F.col(c) for c in by] or [F.lit(0)]


def with_chunk(df: DataFrame, by: list[str], ts: str = "ts", chunk_seconds: int | None = None) -> DataFrame:
    """Adds ``_chunk``, increasing with time in each log: the start of a stretch of time sized by its rows.

    Chunks are four weeks wide. One that would hold more than ``CHUNK_ROWS`` rows is cut into days,
    such a day into hours, and so on down to a second, so that a burst inside a quiet log is split
    like any other. Only dense stretches are listed (rows / ``CHUNK_ROWS`` at most on each level);
    the list is staged, so the join that needs it is planned with its size known, and the search
    ends at the first level without any.
    """
    if _CHUNK in df.columns:
        return df
    if chunk_seconds is not None:
        return df.withColumn(_CHUNK, chunk_of(F.col(ts), chunk_seconds).alias(_CHUNK, metadata=_DENSE))
    out = df.withColumn(_CHUNK, chunk_of(F.col(ts), WIDTHS[0]) * WIDTHS[0])
    times = df.select(*by, F.col(ts).alias("_t"))
    for width, finer in zip(WIDTHS, WIDTHS[1:]):
        cell = (chunk_of(F.col("_t"), width) * width).alias("_cell")
        dense = stage(times.groupBy(*by, cell).agg(F.count("*").alias("_n")).filter(F.col("_n") > CHUNK_ROWS).drop("_n"), "dense")
        if dense.isEmpty():
            break
        times = times.withColumn("_cell", cell).join(dense, [*by, "_cell"], "left_semi").drop("_cell")
        out = out.withColumn("_cell", chunk_of(F.col(ts), width) * width).join(
            dense.withColumn("_dense", F.lit(True)), [*by, "_cell"], "left").withColumn(
            _CHUNK, F.when(F.col("_dense"), chunk_of(F.col(ts), finer) * finer).otherwise(F.col(_CHUNK)).alias(
                _CHUNK, metadata=_DENSE)).drop("_cell", "_dense")
    return out


def _spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Shuffle on the full chunk key.

    A window accepts rows that are already clustered on part of its key, which would leave a
    heavy log in the one task an earlier join or a bucketed table put it in.
    """
    return df.repartition(*[F.col(k) for k in keys])


#: How a value is carried: over the rows before or after a row, or over all of them.
_BEFORE, _AFTER, _ALL = "before", "after", "all"
_AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max}
_COMBINE = {
    "sum": lambda above, here: F.when(above.isNull() | here.isNull(), F.coalesce(above, here)).otherwise(above + here),
    "min": F.least, "max": F.greatest, "last": lambda above, here: F.coalesce(here, above),
}
#: Leading sort keys: a column's name and whether it descends.
Order = list[tuple[str, bool]]


def _sorted(order: Order, backwards: bool = False) -> list[Column]:
    return [F.desc(c) if down != backwards else F.asc(c) for c, down in order]


def _swept(df: DataFrame, by: list[str], order: Order, carried: Mapping[str, tuple[str, str, str]], many: bool) -> DataFrame:
    """Adds for each ``{name: (aggregate, column, side)}`` the aggregate over the rows of the log on that side.

    ``df`` holds summary rows. Where a log may have many they are staged; if one has more than ``GROUP`` they are dealt
    to groups of about that many by ranges of (log, order) and swept inside the groups, and the groups' totals are swept
    the same way and added to it. The aggregate ``last``, for an ascending order, takes the row just before.
    """
    if many:
        df = stage(df, "summary")
        size = df.groupBy(*by).count().agg(F.max("count").alias("most"), F.sum("count").alias("n")).first()
        n, many = size.n, (size.most or 0) > GROUP
    if not many:
        return df.withColumns(_carried_over(by, order, carried))
    g = "_g" if "_g" not in df.columns else "_h"
    ranged = stage(df.repartitionByRange(-(-n // GROUP), *by, *_sorted(order)).withColumn(g, F.spark_partition_id()), "groups")
    totals = ranged.groupBy(*by, g).agg(*[
        (F.max_by(col, F.struct(*[c for c, _ in order])) if how == "last" else _AGGREGATES[how](col)).alias(f"_above_{name}")
        for name, (how, col, _) in carried.items()])
    above = _swept(totals, by, [(g, False)], {f"_up_{name}": (how, f"_above_{name}", side) for name, (how, _, side) in carried.items()}, True)
    joined = ranged.withColumns(_carried_over([*by, g], order, carried)).join(
        above.select(*by, g, *[f"_up_{name}" for name in carried]), [*by, g])
    return joined.withColumns({
        name: F.col(f"_up_{name}") if side == _ALL else _COMBINE[how](F.col(f"_up_{name}"), F.col(name))
        for name, (how, _, side) in carried.items()}).drop(g, *[f"_up_{name}" for name in carried])


def _carried_over(keys: list[str], order: Order, carried: Mapping[str, tuple[str, str, str]]) -> dict[str, Column]:
    whole = Window.partitionBy(*_by(keys))
    sides = {_BEFORE: whole.orderBy(*_sorted(order)), _AFTER: whole.orderBy(*_sorted(order, backwards=True))}
    out = {}
    for name, (how, col, side) in carried.items():
        if how == "last":
            out[name] = F.lag(col).over(sides[_BEFORE])
        else:
            over = whole if side == _ALL else sides[side].rowsBetween(Window.unboundedPreceding, -1)
            out[name] = _AGGREGATES[how](col).over(over)
    return out


def _is_dense(df: DataFrame) -> bool:
    return bool(df.schema[_CHUNK].metadata.get("dense"))


_BY_CHUNK: Order = [(_CHUNK, False)]


def scan_log(
    df: DataFrame,
    by: list[str],
    following: Mapping[str, Column] | None = None,
    preceding: Mapping[str, Column] | None = None,
    *,
    ts: str = "ts",
    tie: str = "checkin_id",
    real: Column | None = None,
    timed: Iterable[str] = (),
    chunk_seconds: int | None = None,
) -> DataFrame:
    """Number the rows of each log and point every row at its nearest marked neighbours.

    Adds ``idx`` (1-based, order ``ts, tie``) and ``log_rows``; for each mark in ``following`` /
    ``preceding`` the ordinal ``next_<m>`` / ``prev_<m>`` of the nearest later / earlier row where
    the mark holds (the row itself never counts), and its time ``..._ts`` for marks in ``timed``.
    Rows where ``real`` is false are probes: they are not numbered (their ``idx`` is that of the
    last real row before them) and their marks must be false.
    """
    following, preceding, timed = dict(following or {}), dict(preceding or {}), set(timed)
    keys = [*by, _CHUNK]
    flagged = with_chunk(df, by, ts, chunk_seconds)
    flagged = flagged.withColumns(
        {
            "_real": F.lit(1) if real is None else F.when(real, 1).otherwise(0),
            **{f"_m_{m}": F.coalesce(p, F.lit(False)) for m, p in {**following, **preceding}.items()},
        }
    )
    up, down = _orders(keys, ts, tie)
    numbered_ = _spread(flagged, keys).withColumn("_rn", F.sum("_real").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    local = numbered_.withColumns(_nearest(following, preceding, timed, "_rn", ts, up, down))

    marks = _extremes(following, preceding, timed, "_rn", ts)
    summary = (numbered_ if marks else flagged).groupBy(*keys).agg(F.sum("_real").alias("_rows"), *marks)
    dense = _is_dense(flagged)
    carried = _swept(summary, by, _BY_CHUNK, {"_off": ("sum", "_rows", _BEFORE), "log_rows": ("sum", "_rows", _ALL)}, dense)
    carried = carried.withColumn("_off", F.coalesce("_off", F.lit(0)))
    carried = _carries(carried, by, following, preceding, timed, F.col("_off"), dense)
    joined = local.join(carried.select(*keys, "_off", "log_rows", *_carry_names(following, preceding, timed)), keys)
    return joined.select(
        *[c for c in df.columns],
        (F.col("_off") + F.col("_rn")).alias("idx"), "log_rows",
        *_resolved(following, preceding, timed, F.col("_off")),
    )


def mark_neighbours(
    df: DataFrame,
    by: list[str],
    following: Mapping[str, Column] | None = None,
    preceding: Mapping[str, Column] | None = None,
    *,
    idx: str = "idx",
    ts: str = "ts",
    tie: str = "checkin_id",
    timed: Iterable[str] = (),
    chunk_seconds: int | None = None,
) -> DataFrame:
    """As :func:`scan_log` for rows that already carry an ordinal ``idx`` (which may have gaps)."""
    following, preceding, timed = dict(following or {}), dict(preceding or {}), set(timed)
    keys = [*by, _CHUNK]
    flagged = with_chunk(df, by, ts, chunk_seconds).withColumns(
        {f"_m_{m}": F.coalesce(p, F.lit(False)) for m, p in {**following, **preceding}.items()}
    )
    up, down = _orders(keys, idx)
    local = _spread(flagged, keys).withColumns(_nearest(following, preceding, timed, idx, ts, up, down))
    summary = flagged.groupBy(*keys).agg(*_extremes(following, preceding, timed, idx, ts))
    carried = _carries(summary, by, following, preceding, timed, F.lit(0), _is_dense(flagged))
    return local.join(carried.select(*keys, *_carry_names(following, preceding, timed)), keys).select(*df.columns, *_resolved(following, preceding, timed, F.lit(0)))


def _orders(keys: list[str], *order: str):
    return (
        Window.partitionBy(*_by(keys)).orderBy(*order),
        Window.partitionBy(*_by(keys)).orderBy(*[F.desc(c) for c in order]),
    )


def _values(m: str, timed: set[str], pos: str, ts: str) -> list[tuple[str, Column]]:
    hit = F.col(f"_m_{m}")
    out = [(m, F.when(hit, F.col(pos)))]
    return out + [(f"{m}_ts", F.when(hit, F.col(ts)))] if m in timed else out


def _nearest(following, preceding, timed, pos, ts, up, down) -> dict[str, Column]:
    """Nearest hits inside the chunk. Later rows are reached by reading the chunk backwards, so
    every frame grows and each row is added once."""
    ahead, behind = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (down, up))
    out = {f"_p_{n}": F.max(v).over(behind) for m in preceding for n, v in _values(m, timed, pos, ts)}
    out |= {f"_n_{n}": F.min(v).over(ahead) for m in following for n, v in _values(m, timed, pos, ts)}
    return out


def _extremes(following, preceding, timed, pos, ts) -> list[Column]:
    return [
        *[F.min(v).alias(f"_f_{n}") for m in following for n, v in _values(m, timed, pos, ts)],
        *[F.max(v).alias(f"_l_{n}") for m in preceding for n, v in _values(m, timed, pos, ts)],
    ]


def _sides(following, preceding):
    return ((following, "f", "min", _AFTER), (preceding, "l", "max", _BEFORE))


def _carry_names(following, preceding, timed) -> list[str]:
    return [f"_c{side}_{n}" for marks, side, _, _ in _sides(following, preceding) for m in marks
            for n in ([m, f"{m}_ts"] if m in timed else [m])]


def _carries(summary: DataFrame, by, following, preceding, timed, off: Column, many: bool) -> DataFrame:
    """Nearest hits in later and earlier chunks, from the chunks' own first and last ones."""
    absolute, carried = {}, {}
    for marks, side, best, where in _sides(following, preceding):
        for m in marks:
            absolute[f"_{side}_{m}"] = off + F.col(f"_{side}_{m}")
            for n in [m, f"{m}_ts"] if m in timed else [m]:
                carried[f"_c{side}_{n}"] = (best, f"_{side}_{n}", where)
    return _swept(summary.withColumns(absolute), by, _BY_CHUNK, carried, many) if carried else summary


def _resolved(following, preceding, timed, off) -> list[Column]:
    out = []
    for marks, side, name, got in ((following, "f", "next", "n"), (preceding, "l", "prev", "p")):
        for m in marks:
            out.append(F.coalesce(off + F.col(f"_{got}_{m}"), F.col(f"_c{side}_{m}")).alias(f"{name}_{m}"))
            if m in timed:
                out.append(F.coalesce(f"_{got}_{m}_ts", f"_c{side}_{m}_ts").alias(f"{name}_{m}_ts"))
    return out


def order_rows(df: DataFrame, by: list[str], chunk_seconds: int | None = None) -> DataFrame:
    """Drop undated rows and number the rest per log (``idx``, 1-based)."""
    return scan_log(df.filter(F.col("ts").isNotNull()), by, chunk_seconds=chunk_seconds).drop("log_rows")


def with_previous(
    df: DataFrame,
    by: list[str],
    cols: list[str],
    *,
    ts: str = "ts",
    tie: str = "checkin_id",
    chunk_seconds: int | None = None,
    prefix: str = "prev_",
) -> DataFrame:
    """Values of ``cols`` on the row before, in order ``ts, tie`` (NULL on the first row)."""
    keys = [*by, _CHUNK]
    cut = with_chunk(df, by, ts, chunk_seconds)
    w = Window.partitionBy(*_by(keys)).orderBy(ts, tie)
    local = _spread(cut, keys).withColumns({"_first": F.row_number().over(w) == 1, "_lag": F.lag(F.struct(*cols)).over(w)})
    summary = cut.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(ts, tie)).alias("_last"))
    carry = _swept(summary, by, _BY_CHUNK, {"_carry": ("last", "_last", _BEFORE)}, _is_dense(cut))
    before = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag"))
    return (
        local.join(carry.select(*keys, "_carry"), keys)
        .withColumn("_before", before)
        .select(*df.columns, *[F.col(f"_before.{c}").alias(f"{prefix}{c}") for c in cols])
    )


def numbered(
    df: DataFrame, by: list[str], chunk: list[Column], within: list[Column], name: str = "rank", many: bool = False
) -> DataFrame:
    """1-based position per ``by`` in the order ``chunk`` then ``within``.

    ``chunk`` are coarse leading sort keys; a position is the offset of its chunk plus the
    position inside it, so no task holds a whole list. ``many`` carries the offsets in groups, for
    a key with too many values for one task.
    """
    names = [f"_k{i}" for i in range(len(chunk))]
    directions = [_is_descending(c) for c in chunk]
    keyed = df.withColumns(dict(zip(names, [_bare(c) for c in chunk], strict=True)))
    keys = [*by, *names]
    local = _spread(keyed, keys).withColumn("_rn", F.row_number().over(Window.partitionBy(*_by(keys)).orderBy(*within)))
    counts = keyed.groupBy(*keys).agg(F.count("*").alias("_n"))
    offsets = _swept(counts, by, list(zip(names, directions, strict=True)), {"_off": ("sum", "_n", _BEFORE)}, many).withColumn(
        "_off", F.coalesce("_off", F.lit(0))).drop("_n")
    cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return (
        local.alias("l")
        .join(offsets.alias("r"), cond)
        .select(*[F.col(f"l.{c}") for c in df.columns], (F.col("r._off") + F.col("l._rn")).alias(name))
    )


#: Steps that one task composes at once.
LINKS = 512


def carried_states(steps: DataFrame, by: list[str]) -> DataFrame:
    """Carry a state through a list of functions: adds ``before``, the state in front of each step.

    ``steps`` has ``by``, ``pos`` (1, 2, ... per log) and ``step``, an array that maps a state (an index from 0) to the
    next one; an array of one value gives it whatever the state is. Each log begins in state 0. Steps are composed in
    groups of ``LINKS``, the groups' functions are carried the same way, and each group is then walked from its state, so
    a list of n takes as many rounds as n has digits to the base ``LINKS``.
    """
    def follow(state: Column, step: Column) -> Column:
        return F.when(F.size(step) == 1, step[0]).otherwise(F.get(step, state)).cast("int")

    extra = [c for c in steps.columns if c not in (*by, "pos", "step")]
    listed = F.struct("pos", F.col("step").cast("array<int>").alias("step"), *extra)
    group = F.floor((F.col("pos") - 1) / LINKS).alias("_g")
    packed = stage(steps.groupBy(*by, group).agg(F.array_sort(F.collect_list(listed)).alias("_l")), "links")
    if packed.filter("_g > 0").isEmpty():
        entered = packed.withColumn("_in", F.lit(0))
    else:
        rest = F.slice("_l", F.lit(2), F.greatest(F.size("_l") - 1, F.lit(0)))
        whole = F.transform(F.col("_l")[0]["step"], lambda first: F.aggregate(rest, first, lambda state, x: follow(state, x["step"])))
        above = carried_states(packed.select(*by, (F.col("_g") + 1).alias("pos"), whole.alias("step")), by)
        entered = packed.join(above.select(*by, (F.col("pos") - 1).alias("_g"), F.col("before").alias("_in")), [*by, "_g"])
    start = F.array(F.col("_in").cast("int"))
    states = F.aggregate("_l", start, lambda seen, x: F.concat(seen, F.array(follow(F.element_at(seen, -1), x["step"]))))
    walked = entered.select(*by, "_l", F.posexplode(F.slice(states, F.lit(1), F.size("_l"))).alias("_i", "before"))
    return walked.select(*by, F.get("_l", F.col("_i")).alias("_x"), "before").select(*by, "_x.*", "before")


class Desc:
    """Marks a leading sort key of :func:`numbered` as descending."""

    def __init__(self, column: Column) -> None:
        self.column = column


def _is_descending(c: Column | Desc) -> bool:
    return isinstance(c, Desc)


def _bare(c: Column | Desc) -> Column:
    return c.column if isinstance(c, Desc) else c
