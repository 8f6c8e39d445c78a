"""Operators on the order of rows within a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlake.functions.geo import great_circle
from flightlake.functions.values import turns
from flightlake.scale import (
    Ordered,
    exact_median,
    following,
    join_per_key,
    known_before,
    last_known,
    previous,
    row_index,
    running_sum,
    total,
)

SERIES = ("log_id", "message", "field")
TIME_ORDER = ("ts_us", "seq")
GAP_FACTOR = 3
SHORTEST_RUN = 4


def fill_time(records: DataFrame) -> DataFrame:
    """Rows without a clock take the last one seen in file order, 0 before any."""
    filled = Ordered(records, ["log_id"], ["seq"]).scan(_clock=last_known(F.col("ts_us")))
    return (
        filled.rows()
        .withColumn("has_time", F.col("ts_us").isNotNull())
        .withColumn("ts_us", F.coalesce("_clock", F.lit(0).cast("long")))
        .drop("_clock")
    )


def mode_changes(labelled: DataFrame) -> DataFrame:
    """``(log_id, seq, ts_us, mode)`` rows where the label differs from the one before."""
    seen = Ordered(labelled, ["log_id"], ["seq"]).scan(_prev=previous("mode"))
    return seen.where(F.col("_prev").isNull() | ~F.col("_prev.mode").eqNullSafe(F.col("mode"))).rows().drop("_prev")


def unwrap_angle(samples: DataFrame, keys: Sequence[str] = SERIES, period: float = 360.0) -> DataFrame:
    """Undo the wrap of an angle; gaps stay gaps and do not reset the offset."""
    value = F.col("value")
    stepped = Ordered(samples, keys, TIME_ORDER).scan(_prev=known_before(value))
    moved = F.coalesce(-turns(value - F.col("_prev"), period), F.lit(0.0))
    return (
        stepped.with_columns(_moved=moved)
        .scan(_offset=running_sum(F.col("_moved")))
        .rows()
        .withColumn("value", value + F.col("_offset"))
        .drop("_prev", "_moved", "_offset")
    )


def steps(samples: DataFrame, keys: Sequence[str] = SERIES, split: bool | None = None) -> Ordered:
    """Ordered rows with ``step``, the spacing to the row before (NULL on the first)."""
    seen = Ordered(samples, keys, TIME_ORDER, split=split).scan(_prev=previous("ts_us"))
    return seen.with_columns(step=F.col("ts_us") - F.col("_prev.ts_us"))


def median_step(samples: DataFrame, keys: Sequence[str] = SERIES, split: bool | None = None) -> DataFrame:
    """Exact median spacing per series; none with fewer than two rows."""
    ordered = steps(samples, keys, split)
    return exact_median(ordered.rows(), keys, "step", "median_step", split=ordered.split)


def _best_run(samples: DataFrame, keys: list[str], gap_factor: float) -> tuple[Ordered, DataFrame]:
    """Rows of the longest gap-free run of each series, and its grid."""
    ordered = steps(samples, keys)
    spacing = exact_median(ordered.rows(), keys, "step", "median_step", split=ordered.split)
    marked = (
        ordered.attach(spacing)
        .with_columns(_cut=F.when(F.col("step") > F.col("median_step") * gap_factor, 1).otherwise(0))
        .scan(run=running_sum(F.col("_cut")), _next=following("ts_us", "value", "_cut"))
        .frozen("runs")
    )
    runs = marked.rows().groupBy(*keys, "run").agg(
        F.count(F.lit(1)).alias("n_run"),
        F.min("ts_us").alias("t0"),
        F.max("ts_us").alias("t1"),
        F.first("median_step").alias("step"),
    )
    # Runs of one series are folded with max_by, so no series' runs are gathered.
    best = runs.groupBy(*keys).agg(
        F.max_by(F.struct("run", "n_run", "t0", "t1", "step"), F.struct("n_run", -F.col("run"))).alias("b"),
        F.sum("n_run").alias("_all"),
    )
    grid = (
        best.select(*keys, "b.*", "_all")
        .where((F.col("_all") >= SHORTEST_RUN) & (F.col("step") > 0) & (F.col("n_run") >= SHORTEST_RUN))
        .withColumn("n_grid", (F.floor((F.col("t1") - F.col("t0")) / F.col("step")) + 1).cast("long"))
        .where(F.col("n_grid") >= SHORTEST_RUN)
        .withColumn("dropped", F.col("_all") - F.col("n_run"))
        .drop("_all")
    )
    chosen = marked.attach(grid.select(*keys, F.col("run").alias("_best"))).where(F.col("run") == F.col("_best"))
    return chosen, grid


def longest_run(samples: DataFrame, keys: Sequence[str] = SERIES, gap_factor: float = GAP_FACTOR):
    """Rows of the longest gap-free run of each series, and its grid.

    Returns ``(rows, grid)``; ``grid`` has one row per series: ``t0, t1, step,
    n_grid, n_run, dropped``.  A series too short for either is absent from both.
    """
    keys = list(keys)
    chosen, grid = _best_run(samples, keys, gap_factor)
    return chosen.rows().select(*keys, "ts_us", "seq", "value"), grid


def uniform_grid(samples: DataFrame, keys: Sequence[str] = SERIES, gap_factor: float = GAP_FACTOR):
    """The longest gap-free run of each series on an even grid.

    Returns ``(points, grid)``: ``points`` has ``i, ts_us, value`` per series, a
    NULL value beside a gap.
    """
    keys = list(keys)
    chosen, grid = _best_run(samples, keys, gap_factor)
    rows = chosen.attach(grid.select(*keys, "t0", F.col("step").alias("_step"), "n_grid")).rows()
    # A row answers for the grid points from its stamp up to the next row's, of which no
    # more than ``gap_factor`` steps lie in a run: points are made where both rows are at hand.
    here, there = F.col("ts_us"), F.when(F.col("_next._cut") == 0, F.col("_next.ts_us"))
    lowest = F.floor((here - F.col("t0")) / F.col("_step")) - 1
    highest = F.floor((F.coalesce(there, here) - F.col("t0")) / F.col("_step")) + 1
    ends = F.greatest(lowest, F.lit(0).cast("long")), F.least(highest, F.col("n_grid") - 1)
    made = rows.where(ends[0] <= ends[1]).select(
        *keys, here.cast("double").alias("_a"), there.cast("double").alias("_b"), "value", F.col("_next.value").alias("_to"),
        ((F.col("_cut") == 1) | F.col("step").isNull()).alias("_first"), "t0", "_step", F.explode(F.sequence(*ends)).alias("i"),
    ).withColumn("_t", (F.col("t0") + F.col("i") * F.col("_step")).cast("double"))
    t, a, b = F.col("_t"), F.col("_a"), F.col("_b")
    # The run's first row answers at its own stamp, also where others share it.
    mine = F.when(F.col("i") == 0, F.col("_first")).otherwise((t >= a) & F.when(b.isNull(), t == a).otherwise(t < b))
    value = F.when(t == a, F.col("value")).otherwise(F.col("value") + (t - a) / (b - a) * (F.col("_to") - F.col("value")))
    points = made.where(mine).select(*keys, t.alias("ts_us"), "i", value.alias("value"))
    return points, grid


def detrend(points: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Subtract mean and least-squares line over ``i``; gaps are left out and kept."""
    keys = list(keys)
    fit = points.groupBy(*keys).agg(
        F.regr_slope("value", "i").alias("_slope"),
        F.avg("value").alias("_my"),
        F.avg(F.when(F.col("value").isNotNull(), F.col("i"))).alias("_mx"),
    )
    line = F.col("_my") + F.coalesce("_slope", F.lit(0.0)) * (F.col("i") - F.col("_mx"))
    return (
        join_per_key(points, fit, keys, "i")
        .withColumn("value", F.col("value") - line)
        .drop("_slope", "_my", "_mx")
    )


def crossing_index(value: Column, before: Column, level: Column, start: Column, rising: Column) -> Column:
    """Aggregate: fractional ``i`` where ``value`` first reaches ``level`` from ``start`` on.

    Interpolated with the sample before, unless that one is a gap, equal, or
    ahead of ``start``.
    """
    i = F.col("i")
    reached = (i >= start) & F.when(rising, value >= level).otherwise(value <= level)
    inside = (i > start) & before.isNotNull() & (value != before)
    at = F.when(inside, i - 1 + (level - before) / (value - before)).otherwise(i.cast("double"))
    return F.min_by(at, F.when(reached, i))


def first_crossing(
    points: DataFrame, keys: Sequence[str], value: str, level: Column, start: Column, rising: Column
) -> DataFrame:
    """Per key, where ``value`` over ``i`` first reaches ``level`` (NULL when never)."""
    rows = Ordered(points, keys, ["i"]).scan(_prev=previous(value)).rows()
    crossing = crossing_index(F.col(value), F.col(f"_prev.{value}"), level, start, rising)
    return rows.groupBy(*keys).agg(crossing.alias("crossing"))


def legs(path: DataFrame, keys: Sequence[str] = ("log_id",), order: Sequence[str] = TIME_ORDER) -> DataFrame:
    """Great-circle length of each leg, running distance and total per path."""
    walked = Ordered(path, keys, order).scan(_prev=previous("lat", "lon"))
    length = F.when(
        F.col("_prev").isNotNull(),
        great_circle(F.col("_prev.lat"), F.col("_prev.lon"), F.col("lat"), F.col("lon")),
    ).otherwise(F.lit(0.0))
    return (
        walked.with_columns(leg_m=length)
        .scan(along_m=running_sum(F.col("leg_m")), total_m=total(F.col("leg_m")))
        .rows()
        .drop("_prev")
    )


def thin(points: DataFrame, keys: Sequence[str], order: Sequence[str] = TIME_ORDER, target: int = 6000) -> DataFrame:
    """Every ``floor(n / target)``-th row of a dense cloud; under 2 x target all rows."""
    counted = Ordered(points, keys, order).scan(_i=row_index(), _n=total(F.lit(1), "count"))
    stride = F.greatest(F.lit(1), F.floor(F.col("_n") / target))
    return counted.where(F.col("_i") % stride == 0).rows().drop("_i", "_n")
