"""Commanded against achieved: shared grid, error, lag, step response."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightlake import scale
from flightlake.functions.values import align_angle, round_half_up
from flightlake.operators.sequence import crossing_index, median_step
from flightlake.operators.timejoin import between, around
from flightlake.scale import (
    Ordered,
    exact_median,
    explode_range,
    group_sizes,
    join_per_key,
    known_small,
    previous,
    scratch_table,
)

SERIES = ("log_id",)

# What a lag search and a step must have.
FEWEST_ROWS, FEWEST_POINTS, FEWEST_PAIRS = 4, 8, 3
LAG_LIMIT_SEC, LAG_WORK, LAG_LEAST, LAG_MOST = 10.0, 4e6, 8, 400
STEP_POINTS, STEP_SIDE, STEP_NOISE, STEP_SHARE, MAD_TO_SIGMA = 12, 5, 5.0, 0.3, 1.4826
RISE_FROM, RISE_TO, SETTLED, TAIL_SHARE, TAIL_LEAST = 0.1, 0.9, 0.05, 0.1, 3

#: Grid points per block of the lag search; a block also reads ``reach`` points
#: on either side, so no task ever needs the whole series.
LAG_BLOCK = 8192


def grid_pair(
    desired: DataFrame, actual: DataFrame, keys: Sequence[str] = SERIES, wrap: Column | float = 0.0
) -> DataFrame:
    """Both series on one even grid over their overlap: ``i, ts_us, des, act, n, dt``.

    The step is the coarser of the two median steps.  Rows are the windowed
    series ``keys, ts_us, seq, value``; a key too short on either side gives
    none.  Where ``wrap`` is not 0 the response is put on the demand's branch.
    Written to scratch: the metrics read it several times.
    """
    keys = list(keys)
    sided = [*keys, "side"]
    both = desired.select(*keys, F.lit("des").alias("side"), "ts_us", "seq", "value").unionByName(
        actual.select(*keys, F.lit("act").alias("side"), "ts_us", "seq", "value")
    )
    largest = 0 if known_small() else group_sizes(both, sided)[0]
    ends = both.groupBy(*sided).agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1")
    )
    plan = scratch_table(
        ends.join(median_step(both, sided, largest > scale.GROUP_ROWS), sided)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("sides"),
            F.min("rows").alias("rows"),
            F.max("t0").alias("t0"),
            F.min("t1").alias("t1"),
            F.max("median_step").alias("step"),
        )
        .where(
            (F.col("sides") == 2)
            & (F.col("rows") >= FEWEST_ROWS)
            & (F.col("t1") > F.col("t0"))
            & (F.col("step") > 0)
        )
        .withColumn("n", (F.floor((F.col("t1") - F.col("t0")) / F.col("step")) + 1).cast("long"))
        .where(F.col("n") >= FEWEST_POINTS)
        .select(*keys, "t0", "step", "n"),
        "grid-plan",
    )
    # Long gaps can give far more grid points than rows.
    longest = plan.agg(F.max("n")).first()[0] or 0
    split = largest + longest > scale.GROUP_ROWS
    stamps = explode_range(plan, F.col("n"), "i").select(
        *keys,
        F.explode(F.array(F.lit("des"), F.lit("act"))).alias("side"),
        (F.col("t0") + F.col("i") * F.col("step")).cast("double").alias("ts_us"),
        F.col("i").alias("seq"),
        "n",
        (F.col("step") / F.lit(1e6)).alias("dt"),
    )
    valued = around(both, stamps, sided, split=split).select(*keys, "side", "seq", "ts_us", "n", "dt", between().alias("value"))
    wide = valued.groupBy(*keys, F.col("seq").alias("i")).agg(
        F.first("ts_us").alias("ts_us"),
        F.max(F.when(F.col("side") == "des", F.col("value"))).alias("des"),
        F.max(F.when(F.col("side") == "act", F.col("value"))).alias("act"),
        F.first("n").alias("n"),
        F.first("dt").alias("dt"),
    )
    if isinstance(wrap, (int, float)):
        if wrap:
            wide = wide.withColumn("act", align_angle(F.col("des"), F.col("act"), wrap))
    else:
        wide = wide.withColumn(
            "act", F.when(wrap > 0, align_angle(F.col("des"), F.col("act"), wrap)).otherwise(F.col("act"))
        )
    return scratch_table(wide, "grid")


def tracking_errors(grid: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Unshifted error: pairs, bias and RMS of achieved minus commanded."""
    error = F.col("act") - F.col("des")
    return (
        grid.groupBy(*keys)
        .agg(
            F.first("n").alias("n"),
            F.first("dt").alias("dt"),
            F.count(error).alias("pairs"),
            F.avg(error).alias("bias"),
            F.sqrt(F.avg(error * error)).alias("rms_error"),
        )
        .where((F.col("n") >= FEWEST_POINTS) & (F.col("pairs") >= FEWEST_PAIRS) & (F.col("dt") > 0))
    )


def lag_reach(n: Column, dt: Column, max_lag_sec: float | None = None) -> Column:
    """Shifts to try each way: bounded by seconds, a quarter of the window, and work."""
    quarter = n * dt / 4
    want = F.least(F.lit(LAG_LIMIT_SEC if max_lag_sec is None else float(max_lag_sec)), quarter)
    budget = F.greatest(F.lit(LAG_LEAST), F.least(F.lit(LAG_MOST), F.floor(F.lit(LAG_WORK) / n)))
    return F.greatest(F.lit(1), F.least(budget, round_half_up(want / dt))).cast("int")


_SUMS = ("m", "sx", "sy", "sxx", "syy", "sxy")
_SUMS_TYPE = T.StructType(
    [T.StructField("k", T.ArrayType(T.IntegerType()))]
    + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in _SUMS]
)


@F.pandas_udf(_SUMS_TYPE)
def _shifted_sums(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """Sums over a block of pairs ``des[i], act[i+k]`` for every shift ``k``."""
    for at, des_at, des, act_at, act, reach in parts:
        out: dict[str, list] = {c: [] for c in ("k", *_SUMS)}
        for start, di, dv, ai, av, r in zip(at, des_at, des, act_at, act, reach):
            x = np.full(LAG_BLOCK, np.nan)
            y = np.full(LAG_BLOCK + 2 * r, np.nan)
            x[np.asarray(di, dtype=np.int64) - start] = np.asarray(dv, dtype=float)
            y[np.asarray(ai, dtype=np.int64) - start + r] = np.asarray(av, dtype=float)
            has_x, has_y = np.isfinite(x).astype(float), np.isfinite(y).astype(float)
            x, y = np.nan_to_num(x), np.nan_to_num(y)
            slide = lambda a, b: np.correlate(a, b, "valid")
            out["k"].append(np.arange(-r, r + 1, dtype=np.int32))
            out["m"].append(slide(has_y, has_x))
            out["sx"].append(slide(has_y, x))
            out["sy"].append(slide(y, has_x))
            out["sxx"].append(slide(has_y, x * x))
            out["syy"].append(slide(y * y, has_x))
            out["sxy"].append(slide(y, x))
        yield pd.DataFrame(out)


def lag_profile(grid: DataFrame, keys: Sequence[str] = SERIES, max_lag_sec: float | None = None) -> DataFrame:
    """Correlation and slope of ``des[i]`` against ``act[i+k]`` for every shift ``k``.

    The grid is cut into blocks of ``LAG_BLOCK`` demands; a response point goes
    to every block whose demands can reach it.  Shuffled rows are about
    n * (1 + 2 * reach / block), not n times the number of shifts, and only one
    row of sums per block and shift leaves the block.
    """
    keys = list(keys)
    centre = grid.groupBy(*keys).agg(F.avg("des").alias("_md"), F.avg("act").alias("_ma"))
    placed = join_per_key(grid, centre, keys, "i").withColumn("reach", lag_reach(F.col("n"), F.col("dt"), max_lag_sec))
    first = F.floor((F.col("i") - F.col("reach")) / LAG_BLOCK)
    last = F.floor((F.col("i") + F.col("reach")) / LAG_BLOCK)
    own = F.floor(F.col("i") / LAG_BLOCK)
    ends = F.floor((F.col("n") - 1) / LAG_BLOCK)
    blocks = (
        placed.select(
            *keys, "i", "reach",
            (F.col("des") - F.col("_md")).alias("des"),
            (F.col("act") - F.col("_ma")).alias("act"),
            own.alias("own"),
            F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), F.least(last, ends))).alias("block"),
        )
        .groupBy(*keys, "block")
        .agg(
            F.collect_list(F.when((F.col("own") == F.col("block")) & F.col("des").isNotNull(), F.struct("i", "des"))).alias("d"),
            F.collect_list(F.when(F.col("act").isNotNull(), F.struct("i", "act"))).alias("a"),
            F.first("reach").alias("reach"),
        )
    )
    sums = blocks.select(
        *keys,
        _shifted_sums(F.col("block") * LAG_BLOCK, F.col("d.i"), F.col("d.des"), F.col("a.i"), F.col("a.act"), F.col("reach")).alias("s"),
    ).select(*keys, F.inline(F.arrays_zip(*[F.col(f"s.{c}").alias(c) for c in ("k", *_SUMS)])))
    folded = sums.groupBy(*keys, "k").agg(*[F.sum(c).alias(c) for c in _SUMS])
    c = F.col
    vx = c("sxx") - c("sx") * c("sx") / c("m")
    vy = c("syy") - c("sy") * c("sy") / c("m")
    vxy = c("sxy") - c("sx") * c("sy") / c("m")
    return (
        folded.where(c("m") >= FEWEST_PAIRS)
        .select(*keys, "k", c("m").cast("long").alias("pairs"), vx.alias("vx"), vy.alias("vy"), vxy.alias("vxy"),
                # Rounding left by the running sums is not spread.
                (c("sxx") * 1e-13).alias("ex"), (c("syy") * 1e-13).alias("ey"))
        .where(c("vx") > c("ex"))
        .select(
            *keys, "k", "pairs",
            F.when(c("vy") > c("ey"), c("vxy") / F.sqrt(c("vx") * c("vy"))).alias("r"),
            (c("vxy") / c("vx")).alias("slope"),
        )
    )


def tracking_metrics(grid: DataFrame, keys: Sequence[str] = SERIES, max_lag_sec: float | None = None) -> DataFrame:
    """Error, gain and lag per key; no row where the window cannot be shifted."""
    keys = list(keys)
    errors = tracking_errors(grid, keys).withColumn("reach", lag_reach(F.col("n"), F.col("dt"), max_lag_sec))
    profile = scratch_table(lag_profile(grid, keys, max_lag_sec), "lags").where("r IS NOT NULL")
    best = profile.groupBy(*keys).agg(F.max_by(F.struct("k", "r", "slope"), F.struct("r", -F.col("k"))).alias("b")).select(*keys, "b.*")
    beside = (
        profile.join(best.select(*keys, F.col("k").alias("_k")), keys)
        .where(F.abs(F.col("k") - F.col("_k")) == 1)
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("k") < F.col("_k"), F.col("r"))).alias("r_before"),
            F.max(F.when(F.col("k") > F.col("_k"), F.col("r"))).alias("r_after"),
        )
    )
    bend = F.col("r_before") - 2 * F.col("r") + F.col("r_after")
    shift = F.try_divide(0.5 * (F.col("r_before") - F.col("r_after")), bend)
    refined = F.col("k") + F.when(F.abs(shift) <= 1, shift).otherwise(0.0)
    return (
        errors.join(best, keys)
        .join(beside, keys, "left")
        .select(
            *keys, "n", "pairs", "bias", "rms_error",
            F.col("slope").alias("gain"),
            "r",
            (refined * F.col("dt")).alias("lag_sec"),
            (F.col("reach") * F.col("dt")).alias("max_lag_sec"),
            "dt",
            (F.abs(F.col("k")) >= F.col("reach")).alias("at_bound"),
        )
    )


def step_gate(rows: Ordered) -> DataFrame:
    """The commanded step of each key that holds one: ``before`` (its index), ``n``, ``dt``.

    ``rows`` is the grid ordered by ``i`` with ``_prev`` scanned.
    """
    keys = rows.keys
    jumps = rows.with_columns(jump=F.abs(F.col("des") - F.col("_prev.des"))).rows()
    noise = exact_median(jumps, keys, "jump", "noise", split=rows.split)
    gate = jumps.groupBy(*keys).agg(
        F.max("jump").alias("jump"),
        F.max_by(F.col("i"), F.when(F.col("jump") > 0, F.struct("jump", -F.col("i")))).alias("before"),
        F.count("des").alias("known"),
        (F.max("des") - F.min("des")).alias("range"),
        F.first("n").alias("n"),
        F.first("dt").alias("dt"),
    )
    sigma = MAD_TO_SIGMA * F.col("noise")
    return (
        gate.join(noise, keys)
        .where(
            (F.col("n") >= STEP_POINTS) & (F.col("known") >= STEP_POINTS) & (F.col("dt") > 0)
            & F.col("before").isNotNull()
            & ((sigma <= 0) | (F.col("jump") >= STEP_NOISE * sigma))
            & (F.col("range") > 0)
            & (F.col("jump") >= STEP_SHARE * F.col("range"))
            & (F.col("before") >= STEP_SIDE)
            & (F.col("n") - F.col("before") >= STEP_SIDE)
        )
        .select(*keys, "before", "n", "dt")
    )


def step_metrics(grid: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Step response per key; no row where the window holds no step."""
    keys = list(keys)
    rows = Ordered(grid.select(*keys, "i", "des", "act", "n", "dt"), keys, ["i"])
    rows = rows.scan(_prev=previous("des", "act")).frozen("steps")
    gate = scratch_table(step_gate(rows), "gate")
    early = F.col("i") < F.col("before")
    part = F.when(early, "before").otherwise("after")
    levels = rows.attach(gate.select(*keys, "before")).rows().select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.concat(F.lit("des_"), part).alias("level"), F.col("des").alias("v")),
                F.struct(F.concat(F.lit("act_"), part).alias("level"), F.col("act").alias("v")),
            )
        ),
    ).where("level <> 'act_after'")
    at = lambda name: F.max(F.when(F.col("level") == name, F.col("median")))
    settled = (
        exact_median(levels, [*keys, "level"], "v", split=rows.split)
        .groupBy(*keys)
        .agg((at("des_after") - at("des_before")).alias("amplitude"), at("act_before").alias("baseline"))
        .where("amplitude <> 0 AND baseline IS NOT NULL")
    )
    judged = rows.with_columns(_n=F.col("n"), _dt=F.col("dt"))
    judged = judged._same(judged.df.drop("n", "dt")).attach(gate.join(settled, keys)).rows()
    i, act, before = F.col("i"), F.col("act"), F.col("before")
    rising = F.col("amplitude") > 0
    level = lambda share: F.col("baseline") + share * F.col("amplitude")
    norm = F.when(i >= before, (act - F.col("baseline")) / F.col("amplitude"))
    after = F.col("n") - before
    tail_from = F.greatest(
        before, F.col("n") - F.greatest(F.lit(TAIL_LEAST), round_half_up(after * TAIL_SHARE))
    )
    response = judged.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("before", "n", "dt", "amplitude", "baseline")],
        crossing_index(act, F.col("_prev.act"), level(RISE_FROM), before, rising).alias("t10"),
        crossing_index(act, F.col("_prev.act"), level(RISE_TO), before, rising).alias("t90"),
        F.max(norm).alias("peak"),
        F.max(F.when(F.abs(norm - 1) > SETTLED, i)).alias("outside"),
        F.avg(F.when(i >= tail_from, act)).alias("tail"),
    )
    dt, start = F.col("dt"), F.col("before") * F.col("dt")
    return response.select(
        *keys,
        start.alias("step_time_sec"),
        "amplitude",
        (F.col("t10") * dt - start).alias("delay_sec"),
        ((F.col("t90") - F.col("t10")) * dt).alias("rise_time_sec"),
        F.when(F.col("peak").isNotNull(), F.greatest(F.lit(0.0), (F.col("peak") - 1) * 100)).alias("overshoot_pct"),
        F.when(F.col("outside").isNull(), 0.0)
        .when(F.col("outside") + 1 < F.col("n"), (F.col("outside") + 1) * dt - start)
        .alias("settling_time_sec"),
        (F.col("tail") - (F.col("baseline") + F.col("amplitude"))).alias("steady_state_error"),
    )
