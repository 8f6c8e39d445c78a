"""The questions an operator asks of a log, each answered for every log at once.

``samples`` is the long table (log_id, message, field, seq, ts_us, value);
``catalog`` its one-row-per-field summary, which decides what a log can answer;
``intervals`` (log_id, t0, t1) limits each log, None meaning the whole of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlake.operators import channels, circle, spectrum, stats, tables, timejoin, tracking
from flightlake.operators.mission import log_mission
from flightlake.operators.select import fields, interval_window, is_one_of, keep_messages
from flightlake.operators.sequence import detrend, uniform_grid, unwrap_angle
from flightlake.operators.trajectory import trajectory
from flightlake.plans import rules
from flightlake.scale import Groups, groups_hold_at_most, join_per_key, scratch_path, scratch_table

SERIES = ("log_id", "message", "field")

# When a reading is flagged.
WEAK_CORRELATION = 0.5
HIGH_OVERSHOOT = 25.0
NARROW_ARC = 270.0


def _windowed(rows: DataFrame, intervals: DataFrame | None) -> DataFrame:
    return rows if intervals is None else interval_window(rows, intervals)


#: Rows that one row of a log can become on the way: an even grid has at most so many.
SPREAD = 4


def _largest(catalog: DataFrame | None, messages: Sequence[str] | Column | None = None) -> int | None:
    """Rows any log can bring to a report, as its catalog tells; None if there is none."""
    if catalog is None:
        return None
    if messages is not None:
        catalog = catalog.where(messages if isinstance(messages, Column) else F.col("message").isin(*messages))
    rows = catalog.groupBy("log_id").agg(F.sum("n_rows").alias("n")).agg(F.max("n")).first()[0]
    return SPREAD * int(rows or 0)


def _names_in(table: DataFrame, *columns: str) -> list[str]:
    """The different message names of a rule table: as many as there are message types."""
    names = table.select(F.explode(F.array(*columns)).alias("name")).where("name IS NOT NULL").distinct()
    return sorted(r["name"] for r in names.collect())


def window_stats(
    samples: DataFrame,
    selected: Sequence[tuple[str, str]],
    extra: Sequence[tuple[str, str]] = (),
    intervals: DataFrame | None = None,
    catalog: DataFrame | None = None,
) -> DataFrame:
    """Statistics of the chosen fields; a field without samples keeps its row.

    With ``catalog`` only the chosen messages are read, and the logs come from it.
    """
    refs = list(dict.fromkeys([*selected, *extra]))
    listed = F.array(
        *[
            F.struct(F.lit(at).alias("pos"), F.lit(m).alias("message"), F.lit(f).alias("field"))
            for at, (m, f) in enumerate(refs)
        ]
    )
    measured = stats.column_stats(_windowed(fields(samples, refs), intervals))
    asked = (samples if catalog is None else catalog).select("log_id").distinct().select("log_id", F.inline(listed))
    return asked.join(measured, list(SERIES), "left").withColumn("n", F.coalesce("n", F.lit(0)))


def compass_report(
    samples: DataFrame, catalog: DataFrame, intervals: DataFrame | None = None
) -> DataFrame:
    """Circle fit, arc, field magnitude and load dependence of every compass."""
    names = sorted({n for triple in rules.COMPASS_AXES for n in triple})
    read = F.col("field").isin(*names) | is_one_of([d[:2] for d in rules.DRIVERS])
    with groups_hold_at_most(_largest(catalog, read)):
        return _compass_report(samples, catalog, intervals, names)


def _compass_report(
    samples: DataFrame, catalog: DataFrame, intervals: DataFrame | None, names: Sequence[str]
) -> DataFrame:
    sources = scratch_table(rules.compass_sources(catalog), "compasses")
    keys = ["log_id", "message"]
    axes = sources.select(
        *keys, F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"{a}_field").alias("field")) for a in "xyz"]))
    )
    near = samples.where(F.col("field").isin(*names))
    tagged = join_per_key(near, axes, list(SERIES), "seq")
    of = lambda a: F.max(F.when(F.col("axis") == a, F.col("value"))).alias(a)
    cloud = tagged.groupBy(*keys, "ts_us", "seq").agg(of("x"), of("y"), of("z"))
    cloud = scratch_table(
        _windowed(cloud, intervals).withColumn("b", stats.magnitude(F.col("x"), F.col("y"), F.col("z"))), "compass"
    )
    fit = circle.fit_circle(cloud, keys)
    field = stats.column_stats(cloud, keys, "b").select(
        *keys, F.col("mean").alias("b_mean"), F.col("std").alias("b_std"), F.col("cv").alias("b_cv")
    )
    # Load on the compass's own stamps, interpolated from the load's whole series.
    driver = scratch_table(rules.driver_sources(catalog).where("pos = 1"), "drivers")
    drive = join_per_key(
        samples.where(is_one_of([d[:2] for d in rules.DRIVERS])), driver.select(*SERIES), list(SERIES), "seq"
    ).select("log_id", "ts_us", "seq", "value")
    drive = join_per_key(drive, sources.select(*keys), ["log_id"], "seq")
    on_mag = timejoin.interpolate(drive, cloud.select(*keys, "ts_us", "seq", "b"), keys)
    load = stats.line_fit(on_mag, keys, "value", "b").select(
        *keys, F.col("slope").alias("load_slope"), F.col("r").alias("load_r"), F.col("n").alias("load_n")
    )
    return (
        sources.select(*keys, "pos").join(fit, keys, "left").join(field, keys, "left").join(load, keys, "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("status", F.coalesce("status", F.lit("too-few-samples")))
        .withColumn("narrow_arc", F.coalesce(F.col("arc_deg") < NARROW_ARC, F.lit(False)))
    )


def _outputs_state(
    samples: DataFrame, catalog: DataFrame, params: DataFrame, intervals: DataFrame | None,
    manual_min: float | None, manual_max: float | None,
) -> DataFrame:
    found = rules.actuator_channels(catalog)
    limits = scratch_table(channels.channel_limits(found, params, manual_min, manual_max), "limits")
    bank = F.lit(False)
    for message_re, field_re, _, _ in rules.BANKS:
        bank = bank | (F.col("message").rlike(message_re) & F.col("field").rlike(field_re))
    with groups_hold_at_most(_largest(catalog, bank)):
        return channels.channel_state(_windowed(samples.where(bank), intervals), limits)


def outputs_report(
    samples: DataFrame,
    catalog: DataFrame,
    params: DataFrame,
    intervals: DataFrame | None = None,
    manual_min: float | None = None,
    manual_max: float | None = None,
) -> DataFrame:
    """State, saturation and balance of every channel of every bank."""
    return channels.channel_balance(_outputs_state(samples, catalog, params, intervals, manual_min, manual_max))


def outputs_banks(
    samples: DataFrame,
    catalog: DataFrame,
    params: DataFrame,
    intervals: DataFrame | None = None,
    manual_min: float | None = None,
    manual_max: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``outputs_report``, and its line per bank: how many channels are driven, the worst
    saturated one, whether any leaves its limits, and where these came from.

    Channels are measured once for both.
    """
    manual = manual_min is not None or manual_max is not None
    state = scratch_table(_outputs_state(samples, catalog, params, intervals, manual_min, manual_max), "channels")
    return channels.channel_balance(state), channels.bank_summary(state, manual)


def tracking_report(
    samples: DataFrame, catalog: DataFrame, intervals: DataFrame | None = None
) -> DataFrame:
    """Error, lag and step response of every commanded/achieved pair."""
    messages = sorted({r[1] for r in rules.PAIRS} | {r[4] for r in rules.PAIRS})
    largest = _largest(catalog, messages)
    with groups_hold_at_most(largest):
        return _tracking_report(samples, catalog, intervals, messages, largest or 0)


def _tracking_report(
    samples: DataFrame, catalog: DataFrame, intervals: DataFrame | None, messages: Sequence[str], largest: int
) -> DataFrame:
    pairs = scratch_table(rules.tracking_pairs(catalog), "pairs")
    keys = ["log_id", "label"]
    sided = [*keys, "side"]
    sides = pairs.select(
        *keys, "wrap",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(s).alias("side"), F.col(f"{s}_message").alias("message"),
                        F.col(f"{s}_field").alias("field"), F.col(f"{s}_scale").alias("scale"),
                    )
                    for s in ("des", "act")
                ]
            )
        ),
    )
    near = _windowed(keep_messages(samples, messages), intervals)
    rows = join_per_key(near, sides, list(SERIES), "seq").select(
        *sided, "wrap", "ts_us", "seq", (F.col("value") * F.col("scale")).alias("value")
    )
    # Angles are unwrapped before they are resampled; the others pass by.
    rows = scratch_table(rows, "tracking")
    turned = unwrap_angle(rows.where("wrap > 0"), sided, 360.0)
    ready = scratch_table(rows.where("wrap = 0").unionByName(turned), "tracking")
    one = lambda s: ready.where(F.col("side") == s).select(*keys, "wrap", "ts_us", "seq", "value")
    gridded = tracking.grid_pair(one("des"), one("act"), [*keys, "wrap"], wrap=F.col("wrap")).drop("wrap")
    # Long gaps can give a grid far more points than the log has rows.
    longest = gridded.agg(F.max("n")).first()[0] or 0
    with groups_hold_at_most(max(largest, int(longest))):
        metrics = tracking.tracking_metrics(gridded, keys)
        step = tracking.step_metrics(gridded, keys)
    return (
        pairs.select(*keys, "unit", "varies", "pos")
        .join(metrics, keys, "left").join(step, keys, "left")
        .withColumn("weak", F.coalesce(F.col("r") < WEAK_CORRELATION, F.lit(False)))
        .withColumn("overshoots", F.coalesce(F.col("overshoot_pct") > HIGH_OVERSHOOT, F.lit(False)))
    )


def scatter_report(
    samples: DataFrame, presets: DataFrame, intervals: DataFrame | None = None, catalog: DataFrame | None = None
) -> DataFrame:
    """Line fit of every preset (or custom) pair: slope, r and, where it applies, resistance.

    ``presets`` as ``rules.scatter_presets`` gives them; with ``catalog`` the sizes of logs
    are taken from it and not counted.
    """
    presets = scratch_table(presets, "presets")
    names = _names_in(presets, "x_message", "y_message")
    with groups_hold_at_most(_largest(catalog, names)):
        return _scatter_report(samples, presets, intervals, names)


def _scatter_report(
    samples: DataFrame, presets: DataFrame, intervals: DataFrame | None, names: Sequence[str]
) -> DataFrame:
    keys = ["log_id", "label"]
    # What the pairing needs to know of a preset travels with its rows.
    carried = presets if intervals is None else presets.join(intervals, "log_id")
    told = [*keys, "x_scale", "y_scale"]
    inside = F.lit(True) if intervals is None else F.col("ts_us").between(F.col("t0"), F.col("t1"))
    samples = keep_messages(samples, names)
    groups = Groups(samples, SERIES)

    def series(axis: str) -> DataFrame:
        ends = [] if intervals is None else ["t0", "t1"]
        picked = carried.select(
            *told, *ends, F.col(f"{axis}_message").alias("message"), F.col(f"{axis}_field").alias("field")
        )
        return groups.join(samples, picked, "seq").select(*told, "ts_us", "seq", "value", inside.alias("inside"))

    scaled = timejoin.pair_on_common_time(series("x"), series("y"), keys=told).select(
        *keys, (F.col("a") * F.col("x_scale")).alias("x"), (F.col("b") * F.col("y_scale")).alias("y")
    )
    fit = stats.line_fit(scaled, keys)
    resistance = F.when(F.col("meaning") == "internal-resistance", stats.internal_resistance(F.col("slope")))
    return (
        presets.join(fit, keys, "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("r2", F.col("r") * F.col("r"))
        .withColumn("resistance_mohm", resistance)
        .withColumn("weak", F.coalesce(F.abs("r") < WEAK_CORRELATION, F.lit(False)))
    )


def spectrum_report(
    samples: DataFrame,
    chosen_fields: DataFrame,
    intervals: DataFrame | None = None,
    catalog: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Spectra of one field per log: ``(status per log, bins)``.

    ``chosen_fields(log_id, message, field)``; status is ``ok``, ``flat`` or why there
    is none: ``missing``, ``short``, ``gaps``.  With ``catalog`` the sizes of logs are
    taken from it and not counted.
    """
    names = _names_in(chosen_fields, "message")
    with groups_hold_at_most(_largest(catalog, names)):
        return _spectrum_report(samples, chosen_fields, intervals, names)


def _spectrum_report(
    samples: DataFrame, chosen_fields: DataFrame, intervals: DataFrame | None, names: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    keys = list(SERIES)
    samples = keep_messages(samples, names)
    chosen = scratch_table(join_per_key(samples, chosen_fields.select(*keys), keys, "seq").select(*keys, "ts_us", "seq", "value"), "signal")
    points, grid = uniform_grid(_windowed(chosen, intervals), keys)
    points, grid = scratch_table(points, "points"), scratch_table(grid, "grids")
    holes = points.groupBy(*keys).agg(F.count_if(F.col("value").isNull()).alias("holes"))
    dt = grid.select(*keys, (F.col("step") / F.lit(1e6)).alias("dt"))
    bins = scratch_table(spectrum.power_spectrum(detrend(points, keys), dt, keys), "bins")
    peak = spectrum.dominant_peak(bins, keys).select(*keys, F.col("freq").alias("peak_freq"), F.col("psd").alias("peak_psd"))
    present = chosen.select(*keys).distinct().withColumn("present", F.lit(True))
    status = (
        F.when(F.col("present").isNull(), "missing")
        .when(F.col("n_grid").isNull(), "short")
        .when(F.col("holes") > 0, "gaps")
        .when(F.coalesce(F.col("peak_psd"), F.lit(0.0)) > 0, "ok")
        .otherwise("flat")
    )
    summary = (
        chosen_fields.select(*keys).join(present, keys, "left").join(grid.select(*keys, "n_grid", "dropped"), keys, "left")
        .join(holes, keys, "left").join(peak, keys, "left")
        .select(*keys, status.alias("status"), "n_grid", "dropped", "peak_freq", "peak_psd")
    )
    return summary, bins


def plot_extract(
    samples: DataFrame, records: DataFrame | None, bounds: DataFrame, refs: Sequence[tuple[str, str]]
) -> DataFrame:
    """Chosen series against seconds into the log.

    Fields of one message are read row by row, keeping rows that share a stamp;
    fields of several are merged on the union of stamps.
    """
    messages = {m for m, _ in refs}
    if len(messages) == 1 and records is not None:
        (message,) = messages
        rows = records.where(F.col("message") == message).select(
            "log_id", "seq", "ts_us", *[tables.num(f).alias(f"{message}.{f}") for _, f in refs]
        )
    else:
        rows = timejoin.merge_on_time(samples, refs)
    start = bounds.select("log_id", "start_us")
    x = (F.col("ts_us") - F.col("start_us")) / F.lit(1e6)
    return join_per_key(rows, start, ["log_id"], "ts_us").withColumn("x", x).drop("start_us")


def plot_extents(extract: DataFrame, refs: Sequence[tuple[str, str]]) -> DataFrame:
    """``(log_id, label, lo, hi)`` of every column of ``plot_extract``: what an axis must hold.

    Columns are walked once for all; one without a known value has no ends.
    """
    labels = list(dict.fromkeys(f"{m}.{f}" for m, f in refs))
    ends = extract.groupBy("log_id").agg(
        *[fold(F.col(f"`{x}`")).alias(f"{side}{i}") for i, x in enumerate(labels) for side, fold in (("lo", F.min), ("hi", F.max))]
    )
    told = [F.struct(F.lit(x).alias("label"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")) for i, x in enumerate(labels)]
    return ends.select("log_id", F.inline(F.array(*told)))


def flight_tables(records: DataFrame) -> dict[str, DataFrame]:
    """The tables that describe every log, as lazy DataFrames."""
    rows = tables.samples(records)
    path = trajectory(records)
    return {
        "samples": rows,
        "catalog": tables.catalog(rows),
        "bounds": tables.log_bounds(records, path),
        "params": tables.params(records),
        "modes": tables.modes(records),
        "texts": tables.texts(records),
        "trajectory": path,
        "mission": log_mission(records),
    }


def flight_summary(records: DataFrame) -> DataFrame:
    """One row per log: bounds and how much of everything it holds.

    Every table is derived from the records, so they are decoded once and written by
    message: each part then reads the messages it is about.
    """
    schema = records.schema
    folder = scratch_path(records.sparkSession, "records")
    records.hint("rebalance", F.col("message")).write.partitionBy("message").parquet(folder)
    records = records.sparkSession.read.schema(schema).parquet(folder)
    t = flight_tables(records)
    count = lambda name, label: t[name].groupBy("log_id").agg(F.count(F.lit(1)).alias(label))
    out = t["bounds"]
    parts = (("params", "n_params"), ("modes", "n_modes"), ("texts", "n_texts"), ("trajectory", "n_fixes"), ("mission", "n_waypoints"))
    for name, label in parts:
        out = out.join(count(name, label), "log_id", "left")
    messages = tables.message_counts(records).groupBy("log_id").agg(F.count(F.lit(1)).alias("n_messages"))
    out = out.join(messages, "log_id", "left")
    return out.fillna(0, [label for _, label in parts] + ["n_messages"])
