"""Joins on time: the row before, the row after, the value in between.

Everything here rests on one plan: source rows and the instants asked for are
stacked, ordered by time within a series, and each instant reads the source rows
around it.  That is one shuffle and one sort however dense either side is; there
is no range join and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlake.operators.select import is_one_of
from flightlake.scale import (
    Groups,
    Ordered,
    first_known,
    join_per_key,
    last_known,
    next_known,
    scratch_table,
)

SERIES = ("log_id",)


def around(
    source: DataFrame,
    probe: DataFrame,
    keys: Sequence[str] = SERIES,
    carry: Sequence[str] = ("value",),
    split: bool | None = None,
) -> DataFrame:
    """Probe rows with ``first``, ``before`` and ``after`` source rows.

    ``source`` has keys, ``ts_us``, ``seq`` and the ``carry`` columns; ``probe``
    has keys, ``ts_us``, ``seq`` and whatever else it brings.  ``before`` is the
    last row at or before the instant, ``after`` the first strictly later one,
    ``first`` the first row of the series if it is not later than the instant.
    Rows travel as structs, so a gap row is still a neighbour.
    """
    keys = list(keys)
    brought = [c for c in probe.columns if c not in (*keys, "ts_us", "seq")]
    time, place = F.col("ts_us").cast("double").alias("_t"), F.col("seq").cast("long").alias("_s")
    row_type = F.struct("ts_us", "seq", *carry)
    stacked = source.select(
        *keys, time, F.lit(0).alias("_side"), place, row_type.alias("_row")
    ).unionByName(
        probe.select(
            *keys,
            time,
            F.lit(1).alias("_side"),
            place,
            F.struct("ts_us", "seq", *brought).alias("_ask"),
        ),
        allowMissingColumns=True,
    )
    found = Ordered(stacked, keys, ["_t", "_side", "_s"], split=split).scan(
        first=first_known(F.col("_row")),
        before=last_known(F.col("_row")),
        after=next_known(F.col("_row")),
    )
    return (
        found.where(F.col("_side") == 1)
        .rows()
        .select(*keys, "_ask.ts_us", "_ask.seq", *[F.col(f"_ask.`{c}`") for c in brought], "first", "before", "after")
    )


def held_row() -> Column:
    """As-of backward: clamps to the first row before the series starts.

    At the very first stamp the first row answers; at any other stamp shared by
    several rows the last of them does.
    """
    before, first = F.col("before"), F.col("first")
    return (
        F.when(before.isNull(), F.col("after"))
        .when(before["ts_us"] == first["ts_us"], F.when(F.col("ts_us") == first["ts_us"], first).otherwise(before))
        .otherwise(before)
    )


def nearest_row() -> Column:
    """Closer neighbour, the earlier on a tie, NULL outside the series."""
    held, after, t = held_row(), F.col("after"), F.col("ts_us")
    inside = F.col("before").isNotNull() & (after.isNotNull() | (t == F.col("before")["ts_us"]))
    closer = (after["ts_us"] - t) < (t - held["ts_us"])
    return F.when(inside, F.when(after.isNotNull() & closer, after).otherwise(held))


def between(value: str = "value") -> Column:
    """Linear interpolation; NULL outside the series or beside a gap."""
    held, after, t = held_row(), F.col("after"), F.col("ts_us").cast("double")
    t0, t1 = held["ts_us"].cast("double"), after["ts_us"].cast("double")
    inside = F.col("before").isNotNull()
    return F.when(inside & (t == t0), held[value]).when(
        inside & after.isNotNull(),
        held[value] + (t - t0) / (t1 - t0) * (after[value] - held[value]),
    )


def asof(source, probe, keys=SERIES, carry=("value",), split=None) -> DataFrame:
    """Probe rows with the ``carry`` columns of the row in force at that time."""
    asked = probe.columns
    return around(source, probe, keys, carry, split).select(
        *asked,
        held_row()["ts_us"].alias("held_ts_us"),
        *[held_row()[c].alias(c) for c in carry],
    )


def nearest(source, probe, keys=SERIES, carry=("value",), split=None) -> DataFrame:
    asked = probe.columns
    return around(source, probe, keys, carry, split).select(
        *asked,
        nearest_row()["ts_us"].alias("near_ts_us"),
        *[nearest_row()[c].alias(c) for c in carry],
    )


def interpolate(source, probe, keys=SERIES, value="value", split=None) -> DataFrame:
    asked = probe.columns
    return around(source, probe, keys, (value,), split).select(*asked, between(value).alias(value))


def pair_on_common_time(
    a: DataFrame,
    b: DataFrame,
    window: tuple[int, int] | DataFrame | None = None,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """Two series side by side at the stamps of the sparser one.

    Per key, whichever side has fewer rows in the window (``a`` on a tie) lends
    its stamps and the other is interpolated from its whole series.  A key with
    no rows on either side in the window gives none.  ``window`` is one interval
    for all, a table ``(log_id, t0, t1)``, or an ``inside`` flag on the rows.
    """
    keys = list(keys)
    own = ["inside"] if "inside" in a.columns else []
    rows = [*keys, "ts_us", "seq", "value", *own]
    both = a.select(*rows, F.lit("a").alias("side")).unionByName(b.select(*rows, F.lit("b").alias("side")))
    if isinstance(window, DataFrame):
        both = join_per_key(both, window.select("log_id", "t0", "t1"), ["log_id"], "seq")
        both = both.withColumn("inside", F.col("ts_us").between(F.col("t0"), F.col("t1")))
    elif not own:
        both = both.withColumn("inside", F.lit(True) if window is None else F.col("ts_us").between(*window))
    both = scratch_table(both, "pairs")
    in_a = F.count_if(F.col("inside") & (F.col("side") == "a"))
    in_b = F.count_if(F.col("inside") & (F.col("side") == "b"))
    lead = (
        both.groupBy(*keys)
        .agg(in_a.alias("na"), in_b.alias("nb"))
        .where("na > 0 AND nb > 0")
        .select(*keys, F.when(F.col("na") <= F.col("nb"), "a").otherwise("b").alias("lead"))
    )
    # A row of the leading side inside the window is an instant; a row of the
    # other side is a source.
    groups = Groups(both, keys)
    ask = F.col("side") == F.col("lead")
    roles = (
        groups.join(both, lead, "seq")
        .withColumns({"_t": F.col("ts_us").cast("double"), "_ask": ask.cast("int")})
        .where((F.col("_ask") == 0) | F.col("inside"))
    )
    source = F.when(F.col("_ask") == 0, F.struct("ts_us", "seq", "value"))
    found = (
        Ordered(roles, keys, ["_t", "_ask", "seq"], split=groups.split)
        .scan(first=first_known(source), before=last_known(source), after=next_known(source))
        .where(F.col("_ask") == 1)
    )
    other = between("value")
    a_leads = F.col("lead") == "a"
    return found.rows().select(
        *keys,
        "ts_us",
        "seq",
        F.when(a_leads, F.col("value")).otherwise(other).alias("a"),
        F.when(a_leads, other).otherwise(F.col("value")).alias("b"),
    )


def merge_on_time(samples: DataFrame, refs: Sequence[tuple[str, str]]) -> DataFrame:
    """All chosen series on the union of their stamps, one column per series.

    Of several rows at one stamp the last in file order wins, also when it is a
    gap: ``max_by`` passes over a NULL order, not over a NULL value.
    """
    chosen = F.lit(False)
    columns = []
    for message, field in refs:
        match = (F.col("message") == message) & (F.col("field") == field)
        chosen = chosen | match
        columns.append(
            F.max_by("value", F.when(match, F.col("seq"))).alias(f"{message}.{field}")
        )
    return samples.where(chosen).groupBy("log_id", "ts_us").agg(*columns)


def at_instants(samples: DataFrame, instants: DataFrame, refs: Sequence[tuple[str, str]]) -> DataFrame:
    """Nearest sample of each chosen series at each instant of its log.

    ``instants(log_id, ts_us, seq)``; ``refs`` is the short list a user picked.
    """
    picked = F.array(*[F.struct(F.lit(m).alias("message"), F.lit(f).alias("field")) for m, f in refs])
    asked = instants.select("log_id", "ts_us", "seq", F.inline(picked))
    return nearest(samples.where(is_one_of(refs)), asked, ("log_id", "message", "field"))


def in_same_row(samples: DataFrame, rows: DataFrame, message: str, fields: Sequence[str]) -> DataFrame:
    """Values of chosen fields of one message in the very rows asked for, one column a field.

    ``rows(log_id, seq)``.  Fields of one message share their rows, so a row is found by its
    place in the file, never by its time: of several rows at one stamp each answers for itself,
    and a row without a value stays one.
    """
    asked = rows.select("log_id", "seq").distinct()
    held = samples.where((F.col("message") == message) & F.col("field").isin(*fields)).join(asked, ["log_id", "seq"])
    return held.groupBy("log_id", "seq", "ts_us").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"{message}.{f}") for f in fields]
    )


def position_at(trajectory: DataFrame, instants: DataFrame) -> DataFrame:
    """Position and heading in force at each instant."""
    return asof(trajectory, instants, ("log_id",), ("lat", "lon", "alt", "heading"))
