"""Output and input channels: limits, saturation, balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from flightlake.operators.stats import stat_columns
from flightlake.scale import join_per_key

# Fixed values.
SATURATION_MARGIN = 2
DEFAULT_LIMITS = (1100.0, 1900.0)
OFF_BALANCE = 0.05
SATURATED = 0.05

CHANNEL = ("log_id", "message", "field")


def channel_limits(
    channels: DataFrame,
    params: DataFrame,
    manual_min: float | None = None,
    manual_max: float | None = None,
) -> DataFrame:
    """Add ``lo``, ``hi`` and ``from_params`` to ``channels(log_id, prefix, channel, ...)``.

    A channel uses its parameters only when both ends are there; a manual end
    replaces whatever was found.
    """
    pattern = r"^(SERVO|RC)(\d+)_(MIN|MAX)$"
    end = F.regexp_extract("name", pattern, 3)
    known = (
        params.where(F.col("name").rlike(pattern))
        .groupBy(
            "log_id",
            F.regexp_extract("name", pattern, 1).alias("prefix"),
            F.regexp_extract("name", pattern, 2).try_cast("int").alias("channel"),
        )
        .agg(F.max(F.when(end == "MIN", F.col("value"))).alias("_lo"), F.max(F.when(end == "MAX", F.col("value"))).alias("_hi"))
    )
    both = F.col("_lo").isNotNull() & F.col("_hi").isNotNull()
    lo = F.lit(float(manual_min)) if manual_min is not None else F.when(both, F.col("_lo")).otherwise(DEFAULT_LIMITS[0])
    hi = F.lit(float(manual_max)) if manual_max is not None else F.when(both, F.col("_hi")).otherwise(DEFAULT_LIMITS[1])
    return (
        channels.join(known, ["log_id", "prefix", "channel"], "left")
        .withColumns({"lo": lo, "hi": hi, "from_params": both})
        .drop("_lo", "_hi")
    )


def saturation_columns(value: Column, lo: Column, hi: Column) -> list[Column]:
    share = lambda hit: F.avg(F.when(value.isNotNull(), hit.cast("double")))
    return [
        share(value <= lo + SATURATION_MARGIN).alias("low_share"),
        share(value >= hi - SATURATION_MARGIN).alias("high_share"),
    ]


def channel_state(samples: DataFrame, limits: DataFrame) -> DataFrame:
    """One row per channel: statistics, saturation, idle and out-of-bounds flags.

    ``limits`` has one row per ``(log_id, message, field)``; a channel without
    known values keeps its row and is idle.
    """
    keys = list(CHANNEL)
    judged = join_per_key(
        samples.select(*keys, "seq", "value"), limits.select(*keys, "lo", "hi"), keys, "seq"
    )
    per_channel = judged.groupBy(*keys).agg(
        *stat_columns(F.col("value")), *saturation_columns(F.col("value"), F.col("lo"), F.col("hi"))
    )
    none = F.coalesce(F.col("n"), F.lit(0)) == 0
    still = (F.col("std") == 0) & ((F.col("mean") == 0) | (F.col("n") <= 1))
    idle = F.coalesce(none | still, F.lit(True))
    outside = (F.col("min") < F.col("lo") - SATURATION_MARGIN) | (F.col("max") > F.col("hi") + SATURATION_MARGIN)
    return (
        limits.join(per_channel, keys, "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("std", F.when(F.col("n") > 0, F.col("std")))
        .withColumn("idle", idle)
        .withColumn("out_of_bounds", F.coalesce(~F.col("idle") & outside, F.lit(False)))
    )


def channel_balance(state: DataFrame) -> DataFrame:
    """Offset of each driven channel from the mean of its bank's driven channels.

    A bank is the channels of one message, a handful of rows.
    """
    bank = Window.partitionBy("log_id", "message")
    driven = ~F.col("idle")
    mean = F.when(F.count_if(driven).over(bank) >= 2, F.avg(F.when(driven, F.col("mean"))).over(bank))
    offset = F.when(driven, F.col("mean") - F.col("bank_mean"))
    span = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo"))
    return (
        state.withColumn("bank_mean", mean)
        .withColumn("offset", offset)
        .withColumn("off_balance", F.coalesce(F.abs("offset") > OFF_BALANCE * span, F.lit(False)))
        .withColumn(
            "saturated",
            F.coalesce(driven & (F.greatest("low_share", "high_share") > SATURATED), F.lit(False)),
        )
    )


def bank_summary(state: DataFrame, manual: bool = False) -> DataFrame:
    """Per bank: driven channels, worst saturated one, where the limits came from."""
    driven = ~F.col("idle")
    share = F.greatest("low_share", "high_share")
    worst = F.max_by(F.struct("field", share.alias("share")), F.when(driven, F.struct(share, -F.col("channel"))))
    params = F.col("from_params")
    source = (
        F.when(F.lit(manual), "manual")
        .when((F.count_if(driven) > 0) & (F.count_if(driven & ~params) == 0), "parameters")
        .when(F.count_if(driven & params) > 0, "part parameters")
        .otherwise("defaults")
    )
    return (
        state.groupBy("log_id", "message")
        .agg(
            F.count_if(driven).alias("n_driven"),
            worst.alias("_worst"),
            F.bool_or("out_of_bounds").alias("any_out_of_bounds"),
            source.alias("limit_source"),
        )
        .select(
            "log_id", "message", "n_driven",
            F.col("_worst.field").alias("worst_field"),
            F.col("_worst.share").alias("worst_share"),
            "any_out_of_bounds", "limit_source",
        )
    )
