"""Grouped statistics.  Plain hash aggregates: combined map-side, no sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SERIES = ("log_id", "message", "field")


def stat_columns(value: Column) -> list[Column]:
    std = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    mean = F.avg(value)
    return [
        F.count(value).alias("n"),
        mean.alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        std.alias("std"),
        F.sqrt(F.avg(value * value)).alias("rms"),
        F.try_divide(std, F.abs(mean)).alias("cv"),
    ]


def column_stats(samples: DataFrame, keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """Count, mean, extremes, spread of the known values; no row where there are none."""
    return samples.groupBy(*keys).agg(*stat_columns(F.col(value))).where("n > 0")


def fit_columns(x: Column, y: Column) -> list[Column]:
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    # corr() raises on a constant column, so r is spelled out with a guarded division.
    r = F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))
    return [
        F.regr_slope(py, px).alias("slope"),
        F.regr_intercept(py, px).alias("intercept"),
        r.alias("r"),
        F.count(px).alias("n"),
    ]


def line_fit(pairs: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Least-squares line and correlation over pairs without gaps."""
    fit = pairs.groupBy(*keys).agg(*fit_columns(F.col(x), F.col(y)))
    return fit.withColumn("intercept", F.when(F.col("slope").isNotNull(), F.col("intercept")))


def pearson(pairs: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    return line_fit(pairs, keys, x, y).select(*keys, "r", "n")


def extent(samples: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    return samples.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def varies(samples: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    moving = F.coalesce(F.min("value") != F.max("value"), F.lit(False))
    return samples.groupBy(*keys).agg(moving.alias("varies"))


def magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def internal_resistance(slope: Column) -> Column:
    """Milliohms from the slope of voltage over current; NULL unless the pack sagged."""
    return F.when(slope < 0, -slope * 1000)
