"""Algebraic circle fit of a point cloud (Taubin's method), one fit per key.

Rows are only ever aggregated: two passes give centre, scale and moments, the
cubic is solved on the one moment row each key is left with, and a third pass
measures the fit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlake.scale import Groups, Ordered, previous, scratch_table

# Fixed values.
FEWEST_POINTS = 3
SMALLEST_COVARIANCE = 1e-10
SMALLEST_DETERMINANT = 1e-12
NEWTON_STEPS = 99


def _smallest_root(a0: Column, a1: Column, a2: Column, a3: Column) -> Column:
    """Newton from 0 on the cubic, as long as each step brings it closer to zero."""

    def step(state: Column, _: Column) -> Column:
        x, y = state["x"], state["y"]
        slope = a1 + x * (2 * a2 + 3 * a3 * x)
        nx = F.try_subtract(x, F.try_divide(y, slope))
        ny = a0 + nx * (a1 + nx * (a2 + nx * a3))
        better = ~state["done"] & nx.isNotNull() & (nx != x) & (F.abs(ny) < F.abs(y))
        better = F.coalesce(better, F.lit(False))
        return F.struct(
            F.when(better, nx).otherwise(x).alias("x"),
            F.when(better, ny).otherwise(y).alias("y"),
            (~better).alias("done"),
        )

    start = F.struct(F.lit(0.0).alias("x"), a0.alias("y"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), start, step)["x"]


def moments(points: DataFrame, keys: Sequence[str], groups: Groups | None = None) -> DataFrame:
    """Per key: count, centre, RMS radius and the scaled moments about the centre."""
    keys = list(keys)
    groups = groups or Groups(points, keys)
    centre = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("x").alias("mx"),
        F.avg("y").alias("my"),
        F.sqrt(F.var_pop("x") + F.var_pop("y")).alias("s"),
    )
    u = F.try_divide(F.col("x") - F.col("mx"), F.col("s"))
    v = F.try_divide(F.col("y") - F.col("my"), F.col("s"))
    scaled = (
        groups.join(points, centre, "x")
        .withColumns({"u": u, "v": v})
        .withColumn("z", F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    )
    mean_of = lambda a, b: F.avg(F.col(a) * F.col(b))
    return scaled.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("n", "mx", "my", "s")],
        mean_of("u", "u").alias("uu"),
        mean_of("v", "v").alias("vv"),
        mean_of("u", "v").alias("uv"),
        mean_of("u", "z").alias("uz"),
        mean_of("v", "z").alias("vz"),
        F.avg("z").alias("z"),
        mean_of("z", "z").alias("zz"),
    )


def _settled(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that later ones read many times, each evaluated once.

    Plain projections would be merged and the solver repeated wherever its
    result is mentioned; a generator is not merged.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def circle_from_moments(m: DataFrame) -> DataFrame:
    """Centre and radius per moment row, ``status`` telling why there is none."""
    c = F.col
    var_z = c("zz") - c("z") * c("z")
    cubic = _settled(_settled(m, cov=c("uu") * c("vv") - c("uv") * c("uv")),
        a3=4 * c("z"),
        a2=-3 * c("z") * c("z") - c("zz"),
        a1=var_z * c("z") + 4 * c("cov") * c("z") - c("uz") * c("uz") - c("vz") * c("vz"),
        a0=c("uz") * (c("uz") * c("vv") - c("vz") * c("uv"))
        + c("vz") * (c("vz") * c("uu") - c("uz") * c("uv"))
        - var_z * c("cov"),
    )
    solved = _settled(cubic, root=_smallest_root(c("a0"), c("a1"), c("a2"), c("a3")))
    solved = _settled(solved, det=2 * (c("root") * c("root") - c("root") * c("z") + c("cov")))
    placed = _settled(
        solved,
        _cx=F.try_divide(c("uz") * (c("vv") - c("root")) - c("vz") * c("uv"), c("det")),
        _cy=F.try_divide(c("vz") * (c("uu") - c("root")) - c("uz") * c("uv"), c("det")),
    )
    usable = (c("s") > 0) & (c("cov") > SMALLEST_COVARIANCE) & (F.abs(c("det")) > SMALLEST_DETERMINANT)
    placed = _settled(
        placed,
        radius_=F.sqrt(c("_cx") * c("_cx") + c("_cy") * c("_cy") + c("z")) * c("s"),
        cx_=c("_cx") * c("s") + c("mx"),
        cy_=c("_cy") * c("s") + c("my"),
    )
    status = (
        F.when(c("n") < FEWEST_POINTS, "too-few-samples")
        .when(F.coalesce(usable & (c("radius_") > 0) & ~F.isnan("radius_"), F.lit(False)), "ok")
        .otherwise("degenerate")
    )
    keep = [x for x in m.columns if x not in ("mx", "my", "s", "uu", "vv", "uv", "uz", "vz", "z", "zz")]
    return placed.select(
        *keep, status.alias("status"), *[F.when(status == "ok", c(f"{x}_")).alias(x) for x in ("cx", "cy", "radius")]
    )


def angular_coverage(
    angles: DataFrame, keys: Sequence[str], angle: str = "angle", split: bool | None = None
) -> DataFrame:
    """Degrees spanned: the full turn less the largest empty gap, wrap included."""
    keys = list(keys)
    distinct = angles.select(*keys, F.col(angle).alias("angle")).groupBy(*keys, "angle").agg(
        F.count(F.lit(1)).alias("_n")
    )
    gaps = Ordered(distinct, keys, ["angle"], split=split).scan(_prev=previous("angle")).rows()
    turn = F.lit(2.0) * F.pi()
    widest = F.greatest(
        F.coalesce(F.max(F.col("angle") - F.col("_prev.angle")), F.lit(0.0)),
        F.min("angle") + turn - F.max("angle"),
    )
    return gaps.groupBy(*keys).agg(
        F.when(F.sum("_n") < 2, F.lit(0.0)).otherwise(F.degrees(turn - widest)).alias("arc_deg")
    )


def fit_circle(points: DataFrame, keys: Sequence[str] = ("log_id",)) -> DataFrame:
    """Circle per key over rows with both ``x`` and ``y``."""
    keys = list(keys)
    known = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*keys, "x", "y")
    groups = Groups(known, keys)
    # One row per key, read by the passes that measure the fit.
    fit = scratch_table(circle_from_moments(moments(known, keys, groups)), "circles")
    measured = groups.join(known, fit.where("status = 'ok'").select(*keys, "cx", "cy"), "x")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    measured = measured.withColumns({"r": F.sqrt(dx * dx + dy * dy), "angle": F.atan2(dy, dx)})
    spread = measured.groupBy(*keys).agg(F.stddev_pop("r").alias("radial_std"))
    arc = angular_coverage(measured, keys, split=groups.split)
    offset = F.sqrt(F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy"))
    return (
        fit.join(spread, keys, "left")
        .join(arc, keys, "left")
        .withColumn("offset", offset)
        .withColumn("offset_ratio", F.col("offset") / F.col("radius"))
        .withColumn(
            "heading_error_deg",
            F.when(F.col("offset_ratio").isNotNull(), F.degrees(F.asin(F.least(F.lit(1.0), F.col("offset_ratio"))))),
        )
    )
