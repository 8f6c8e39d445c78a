"""Flown path: which message gives it, which heading is draped on it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlake.functions.geo import is_fix, zoom_for
from flightlake.functions.values import finite
from flightlake.operators.timejoin import asof
from flightlake.scale import join_per_key

# Position messages by kind of log, best first:
# (source, rank, message, lat, lon, alt, degrees per unit, metres per unit)
POSITIONS = (
    ("bin", 0, "POS", "Lat", "Lng", "Alt", 1.0, 1.0),
    ("bin", 1, "GPS", "Lat", "Lng", "Alt", 1.0, 1.0),
    ("bin", 2, "AHR2", "Lat", "Lng", "Alt", 1.0, 1.0),
    ("tlog", 0, "GLOBAL_POSITION_INT", "lat", "lon", "relativeAlt", 1e-7, 1e-3),
    ("tlog", 1, "GPS_RAW_INT", "lat", "lon", "alt", 1e-7, 1e-3),
)

# Heading series by kind of log, best first:
# (source, rank, message, field, degrees per unit, value that means unknown)
HEADINGS = (
    ("bin", 0, "ATT", "Yaw", 1.0, None),
    ("bin", 1, "AHR2", "Yaw", 1.0, None),
    ("bin", 2, "GPS", "GCrs", 1.0, None),
    ("tlog", 0, "GLOBAL_POSITION_INT", "hdg", 0.01, 65535.0),
    ("tlog", 1, "VFR_HUD", "heading", 1.0, None),
    ("tlog", 2, "ATTITUDE", "yaw", 180 / math.pi, None),
    ("tlog", 3, "GPS_RAW_INT", "cog", 0.01, 65535.0),
)


def _rules(df: DataFrame, rows, schema: str) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(list(rows), schema))


def positions(records: DataFrame) -> DataFrame:
    """Every known position of every candidate message, with the candidate's rank."""
    rules = _rules(
        records, POSITIONS,
        "source string, rank int, message string, lat_f string, lon_f string, alt_f string, deg double, metre double",
    )
    names = sorted({r[2] for r in POSITIONS})
    matched = records.where(F.col("message").isin(*names)).join(rules, ["source", "message"])
    at = lambda name: F.try_element_at("nums", F.col(name))
    alt = F.when(F.map_contains_key("nums", F.col("alt_f")), at("alt_f") * F.col("metre")).otherwise(0.0)
    return matched.select(
        "log_id", "source", "rank", "seq", "ts_us",
        (at("lat_f") * F.col("deg")).alias("lat"),
        (at("lon_f") * F.col("deg")).alias("lon"),
        finite(alt).alias("alt"),
        F.col("message").alias("source_message"),
    ).where(is_fix(F.col("lat"), F.col("lon")))


def first_source(ranked: DataFrame) -> DataFrame:
    """Rows of the best-ranked candidate each log has any of."""
    best = ranked.groupBy("log_id").agg(F.min("rank").alias("_best"))
    return join_per_key(ranked, best, ["log_id"], "seq").where(F.col("rank") == F.col("_best")).drop("_best")


def headings(records: DataFrame) -> DataFrame:
    """Every row of every heading candidate; chosen by existence, known or not."""
    rules = _rules(
        records, HEADINGS,
        "source string, rank int, message string, field string, degree double, unknown double",
    )
    names = sorted({r[2] for r in HEADINGS})
    raw = F.try_element_at("nums", F.col("field"))
    return (
        records.where(F.col("message").isin(*names))
        .join(rules, ["source", "message"])
        .where(F.map_contains_key("nums", F.col("field")))
        .select(
            "log_id", "rank", "seq", "ts_us",
            F.when(F.col("unknown").isNull() | ~raw.eqNullSafe(F.col("unknown")), raw * F.col("degree")).alias("heading"),
        )
    )


def drape_heading(path: DataFrame, heading_rows: DataFrame) -> DataFrame:
    """Path rows with the heading in force at their time, NULL where unknown."""
    return asof(heading_rows, path, ("log_id",), ("heading",)).drop("held_ts_us")


def trajectory(records: DataFrame) -> DataFrame:
    path = first_source(positions(records)).drop("rank", "source")
    return drape_heading(path, first_source(headings(records)))


def view_of(points: DataFrame) -> DataFrame:
    """Centre and zoom framing each log's points."""
    lat, lon = F.col("lat"), F.col("lon")
    return points.groupBy("log_id").agg(
        ((F.min(lon) + F.max(lon)) / 2).alias("longitude"),
        ((F.min(lat) + F.max(lat)) / 2).alias("latitude"),
        zoom_for(F.max(lon) - F.min(lon), F.max(lat) - F.min(lat)).alias("zoom"),
    )


def initial_view(logs: DataFrame, path: DataFrame, mission: DataFrame) -> DataFrame:
    """The flown path framed, else the plan, else the whole world."""
    flown, planned = view_of(path), view_of(mission)
    names = ("longitude", "latitude", "zoom")
    world = {"longitude": 0.0, "latitude": 20.0, "zoom": 1.5}
    marked = flown.select("log_id", *[F.col(c).alias(f"f_{c}") for c in names])
    plan = planned.select("log_id", *[F.col(c).alias(f"p_{c}") for c in names])
    return (
        logs.select("log_id").distinct().join(marked, "log_id", "left").join(plan, "log_id", "left")
        .select("log_id", *[F.coalesce(f"f_{c}", f"p_{c}", F.lit(world[c])).alias(c) for c in names])
    )


