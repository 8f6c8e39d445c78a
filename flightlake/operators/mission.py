"""Planned missions: which items are vertices, which plan is the newest.

An item's number is a DOUBLE, as the log holds it: numbers that are not whole, or beyond
any integer, tell items apart like others.  A command or frame that is no INT is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlake.functions.geo import as_degrees, is_route_vertex
from flightlake.scale import Ordered, join_per_key, row_index

WAYPOINT = ("command", "lat", "lon", "alt", "frame")


def route_vertices(items: DataFrame) -> DataFrame:
    return items.where(is_route_vertex(F.col("command"), F.col("lat"), F.col("lon")))


def is_flight_plan(mission_type: Column) -> Column:
    """0 is the flight plan; senders that omit the field mean 0."""
    return F.coalesce(mission_type, F.lit(0.0)) == 0


def in_order(plan: DataFrame) -> DataFrame:
    """Waypoints with their ``place`` in their log's plan, counted from 1."""
    by_number = Ordered(plan, ["log_id"], ["seq"]).scan(place=row_index())
    return by_number.with_columns(place=F.col("place") + 1).rows()


def newest_plan(items: DataFrame, transfers: DataFrame | None = None) -> DataFrame:
    """The plan a log last held: ``log_id, seq`` and the waypoint columns.

    ``items(log_id, file_seq, seq, ...)`` are all items in file order;
    ``transfers(log_id, file_seq)`` marks where a full transfer begins.  A log
    with transfers starts at its last one, any other at its last item number 0;
    a log with neither keeps everything.  The last write of a number wins.
    """
    start = items.groupBy("log_id").agg(
        F.max(F.when(F.col("seq") == 0, F.col("file_seq"))).alias("_zero")
    )
    if transfers is not None:
        told = transfers.groupBy("log_id").agg(F.max("file_seq").alias("_told"))
        start = start.join(told, "log_id", "left").select("log_id", F.coalesce("_told", "_zero").alias("_from"))
    else:
        start = start.select("log_id", F.col("_zero").alias("_from"))
    current = join_per_key(items, start, ["log_id"], "file_seq").where(
        F.col("_from").isNull() | (F.col("file_seq") >= F.col("_from"))
    )
    carried = [c for c in WAYPOINT if c in items.columns]
    return (
        route_vertices(current)
        .groupBy("log_id", "seq")
        .agg(F.max_by(F.struct(*carried), F.col("file_seq")).alias("w"))
        .select("log_id", "seq", "w.*")
    )


def prefer_first(*plans: DataFrame) -> DataFrame:
    """Plans in order of preference: a log in an earlier one is not taken from a later."""
    chosen = plans[0]
    for plan in plans[1:]:
        chosen = chosen.unionByName(
            plan.join(chosen.select("log_id").distinct(), "log_id", "left_anti"), allowMissingColumns=True
        )
    return chosen


def command_items(records: DataFrame) -> DataFrame:
    """Items of ``CMD`` rows; ``MISE`` traces execution and is not the plan."""
    n = lambda label: F.try_element_at("nums", F.lit(label))
    lat, lon = as_degrees(n("Lat"), n("Lng"))
    return records.where((F.col("message") == "CMD") & n("CNum").isNotNull()).select(
        "log_id", F.col("seq").alias("file_seq"), n("CNum").alias("seq"),
        n("CId").try_cast("int").alias("command"), lat.alias("lat"), lon.alias("lon"),
        n("Alt").alias("alt"), n("Frame").try_cast("int").alias("frame"),
    )


def telemetry_items(records: DataFrame, message: str) -> DataFrame:
    """Items of ``MISSION_ITEM_INT`` (degrees x 1e7) or ``MISSION_ITEM`` (degrees)."""
    n = lambda label: F.try_element_at("nums", F.lit(label))
    scale = 1e-7 if message == "MISSION_ITEM_INT" else 1.0
    kept = (F.col("message") == message) & is_flight_plan(n("missionType")) & n("seq").isNotNull()
    return records.where(kept).select(
        "log_id", F.col("seq").alias("file_seq"), n("seq").alias("seq"),
        n("command").try_cast("int").alias("command"), (n("x") * scale).alias("lat"), (n("y") * scale).alias("lon"),
        n("z").alias("alt"), n("frame").try_cast("int").alias("frame"),
    )


def transfers(records: DataFrame) -> DataFrame:
    kind = F.try_element_at("nums", F.lit("missionType"))
    return records.where((F.col("message") == "MISSION_COUNT") & is_flight_plan(kind)).select(
        "log_id", F.col("seq").alias("file_seq")
    )


def log_mission(records: DataFrame) -> DataFrame:
    """The newest plan of every log, whichever kind of log it is."""
    begun = transfers(records)
    return prefer_first(
        newest_plan(command_items(records).unionByName(telemetry_items(records, "MISSION_ITEM_INT")), begun),
        newest_plan(telemetry_items(records, "MISSION_ITEM"), begun),
    )
