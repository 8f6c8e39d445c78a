"""Flight-plan files: the line-based text form and the JSON form.

A plan file is whole in one row.  A caller may name a size above which a file is no
plan; it is then rejected before it is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlake.functions.geo import is_route_command, is_route_vertex
from flightlake.scale import Ordered, last_known, row_index, scratch_table

# Fixed values.
TEXT_HEADER = "QGC WPL"
TEXT_FIELDS = 12
WAYPOINT, GLOBAL_FRAME = 16, 0

_SPACE = r"[\s\x0B   -     　﻿]"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

WAYPOINTS = ("log_id", "seq", "command", "lat", "lon", "alt", "frame")


def read_plans(spark: SparkSession, folder: str, largest: int | None = None) -> DataFrame:
    """``(log_id, size, content)`` per file; content is NULL where ``largest`` rules a plan out."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    meta = F.col("_metadata")
    told = (meta["file_path"].alias("log_id"), meta["file_size"].alias("size"), F.col("value").alias("content"))
    if largest is None:
        return files.select(*told)
    small = files.where(meta["file_size"] <= largest).select(*told)
    large = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        .where(F.col("length") > largest)
        .select(F.col("path").alias("log_id"), F.col("length").alias("size"), F.lit(None).cast("string").alias("content"))
    )
    return small.unionByName(large)


def route_plans(files: DataFrame) -> DataFrame:
    """Add ``body`` (leading blanks and byte-order mark removed) and ``kind``.

    The kind is told by content: ``json``, ``text``, ``other`` or ``too-large``.
    """
    body = F.regexp_replace("content", f"^{_SPACE}+", "")
    kind = (
        F.when(F.col("content").isNull(), "too-large")
        .when(F.col("body").startswith("{"), "json")
        .when(F.col("body").startswith(TEXT_HEADER), "text")
        .otherwise("other")
    )
    return files.withColumn("body", body).withColumn("kind", kind)


def _number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def text_rows(routed: DataFrame) -> DataFrame:
    """Data lines of text plans: ``log_id, line, parts`` (1-based line number)."""
    lines = routed.where("kind = 'text'").select(
        "log_id", F.posexplode(F.split("body", r"\r?\n")).alias("at", "raw")
    )
    trimmed = F.regexp_replace("raw", f"^{_SPACE}+|{_SPACE}+$", "")
    return (
        lines.where("at > 0")
        .select("log_id", (F.col("at") + 1).alias("line"), trimmed.alias("row"))
        .where((F.col("row") != "") & ~F.col("row").startswith("#"))
        .select("log_id", "line", F.split("row", f"{_SPACE}+").alias("parts"))
    )


def text_items(rows: DataFrame) -> DataFrame:
    """Items of well-formed lines, in file order as ``file_seq``."""
    n = lambda i: _number(F.col("parts")[i])
    seq, command = n(0), n(3)
    return rows.where(F.size("parts") == TEXT_FIELDS).select(
        "log_id", F.col("line").cast("long").alias("file_seq"), seq.alias("seq"),
        F.when((command == 0) & (seq == 0), float(WAYPOINT)).otherwise(command).alias("command"),
        n(8).alias("lat"), n(9).alias("lon"), n(10).alias("alt"), n(2).alias("frame"),
    )


def _json_number(value: Column) -> Column:
    """A JSON number; null, text and the rest are missing, not 0."""
    kind = F.schema_of_variant(value)
    return F.when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(value, "$", "double"))


def _at(value: str, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(F.col(value), path, kind)


def json_plans(routed: DataFrame) -> DataFrame:
    """JSON plans with ``home``, ``items`` and the ``reason`` for a rejected one."""
    doc = routed.where("kind = 'json'").select("log_id", F.try_parse_json("body").alias("doc"))
    parts = doc.select(
        "log_id", "doc",
        _at("doc", "$.fileType", "string").alias("file_type"),
        _at("doc", "$.mission").alias("mission"),
        _at("doc", "$.mission.plannedHomePosition", "array<variant>").alias("home"),
        _at("doc", "$.mission.items", "array<variant>").alias("items"),
    )
    empty = F.col("mission").isNull() | F.is_variant_null("mission")
    reason = (
        F.when(F.col("doc").isNull(), "not JSON")
        .when(F.coalesce(F.col("file_type") != "Plan", F.lit(True)), "not a plan")
        .when(empty, "no mission")
        .when(F.coalesce(F.size("items"), F.lit(0)) <= 0, "no waypoints")
    )
    # Written parsed: items, home and reason are read from it, not parsed again for each.
    return scratch_table(parts.withColumn("reason", reason).drop("doc", "file_type", "mission"), "json-plans")


def _inner_items(item: Column) -> Column:
    """Items stored inside a complex item; NULL for any other and for an empty one."""
    kind = F.try_variant_get(item, "$.type", "string")
    inner = F.try_variant_get(item, "$.TransectStyleComplexItem.Items", "array<variant>")
    return F.when(kind.isin("ComplexItem", "survey") & (F.size(inner) > 0), inner)


def _expanded(level: DataFrame) -> DataFrame:
    """``(log_id, place, item)`` with complex items replaced by what they hold, however deep.

    Each round opens one level of what is still closed, until nothing is.
    """
    done = []
    while True:
        level = level.withColumn("more", _inner_items(F.col("item")).isNotNull())
        done.append(level.where("NOT more").select("log_id", "place", "item"))
        closed = level.where("more")
        if closed.isEmpty():
            return reduce(DataFrame.unionByName, done)
        opened = closed.select("log_id", "place", F.posexplode(_inner_items(F.col("item"))).alias("j", "sub"))
        opened = opened.select("log_id", F.concat("place", F.array("j")).alias("place"), F.col("sub").alias("item"))
        level = scratch_table(opened, "nested-items")


def json_items(plans: DataFrame) -> DataFrame:
    """Items of accepted JSON plans after expanding complex ones.

    ``place`` orders them as written; ``unreadable`` marks what belongs on the
    route but cannot be drawn.
    """
    first = plans.where("reason IS NULL").select("log_id", F.posexplode("items").alias("i", "item"))
    flat = _expanded(first.select("log_id", F.array("i").alias("place"), "item"))
    flat = flat.where(F.schema_of_variant("item").rlike("^(OBJECT|ARRAY)"))
    kind = _at("item", "$.type", "string")
    moved = F.schema_of_variant(_at("item", "$.coordinate")).startswith("ARRAY")
    spot = lambda c, p: F.when(
        F.coalesce(moved, F.lit(False)), _json_number(_at("item", f"$.coordinate[{c}]"))
    ).otherwise(_json_number(_at("item", f"$.params[{p}]")))
    read = flat.select(
        "log_id", "place",
        F.coalesce(kind.isin("ComplexItem", "survey"), F.lit(False)).alias("complex"),
        _json_number(_at("item", "$.command")).alias("command"),
        spot(0, 4).alias("lat"), spot(1, 5).alias("lon"), spot(2, 6).alias("alt"),
        _json_number(_at("item", "$.frame")).alias("frame"),
        _json_number(_at("item", "$.doJumpId")).alias("jump_id"),
    )
    lost = is_route_command(F.col("command")) & (F.col("lat").isNull() | F.col("lon").isNull())
    return read.withColumn("unreadable", F.col("complex") | lost)


def number_items(items: DataFrame) -> DataFrame:
    """``seq`` of each item: its own valid number, else one more than the item before."""
    valid = (F.col("jump_id") >= 0) & (F.col("jump_id") % 1 == 0)
    ranked = Ordered(items.where("NOT complex"), ["log_id"], ["place"]).scan(_rank=row_index())
    ranked = ranked.with_columns(_rank=F.col("_rank") + 1)
    numbered = ranked.scan(_a=last_known(F.when(valid, F.struct("jump_id", "_rank")))).rows()
    return numbered.withColumn(
        "seq", F.coalesce(F.col("_a.jump_id") + F.col("_rank") - F.col("_a._rank"), F.col("_rank").cast("double"))
    ).drop("_a", "_rank")


def _home(plans: DataFrame) -> DataFrame:
    has = F.col("reason").isNull() & (F.coalesce(F.size("home"), F.lit(0)) >= 2)
    n = lambda i: _json_number(F.get("home", F.lit(i)))
    return plans.where(has).select(
        "log_id", F.array(F.lit(-1)).alias("place"), F.lit(0.0).alias("seq"),
        F.lit(float(WAYPOINT)).alias("command"), n(0).alias("lat"), n(1).alias("lon"),
        F.coalesce(n(2), F.lit(0.0)).alias("alt"), F.lit(float(GLOBAL_FRAME)).alias("frame"),
    )


def _last_written(items: DataFrame, order: str) -> DataFrame:
    """Drawable items, the last write of each number.

    A number is what the file says, whole or not: items are told apart by it and
    ordered by it, and none is lost for what it is numbered.
    """
    drawn = items.where(is_route_vertex(F.col("command"), F.col("lat"), F.col("lon")))
    return (
        drawn.where("seq IS NOT NULL").groupBy("log_id", "seq")
        .agg(F.max_by(F.struct("command", "lat", "lon", "alt", "frame"), F.col(order)).alias("w"))
        .select(
            "log_id", "seq", F.col("w.command").try_cast("int").alias("command"),
            "w.lat", "w.lon", "w.alt", F.col("w.frame").try_cast("int").alias("frame"),
        )
    )


def parse_plans(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(waypoints, outcome)`` of plan files ``(log_id, size, content)``.

    ``outcome`` has one row per file: kind, waypoints, unreadable items, and the
    reason if it was rejected.  A rejected file gives no waypoints.
    """
    routed = scratch_table(route_plans(files).drop("content"), "plans")
    rows = scratch_table(text_rows(routed), "plan-lines")
    bad = F.size("parts") != TEXT_FIELDS
    judged = rows.groupBy("log_id").agg(
        F.min_by(F.struct("line", F.size("parts").alias("found")), F.when(bad, F.col("line"))).alias("bad")
    )
    text_reason = F.when(
        F.col("bad").isNotNull(),
        F.format_string(f"%d fields on line %d where a waypoint has {TEXT_FIELDS}", F.col("bad.found"), F.col("bad.line")),
    )
    text_state = (
        routed.where("kind = 'text'").select("log_id").join(judged.withColumn("seen", F.lit(True)), "log_id", "left")
        .select("log_id", F.when(F.col("seen").isNull(), "no waypoints").otherwise(text_reason).alias("reason"))
    )
    good = text_state.where("reason IS NULL").select("log_id")
    from_text = _last_written(text_items(rows.join(good, "log_id", "left_semi")), "file_seq")

    plans = json_plans(routed)
    # Parsed once; the flat items are read for numbering and for counting.
    items = scratch_table(json_items(plans), "plan-items")
    numbered = number_items(items).where("NOT unreadable")
    names = ["log_id", "place", "seq", "command", "lat", "lon", "alt", "frame"]
    from_json = _last_written(numbered.select(*names).unionByName(_home(plans)), "place")
    lost = items.groupBy("log_id").agg(F.count_if("unreadable").alias("unreadable"))

    waypoints = from_text.unionByName(from_json)
    drawn = waypoints.groupBy("log_id").agg(F.count(F.lit(1)).alias("n"))
    reasons = text_state.unionByName(plans.select("log_id", "reason"))
    outcome = (
        routed.select("log_id", "kind")
        .join(reasons, "log_id", "left").join(drawn, "log_id", "left").join(lost, "log_id", "left")
        .select(
            "log_id", "kind", F.coalesce("n", F.lit(0)).alias("n_waypoints"),
            F.coalesce("unreadable", F.lit(0)).alias("unreadable"),
            F.when(F.col("kind") == "too-large", "too large")
            .when(F.col("kind") == "other", "not a mission file")
            .when(F.col("reason").isNotNull(), F.col("reason"))
            .when(F.coalesce("n", F.lit(0)) == 0, "no drawable waypoints")
            .alias("reason"),
        )
    )
    return waypoints, outcome
