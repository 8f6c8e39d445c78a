"""The tables of a log: samples, catalog, bounds, parameters, modes, texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlake.functions.values import finite, round_half_up
from flightlake.operators.sequence import mode_changes


def num(label: str) -> Column:
    return F.try_element_at("nums", F.lit(label))


def txt(label: str) -> Column:
    return F.try_element_at("txts", F.lit(label))


def samples(records: DataFrame) -> DataFrame:
    """One row per numeric value; ``position`` is the field's place in its message.

    Series are built of one type per name: records told to be ``shadowed`` give none.
    """
    if "shadowed" in records.columns:
        records = records.where(~F.coalesce("shadowed", F.lit(False)))
    return records.select(
        "log_id", "message", "seq", "ts_us", F.posexplode("nums").alias("position", "field", "value")
    ).select(
        "log_id", "message", "field", "position", "seq", "ts_us", finite(F.col("value")).alias("value")
    )


def wide_view(records: DataFrame, message: str, numbers: list[str], texts: list[str] | None = None) -> DataFrame:
    """Typed columns of one message; an absent number is NULL, an absent text ''."""
    return records.where(F.col("message") == message).select(
        "log_id", "seq", "ts_us",
        *[num(f).alias(f) for f in numbers],
        *[F.coalesce(txt(f), F.lit("")).alias(f) for f in (texts or [])],
    )


def catalog(rows: DataFrame) -> DataFrame:
    """What each log holds, one row per field; small, and what detection reads."""
    place = F.min("position") if "position" in rows.columns else F.lit(0)
    return rows.groupBy("log_id", "message", "field").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("value").alias("n_finite"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.coalesce(F.min("value") != F.max("value"), F.lit(False)).alias("varies"),
        F.min("seq").alias("first_seq"),
        place.alias("position"),
    )


def message_counts(rows: DataFrame) -> DataFrame:
    """Rows per message of each log."""
    return rows.groupBy("log_id", "message").agg(F.count(F.lit(1)).alias("n_rows"))


def message_summary(rows: DataFrame, selected: list[str]) -> DataFrame:
    """Per log: message types, and how many of them hold no selected field."""
    counts = message_counts(rows)
    return counts.groupBy("log_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count_if(~F.col("message").isin(*selected)).alias("n_purgeable"),
        F.sum("n_rows").alias("n_rows"),
    )


def log_bounds(records: DataFrame, trajectory: DataFrame | None = None) -> DataFrame:
    """First and last real stamp; else the ends of the path; else 0."""
    own = records.groupBy("log_id", "source").agg(
        F.min(F.when(F.col("has_time"), F.col("ts_us"))).alias("s"),
        F.max(F.when(F.col("has_time"), F.col("ts_us"))).alias("e"),
    )
    zero = F.lit(0).cast("long")
    if trajectory is None:
        return own.select("log_id", "source", F.coalesce("s", zero).alias("start_us"), F.coalesce("e", zero).alias("end_us"))
    path = trajectory.groupBy("log_id").agg(F.min("ts_us").alias("ps"), F.max("ts_us").alias("pe"))
    return own.join(path, "log_id", "left").select(
        "log_id", "source",
        F.coalesce("s", "ps", zero).alias("start_us"),
        F.coalesce("e", "pe", zero).alias("end_us"),
    )


def last_write(named: DataFrame) -> DataFrame:
    """``(log_id, name, value)`` of the latest row per name in file order."""
    return named.groupBy("log_id", "name").agg(F.max_by("value", "seq").alias("value"))


def params(records: DataFrame) -> DataFrame:
    has = lambda label: F.map_contains_key("nums", label)
    onboard = records.where((F.col("message") == "PARM") & has("Value")).select(
        "log_id", "seq", txt("Name").alias("name"), num("Value").alias("value")
    )
    link = records.where((F.col("message") == "PARAM_VALUE") & has("paramValue")).select(
        "log_id", "seq", txt("paramId").alias("name"), num("paramValue").alias("value")
    )
    return last_write(onboard.unionByName(link).where("name IS NOT NULL"))


def _plain(number: Column) -> Column:
    """A number as people write it: whole ones without a point, vast and tiny ones with an exponent."""
    size = F.abs(number)
    written = F.regexp_replace(F.regexp_replace(number.cast("string"), r"\.0E", "E"), r"E(\d)", "e+$1")
    return (
        F.when((size >= 1e21) | ((size < 1e-6) & (number != 0)), F.regexp_replace(written, "E", "e"))
        .when(number % 1 == 0, number.try_cast("decimal(22,0)").cast("string"))
        .otherwise(F.regexp_replace(number.try_cast("decimal(38,10)").cast("string"), r"0+$", ""))
    )


def modes(records: DataFrame) -> DataFrame:
    """Mode changes; a mode without a name is told by its number, whatever that is."""
    onboard = records.where(F.col("message") == "MODE").select(
        "log_id", "seq", "ts_us",
        F.coalesce(
            F.concat(F.lit("Mode "), _plain(num("Mode"))), txt("Mode"), _plain(num("ModeNum")), txt("ModeNum"), F.lit("?")
        ).alias("mode"),
    )
    link = records.where((F.col("message") == "HEARTBEAT") & num("customMode").isNotNull()).select(
        "log_id", "seq", "ts_us", F.concat(F.lit("Mode "), _plain(num("customMode"))).alias("mode")
    )
    return mode_changes(onboard.unionByName(link))


def texts(records: DataFrame) -> DataFrame:
    onboard = records.where((F.col("message") == "MSG") & txt("Message").isNotNull()).select(
        "log_id", "seq", "ts_us", txt("Message").alias("text"), F.lit(None).cast("int").alias("severity")
    )
    link = records.where((F.col("message") == "STATUSTEXT") & (F.length(txt("text")) > 0)).select(
        "log_id", "seq", "ts_us", txt("text").alias("text"), num("severity").try_cast("int").alias("severity")
    )
    return onboard.unionByName(link)


def event_log(mode_rows: DataFrame, text_rows: DataFrame) -> DataFrame:
    """Modes and texts together; order by ``ts_us, kind, seq`` puts modes first."""
    return mode_rows.select("log_id", "ts_us", F.lit("mode").alias("kind"), "seq", F.col("mode").alias("text")).unionByName(
        text_rows.select("log_id", "ts_us", F.lit("text").alias("kind"), "seq", "text")
    )


def time_sorted(rows: DataFrame) -> DataFrame:
    """Total order per series: time, then place in the file."""
    return rows.orderBy("log_id", "message", "ts_us", "seq")


def interval(bounds: DataFrame, start_sec: float | None, end_sec: float | None) -> DataFrame:
    """``(log_id, t0, t1)`` from seconds into the log; clamped, ends put in order."""
    def at(seconds: float | None, fallback: str) -> Column:
        if seconds is None:
            return F.col(fallback)
        raw = F.col("start_us") + round_half_up(F.lit(float(seconds)) * 1e6).cast("long")
        return F.least(F.greatest(raw, F.col("start_us")), F.col("end_us"))

    a, b = at(start_sec, "start_us"), at(end_sec, "end_us")
    return bounds.select("log_id", F.least(a, b).alias("t0"), F.greatest(a, b).alias("t1"))
