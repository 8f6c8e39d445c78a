"""What the analyses look for, as small tables matched against the catalog.

Detection reads only the catalog (one row per log and field), never samples.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightlake.functions.values import captured_number, trailing_number

RAD = 180 / math.pi

# Names of the three axes of a compass.
COMPASS_AXES = (("MagX", "MagY", "MagZ"), ("xmag", "ymag", "zmag"))

# Load signals, best first (message, field, kind, unit).
DRIVERS = (
    ("BAT", "Curr", "current", "A"),
    ("BAT", "Cur", "current", "A"),
    ("BATTERY_STATUS", "currentBattery", "current", "cA"),
    ("SYS_STATUS", "currentBattery", "current", "cA"),
    ("VFR_HUD", "throttle", "throttle", "%"),
    ("CTUN", "ThO", "throttle", ""),
)

# Channel banks (message pattern, field pattern, kind, parameter prefix).
BANKS = (
    (r"^RCOU", r"^C(\d+)$", "output", "SERVO"),
    (r"^SERVO_OUTPUT_RAW$", r"^servo(\d+)Raw$", "output", "SERVO"),
    (r"^RCIN", r"^C(\d+)$", "input", "RC"),
    (r"^RC_CHANNELS(_RAW)?$", r"^chan(\d+)Raw$", "input", "RC"),
)

# Commanded and achieved series
# (label, message, field, scale, message, field, scale, unit, wrap).
PAIRS = (
    ("Roll rate", "RATE", "RDes", 1.0, "RATE", "R", 1.0, "deg/s", 0.0),
    ("Pitch rate", "RATE", "PDes", 1.0, "RATE", "P", 1.0, "deg/s", 0.0),
    ("Yaw rate", "RATE", "YDes", 1.0, "RATE", "Y", 1.0, "deg/s", 0.0),
    ("Vertical accel", "RATE", "ADes", 1.0, "RATE", "A", 1.0, "m/s²", 0.0),
    ("Roll", "ATT", "DesRoll", 1.0, "ATT", "Roll", 1.0, "deg", 0.0),
    ("Pitch", "ATT", "DesPitch", 1.0, "ATT", "Pitch", 1.0, "deg", 0.0),
    ("Yaw", "ATT", "DesYaw", 1.0, "ATT", "Yaw", 1.0, "deg", 360.0),
    ("PID roll", "PIDR", "Tar", 1.0, "PIDR", "Act", 1.0, "", 0.0),
    ("PID pitch", "PIDP", "Tar", 1.0, "PIDP", "Act", 1.0, "", 0.0),
    ("PID yaw", "PIDY", "Tar", 1.0, "PIDY", "Act", 1.0, "", 0.0),
    ("PID steering", "PIDS", "Tar", 1.0, "PIDS", "Act", 1.0, "", 0.0),
    ("Roll (nav)", "NAV_CONTROLLER_OUTPUT", "navRoll", 1.0, "ATTITUDE", "roll", RAD, "deg", 0.0),
    ("Pitch (nav)", "NAV_CONTROLLER_OUTPUT", "navPitch", 1.0, "ATTITUDE", "pitch", RAD, "deg", 0.0),
    ("Heading", "NAV_CONTROLLER_OUTPUT", "targetBearing", 1.0, "VFR_HUD", "heading", 1.0, "deg", 360.0),
    ("Yaw (target)", "POSITION_TARGET_GLOBAL_INT", "yaw", RAD, "ATTITUDE", "yaw", RAD, "deg", 360.0),
    ("Velocity north", "POSITION_TARGET_GLOBAL_INT", "vx", 1.0, "GLOBAL_POSITION_INT", "vx", 0.01, "m/s", 0.0),
    ("Velocity east", "POSITION_TARGET_GLOBAL_INT", "vy", 1.0, "GLOBAL_POSITION_INT", "vy", 0.01, "m/s", 0.0),
    ("Velocity down", "POSITION_TARGET_GLOBAL_INT", "vz", 1.0, "GLOBAL_POSITION_INT", "vz", 0.01, "m/s", 0.0),
)

# Scatter presets, first spelling of a label wins
# (label, x message, x field, x scale, x unit, y message, y field, y scale, y unit, meaning of the slope).
SCATTERS = (
    ("Battery internal resistance", "BAT", "Curr", 1.0, "A", "BAT", "Volt", 1.0, "V", "internal-resistance"),
    ("Battery internal resistance", "SYS_STATUS", "currentBattery", 0.01, "A", "SYS_STATUS", "voltageBattery", 0.001, "V", "internal-resistance"),
    ("Throttle vs speed", "VFR_HUD", "throttle", 1.0, "%", "VFR_HUD", "groundspeed", 1.0, "m/s", None),
    ("Throttle vs speed", "CTUN", "ThO", 1.0, "", "GPS", "Spd", 1.0, "m/s", None),
    ("Throttle vs current", "VFR_HUD", "throttle", 1.0, "%", "SYS_STATUS", "currentBattery", 0.01, "A", None),
    ("Throttle vs current", "CTUN", "ThO", 1.0, "", "BAT", "Curr", 1.0, "A", None),
    ("Speed vs current", "VFR_HUD", "groundspeed", 1.0, "m/s", "SYS_STATUS", "currentBattery", 0.01, "A", None),
)

# Series worth a spectrum, best first.
SPECTRUM_FIELDS = (
    ("RATE", "R"),
    ("RATE", "Y"),
    ("ATT", "Roll"),
    ("ATTITUDE", "rollspeed"),
    ("ATTITUDE", "yawspeed"),
    ("VFR_HUD", "heading"),
)
ONBOARD_SPECTRA = ("FTN1", "FTN2", "FTNS")
ONBOARD_FIELD = r"(?i)^Pk|^Fr|^En|Freq"
BATCH_SAMPLING = ("ISBH", "ISBD")


def rule_table(df: DataFrame, rows, schema: str) -> DataFrame:
    """A constant table with the place of each rule as ``rule``; always broadcast."""
    numbered = [(at, *row) for at, row in enumerate(rows)]
    return F.broadcast(df.sparkSession.createDataFrame(numbered, f"rule int, {schema}"))


def _present(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.col("n_rows") > 0)


def compass_sources(catalog: DataFrame) -> DataFrame:
    """Messages with a full compass triple, primary compass first."""
    axes = [n for triple in COMPASS_AXES for n in triple]
    has = lambda n: F.max(F.col("field") == n)
    full = [has(x) & has(y) & has(z) for x, y, z in COMPASS_AXES]
    which: Column = F.lit(None).cast("int")
    for at in reversed(range(len(full))):
        which = F.when(full[at], at).otherwise(which)
    axis = lambda i: F.element_at(F.array(*[F.lit(t[i]) for t in COMPASS_AXES]), F.col("which") + 1)
    found = (
        _present(catalog).where(F.col("field").isin(*axes))
        .groupBy("log_id", "message").agg(which.alias("which")).where("which IS NOT NULL")
    )
    order = Window.partitionBy("log_id").orderBy(trailing_number(F.col("message")), F.collate("message", "UNICODE"))
    return found.select(
        "log_id", "message", axis(0).alias("x_field"), axis(1).alias("y_field"), axis(2).alias("z_field"),
        F.row_number().over(order).alias("pos"),
    )


def driver_sources(catalog: DataFrame) -> DataFrame:
    rules = rule_table(catalog, DRIVERS, "message string, field string, kind string, unit string")
    order = Window.partitionBy("log_id").orderBy("rule")
    return _present(catalog).join(rules, ["message", "field"]).select(
        "log_id", "message", "field", "kind", "unit", F.row_number().over(order).alias("pos")
    )


def actuator_channels(catalog: DataFrame) -> DataFrame:
    """Channels of every bank with at least two, outputs before inputs."""
    kind, prefix, channel = (F.lit(None).cast(t) for t in ("string", "string", "int"))
    for message_re, field_re, k, p in reversed(BANKS):
        hit = F.col("message").rlike(message_re)
        kind = F.when(hit, k).otherwise(kind)
        prefix = F.when(hit, p).otherwise(prefix)
        channel = F.when(hit, captured_number(F.col("field"), field_re)).otherwise(channel)
    found = (
        _present(catalog)
        .select("log_id", "message", "field", kind.alias("kind"), prefix.alias("prefix"), channel.alias("channel"))
        .where("channel IS NOT NULL")
    )
    bank = Window.partitionBy("log_id", "message")
    return found.withColumn("n_channels", F.count(F.lit(1)).over(bank)).where("n_channels >= 2")


def actuator_banks(catalog: DataFrame) -> DataFrame:
    order = Window.partitionBy("log_id").orderBy(F.desc("kind"), F.collate("message", "UNICODE"))
    return (
        actuator_channels(catalog)
        .groupBy("log_id", "message", "kind", "prefix").agg(F.count(F.lit(1)).alias("n_channels"))
        .withColumn("pos", F.row_number().over(order))
    )


def tracking_pairs(catalog: DataFrame) -> DataFrame:
    """Pairs with both sides present; those that never move come last, flagged."""
    rules = rule_table(
        catalog, PAIRS,
        "label string, des_message string, des_field string, des_scale double, "
        "act_message string, act_field string, act_scale double, unit string, wrap double",
    )
    side = lambda s: _present(catalog).select(
        "log_id", F.col("message").alias(f"{s}_message"), F.col("field").alias(f"{s}_field"), F.col("varies").alias(f"{s}_varies")
    )
    both = (
        side("des").join(rules, ["des_message", "des_field"])
        .join(side("act"), ["log_id", "act_message", "act_field"])
        .withColumn("varies", F.col("des_varies") & F.col("act_varies"))
    )
    order = Window.partitionBy("log_id").orderBy(F.desc("varies"), "rule")
    return both.select(
        "log_id", "label", "des_message", "des_field", "des_scale", "act_message", "act_field", "act_scale",
        "unit", "wrap", "varies", F.row_number().over(order).alias("pos"),
    )


def scatter_presets(catalog: DataFrame) -> DataFrame:
    rules = rule_table(
        catalog, SCATTERS,
        "label string, x_message string, x_field string, x_scale double, x_unit string, "
        "y_message string, y_field string, y_scale double, y_unit string, meaning string",
    )
    side = lambda s: _present(catalog).select(
        "log_id", F.col("message").alias(f"{s}_message"), F.col("field").alias(f"{s}_field")
    )
    both = side("x").join(rules, ["x_message", "x_field"]).join(side("y"), ["log_id", "y_message", "y_field"])
    cols = ["rule", "x_message", "x_field", "x_scale", "x_unit", "y_message", "y_field", "y_scale", "y_unit", "meaning"]
    first = both.groupBy("log_id", "label").agg(F.min_by(F.struct(*cols), F.col("rule")).alias("p"))
    order = Window.partitionBy("log_id").orderBy("rule")
    return first.select("log_id", "label", "p.*").withColumn("pos", F.row_number().over(order)).drop("rule")


def onboard_spectra(catalog: DataFrame) -> DataFrame:
    """Fields of results the vehicle transformed itself."""
    return (
        _present(catalog)
        .where(F.col("message").isin(*ONBOARD_SPECTRA) & F.col("field").rlike(ONBOARD_FIELD))
        .select("log_id", "message", "field", "position")
    )


def batch_sampling(catalog: DataFrame) -> DataFrame:
    has = [F.max(F.col("message") == m) for m in BATCH_SAMPLING]
    return _present(catalog).groupBy("log_id").agg((has[0] & has[1]).alias("has_batch"))


def spectrum_field(catalog: DataFrame, selected: list[tuple[str, str]] | None = None) -> DataFrame:
    """One series per log: preferred, else selected, else the first by name."""
    from flightlake.operators.select import signal_fields

    rank: Column = F.lit(None).cast("int")
    for at, (message, name) in reversed(list(enumerate([*SPECTRUM_FIELDS, *(selected or [])]))):
        rank = F.when((F.col("message") == message) & (F.col("field") == name), at).otherwise(rank)
    pick = F.struct("message", "field")
    signal = signal_fields(catalog).groupBy("log_id").agg(F.min_by(pick, F.struct("message", "position")).alias("first"))
    liked = catalog.withColumn("rank", rank).groupBy("log_id").agg(F.min_by(pick, F.col("rank")).alias("liked"))
    return (
        liked.join(signal, "log_id", "left")
        .select("log_id", F.coalesce("liked", "first").alias("ref"))
        .where("ref IS NOT NULL").select("log_id", "ref.message", "ref.field")
    )


def modules(catalog: DataFrame) -> DataFrame:
    """Which analyses each log can answer."""
    logs = catalog.select("log_id").distinct()
    flag = lambda df, name: df.select("log_id").distinct().withColumn(name, F.lit(True))
    out = logs
    for found, name in (
        (compass_sources(catalog), "compass"),
        (actuator_channels(catalog), "outputs"),
        (tracking_pairs(catalog), "tracking"),
    ):
        out = out.join(flag(found, name), "log_id", "left")
    return out.select(
        "log_id",
        *[F.lit(True).alias(n) for n in ("stats", "scatter", "spectrum")],
        *[F.coalesce(n, F.lit(False)).alias(n) for n in ("compass", "outputs", "tracking")],
    )
