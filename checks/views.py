"""Telemetry seen in the driver's tables, as SQL both engines read.

The test tables hold no logs.  Each view here presents a whole table as if it
were telemetry; the Spark queries start from these views and the oracle SQL
starts from the same text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Which message and fields an event stands for, by event number.
# (kind of log, slot, message, position, field, shape, gain, base)
FLEET = (
    ("bin", 0, "RATE", 0, "RDes", "line", 1.0, 0.0),
    ("bin", 0, "RATE", 1, "R", "late", 0.9, 0.5),
    ("bin", 0, "RATE", 2, "YDes", "flat", 0.0, 0.0),
    ("bin", 0, "RATE", 3, "Y", "line", 0.1, 0.0),
    ("bin", 1, "ATT", 0, "DesRoll", "line", 0.5, 0.0),
    ("bin", 1, "ATT", 1, "Roll", "line", 0.45, 1.0),
    ("bin", 1, "ATT", 2, "DesYaw", "turn", 37.0, 0.0),
    ("bin", 1, "ATT", 3, "Yaw", "turn", 37.0, 5.0),
    ("bin", 2, "BAT", 0, "Volt", "line", -0.01, 16.0),
    ("bin", 2, "BAT", 1, "Curr", "line", 0.5, 1.0),
    ("bin", 3, "RCOU", 0, "TimeUS", "line", 1.0, 0.0),
    ("bin", 3, "RCOU", 1, "C1", "line", 2.0, 1000.0),
    ("bin", 3, "RCOU", 2, "C2", "line", 1.5, 1200.0),
    ("bin", 3, "RCOU", 3, "C3", "flat", 0.0, 0.0),
    ("bin", 3, "RCOU", 4, "C10", "line", 1.0, 1500.0),
    ("bin", 4, "RCIN", 0, "C1", "line", 1.0, 1100.0),
    ("bin", 4, "RCIN", 1, "C2", "flat", 0.0, 1500.0),
    ("bin", 5, "MAG", 0, "MagX", "east", 300.0, 120.0),
    ("bin", 5, "MAG", 1, "MagY", "north", 300.0, -45.0),
    ("bin", 5, "MAG", 2, "MagZ", "line", 0.1, 50.0),
    ("bin", 6, "MAG2", 0, "MagX", "east", 200.0, 20.0),
    ("bin", 6, "MAG2", 1, "MagY", "north", 200.0, 10.0),
    ("bin", 6, "MAG2", 2, "MagZ", "line", 0.2, 30.0),
    ("bin", 6, "FTN1", 0, "PkAvg", "line", 0.3, 0.0),
    ("bin", 6, "FTN1", 1, "DnF", "line", 0.2, 0.0),
    ("bin", 7, "CTUN", 0, "ThO", "line", 0.01, 0.0),
    ("bin", 7, "GPS", 0, "Spd", "line", 0.2, 0.0),
    ("bin", 7, "GPS", 1, "Alt", "line", 1.0, 100.0),
    ("tlog", 0, "ATTITUDE", 0, "timeBootMs", "line", 1.0, 0.0),
    ("tlog", 0, "ATTITUDE", 1, "roll", "line", 0.01, 0.0),
    ("tlog", 0, "ATTITUDE", 2, "yaw", "line", 0.01, 0.0),
    ("tlog", 1, "NAV_CONTROLLER_OUTPUT", 0, "navRoll", "flat", 0.0, 0.0),
    ("tlog", 1, "NAV_CONTROLLER_OUTPUT", 1, "targetBearing", "turn", 37.0, 0.0),
    ("tlog", 2, "VFR_HUD", 0, "heading", "turn", 37.0, 3.0),
    ("tlog", 2, "VFR_HUD", 1, "throttle", "line", 0.2, 0.0),
    ("tlog", 2, "VFR_HUD", 2, "groundspeed", "line", 0.05, 0.3),
    ("tlog", 3, "SYS_STATUS", 0, "currentBattery", "line", 10.0, 100.0),
    ("tlog", 3, "SYS_STATUS", 1, "voltageBattery", "line", -1.0, 16000.0),
    ("tlog", 4, "SERVO_OUTPUT_RAW", 0, "servo1Raw", "line", 1.0, 1100.0),
    ("tlog", 4, "SERVO_OUTPUT_RAW", 1, "servo3Raw", "line", 2.0, 1000.0),
    ("tlog", 5, "RAW_IMU", 0, "xmag", "east", 250.0, 5.0),
    ("tlog", 5, "RAW_IMU", 1, "ymag", "north", 250.0, -5.0),
    ("tlog", 5, "RAW_IMU", 2, "zmag", "line", 0.1, 10.0),
    ("tlog", 6, "RC_CHANNELS", 0, "chan1Raw", "line", 1.0, 1200.0),
    ("tlog", 6, "GPS_RAW_INT", 0, "alt", "line", 10.0, 0.0),
    ("tlog", 7, "ISBH", 0, "N", "line", 1.0, 0.0),
    ("tlog", 7, "ISBD", 0, "N", "line", 1.0, 0.0),
)

_RULES = ", ".join(
    f"('{k}', {s}, '{m}', {p}, '{f}', '{h}', CAST({g} AS DOUBLE), CAST({b} AS DOUBLE))" for k, s, m, p, f, h, g, b in FLEET
)

#: View name to SQL; a view may use those before it.  {us} reads a stamp in microseconds.
VIEWS = {
    "telemetry": """
        SELECT CAST(user_id % 4 AS STRING) AS log_id, event_type AS message, 'value' AS field,
               event_id AS seq, {us} AS ts_us,
               CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value
        FROM events""",
    # The same rows on an hourly clock: many rows share a stamp.
    "hourly": """
        SELECT log_id, message, field, seq,
               ts_us - ts_us % 3600000000 AS ts_us, value
        FROM telemetry""",
    "clicks": "SELECT log_id, seq, ts_us, value FROM hourly WHERE message = 'click'",
    "views": "SELECT log_id, seq, ts_us, value FROM hourly WHERE message = 'view'",
    "headings": """
        SELECT log_id, message, field, seq, ts_us,
               CASE WHEN seq % 17 = 0 THEN NULL ELSE CAST((seq * 37) % 360 AS DOUBLE) END AS value
        FROM telemetry""",
    "positions": """
        SELECT log_id, seq, ts_us,
               CASE WHEN seq % 50 = 0 THEN 0.0e0 ELSE ((seq * 7) % 1200) / 10.0e0 - 60.0e0 END AS lat,
               CASE WHEN seq % 50 = 0 THEN 0.0e0 ELSE ((seq * 13) % 3000) / 10.0e0 - 150.0e0 END AS lon,
               value AS alt
        FROM telemetry""",
    "fixes": "SELECT * FROM positions WHERE NOT (lat = 0 AND lon = 0)",
    "cloud": """
        SELECT log_id, seq, ts_us,
               CASE WHEN value IS NULL THEN NULL ELSE 120 + (300 + value / 100) * cos(seq * 0.1e0) END AS x,
               -45 + (300 + seq % 7) * sin(seq * 0.1e0) AS y,
               20 + seq % 5 * 1.0e0 AS z
        FROM telemetry""",
    "mission_items": """
        SELECT log_id, seq AS file_seq, seq % 11 AS seq,
               CAST(16 + seq % 7 AS INT) AS command, lat, lon, alt, CAST(3 AS INT) AS frame
        FROM positions""",
    "fleet": f"""
        SELECT t.log_id, r.message, r.field, r.position, t.seq, t.ts_us,
               CASE WHEN t.value IS NULL THEN NULL
                    WHEN r.shape = 'flat' THEN r.base
                    WHEN r.shape = 'turn' THEN CAST((t.seq * 37) % 360 AS DOUBLE) * 0.5e0 + r.base
                    WHEN r.shape = 'east' THEN r.base + (r.gain + t.seq % 7) * cos(t.seq * 0.1e0)
                    WHEN r.shape = 'north' THEN r.base + (r.gain + t.seq % 7) * sin(t.seq * 0.1e0)
                    ELSE r.gain * t.value + r.base END AS value
        FROM telemetry t
        JOIN (SELECT * FROM (VALUES {_RULES}) AS v(kind, slot, message, position, field, shape, gain, base)) r
          ON r.slot = t.seq % 8
         AND r.kind = CASE WHEN t.log_id = '3' THEN 'tlog' ELSE 'bin' END""",
    "fleet_catalog": """
        SELECT log_id, message, field, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(value) AS BIGINT) AS n_finite,
               min(value) AS lo, max(value) AS hi, coalesce(min(value) <> max(value), FALSE) AS varies,
               min(seq) AS first_seq, min(position) AS position
        FROM fleet GROUP BY log_id, message, field""",
    # Orders per day as a demand, and the response three days later.
    "demand": """
        SELECT log_id, i, CAST(i AS DOUBLE) * 86400000000 AS ts_us, des,
               0.8e0 * lag(des, 3) OVER (PARTITION BY log_id ORDER BY i) + 2.0e0 AS act
        FROM (SELECT log_id, CAST(row_number() OVER (PARTITION BY log_id ORDER BY o_orderdate) - 1 AS BIGINT) AS i,
                     CAST(n AS DOUBLE) AS des
              FROM (SELECT o_orderpriority AS log_id, o_orderdate, count(*) AS n
                    FROM orders GROUP BY o_orderpriority, o_orderdate) d) e""",
    "pair_grid": """
        SELECT d.log_id, d.i, d.ts_us, d.des, d.act, c.n, CAST(0.5e0 AS DOUBLE) AS dt
        FROM demand d JOIN (SELECT log_id, CAST(count(*) AS BIGINT) AS n FROM demand GROUP BY log_id) c
          ON d.log_id = c.log_id""",
    # A demand that steps half way, answered with a lag.
    "step_grid": """
        SELECT p.log_id, p.i, p.n, CAST(0.01e0 AS DOUBLE) AS dt,
               CASE WHEN p.i < floor(p.n / 2) THEN 0.0e0 ELSE 10.0e0 END + p.des % 3 * 0.01e0 AS des,
               CASE WHEN p.i < floor(p.n / 2) THEN 0.0e0
                    ELSE 10.0e0 * (1 - exp(-(p.i - floor(p.n / 2)) / 20.0e0)) END + p.des % 2 * 0.001e0 AS act
        FROM pair_grid p""",
    "signal": """
        SELECT log_id, i, des AS value FROM demand""",
}


def _needed(sql: str) -> list[str]:
    wanted: set[str] = set()
    for name in reversed(list(VIEWS)):
        pattern = rf"\b{name}\b"
        if re.search(pattern, sql) or any(re.search(pattern, VIEWS[w]) for w in wanted):
            wanted.add(name)
    return [v for v in VIEWS if v in wanted]


def with_views(sql: str, us: str) -> str:
    """``sql`` with the views it uses written ahead of it."""
    needed = _needed(sql)
    body = sql.strip()
    if not needed:
        return body
    defined = ",\n".join(f"{v} AS ({VIEWS[v].format(us=us)})" for v in needed)
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {defined},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {defined},\n{body[len('WITH'):]}"
    return f"WITH {defined}\n{body}"


def duck(sql: str) -> str:
    return with_views(sql, "epoch_us(ts)")


def spark_sql(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """Run SQL over the views and the parquet tables of ``folder``."""
    text = with_views(sql, "unix_micros(CAST(ts AS TIMESTAMP))")
    for table in TABLES:
        if re.search(rf"\b{table}\b", text):
            spark.read.parquet(f"{folder}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(text)


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark_sql(spark, folder, f"SELECT * FROM {name}")
