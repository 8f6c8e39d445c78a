"""Logs and plan files written from the driver's tables, then read back.

Spark encodes each run of events as the bytes of a log (or the text of a plan);
reading it must give the events again.  A log holds the events of one bucket and
stretch of event numbers, so there are more logs, not longer ones, in more data.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks.registry import check, rounded
from checks.views import spark_sql, view
from flightlake.operators import tables
from flightlake.operators.tables import num, txt
from flightlake.sources import dataflash, planfile, tlog
from flightlake.sources.files import ingest_errors
from flightlake.sources.tables import read_by_message, write_by_message
from flightlake.scale import scratch_path

STRETCH = 400

# The declared layouts of the written logs.
DECLARED = (
    (130, "GPS", "QLLen", "TimeUS,Lat,Lng,Alt,Tag"),
    (131, "STAT", "Bh", "Kind, Delta"),
    (132, "XYZ", "B", "One"),
)

_WHOLE = f"""
    SELECT t.log_id || '-' || CAST(floor(t.seq / {STRETCH}) AS STRING) AS log_id, t.seq, t.ts_us, t.message, CAST(floor(p.lat * 10) AS BIGINT) AS lat10, CAST(floor(p.lon * 10) AS BIGINT) AS lon10,
           CAST(floor(coalesce(t.value, 0) * 10) AS BIGINT) AS alt10
    FROM telemetry t JOIN positions p ON p.seq = t.seq"""
# How DuckDB says the same (a bigint log number prints without decimals).
_WHOLE_DUCK = _WHOLE.replace(f"CAST(floor(t.seq / {STRETCH}) AS STRING)", f"CAST(t.seq // {STRETCH} AS VARCHAR)")


def _digits(value: Column, size: int) -> Column:
    return F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(2 * size))


def big(value: Column, size: int) -> Column:
    """Hex of a big-endian integer."""
    return _digits(value, size)


def little(value: Column, size: int) -> Column:
    """Hex of a little-endian integer."""
    h = _digits(value, size)
    return F.concat(*[F.substring(h, 2 * (size - 1 - i) + 1, 2) for i in range(size)])


def declaration(msg_type: int, name: str, form: str, labels: str) -> str:
    body = struct.pack("<BB4s16s64s", msg_type, 0, name.encode(), form.encode(), labels.encode())
    return (b"\xa3\x95\x80" + body).hex().upper()


def _joined(rows: DataFrame, head: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "hex"))), lambda x: x["hex"])
    return rows.groupBy("log_id").agg(F.unhex(F.concat(F.lit(head), F.array_join(parts, ""))).alias("content"))


def onboard_logs(spark, d) -> DataFrame:
    """GPS rows and clockless STAT rows, with stray bytes and an undeclared type between."""
    rows = spark_sql(spark, d, _WHOLE)
    gps = F.concat(
        F.lit("A39582"), little(F.col("ts_us"), 8), little(F.col("lat10") * 1000000, 4), little(F.col("lon10") * 1000000, 4),
        little(F.col("alt10") * 10, 4), F.rpad(F.hex(F.encode(F.substring("message", 1, 4), "US-ASCII")), 8, "0"),
    )
    stat = F.concat(F.lit("A39583"), little(F.col("seq") % 256, 1), little(F.col("seq") % 3000 - 1500, 2))
    noise = F.when(F.col("seq") % 5 == 0, "00A3FF").when(F.col("seq") % 5 == 1, "A395F00102").otherwise("")
    head = "FF" + "".join(declaration(*d) for d in DECLARED) + declaration(130, "LATE", "B", "No")
    return _joined(rows.select("log_id", "seq", F.concat(gps, noise, stat).alias("hex")), head)


_FRAMES = f"WITH w AS ({_WHOLE_DUCK})"


@check("src02_frames", f"""{_FRAMES}
    SELECT log_id, CAST(t AS BIGINT) AS msg_type, CAST(CASE WHEN t = 128 THEN 4 ELSE count(*) END AS BIGINT) AS n, CAST(CASE t WHEN 128 THEN 86 WHEN 130 THEN 24 ELSE 3 END AS BIGINT) AS body_bytes
    FROM w, (VALUES (128), (130), (131)) AS v(t) GROUP BY log_id, t""")
def src02(spark, d):
    framed = dataflash.frames(onboard_logs(spark, d))
    return rounded(framed.groupBy("log_id", "msg_type").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.octet_length("body")).alias("body_bytes")
    ))


@check("src02_ingest_errors", f"""{_FRAMES}
    SELECT log_id, CAST(1 + sum(CASE seq % 5 WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 0 END) AS VARCHAR) || ' bytes outside records' AS reason FROM w GROUP BY log_id""")
def src02b(spark, d):
    logs = onboard_logs(spark, d)
    return ingest_errors(logs, dataflash.framed_bytes(dataflash.frames(logs)))


@check("src03_formats", f"""{_FRAMES}
    SELECT DISTINCT log_id, CAST(t AS BIGINT) AS msg_type, name, format, labels, CAST(size AS BIGINT) AS body_size
    FROM w, (VALUES (130, 'GPS', 'QLLen', 'TimeUS|Lat|Lng|Alt|Tag', 24), (131, 'STAT', 'Bh', 'Kind|Delta', 3), (132, 'XYZ', 'B', 'One', 1)) AS v(t, name, format, labels, size)""")
def src03(spark, d):
    found = dataflash.formats(dataflash.frames(onboard_logs(spark, d)))
    return rounded(found.select("log_id", "msg_type", "name", "format", F.array_join("labels", "|").alias("labels"), "body_size"))


_GPS = f"""{_FRAMES}
    SELECT log_id, ts_us, round(lat10 / 10.0, 6) + 0.0 AS lat, round(lon10 / 10.0, 6) + 0.0 AS lon, round(alt10 / 10.0, 6) + 0.0 AS alt, substr(message, 1, 4) AS tag, CAST(ts_us AS DOUBLE) AS clock FROM w"""


def _gps(records: DataFrame) -> DataFrame:
    return rounded(records.where("message = 'GPS'").select(
        "log_id", "ts_us", num("Lat").alias("lat"), num("Lng").alias("lon"), num("Alt").alias("alt"), txt("Tag").alias("tag"), num("TimeUS").alias("clock")
    ))


@check("src04_records", _GPS)
def src04(spark, d):
    return _gps(dataflash.read_dataflash(onboard_logs(spark, d)))


@check("src04_records_in_ranges", _GPS)
def src04b(spark, d):
    """The same logs cut into byte ranges that fall inside records."""
    return _gps(dataflash.read_dataflash(onboard_logs(spark, d), range_bytes=3001))


@check("src04_clockless_rows", f"""{_FRAMES}
    SELECT log_id, ts_us, FALSE AS has_time, CAST(seq % 256 AS DOUBLE) AS kind, CAST(seq % 3000 - 1500 AS DOUBLE) AS delta FROM w""")
def src04c(spark, d):
    rows = dataflash.read_dataflash(onboard_logs(spark, d), range_bytes=3001).where("message = 'STAT'")
    return rows.select("log_id", "ts_us", "has_time", num("Kind").alias("kind"), num("Delta").alias("delta"))


# Two messages, one of them redefined by a higher layer.
DIALECT = (
    (33, "GLOBAL_POSITION_INT", "timeBootMs", "uint32_t", 0, 4, 0, 1),
    (33, "GLOBAL_POSITION_INT", "lat", "int32_t", 4, 4, 0, 1),
    (33, "GLOBAL_POSITION_INT", "lon", "int32_t", 8, 4, 0, 1),
    (33, "GLOBAL_POSITION_INT", "alt", "int32_t", 12, 4, 0, 1),
    (33, "GLOBAL_POSITION_INT", "relativeAlt", "int32_t", 16, 4, 0, 1),
    (33, "GLOBAL_POSITION_INT", "vx", "int16_t", 20, 2, 0, 1),
    (33, "GLOBAL_POSITION_INT", "vy", "int16_t", 22, 2, 0, 1),
    (33, "GLOBAL_POSITION_INT", "vz", "int16_t", 24, 2, 0, 1),
    (33, "GLOBAL_POSITION_INT", "hdg", "uint16_t", 26, 2, 0, 1),
    (253, "OLD_TEXT", "text", "char[]", 0, 1, 50, 0),
    (253, "STATUSTEXT", "severity", "uint8_t", 0, 1, 0, 1),
    (253, "STATUSTEXT", "text", "char[]", 1, 1, 50, 1),
    (253, "STATUSTEXT", "numbers", "uint8_t[]", 51, 1, 4, 1),
)
_DIALECT_SCHEMA = "msg_id int, msg_name string, field string, type string, offset int, size int, array_len int, layer int"


def link_logs(spark, d) -> DataFrame:
    """Position frames (short ones, signed ones, old-style ones) and texts, with stray bytes."""
    rows = spark_sql(spark, d, _WHOLE)
    full = F.concat(
        little(F.col("seq"), 4), little(F.col("lat10") * 1000000, 4), little(F.col("lon10") * 1000000, 4), little(F.col("alt10"), 4),
        little(F.col("alt10"), 4), little(F.col("seq") % 200 - 100, 2), F.lit("0000"), F.lit("0000"), F.lit("0000"),
    )
    zeros = F.col("seq") % 3 == 0  # trailing zero bytes left out
    payload = F.when(zeros, F.substring(full, 1, 44)).otherwise(full)
    size = F.when(zeros, F.lit("16")).otherwise(F.lit("1C"))
    stamp = big(F.col("ts_us"), 8)
    signed = F.col("seq") % 4 == 0
    modern = F.concat(
        stamp, F.lit("FD"), size, F.when(signed, "01").otherwise("00"), F.lit("00000101210000"), payload, F.lit("1234"),
        F.when(signed, "00" * 13).otherwise(""),
    )
    old = F.concat(stamp, F.lit("FE"), size, F.lit("00010121"), payload, F.lit("1234"))
    frame = F.when(F.col("seq") % 7 == 0, old).otherwise(modern)
    # A stray byte moves the stamp's last byte to where the frame mark is sought.
    safe = ~(F.col("ts_us") % 256).isin(0xFD, 0xFE)
    stray = F.when((F.col("seq") % 5 == 0) & safe, "00").otherwise("")
    said = F.concat(F.lit("06"), F.rpad(F.hex(F.encode(F.col("message"), "US-ASCII")), 100, "0"))
    text = F.concat(stamp, F.lit("FD33000000" + "0101FD0000"), said, F.lit("1234"))
    unknown = F.concat(stamp, F.lit("FD0200000001010F27001122" + "1234"))
    return _joined(rows.select("log_id", "seq", F.concat(stray, frame, text, unknown).alias("hex")), "")


_LINK = f"""{_FRAMES}
    SELECT log_id, ts_us, CAST(lat10 * 1000000 AS DOUBLE) AS lat, CAST(alt10 AS DOUBLE) AS alt, CAST(seq % 200 - 100 AS DOUBLE) AS vx, CAST(0 AS DOUBLE) AS hdg FROM w"""


def _link(records: DataFrame) -> DataFrame:
    return records.where("message = 'GLOBAL_POSITION_INT'").select(
        "log_id", "ts_us", num("lat").alias("lat"), num("relativeAlt").alias("alt"), num("vx").alias("vx"), num("hdg").alias("hdg")
    )


def _dialect(spark) -> DataFrame:
    return spark.createDataFrame(list(DIALECT), _DIALECT_SCHEMA)


@check("src05_frames", f"""{_FRAMES}
    SELECT log_id, CAST(m AS BIGINT) AS msg_id, CAST(count(*) AS BIGINT) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us FROM w, (VALUES (33), (253), (9999)) AS v(m) GROUP BY log_id, m""")
def src05(spark, d):
    framed = tlog.frames(link_logs(spark, d))
    return rounded(framed.groupBy("log_id", "msg_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")
    ))


@check("src05_ingest_errors", f"""{_FRAMES}
    SELECT log_id, CAST(17 + count(*) FILTER (seq % 5 = 0 AND ts_us % 256 NOT IN (253, 254)) AS VARCHAR) || ' bytes outside records' AS reason FROM w GROUP BY log_id""")
def src05b(spark, d):
    """Stray bytes, and what is left of a last frame that the end of the log has cut short."""
    logs = link_logs(spark, d).withColumn("content", F.expr("substring(content, 1, octet_length(content) - 5)"))
    return ingest_errors(logs, tlog.framed_bytes(tlog.frames(logs)))


@check("src12_one_type_per_name", f"""{_FRAMES}, late AS (SELECT log_id, max(seq) AS last FROM w GROUP BY log_id)
    SELECT w.log_id, 'STAT' AS message, 'Level' AS field, CAST(w.seq % 100 AS DOUBLE) AS value FROM w JOIN late ON late.log_id = w.log_id WHERE w.seq * 2 > last
    UNION ALL SELECT w.log_id, 'STAT', 'Level', CAST(w.seq % 100 AS DOUBLE) FROM w JOIN late ON late.log_id = w.log_id WHERE w.seq * 2 <= last AND w.seq % 4 = 0""")
def src12_types(spark, d):
    """A type of a name declared again late in its log replaces the one before, also in ranges it is not seen in."""
    rows = spark_sql(spark, d, _WHOLE)
    late = rows.groupBy("log_id").agg(F.max("seq").alias("last"))
    rows = rows.join(late, "log_id")
    old = F.concat(F.lit("A39583"), little(F.col("seq") % 256, 1), little(F.col("seq") % 3000 - 1500, 2))
    new = F.concat(F.lit("A39590"), little(F.col("seq") % 100, 1))
    both = F.when(F.col("seq") * 2 > F.col("last"), new).when(F.col("seq") % 4 == 0, F.concat(old, new)).otherwise(old)
    # The old type opens the log, so that its first record comes first whatever the rows are.
    head = "".join(declaration(*x) for x in (DECLARED[1], (144, "STAT", "B", "Level"))) + "A395830000" + "00"
    logs = _joined(rows.select("log_id", "seq", both.alias("hex")), head)
    found = tables.samples(dataflash.read_dataflash(logs, range_bytes=1009))
    return found.select("log_id", "message", "field", "value")


@check("src06_records", _LINK)
def src06(spark, d):
    return _link(tlog.read_tlog(link_logs(spark, d), _dialect(spark)))


@check("src06_records_in_ranges", _LINK)
def src06b(spark, d):
    return _link(tlog.read_tlog(link_logs(spark, d), _dialect(spark), range_bytes=5003))


@check("src07_redefined_message", f"{_FRAMES} SELECT log_id, ts_us, 'STATUSTEXT' AS message, message AS text, CAST(6 AS DOUBLE) AS severity FROM w")
def src07(spark, d):
    records = tlog.read_tlog(link_logs(spark, d), _dialect(spark)).where("msg_type = 253")
    return records.select("log_id", "ts_us", "message", txt("text").alias("text"), num("severity").alias("severity"))


# --- plan files -------------------------------------------------------------------

_PLAN_ROWS = f"""
    SELECT m.log_id || '-' || CAST(floor(m.file_seq / {STRETCH}) AS STRING) AS log_id, m.log_id AS bucket, m.file_seq, m.seq, m.command,
           CAST(floor(lat * 10) AS BIGINT) AS lat10, CAST(floor(lon * 10) AS BIGINT) AS lon10 FROM mission_items m"""
_PLAN_DUCK = _PLAN_ROWS.replace(f"CAST(floor(m.file_seq / {STRETCH}) AS STRING)", f"CAST(m.file_seq // {STRETCH} AS VARCHAR)")
_ROUTE = "command IN (16,17,18,19,21,22,30,31,36,82,84,85,92,94,188,189)"


def _plans(rows: DataFrame, line: Column, head: str, tail: str, sep: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("file_seq", line.alias("line")))), lambda x: x["line"])
    files = rows.groupBy("log_id").agg(F.concat(F.lit(head), F.array_join(lines, sep), F.lit(tail)).alias("content"))
    return files.withColumn("size", F.octet_length("content").cast("long"))


def text_plans(spark, d) -> DataFrame:
    """Logs of bucket 3 have one line a field short."""
    rows = spark_sql(spark, d, _PLAN_ROWS)
    s = lambda c: F.col(c).cast("string")
    spot = lambda c: (F.col(c) / 10).cast("string")
    short = (F.col("bucket") == "3") & (F.col("file_seq") % 50 == 7)
    line = F.concat_ws(
        "\t", s("seq"), F.lit("0"), F.lit("3"), F.when((F.col("seq") == 0) & (F.col("command") == 16), F.lit("0")).otherwise(s("command")),
        *[F.lit("0.0")] * 4, spot("lat10"), spot("lon10"), F.lit("25.5"), F.when(~short, F.lit("1")),
    )
    line = F.when(F.col("file_seq") % 4 == 0, F.concat(F.lit("# note\r\n\r\n  "), line, F.lit(" "))).otherwise(line)
    return _plans(rows, line, "﻿\r\nQGC WPL 110\r\n", "\r\n", "\r\n")


_LAST = """SELECT log_id, seq, CAST(command AS BIGINT) AS command, lat10 / 10.0 AS lat, lon10 / 10.0 AS lon, {alt} AS alt, CAST(3 AS BIGINT) AS frame FROM (
        SELECT *, row_number() OVER (PARTITION BY log_id, seq ORDER BY file_seq DESC) AS k FROM w WHERE {route} AND NOT (lat10 = 0 AND lon10 = 0) AND {rest}) l WHERE k = 1"""


@check("src08_text_plans", f"""WITH r AS ({_PLAN_DUCK}), w AS (SELECT * FROM r WHERE log_id NOT IN (SELECT log_id FROM r WHERE bucket = '3' AND file_seq % 50 = 7))
    {_LAST.format(alt='CAST(25.5 AS DOUBLE)', route=_ROUTE, rest='TRUE')}""")
def src08(spark, d):
    waypoints, _ = planfile.parse_plans(text_plans(spark, d))
    return rounded(waypoints.withColumn("seq", F.col("seq").cast("long")))


@check("src08_odd_numbers", f"""WITH r AS ({_PLAN_DUCK}),
    w AS (SELECT *, CASE file_seq % 5 WHEN 1 THEN seq + 0.5 WHEN 2 THEN 1e300 ELSE CAST(seq AS DOUBLE) END AS no FROM r)
    SELECT log_id, no AS seq, lat FROM (
        SELECT log_id, no, lat10 / 10.0 AS lat, row_number() OVER (PARTITION BY log_id, no ORDER BY file_seq DESC) AS k
        FROM w WHERE {_ROUTE} AND NOT (lat10 = 0 AND lon10 = 0)) l WHERE k = 1""")
def src08c(spark, d):
    """Numbers that are not whole, or beyond any integer, each stand for an item of their own."""
    rows = spark_sql(spark, d, _PLAN_ROWS)
    s = lambda c: F.col(c).cast("string")
    at = F.col("file_seq") % 5
    number = F.when(at == 1, F.concat(s("seq"), F.lit(".5"))).when(at == 2, F.lit("1e300")).otherwise(s("seq"))
    spot = lambda c: (F.col(c) / 10).cast("string")
    line = F.concat_ws("\t", number, F.lit("0"), F.lit("3"), s("command"), *[F.lit("0")] * 4, spot("lat10"), spot("lon10"), F.lit("1"), F.lit("1"))
    waypoints, _ = planfile.parse_plans(_plans(rows, line, "QGC WPL 110\n", "", "\n"))
    return waypoints.select("log_id", "seq", "lat")


@check("src08_outcome", f"""WITH r AS ({_PLAN_DUCK}), bad AS (SELECT log_id FROM r WHERE bucket = '3' AND file_seq % 50 = 7 GROUP BY log_id),
    w AS (SELECT * FROM r WHERE log_id NOT IN (SELECT log_id FROM bad))
    SELECT l.log_id, 'text' AS kind, l.log_id IN (SELECT log_id FROM bad) AS rejected, coalesce(n, 0) AS n_waypoints
    FROM (SELECT DISTINCT log_id FROM r) l LEFT JOIN (SELECT log_id, count(DISTINCT seq) AS n FROM w WHERE {_ROUTE} AND NOT (lat10 = 0 AND lon10 = 0) GROUP BY log_id) c ON c.log_id = l.log_id""")
def src08b(spark, d):
    _, outcome = planfile.parse_plans(text_plans(spark, d))
    return outcome.select("log_id", "kind", F.col("reason").contains("where a waypoint has 12").alias("rejected"), "n_waypoints").fillna(False, ["rejected"])


def json_plans(spark, d) -> DataFrame:
    """Simple items, positions in either place, nulls, and complex items around some."""
    rows = spark_sql(spark, d, _PLAN_ROWS)
    n = lambda c: (F.col(c) / 10).cast("string")
    lost = F.col("file_seq") % 9 == 4
    lat = F.when(lost, F.lit("null")).otherwise(n("lat10"))
    params = F.concat(F.lit('"params":[0,0,0,null,'), lat, F.lit(","), n("lon10"), F.lit(",7]"))
    place = F.concat(F.lit('"params":[1,2,3,4,5,6,7],"coordinate":['), lat, F.lit(","), n("lon10"), F.lit(",7]"))
    item = F.concat(
        F.lit('{"type":"SimpleItem","frame":3,"command":'), F.col("command").cast("string"), F.lit(',"doJumpId":'),
        (F.col("seq") + 1).cast("string"), F.lit(","), F.when(F.col("file_seq") % 2 == 0, params).otherwise(place), F.lit("}"),
    )
    wrapped = F.concat(F.lit('{"type":"ComplexItem","TransectStyleComplexItem":{"Items":['), item, F.lit("]}}"))
    empty = F.lit(',{"type":"survey","TransectStyleComplexItem":{"Items":[]}}')
    line = F.when(F.col("file_seq") % 5 == 0, wrapped).otherwise(item)
    line = F.when(F.col("file_seq") % 7 == 0, F.concat(line, empty)).otherwise(line)
    head = '  {"fileType":"Plan","mission":{"plannedHomePosition":[10.5,-20.25,null],"items":['
    return _plans(rows, line, head, "]}}", ",")


@check("src09_json_plans", f"""WITH w AS (SELECT * REPLACE (seq + 1 AS seq) FROM ({_PLAN_DUCK}) r)
    {_LAST.format(alt='CAST(7 AS DOUBLE)', route=_ROUTE, rest='file_seq % 9 <> 4')}
    UNION ALL SELECT DISTINCT log_id, CAST(0 AS BIGINT), CAST(16 AS BIGINT), CAST(10.5 AS DOUBLE), CAST(-20.25 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS BIGINT) FROM w""")
def src09(spark, d):
    waypoints, _ = planfile.parse_plans(json_plans(spark, d))
    return rounded(waypoints.withColumn("seq", F.col("seq").cast("long")))


@check("src10_unreadable_items", f"""WITH w AS ({_PLAN_DUCK})
    SELECT log_id, 'json' AS kind, CAST(count(*) FILTER ({_ROUTE} AND file_seq % 9 = 4) + count(*) FILTER (file_seq % 7 = 0) AS BIGINT) AS unreadable FROM w GROUP BY log_id""")
def src10(spark, d):
    _, outcome = planfile.parse_plans(json_plans(spark, d))
    return outcome.where("reason IS NULL").select("log_id", "kind", "unreadable")


@check("src11_plan_kinds", """
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'text' WHEN 2 THEN 'other' ELSE 'other' END AS kind,
           CASE doc_id % 4 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'rejected' ELSE 'not a mission file' END AS reason FROM documents""")
def src11(spark, d):
    """Texts that are no plans, some with a plan's first characters."""
    head = F.when(F.col("doc_id") % 4 == 0, "﻿ { ").when(F.col("doc_id") % 4 == 1, "\nQGC WPL 110\n").when(F.col("doc_id") % 4 == 2, "# ").otherwise("QGC ")
    files = spark_sql(spark, d, "SELECT doc_id, text FROM documents").select(
        F.col("doc_id").alias("log_id"), F.concat(head, F.coalesce("text", F.lit("")), F.lit("\nx")).alias("content")
    ).withColumn("size", F.octet_length("content").cast("long"))
    _, outcome = planfile.parse_plans(files)
    reason = F.when(F.col("kind") == "text", "rejected").otherwise(F.col("reason"))
    return outcome.select(F.col("log_id").alias("doc_id"), "kind", reason.alias("reason"))


@check("snk01_write_by_message", "SELECT log_id, message, CAST(count(*) AS BIGINT) AS n, CAST(count(value) AS BIGINT) AS known, min(ts_us) AS first_us FROM telemetry GROUP BY log_id, message")
def snk01(spark, d):
    path = scratch_path(spark, "by-message")
    write_by_message(view(spark, d, "telemetry"), path)
    rows = read_by_message(spark, path)
    return rows.groupBy("log_id", "message").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("known"), F.min("ts_us").alias("first_us"))
