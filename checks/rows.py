"""Selections, scalar functions, sets, orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.registry import check, rounded
from checks.views import spark_sql, view
from flightlake.functions import display, geo, values
from flightlake.operators import select, sequence, tables
from flightlake.operators.mission import command_items, in_order, is_flight_plan, route_vertices
from flightlake.sources.files import log_kind
from flightlake.sources.tlog import layered_dialect

WIDE = 1704067200000000 + 5 * 86400000000, 1704067200000000 + 20 * 86400000000


@check("p01_field", "SELECT log_id, seq, ts_us, value FROM telemetry WHERE message = 'click' AND field = 'value'")
def p01(spark, d):
    return select.field(view(spark, d, "telemetry"), "click", "value").select("log_id", "seq", "ts_us", "value")


@check("p01_fields", "SELECT log_id, message, field, seq, value FROM fleet WHERE (message = 'ATT' AND field = 'Roll') OR (message = 'BAT' AND field = 'Volt')")
def p01b(spark, d):
    chosen = select.fields(view(spark, d, "fleet"), [("ATT", "Roll"), ("BAT", "Volt"), ("NONE", "Such")])
    return chosen.select("log_id", "message", "field", "seq", "value")


@check("p02_time_window", f"SELECT log_id, seq, ts_us, value FROM hourly WHERE ts_us >= {WIDE[0]} AND ts_us <= {WIDE[1]}")
def p02(spark, d):
    return select.time_window(view(spark, d, "hourly"), *WIDE).select("log_id", "seq", "ts_us", "value")


@check("p03_known_samples", "SELECT log_id, message, CAST(count(value) AS BIGINT) AS n, sum(value) IS NOT NULL AS any_known FROM telemetry GROUP BY log_id, message")
def p03(spark, d):
    # Gaps arrive as NaN and infinities and must leave no trace in a reducer.
    raw = view(spark, d, "telemetry").withColumn(
        "value",
        F.when(F.col("value").isNull(), F.when(F.col("seq") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf"))))
        .otherwise(F.col("value")),
    )
    clean = select.known_samples(raw.withColumn("value", values.finite(F.col("value"))))
    return clean.groupBy("log_id", "message").agg(F.count("value").alias("n"), F.sum("value").isNotNull().alias("any_known"))


@check("p04_scaled", "SELECT seq, round(value * 0.01, 6) + 0.0 AS value FROM telemetry")
def p04(spark, d):
    return rounded(view(spark, d, "telemetry").select("seq", values.scaled(F.col("value"), 0.01).alias("value")))


def _search(term: str):
    def run(spark, d):
        found = select.search_fields(view(spark, d, "fleet_catalog"), term)
        return found.select(
            "log_id", "message", F.array_join("fields", ",").alias("fields"), F.array_join("hits", ",").alias("hits"), "auto_expand"
        )

    return run


_LISTED = """
    SELECT log_id, message, coalesce(string_agg(field, ',' ORDER BY position) FILTER ({shown}), '') AS fields,
           coalesce(string_agg(field, ',' ORDER BY position) FILTER ({hit}), '') AS hits, {narrow} AS auto_expand
    FROM fleet_catalog WHERE field <> 'TimeUS' GROUP BY log_id, message HAVING {kept}"""

check("p05_search_bare", _LISTED.format(
    shown="contains(lower(message), 'rol') OR contains(lower(field), 'rol')", hit="contains(lower(field), 'rol')",
    narrow="NOT contains(lower(message), 'rol')", kept="contains(lower(message), 'rol') OR count(*) FILTER (contains(lower(field), 'rol')) > 0"
))(_search(" Rol "))
check("p05_search_message", _LISTED.format(
    shown="TRUE", hit="contains(lower(field), 'mag')", narrow="FALSE", kept="contains(lower(message), 'mag')"
).replace("FROM fleet_catalog WHERE", "FROM fleet_catalog WHERE message <> 'RAW_IMU' AND") + """
    UNION ALL SELECT log_id, message, string_agg(field, ',' ORDER BY position), string_agg(field, ',' ORDER BY position), TRUE
    FROM fleet_catalog WHERE message = 'RAW_IMU' GROUP BY log_id, message""")(_search("mag"))
check("p05_search_dotted", _LISTED.format(
    shown="contains(lower(field), 'ma')", hit="contains(lower(field), 'ma')", narrow="TRUE",
    kept="contains(lower(message), 'mag') AND count(*) FILTER (contains(lower(field), 'ma')) > 0"
))(_search("MAG.Ma"))
check("p05_search_short", _LISTED.format(shown="TRUE", hit="FALSE", narrow="FALSE", kept="contains(lower(message), 'r')"))(_search("r"))
check("p05_search_empty", _LISTED.format(shown="TRUE", hit="FALSE", narrow="FALSE", kept="TRUE"))(_search("."))


_NAMED = """
    SELECT CAST(user_id % 4 AS STRING) AS log_id, event_id AS seq, upper(event_type) || '_' || CAST(user_id AS STRING) AS name, value
    FROM events"""


@check("p06_search_params", f"""
    SELECT log_id, name, arg_max(value, seq) AS value FROM ({_NAMED}) n WHERE contains(name, 'CLICK_1') GROUP BY log_id, name""")
def p06(spark, d):
    return select.search_params(tables.last_write(spark_sql(spark, d, _NAMED)), "click_1")


@check("p07_drop_message", "SELECT log_id, message, CAST(count(*) AS BIGINT) AS n FROM telemetry WHERE message <> 'view' GROUP BY log_id, message")
def p07(spark, d):
    return select.drop_message(view(spark, d, "telemetry"), "view").groupBy("log_id", "message").agg(F.count("*").alias("n"))


@check("p07_keep_selected", "SELECT log_id, message, CAST(count(*) AS BIGINT) AS n FROM fleet WHERE message IN ('ATT', 'GPS') GROUP BY log_id, message")
def p07b(spark, d):
    return select.keep_messages(view(spark, d, "fleet"), ["ATT", "GPS"]).groupBy("log_id", "message").agg(F.count("*").alias("n"))


_PREFERRED = ", ".join(f"({i}, '{m}', '{f}')" for i, (m, f) in enumerate(select.DEFAULT_FIELDS))


@check("p08_default_fields", f"""
    WITH liked AS (
        SELECT c.log_id, p.message, p.field, row_number() OVER (PARTITION BY c.log_id ORDER BY p.rank) - 1 AS pos
        FROM fleet_catalog c JOIN (VALUES {_PREFERRED}) AS p(rank, message, field) ON c.message = p.message AND c.field = p.field
    ), rest AS (
        SELECT log_id, message, field, row_number() OVER (PARTITION BY log_id ORDER BY first_seq, message, position) AS k
        FROM fleet_catalog WHERE field <> 'TimeUS' AND log_id NOT IN (SELECT log_id FROM liked)
    )
    SELECT log_id, CAST(pos AS BIGINT) AS pos, message, field FROM liked WHERE pos < 2
    UNION ALL SELECT log_id, 0, message, field FROM rest WHERE k = 1""")
def p08(spark, d):
    return rounded(select.default_fields(view(spark, d, "fleet_catalog")))


@check("p08_default_fallback", """
    SELECT log_id, CAST(0 AS BIGINT) AS pos, message, field FROM (
        SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY first_seq, message, position) AS k
        FROM fleet_catalog WHERE field <> 'TimeUS' AND message NOT IN ('ATT', 'GPS', 'BAT', 'VFR_HUD', 'ATTITUDE')) WHERE k = 1""")
def p08b(spark, d):
    others = view(spark, d, "fleet_catalog").where("message NOT IN ('ATT', 'GPS', 'BAT', 'VFR_HUD', 'ATTITUDE')")
    return rounded(select.default_fields(others))


@check("p09_fixes", "SELECT log_id, CAST(count(*) AS BIGINT) AS n, min(lat) AS south, max(lon) AS east FROM positions WHERE NOT (lat = 0 AND lon = 0) GROUP BY log_id")
def p09(spark, d):
    kept = view(spark, d, "positions").where(geo.is_fix(F.col("lat"), F.col("lon")))
    return kept.groupBy("log_id").agg(F.count("*").alias("n"), F.min("lat").alias("south"), F.max("lon").alias("east"))


@check("p10_route_vertices", """
    SELECT log_id, file_seq, seq, CAST(command AS BIGINT) AS command, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon FROM mission_items
    WHERE command IN (16,17,18,19,21,22,30,31,36,82,84,85,92,94,188,189) AND NOT (lat = 0 AND lon = 0) AND abs(lat) <= 90 AND abs(lon) <= 180""")
def p10(spark, d):
    return rounded(route_vertices(view(spark, d, "mission_items")).select("log_id", "file_seq", "seq", "command", "lat", "lon"))


_BOUNDS = "SELECT log_id, min(ts_us) AS start_us, max(ts_us) AS end_us FROM telemetry GROUP BY log_id"


@check("p11_interval", f"""
    SELECT log_id, least(greatest(start_us + 86400500000, start_us), end_us) AS t0,
           least(greatest(start_us + 864000000000000, start_us), end_us) AS t1 FROM ({_BOUNDS}) b""")
def p11(spark, d):
    return tables.interval(spark_sql(spark, d, _BOUNDS), 864000000.0, 86400.5)


@check("p11_interval_window", f"""
    SELECT t.log_id, CAST(count(*) AS BIGINT) AS n, CAST(count(value) AS BIGINT) AS known
    FROM telemetry t JOIN ({_BOUNDS}) b ON t.log_id = b.log_id
    WHERE t.ts_us BETWEEN b.start_us + 432000000000 AND b.end_us GROUP BY t.log_id""")
def p11b(spark, d):
    intervals = tables.interval(spark_sql(spark, d, _BOUNDS), 432000.0, None)
    rows = select.interval_window(view(spark, d, "telemetry"), intervals)
    return rows.groupBy("log_id").agg(F.count("*").alias("n"), F.count("value").alias("known"))


@check("p12_signal_fields", """
    SELECT log_id, message, field, n_rows FROM fleet_catalog
    WHERE field NOT IN ('TimeUS', 'TimeMS', 'timeBootMs', 'timeUsec', 'timeUnixUsec')""")
def p12(spark, d):
    return select.signal_fields(view(spark, d, "fleet_catalog")).select("log_id", "message", "field", "n_rows")


_TYPED = """
    SELECT log_id, seq, CASE WHEN seq % 4 = 0 THEN NULL ELSE CAST(seq % 4 - 1 AS DOUBLE) END AS mission_type FROM telemetry"""


@check("p13_flight_plan_rows", f"SELECT log_id, CAST(count(*) AS BIGINT) AS n FROM ({_TYPED}) t WHERE coalesce(mission_type, 0) = 0 GROUP BY log_id")
def p13(spark, d):
    return spark_sql(spark, d, _TYPED).where(is_flight_plan(F.col("mission_type"))).groupBy("log_id").agg(F.count("*").alias("n"))


_COMMANDS = """
    SELECT log_id, file_seq AS seq, CASE WHEN file_seq % 3 = 0 THEN 'MISE' ELSE 'CMD' END AS message,
           map_from_arrays(array('CNum', 'CId', 'Lat', 'Lng', 'Alt', 'Frame'),
               array(CAST(seq AS DOUBLE), CAST(command AS DOUBLE), CASE WHEN file_seq % 2 = 0 THEN lat * 1e7 ELSE lat END,
                     CASE WHEN file_seq % 2 = 0 THEN lon * 1e7 ELSE lon END, alt, CAST(frame AS DOUBLE))) AS nums
    FROM mission_items"""


@check("p14_command_items", """
    SELECT log_id, file_seq, seq, CAST(command AS BIGINT) AS command, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon, round(alt, 6) AS alt
    FROM mission_items WHERE file_seq % 3 <> 0""")
def p14(spark, d):
    return rounded(command_items(spark_sql(spark, d, _COMMANDS)).drop("frame").withColumn("seq", F.col("seq").cast("long")))


@check("p15_thin", """
    SELECT log_id, seq, value FROM (
        SELECT log_id, seq, value, row_number() OVER (PARTITION BY log_id ORDER BY ts_us, seq) - 1 AS i,
               count(*) OVER (PARTITION BY log_id) AS n FROM telemetry) t
    WHERE i % greatest(1, CAST(floor(n / 100) AS BIGINT)) = 0""")
def p15(spark, d):
    return sequence.thin(view(spark, d, "telemetry"), ["log_id"], target=100).select("log_id", "seq", "value")


# --- scalar functions -------------------------------------------------------------


@check("f01_as_degrees", """
    SELECT log_id, seq, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon FROM positions""")
def f01(spark, d):
    raw = view(spark, d, "positions")
    big = F.col("seq") % 2 == 0
    raw = raw.withColumns({c: F.when(big, F.col(c) * 1e7).otherwise(F.col(c)) for c in ("lat", "lon")})
    lat, lon = geo.as_degrees(F.col("lat"), F.col("lon"))
    return rounded(raw.select("log_id", "seq", lat.alias("lat"), lon.alias("lon")))


@check("f02_duration", f"""
    WITH t AS (SELECT seq, CAST(floor(greatest(ts_us - 1704067200000000 - 50000000, 0) / 100000.0 + 0.5) AS BIGINT) AS tenths FROM telemetry)
    SELECT seq, CAST(tenths // 600 AS VARCHAR) || ':' || lpad(CAST((tenths % 600) // 10 AS VARCHAR), 2, '0') || '.' ||
           CAST(tenths % 10 AS VARCHAR) AS shown FROM t""")
def f02(spark, d):
    since = F.col("ts_us") - F.lit(1704067200000000 + 50000000)
    return view(spark, d, "telemetry").select("seq", display.duration(since).alias("shown"))


# A quarter is held exactly and rounds up; printf would round it to even.
_ONE_DIGIT = "printf('%.1f', CASE WHEN value * 4 = floor(value * 4) AND value * 2 <> floor(value * 2) THEN value + 0.01 ELSE value END)"


@check("f03_fixed", f"SELECT seq, CASE WHEN value IS NULL THEN '—' ELSE {_ONE_DIGIT} END AS shown, CASE WHEN value IS NULL THEN '—' ELSE printf('%.2f', value) END AS two FROM telemetry")
def f03(spark, d):
    v = F.col("value")
    return view(spark, d, "telemetry").select("seq", display.fixed(v, 1).alias("shown"), display.fixed(v, 2).alias("two"))


@check("f03_percent", "SELECT seq, CASE WHEN value IS NULL THEN '—' ELSE printf('%.1f', CAST(floor(value) AS DOUBLE)) END AS shown FROM telemetry")
def f03b(spark, d):
    return view(spark, d, "telemetry").select("seq", display.percent(F.floor("value").cast("double") / 100).alias("shown"))


@check("f03_auto", f"""
    SELECT seq, CASE WHEN value IS NULL THEN '—' WHEN value = floor(value) THEN printf('%.0f', value)
        WHEN value < 0.1 THEN printf('%.5f', value) WHEN value < 1 THEN printf('%.4f', value)
        WHEN value < 10 THEN printf('%.3f', value) WHEN value < 100 THEN printf('%.2f', value)
        ELSE {_ONE_DIGIT} END AS shown FROM telemetry""")
def f03c(spark, d):
    return view(spark, d, "telemetry").select("seq", display.auto(F.col("value")).alias("shown"))


@check("f04_plot_value", """
    SELECT seq, CASE WHEN value IS NULL THEN '—' WHEN value = floor(value) THEN printf('%.0f', value)
        ELSE rtrim(printf('%.3f', value), '0') END AS shown FROM telemetry""")
def f04(spark, d):
    return view(spark, d, "telemetry").select("seq", display.plot_value(F.col("value")).alias("shown"))


@check("f05_distance", """
    SELECT seq, CASE WHEN m < 1000 THEN printf('%.1f', m) || ' m' ELSE printf('%.2f', CASE WHEN m % 250 = 125 THEN m / 1000 + 0.001 ELSE m / 1000 END) || ' km' END AS shown
    FROM (SELECT seq, CAST(floor(value) * 7 AS DOUBLE) AS m FROM telemetry) t""")
def f05(spark, d):
    return view(spark, d, "telemetry").select("seq", display.distance((F.floor("value") * 7).cast("double")).alias("shown"))


_HAVERSINE = """2 * 6371000 * asin(sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2)
    + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)))"""


@check("f06_great_circle", f"SELECT seq, round({_HAVERSINE.format(a='', b='0*')}, 3) AS metres FROM positions")
def f06(spark, d):
    zero = F.lit(0.0)
    return rounded(view(spark, d, "positions").select("seq", geo.great_circle(F.col("lat"), F.col("lon"), zero, zero).alias("metres")), 3)


@check("f07_units", "SELECT seq, round((ts_us - 1704067200000000) / 1000000.0, 6) AS seconds, round(degrees(value / 100), 6) AS deg, round(value * 0.01, 6) AS cdeg, round(value * 0.001, 6) AS metres FROM telemetry")
def f07(spark, d):
    v = F.col("value")
    return rounded(view(spark, d, "telemetry").select(
        "seq", values.seconds_since(F.col("ts_us"), F.lit(1704067200000000)).alias("seconds"),
        F.degrees(v / 100).alias("deg"), values.scaled(v, 0.01).alias("cdeg"), values.scaled(v, 0.001).alias("metres"),
    ))


@check("f08_numbers_in_names", """
    SELECT log_id, message, field, coalesce(TRY_CAST(regexp_extract(message, '([0-9]+)$', 1) AS BIGINT), 0) AS trailing,
           TRY_CAST(regexp_extract(field, '^C([0-9]+)$', 1) AS BIGINT) AS channel FROM fleet_catalog""")
def f08(spark, d):
    return rounded(view(spark, d, "fleet_catalog").select(
        "log_id", "message", "field", values.trailing_number(F.col("message")).alias("trailing"),
        values.captured_number(F.col("field"), r"^C(\d+)$").alias("channel"),
    ))


@check("f09_field_key", "SELECT log_id, message || '.' || field AS key, n_rows FROM fleet_catalog")
def f09(spark, d):
    return view(spark, d, "fleet_catalog").select("log_id", values.field_key(F.col("message"), F.col("field")).alias("key"), "n_rows")


@check("f10_snap", """
    WITH t AS (SELECT seq, CASE WHEN value IS NOT NULL THEN least(greatest(value, 10.0), 100.0) END AS v FROM telemetry),
         u AS (SELECT seq, v, 10.0 + floor((v - 10.0) / 7.0 + 0.5) * 7.0 AS s FROM t)
    SELECT seq, CASE WHEN v IS NOT NULL THEN CAST(least(greatest(CASE WHEN s > 100 THEN s - 7 ELSE s END, 10.0), 100.0) AS DOUBLE) END AS stop FROM u""")
def f10(spark, d):
    return view(spark, d, "telemetry").select("seq", values.snap(F.col("value"), 10.0, 100.0, 7.0).cast("double").alias("stop"))


# --- sets and orders --------------------------------------------------------------

_MODES = "SELECT log_id, seq, ts_us, message AS mode FROM hourly"
_TEXTS = "SELECT log_id, seq, ts_us, 'said ' || CAST(seq AS STRING) AS text FROM hourly"


@check("u01_event_log", f"""
    SELECT log_id, ts_us, kind, seq, text, row_number() OVER (PARTITION BY log_id ORDER BY ts_us, kind, seq) AS place FROM (
        SELECT log_id, ts_us, 'mode' AS kind, seq, mode AS text FROM ({_MODES}) m
        UNION ALL SELECT log_id, ts_us, 'text', seq, text FROM ({_TEXTS}) t) e""")
def u01(spark, d):
    from flightlake.scale import Ordered, row_index

    both = tables.event_log(spark_sql(spark, d, _MODES), spark_sql(spark, d, _TEXTS))
    placed = Ordered(both, ["log_id"], ["ts_us", "kind", "seq"]).scan(place=row_index()).rows()
    return placed.withColumn("place", F.col("place") + 1)


@check("u02_stamp_union", "SELECT DISTINCT log_id, ts_us FROM hourly WHERE message IN ('click', 'view')")
def u02(spark, d):
    from flightlake.operators.timejoin import merge_on_time

    rows = view(spark, d, "hourly")
    return merge_on_time(rows, [("click", "value"), ("view", "value")]).select("log_id", "ts_us")


_PICKED = "SELECT event_type AS message, 'value' AS field, CAST(min(event_id) AS BIGINT) AS pos FROM events WHERE {w} GROUP BY event_type"


@check("u03_chosen_fields", f"""
    SELECT message, field, list, pos FROM (
        SELECT *, row_number() OVER (PARTITION BY message, field ORDER BY list, pos) AS k FROM (
            SELECT CAST(0 AS BIGINT) AS list, * FROM ({_PICKED.format(w="event_type IN ('click', 'view')")}) a
            UNION ALL SELECT 1, * FROM ({_PICKED.format(w="event_type IN ('view', 'error')")}) b) u) t WHERE k = 1""")
def u03(spark, d):
    chosen = spark_sql(spark, d, _PICKED.format(w="event_type IN ('click', 'view')"))
    extra = spark_sql(spark, d, _PICKED.format(w="event_type IN ('view', 'error')"))
    return rounded(select.chosen_fields(chosen, extra))


_DIALECT = """
    SELECT CAST(p_partkey % 500 AS INT) AS msg_id, p_brand AS msg_name, p_name AS field, CAST(p_size % 3 AS INT) AS layer FROM part"""


@check("u04_layered_dialect", f"""
    SELECT CAST(msg_id AS BIGINT) AS msg_id, msg_name, field, CAST(layer AS BIGINT) AS layer
    FROM (SELECT *, max(layer) OVER (PARTITION BY msg_id) AS top FROM ({_DIALECT}) t) u WHERE layer = top""")
def u04(spark, d):
    return rounded(layered_dialect(spark_sql(spark, d, _DIALECT)).select("msg_id", "msg_name", "field", "layer"))


@check("s01_time_sorted", "SELECT log_id, message, ts_us, seq, value FROM hourly ORDER BY log_id, message, ts_us, seq")
def s01(spark, d):
    return tables.time_sorted(view(spark, d, "hourly").select("log_id", "message", "ts_us", "seq", "value"))


# Underscores come before digits and letters, case only settles ties, lower case first.
_BY_NAME = ", ".join(
    f"translate(lower({c}), '_', '!'), translate({c}, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz')"
    for c in ("message", "field")
)


@check("s03_name_order", f"""
    SELECT log_id, message, field, CAST(row_number() OVER (PARTITION BY log_id ORDER BY {_BY_NAME}) AS INT) AS place
    FROM fleet_catalog""")
def s03(spark, d):
    names = view(spark, d, "fleet_catalog").select("log_id", "message", "field")
    return select.name_order(names, "message", "field", within=["log_id"])


@check("src01_log_kind", """
    SELECT page_id, path, CASE WHEN lower(path) LIKE '%.bin' OR lower(path) LIKE '%.log' THEN 'bin'
        WHEN lower(path) LIKE '%.tlog' THEN 'tlog' WHEN page_id % 2 = 0 THEN 'bin' ELSE 'tlog' END AS kind
    FROM (SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '.BIN' WHEN 1 THEN '.log' WHEN 2 THEN '.Tlog' WHEN 3 THEN '' ELSE '.txt' END AS path FROM pages) p""")
def src01(spark, d):
    named = spark_sql(spark, d, """
        SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '.BIN' WHEN 1 THEN '.log' WHEN 2 THEN '.Tlog' WHEN 3 THEN '' ELSE '.txt' END AS path,
               unhex(CASE WHEN page_id % 2 = 0 THEN 'A3' ELSE 'FD' END) AS head FROM pages""")
    return named.select("page_id", "path", log_kind(F.col("path"), F.col("head")).alias("kind"))


@check("s02_mission_order", """
    SELECT log_id, seq, lat, row_number() OVER (PARTITION BY log_id ORDER BY seq) AS place FROM (
        SELECT log_id, seq, round(arg_max(lat, file_seq), 6) + 0.0 AS lat FROM mission_items GROUP BY log_id, seq) m""")
def s02(spark, d):
    """A plan has one row per number: a short list, numbered in its order."""
    items = view(spark, d, "mission_items")
    return rounded(in_order(items.groupBy("log_id", "seq").agg(F.max_by("lat", "file_seq").alias("lat"))))


@check("s06_longest_series", """
    SELECT log_id, message, n_rows FROM (
        SELECT log_id, message, CAST(count(*) AS BIGINT) AS n_rows, row_number() OVER (PARTITION BY log_id ORDER BY count(*) DESC, message) AS k FROM telemetry GROUP BY log_id, message) t WHERE k <= 2""")
def s06(spark, d):
    """Top-k per log over the catalog, ties broken by name."""
    return select.longest_series(tables.message_counts(view(spark, d, "telemetry")), 2)
