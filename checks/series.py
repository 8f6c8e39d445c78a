"""Time joins and operators on the order of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check, rounded
from checks.views import spark_sql, view
from flightlake.functions.values import align_angle
from flightlake.operators import sequence, tables, timejoin
from flightlake.operators.mission import command_items, newest_plan, prefer_first
from flightlake.operators.trajectory import drape_heading, initial_view
from flightlake.scale import Ordered, exact_median, last_known, previous, row_index

# Rows of the source around each instant, by brute force over all pairs of a log.
_AROUND = """
    pairs AS (
        SELECT p.log_id, p.seq, p.ts_us, s.ts_us AS s_ts, s.seq AS s_seq, s.value AS s_value,
               min(s.ts_us) OVER (PARTITION BY p.log_id, p.seq) AS first_ts,
               max(s.ts_us) OVER (PARTITION BY p.log_id, p.seq) AS last_ts
        FROM {probe} p JOIN {source} s ON p.log_id = s.log_id),
    held AS (
        SELECT log_id, seq, ts_us, first_ts, last_ts, s_ts, s_seq, s_value FROM (
            SELECT *, row_number() OVER (PARTITION BY log_id, seq ORDER BY
                CASE WHEN ts_us <= first_ts THEN s_ts ELSE 0 END, CASE WHEN ts_us <= first_ts THEN s_seq ELSE 0 END,
                s_ts DESC, s_seq DESC) AS k
            FROM pairs WHERE s_ts <= ts_us OR ts_us <= first_ts) a WHERE k = 1),
    nxt AS (
        SELECT log_id, seq, s_ts AS n_ts, s_value AS n_value FROM (
            SELECT *, row_number() OVER (PARTITION BY log_id, seq ORDER BY s_ts, s_seq) AS k
            FROM pairs WHERE s_ts > ts_us) b WHERE k = 1),
    both_sides AS (SELECT h.*, n.n_ts, n.n_value FROM held h LEFT JOIN nxt n ON h.log_id = n.log_id AND h.seq = n.seq)"""
_CLICKS_AT_VIEWS = "WITH " + _AROUND.format(probe="views", source="clicks")


@check("j01_asof", _CLICKS_AT_VIEWS + "SELECT log_id, seq, ts_us, s_ts AS held_ts_us, s_value AS value FROM both_sides")
def j01(spark, d):
    asked = view(spark, d, "views").drop("value")
    return timejoin.asof(view(spark, d, "clicks"), asked).select("log_id", "seq", "ts_us", "held_ts_us", "value")


@check("j02_nearest", _CLICKS_AT_VIEWS + """
    SELECT log_id, seq, ts_us,
           CASE WHEN ts_us < first_ts OR ts_us > last_ts THEN NULL WHEN n_ts - ts_us < ts_us - s_ts THEN n_ts ELSE s_ts END AS near_ts_us,
           CASE WHEN ts_us < first_ts OR ts_us > last_ts THEN NULL WHEN n_ts - ts_us < ts_us - s_ts THEN n_value ELSE s_value END AS value
    FROM both_sides""")
def j02(spark, d):
    asked = view(spark, d, "views").drop("value")
    return timejoin.nearest(view(spark, d, "clicks"), asked).select("log_id", "seq", "ts_us", "near_ts_us", "value")


_BETWEEN = """CASE WHEN ts_us < first_ts OR ts_us > last_ts THEN NULL WHEN s_ts = ts_us THEN s_value
              ELSE s_value + CAST(ts_us - s_ts AS DOUBLE) / (n_ts - s_ts) * (n_value - s_value) END"""


@check("j03_interpolate", _CLICKS_AT_VIEWS + f"SELECT log_id, seq, ts_us, round({_BETWEEN}, 6) AS value FROM both_sides")
def j03(spark, d):
    asked = view(spark, d, "views").drop("value")
    return rounded(timejoin.interpolate(view(spark, d, "clicks"), asked).select("log_id", "seq", "ts_us", "value"))


@check("j04_pair_on_common_time", "WITH " + _AROUND.format(probe="clicks", source="views").replace("pairs", "pairs_a").replace(
    "held", "held_a").replace("nxt", "nxt_a").replace("both_sides", "at_clicks") + "," + _AROUND.format(probe="views", source="clicks") + f""",
    sizes AS (SELECT log_id, count(*) FILTER (message = 'click') <= count(*) FILTER (message = 'view') AS a_leads
              FROM hourly WHERE message IN ('click', 'view') GROUP BY log_id)
    SELECT x.log_id, x.seq, x.ts_us, round(c.value, 6) AS a, round({_BETWEEN.replace('ts_us', 'x.ts_us').replace('s_x.ts_us', 's_ts').replace('first_ts', 'x.first_ts').replace('last_ts', 'x.last_ts')}, 6) AS b
    FROM at_clicks x JOIN clicks c ON x.log_id = c.log_id AND x.seq = c.seq JOIN sizes z ON z.log_id = x.log_id WHERE z.a_leads
    UNION ALL
    SELECT x.log_id, x.seq, x.ts_us, round({_BETWEEN.replace('ts_us', 'x.ts_us').replace('s_x.ts_us', 's_ts').replace('first_ts', 'x.first_ts').replace('last_ts', 'x.last_ts')}, 6), round(v.value, 6)
    FROM both_sides x JOIN views v ON x.log_id = v.log_id AND x.seq = v.seq JOIN sizes z ON z.log_id = x.log_id WHERE NOT z.a_leads""")
def j04(spark, d):
    return rounded(timejoin.pair_on_common_time(view(spark, d, "clicks"), view(spark, d, "views")))


@check("j05_merge_on_time", """
    WITH last_rows AS (
        SELECT log_id, message, ts_us, value FROM (
            SELECT *, row_number() OVER (PARTITION BY log_id, message, ts_us ORDER BY seq DESC) AS k FROM hourly) h WHERE k = 1)
    SELECT u.log_id, u.ts_us, c.value AS click, v.value AS view_value
    FROM (SELECT DISTINCT log_id, ts_us FROM hourly WHERE message IN ('click', 'view')) u
    LEFT JOIN last_rows c ON c.log_id = u.log_id AND c.ts_us = u.ts_us AND c.message = 'click'
    LEFT JOIN last_rows v ON v.log_id = u.log_id AND v.ts_us = u.ts_us AND v.message = 'view'""")
def j05(spark, d):
    merged = timejoin.merge_on_time(view(spark, d, "hourly"), [("click", "value"), ("view", "value")])
    return merged.select("log_id", "ts_us", F.col("`click.value`").alias("click"), F.col("`view.value`").alias("view_value"))


_ASKED = "SELECT log_id, min(ts_us) + 86400000000 * 10 AS ts_us, CAST(1 AS BIGINT) AS seq FROM telemetry GROUP BY log_id"


@check("j07_at_instants", f"""
    SELECT log_id, ts_us, message, near_ts_us, value FROM (
        SELECT a.log_id, a.ts_us, t.message, t.ts_us AS near_ts_us, t.value,
               row_number() OVER (PARTITION BY a.log_id, t.message ORDER BY abs(t.ts_us - a.ts_us), t.ts_us) AS k
        FROM ({_ASKED}) a JOIN telemetry t ON t.log_id = a.log_id AND t.message IN ('click', 'view')) n WHERE k = 1""")
def j07(spark, d):
    refs = [("click", "value"), ("view", "value")]
    found = timejoin.at_instants(view(spark, d, "telemetry"), spark_sql(spark, d, _ASKED), refs)
    return found.select("log_id", "ts_us", "message", "near_ts_us", "value")


_HEADING_AT = """
    SELECT p.log_id, p.seq, p.ts_us, (
        SELECT arg_max(CAST(h.seq AS BIGINT), h.ts_us) FROM headings h WHERE h.log_id = p.log_id AND h.message = 'view' AND h.ts_us <= p.ts_us) AS at_seq, (
        SELECT arg_min(CAST(h.seq AS BIGINT), h.ts_us) FROM headings h WHERE h.log_id = p.log_id AND h.message = 'view') AS first_seq
    FROM fixes p"""


@check("j08_drape_heading", f"""
    SELECT a.log_id, a.seq, CASE WHEN h.value = 180 THEN NULL ELSE round(h.value * 0.5, 6) END AS heading
    FROM ({_HEADING_AT}) a JOIN headings h ON h.seq = coalesce(a.at_seq, a.first_seq)""")
def j08(spark, d):
    from flightlake.functions.values import known

    rows = view(spark, d, "headings").where("message = 'view'").select(
        "log_id", "ts_us", "seq", (known(F.col("value"), 180.0) * 0.5).alias("heading")
    )
    path = view(spark, d, "fixes").select("log_id", "ts_us", "seq")
    return rounded(drape_heading(path, rows).select("log_id", "seq", "heading"))


@check("j07_same_message", """
    SELECT log_id, seq, ts_us, max(value) FILTER (field = 'RDes') AS "RATE.RDes", max(value) FILTER (field = 'R') AS "RATE.R"
    FROM fleet WHERE message = 'RATE' AND seq % 3 = 1 AND field IN ('RDes', 'R') GROUP BY log_id, seq, ts_us""")
def j07_rows(spark, d):
    """Every third row of a message by its place in the file: its own values, gaps too."""
    fleet = view(spark, d, "fleet")
    return timejoin.in_same_row(fleet, fleet.where("message = 'RATE' AND seq % 3 = 1"), "RATE", ["RDes", "R"])


@check("j09_position_at", """
    SELECT e.event_id AS seq, round(p.lat, 6) + 0.0 AS lat, round(p.lon, 6) + 0.0 AS lon, round(p.alt, 6) AS alt
    FROM events e ASOF JOIN fixes p ON CAST(e.user_id % 4 AS VARCHAR) = p.log_id AND epoch_us(e.ts) + 1800000000 >= p.ts_us
    UNION ALL
    SELECT e.event_id, round(f.lat, 6) + 0.0, round(f.lon, 6) + 0.0, round(f.alt, 6)
    FROM events e JOIN (SELECT log_id, min(ts_us) AS ts_us, arg_min(lat, (ts_us, seq)) AS lat, arg_min(lon, (ts_us, seq)) AS lon, arg_min(alt, (ts_us, seq)) AS alt
                        FROM fixes GROUP BY log_id) f
    ON CAST(e.user_id % 4 AS VARCHAR) = f.log_id AND epoch_us(e.ts) + 1800000000 < f.ts_us""")
def j09(spark, d):
    path = view(spark, d, "fixes").withColumn("heading", F.lit(None).cast("double"))
    asked = view(spark, d, "telemetry").select("log_id", (F.col("ts_us") + 1800000000).alias("ts_us"), "seq")
    # Instants before the first fix clamp to it.
    return rounded(timejoin.position_at(path, asked).select("seq", "lat", "lon", "alt"))


# --- order of rows ----------------------------------------------------------------

_CLOCKLESS = "SELECT log_id, seq, message, CASE WHEN seq % 3 = 0 THEN NULL ELSE ts_us END AS ts_us FROM telemetry"


@check("w01_fill_time", f"""
    SELECT log_id, seq, message, ts_us IS NOT NULL AS has_time,
           coalesce(last_value(ts_us IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS ts_us
    FROM ({_CLOCKLESS}) t""")
def w01(spark, d):
    return sequence.fill_time(spark_sql(spark, d, _CLOCKLESS))


@check("t02_stamps_go_back", """
    SELECT log_id, seq, lag(seq) OVER w AS before, row_number() OVER w - 1 AS place,
           last_value(value IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY back, seq ROWS UNBOUNDED PRECEDING) AS known FROM (
        SELECT *, ts_us - CASE WHEN seq % 7 < 3 THEN 86400000000 * (seq % 5) ELSE 0 END AS back FROM telemetry) t
    WINDOW w AS (PARTITION BY log_id ORDER BY back, seq)""")
def t02(spark, d):
    """Clocks that run back, by days, for stretches of a log: order is by stamp, then by place in the file."""
    back = F.col("ts_us") - F.when(F.col("seq") % 7 < 3, F.lit(86_400_000_000) * (F.col("seq") % 5)).otherwise(0)
    rows = view(spark, d, "telemetry").withColumn("back", back)
    # Split on purpose, so that what goes back crosses pieces.
    ordered = Ordered(rows, ["log_id"], ["back", "seq"], split=True, group_rows=500)
    found = ordered.scan(before=previous("seq"), place=row_index(), known=last_known(F.col("value"))).rows()
    return found.select("log_id", "seq", F.col("before.seq").alias("before"), "place", "known")


@check("w02_mode_changes", """
    SELECT log_id, seq, ts_us, mode FROM (
        SELECT log_id, seq, ts_us, message AS mode, lag(message) OVER (PARTITION BY log_id ORDER BY seq) AS p FROM telemetry) t
    WHERE p IS NULL OR p <> mode""")
def w02(spark, d):
    return sequence.mode_changes(view(spark, d, "telemetry").select("log_id", "seq", "ts_us", F.col("message").alias("mode")))


@check("w02_wild_modes", """
    SELECT log_id, seq, mode FROM (
        SELECT *, lag(mode) OVER (PARTITION BY log_id ORDER BY seq) AS p FROM (
            SELECT CAST(user_id % 4 AS VARCHAR) AS log_id, event_id AS seq,
                   CASE event_id % 11 WHEN 0 THEN 'Mode 1e+30' WHEN 1 THEN 'Mode -2.5' WHEN 2 THEN 'Mode 12345678901234567000' WHEN 3 THEN 'named'
                        WHEN 4 THEN 'Mode 1e-9' WHEN 5 THEN '?' ELSE 'Mode ' || CAST(user_id % 3 AS VARCHAR) END AS mode FROM events) e) t
    WHERE p IS NULL OR p <> mode""")
def w02b(spark, d):
    """Mode numbers of any size make labels; none ends the job."""
    rows = spark_sql(spark, d, """
        SELECT CAST(user_id % 4 AS STRING) AS log_id, event_id AS seq, event_id AS ts_us, 'MODE' AS message,
               CASE event_id % 11 WHEN 0 THEN 1e30D WHEN 1 THEN -2.5D WHEN 2 THEN 12345678901234567890D WHEN 3 THEN NULL WHEN 4 THEN 1e-9D
                    WHEN 5 THEN NULL ELSE CAST(user_id % 3 AS DOUBLE) END AS n,
               CASE WHEN event_id % 11 = 3 THEN 'named' END AS t FROM events""")
    nums = F.when(F.col("n").isNull(), F.expr("map()").cast("map<string,double>")).otherwise(F.create_map(F.lit("Mode"), F.col("n")))
    txts = F.when(F.col("t").isNull(), F.expr("map()").cast("map<string,string>")).otherwise(F.create_map(F.lit("Mode"), F.col("t")))
    return tables.modes(rows.withColumn("nums", nums).withColumn("txts", txts)).select("log_id", "seq", "mode")


@check("w03_unwrap_angle", """
    WITH known AS (SELECT *, value - lag(value) OVER (PARTITION BY log_id, message ORDER BY ts_us, seq) AS step FROM headings WHERE value IS NOT NULL),
    turned AS (SELECT log_id, message, seq, value - sum(coalesce(floor(step / 360 + 0.5), 0) * 360) OVER (PARTITION BY log_id, message ORDER BY ts_us, seq) AS value FROM known)
    SELECT h.log_id, h.message, h.seq, round(t.value, 6) + 0.0 AS value
    FROM headings h LEFT JOIN turned t ON h.log_id = t.log_id AND h.message = t.message AND h.seq = t.seq""")
def w03(spark, d):
    return rounded(sequence.unwrap_angle(view(spark, d, "headings")).select("log_id", "message", "seq", "value"))


@check("w04_align_angle", """
    SELECT seq, round(a + ((b - a) - floor((b - a) / 360 + 0.5) * 360), 6) + 0.0 AS value
    FROM (SELECT seq, value AS a, CAST(seq AS DOUBLE) * 91 % 1080 - 360 AS b FROM headings) t""")
def w04(spark, d):
    b = F.col("seq").cast("double") * 91 % 1080 - 360
    return rounded(view(spark, d, "headings").select("seq", align_angle(F.col("value"), b).alias("value")))


_RUNS = """
    steps AS (SELECT log_id, message, seq, ts_us, value, ts_us - lag(ts_us) OVER (PARTITION BY log_id, message ORDER BY ts_us, seq) AS step FROM telemetry),
    spacing AS (SELECT log_id, message, median(step) AS median_step FROM steps GROUP BY log_id, message),
    cut AS (SELECT s.*, p.median_step, sum(CASE WHEN s.step > 3 * p.median_step THEN 1 ELSE 0 END) OVER (PARTITION BY s.log_id, s.message ORDER BY s.ts_us, s.seq) AS run
            FROM steps s JOIN spacing p ON s.log_id = p.log_id AND s.message = p.message),
    runs AS (SELECT log_id, message, run, count(*) AS n_run, min(ts_us) AS t0, max(ts_us) AS t1, any_value(median_step) AS step FROM cut GROUP BY log_id, message, run),
    best AS (SELECT * FROM (SELECT *, sum(n_run) OVER (PARTITION BY log_id, message) AS n_all, row_number() OVER (PARTITION BY log_id, message ORDER BY n_run DESC, run) AS k FROM runs) r WHERE k = 1 AND n_run >= 4),
    grid AS (SELECT log_id, message, run, CAST(n_run AS BIGINT) AS n_run, t0, t1, step, CAST(floor((t1 - t0) / step) + 1 AS BIGINT) AS n_grid, CAST(n_all - n_run AS BIGINT) AS dropped FROM best)"""


@check("w05_longest_run", f"WITH {_RUNS} SELECT log_id, message, n_run, t0, t1, round(step, 6) AS step, n_grid, dropped FROM grid")
def w05(spark, d):
    _, grid = sequence.longest_run(view(spark, d, "telemetry"))
    return rounded(grid.select("log_id", "message", "n_run", "t0", "t1", "step", "n_grid", "dropped"))


_GRID_POINTS = f"""{_RUNS},
    stamps AS (SELECT log_id, message, run, t0, step, unnest(range(n_grid)) AS i FROM grid),
    points AS (
        SELECT s.log_id, s.message, s.i, s.t0 + s.i * s.step AS t,
               arg_max(struct_pack(t := c.ts_us, v := c.value), c.ts_us) FILTER (c.ts_us <= s.t0 + s.i * s.step) AS b,
               arg_min(struct_pack(t := c.ts_us, v := c.value), c.ts_us) FILTER (c.ts_us > s.t0 + s.i * s.step) AS a
        FROM stamps s JOIN cut c ON c.log_id = s.log_id AND c.message = s.message AND c.run = s.run GROUP BY ALL),
    even AS (SELECT log_id, message, i, CASE WHEN b.t = t THEN b.v ELSE b.v + (t - b.t) / (a.t - b.t) * (a.v - b.v) END AS value FROM points)"""


@check("w06_uniform_grid", f"WITH {_GRID_POINTS} SELECT log_id, message, CAST(i AS BIGINT) AS i, round(value, 6) AS value FROM even")
def w06(spark, d):
    points, _ = sequence.uniform_grid(view(spark, d, "telemetry"))
    return rounded(points.select("log_id", "message", "i", "value"))


_LINED = "SELECT log_id, message, seq, value, row_number() OVER (PARTITION BY log_id, message ORDER BY ts_us, seq) - 1 AS i FROM telemetry"


@check("w07_detrend", f"""
    WITH t AS ({_LINED}), f AS (SELECT log_id, message, regr_slope(value, i) AS m, avg(value) AS my, avg(i) FILTER (value IS NOT NULL) AS mx FROM t GROUP BY log_id, message)
    SELECT t.log_id, t.message, t.seq, round(value - (my + m * (i - mx)), 6) + 0.0 AS value
    FROM t JOIN f ON t.log_id = f.log_id AND t.message = f.message""")
def w07(spark, d):
    rows = Ordered(view(spark, d, "telemetry"), sequence.SERIES, sequence.TIME_ORDER).scan(i=row_index()).rows()
    return rounded(sequence.detrend(rows).select("log_id", "message", "seq", "value"))


@check("w08_first_crossing", f"""
    WITH t AS ({_LINED}), p AS (SELECT *, lag(value) OVER (PARTITION BY log_id, message ORDER BY i) AS prev FROM t),
    hit AS (SELECT *, row_number() OVER (PARTITION BY log_id, message ORDER BY i) AS k FROM p WHERE i >= 5 AND value >= 60)
    SELECT s.log_id, s.message, round(CASE WHEN h.i > 5 AND h.prev IS NOT NULL AND h.value <> h.prev THEN h.i - 1 + (60 - h.prev) / (h.value - h.prev) ELSE h.i END, 6) AS crossing
    FROM (SELECT DISTINCT log_id, message FROM t) s LEFT JOIN hit h ON h.log_id = s.log_id AND h.message = s.message AND h.k = 1""")
def w08(spark, d):
    rows = spark_sql(spark, d, _LINED)
    found = sequence.first_crossing(rows, ["log_id", "message"], "value", F.lit(60.0), F.lit(5), F.lit(True))
    return rounded(found)


_PLAN_SQL = """
    SELECT log_id, seq, command, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon, round(alt, 6) AS alt FROM (
        SELECT m.log_id, m.seq, CAST(command AS BIGINT) AS command, lat, lon, alt, row_number() OVER (PARTITION BY m.log_id, m.seq ORDER BY m.file_seq DESC) AS k
        FROM {items} m JOIN ({start}) s ON s.log_id = m.log_id
        WHERE m.file_seq >= s.f AND m.command IN (16,17,18,19,21,22,30,31,36,82,84,85,92,94,188,189)
          AND m.lat IS NOT NULL AND NOT (m.lat = 0 AND m.lon = 0) AND abs(m.lat) <= 90 AND abs(m.lon) <= 180) w WHERE k = 1"""
_PLAN_COLUMNS = ("log_id", "seq", "command", "lat", "lon", "alt")


@check("w09_newest_plan", _PLAN_SQL.format(items="mission_items", start="SELECT log_id, max(file_seq) AS f FROM mission_items WHERE seq = 0 GROUP BY log_id"))
def w09(spark, d):
    return rounded(newest_plan(view(spark, d, "mission_items")).select(*_PLAN_COLUMNS))


@check("w09_wild_items", """
    SELECT log_id, no AS seq, command, frame FROM (
        SELECT m.log_id, no, CAST(CASE WHEN m.file_seq % 7 <> 3 THEN command END AS BIGINT) AS command,
               CAST(CASE WHEN m.file_seq % 5 <> 2 THEN frame END AS BIGINT) AS frame,
               row_number() OVER (PARTITION BY m.log_id, no ORDER BY m.file_seq DESC) AS k
        FROM (SELECT *, CASE file_seq % 6 WHEN 1 THEN 1e30 WHEN 2 THEN seq + 0.25 ELSE CAST(seq AS DOUBLE) END AS no FROM mission_items) m
        JOIN (SELECT log_id, max(file_seq) AS f FROM mission_items WHERE seq = 0 AND file_seq % 6 NOT IN (1, 2) GROUP BY log_id) s ON s.log_id = m.log_id
        WHERE m.file_seq >= s.f AND m.file_seq % 7 <> 3 AND command IN (16,17,18,19,21,22,30,31,36,82,84,85,92,94,188,189)
          AND m.lat IS NOT NULL AND NOT (m.lat = 0 AND m.lon = 0) AND abs(m.lat) <= 90 AND abs(m.lon) <= 180) w WHERE k = 1""")
def w09c(spark, d):
    """Items numbered and commanded by numbers no integer holds: none is lost for its number, none ends the job."""
    rows = spark_sql(spark, d, """
        SELECT log_id, file_seq AS seq, 'CMD' AS message,
               map_from_arrays(array('CNum', 'CId', 'Lat', 'Lng', 'Alt', 'Frame'),
                   array(CASE file_seq % 6 WHEN 1 THEN 1e30D WHEN 2 THEN seq + 0.25D ELSE CAST(seq AS DOUBLE) END,
                         CASE WHEN file_seq % 7 = 3 THEN 1e30D ELSE CAST(command AS DOUBLE) END, lat, lon, alt,
                         CASE WHEN file_seq % 5 = 2 THEN -1e300D ELSE CAST(frame AS DOUBLE) END)) AS nums
        FROM mission_items""")
    return rounded(newest_plan(command_items(rows)).select("log_id", "seq", "command", "frame"))


_TOLD = "SELECT log_id, seq AS file_seq FROM telemetry WHERE message = 'signup' AND log_id <> '2' AND value > 300"


@check("w09_newest_plan_told", _PLAN_SQL.format(items="mission_items", start=f"""
    SELECT z.log_id, coalesce(t.f, z.f) AS f FROM (SELECT log_id, max(file_seq) AS f FROM mission_items WHERE seq = 0 GROUP BY log_id) z
    LEFT JOIN (SELECT log_id, max(file_seq) AS f FROM ({_TOLD}) x GROUP BY log_id) t ON t.log_id = z.log_id"""))
def w09b(spark, d):
    return rounded(newest_plan(view(spark, d, "mission_items"), spark_sql(spark, d, _TOLD)).select(*_PLAN_COLUMNS))


@check("w10_preferred_plan", """
    SELECT log_id, file_seq, CASE WHEN log_id IN ('0', '1') THEN 'int' ELSE 'float' END AS form FROM mission_items""")
def w10(spark, d):
    """Every item once in its log's form, and once more in the other, which must not be taken."""
    items = view(spark, d, "mission_items").select("log_id", "file_seq")
    whole = items.join(items.where("log_id IN ('0', '1')").select("log_id").distinct(), "log_id", "left_semi")
    return prefer_first(whole.withColumn("form", F.lit("int")), items.withColumn("form", F.lit("float")))


@check("j14_plan_file_wins", """
    SELECT log_id, seq, 'file' AS origin FROM mission_items WHERE log_id = '1'
    UNION ALL SELECT log_id, seq, 'log' FROM mission_items WHERE log_id <> '1'""")
def j14(spark, d):
    items = view(spark, d, "mission_items")
    from_file = items.where("log_id = '1'").select("log_id", "seq", F.lit("file").alias("origin"))
    return prefer_first(from_file, items.select("log_id", "seq", F.lit("log").alias("origin")))


@check("w11_number_items", """
    WITH t AS (SELECT log_id, event_id AS place, CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 97 AS DOUBLE) WHEN event_id % 5 = 1 THEN -3.0 WHEN event_id % 5 = 2 THEN 2.5 END AS jump_id
               FROM (SELECT *, CAST(user_id AS VARCHAR) AS log_id FROM events) e),
    r AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY place) AS k FROM t),
    v AS (SELECT *, max(CASE WHEN jump_id >= 0 AND jump_id = floor(jump_id) THEN k END) OVER (PARTITION BY log_id ORDER BY place) AS vk FROM r)
    SELECT v.log_id, v.place, CAST(coalesce(a.jump_id + v.k - v.vk, v.k) AS DOUBLE) AS seq FROM v LEFT JOIN r a ON a.log_id = v.log_id AND a.k = v.vk""")
def w11(spark, d):
    from flightlake.sources.planfile import number_items

    e = spark_sql(spark, d, """
        SELECT CAST(user_id AS STRING) AS log_id, event_id AS place, FALSE AS complex,
               CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 97 AS DOUBLE) WHEN event_id % 5 = 1 THEN -3e0 WHEN event_id % 5 = 2 THEN 2.5e0 END AS jump_id
        FROM events""")
    return number_items(e).select("log_id", "place", F.col("seq").cast("double").alias("seq"))


_LEG = """2 * 6371000 * asin(sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2)))"""


@check("w12_legs", f"""
    WITH p AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM fixes WINDOW w AS (PARTITION BY log_id ORDER BY ts_us, seq)),
    l AS (SELECT log_id, seq, ts_us, coalesce({_LEG}, 0) AS leg FROM p)
    SELECT log_id, seq, round(leg, 3) AS leg_m, round(sum(leg) OVER (PARTITION BY log_id ORDER BY ts_us, seq) / 1000, 3) AS along_km,
           round(sum(leg) OVER (PARTITION BY log_id) / 1000, 3) AS total_km FROM l""")
def w12(spark, d):
    walked = sequence.legs(view(spark, d, "fixes").select("log_id", "ts_us", "seq", "lat", "lon"))
    return rounded(walked.select(
        "log_id", "seq", "leg_m", (F.col("along_m") / 1000).alias("along_km"), (F.col("total_m") / 1000).alias("total_km")
    ), 3)


@check("a04_median_step", f"WITH {_RUNS} SELECT log_id, message, median_step FROM spacing")
def a04(spark, d):
    return sequence.median_step(view(spark, d, "telemetry")).select("log_id", "message", "median_step")


@check("a27_median", "SELECT log_id, message, round(median(value), 6) AS median FROM telemetry GROUP BY log_id, message")
def a27(spark, d):
    return rounded(exact_median(view(spark, d, "telemetry"), ["log_id", "message"], "value"))


@check("a27_median_counted", "SELECT log_id, round(median(value), 6) AS median FROM telemetry GROUP BY log_id")
def a27b(spark, d):
    """The form used beyond one task's worth of rows."""
    return rounded(exact_median(view(spark, d, "telemetry"), ["log_id"], "value", split=True))


@check("a26_initial_view", """
    SELECT l.log_id, round(coalesce(v.longitude, 0), 6) + 0.0 AS longitude, round(coalesce(v.latitude, 20), 6) + 0.0 AS latitude, round(coalesce(v.zoom, 1.5), 6) AS zoom
    FROM (SELECT DISTINCT log_id FROM telemetry) l LEFT JOIN (
        SELECT log_id, (min(lon) + max(lon)) / 2 AS longitude, (min(lat) + max(lat)) / 2 AS latitude,
               least(18, greatest(2, log2(360 / greatest(max(lon) - min(lon), max(lat) - min(lat), 0.0001)) - 0.5)) AS zoom
        FROM (SELECT log_id, lat, lon FROM fixes WHERE log_id IN ('0', '1') UNION ALL
              SELECT log_id, lat, lon FROM mission_items WHERE log_id = '2' AND NOT (lat = 0 AND lon = 0)) p GROUP BY log_id) v ON v.log_id = l.log_id""")
def a26(spark, d):
    path = view(spark, d, "fixes").where("log_id IN ('0', '1')")
    plan = view(spark, d, "mission_items").where("log_id IN ('0', '2') AND NOT (lat = 0 AND lon = 0)")
    return rounded(initial_view(view(spark, d, "telemetry"), path, plan))


_PARAMS = """
    SELECT CAST(user_id % 4 AS STRING) AS log_id, event_id AS seq, event_type AS name,
           CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value FROM events"""


@check("a07_last_write", f"SELECT log_id, name, value FROM (SELECT *, row_number() OVER (PARTITION BY log_id, name ORDER BY seq DESC) AS k FROM ({_PARAMS}) p) q WHERE k = 1")
def a07(spark, d):
    return tables.last_write(spark_sql(spark, d, _PARAMS))
