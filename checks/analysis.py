"""Statistics, fits, tracking, spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check, rounded
from checks.views import spark_sql, view
from flightlake.operators import channels, circle, select, spectrum, stats, tables, tracking

_STATS = """CAST(count({v}) AS BIGINT) AS n, round(avg({v}), 6) + 0.0 AS mean, round(min({v}), 6) + 0.0 AS min, round(max({v}), 6) + 0.0 AS max,
    round(coalesce(stddev_samp({v}), 0), 6) + 0.0 AS std, round(sqrt(avg({v} * {v})), 6) + 0.0 AS rms,
    CASE WHEN avg({v}) = 0 THEN NULL ELSE round(coalesce(stddev_samp({v}), 0) / abs(avg({v})), 6) + 0.0 END AS cv"""


@check("a01_column_stats", f"SELECT log_id, message, field, {_STATS.format(v='value')} FROM fleet GROUP BY log_id, message, field HAVING count(value) > 0")
def a01(spark, d):
    return rounded(stats.column_stats(view(spark, d, "fleet")))


@check("a01_single_sample", f"SELECT event_id, {_STATS.format(v='value')} FROM events GROUP BY event_id")
def a01b(spark, d):
    return rounded(stats.column_stats(spark_sql(spark, d, "SELECT event_id, value FROM events"), ["event_id"]))


_FIT = """round(regr_slope({y}, {x}), 4) + 0.0 AS slope, round(regr_intercept({y}, {x}), 4) + 0.0 AS intercept,
    CASE WHEN isnan(corr({y}, {x})) THEN NULL ELSE round(corr({y}, {x}), 4) + 0.0 END AS r, CAST(regr_count({y}, {x}) AS BIGINT) AS n"""


@check("a02_line_fit", f"SELECT l_returnflag AS flag, {_FIT.format(x='l_quantity', y='l_extendedprice')} FROM lineitem GROUP BY l_returnflag")
def a02(spark, d):
    rows = spark_sql(spark, d, "SELECT l_returnflag AS flag, l_quantity AS x, l_extendedprice AS y FROM lineitem")
    return rounded(stats.line_fit(rows, ["flag"]), 4)


@check("a02_constant_columns", """
    SELECT user_id, CASE WHEN count(*) < 2 THEN NULL ELSE CAST(0 AS DOUBLE) END AS slope_y, CAST(NULL AS DOUBLE) AS r_y, CAST(NULL AS DOUBLE) AS slope_x, CAST(NULL AS DOUBLE) AS r_x, CAST(count(*) AS BIGINT) AS n
    FROM events GROUP BY user_id""")
def a02b(spark, d):
    rows = spark_sql(spark, d, "SELECT user_id, value, CAST(5 AS DOUBLE) AS five FROM events")
    over = lambda x, y, s: stats.line_fit(rows, ["user_id"], x, y).select(
        "user_id", F.col("slope").alias(f"slope_{s}"), F.col("r").alias(f"r_{s}"), "n"
    )
    return rounded(over("value", "five", "y").join(over("five", "value", "x").drop("n"), "user_id"))


@check("a03_pearson", "SELECT l_linestatus AS status, round(corr(l_tax, l_discount), 6) + 0.0 AS r, CAST(regr_count(l_tax, l_discount) AS BIGINT) AS n FROM lineitem GROUP BY l_linestatus")
def a03(spark, d):
    rows = spark_sql(spark, d, "SELECT l_linestatus AS status, l_discount, l_tax FROM lineitem")
    return rounded(stats.pearson(rows, ["status"], "l_discount", "l_tax"))


@check("a05_extent", "SELECT log_id, message, field, round(min(value), 6) + 0.0 AS lo, round(max(value), 6) + 0.0 AS hi FROM fleet GROUP BY log_id, message, field")
def a05(spark, d):
    return rounded(stats.extent(view(spark, d, "fleet")))


@check("a06_varies", "SELECT log_id, message, field, count(DISTINCT value) > 1 AS varies FROM fleet GROUP BY log_id, message, field")
def a06(spark, d):
    return stats.varies(view(spark, d, "fleet"))


@check("a08_log_bounds", """
    SELECT r.log_id, 'bin' AS source, coalesce(r.s, p.s, 0) AS start_us, coalesce(r.e, p.e, 0) AS end_us
    FROM (SELECT log_id, min(ts_us) FILTER (log_id IN ('0', '1')) AS s, max(ts_us) FILTER (log_id IN ('0', '1')) AS e FROM telemetry GROUP BY log_id) r
    LEFT JOIN (SELECT log_id, min(ts_us) AS s, max(ts_us) AS e FROM (SELECT CASE log_id WHEN '3' THEN 'x' ELSE log_id END AS log_id, ts_us FROM fixes) f
               GROUP BY log_id) p ON p.log_id = r.log_id""")
def a08(spark, d):
    """Logs with a clock, with a path only, and with neither: the path of log 3 goes by another name."""
    records = view(spark, d, "telemetry").withColumns({"source": F.lit("bin"), "has_time": F.col("log_id").isin("0", "1")})
    path = view(spark, d, "fixes").withColumn("log_id", F.when(F.col("log_id") == "3", "x").otherwise(F.col("log_id")))
    return tables.log_bounds(records, path)


@check("a09_message_counts", "SELECT log_id, message, CAST(count(*) AS BIGINT) AS n_rows FROM telemetry GROUP BY log_id, message")
def a09(spark, d):
    return tables.message_counts(view(spark, d, "telemetry"))


@check("a09_message_summary", """
    SELECT log_id, CAST(count(DISTINCT message) AS BIGINT) AS n_messages, CAST(count(DISTINCT message) FILTER (message NOT IN ('click', 'view')) AS BIGINT) AS n_purgeable,
           CAST(count(*) AS BIGINT) AS n_rows FROM telemetry GROUP BY log_id""")
def a09b(spark, d):
    return tables.message_summary(view(spark, d, "telemetry"), ["click", "view"])


@check("src12_catalog", "SELECT log_id, message, field, n_rows, n_finite, round(lo, 6) + 0.0 AS lo, round(hi, 6) + 0.0 AS hi, varies, first_seq, CAST(position AS BIGINT) AS position FROM fleet_catalog")
def src12(spark, d):
    return rounded(tables.catalog(view(spark, d, "fleet")))


# Taubin's fit written out: moments, then Newton as a recursion.
_CIRCLE = """WITH RECURSIVE
    pts AS (SELECT log_id, x, y FROM cloud WHERE x IS NOT NULL AND y IS NOT NULL),
    ctr AS (SELECT log_id, CAST(count(*) AS BIGINT) AS n, avg(x) AS mx, avg(y) AS my FROM pts GROUP BY log_id),
    rad AS (SELECT p.log_id, sqrt(avg((x - mx) * (x - mx) + (y - my) * (y - my))) AS s FROM pts p JOIN ctr c ON p.log_id = c.log_id GROUP BY p.log_id),
    uv AS (SELECT p.log_id, (x - mx) / s AS u, (y - my) / s AS v FROM pts p JOIN ctr c ON p.log_id = c.log_id JOIN rad r ON p.log_id = r.log_id),
    m AS (SELECT log_id, avg(u*u) AS uu, avg(v*v) AS vv, avg(u*v) AS uv, avg(u*(u*u+v*v)) AS uz, avg(v*(u*u+v*v)) AS vz, avg(u*u+v*v) AS z, avg((u*u+v*v)*(u*u+v*v)) AS zz FROM uv GROUP BY log_id),
    poly AS (SELECT *, uu*vv - uv*uv AS cov, 4*z AS a3, -3*z*z - zz AS a2, (zz - z*z)*z + 4*(uu*vv - uv*uv)*z - uz*uz - vz*vz AS a1,
             uz*(uz*vv - vz*uv) + vz*(vz*uu - uz*uv) - (zz - z*z)*(uu*vv - uv*uv) AS a0 FROM m),
    newton AS (
        SELECT log_id, 0 AS k, CAST(0 AS DOUBLE) AS r FROM poly
        UNION ALL
        SELECT n.log_id, n.k + 1, n.r - (a0 + n.r*(a1 + n.r*(a2 + n.r*a3))) / (a1 + n.r*(2*a2 + 3*a3*n.r)) FROM newton n JOIN poly p ON n.log_id = p.log_id WHERE n.k < 20),
    sol AS (SELECT p.*, n.r, 2*(n.r*n.r - n.r*z + cov) AS det FROM poly p JOIN newton n ON n.log_id = p.log_id AND n.k = 20),
    fit AS (SELECT o.log_id, c.n, (uz*(vv - r) - vz*uv)/det*s + mx AS cx, (vz*(uu - r) - uz*uv)/det*s + my AS cy,
            sqrt(pow((uz*(vv - r) - vz*uv)/det, 2) + pow((vz*(uu - r) - uz*uv)/det, 2) + z)*s AS radius
            FROM sol o JOIN ctr c ON o.log_id = c.log_id JOIN rad d ON o.log_id = d.log_id),
    away AS (SELECT p.log_id, sqrt((x - cx)*(x - cx) + (y - cy)*(y - cy)) AS d, atan2(y - cy, x - cx) AS a FROM pts p JOIN fit f ON p.log_id = f.log_id),
    gaps AS (SELECT log_id, d, a, a - lag(a) OVER (PARTITION BY log_id ORDER BY a) AS g FROM away),
    sp AS (SELECT log_id, stddev_pop(d) AS radial_std, degrees(2*pi() - greatest(max(g), min(a) + 2*pi() - max(a))) AS arc_deg FROM gaps GROUP BY log_id)
"""


@check("a10_circle_fit", _CIRCLE + """
    SELECT f.log_id, n, 'ok' AS status, round(cx, 5) AS cx, round(cy, 5) AS cy, round(radius, 5) AS radius, round(radial_std, 5) AS radial_std, round(arc_deg, 5) AS arc_deg,
           round(sqrt(cx*cx + cy*cy), 5) AS "offset", round(sqrt(cx*cx + cy*cy)/radius, 5) AS offset_ratio, round(degrees(asin(least(1, sqrt(cx*cx + cy*cy)/radius))), 5) AS heading_error_deg
    FROM fit f JOIN sp ON f.log_id = sp.log_id""")
def a10(spark, d):
    return rounded(circle.fit_circle(view(spark, d, "cloud")), 5)


@check("a10_circle_failures", """
    SELECT user_id, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) < 3 THEN 'too-few-samples' ELSE 'degenerate' END AS status FROM events GROUP BY user_id""")
def a10b(spark, d):
    """Points on one line have no circle."""
    line = spark_sql(spark, d, "SELECT user_id, value AS x, 3e0 AS y FROM events")
    return circle.fit_circle(line, ["user_id"]).select("user_id", "n", "status")


@check("a11_angular_coverage", """
    WITH t AS (SELECT log_id, radians((seq * 7) % 200) AS a FROM telemetry), g AS (SELECT log_id, a, a - lag(a) OVER (PARTITION BY log_id ORDER BY a) AS g FROM t)
    SELECT log_id, round(degrees(2*pi() - greatest(max(g), min(a) + 2*pi() - max(a))), 6) AS arc_deg FROM g GROUP BY log_id""")
def a11(spark, d):
    angles = view(spark, d, "telemetry").select("log_id", F.radians((F.col("seq") * 7) % 200).alias("a"))
    return rounded(circle.angular_coverage(angles, ["log_id"], "a"))


@check("a12_field_magnitude", "SELECT log_id, {s} FROM (SELECT log_id, sqrt(x*x + y*y + z*z) AS b FROM cloud) c GROUP BY log_id".format(s=_STATS.format(v="b")))
def a12(spark, d):
    rows = view(spark, d, "cloud").withColumn("b", stats.magnitude(F.col("x"), F.col("y"), F.col("z")))
    return rounded(stats.column_stats(rows, ["log_id"], "b"))


# --- channels ---------------------------------------------------------------------
# A channel per line number and return flag; its values are quantities.

_CHANNELS = "SELECT l_returnflag AS log_id, 'RCOU' AS message, 'C' || CAST(l_linenumber AS STRING) AS field, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_linenumber = 7 THEN 0e0 ELSE l_quantity * l_linenumber END AS value FROM lineitem"
_BANK = "SELECT DISTINCT log_id, message, field, 'SERVO' AS prefix, CAST(substring(field, 2) AS INT) AS channel FROM ({c}) c"
_ENDS = """
    SELECT log_id, 'SERVO' || CAST(channel AS STRING) || '_MIN' AS name, CAST(channel AS DOUBLE) AS value FROM ({b}) b WHERE channel <> 3
    UNION ALL SELECT log_id, 'SERVO' || CAST(channel AS STRING) || '_MAX', channel * 50e0 - 10 FROM ({b}) b WHERE channel <> 5"""
_LIMITS = """
    SELECT log_id, message, field, channel, CASE WHEN channel IN (3, 5) THEN 1100.0 ELSE channel END AS lo, CASE WHEN channel IN (3, 5) THEN 1900.0 ELSE channel * 50.0 - 10 END AS hi, channel NOT IN (3, 5) AS from_params
    FROM ({b}) b""".format(b=_BANK.format(c=_CHANNELS))
_STATE = f"""
    lim AS ({_LIMITS}), chan AS ({_CHANNELS}),
    st AS (SELECT c.log_id, c.message, c.field, l.channel, any_value(l.lo) AS lo, any_value(l.hi) AS hi, bool_and(l.from_params) AS from_params, count(value) AS n, avg(value) AS mean, min(value) AS vmin, max(value) AS vmax,
                  coalesce(stddev_samp(value), 0) AS std, avg(CASE WHEN value <= lo + 2 THEN 1.0 ELSE 0 END) AS low_share, avg(CASE WHEN value >= hi - 2 THEN 1.0 ELSE 0 END) AS high_share
           FROM chan c JOIN lim l ON c.log_id = l.log_id AND c.field = l.field GROUP BY c.log_id, c.message, c.field, l.channel),
    flagged AS (SELECT *, std = 0 AND (mean = 0 OR n <= 1) AS idle, NOT (std = 0 AND (mean = 0 OR n <= 1)) AND (vmin < lo - 2 OR vmax > hi + 2) AS out_of_bounds FROM st),
    bal AS (SELECT *, avg(mean) FILTER (NOT idle) OVER (PARTITION BY log_id) AS bank_mean FROM flagged)"""


def _state(spark, d):
    rows = spark_sql(spark, d, _CHANNELS)
    bank = spark_sql(spark, d, _BANK.format(c=_CHANNELS))
    params = spark_sql(spark, d, _ENDS.format(b=_BANK.format(c=_CHANNELS)))
    return channels.channel_state(rows, channels.channel_limits(bank, params))


@check("j13_channel_limits", f"SELECT log_id, field, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, from_params FROM ({_LIMITS}) l")
def j13(spark, d):
    bank = spark_sql(spark, d, _BANK.format(c=_CHANNELS))
    params = spark_sql(spark, d, _ENDS.format(b=_BANK.format(c=_CHANNELS)))
    return channels.channel_limits(bank, params).select("log_id", "field", "lo", "hi", "from_params")


@check("j13_manual_limits", f"SELECT log_id, field, CAST(lo AS DOUBLE) AS lo, CAST(42 AS DOUBLE) AS hi FROM ({_LIMITS}) l")
def j13b(spark, d):
    bank = spark_sql(spark, d, _BANK.format(c=_CHANNELS))
    params = spark_sql(spark, d, _ENDS.format(b=_BANK.format(c=_CHANNELS)))
    return channels.channel_limits(bank, params, manual_max=42).select("log_id", "field", "lo", "hi")


@check("a13_saturation", f"WITH {_STATE} SELECT log_id, field, CAST(n AS BIGINT) AS n, round(low_share, 6) AS low_share, round(high_share, 6) AS high_share FROM flagged")
def a13(spark, d):
    return rounded(_state(spark, d).select("log_id", "field", "n", "low_share", "high_share"))


@check("a14_channel_state", f"WITH {_STATE} SELECT log_id, field, idle, out_of_bounds FROM flagged")
def a14(spark, d):
    return _state(spark, d).select("log_id", "field", "idle", "out_of_bounds")


@check("a15_channel_balance", f"""
    WITH {_STATE} SELECT log_id, field, round(bank_mean, 6) AS bank_mean, CASE WHEN NOT idle THEN round(mean - bank_mean, 6) END AS "offset",
        coalesce(NOT idle AND abs(mean - bank_mean) > 0.05 * (hi - lo), FALSE) AS off_balance, NOT idle AND greatest(low_share, high_share) > 0.05 AS saturated FROM bal""")
def a15(spark, d):
    return rounded(channels.channel_balance(_state(spark, d)).select("log_id", "field", "bank_mean", "offset", "off_balance", "saturated"))


@check("a16_bank_summary", f"""
    WITH {_STATE}, worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY greatest(low_share, high_share) DESC, channel) AS k FROM flagged WHERE NOT idle) w WHERE k = 1)
    SELECT f.log_id, 'RCOU' AS message, CAST(count(*) FILTER (NOT f.idle) AS BIGINT) AS n_driven, any_value(w.field) AS worst_field, round(any_value(greatest(w.low_share, w.high_share)), 6) AS worst_share,
           bool_or(f.out_of_bounds) AS any_out_of_bounds, 'part parameters' AS limit_source
    FROM flagged f JOIN worst w ON f.log_id = w.log_id GROUP BY f.log_id""")
def a16(spark, d):
    return rounded(channels.bank_summary(_state(spark, d)))


# --- tracking ---------------------------------------------------------------------


@check("a17_tracking_errors", """
    SELECT log_id, n, CAST(count(act - des) AS BIGINT) AS pairs, round(avg(act - des), 6) + 0.0 AS bias, round(sqrt(avg((act - des) * (act - des))), 6) AS rms_error
    FROM pair_grid GROUP BY log_id, n HAVING n >= 8 AND count(act - des) >= 3""")
def a17(spark, d):
    return rounded(tracking.tracking_errors(view(spark, d, "pair_grid")).drop("dt"))


# Every shift written as a join of the demand with the response k points later.
_LAGS = """
    reach AS (SELECT log_id, any_value(n) AS n, any_value(dt) AS dt, CAST(greatest(1, least(greatest(8, least(400, floor(4000000.0 / any_value(n)))), floor(least(10, any_value(n) * any_value(dt) / 4) / any_value(dt) + 0.5))) AS BIGINT) AS k_max FROM pair_grid GROUP BY log_id),
    shifts AS (SELECT log_id, unnest(range(-k_max, k_max + 1)) AS k FROM reach),
    lags AS (SELECT s.log_id, s.k, CAST(regr_count(a.act, d.des) AS BIGINT) AS pairs, CASE WHEN isnan(corr(a.act, d.des)) THEN NULL ELSE corr(a.act, d.des) END AS r, regr_slope(a.act, d.des) AS slope
             FROM shifts s JOIN pair_grid d ON d.log_id = s.log_id JOIN pair_grid a ON a.log_id = s.log_id AND a.i = d.i + s.k
             GROUP BY s.log_id, s.k HAVING regr_count(a.act, d.des) >= 3)"""


@check("a18_lag_profile", f"WITH {_LAGS} SELECT log_id, CAST(k AS BIGINT) AS k, pairs, round(r, 6) + 0.0 AS r, round(slope, 6) + 0.0 AS slope FROM lags")
def a18(spark, d):
    return rounded(tracking.lag_profile(view(spark, d, "pair_grid")))


@check("a19_tracking_metrics", f"""
    WITH {_LAGS}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY r DESC, k) AS o FROM lags WHERE r IS NOT NULL) b WHERE o = 1),
    bent AS (SELECT b.*, m.r AS rm, p.r AS rp, 0.5 * (m.r - p.r) / (m.r - 2 * b.r + p.r) AS shift FROM best b LEFT JOIN lags m ON m.log_id = b.log_id AND m.k = b.k - 1 LEFT JOIN lags p ON p.log_id = b.log_id AND p.k = b.k + 1)
    SELECT t.log_id, round(slope, 6) AS gain, round(r, 6) AS r, round((k + CASE WHEN abs(shift) <= 1 THEN shift ELSE 0 END) * c.dt, 6) AS lag_sec, round(c.k_max * c.dt, 6) AS max_lag_sec, abs(k) >= c.k_max AS at_bound
    FROM bent t JOIN reach c ON c.log_id = t.log_id""")
def a19(spark, d):
    found = tracking.tracking_metrics(view(spark, d, "pair_grid"))
    return rounded(found.select("log_id", "gain", "r", "lag_sec", "max_lag_sec", "at_bound"))


_STEP = """
    j AS (SELECT *, abs(des - lag(des) OVER (PARTITION BY log_id ORDER BY i)) AS jump, lag(act) OVER (PARTITION BY log_id ORDER BY i) AS p_act FROM step_grid),
    g AS (SELECT log_id, any_value(n) AS n, any_value(dt) AS dt, median(jump) * 1.4826 AS sigma, max(jump) AS jump, count(des) AS known, max(des) - min(des) AS rng FROM j GROUP BY log_id),
    w AS (SELECT j.log_id, min(j.i) AS before FROM j JOIN g ON j.log_id = g.log_id AND j.jump = g.jump AND g.jump > 0 GROUP BY j.log_id),
    ok AS (SELECT g.*, w.before FROM g JOIN w ON w.log_id = g.log_id WHERE g.n >= 12 AND g.known >= 12 AND (g.sigma <= 0 OR g.jump >= 5 * g.sigma) AND g.rng > 0 AND g.jump >= 0.3 * g.rng AND w.before >= 5 AND g.n - w.before >= 5),
    lv AS (SELECT s.log_id, median(s.des) FILTER (s.i >= o.before) - median(s.des) FILTER (s.i < o.before) AS amp, median(s.act) FILTER (s.i < o.before) AS base FROM step_grid s JOIN ok o ON o.log_id = s.log_id GROUP BY s.log_id),
    r AS (SELECT j.*, o.before, l.amp, l.base FROM j JOIN ok o ON o.log_id = j.log_id JOIN lv l ON l.log_id = j.log_id WHERE l.amp <> 0 AND l.base IS NOT NULL AND j.i >= o.before),
    x AS (SELECT *, CASE WHEN i > before AND p_act IS NOT NULL AND act <> p_act THEN i - 1 + (base + 0.1 * amp - p_act) / (act - p_act) ELSE i END AS at10,
                 CASE WHEN i > before AND p_act IS NOT NULL AND act <> p_act THEN i - 1 + (base + 0.9 * amp - p_act) / (act - p_act) ELSE i END AS at90,
                 CASE WHEN amp > 0 THEN act >= base + 0.1 * amp ELSE act <= base + 0.1 * amp END AS hit10, CASE WHEN amp > 0 THEN act >= base + 0.9 * amp ELSE act <= base + 0.9 * amp END AS hit90 FROM r),
    z AS (SELECT log_id, any_value(before) AS before, any_value(n) AS n, any_value(dt) AS dt, any_value(amp) AS amp, any_value(base) AS base, arg_min(at10, i) FILTER (hit10) AS t10, arg_min(at90, i) FILTER (hit90) AS t90,
                 max((act - base) / amp) AS peak, max(i) FILTER (abs((act - base) / amp - 1) > 0.05) AS outside,
                 avg(act) FILTER (i >= greatest(before, n - greatest(3, floor((n - before) * 0.1 + 0.5)))) AS tail FROM x GROUP BY log_id)"""


@check("a20_step_gate", f"WITH {_STEP} SELECT log_id, CAST(before AS BIGINT) AS before, n FROM ok")
def a20(spark, d):
    from flightlake.scale import Ordered, previous

    rows = Ordered(view(spark, d, "step_grid"), ["log_id"], ["i"]).scan(_prev=previous("des", "act"))
    return tracking.step_gate(rows).drop("dt")


@check("a21_step_metrics", f"""
    WITH {_STEP} SELECT log_id, round(before * dt, 6) AS step_time_sec, round(amp, 6) AS amplitude, round(t10 * dt - before * dt, 6) + 0.0 AS delay_sec, round((t90 - t10) * dt, 6) + 0.0 AS rise_time_sec,
        round(greatest(0, (peak - 1) * 100), 6) AS overshoot_pct, CASE WHEN outside IS NULL THEN 0 WHEN outside + 1 < n THEN round((outside + 1) * dt - before * dt, 6) END AS settling_time_sec, round(tail - (base + amp), 6) + 0.0 AS steady_state_error FROM z""")
def a21(spark, d):
    return rounded(tracking.step_metrics(view(spark, d, "step_grid")))


@check("a21_no_step", "SELECT log_id, CAST(0 AS BIGINT) AS steps FROM pair_grid GROUP BY log_id")
def a21b(spark, d):
    """Daily counts wander; none of them is a step."""
    grid = view(spark, d, "pair_grid")
    found = tracking.step_metrics(grid).groupBy("log_id").agg(F.count(F.lit(1)).alias("steps"))
    return grid.select("log_id").distinct().join(found, "log_id", "left").fillna(0)


# --- spectra ----------------------------------------------------------------------

# A direct transform: every sample against every bin.
_DFT = """
    sized AS (SELECT log_id, count(*) AS n FROM signal GROUP BY log_id),
    len AS (SELECT log_id, n, CAST(pow(2, ceil(log2(n))) AS BIGINT) AS nfft FROM sized WHERE n >= 4),
    win AS (SELECT s.log_id, s.i, l.nfft, s.value * 0.5 * (1 - cos(2 * pi() * s.i / l.n)) AS x, pow(0.5 * (1 - cos(2 * pi() * s.i / l.n)), 2) AS w2 FROM signal s JOIN len l ON s.log_id = l.log_id),
    pw AS (SELECT log_id, sum(w2) AS w2 FROM win GROUP BY log_id),
    bins AS (SELECT log_id, nfft, unnest(range(nfft // 2 + 1)) AS k FROM len),
    dft AS (SELECT b.log_id, b.k, b.nfft, sum(w.x * cos(2 * pi() * ((b.k * w.i) % b.nfft) / b.nfft)) AS re, sum(w.x * sin(2 * pi() * ((b.k * w.i) % b.nfft) / b.nfft)) AS im FROM bins b JOIN win w ON w.log_id = b.log_id GROUP BY b.log_id, b.k, b.nfft),
    psd AS (SELECT d.log_id, d.k, d.k / (d.nfft * 0.1) AS freq, CASE WHEN d.k = 0 OR 2 * d.k = d.nfft THEN 1 ELSE 2 END * (re * re + im * im) * 0.1 / p.w2 AS psd FROM dft d JOIN pw p ON p.log_id = d.log_id)"""


def _spacing(points):
    return points.select("log_id").distinct().withColumn("dt", F.lit(0.1))


@check("a22_power_spectrum", f"WITH {_DFT} SELECT log_id, CAST(k AS BIGINT) AS k, round(freq, 5) AS freq, round(psd, 5) + 0.0 AS psd FROM psd")
def a22(spark, d):
    points = view(spark, d, "signal")
    out = spectrum.power_spectrum(points, _spacing(points), ["log_id"]).select("log_id", "k", "freq", "psd")
    return rounded(out, 5)


@check("a22_narrow_band", f"WITH {_DFT} SELECT log_id, CAST(k AS BIGINT) AS k, round(freq, 5) AS freq, round(psd, 5) + 0.0 AS psd FROM psd WHERE k IN (0, 1, 7, 30)")
def a22b(spark, d):
    points = view(spark, d, "signal")
    out = spectrum.narrow_band(points, _spacing(points), ["log_id"], (0, 1, 7, 30))
    return rounded(out, 5)


@check("a22_gapped_series", "SELECT log_id, CAST(0 AS BIGINT) AS bins FROM telemetry GROUP BY log_id")
def a22c(spark, d):
    """A series with a hole has no spectrum."""
    from flightlake.scale import Ordered, row_index

    rows = Ordered(view(spark, d, "telemetry"), ["log_id"], ["ts_us", "seq"]).scan(i=row_index()).rows()
    found = spectrum.power_spectrum(rows.select("log_id", "i", "value"), _spacing(rows), ["log_id"])
    counted = found.groupBy("log_id").agg(F.count(F.lit(1)).alias("bins"))
    return rows.select("log_id").distinct().join(counted, "log_id", "left").fillna(0)


@check("a23_dominant_peak", f"""
    WITH {_DFT} SELECT log_id, CAST(k AS BIGINT) AS k, round(freq, 5) AS freq, round(psd, 5) AS psd FROM (
        SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY psd DESC, k) AS o FROM psd WHERE k >= 1 AND freq >= 1) p WHERE o = 1""")
def a23(spark, d):
    points = view(spark, d, "signal")
    bins = spectrum.power_spectrum(points, _spacing(points), ["log_id"])
    return rounded(spectrum.dominant_peak(bins, ["log_id"], 1.0), 5)


@check("a24_log_view", f"""
    WITH {_DFT}, f AS (SELECT log_id, greatest(min(psd) FILTER (psd > 0), max(psd) * 1e-8) AS floor FROM psd WHERE k >= 1 GROUP BY log_id)
    SELECT p.log_id, CAST(k AS BIGINT) AS k, round(floor, 8) AS floor, CASE WHEN psd >= floor THEN round(psd, 5) + 0.0 END AS shown_psd FROM psd p JOIN f ON f.log_id = p.log_id WHERE k >= 1""")
def a24(spark, d):
    points = view(spark, d, "signal")
    bins = spectrum.power_spectrum(points, _spacing(points), ["log_id"])
    out = spectrum.log_view(bins, ["log_id"]).select("log_id", "k", "floor", "shown_psd")
    return out.select("log_id", "k", F.round("floor", 8).alias("floor"), (F.round("shown_psd", 5) + 0.0).alias("shown_psd"))


@check("a25_internal_resistance", """
    SELECT log_id, CASE WHEN regr_slope(v, c) < 0 THEN round(-regr_slope(v, c) * 1000, 6) END AS mohm
    FROM (SELECT log_id, value AS c, (CASE WHEN log_id IN ('0', '1') THEN -0.01 ELSE 0.01 END) * value + 16 + seq % 5 * 0.001 AS v FROM telemetry) t GROUP BY log_id""")
def a25(spark, d):
    sag = F.when(F.col("log_id").isin("0", "1"), -0.01).otherwise(0.01)
    rows = view(spark, d, "telemetry").select("log_id", F.col("value").alias("x"), (sag * F.col("value") + 16 + F.col("seq") % 5 * 0.001).alias("y"))
    fit = stats.line_fit(rows, ["log_id"])
    return rounded(fit.select("log_id", stats.internal_resistance(F.col("slope")).alias("mohm")))


# A pair of uneven series on one grid, response interpolated on the same stamps.
_PAIR = """
    s AS (SELECT log_id, message AS side, ts_us, seq, value, ts_us - lag(ts_us) OVER (PARTITION BY log_id, message ORDER BY ts_us, seq) AS step FROM telemetry WHERE message IN ('click', 'view')),
    e AS (SELECT log_id, side, min(ts_us) AS t0, max(ts_us) AS t1, median(step) AS step FROM s GROUP BY log_id, side),
    p AS (SELECT log_id, max(t0) AS t0, min(t1) AS t1, max(step) AS step, CAST(floor((min(t1) - max(t0)) / max(step)) + 1 AS BIGINT) AS n FROM e GROUP BY log_id),
    g AS (SELECT log_id, t0, step, n, unnest(range(n)) AS i FROM p),
    nb AS (SELECT g.log_id, g.i, g.n, g.step, s.side, g.t0 + g.i * g.step AS t,
                 arg_max(struct_pack(t := s.ts_us, v := s.value), s.ts_us) FILTER (s.ts_us <= g.t0 + g.i * g.step) AS b,
                 arg_min(struct_pack(t := s.ts_us, v := s.value), s.ts_us) FILTER (s.ts_us > g.t0 + g.i * g.step) AS a
          FROM g JOIN s ON s.log_id = g.log_id GROUP BY ALL),
    v AS (SELECT log_id, i, n, step, side, CASE WHEN b.t = t THEN b.v ELSE b.v + (t - b.t) / (a.t - b.t) * (a.v - b.v) END AS value FROM nb)"""


@check("j10_grid_pair", f"""
    WITH {_PAIR} SELECT log_id, CAST(i AS BIGINT) AS i, n, round(any_value(step) / 1000000, 6) AS dt, round(max(value) FILTER (side = 'click'), 6) AS des, round(max(value) FILTER (side = 'view'), 6) AS act
    FROM v GROUP BY log_id, i, n""")
def j10(spark, d):
    rows = view(spark, d, "telemetry")
    side = lambda m: select.field(rows, m, "value").select("log_id", "ts_us", "seq", "value")
    return rounded(tracking.grid_pair(side("click"), side("view")).select("log_id", "i", "n", "dt", "des", "act"))


