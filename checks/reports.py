"""Detection rules and the reports built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.analysis import _DFT, _STATS
from checks.registry import check, rounded
from checks.views import spark_sql, view
from flightlake.operators import tables
from flightlake.plans import reports, rules


def _names(*fields: str) -> str:
    return ", ".join(f"'{f}'" for f in fields)


def _values(rows) -> str:
    cell = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)"
    return ", ".join(f"({i}, {', '.join(map(cell, r))})" for i, r in enumerate(rows))


_COMPASS = """
    SELECT log_id, message, CASE WHEN n1 = 3 THEN 'MagX' ELSE 'xmag' END AS x_field, CASE WHEN n1 = 3 THEN 'MagY' ELSE 'ymag' END AS y_field, CASE WHEN n1 = 3 THEN 'MagZ' ELSE 'zmag' END AS z_field,
           row_number() OVER (PARTITION BY log_id ORDER BY coalesce(TRY_CAST(regexp_extract(message, '([0-9]+)$', 1) AS INT), 0), message) AS pos
    FROM (SELECT log_id, message, count(*) FILTER (field IN ('MagX', 'MagY', 'MagZ')) AS n1, count(*) FILTER (field IN ('xmag', 'ymag', 'zmag')) AS n2 FROM fleet_catalog GROUP BY log_id, message) c
    WHERE n1 = 3 OR n2 = 3"""


@check("r01_compass_sources", _COMPASS)
def r01(spark, d):
    return rounded(rules.compass_sources(view(spark, d, "fleet_catalog")))


_DRIVERS = f"""
    SELECT c.log_id, c.message, c.field, r.kind, r.unit, row_number() OVER (PARTITION BY c.log_id ORDER BY r.rule) AS pos
    FROM fleet_catalog c JOIN (VALUES {_values(rules.DRIVERS)}) AS r(rule, message, field, kind, unit) ON c.message = r.message AND c.field = r.field"""


@check("r02_driver_sources", _DRIVERS)
def r02(spark, d):
    return rounded(rules.driver_sources(view(spark, d, "fleet_catalog")))


_CHANNELS = """
    SELECT log_id, message, field, kind, prefix, channel, n_channels FROM (
        SELECT *, count(*) OVER (PARTITION BY log_id, message) AS n_channels FROM (
            SELECT log_id, message, field,
                   CASE WHEN message LIKE 'RCOU%' OR message = 'SERVO_OUTPUT_RAW' THEN 'output' ELSE 'input' END AS kind,
                   CASE WHEN message LIKE 'RCOU%' OR message = 'SERVO_OUTPUT_RAW' THEN 'SERVO' ELSE 'RC' END AS prefix,
                   TRY_CAST(regexp_extract(field, CASE WHEN message LIKE 'RCOU%' OR message LIKE 'RCIN%' THEN '^C([0-9]+)$' WHEN message = 'SERVO_OUTPUT_RAW' THEN '^servo([0-9]+)Raw$'
                                                       WHEN message IN ('RC_CHANNELS', 'RC_CHANNELS_RAW') THEN '^chan([0-9]+)Raw$' END, 1) AS BIGINT) AS channel
            FROM fleet_catalog) a WHERE channel IS NOT NULL) b WHERE n_channels >= 2"""


@check("r03_actuator_channels", _CHANNELS)
def r03(spark, d):
    return rounded(rules.actuator_channels(view(spark, d, "fleet_catalog")))


@check("r03_actuator_banks", f"""
    SELECT log_id, message, kind, prefix, CAST(count(*) AS BIGINT) AS n_channels, row_number() OVER (PARTITION BY log_id ORDER BY CASE kind WHEN 'output' THEN 0 ELSE 1 END, message) AS pos
    FROM ({_CHANNELS}) c GROUP BY log_id, message, kind, prefix""")
def r03b(spark, d):
    return rounded(rules.actuator_banks(view(spark, d, "fleet_catalog")))


_PAIRS = f"""
    SELECT x.log_id, r.*, x.varies AND y.varies AS varies, row_number() OVER (PARTITION BY x.log_id ORDER BY CASE WHEN x.varies AND y.varies THEN 0 ELSE 1 END, r.rule) AS pos
    FROM (VALUES {_values(rules.PAIRS)}) AS r(rule, label, des_message, des_field, des_scale, act_message, act_field, act_scale, unit, wrap)
    JOIN fleet_catalog x ON x.message = r.des_message AND x.field = r.des_field JOIN fleet_catalog y ON y.log_id = x.log_id AND y.message = r.act_message AND y.field = r.act_field"""


@check("r04_tracking_pairs", f"SELECT log_id, label, des_message, des_field, round(des_scale, 6) AS des_scale, act_message, act_field, round(act_scale, 6) AS act_scale, unit, wrap, varies, pos FROM ({_PAIRS}) p")
def r04(spark, d):
    return rounded(rules.tracking_pairs(view(spark, d, "fleet_catalog")))


_PRESETS = f"""
    SELECT * EXCLUDE (k, rule), row_number() OVER (PARTITION BY log_id ORDER BY rule) AS pos FROM (
        SELECT x.log_id, r.*, row_number() OVER (PARTITION BY x.log_id, r.label ORDER BY r.rule) AS k
        FROM (VALUES {_values(rules.SCATTERS)}) AS r(rule, label, x_message, x_field, x_scale, x_unit, y_message, y_field, y_scale, y_unit, meaning)
        JOIN fleet_catalog x ON x.message = r.x_message AND x.field = r.x_field JOIN fleet_catalog y ON y.log_id = x.log_id AND y.message = r.y_message AND y.field = r.y_field) p WHERE k = 1"""


@check("r05_scatter_presets", _PRESETS)
def r05(spark, d):
    return rounded(rules.scatter_presets(view(spark, d, "fleet_catalog")))


@check("r06_onboard_spectra", """
    SELECT log_id, message, field, CAST(position AS BIGINT) AS position FROM fleet_catalog
    WHERE message IN ('FTN1', 'FTN2', 'FTNS') AND (lower(field) LIKE 'pk%' OR lower(field) LIKE 'fr%' OR lower(field) LIKE 'en%' OR lower(field) LIKE '%freq%')""")
def r06(spark, d):
    return rounded(rules.onboard_spectra(view(spark, d, "fleet_catalog")))


@check("r06_batch_sampling", "SELECT log_id, bool_or(message = 'ISBH') AND bool_or(message = 'ISBD') AS has_batch FROM fleet_catalog GROUP BY log_id")
def r06b(spark, d):
    return rules.batch_sampling(view(spark, d, "fleet_catalog"))


@check("r07_modules", f"""
    SELECT log_id, TRUE AS stats, TRUE AS scatter, TRUE AS spectrum, log_id IN (SELECT log_id FROM ({_COMPASS}) a) AS compass,
           log_id IN (SELECT log_id FROM ({_CHANNELS}) b) AS outputs, log_id IN (SELECT log_id FROM ({_PAIRS}) p) AS tracking
    FROM (SELECT DISTINCT log_id FROM fleet_catalog) l""")
def r07(spark, d):
    return rules.modules(view(spark, d, "fleet_catalog"))


_SELECTED = [("ATT", "Roll"), ("VFR_HUD", "heading"), ("NONE", "Such")]
_EXTRA = [("BAT", "Volt"), ("ATT", "Roll")]
_INSIDE = "SELECT log_id, min(ts_us) + 86400000000 AS t0, max(ts_us) - 86400000000 AS t1 FROM telemetry GROUP BY log_id"


@check("r08_window_stats", f"""
    WITH refs AS (SELECT * FROM (VALUES (0, 'ATT', 'Roll'), (1, 'VFR_HUD', 'heading'), (2, 'NONE', 'Such'), (3, 'BAT', 'Volt')) AS v(pos, message, field)),
    st AS (SELECT f.log_id, f.message, f.field, {_STATS.format(v='value')} FROM fleet f JOIN ({_INSIDE}) w ON f.log_id = w.log_id WHERE f.ts_us BETWEEN w.t0 AND w.t1 GROUP BY f.log_id, f.message, f.field)
    SELECT l.log_id, r.message, r.field, r.pos, coalesce(s.n, 0) AS n, s.mean, s.min, s.max, s.std, s.rms, s.cv
    FROM (SELECT DISTINCT log_id FROM fleet) l CROSS JOIN refs r LEFT JOIN st s ON s.log_id = l.log_id AND s.message = r.message AND s.field = r.field""")
def r08(spark, d):
    return rounded(reports.window_stats(view(spark, d, "fleet"), _SELECTED, _EXTRA, spark_sql(spark, d, _INSIDE)))


_MAG = f"""
    cs AS ({_COMPASS}),
    mg AS (SELECT c.log_id, c.message, f.seq, f.ts_us, max(value) FILTER (f.field = c.x_field) AS x, max(value) FILTER (f.field = c.y_field) AS y, max(value) FILTER (f.field = c.z_field) AS z
           FROM cs c JOIN fleet f ON f.log_id = c.log_id AND f.message = c.message GROUP BY c.log_id, c.message, f.seq, f.ts_us),
    pts AS (SELECT log_id || '/' || message AS g, x, y FROM mg WHERE x IS NOT NULL AND y IS NOT NULL),
    ctr AS (SELECT g, CAST(count(*) AS BIGINT) AS n, avg(x) AS mx, avg(y) AS my FROM pts GROUP BY g),
    rad AS (SELECT p.g, sqrt(avg((x - mx)*(x - mx) + (y - my)*(y - my))) AS s FROM pts p JOIN ctr c ON p.g = c.g GROUP BY p.g),
    uv AS (SELECT p.g, (x - mx)/s AS u, (y - my)/s AS v FROM pts p JOIN ctr c ON p.g = c.g JOIN rad r ON p.g = r.g),
    m AS (SELECT g, avg(u*u) AS uu, avg(v*v) AS vv, avg(u*v) AS uv, avg(u*(u*u+v*v)) AS uz, avg(v*(u*u+v*v)) AS vz, avg(u*u+v*v) AS z, avg((u*u+v*v)*(u*u+v*v)) AS zz FROM uv GROUP BY g),
    poly AS (SELECT *, uu*vv - uv*uv AS cov, 4*z AS a3, -3*z*z - zz AS a2, (zz - z*z)*z + 4*(uu*vv - uv*uv)*z - uz*uz - vz*vz AS a1,
             uz*(uz*vv - vz*uv) + vz*(vz*uu - uz*uv) - (zz - z*z)*(uu*vv - uv*uv) AS a0 FROM m),
    newton AS (SELECT g, 0 AS k, CAST(0 AS DOUBLE) AS r FROM poly UNION ALL
        SELECT n.g, n.k + 1, n.r - (a0 + n.r*(a1 + n.r*(a2 + n.r*a3)))/(a1 + n.r*(2*a2 + 3*a3*n.r)) FROM newton n JOIN poly p ON n.g = p.g WHERE n.k < 20),
    sol AS (SELECT p.*, n.r, 2*(n.r*n.r - n.r*z + cov) AS det FROM poly p JOIN newton n ON n.g = p.g AND n.k = 20),
    fit AS (SELECT o.g, c.n, (uz*(vv - r) - vz*uv)/det*s + mx AS cx, (vz*(uu - r) - uz*uv)/det*s + my AS cy,
            sqrt(pow((uz*(vv - r) - vz*uv)/det, 2) + pow((vz*(uu - r) - uz*uv)/det, 2) + z)*s AS radius FROM sol o JOIN ctr c ON o.g = c.g JOIN rad d ON o.g = d.g),
    bs AS (SELECT log_id || '/' || message AS g, avg(sqrt(x*x + y*y + z*z)) AS b_mean FROM mg GROUP BY 1),
    dr AS (SELECT f.log_id, f.ts_us, f.value FROM fleet f JOIN ({_DRIVERS}) v ON v.log_id = f.log_id AND v.message = f.message AND v.field = f.field AND v.pos = 1),
    ends AS (SELECT log_id, min(ts_us) AS d0, max(ts_us) AS d1 FROM dr GROUP BY log_id),
    nb AS (SELECT q.log_id, q.message, q.seq, q.ts_us AS t, sqrt(q.x*q.x + q.y*q.y + q.z*q.z) AS b,
                  arg_max(struct_pack(t := d.ts_us, v := d.value), d.ts_us) FILTER (d.ts_us <= q.ts_us) AS lo, arg_min(struct_pack(t := d.ts_us, v := d.value), d.ts_us) FILTER (d.ts_us > q.ts_us) AS hi
           FROM mg q JOIN dr d ON d.log_id = q.log_id GROUP BY ALL),
    ld AS (SELECT n.log_id || '/' || message AS g, n.b, CASE WHEN t < d0 OR t > d1 THEN NULL WHEN lo.t = t THEN lo.v ELSE lo.v + CAST(t - lo.t AS DOUBLE)/(hi.t - lo.t)*(hi.v - lo.v) END AS drive FROM nb n JOIN ends e ON e.log_id = n.log_id),
    lf AS (SELECT g, regr_slope(b, drive) AS load_slope, corr(b, drive) AS load_r, CAST(regr_count(b, drive) AS BIGINT) AS load_n FROM ld GROUP BY g)"""


@check("r09_compass_report", f"""WITH RECURSIVE {_MAG}
    SELECT c.log_id, c.message, c.pos, f.n, round(cx, 5) + 0.0 AS cx, round(cy, 5) + 0.0 AS cy, round(radius, 5) AS radius, round(b_mean, 5) AS b_mean, round(load_slope, 5) + 0.0 AS load_slope, round(load_r, 5) + 0.0 AS load_r, load_n
    FROM cs c JOIN fit f ON f.g = c.log_id || '/' || c.message JOIN bs ON bs.g = f.g JOIN lf ON lf.g = f.g""")
def r09(spark, d):
    out = reports.compass_report(view(spark, d, "fleet"), view(spark, d, "fleet_catalog"))
    return rounded(out.select("log_id", "message", "pos", "n", "cx", "cy", "radius", "b_mean", "load_slope", "load_r", "load_n"), 5)


_ENDS = """
    SELECT log_id, 'SERVO1_MIN' AS name, 1010e0 AS value FROM telemetry GROUP BY log_id
    UNION ALL SELECT log_id, 'SERVO1_MAX', 1500e0 FROM telemetry GROUP BY log_id
    UNION ALL SELECT log_id, 'RC1_MIN', 1101e0 FROM telemetry GROUP BY log_id"""


@check("r10_outputs_report", f"""
    WITH ch AS (SELECT *, CASE WHEN prefix = 'SERVO' AND channel = 1 THEN 1010.0 ELSE 1100.0 END AS lo, CASE WHEN prefix = 'SERVO' AND channel = 1 THEN 1500.0 ELSE 1900.0 END AS hi FROM ({_CHANNELS}) c),
    st AS (SELECT c.log_id, c.message, c.field, c.channel, any_value(lo) AS lo, any_value(hi) AS hi, count(value) AS n, avg(value) AS mean, min(value) AS mn, max(value) AS mx, coalesce(stddev_samp(value), 0) AS std,
                  avg(CASE WHEN value <= lo + 2 THEN 1.0 WHEN value IS NOT NULL THEN 0 END) AS low_share, avg(CASE WHEN value >= hi - 2 THEN 1.0 WHEN value IS NOT NULL THEN 0 END) AS high_share
           FROM ch c JOIN fleet f ON f.log_id = c.log_id AND f.message = c.message AND f.field = c.field GROUP BY c.log_id, c.message, c.field, c.channel),
    fl AS (SELECT *, std = 0 AND mean = 0 AS idle FROM st),
    bl AS (SELECT *, CASE WHEN count(*) FILTER (NOT idle) OVER w >= 2 THEN avg(mean) FILTER (NOT idle) OVER w END AS bank_mean FROM fl WINDOW w AS (PARTITION BY log_id, message))
    SELECT log_id, message, field, CAST(n AS BIGINT) AS n, round(mean, 6) + 0.0 AS mean, round(low_share, 6) AS low_share, round(high_share, 6) AS high_share, idle, NOT idle AND (mn < lo - 2 OR mx > hi + 2) AS out_of_bounds,
           round(bank_mean, 6) AS bank_mean, NOT idle AND greatest(low_share, high_share) > 0.05 AS saturated FROM bl""")
def r10(spark, d):
    out = reports.outputs_report(view(spark, d, "fleet"), view(spark, d, "fleet_catalog"), spark_sql(spark, d, _ENDS))
    return rounded(out.select("log_id", "message", "field", "n", "mean", "low_share", "high_share", "idle", "out_of_bounds", "bank_mean", "saturated"))


_BANKS = """
    WITH ch AS (SELECT *, {lo} AS lo, {hi} AS hi, {known} AS known FROM ({channels}) c),
    st AS (SELECT c.log_id, c.message, c.field, c.channel, any_value(c.known) AS known, any_value(lo) AS lo, any_value(hi) AS hi, avg(value) AS mean, min(value) AS mn, max(value) AS mx, coalesce(stddev_samp(value), 0) AS std,
                  avg(CASE WHEN value <= lo + 2 THEN 1.0 WHEN value IS NOT NULL THEN 0 END) AS low_share, avg(CASE WHEN value >= hi - 2 THEN 1.0 WHEN value IS NOT NULL THEN 0 END) AS high_share
           FROM ch c JOIN fleet f ON f.log_id = c.log_id AND f.message = c.message AND f.field = c.field GROUP BY c.log_id, c.message, c.field, c.channel),
    fl AS (SELECT *, std = 0 AND mean = 0 AS idle, greatest(low_share, high_share) AS share FROM st)
    SELECT log_id, message, CAST(count(*) FILTER (NOT idle) AS BIGINT) AS n_driven,
           first(field ORDER BY share DESC, channel) FILTER (NOT idle) AS worst_field, round(max(share) FILTER (NOT idle), 6) AS worst_share,
           bool_or(NOT idle AND (mn < lo - 2 OR mx > hi + 2)) AS any_out_of_bounds, {source} AS limit_source
    FROM fl GROUP BY log_id, message"""
_FROM_PARAMS = """CASE WHEN count(*) FILTER (NOT idle) > 0 AND count(*) FILTER (NOT idle AND NOT known) = 0 THEN 'parameters'
    WHEN count(*) FILTER (NOT idle AND known) > 0 THEN 'part parameters' ELSE 'defaults' END"""
_FIRST = "prefix = 'SERVO' AND channel = 1"


@check("r10_bank_lines", _BANKS.format(
    lo=f"CASE WHEN {_FIRST} THEN 1010.0 ELSE 1100.0 END", hi=f"CASE WHEN {_FIRST} THEN 1500.0 ELSE 1900.0 END", known=_FIRST, channels=_CHANNELS, source=_FROM_PARAMS))
def r10_banks(spark, d):
    _, banks = reports.outputs_banks(view(spark, d, "fleet"), view(spark, d, "fleet_catalog"), spark_sql(spark, d, _ENDS))
    return rounded(banks)


@check("r10_bank_lines_manual", _BANKS.format(lo="1200.0", hi="1700.0", known="TRUE", channels=_CHANNELS, source="'manual'"))
def r10_manual(spark, d):
    _, banks = reports.outputs_banks(
        view(spark, d, "fleet"), view(spark, d, "fleet_catalog"), spark_sql(spark, d, _ENDS), manual_min=1200, manual_max=1700
    )
    return rounded(banks)


# Each pair: scaled rows, unwrapped if an angle, both on one grid, aligned, measured.
_TRACK = f"""
    pr AS ({_PAIRS}),
    rw AS (SELECT p.log_id, p.label, p.wrap, 'des' AS side, f.ts_us, f.seq, f.value * p.des_scale AS value FROM pr p JOIN fleet f ON f.log_id = p.log_id AND f.message = p.des_message AND f.field = p.des_field
           UNION ALL SELECT p.log_id, p.label, p.wrap, 'act', f.ts_us, f.seq, f.value * p.act_scale FROM pr p JOIN fleet f ON f.log_id = p.log_id AND f.message = p.act_message AND f.field = p.act_field),
    kn AS (SELECT *, value - lag(value) OVER (PARTITION BY log_id, label, side ORDER BY ts_us, seq) AS st FROM rw WHERE value IS NOT NULL AND wrap > 0),
    un AS (SELECT log_id, label, side, seq, value - sum(coalesce(floor(st/360 + 0.5), 0)*360) OVER (PARTITION BY log_id, label, side ORDER BY ts_us, seq) AS value FROM kn),
    rd AS (SELECT r.log_id, r.label, r.wrap, r.side, r.ts_us, r.seq, CASE WHEN r.wrap > 0 THEN u.value ELSE r.value END AS value, r.ts_us - lag(r.ts_us) OVER (PARTITION BY r.log_id, r.label, r.side ORDER BY r.ts_us, r.seq) AS gap
           FROM rw r LEFT JOIN un u ON u.log_id = r.log_id AND u.label = r.label AND u.side = r.side AND u.seq = r.seq),
    en AS (SELECT log_id, label, wrap, side, count(*) AS c, min(ts_us) AS t0, max(ts_us) AS t1, median(gap) AS step FROM rd GROUP BY ALL),
    pl AS (SELECT log_id, label, wrap, max(t0) AS t0, max(step) AS step, CAST(floor((min(t1) - max(t0))/max(step)) + 1 AS BIGINT) AS n FROM en GROUP BY log_id, label, wrap HAVING min(c) >= 4),
    gr AS (SELECT *, unnest(range(n)) AS i FROM pl WHERE n >= 8),
    nb AS (SELECT g.log_id, g.label, g.wrap, g.n, g.step, g.i, r.side, g.t0 + g.i*g.step AS t,
                  arg_max(struct_pack(t := r.ts_us, v := r.value), r.ts_us) FILTER (r.ts_us <= g.t0 + g.i*g.step) AS lo, arg_min(struct_pack(t := r.ts_us, v := r.value), r.ts_us) FILTER (r.ts_us > g.t0 + g.i*g.step) AS hi
           FROM gr g JOIN rd r ON r.log_id = g.log_id AND r.label = g.label GROUP BY ALL),
    vl AS (SELECT *, CASE WHEN lo.t = t THEN lo.v ELSE lo.v + (t - lo.t)/(hi.t - lo.t)*(hi.v - lo.v) END AS value FROM nb),
    wd AS (SELECT log_id, label, wrap, n, step/1000000 AS dt, i, max(value) FILTER (side = 'des') AS des, max(value) FILTER (side = 'act') AS raw FROM vl GROUP BY ALL),
    gd AS (SELECT *, CASE WHEN wrap > 0 THEN des + (raw - des) - floor((raw - des)/wrap + 0.5)*wrap ELSE raw END AS act FROM wd),
    er AS (SELECT log_id, label, n, dt, CAST(count(act - des) AS BIGINT) AS pairs, avg(act - des) AS bias, sqrt(avg((act - des)*(act - des))) AS rms FROM gd GROUP BY log_id, label, n, dt HAVING count(act - des) >= 3),
    rc AS (SELECT *, CAST(greatest(1, least(greatest(8, least(400, floor(4000000.0/n))), floor(least(10, n*dt/4)/dt + 0.5))) AS BIGINT) AS k_max FROM er),
    sh AS (SELECT log_id, label, unnest(range(-k_max, k_max + 1)) AS k FROM rc),
    lg AS (SELECT s.log_id, s.label, s.k, CASE WHEN isnan(corr(a.act, x.des)) THEN NULL ELSE corr(a.act, x.des) END AS r, regr_slope(a.act, x.des) AS slope
           FROM sh s JOIN gd x ON x.log_id = s.log_id AND x.label = s.label JOIN gd a ON a.log_id = s.log_id AND a.label = s.label AND a.i = x.i + s.k GROUP BY s.log_id, s.label, s.k HAVING regr_count(a.act, x.des) >= 3),
    bt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_id, label ORDER BY r DESC, k) AS o FROM lg WHERE r IS NOT NULL) b WHERE o = 1)"""


@check("r11_tracking_report", f"""
    WITH {_TRACK} SELECT p.log_id, p.label, p.varies, p.pos, e.n, e.pairs, round(e.bias, 5) + 0.0 AS bias, round(e.rms, 5) + 0.0 AS rms_error, round(b.r, 5) + 0.0 AS r, round(b.slope, 5) + 0.0 AS gain, round(e.k_max*e.dt, 4) AS max_lag_sec, coalesce(b.r < 0.5, FALSE) AS weak
    FROM pr p LEFT JOIN (rc e JOIN bt b ON b.log_id = e.log_id AND b.label = e.label) ON e.log_id = p.log_id AND e.label = p.label""")
def r11(spark, d):
    out = reports.tracking_report(view(spark, d, "fleet"), view(spark, d, "fleet_catalog"))
    return rounded(out.select("log_id", "label", "varies", "pos", "n", "pairs", "bias", "rms_error", "r", "gain", F.round("max_lag_sec", 4).alias("max_lag_sec"), "weak"), 5)


# The sparser axis lends its stamps; the other is interpolated from its whole series.
_SCATTER = f"""
    ps AS ({_PRESETS}),
    ax AS (SELECT p.log_id, p.label, 'x' AS side, f.ts_us, f.seq, f.value FROM ps p JOIN fleet f ON f.log_id = p.log_id AND f.message = p.x_message AND f.field = p.x_field
           UNION ALL SELECT p.log_id, p.label, 'y', f.ts_us, f.seq, f.value FROM ps p JOIN fleet f ON f.log_id = p.log_id AND f.message = p.y_message AND f.field = p.y_field),
    sz AS (SELECT a.log_id, a.label, count(*) FILTER (side = 'x') <= count(*) FILTER (side = 'y') AS x_leads FROM ax a JOIN ({_INSIDE}) w ON w.log_id = a.log_id WHERE ts_us BETWEEN t0 AND t1 GROUP BY a.log_id, a.label),
    lead_rows AS (SELECT a.* FROM ax a JOIN sz s ON s.log_id = a.log_id AND s.label = a.label AND (a.side = 'x') = s.x_leads JOIN ({_INSIDE}) w ON w.log_id = a.log_id WHERE ts_us BETWEEN t0 AND t1),
    other_rows AS (SELECT a.* FROM ax a JOIN sz s ON s.log_id = a.log_id AND s.label = a.label AND (a.side = 'x') <> s.x_leads),
    oe AS (SELECT log_id, label, min(ts_us) AS o0, max(ts_us) AS o1 FROM other_rows GROUP BY log_id, label),
    nb AS (SELECT l.log_id, l.label, l.side, l.ts_us AS t, l.seq, l.value, arg_max(struct_pack(t := o.ts_us, v := o.value), o.ts_us) FILTER (o.ts_us <= l.ts_us) AS lo, arg_min(struct_pack(t := o.ts_us, v := o.value), o.ts_us) FILTER (o.ts_us > l.ts_us) AS hi
           FROM lead_rows l JOIN other_rows o ON o.log_id = l.log_id AND o.label = l.label GROUP BY ALL),
    pt AS (SELECT n.log_id, n.label, side, value AS own, CASE WHEN t < o0 OR t > o1 THEN NULL WHEN lo.t = t THEN lo.v ELSE lo.v + CAST(t - lo.t AS DOUBLE)/(hi.t - lo.t)*(hi.v - lo.v) END AS oth FROM nb n JOIN oe e ON e.log_id = n.log_id AND e.label = n.label),
    xy AS (SELECT t.log_id, t.label, CASE WHEN side = 'x' THEN own ELSE oth END * p.x_scale AS x, CASE WHEN side = 'x' THEN oth ELSE own END * p.y_scale AS y FROM pt t JOIN ps p ON p.log_id = t.log_id AND p.label = t.label),
    ft AS (SELECT log_id, label, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, corr(y, x) AS r, CAST(regr_count(y, x) AS BIGINT) AS n FROM xy GROUP BY log_id, label)"""


@check("r12_scatter_report", f"""
    WITH {_SCATTER} SELECT p.log_id, p.label, p.pos, round(f.slope, 5) + 0.0 AS slope, round(f.intercept, 5) + 0.0 AS intercept, round(f.r, 5) + 0.0 AS r, round(f.r*f.r, 5) AS r2, f.n,
        CASE WHEN p.meaning IS NOT NULL AND f.slope < 0 THEN round(-f.slope*1000, 5) END AS resistance_mohm, coalesce(abs(f.r) < 0.5, FALSE) AS weak
    FROM ps p JOIN ft f ON f.log_id = p.log_id AND f.label = p.label""")
def r12(spark, d):
    catalog = view(spark, d, "fleet_catalog")
    out = reports.scatter_report(view(spark, d, "fleet"), rules.scatter_presets(catalog), spark_sql(spark, d, _INSIDE), catalog)
    return rounded(out.select("log_id", "label", "pos", "slope", "intercept", "r", "r2", "n", "resistance_mohm", "weak"), 5)


@check("r13_spectrum_field", """
    SELECT log_id, CASE WHEN log_id = '3' THEN 'VFR_HUD' ELSE 'RATE' END AS message, CASE WHEN log_id = '3' THEN 'heading' ELSE 'R' END AS field
    FROM (SELECT DISTINCT log_id FROM fleet_catalog) l""")
def r13(spark, d):
    return rules.spectrum_field(view(spark, d, "fleet_catalog"))


_EVEN = "SELECT log_id, 'CNT' AS message, 'n' AS field, i AS seq, i * 100000 AS ts_us, value FROM signal"


@check("r13_spectrum_report", f"""
    WITH {_DFT}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY psd DESC, k) AS o FROM psd WHERE k >= 1) t WHERE o = 1)
    SELECT t.log_id, 'ok' AS status, CAST(l.n AS BIGINT) AS n_grid, CAST(0 AS BIGINT) AS dropped, round(t.freq, 5) AS peak_freq, round(t.psd, 4) AS peak_psd FROM top t JOIN len l ON l.log_id = t.log_id""".replace(
    "psd AS (SELECT d.log_id", "psd AS (SELECT d.log_id").replace("FROM signal s JOIN len", "FROM leveled s JOIN len").replace(
    "    sized AS (", """    lined AS (SELECT log_id, regr_slope(value, i) AS m, avg(value) AS my, avg(i) AS mx FROM signal GROUP BY log_id),
    leveled AS (SELECT s.log_id, s.i, s.value - (l.my + l.m * (s.i - l.mx)) AS value FROM signal s JOIN lined l ON l.log_id = s.log_id),
    sized AS ("""))
def r13b(spark, d):
    rows = spark_sql(spark, d, _EVEN)
    status, _ = reports.spectrum_report(rows, rows.select("log_id", "message", "field").distinct())
    out = status.select("log_id", "status", "n_grid", "dropped", "peak_freq", F.round("peak_psd", 4).alias("peak_psd"))
    return rounded(out, 5)


@check("r13_spectrum_refusals", """
    SELECT log_id, CASE WHEN log_id = '3' THEN 'missing' ELSE 'gaps' END AS status FROM telemetry GROUP BY log_id""")
def r13c(spark, d):
    rows = view(spark, d, "telemetry")
    series = F.when(F.col("log_id") == "3", "absent").otherwise("click")
    chosen = rows.select("log_id", series.alias("message"), F.lit("value").alias("field")).distinct()
    holed = rows.withColumn("value", F.when(F.col("seq") % 3 != 0, F.col("value")))
    status, _ = reports.spectrum_report(holed, chosen)
    return status.select("log_id", "status")


_START = "SELECT log_id, min(ts_us) AS start_us FROM telemetry GROUP BY log_id"


@check("r14_plot_extract", f"""
    SELECT u.log_id, u.ts_us, round((u.ts_us - s.start_us) / 1000000.0, 6) AS x, c.value AS click, v.value AS view_value
    FROM (SELECT DISTINCT log_id, ts_us FROM telemetry WHERE message IN ('click', 'view')) u JOIN ({_START}) s ON s.log_id = u.log_id
    LEFT JOIN telemetry c ON c.log_id = u.log_id AND c.ts_us = u.ts_us AND c.message = 'click' LEFT JOIN telemetry v ON v.log_id = u.log_id AND v.ts_us = u.ts_us AND v.message = 'view'""")
def r14(spark, d):
    out = reports.plot_extract(view(spark, d, "telemetry"), None, spark_sql(spark, d, _START), [("click", "value"), ("view", "value")])
    return rounded(out.select("log_id", "ts_us", "x", F.col("`click.value`").alias("click"), F.col("`view.value`").alias("view_value")))


@check("r14_plot_extents", """
    SELECT log_id, message || '.value' AS label, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM telemetry WHERE message IN ('click', 'view') GROUP BY log_id, message
    UNION ALL SELECT DISTINCT log_id, 'absent.value', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM telemetry""")
def r14_extents(spark, d):
    refs = [("click", "value"), ("view", "value"), ("absent", "value")]
    extract = reports.plot_extract(view(spark, d, "telemetry"), None, spark_sql(spark, d, _START), refs)
    return rounded(reports.plot_extents(extract, refs))


_RECORDS = "SELECT log_id, seq, ts_us, message, map('a', value, 'b', CAST(seq AS DOUBLE)) AS nums FROM hourly"


@check("j06_same_message", f"""
    SELECT h.log_id, h.seq, round((h.ts_us - s.start_us) / 1000000.0, 6) + 0.0 AS x, value AS a, CAST(seq AS DOUBLE) AS b
    FROM hourly h JOIN (SELECT log_id, min(ts_us) AS start_us FROM hourly GROUP BY log_id) s ON s.log_id = h.log_id WHERE message = 'click'""")
def j06(spark, d):
    rows = view(spark, d, "hourly")
    bounds = spark_sql(spark, d, "SELECT log_id, min(ts_us) AS start_us FROM hourly GROUP BY log_id")
    out = reports.plot_extract(rows, spark_sql(spark, d, _RECORDS), bounds, [("click", "a"), ("click", "b")])
    return rounded(out.select("log_id", "seq", "x", F.col("`click.a`").alias("a"), F.col("`click.b`").alias("b")))


# Records of two kinds of log: positions, headings, parameters, modes, texts, plan.
_LOGS = """
    SELECT t.log_id, CASE WHEN t.log_id = '3' THEN 'tlog' ELSE 'bin' END AS source, t.seq, t.seq % 7 AS msg_type,
           CASE WHEN t.log_id = '3' THEN element_at(array('GLOBAL_POSITION_INT', 'ATTITUDE', 'PARAM_VALUE', 'HEARTBEAT', 'STATUSTEXT', 'MISSION_ITEM', 'GPS_RAW_INT'), CAST(t.seq % 7 AS INT) + 1)
                ELSE element_at(array('POS', 'ATT', 'PARM', 'MODE', 'MSG', 'CMD', 'GPS'), CAST(t.seq % 7 AS INT) + 1) END AS message,
           t.ts_us, TRUE AS has_time,
           CASE t.seq % 7
                WHEN 0 THEN CASE WHEN t.log_id = '3' THEN map('lat', floor(p.lat * 10) * 1e6, 'lon', floor(p.lon * 10) * 1e6, 'relativeAlt', t.value, 'hdg', CASE WHEN t.seq % 2 = 0 THEN 65535e0 ELSE CAST(t.seq % 36000 AS DOUBLE) END)
                                 WHEN t.log_id = '0' THEN map('Lat', 0e0, 'Lng', 0e0, 'Alt', t.value) ELSE map('Lat', p.lat, 'Lng', p.lon, 'Alt', t.value) END
                WHEN 1 THEN CASE WHEN t.log_id = '3' THEN map('yaw', t.value) ELSE map('Yaw', CAST(t.seq % 360 AS DOUBLE)) END
                WHEN 2 THEN map('Value', t.value, 'paramValue', t.value)
                WHEN 3 THEN CASE WHEN t.log_id = '1' THEN map('ModeNum', CAST(floor(coalesce(t.value, 0) / 40) AS DOUBLE)) ELSE map('Mode', CAST(floor(coalesce(t.value, 0) / 40) AS DOUBLE), 'customMode', CAST(floor(coalesce(t.value, 0) / 40) AS DOUBLE)) END
                WHEN 4 THEN map('severity', CAST(t.seq % 5 AS DOUBLE))
                WHEN 5 THEN map('CNum', CAST(t.seq % 11 AS DOUBLE), 'CId', 16e0, 'Lat', p.lat, 'Lng', p.lon, 'Alt', 5e0, 'Frame', 3e0, 'seq', CAST(t.seq % 11 AS DOUBLE), 'command', 16e0, 'x', p.lat, 'y', p.lon, 'z', 5e0, 'frame', 3e0)
                ELSE map('Lat', p.lat, 'Lng', p.lon, 'Alt', t.value, 'lat', p.lat * 1e7, 'lon', p.lon * 1e7, 'alt', t.value) END AS nums,
           CASE t.seq % 7 WHEN 2 THEN map('Name', 'P' || CAST(t.seq % 13 AS STRING), 'paramId', 'P' || CAST(t.seq % 13 AS STRING))
                WHEN 4 THEN map('Message', CASE WHEN t.seq % 3 = 0 THEN '' ELSE 'hello' END, 'text', CASE WHEN t.seq % 3 = 0 THEN '' ELSE 'hello' END)
                ELSE map_from_arrays(array('none'), array('')) END AS txts
    FROM telemetry t JOIN positions p ON p.seq = t.seq"""

_PATH = """
    pos AS (SELECT t.log_id, t.seq, t.ts_us, CASE WHEN t.log_id = '3' THEN floor(p.lat * 10) / 10 ELSE p.lat END AS lat, CASE WHEN t.log_id = '3' THEN floor(p.lon * 10) / 10 ELSE p.lon END AS lon,
                   CASE WHEN t.log_id = '3' THEN t.value * 0.001 ELSE t.value END AS alt
            FROM telemetry t JOIN positions p ON p.seq = t.seq WHERE t.seq % 7 = CASE WHEN t.log_id = '0' THEN 6 ELSE 0 END),
    fly AS (SELECT * FROM pos WHERE NOT (lat = 0 AND lon = 0)),
    hdg AS (SELECT log_id, ts_us, CASE WHEN log_id = '3' THEN CASE WHEN seq % 2 = 0 THEN NULL ELSE (seq % 36000) * 0.01 END ELSE seq % 360 END AS heading FROM telemetry WHERE seq % 7 = CASE WHEN log_id = '3' THEN 0 ELSE 1 END),
    hx AS (SELECT f.log_id, f.seq, arg_max(struct_pack(h := h.heading), h.ts_us) FILTER (h.ts_us <= f.ts_us) AS before, arg_min(struct_pack(h := h.heading), h.ts_us) AS earliest FROM fly f JOIN hdg h ON h.log_id = f.log_id GROUP BY f.log_id, f.seq)"""


@check("w13_trajectory", f"""
    WITH {_PATH} SELECT f.log_id, f.seq, f.ts_us, round(f.lat, 6) + 0.0 AS lat, round(f.lon, 6) + 0.0 AS lon, round(f.alt, 6) AS alt, CAST(round(coalesce(x.before, x.earliest).h, 6) AS DOUBLE) AS heading
    FROM fly f JOIN hx x ON x.log_id = f.log_id AND x.seq = f.seq""")
def w13(spark, d):
    from flightlake.operators.trajectory import trajectory

    return rounded(trajectory(spark_sql(spark, d, _LOGS)).select("log_id", "seq", "ts_us", "lat", "lon", "alt", "heading"))


_LABELS = """SELECT log_id, seq, ts_us, CASE WHEN log_id = '1' THEN '' ELSE 'Mode ' END || CAST(CAST(floor(coalesce(value, 0) / 40) AS BIGINT) AS VARCHAR) AS mode FROM telemetry WHERE seq % 7 = 3"""


@check("r15_modes", f"SELECT log_id, seq, ts_us, mode FROM (SELECT *, lag(mode) OVER (PARTITION BY log_id ORDER BY seq) AS p FROM ({_LABELS}) l) m WHERE p IS NULL OR p <> mode")
def r15m(spark, d):
    return tables.modes(spark_sql(spark, d, _LOGS))


@check("r15_texts", """
    SELECT log_id, seq, ts_us, CASE WHEN seq % 3 = 0 THEN '' ELSE 'hello' END AS text, CASE WHEN log_id = '3' THEN seq % 5 END AS severity
    FROM telemetry WHERE seq % 7 = 4 AND NOT (log_id = '3' AND seq % 3 = 0)""")
def r15t(spark, d):
    return rounded(tables.texts(spark_sql(spark, d, _LOGS)))


@check("r15_params", """
    SELECT log_id, name, value FROM (SELECT log_id, 'P' || CAST(seq % 13 AS VARCHAR) AS name, value, row_number() OVER (PARTITION BY log_id, seq % 13 ORDER BY seq DESC) AS k FROM telemetry WHERE seq % 7 = 2) p WHERE k = 1""")
def r15p(spark, d):
    return tables.params(spark_sql(spark, d, _LOGS))


@check("r15_flight_summary", f"""
    WITH {_PATH}, b AS (SELECT log_id, CASE WHEN log_id = '3' THEN 'tlog' ELSE 'bin' END AS source, min(ts_us) AS start_us, max(ts_us) AS end_us FROM telemetry GROUP BY log_id),
    md AS (SELECT log_id, count(*) AS c FROM (SELECT *, lag(mode) OVER (PARTITION BY log_id ORDER BY seq) AS p FROM ({_LABELS}) l) m WHERE p IS NULL OR p <> mode GROUP BY log_id),
    tx AS (SELECT log_id, count(*) AS c FROM telemetry WHERE seq % 7 = 4 AND NOT (log_id = '3' AND seq % 3 = 0) GROUP BY log_id),
    pa AS (SELECT log_id, count(DISTINCT seq % 13) AS c FROM telemetry WHERE seq % 7 = 2 GROUP BY log_id),
    fx AS (SELECT log_id, count(*) AS c FROM fly GROUP BY log_id),
    it AS (SELECT t.log_id, t.seq, t.seq % 11 AS num, p.lat, p.lon FROM telemetry t JOIN positions p ON p.seq = t.seq WHERE t.seq % 7 = 5),
    wp AS (SELECT i.log_id, count(DISTINCT num) AS c FROM it i JOIN (SELECT log_id, max(seq) FILTER (num = 0) AS f FROM it GROUP BY log_id) z ON z.log_id = i.log_id WHERE i.seq >= coalesce(z.f, 0) AND NOT (lat = 0 AND lon = 0) GROUP BY i.log_id)
    SELECT b.log_id, b.source, b.start_us, b.end_us, pa.c AS n_params, md.c AS n_modes, tx.c AS n_texts, fx.c AS n_fixes, coalesce(wp.c, 0) AS n_waypoints, CAST(7 AS BIGINT) AS n_messages
    FROM b JOIN pa ON pa.log_id = b.log_id JOIN md ON md.log_id = b.log_id JOIN tx ON tx.log_id = b.log_id JOIN fx ON fx.log_id = b.log_id LEFT JOIN wp ON wp.log_id = b.log_id""")
def r15(spark, d):
    return reports.flight_summary(spark_sql(spark, d, _LOGS))


@check("src12_samples", """
    SELECT log_id, message, field, CAST(position AS BIGINT) AS position, seq, value FROM (
        SELECT log_id, message, 'a' AS field, 0 AS position, seq, value FROM hourly
        UNION ALL SELECT log_id, message, 'b', 1, seq, CAST(seq AS DOUBLE) FROM hourly) s""")
def src12(spark, d):
    return rounded(tables.samples(spark_sql(spark, d, _RECORDS)).drop("ts_us"))


@check("src12_wide_view", "SELECT log_id, seq, ts_us, value AS a, CAST(NULL AS DOUBLE) AS missing, '' AS note FROM hourly WHERE message = 'click'")
def src12b(spark, d):
    records = spark_sql(spark, d, _RECORDS).withColumn("txts", F.create_map().cast("map<string,string>"))
    return tables.wide_view(records, "click", ["a", "missing"], ["note"])
