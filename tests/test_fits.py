"""Circle, line, tracking and spectrum on signals with known answers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightlake.operators import circle, spectrum, stats, tracking

POINTS = "log_id string, x double, y double"


def one(df):
    return {r.log_id: r for r in df.collect()}


def ring(cx, cy, r, n, arc=360.0, noise=0.0, seed=1):
    rnd = random.Random(seed)
    for i in range(n):
        a = math.radians(arc) * i / (n if arc == 360 else n - 1)
        d = r + rnd.uniform(-noise, noise)
        yield cx + d * math.cos(a), cy + d * math.sin(a)


def test_circle(spark, grouping):
    logs = {
        "exact": list(ring(120, -45, 300, 64)),
        "centred": list(ring(0, 0, 5, 40)),
        "noisy": list(ring(50, 20, 400, 400, noise=5)),
        "arc": list(ring(10, 10, 100, 101, arc=200)),
        "two": [(0, 0), (1, 1)],
        "line": [(i, 2 * i) for i in range(20)],
        "still": [(3, 4)] * 10,
        "gaps": [*ring(120, -45, 300, 64), (None, 1.0), (2.0, None)],
    }
    rows = [(k, None if x is None else float(x), None if y is None else float(y)) for k, ps in logs.items() for x, y in ps]
    fit = one(circle.fit_circle(spark.createDataFrame(rows, POINTS)))
    assert (fit["exact"].cx, fit["exact"].cy, fit["exact"].radius) == pytest.approx((120, -45, 300), abs=1e-6)
    assert fit["exact"].offset == pytest.approx(math.hypot(120, 45))
    assert fit["exact"].heading_error_deg == pytest.approx(math.degrees(math.asin(math.hypot(120, 45) / 300)))
    assert fit["exact"].radial_std == pytest.approx(0, abs=1e-6)
    assert fit["exact"].arc_deg == pytest.approx(360 - 360 / 64)
    assert (fit["noisy"].cx, fit["noisy"].cy, fit["noisy"].radius) == pytest.approx((50, 20, 400), abs=1)
    assert 1 < fit["noisy"].radial_std < 5
    assert fit["arc"].arc_deg == pytest.approx(200)
    assert fit["gaps"].n == 64 and fit["gaps"].cx == pytest.approx(120)
    assert (fit["two"].status, fit["line"].status, fit["still"].status) == ("too-few-samples", "degenerate", "degenerate")
    assert fit["line"].radius is None and fit["centred"].offset == pytest.approx(0, abs=1e-9)


def test_lines(spark):
    logs = {
        "line": [(x, 2 * x + 1) for x in range(5)],
        "level": [(x, 4) for x in range(5)],
        "upright": [(3, y) for y in range(5)],
        "gap": [(0, 1), (1, None), (2, 5), (None, 9)],
        "one": [(1, 1)],
    }
    rows = [(k, None if x is None else float(x), None if y is None else float(y)) for k, ps in logs.items() for x, y in ps]
    fit = one(stats.line_fit(spark.createDataFrame(rows, POINTS), ["log_id"]))
    assert (fit["line"].slope, fit["line"].intercept, fit["line"].r) == pytest.approx((2, 1, 1))
    assert (fit["level"].slope, fit["level"].r) == (0, None)
    assert (fit["upright"].slope, fit["upright"].intercept, fit["upright"].r) == (None, None, None)
    assert (fit["gap"].slope, fit["gap"].n) == (2, 2)
    assert (fit["one"].slope, fit["one"].r, fit["one"].n) == (None, None, 1)


def test_stats(series):
    s = series({"a": [(0, 1), (1, 2), (2, None), (3, 3), (4, 4)], "one": [(0, 5)], "none": [(0, None)], "zero": [(0, -1), (1, 1)]})
    got = one(stats.column_stats(s))
    assert (got["a"].n, got["a"].mean, got["a"].min, got["a"].max) == (4, 2.5, 1, 4)
    assert got["a"].std == pytest.approx(1.2909944) and got["a"].rms == pytest.approx(math.sqrt(7.5))
    assert (got["one"].std, got["one"].cv) == (0, 0) and got["zero"].cv is None and "none" not in got


GRID = "log_id string, i long, des double, act double, n long, dt double"


def grid(spark, logs, dt):
    rows = []
    for log, (des, act) in logs.items():
        n = min(len(des), len(act))
        rows += [(log, i, None if des[i] is None else float(des[i]), None if act[i] is None else float(act[i]), n, dt) for i in range(n)]
    return spark.createDataFrame(rows, GRID)


def chirp(n, delay=0.0, gain=1.0):
    t = np.arange(n) - delay
    return gain * np.sin(0.02 * t + 0.0002 * t * t)


def test_lag_and_gain(spark, grouping):
    rnd = np.random.default_rng(3)
    holed = list(chirp(600, 7))
    for i in range(0, 600, 11):
        holed[i] = None
    logs = {
        "seven": (chirp(600), chirp(600, 7)),
        "between": (chirp(600), chirp(600, 3.4)),
        "gain": (chirp(600), chirp(600, 5, 0.6) + 4),
        "leads": (chirp(600, 6), chirp(600)),
        "noise": (rnd.normal(size=600), rnd.normal(size=600)),
        "holes": (chirp(600), holed),
        "flat": (np.ones(100), chirp(100)),
        "short": (chirp(7), chirp(7)),
    }
    got = one(tracking.tracking_metrics(grid(spark, logs, 0.01)))
    assert got["seven"].lag_sec == pytest.approx(0.07, abs=1e-4) and got["seven"].r == pytest.approx(1, abs=1e-6)
    assert got["between"].lag_sec == pytest.approx(0.034, abs=2e-3)
    assert got["gain"].gain == pytest.approx(0.6, abs=1e-6) and got["gain"].lag_sec == pytest.approx(0.05, abs=1e-4)
    assert got["leads"].lag_sec == pytest.approx(-0.06, abs=1e-4)
    assert got["noise"].r < 0.5
    assert got["holes"].lag_sec == pytest.approx(0.07, abs=1e-3)
    assert got["seven"].max_lag_sec == pytest.approx(1.5)
    assert "flat" not in got and "short" not in got
    assert got["seven"].bias == pytest.approx(float(np.mean(chirp(600, 7) - chirp(600))))


def test_lag_across_blocks(spark, monkeypatch):
    """Blocks smaller than the reach give what one block gives."""
    logs = {"a": (chirp(500), chirp(500, 9)), "b": (chirp(333), chirp(333, -4))}
    g = grid(spark, logs, 0.01)
    n_shifts = {"a": 2 * 125 + 1, "b": 2 * 83 + 1}
    want = sorted((r.log_id, r.k, r.pairs, round(r.r, 9), round(r.slope, 9)) for r in tracking.lag_profile(g).collect())
    assert {k: sum(1 for w in want if w[0] == k) for k in "ab"} == n_shifts
    for log, k, pairs, r, slope in want[:: 17]:
        des, act = (np.asarray(v) for v in logs[log])
        n = len(des)
        x, y = des[max(0, -k) : min(n, n - k)], act[max(0, -k) + k : min(n, n - k) + k]
        assert pairs == len(x) and r == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-8)
        assert slope == pytest.approx(np.polyfit(x, y, 1)[0], abs=1e-8)


def test_reach_is_bounded_by_work(spark):
    rows = [(600, 0.01), (200_000, 0.0025), (10_000_000, 0.0025), (8, 10.0)]
    df = spark.createDataFrame(rows, "n long, dt double").select("n", tracking.lag_reach(F.col("n"), F.col("dt")).alias("k"))
    got = {r.n: r.k for r in df.collect()}
    assert (got[600], got[200_000], got[10_000_000], got[8]) == (150, 20, 8, 1)


def test_step_response(spark, grouping):
    n, dt, tau = 400, 0.01, 20
    up = [0.0] * 100 + [10.0] * 300
    lag = [0.0] * 100 + [10 * (1 - math.exp(-(i + 1) / tau)) for i in range(300)]
    ring_down = [0.0] * 100 + [10 * (1 - math.exp(-i / 30) * math.cos(i / 8)) for i in range(300)]
    rnd = random.Random(5)
    late = [0.0] * 300 + [10 * (1 - math.exp(-i / 500)) for i in range(100)]
    logs = {
        "first": (up, lag),
        "down": ([-v for v in up], [-v for v in lag]),
        "ring": (up, ring_down),
        "noise": ([rnd.gauss(0, 1) for _ in range(n)], lag),
        "ramp": (list(range(n)), lag),
        "flat": ([1.0] * n, lag),
        "early": ([0.0] * 3 + [10.0] * 397, lag),
        "tiny": (up[95:106], lag[95:106]),
        "slow": ([0.0] * 300 + [10.0] * 100, late),
    }
    got = one(tracking.step_metrics(grid(spark, logs, dt)))
    assert set(got) == {"first", "down", "ring", "slow"}
    assert got["first"].amplitude == 10 and got["first"].step_time_sec == pytest.approx(1.0)
    assert got["first"].rise_time_sec == pytest.approx(math.log(9) * tau * dt, rel=0.02)
    assert got["first"].overshoot_pct == 0 and got["first"].settling_time_sec == pytest.approx(3 * tau * dt, rel=0.05)
    assert got["down"].rise_time_sec == pytest.approx(got["first"].rise_time_sec) and got["down"].amplitude == -10
    assert got["ring"].overshoot_pct > 20
    assert got["slow"].rise_time_sec is None and got["slow"].settling_time_sec is None
    assert got["slow"].steady_state_error < -5


def psd_of(x, dt, zero_pad=True, hann=True):
    n = len(x)
    nfft = 1 << (n - 1).bit_length() if zero_pad else 1 << (n.bit_length() - 1)
    used = min(n, nfft)
    w = 0.5 * (1 - np.cos(2 * np.pi * np.arange(used) / used)) if hann else np.ones(used)
    X = np.fft.rfft(np.asarray(x[:used]) * w, nfft)
    p = 2 * np.abs(X) ** 2 * dt / np.sum(w * w)
    p[0] /= 2
    p[-1] /= 2
    return p


@pytest.mark.parametrize("whole", [1 << 16, 8])
def test_spectrum(spark, monkeypatch, whole, grouping):
    monkeypatch.setattr(spectrum, "WHOLE", whole)
    rnd = np.random.default_rng(9)
    logs = {"sine": np.sin(2 * np.pi * 12.5 * np.arange(1024) / 100), "odd": rnd.normal(size=777), "four": np.array([1.0, -1, 2, 0]), "few": np.array([1.0, 2, 3])}
    rows = [(k, i, float(v)) for k, x in logs.items() for i, v in enumerate(x)] + [("hole", i, None if i == 5 else 1.0) for i in range(50)]
    points = spark.createDataFrame(rows, "log_id string, i long, value double")
    dt = points.select("log_id").distinct().withColumn("dt", F.lit(0.01))
    for options in ({}, {"zero_pad": False}, {"window": "none"}):
        bins = spectrum.power_spectrum(points, dt, ["log_id"], **options).collect()
        got: dict[str, dict[int, float]] = {}
        for r in bins:
            got.setdefault(r.log_id, {})[r.k] = r.psd
        assert set(got) == {"sine", "odd", "four"}
        for log, x in logs.items():
            if log != "few":
                want = psd_of(x, 0.01, options.get("zero_pad", True), options.get("window", "hann") == "hann")
                assert sorted(got[log]) == list(range(len(want)))
                assert [got[log][k] for k in range(len(want))] == pytest.approx(list(want), abs=1e-12)
    bins = spectrum.power_spectrum(points, dt, ["log_id"])
    assert one(spectrum.dominant_peak(bins, ["log_id"]))["sine"].freq == pytest.approx(12.5)
    power = {r.log_id: r.p for r in bins.groupBy("log_id").agg(F.sum(F.col("psd") * F.col("df")).alias("p")).collect()}
    assert power["sine"] == pytest.approx(0.5, abs=1e-6)


def test_flat_series_has_no_log_view(spark):
    points = spark.createDataFrame([("zero", i, 0.0) for i in range(8)] + [("tone", i, float(i % 2)) for i in range(8)], "log_id string, i long, value double")
    dt = points.select("log_id").distinct().withColumn("dt", F.lit(1.0))
    shown = spectrum.log_view(spectrum.power_spectrum(points, dt, ["log_id"]), ["log_id"]).collect()
    assert {r.log_id for r in shown} == {"tone"} and min(r.k for r in shown) == 1


def test_grid_pair(series, grouping):
    des = series({"x": [(t, t) for t in range(0, 200, 10)], "far": [(t, 0) for t in range(0, 100, 10)], "wrap": [(t, 350 + t / 10) for t in range(0, 100, 10)]})
    act = series({"x": [(t, t) for t in range(5, 205, 20)], "far": [(t, 0) for t in range(500, 600, 10)], "wrap": [(t, 720 + t / 10) for t in range(0, 100, 10)]})
    rows = tracking.grid_pair(des, act, wrap=360.0).collect()
    got = sorted((r.i, r.des, r.act, r.dt) for r in rows if r.log_id == "x")
    assert [g[0] for g in got] == list(range(10)) and all(g[1] == pytest.approx(5 + 20 * g[0]) and g[2] == pytest.approx(g[1]) for g in got)
    assert {r.log_id for r in rows} == {"x", "wrap"}
    assert all(r.act - r.des == pytest.approx(10) for r in rows if r.log_id == "wrap")
