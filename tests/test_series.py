"""Hand-computed cases of time joins and sequence operators, many logs per job."""

from __future__ import annotations

import random
import pytest
from pyspark.sql import functions as F

from flightlake.operators import select, sequence, timejoin

NONE = None


def by_log(df, *cols):
    out: dict[str, list] = {}
    for r in sorted(df.collect(), key=lambda r: (r.log_id, r.ts_us if "ts_us" in r else 0, r.seq)):
        out.setdefault(r.log_id, []).append(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]])
    return out


def test_time_window_holds_both_ends(series):
    s = series({"a": [(t, 1) for t in (0, 10, 20, 30, 40)], "run": [(t, 1) for t in (0, 10, 10, 10, 20)]})
    def stamps(log, t0, t1):
        return sorted(r.ts_us for r in select.time_window(s, t0, t1).where(F.col("log_id") == log).collect())

    assert stamps("a", 5, 35) == [10, 20, 30]
    assert stamps("a", 12, 18) == []
    assert stamps("a", 35, 5) == []
    assert stamps("run", 10, 10) == [10, 10, 10]
    # A window closing on a stamp shared by the very first rows keeps all of them.
    first = series({"x": [(0, 1), (0, 2), (0, 3), (9, 4)]})
    assert select.time_window(first, 0, 0).count() == 3


def probes(spark, logs):
    rows = [(log, i, float(t)) for log, ts in logs.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "log_id string, seq long, ts_us double")


def test_interpolate(spark, series, grouping):
    source = series(
        {
            "line": [(0, 0), (10, 10), (20, 30)],
            "hole": [(0, 0), (10, NONE), (20, 20), (30, 30)],
            "twice": [(0, 1), (0, 2), (10, 5), (10, 7), (20, 9)],
            "one": [(5, 4)],
            "late": [(t, t) for t in range(100, 130, 10)],
        }
    )
    asked = probes(
        spark,
        {
            "line": [-1, 0, 5, 10, 15, 20, 21],
            "hole": [0, 5, 10, 15, 20, 25],
            "twice": [0, 5, 10, 15, 20],
            "one": [4, 5, 6],
            "late": [99.5, 105, 120],
        },
    )
    got = by_log(timejoin.interpolate(source, asked), "value")
    assert got["line"] == [NONE, 0, 5, 10, 20, 30, NONE]
    assert got["hole"] == [0, NONE, NONE, NONE, 20, 25]
    # First stamp: its first row. Later shared stamps: the last row.
    assert got["twice"] == [1, 3.5, 7, 8, 9]
    assert got["one"] == [NONE, 4, NONE]
    assert got["late"] == [NONE, 105, 120]


def test_asof_clamps_and_nearest_refuses(spark, series, grouping):
    source = series({"a": [(10, 1), (20, 2), (20, 3), (40, 4)], "first": [(10, 1), (10, 2), (30, 3)]})
    asked = probes(spark, {"a": [0, 10, 15, 20, 30, 31, 40, 50], "first": [10, 12, 20]})
    held = by_log(timejoin.asof(source, asked), "value")
    assert held["a"] == [1, 1, 1, 3, 3, 3, 4, 4]
    assert held["first"] == [1, 2, 2]
    near = by_log(timejoin.nearest(source, asked), "value")
    assert near["a"] == [NONE, 1, 1, 3, 3, 4, 4, NONE]  # a tie goes to the earlier


def test_pair_takes_the_sparser_side(series, grouping):
    dense = series({"x": [(t, t) for t in range(0, 101, 10)], "tie": [(0, 0), (10, 10)], "none": [(0, 1)]})
    sparse = series({"x": [(15, 1), (55, 2), (200, 3)], "tie": [(5, 1), (15, 2)]})
    got = by_log(timejoin.pair_on_common_time(dense, sparse, (0, 150)), "ts_us", "a", "b")
    assert got["x"] == [(15, 15.0, 1.0), (55, 55.0, 2.0)]
    assert got["tie"] == [(0, 0.0, NONE), (10, 10.0, 1.5)]  # equal counts: a lends its stamps
    assert "none" not in got
    # The other side is interpolated from its whole series, beyond the window too.
    narrow = by_log(timejoin.pair_on_common_time(dense, sparse, (50, 58)), "ts_us", "a", "b")
    assert narrow["x"] == [(50, 50.0, 1.875)]


def test_pair_window_per_log(spark, series):
    a = series({"x": [(t, t) for t in range(0, 50, 10)], "y": [(t, t) for t in range(0, 50, 10)]})
    windows = spark.createDataFrame([("x", 10, 20)], "log_id string, t0 long, t1 long")
    got = by_log(timejoin.pair_on_common_time(a, a, windows), "ts_us")
    assert got == {"x": [10, 20]}


def test_merge_lets_a_gap_win(spark, series):
    a = series({"x": [(0, 1), (10, 2), (10, NONE)]}, "A", "f")
    b = series({"x": [(5, 7), (10, 8)]}, "B", "f")
    out = timejoin.merge_on_time(a.unionByName(b), [("A", "f"), ("B", "f"), ("C", "f")])
    got = {r.ts_us: (r["A.f"], r["B.f"], r["C.f"]) for r in out.collect()}
    assert got == {0: (1.0, NONE, NONE), 5: (NONE, 7.0, NONE), 10: (NONE, 8.0, NONE)}


def test_unwrap(series, grouping):
    def at(values):
        return [(i * 10, v) for i, v in enumerate(values)]

    got = by_log(
        sequence.unwrap_angle(
            series(
                {
                    "up": at([350, 355, 359, 3, 8]),
                    "down": at([8, 3, 359, 355]),
                    "gap": at([358, NONE, 2]),
                    "lead": at([NONE, NONE, 350, 10]),
                    "turns": at([0, 170, 340, 150, 320, 130, 300]),
                }
            )
        ),
        "value",
    )
    assert got["up"] == [350, 355, 359, 363, 368]
    assert got["down"] == [8, 3, -1, -5]
    assert got["gap"] == [358, NONE, 362]
    assert got["lead"] == [NONE, NONE, 350, 370]
    assert got["turns"] == [0, 170, 340, 510, 680, 850, 1020]


def test_grid_of_the_longest_run(series, grouping):
    logs = {
        "even": [(t, t) for t in (0, 10, 19, 30, 41, 50)],
        "cut": [(t, 1) for t in (0, 10, 20, 5000, 5010, 5020, 5030, 5040)],
        "short": [(0, 1), (10, 1), (20, 1)],
        "tie": [(t, 1) for t in (0, 10, 20, 30, 900, 910, 920, 930)],
        "still": [(5, 1)] * 6,
    }
    points, grid = sequence.uniform_grid(series(logs))
    plan = {r.log_id: (r.t0, r.step, r.n_grid, r.dropped) for r in grid.collect()}
    assert plan == {"even": (0, 10, 6, 0), "cut": (5000, 10, 5, 3), "tie": (0, 10, 4, 4)}
    got = {}
    for r in sorted(points.collect(), key=lambda r: (r.log_id, r.i)):
        got.setdefault(r.log_id, []).append(r.value)
    assert [round(v, 9) for v in got["even"]] == [0, 10, 20, 30, 40, 50]


def test_grid_points_are_those_of_interpolation(series, grouping, spark):
    """Stamps shared, odd and fractional steps, gaps, runs that begin on a shared stamp: as by joining on time."""
    rng = random.Random(3)
    logs = {}
    for n in range(12):
        t, rows = rng.randrange(50), []
        for _ in range(rng.randint(4, 40)):
            rows.append((t, NONE if rng.random() < 0.15 else rng.randrange(100) / 4))
            t += rng.choice([0, 1, 3, 3, 4, 4, 5, 9, 11, 60])
        logs[f"log{n}"] = rows
    rows, grid = sequence.longest_run(series(logs))
    asked = [
        (r.log_id, r.message, r.field, r.t0 + i * r.step, i) for r in grid.collect() for i in range(r.n_grid)
    ]
    probe = spark.createDataFrame(asked, "log_id string, message string, field string, ts_us double, seq long")
    want = timejoin.interpolate(rows, probe, sequence.SERIES).select("log_id", "ts_us", "seq", "value").collect()
    points, _ = sequence.uniform_grid(series(logs))
    got = points.select("log_id", "ts_us", "i", "value").collect()
    close = lambda r: (r[0], r[1], r[2], None if r[3] is None else round(r[3], 9))
    assert len(asked) > 50 and sorted(map(repr, map(close, got))) == sorted(map(repr, map(close, want)))


def test_median_step(series, grouping):
    got = sequence.median_step(series({"a": [(t, 0) for t in (0, 10, 25, 30, 31)], "one": [(0, 0)]}))
    assert {r.log_id: r.median_step for r in got.collect()} == {"a": 7.5}


def test_detrend(spark):
    rows = [("line", i, float(i + 1)) for i in range(5)]
    rows += [("gap", i, v) for i, v in enumerate([1.0, 2.0, NONE, 4.0, 5.0])] + [("one", 0, 7.0)]
    out = sequence.detrend(spark.createDataFrame(rows, "log_id string, i long, value double"), ["log_id"])
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.log_id, r.i)):
        got.setdefault(r.log_id, []).append(r.value if r.value is None else round(r.value, 9))
    assert got == {"line": [0] * 5, "gap": [0, 0, NONE, 0, 0], "one": [0]}


def test_first_crossing(spark):
    values = {"up": [0.0, 1.0, 3.0, 9.0], "gap": [0.0, NONE, 4.0, 9.0], "never": [0.0, 1.0], "ahead": [9.0, 9.0, 9.0]}
    rows = [(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "log_id string, i long, v double")
    out = sequence.first_crossing(df, ["log_id"], "v", F.lit(2.0), F.lit(1), F.lit(True))
    assert {r.log_id: r.crossing for r in out.collect()} == {"up": 1.5, "gap": 2.0, "never": NONE, "ahead": 1.0}


def test_modes_and_clock(spark, grouping):
    labels = "AABBBAACCCCCCCA"
    rows = [("x", i, i, m) for i, m in enumerate(labels)] + [("y", 0, 0, "A")]
    df = spark.createDataFrame(rows, "log_id string, seq long, ts_us long, mode string")
    got = sorted((r.log_id, r.seq, r["mode"]) for r in sequence.mode_changes(df).collect())
    assert got == [("x", 0, "A"), ("x", 2, "B"), ("x", 5, "A"), ("x", 7, "C"), ("x", 14, "A"), ("y", 0, "A")]
    clocks = [NONE, 5, NONE, NONE, 3, NONE, NONE, 9]
    df = spark.createDataFrame([("x", i, t) for i, t in enumerate(clocks)], "log_id string, seq long, ts_us long")
    got = [(r.ts_us, r.has_time) for r in sorted(sequence.fill_time(df).collect(), key=lambda r: r.seq)]
    assert [t for t, _ in got] == [0, 5, 5, 5, 3, 3, 3, 9]
    assert [h for _, h in got] == [t is not None for t in clocks]


def test_legs(spark):
    df = spark.createDataFrame([("a", 0, 0, 0.0, 0.0), ("a", 1, 1, 0.0, 1.0), ("a", 2, 2, 1.0, 1.0)], "log_id string, seq long, ts_us long, lat double, lon double")
    rows = sorted(sequence.legs(df).collect(), key=lambda r: r.seq)
    assert rows[0].leg_m == 0 and rows[1].leg_m == pytest.approx(111194.93, abs=0.01)
    assert rows[2].along_m == pytest.approx(222389.85, abs=0.01) and rows[0].total_m == rows[2].along_m


def test_thin(spark, grouping):
    df = spark.createDataFrame([("big", i, i) for i in range(45)] + [("small", i, i) for i in range(19)], "log_id string, seq long, ts_us long")
    got = {}
    for r in sequence.thin(df, ["log_id"], target=10).collect():
        got.setdefault(r.log_id, []).append(r.seq)
    assert sorted(got["big"]) == list(range(0, 45, 4)) and len(got["small"]) == 19
