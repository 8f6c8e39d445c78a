"""Detection, search and display on small catalogs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from flightlake.functions import display
from flightlake.functions.values import finite, snap
from flightlake.operators import channels, select
from flightlake.plans import rules

CATALOG = "log_id string, message string, field string, position int, n_rows long, varies boolean, first_seq long"


@pytest.fixture(scope="module")
def make(spark):
    def build(logs):
        rows = []
        for log, messages in logs.items():
            for at, (message, fields) in enumerate(messages.items()):
                rows += [(log, message, f, p, 0 if message == "EMPTY" else 5, f not in ("still", "navRoll"), at) for p, f in enumerate(fields)]
        return spark.createDataFrame(rows, CATALOG)

    return build


TREE = {
    "GPS": ["TimeUS", "Lat", "Spd", "GCrs"], "GPS2": ["TimeUS", "GCrs"], "GPS_RAW_INT": ["lat", "cog"], "ATT": ["TimeUS", "Roll"],
    "VFR_HUD": ["heading", "groundspeed"], "RAW_IMU": ["xmag", "ymag", "zmag"], "BATTERY_STATUS": ["currentBattery"], "MSG": ["TimeUS"],
}


@pytest.mark.parametrize(
    "raw, want",
    [
        ("gps", {"GPS": ("Lat,Spd,GCrs", "", False), "GPS2": ("GCrs", "", False), "GPS_RAW_INT": ("lat,cog", "", False)}),
        ("cog", {"GPS_RAW_INT": ("cog", "cog", True)}),
        ("gps.cr", {"GPS": ("GCrs", "GCrs", True), "GPS2": ("GCrs", "GCrs", True)}),
        (".mag", {"RAW_IMU": ("xmag,ymag,zmag", "xmag,ymag,zmag", True)}),
        ("att.", {"ATT": ("Roll", "", False), "BATTERY_STATUS": ("currentBattery", "", False)}),
        ("imu.x", {"RAW_IMU": ("xmag,ymag,zmag", "", False)}),
        ("a.b.c", {}),
        ("timeus", {}),
    ],
)
def test_search(make, raw, want):
    found = select.search_fields(make({"x": TREE}), raw).collect()
    assert {r.message: (",".join(r.fields), ",".join(r.hits), r.auto_expand) for r in found} == want


def test_search_shows_all_when_still_typing(make):
    for raw in ("", "  ", ".", ".c"):
        assert select.search_fields(make({"x": TREE}), raw).count() == 7


def test_sources(make):
    catalog = make(
        {
            "a": {
                "MAG2": ["MagX", "MagY", "MagZ"], "MAG": ["MagX", "MagY", "MagZ"], "IMU": ["xmag", "ymag"],
                "BAT": ["Volt", "Curr"], "CTUN": ["ThO"], "GPS": ["Spd"], "RCOU": ["C10", "C2", "C1", "Cx"], "RCIN": ["C1"],
                "RATE": ["RDes", "R", "still"], "FTN1": ["PkAvg", "TimeUS", "SnX", "DnFreq"], "ISBH": ["N"], "EMPTY": ["C1", "C2"],
            },
            "b": {
                "ATTITUDE": ["roll", "yaw"], "NAV_CONTROLLER_OUTPUT": ["navRoll", "targetBearing"], "VFR_HUD": ["heading", "throttle", "groundspeed"],
                "SYS_STATUS": ["currentBattery", "voltageBattery"], "RC_CHANNELS": ["chan1Raw", "chan2Raw"], "SERVO_OUTPUT_RAW": ["servo1Raw", "servo9Raw"],
            },
        }
    )
    rows = lambda df, *c: [tuple(r[x] for x in c) for r in df.orderBy("log_id", "pos").collect()]
    assert rows(rules.compass_sources(catalog), "log_id", "message") == [("a", "MAG"), ("a", "MAG2")]
    assert rows(rules.driver_sources(catalog), "message", "field", "kind") == [
        ("BAT", "Curr", "current"), ("CTUN", "ThO", "throttle"), ("SYS_STATUS", "currentBattery", "current"), ("VFR_HUD", "throttle", "throttle"),
    ]
    assert rows(rules.actuator_banks(catalog), "message", "kind", "n_channels") == [
        ("RCOU", "output", 3), ("SERVO_OUTPUT_RAW", "output", 2), ("RC_CHANNELS", "input", 2),
    ]
    found = rules.actuator_channels(catalog).where("message = 'RCOU'").orderBy("channel").collect()
    assert [(r.field, r.channel, r.prefix) for r in found] == [("C1", 1, "SERVO"), ("C2", 2, "SERVO"), ("C10", 10, "SERVO")]
    assert rows(rules.tracking_pairs(catalog), "log_id", "label", "varies") == [
        ("a", "Roll rate", True), ("b", "Heading", True), ("b", "Roll (nav)", False),
    ]
    assert rows(rules.scatter_presets(catalog), "label", "x_message") == [
        ("Battery internal resistance", "BAT"), ("Throttle vs speed", "CTUN"), ("Throttle vs current", "CTUN"),
        ("Battery internal resistance", "SYS_STATUS"), ("Throttle vs speed", "VFR_HUD"), ("Throttle vs current", "VFR_HUD"), ("Speed vs current", "VFR_HUD"),
    ]
    assert [r.field for r in rules.onboard_spectra(catalog).orderBy("position").collect()] == ["PkAvg", "DnFreq"]
    assert {r.log_id: r.has_batch for r in rules.batch_sampling(catalog).collect()} == {"a": False, "b": False}
    assert {r.log_id: (r.compass, r.outputs, r.tracking) for r in rules.modules(catalog).collect()} == {"a": (True,) * 3, "b": (False, True, True)}
    assert {r.log_id: (r.message, r.field) for r in rules.spectrum_field(catalog).collect()} == {"a": ("RATE", "R"), "b": ("VFR_HUD", "heading")}


def test_names_sort_as_read(spark):
    df = spark.createDataFrame([(n,) for n in ("b", "A_1", "a1", "B", "a", "A")], "name string")
    assert [r.name for r in select.name_order(df, "name").collect()] == ["a", "A", "A_1", "a1", "b", "B"]


def test_display(spark):
    numbers = [0.0, 9.9996, 1.15, 0.25, -0.25, 0.012345, 1234.5, 12.0, 0.1, 1.005, float("nan"), float("inf"), -3.14159, 0.00000123456, 999.96]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(numbers)], "i int, v double")
    v = F.col("v")
    rows = df.select("i", display.auto(v).alias("auto"), display.fixed(v, 1).alias("fixed"), display.plot_value(v).alias("plot"), display.percent(v).alias("pct")).orderBy("i").collect()
    assert [r.auto for r in rows] == ["0", "10.00", "1.150", "0.2500", "-0.2500", "0.01235", "1235", "12", "0.1000", "1.005", "—", "—", "-3.142", "0.000001235", "1000"]
    assert [r.fixed for r in rows] == ["0.0", "10.0", "1.1", "0.3", "-0.3", "0.0", "1234.5", "12.0", "0.1", "1.0", "—", "—", "-3.1", "0.0", "1000.0"]
    assert [r.plot for r in rows][:9] == ["0", "10", "1.15", "0.25", "-0.25", "0.012", "1235", "12", "0.1"]
    durations = spark.createDataFrame([(0,), (59_960_000,), (59_940_000,), (-5,), (3_600_000_000,)], "us long").select(display.duration(F.col("us")).alias("d"))
    assert [r.d for r in durations.collect()] == ["0:00.0", "1:00.0", "0:59.9", "0:00.0", "60:00.0"]
    far = spark.createDataFrame([(999.94,), (1000.0,), (12345.0,)], "m double").select(display.distance(F.col("m")).alias("d"))
    assert [r.d for r in far.collect()] == ["999.9 m", "1.00 km", "12.35 km"]


def test_snap_and_finite(spark):
    df = spark.createDataFrame([(-5.0,), (0.4,), (0.6,), (9.9,), (float("nan"),), (float("-inf"),)], "v double")
    got = [r.s for r in df.select(snap(finite(F.col("v")), 0.0, 10.0, 3.0).alias("s")).collect()]
    assert got == [0.0, 0.0, 0.0, 9.0, None, None]


def test_channels(spark, grouping):
    values = {"C1": [1000, 1500, 1900] * 4, "C2": [1500] * 12, "C3": [0] * 12, "C4": [None] * 12, "C5": [1102] + [1300] * 11, "C6": [700]}
    rows = [("x", "RCOU", f, i, i, None if v is None else float(v)) for f, vs in values.items() for i, v in enumerate(vs)]
    samples = spark.createDataFrame(rows, "log_id string, message string, field string, seq long, ts_us long, value double")
    bank = spark.createDataFrame([("x", "RCOU", f, "SERVO", int(f[1:])) for f in values], "log_id string, message string, field string, prefix string, channel int")
    params = spark.createDataFrame([("x", "SERVO1_MIN", 1000.0), ("x", "SERVO1_MAX", 1900.0), ("x", "SERVO2_MIN", 1200.0)], "log_id string, name string, value double")
    state = channels.channel_balance(channels.channel_state(samples, channels.channel_limits(bank, params)))
    got = {r.field: r for r in state.collect()}
    assert (got["C1"].lo, got["C1"].hi, got["C1"].from_params) == (1000, 1900, True)
    assert (got["C2"].lo, got["C2"].from_params, got["C2"].idle) == (1100, False, False)
    assert {f for f in got if got[f].idle} == {"C3", "C4", "C6"}
    assert got["C1"].low_share == pytest.approx(1 / 3) and got["C1"].saturated and not got["C1"].out_of_bounds
    assert got["C5"].low_share == pytest.approx(1 / 12) and got["C6"].out_of_bounds is False
    assert got["C4"].low_share is None and got["C4"].n == 0
    mean = ((1000 + 1500 + 1900) / 3 + 1500 + (1102 + 11 * 1300) / 12) / 3
    assert got["C2"].bank_mean == pytest.approx(mean) and got["C2"].offset == pytest.approx(1500 - mean) and got["C3"].offset is None
    summary = channels.bank_summary(state).first()
    assert (summary.n_driven, summary.worst_field, summary.limit_source) == (3, "C1", "part parameters")
    manual = channels.channel_limits(bank, params, manual_min=1250).collect()
    assert {r.lo for r in manual} == {1250}
