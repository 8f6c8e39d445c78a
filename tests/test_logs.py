"""Binary logs: framing, declarations, decoding, byte ranges, corruption."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

from checks.ingest import _DIALECT_SCHEMA, DIALECT
from flightlake.operators import tables
from flightlake.operators.mission import log_mission
from flightlake.operators.trajectory import trajectory
from flightlake.sources import dataflash, tlog
from flightlake.sources.files import list_logs
from flightlake.sources.tables import read_by_message, write_by_message
from tests.logwriter import GPS, STAT, declare, frame1, frame2, gps, record

CMD = declare(140, "CMD", "QHHHffffLLfB", "TimeUS,CTot,CNum,CId,Prm1,Prm2,Prm3,Prm4,Lat,Lng,Alt,Frame")
MISE = declare(141, "MISE", "QHHHffffLLfB", "TimeUS,CTot,CNum,CId,Prm1,Prm2,Prm3,Prm4,Lat,Lng,Alt,Frame")


def cmd(t, num, command, lat, lon, kind=140):
    return record(kind, "QHHHffffiifB", t, 9, num, command, 0, 0, 0, 0, round(lat * 1e7), round(lon * 1e7), 50.0, 3)


@pytest.fixture
def folder(tmp_path):
    def write(files: dict[str, bytes]) -> str:
        for name, content in files.items():
            path = tmp_path / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(content)
        return str(tmp_path)

    return write


def long_log(n: int, seed: int) -> bytes:
    """A log with noise, late declarations, clockless rows and look-alike marks inside bodies."""
    rnd = random.Random(seed)
    out = [b"\x01\x02\xa3", GPS, STAT, declare(150, "TXT", "QZ", "TimeUS,Text")]
    late = declare(160, "LATE", "Qd", "TimeUS,V")
    for i in range(n):
        pick = rnd.random()
        if i == n // 2:
            out.append(late)
        if pick < 0.5:
            out.append(gps(1000 + i, 35 + i * 1e-4, 139, i))
        elif pick < 0.7:
            out.append(record(131, "f", float(i)))
        elif pick < 0.85:
            out.append(record(150, "Q64s", 1000 + i, b"\xa3\x95\x82 in text \xa3\x95\x83"))
        elif pick < 0.95:
            out.append(record(160, "Qd", 1000 + i, i / 7))
        else:
            out.append(bytes(rnd.randrange(256) for _ in range(rnd.randrange(1, 9))))
    return b"".join(out) + gps(9, 1, 1, 1)[:10]


def rows_of(records):
    return sorted(
        (r.log_id.rsplit("/", 1)[-1], r.seq, r.message, r.ts_us, r.has_time, tuple(sorted(r.nums.items())), tuple(sorted(r.txts.items())))
        for r in records.collect()
    )


def walk(content: bytes):
    """An independent reader of one log, a record at a time."""
    sizes = {"Q": "Q", "L": "i", "f": "f", "Z": "64s", "d": "d", "B": "B"}
    known, out, pos, clock = {}, [], 0, 0
    while pos + 3 <= len(content):
        kind = content[pos + 2]
        if content[pos : pos + 2] != b"\xa3\x95" or (kind != 128 and kind not in known):
            pos += 1
            continue
        layout = "<BB4s16s64s" if kind == 128 else known[kind][1]
        size = struct.calcsize(layout)
        if pos + 3 + size > len(content):
            break
        values = struct.unpack_from(layout, content, pos + 3)
        if kind == 128:
            name, form, labels = (v.split(b"\0")[0].decode("latin-1") for v in values[2:])
            if all(c in sizes for c in form) and form and values[0] not in known:
                known[values[0]] = (name, "<" + "".join(sizes[c] for c in form), labels.split(","))
        else:
            name, _, labels = known[kind]
            if labels[0] == "TimeUS":
                clock = values[0]
            out.append((pos, name, clock))
        pos += 3 + size
    return out


def test_ranges_of_any_size_give_the_same_records(spark, folder):
    logs = {f"{i}.bin": long_log(400, i) for i in range(3)}
    files = list_logs(spark, folder(logs))
    whole = rows_of(dataflash.read_dataflash(files))
    for name, content in logs.items():
        assert [(r[1], r[2], r[3]) for r in whole if r[0] == name] == walk(content)
    for size in (700, 5000):
        assert rows_of(dataflash.read_dataflash(files, range_bytes=size)) == whole


def test_decoded_values(spark, folder):
    every = declare(170, "ALL", "bBhHiIfdnNa", ",".join(f"c{i}" for i in range(11)))
    body = record(
        170, "bBhHiIfd4s16s32h", -1, 200, -300, 60000, -70000, 4_000_000_000, 1.5, float("nan"), b"ab\0x", b"name", *range(32)
    )
    scaled = declare(173, "SCAL", "cCeELMqQ", ",".join(f"d{i}" for i in range(8)))
    body += scaled + record(173, "hHiIiBqQ", -150, 150, -12345, 12345, 350000000, 7, -(2**40), 2**40)
    unnamed = declare(171, "FEW", "BBB", "a,,a")
    bad = declare(172, "BAD", "Bx", "a,b")
    content = every + body + unnamed + record(171, "BBB", 1, 2, 3) + bad + b"\xa3\x95\xac\x01\x02"
    got = {r.message: r for r in dataflash.read_dataflash(list_logs(spark, folder({"v.log": content}))).collect()}
    assert set(got) == {"ALL", "SCAL", "FEW"}
    assert got["ALL"].nums == {
        "c0": -1, "c1": 200, "c2": -300, "c3": 60000, "c4": -70000, "c5": 4e9, "c6": 1.5, "c7": None
    }
    assert got["ALL"].txts == {"c8": "ab", "c9": "name", "c10": " ".join(map(str, range(32)))}
    assert [got["SCAL"].nums[f"d{i}"] for i in range(8)] == [
        -150 * 0.01, 150 * 0.01, -12345 * 0.01, 12345 * 0.01, 350000000 * 1e-7, 7, -(2**40), 2**40
    ]
    # Empty labels are dropped, then a repeated label keeps its last column.
    assert got["FEW"].nums == {"a": 2.0, "f2": 3.0}
    assert got["ALL"].ts_us == 0 and not got["ALL"].has_time


def test_flight_from_a_log(spark, folder):
    plain = GPS + gps(400_000, -12.5, 45.25, 80) + gps(900_000, -12.502, 45.2525, 95.5) + gps(1_700_000, 0, 0, 0)
    timeless = STAT + record(131, "f", 0.5) + GPS + record(131, "f", 1.5) + gps(3_200_000, 61.5, -7.25, 12) + record(131, "f", 2.5)
    # A longer plan, then a shorter one; a row off the globe; MISE is no plan.
    plan = CMD + MISE + b"".join(cmd(i, i, 16, 35 + i, 139) for i in range(5)) + cmd(6, 3, 16, 95, 139, 141)
    plan += b"".join(cmd(10 + i, i, 16, 36 + i, 140) for i in range(3)) + cmd(20, 7, 16, 120.0, 10.0) + cmd(21, 2, 178, 1, 1)
    records = dataflash.read_dataflash(list_logs(spark, folder({"plain.bin": plain, "timeless.bin": timeless, "plan.bin": plan}))).cache()
    name = F.element_at(F.split("log_id", "/"), -1).alias("log")
    path = sorted((r.log, r.ts_us, round(r.lat, 6), r.alt, r.heading) for r in trajectory(records).select(name, "*").collect())
    assert path == [("plain.bin", 400_000, -12.5, 80.0, None), ("plain.bin", 900_000, -12.502, 95.5, None), ("timeless.bin", 3_200_000, 61.5, 12.0, None)]
    times = sorted(r.ts_us for r in records.where("message = 'STAT'").collect())
    assert times == [0, 0, 3_200_000]
    bounds = {r.log: (r.start_us, r.end_us) for r in tables.log_bounds(records).select(name, "*").collect()}
    assert bounds["timeless.bin"] == (3_200_000, 3_200_000)
    mission = sorted((r.seq, round(r.lat, 6)) for r in log_mission(records).collect())
    assert mission == [(0, 36.0), (1, 37.0), (2, 38.0)]


def test_formats(spark, folder):
    content = GPS + declare(130, "GPX", "B", "x") + declare(180, " AB", "Zq", " a , ,b") + declare(181, "BAD", "B?", "a,b")
    framed = dataflash.frames(list_logs(spark, folder({"a.bin": content})))
    got = {r.msg_type: (r.name, r.format, r.labels, r.body_size) for r in dataflash.formats(framed).collect()}
    assert got == {130: ("GPS", "QLLf", ["TimeUS", "Lat", "Lng", "Alt"], 20), 180: ("AB", "Zq", ["a", "b"], 72)}


def test_a_later_type_replaces_one_of_the_same_name(spark, folder):
    content = GPS + gps(1, 1, 1, 1) + declare(200, "GPS", "QB", "TimeUS,N") + record(200, "QB", 2, 9) + gps(3, 1, 1, 1)
    records = dataflash.read_dataflash(list_logs(spark, folder({"a.bin": content})))
    assert [(r.msg_type, r.ts_us) for r in dataflash.one_type_per_name(records).collect()] == [(200, 2)]
    assert sorted((r.msg_type, r.shadowed) for r in records.collect()) == [(130, True), (130, True), (200, False)]
    assert {(r.field, r.value) for r in tables.samples(records).collect()} == {("TimeUS", 2.0), ("N", 9.0)}
    # So do ranges that are read apart, the later type unknown to the first of them.
    long = GPS + b"".join(gps(i, 1, 1, 1) for i in range(300)) + declare(200, "GPS", "QB", "TimeUS,N") + record(200, "QB", 2, 9)
    apart = dataflash.read_dataflash(list_logs(spark, folder({"a.bin": long})), range_bytes=700)
    assert apart.where("NOT shadowed").count() == 1 and apart.count() == 301
    assert {r.field for r in tables.samples(apart).collect()} == {"TimeUS", "N"}


def test_listing_routes_by_name_then_first_byte(spark, folder):
    where = folder({"a.BIN": b"x", "b.log": b"x", "sub/c.TLOG": b"x", "d.dat": b"\xa3\x95", "e": b"\0\0"})
    got = {r.path.rsplit("/", 1)[-1]: r.kind for r in list_logs(spark, where).collect()}
    assert got == {"a.BIN": "bin", "b.log": "bin", "c.TLOG": "tlog", "d.dat": "bin", "e": "tlog"}


def position(seq, lat, lon):
    return struct.pack("<Iiiiihhhh", seq, round(lat * 1e7), round(lon * 1e7), 5, 6000, 1, -2, 3, 0)


ITEM_INT = [(73, "MISSION_ITEM_INT", f, t, o, s, 0, 1) for f, t, o, s in (
    ("x", "int32_t", 16, 4), ("y", "int32_t", 20, 4), ("z", "float", 24, 4), ("seq", "uint16_t", 28, 2), ("command", "uint16_t", 30, 2),
    ("frame", "uint8_t", 34, 1), ("missionType", "uint8_t", 37, 1))]
COUNT = [(44, "MISSION_COUNT", "count", "uint16_t", 0, 2, 0, 1), (44, "MISSION_COUNT", "missionType", "uint8_t", 4, 1, 0, 1)]
BEAT = [(0, "HEARTBEAT", "customMode", "uint32_t", 0, 4, 0, 0)]


def item(seq, lat, lon, kind=0):
    return struct.pack("<ffffiifHHBBBBB", 0, 0, 0, 0, round(lat * 1e7), round(lon * 1e7), 9.0, seq, 16, 1, 1, 3, 0, 1)[:-1] + bytes([kind])


def test_link_logs(spark, folder):
    body = position(7, 35, 139)
    content = b"".join(
        [
            frame2(1000, 33, body), b"\0", frame2(2000, 33, body[:20], signed=True), frame1(3000, 33, body),
            frame2(4000, 9999, b"ab"), frame2(5000, 253, b"\x03hi\0x"), frame2(6000, 0, struct.pack("<I", 4)), frame2(7000, 0, struct.pack("<I", 4)),
            frame2(8000, 0, struct.pack("<I", 5)), frame2(9000, 33, body)[:-3],
        ]
    )
    plans = b"".join(
        [frame2(1, 44, struct.pack("<HBBB", 3, 1, 1, 0))]
        + [frame2(2 + i, 73, item(i, 10 + i, 20)) for i in range(3)]
        + [frame2(9, 73, item(0, 50, 50, kind=1)), frame2(10, 44, struct.pack("<HBBB", 2, 1, 1, 0))]
        + [frame2(11 + i, 73, item(i, 30 + i, 20)) for i in (0, 1, 1)]
    )
    dialect = spark.createDataFrame([*DIALECT, *ITEM_INT, *COUNT, *BEAT], _DIALECT_SCHEMA)
    files = list_logs(spark, folder({"a.tlog": content, "plan.tlog": plans}))
    records = tlog.read_tlog(files, dialect)
    assert rows_of(records) == rows_of(tlog.read_tlog(files, dialect, range_bytes=37))
    one = records.where(F.col("log_id").endswith("a.tlog")).cache()
    got = [(r.ts_us, r.nums["lat"], r.nums["vx"], r.nums["relativeAlt"]) for r in one.where("message = 'GLOBAL_POSITION_INT'").orderBy("seq").collect()]
    assert got == [(1000, 350000000, 1, 6000), (2000, 350000000, 0, 6000), (3000, 350000000, 1, 6000)]
    assert [(r.text, r.severity) for r in tables.texts(one).collect()] == [("hi", 3)]
    assert [(r.ts_us, r["mode"]) for r in tables.modes(one).orderBy("seq").collect()] == [(6000, "Mode 4"), (8000, "Mode 5")]
    # The frame cut short ends the log: nothing after 8000.
    assert one.agg(F.max("ts_us")).first()[0] == 8000
    mission = sorted((r.seq, r.lat) for r in log_mission(records).collect())
    assert mission == [(0, pytest.approx(30)), (1, pytest.approx(31))]


def test_written_tables_prune(spark, folder, tmp_path):
    records = dataflash.read_dataflash(list_logs(spark, folder({"a.bin": long_log(200, 5)})))
    rows = tables.samples(records)
    out = str(tmp_path / "out")
    write_by_message(rows, out)
    back = read_by_message(spark, out)
    assert back.count() == rows.count()
    plan = back.where("message = 'GPS' AND ts_us > 1100").select("value")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "GreaterThan(ts_us,1100)" in plan


def test_names_may_hold_anything(spark, folder):
    """Spaces, percent and number signs and other letters, as ground stations write them."""
    names = ["2024-05-01 10-12-33.bin", "a%20b#1.bin", "höhe ü.bin", "sub dir/x?y.bin", "plain.bin", "untold name"]
    path = folder({n: GPS + gps(i + 1, 1, 1, 1) for i, n in enumerate(names)})
    found = list_logs(spark, path)
    assert found.count() == len(names) and {r.kind for r in found.collect()} == {"bin"}
    rows = dataflash.read_dataflash(found).groupBy("log_id").count().collect()
    assert sorted(r["count"] for r in rows) == [1] * len(names)


def test_a_stamp_beyond_63_bits_is_none(spark, folder):
    """A resync through junk can read any stamp; the frames around it are kept."""
    good = frame2(1234, 5, b"\1" * 9)
    wild = b"\xff" * 8 + good[8:]
    path = folder({"x.tlog": good + wild + good})
    got = [r.ts_us for r in tlog.frames(list_logs(spark, path)).orderBy("seq").collect()]
    assert len(got) == 3 and got[1] is None and got[0] is not None and got[0] == got[2]


@pytest.mark.parametrize("source", [tlog, dataflash], ids=["link", "onboard"])
def test_logs_in_a_table_are_made_once(spark, tmp_path, source):
    """Settling reads ranges several times; what makes their bytes runs once."""
    marks = str(tmp_path)
    if source is tlog:
        content, n = b"".join(frame2(i * 1000, 33, position(7, 35, i)) for i in range(40)), 40
    else:
        content, n = long_log(60, 3), None

    def made(batches):
        import uuid

        open(f"{marks}/{uuid.uuid4().hex}", "w").close()
        yield from batches

    rows = spark.createDataFrame([("a", bytearray(content))], "log_id string, content binary").repartition(1)
    logs = rows.mapInArrow(made, "log_id string, content binary")
    got = sorted(source.frames(logs, range_bytes=301).collect())
    assert len(list(tmp_path.iterdir())) == 1
    assert got == sorted(source.frames(rows).collect()) and len(got) == (n or len(got)) > 30


def test_short_ranges_share_a_batch():
    """Frames of many ranges come together, each of its own log and place."""
    import pyarrow as pa

    content = b"".join(frame2(i * 1000, 33, position(7, 35, i)) for i in range(3))
    row = {"path": None, "lo": 0, "hi": len(content), "length": len(content), "start": 0, "content": content}
    batch = pa.RecordBatch.from_pylist([{"log_id": str(i), **row} for i in range(50)])
    got = list(tlog._frames(iter([batch])))
    assert len(got) == 1
    one = [r for r in got[0].to_pylist() if r["log_id"] == "49"]
    assert [r["ts_us"] for r in one] == [0, 1000, 2000] and one[1]["seq"] == one[0]["size"]
    assert sorted(set(got[0]["log_id"].to_pylist())) == sorted(str(i) for i in range(50))


def plain_scan(buf, lo, hi, known):
    """Records one after the other, as a reader from the range's start meets them."""
    sizes = {128: 86} | {d[0]: dataflash.Layout(d).dtype.itemsize for d in known}
    found, declared, pos = [], [], lo
    while pos < hi and pos + 3 <= len(buf):
        if buf[pos : pos + 2] != b"\xa3\x95" or buf[pos + 2] not in sizes:
            nxt = buf.find(b"\xa3\x95", pos + 1)
            pos = nxt if nxt >= 0 else hi
            continue
        kind, end = buf[pos + 2], pos + 3 + sizes[buf[pos + 2]]
        if end > len(buf):
            break
        found.append((pos, kind))
        if kind == 128:
            layout = dataflash.Layout(buf[pos + 3 : end])
            if layout.dtype is not None and layout.msg_type not in sizes:
                sizes[layout.msg_type] = layout.dtype.itemsize
                declared.append(buf[pos + 3 : end])
        pos = end
    return found, b"".join(declared)


@pytest.mark.parametrize("few", [256, 2])
def test_scan_follows_records_like_a_reader(monkeypatch, few):
    """Junk, marks inside bodies, types unknown or declared late, records cut short, from any start."""
    monkeypatch.setattr(dataflash, "FEW_MARKS", few)
    rng = random.Random(17)
    declare = lambda t, form: b"\xa3\x95\x80" + bytes([t, 0]) + b"T%-3d" % t + form.ljust(16, b"\0") + b"a,b".ljust(64, b"\0")
    forms = {1: b"Bh", 2: b"Q", 3: b"ii", 4: b"Z"}
    width = {1: 3, 2: 8, 3: 8, 4: 64}
    for _ in range(60):
        parts = [declare(t, forms[t]) for t in rng.sample([1, 2, 3], 2)]
        for _ in range(rng.randint(5, 120)):
            t = rng.choice([1, 2, 3, 4, 9])
            body = bytes(rng.choices([0xA3, 0x95, 1, 2, 128, 7], k=width.get(t, 5)))
            parts.append(rng.choice([b"\xa3\x95" + bytes([t]) + body] * 8 + [bytes(rng.choices(range(256), k=9)), declare(4, b"Z"), b"\xa3", b"\xa3\x95"]))
        buf = b"".join(parts)[: rng.randint(100, 9000)]
        lo = rng.choice([0, 0, rng.randrange(len(buf))])
        hi = rng.randint(lo, len(buf))
        known = [declare(1, forms[1])[3:]] if rng.random() < 0.5 else []
        row = {"start": lo, "lo": lo, "hi": hi, "length": len(buf), "known": b"".join(known), "content": buf[lo:], "path": None}
        found, _, _, base, end, declared = dataflash._scan(row)
        want, told = plain_scan(buf[: min(hi + 4096, len(buf))], lo, hi, known)
        assert sorted((base + int(p), k) for k, at in found.items() for p in at) == want
        assert declared == told and end >= hi


def test_an_index_frames_a_log_once(spark, folder, tmp_path_factory, monkeypatch):
    path = folder({"a.bin": long_log(200, 5), "b.bin": long_log(40, 2)})
    kept = str(tmp_path_factory.mktemp("kept") / "index")
    framed = []
    plain = dataflash.settle_ranges
    monkeypatch.setattr(dataflash, "settle_ranges", lambda *a: framed.append(1) or plain(*a))

    def read():
        files = list_logs(spark, path)
        rows = dataflash.read_dataflash(dataflash.index(files, kept, range_bytes=300))
        return rows_of(rows), rows_of(dataflash.read_dataflash(files))

    got, want = read()
    assert got == want and len(framed) == 2  # the index, and the plain reader
    got, want = read()
    assert got == want and len(framed) == 3  # only the plain reader
    with open(f"{path}/b.bin", "ab") as grown:
        grown.write(long_log(10, 1))
    got, want = read()
    assert got == want and len(framed) == 5
    assert spark.read.parquet(kept).where("log_id LIKE '%a.bin'").groupBy("lo").count().where("count > 1").count() == 0
