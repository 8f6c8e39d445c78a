"""Plan files: both forms, what is accepted, what is refused and why."""

from __future__ import annotations

import json

import pytest

from flightlake.sources.planfile import parse_plans, read_plans

HEAD = "QGC WPL 110\n"


def line(seq, command=16, lat=35.0, lon=139.0, alt=10.0, frame=3, tail="1"):
    return "\t".join(map(str, (seq, 0, frame, command, 0, 0, 0, 0, lat, lon, alt, tail)))


def plan(items, home=(35, 139, 5), **extra):
    return json.dumps({"fileType": "Plan", "mission": {"plannedHomePosition": home, "items": items}, **extra})


def simple(lat, lon, jump=None, command=16, **extra):
    out = {"type": "SimpleItem", "command": command, "frame": 3, "params": [0, 0, 0, None, lat, lon, 20], **extra}
    return out if jump is None else {**out, "doJumpId": jump}


def survey(items, kind="ComplexItem"):
    return {"type": kind, "TransectStyleComplexItem": {"Items": items}}


def deep(n, items):
    for _ in range(n):
        items = [survey(items)]
    return items[0]


CASES = {
    "text": HEAD + "\n".join([line(0, 0), line(1, lat=36), line(2, 22, lat=37)]),
    "text-dressed": "﻿ \r\n" + HEAD.strip() + "\r\n# note\r\n\r\n  " + line(1).replace("\t", "   ") + " \r\n",
    "text-repeat": HEAD + "\n".join([line(1), line(2, lat=36), line(0, lat=34), line(2, lat=40)]),
    "text-commas": HEAD + line(1) + "\n" + line(2).replace("35.0", "35,0 1"),
    "text-empty": HEAD + "# only a note\n",
    "text-nowhere": HEAD + line(1, lat=0, lon=0) + "\n" + line(2, 178),
    "text-words": HEAD + line(1, lat="north") + "\n" + line(2),
    "json": plan([simple(36, 139, 1), simple(37, 139, 2)]),
    "json-null": plan([simple(None, 139, 1), simple(37, 139, 2), simple(None, None, 3, command=178)]),
    "json-text-number": plan([simple("36", 139, 1), simple(37, 139, 2)]),
    "json-legacy": plan([{"type": "SimpleItem", "command": 16, "frame": 3, "coordinate": [36.5, 139, 7], "params": [1, 2, 3, 4, 5, 6, 7], "id": 9}]),
    "json-survey": plan([simple(36, 139, 1), survey([simple(37, 139, 2), simple(38, 139, 3)]), simple(39, 139, 4)]),
    "json-nested": plan([survey([survey([simple(37, 139)], "survey"), simple(38, 139)]), simple(39, 139)]),
    "json-lost": plan([simple(36, 139, 1), {"type": "ComplexItem", "complexItemType": "fwLandingPattern"}, survey([])]),
    "json-numbers": plan([simple(36, 139), simple(37, 139, 8), simple(38, 139, -4), simple(39, 139, 2.5)]),
    "json-no-home": plan([simple(36, 139, 1)], home=None),
    "json-empty": plan([]),
    "json-other": json.dumps({"fileType": "Fence", "mission": {"items": [simple(1, 1)]}}),
    "json-bare": json.dumps({"fileType": "Plan"}),
    "json-broken": '{"fileType":"Plan",',
    "neither": "hello",
    "json-deep": plan([deep(12, [simple(41, 139), simple(42, 139)]), simple(43, 139)]),
    "json-wild": plan([simple(36, 139, 1e300), {**simple(37, 139, 3), "frame": 1e20}, simple(38, 139, 4)]),
    "text-fractions": HEAD + "\n".join([line(1, lat=36), line("1.5", lat=37), line(2, lat=38), line("1e300", lat=39)]),
    "json-twice": plan([simple(36, 139, 1)]).replace('"items"', '"items": [7], "items"').replace("36,", "36, 139, 20], \"params\": [0, 0, 0, null, 37,"),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(name, len(text.encode()), text) for name, text in CASES.items()] + [("large", 9 << 20, None)]
    waypoints, outcome = parse_plans(spark.createDataFrame(rows, "log_id string, size long, content string"))
    points: dict[str, list] = {}
    for r in sorted(waypoints.collect(), key=lambda r: (r.log_id, r.seq)):
        points.setdefault(r.log_id, []).append((r.seq, r.command, r.lat, r.alt, r.frame))
    return points, {r.log_id: r for r in outcome.collect()}


def lats(points, name):
    return [(p[0], p[2]) for p in points.get(name, [])]


def test_text(parsed):
    points, outcome = parsed
    assert points["text"] == [(0, 16, 35.0, 10.0, 3), (1, 16, 36.0, 10.0, 3), (2, 22, 37.0, 10.0, 3)]
    assert lats(points, "text-dressed") == [(1, 35.0)]
    assert lats(points, "text-repeat") == [(0, 34.0), (1, 35.0), (2, 40.0)]
    assert lats(points, "text-words") == [(2, 35.0)]
    assert outcome["text"].reason is None and outcome["text"].n_waypoints == 3


def test_json(parsed):
    points, outcome = parsed
    assert points["json"] == [(0, 16, 35.0, 5.0, 0), (1, 16, 36.0, 20.0, 3), (2, 16, 37.0, 20.0, 3)]
    assert lats(points, "json-null") == [(0, 35.0), (2, 37.0)] and outcome["json-null"].unreadable == 1
    assert outcome["json-text-number"].unreadable == 1
    assert points["json-legacy"][1] == (1, 16, 36.5, 7.0, 3)
    assert lats(points, "json-survey") == [(0, 35.0), (1, 36.0), (2, 37.0), (3, 38.0), (4, 39.0)]
    assert lats(points, "json-nested") == [(0, 35.0), (1, 37.0), (2, 38.0), (3, 39.0)]
    assert lats(points, "json-lost") == [(0, 35.0), (1, 36.0)] and outcome["json-lost"].unreadable == 2
    assert lats(points, "json-numbers") == [(0, 35.0), (1, 36.0), (8, 37.0), (9, 38.0), (10, 39.0)]
    assert lats(points, "json-no-home") == [(1, 36.0)]
    assert lats(points, "json-deep") == [(0, 35.0), (1, 41.0), (2, 42.0), (3, 43.0)]


def test_odd_numbers(parsed):
    """Items go by the number written, whole or not, however large; a frame no integer holds is unknown."""
    points, outcome = parsed
    assert [(p[0], p[2], p[4]) for p in points["json-wild"]] == [
        (0, 35.0, 0),
        (3, 37.0, None),
        (4, 38.0, 3),
        (1e300, 36.0, 3),
    ]
    assert lats(points, "text-fractions") == [(1, 36.0), (1.5, 37.0), (2, 38.0), (1e300, 39.0)]
    # Of a key written twice the last value counts.
    assert lats(points, "json-twice") == [(0, 35.0), (1, 37.0)]
    assert outcome["json-wild"].reason is None


def test_refusals(parsed):
    points, outcome = parsed
    reasons = {name: r.reason for name, r in outcome.items() if r.reason}
    assert reasons == {
        "text-commas": "13 fields on line 3 where a waypoint has 12",
        "text-empty": "no waypoints",
        "text-nowhere": "no drawable waypoints",
        "json-empty": "no waypoints",
        "json-other": "not a plan",
        "json-bare": "no mission",
        "json-broken": "not JSON",
        "neither": "not a mission file",
        "large": "too large",
    }
    assert "text-commas" not in points


def test_files(spark, tmp_path):
    (tmp_path / "a.waypoints").write_text(CASES["text"])
    (tmp_path / "b.plan").write_text(CASES["json"])
    waypoints, outcome = parse_plans(read_plans(spark, str(tmp_path)))
    assert waypoints.count() == 6 and sorted(r.kind for r in outcome.collect()) == ["json", "text"]
    (tmp_path / "c.plan").write_text(" " * 3000 + CASES["json"])
    _, outcome = parse_plans(read_plans(spark, str(tmp_path), largest=3000))
    assert sorted(r.kind for r in outcome.collect()) == ["json", "text", "too-large"]
