"""A split series must answer exactly as a whole one."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from flightlake import scale
from flightlake.scale import Ordered

KEYS, ORDER = ["log_id"], ["ts_us", "seq"]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    data = []
    for log, n in (("hot", 300), ("b", 3), ("c", 1), ("d", 40)):
        for seq in range(n):
            # One stamp holds a third of the large log.
            ts = 50 if log == "hot" and seq % 3 == 0 else rnd.randrange(100)
            data.append((log, seq, ts, None if rnd.random() < 0.3 else rnd.randrange(1000) / 4))
    return spark.createDataFrame(data, "log_id string, seq long, ts_us long, value double").cache()


def scanned(rows, split, **scans):
    got = Ordered(rows, KEYS, ORDER, split=split, group_rows=20).scan(**scans).rows()
    return sorted(got.select("log_id", "seq", *scans).collect(), key=lambda r: (r.log_id, r.seq))


@pytest.mark.parametrize(
    "scan",
    [
        lambda: scale.previous("ts_us", "value"),
        lambda: scale.following("ts_us", "value"),
        lambda: scale.last_known(F.col("value")),
        lambda: scale.known_before(F.col("value")),
        lambda: scale.first_known(F.col("value")),
        lambda: scale.next_known(F.col("value")),
        lambda: scale.running_sum(F.col("value")),
        lambda: scale.row_index(),
        lambda: scale.total(F.col("value")),
        lambda: scale.total(F.col("value"), "count"),
        lambda: scale.total(F.col("value"), "min"),
    ],
    ids="previous following last before first next sum index total count min".split(),
)
@pytest.mark.parametrize("block", [1000, 4], ids=["one level", "two levels"])
def test_split_equals_whole(rows, scan, block, monkeypatch):
    """Also where there are more pieces than one task folds."""
    monkeypatch.setattr(scale, "BLOCK", block)
    assert scanned(rows, True, x=scan()) == scanned(rows, False, x=scan())


def test_two_levels_share_one_pass(rows, monkeypatch):
    """Several scans at once; no task folds all pieces of a series."""
    scans = {"a": scale.row_index(), "b": scale.running_sum(F.col("value")), "c": scale.next_known(F.col("value"))}
    want = scanned(rows, False, **scans)
    monkeypatch.setattr(scale, "BLOCK", 3)
    assert scanned(rows, True, **scans) == want
    ordered = Ordered(rows, KEYS, ORDER, split=True, group_rows=20)
    folded = ordered._carries([*KEYS, "_piece"], scans)
    assert folded.count() > 3 * 3
    plan = folded._jdf.queryExecution().optimizedPlan().toString()
    over_series = [x for x in plan.splitlines() if "Window " in x and "_piece" in x]
    assert over_series and all("_block" in x.split("windowspecdefinition")[-1] for x in over_series)


def test_pieces_grow_beyond_their_number(rows, monkeypatch):
    monkeypatch.setattr(scale, "MOST_PIECES", 6)
    ordered = Ordered(rows, KEYS, ORDER, split=True, group_rows=1)
    assert ordered._pieces == 6
    assert scanned(rows, True, x=scale.row_index()) == scanned(rows, False, x=scale.row_index())


def test_pieces_are_bounded_and_carry_is_small(rows):
    ordered = Ordered(rows, KEYS, ORDER, group_rows=20)
    assert ordered.split
    sizes = [r["count"] for r in ordered.df.groupBy("_piece").count().collect()]
    assert len(sizes) > 5 and max(sizes) < 120
    again = ordered.scan(a=scale.row_index()).scan(b=scale.previous("a"))
    wrong = again.where((F.col("a") > 0) & ~F.col("b.a").eqNullSafe(F.col("a") - 1)).rows()
    assert wrong.count() == 0


def test_short_pieces_share_tasks_and_files(rows, spark):
    """Pieces far shorter than a task may hold are cut inside it, in order, none left out."""
    ordered = Ordered(rows, KEYS, ORDER, split=True, group_rows=2)
    assert len(ordered.df.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = ordered.df.select(F.struct(*KEYS, *ORDER).alias("at"), "_piece").collect()
    assert len(held) == rows.count()
    pieces = [r["_piece"] for r in sorted(held, key=lambda r: tuple(r["at"]))]
    assert pieces == sorted(pieces)
    assert len(set(pieces)) > 100 and max(pieces.count(p) for p in set(pieces)) < 20
    got = ordered.scan(x=scale.row_index(), y=scale.next_known(F.col("value"))).rows()
    want = Ordered(rows, KEYS, ORDER, split=False).scan(x=scale.row_index(), y=scale.next_known(F.col("value"))).rows()
    assert sorted(got.select("log_id", "seq", "x", "y").collect()) == sorted(want.select("log_id", "seq", "x", "y").collect())


def test_not_split_below_the_limit(rows):
    assert not Ordered(rows, KEYS, ORDER).split


def test_attach_reaches_every_piece(rows):
    per_key = rows.groupBy("log_id").agg(F.count("*").alias("n"))
    ordered = Ordered(rows, KEYS, ORDER, group_rows=20)
    out = ordered.attach(per_key).rows().groupBy("log_id").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    assert all(r.c == r.n for r in out.collect())


def test_join_per_key_salts_large_groups(rows, monkeypatch):
    monkeypatch.setattr(scale, "GROUP_ROWS", 20)
    per_key = rows.groupBy("log_id").agg(F.count("*").alias("n"))
    groups = scale.Groups(rows, KEYS)
    assert {r.log_id: r._salts for r in groups.hot.collect()} == {"hot": 15, "d": 2}
    out = groups.join(rows, per_key, "seq")
    assert out.count() == rows.count()
    assert out.where("n IS NULL").count() == 0


@pytest.mark.parametrize("split", [False, True])
def test_exact_median(rows, split):
    got = {r.log_id: r.m for r in scale.exact_median(rows, KEYS, "value", "m", split=split).collect()}
    want: dict[str, list[float]] = {}
    for r in rows.collect():
        if r.value is not None:
            want.setdefault(r.log_id, []).append(r.value)
    assert got == {k: statistics.median(v) for k, v in want.items()}


def test_explode_range_in_blocks(spark):
    df = spark.createDataFrame([("a", 25), ("b", 1), ("c", 10)], "log_id string, n long")
    out = scale.explode_range(df, F.col("n"), "i", block=10)
    got = sorted((r.log_id, r.i) for r in out.collect())
    assert got == [("a", i) for i in range(25)] + [("b", 0)] + [("c", i) for i in range(10)]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        scale.scratch_dir(Session())
