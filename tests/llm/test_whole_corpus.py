"""Filter audit, phrase mining and source mixing against SQL and plain Python."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from flightlake.llm import common, filter_audit, mixing, phrases
from flightlake.llm.queries import QUERIES

from . import cases

FOLDER = "/root/testdata/sf0.001"


def rows_of(df, *cols):
    return sorted(map(repr, map(tuple, (df.select(*cols) if cols else df).collect())))


@pytest.mark.parametrize(
    "name,oracle",
    [("op11_filter_audit", filter_audit.ORACLE), ("op12_phrase_mining", phrases.ORACLE), ("op13_source_mixing", mixing.ORACLE)],
)
def test_against_sql(spark, name, oracle):
    db = duckdb.connect()
    for table in ("documents", "labels"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = QUERIES[name](spark, FOLDER)
    want = db.sql(oracle)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


# ---- filter audit


def audited(rows, labels):
    """Every document through every order, one at a time."""
    first = {}
    for doc, text, *_ in rows:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    good = {d for d, q, _ in labels if q == 1} - {None}
    toxic = {d for d, _, t in labels if t == 1} - {None}
    out = defaultdict(Counter)
    for doc, text, _, source, *_ in rows:
        text, part = text or "", source or ""
        words = cases.spaced_words(text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": re.search("[#$%&*|]", text) is not None,
            "E": doc is not None and text in first and doc > first[text],
        }
        for order in map("".join, itertools.permutations("ABCDE")):
            there = True
            for step, letter in enumerate(order, 1):
                at = out[part, order, step]
                at["unique_fails"] += fails[letter] and sum(fails.values()) == 1
                at["redundant"] += fails[letter] and not there
                removed = fails[letter] and there
                at["removed"] += removed
                at["good_lost"] += removed and doc in good
                at["toxic_lost"] += removed and doc in toxic
                there = there and not fails[letter]
                at["kept"] += there
                out[part, letter]["shapley"] += removed
    return sorted(
        repr((*key, *[out[key][c] for c in filter_audit.COUNTED], out[key[0], key[1][key[2] - 1]]["shapley"]))
        for key in list(out)
        if len(key) == 3
    )


def test_audit_of_odd_rows(spark):
    capital = (200, " ".join(f"Word{i} A" for i in range(150)), "en", "a", 1)
    rows = [*cases.odd_rows(), capital, (201, "# " + cases.prose(77, 400), "en", "", 1), (202, "", "en", "", 1)]
    labels = [(1, 1, 0), (1, 0, 1), (10, 0, 1), (12, 1, 0), (14, None, 1), (200, 1, None), (999, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, cases.SCHEMA).selectExpr("*", *[f"{v} AS {k}" for k, v in cases.CLASHING.items()])
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1))
    got = filter_audit.audit(docs.repartition(3), said)
    assert rows_of(got) == audited(rows, labels)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rows_of(filter_audit.audit(docs, none)) == audited(rows, [])
    assert filter_audit.audit(cases.empty_documents(spark), said).count() == 0


def test_copies_are_no_hot_key(spark):
    """Documents meet their first copy on digest and id, never on the digest alone."""
    docs = spark.createDataFrame([(i, "same text", "en", "s", 1) for i in range(50)], cases.SCHEMA)
    said = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    plan = filter_audit.cells(docs, said)._jdf.queryExecution().toString()
    joins = [x for x in plan.splitlines() if re.search(r"Join.*digest", x)]
    assert joins and all("doc_id" in x for x in joins)
    first = filter_audit.audit(docs, said).where("filter_order = 'EABCD' AND step = 1").first()
    assert (first["kept"], first["removed"], first["unique_fails"]) == (1, 49, 0)


# ---- phrase mining


def mined(rows, least, first, percent=80, depth=4):
    counts, size = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", cases.folded(text or "")):
            words = re.findall("[^ \t]+", piece)
            size[lang] += len(words)
            for k in range(1, depth + 1):
                counts.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    often = {g: n for g, n in counts.items() if len(g) > 2 and n >= least}
    found = defaultdict(list)
    for (lang, *words), a in often.items():
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, *words[:k]], counts[lang, *words[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        text = f" {' '.join(words)} "
        if not any(
            g[0] == lang and len(g) - 1 > len(words) and text in f" {' '.join(g[1:])} " and 100 * n >= percent * a
            for g, n in often.items()
        ):
            found[lang].append((-score, -a, text.strip().encode(), left, right))
    return sorted(
        repr((lang, i, p.decode(), -a, left, right, size[lang], -score))
        for lang, held in found.items()
        for i, (score, a, p, left, right) in enumerate(sorted(held)[:first], 1)
    )


def crowd(n):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        body = " ".join(rng.choice(vocabulary, 30))
        rows.append((i, f"Hot Pair {body}, hot pair always again and {body[:40]}! the very same passage here.", "en" if i % 3 else None, "s", 1))
    return rows


@pytest.mark.parametrize("target", [phrases.TARGET, 50])
def test_phrases_against_counting(spark, monkeypatch, target):
    """With a low target, crowded pairs and triples are routed by more words and summed."""
    monkeypatch.setattr(phrases, "TARGET", target)
    rows = [*cases.odd_rows(), *crowd(120)]
    docs = spark.createDataFrame(rows, cases.SCHEMA).selectExpr("*", *[f"{v} AS {k}" for k, v in cases.CLASHING.items()])
    for least, first in ((30, 2000), (5, 40)):
        got = phrases.collocations(docs.repartition(5), least, first)
        assert rows_of(got) == mined(rows, least, first)


def test_phrases_by_any_join(spark, monkeypatch):
    monkeypatch.setattr(common.small, "__defaults__", (-1,))
    rows = crowd(60)
    got = phrases.collocations(spark.createDataFrame(rows, cases.SCHEMA), 10, 100)
    assert rows_of(got) == mined(rows, 10, 100)


def test_no_phrases(spark):
    assert phrases.collocations(cases.empty_documents(spark)).count() == 0
    few = spark.createDataFrame([(1, "one two three", "en"), (2, None, None)], "doc_id long, text string, lang string")
    assert phrases.collocations(few).count() == 0


@pytest.mark.parametrize("route", [2, 3, 4])
def test_quicksort_counts_every_prefix(route):
    rng = np.random.default_rng(3)
    suffixes = rng.choice(np.array([1, 2, 3, 2**63 + 5], np.uint64), (3000, 4))
    for j in range(2, 4):
        suffixes[(rng.random(3000) < 0.2) | (suffixes[:, j - 1] == 0), j] = 0
    weights = None if route == 2 else rng.integers(1, 4, 3000)
    want = Counter()
    for row, w in zip(suffixes.tolist(), [1] * 3000 if weights is None else weights.tolist(), strict=True):
        for k in (2, 3, 4):
            if row[k - 1]:
                want[tuple(row[:k])] += w
    got = {}
    for length, at, n in phrases.frequent_prefixes(suffixes, weights, 60, route):
        for row, count in zip(suffixes[at, :length].tolist(), n.tolist(), strict=True):
            assert tuple(row) not in got
            got[tuple(row)] = count
    assert got == {k: n for k, n in want.items() if n >= 60 or len(k) < route}


def test_words_with_one_hash_are_refused(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, "c d", "en")], "doc_id long, text string, lang string")

    def clash(batches):
        import pyarrow as pa

        for _ in batches:
            pass
        yield pa.RecordBatch.from_pylist(
            [dict(kind=1, lang="en", number=7, n=1, word=w, counts=None) for w in ("a", "b")],
            pa.schema([("kind", pa.int32()), ("lang", pa.string()), ("number", pa.int64()), ("n", pa.int64()), ("word", pa.string()), ("counts", pa.binary())]),
        )

    monkeypatch.setattr(phrases, "_survey", lambda slots: clash)
    with pytest.raises(ValueError, match="share a hash"):
        phrases.collocations(docs.coalesce(1))


# ---- source mixing


def shared_out(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by sharing, capping and sharing again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in capped]
        total = sum(weight[s] for s in open_)
        goal = {s: (left - sum(capped.values())) * weight[s] / total for s in open_}
        over = [s for s in open_ if goal[s] > most * sizes[s] * (1 + 1e-12)]
        if not over:
            return {**goal, **capped}
        capped |= {s: most * sizes[s] for s in over}


def check_mix(got, rows):
    sizes, taken, longest = Counter(), Counter(), Counter()
    for _, text, _, source, *_ in rows:
        sizes[source] += len(cases.spaced_words(text))
        longest[source] = max(longest[source], len(cases.spaced_words(text)))
    goal = shared_out(sizes)
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter(
        (d, s, len(cases.spaced_words(t))) for d, t, _, s, *_ in rows
    )
    for r in got:
        assert r.source_size == sizes[r.source]
        assert math.isclose(r.target, goal[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    for s, n in sizes.items():
        assert abs(taken[s] - goal[s]) <= longest[s]


@pytest.mark.parametrize("bound", [500_000, -1])
def test_mix_of_odd_rows(spark, monkeypatch, bound):
    monkeypatch.setattr(common.small, "__defaults__", (bound,))
    rows = [*cases.odd_rows(), (300, "", "en", "without words", 0), (301, "a b c", "en", "", 0), (302, "ä ß", "en", "Zoë", 0)]
    docs = spark.createDataFrame(rows, cases.SCHEMA).selectExpr("*", *[f"{v} AS {k}" for k, v in cases.CLASHING.items()])
    got = mixing.mixed(docs.repartition(4)).collect()
    check_mix(got, rows)
    again = mixing.mixed(docs.repartition(7).orderBy("n_chars")).collect()
    assert Counter(map(repr, got)) == Counter(map(repr, again))
    assert mixing.mixed(cases.empty_documents(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "s"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r.target, r.taken) for r in mixing.mixed(blank).collect()} == {(0.0, 0)}


def test_mix_of_many_sources(spark):
    """Sources beyond one partition, a hot one among them, with caps in several rounds."""
    rng = np.random.default_rng(11)
    rows = [
        (i, "x " * int(rng.integers(0, 30)), "en", "hot" if i % 3 == 0 else f"s{int(rng.integers(0, 60)) ** 2 % 97}", 1)
        for i in range(3000)
    ]
    check_mix(mixing.mixed(spark.createDataFrame(rows, cases.SCHEMA).repartition(9)).collect(), rows)


def test_ranks_cross_pieces(spark):
    rows = [(i, "ab"[i % 7 == 0]) for i in range(2000)]
    df = spark.createDataFrame(rows, "v long, g string").repartition(6)
    got = {(r.g, r.v): r.place for r in mixing.ranked(df, "g", F.col("g"), F.col("v")).collect()}
    want = {(g, v): n for g in "ab" for n, v in enumerate(v for v, x in rows if x == g)}
    assert got == want


def test_copies_are_exact(spark):
    """Expected copies a hair below 2 never give a third, however far the prefix sum has run."""
    below = 10**17 + 3
    df = spark.range(10**9, 10**9 + 50).select(
        mixing.crossed(F.col("id"), F.lit(2 * below - 1).cast("decimal(38,0)"), F.lit(below).cast("decimal(38,0)"), F.lit(below - 1).cast("decimal(38,0)")).alias("c")
    )
    want = [((n + 1) * (2 * below - 1) + below - 1) // below - (n * (2 * below - 1) + below - 1) // below for n in range(10**9, 10**9 + 50)]
    assert [r.c for r in df.collect()] == want
