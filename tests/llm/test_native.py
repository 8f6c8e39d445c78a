"""Licence scan, decontamination and line dedup against SQL and brute force."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from flightlake.llm import common, decontaminate, licenses, line_dedup

from . import cases

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("broadcast", [True, False])
def test_line_dedup(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
        monkeypatch.setattr(common.small, "__defaults__", (-1,))
    got = rows_of(line_dedup.deduplicated_lines(cases.odd_documents(spark)))
    keys = defaultdict(set)
    strip = " \t\n\x0b\x0c\r"
    for n, (doc, text, *_) in enumerate(dict.fromkeys(cases.odd_rows())):
        for line in (text or "").split("\n"):
            if key := cases.folded(line.strip(strip)):
                keys[key].add(n)
    often = {k for k, d in keys.items() if len(d) >= 10}
    want = []
    for doc, text, *_ in cases.odd_rows():
        lines = (text or "").split("\n")
        kept = [x for x in lines if cases.folded(x.strip(strip)) not in often]
        want.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert got == sorted(map(repr, want))
    assert any(w[2] for w in want)


def test_kept_runs_are_a_bitmap(spark):
    docs = spark.createDataFrame([(i, f"a\nb{i}\na\na\nc{i}") for i in range(3)], "doc_id long, text string")
    runs = line_dedup.keep_bitmaps(docs, min_docs=3).select("doc_id", "n_dropped", "kept_runs").collect()
    assert sorted((r[0], r[1], [tuple(x) for x in r[2]]) for r in runs) == [(i, 3, [(1, 1), (4, 1)]) for i in range(3)]


def contaminated(docs, items, size=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        words = word.findall(cases.folded(text or ""))
        k = min(size, len(words))
        for s in range(max(1, len(words) - size + 1) if words else 0):
            windows[tuple(words[s : s + k])].add(str(item))
    sizes = {len(w) for w in windows}
    for doc, text in docs:
        words = word.findall(cases.folded(text or ""))
        hit, found = set(), set()
        for k in sizes:
            for s in range(len(words) - k + 1):
                if own := windows.get(tuple(words[s : s + k])):
                    found |= own
                    hit.update(range(s, s + k))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        yield doc, len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)


ITEMS = [
    (1, cases.prose(1, 40)),
    (2, cases.prose(1, 120)[200:420]),
    (3, "two"),
    (3, "two"),
    (4, None),
    (5, ""),
    (6, "?!"),
    (7, "É ÇA 日本"),
    (8, "é ça"),
    (None, "same same same"),
    (9, cases.prose(77, 20)),
]


@pytest.mark.parametrize("bound", [100_000, -1])
def test_decontamination(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", bound)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("words", F.lit(1))
    got = decontaminate.contamination(cases.odd_documents(spark), items).drop("text_hash")
    want = contaminated([r[:2] for r in cases.odd_rows()], [x for x in ITEMS if x[0] is not None] + [("", "same same same")])
    rows = {repr(tuple(r)) for r in got.collect()}
    # An item without an id has windows, but no id to list.
    known = [w for w in want if w[0] != 14]
    assert {repr(w) for w in known} <= rows
    assert got.count() == len(cases.odd_rows())


def test_windows_beyond_a_broadcast(spark):
    """200 000 windows and a text of 20 000 words: no array of its words goes through an exchange."""
    texts = [cases.prose(900 + i, 10_012) for i in range(20)]
    document = f"{cases.prose(33, 10_000)} {' '.join(texts[7].split()[500:900])} {cases.prose(34, 9_600)}"
    docs = spark.createDataFrame([(1, document), (2, cases.prose(35, 200)), (3, texts[3][:4000])], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        windows = decontaminate.item_windows(items, 13)
        index = common.scratch_table(decontaminate.prefix_index(docs, windows), "prefixes")
        assert windows.count() > decontaminate.BROADCAST_WINDOWS
        found = decontaminate.occurrences(docs, index, decontaminate.BROADCAST_WINDOWS + 1)
        plan = found._jdf.queryExecution().executedPlan()
        lines = plan.toString().splitlines()
        at = [i for i, x in enumerate(lines) if re.search(r"Exchange hashpartitioning\(prefix", x)]
        # What is below projects the stretch from the words, and not the words themselves.
        assert at and not any(re.search(r"[\[ ]words#\d+(, |\])", re.sub(r"slice\(.*?\) AS", "AS", lines[i + 1])) for i in at)
        assert all("AS around#" in lines[i + 1] for i in at)
        got = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    for doc, *want in contaminated([(r.doc_id, r.text) for r in docs.collect()], list(enumerate(texts))):
        r = got[doc]
        assert [r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated] == want
    assert got[1].n_hit >= 400 and not got[1].contaminated and got[3].contaminated


def test_decontamination_at_the_border(spark):
    item = "p q r s"
    texts = [" ".join(["w"] * n) + f" {item}" for n in (75, 76, 77)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.contamination(docs, items).select("doc_id", "n_hit", "contaminated")
    assert rows_of(got) == ["(0, 4, True)", "(1, 4, True)", "(2, 4, False)"]


def test_licenses(spark):
    mit = dict((k, v) for k, v in licenses.KNOWN if k == "MIT")["MIT"]
    rows = [
        (1, "Some words\nReleased under the MIT Licence!\nmore"),
        (2, "  RELEASED under the   mit license"),
        (3, f"Copyright (c) 2020 Somebody\n\n{mit}"),
        (4, mit.replace("sublicense", "sub-license").replace(", ", ",\n * ")),
        (5, "This mentions the MIT License in passing"),
        (6, None),
        (7, ""),
        (None, "All rights reserved."),
        (8, "All rights reserved\nall rights reserved."),
        (8, "All rights reserved\nall rights reserved."),
        (9, "© 2024 Someone\nLicensed under CC BY-NC 4.0"),
        (10, "a " * 40_000),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"{v} AS {k}" for k, v in cases.CLASHING.items()])
    got = licenses.licenses_of(docs, licenses.known_licenses(spark))
    want = [
        (1, "", "MIT", 1), (2, "MIT", "MIT", 1), (3, "MIT", "MIT", 1), (4, "MIT", "", 0), (5, "", "", 0),
        (6, "", "", 0), (7, "", "", 0), (None, "all-rights-reserved", "all-rights-reserved", 1),
        (8, "", "all-rights-reserved", 2), (8, "", "all-rights-reserved", 2), (9, "CC-BY-NC-4.0", "CC-BY-NC-4.0", 1),
        (10, "", "", 0),
    ]
    assert rows_of(got) == sorted(map(repr, want))


def test_whole_license_files(spark):
    """Full texts with and without their title, as licence files have them."""
    full = {name: text for name, text in licenses.KNOWN if text.startswith("Permission ")}
    assert set(full) == {"0BSD", "ISC", "MIT"}
    files = [(name, f"{title}\n\nCopyright (c) 2020 Some Body\n\n{full[name]}\n") for name, title in (
        ("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("ISC", "ISC License"), ("0BSD", "BSD Zero Clause License"),
        ("MIT", ""), ("ISC", ""), ("0BSD", ""),
    )]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(files)], "doc_id long, text string")
    got = licenses.licenses_of(docs, licenses.known_licenses(spark)).collect()
    assert {r.doc_id: r.text_licenses for r in got} == {i: name for i, (name, _) in enumerate(files)}


def test_empty_tables(spark):
    docs = cases.empty_documents(spark)
    items = spark.createDataFrame([], "item_id long, text string")
    assert line_dedup.deduplicated_lines(docs).count() == 0
    assert decontaminate.contamination(docs, items).count() == 0
    assert decontaminate.contamination(cases.odd_documents(spark), items).where("contaminated").count() == 0
    assert licenses.scan(docs, licenses.known_licenses(spark)).count() == 0
    none = licenses.known_licenses(spark).limit(0)
    assert licenses.scan(cases.odd_documents(spark), none).where("n_lines > 0").count() == 0


def test_no_python_in_native_operators(spark):
    docs = cases.odd_documents(spark)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for df in (
        line_dedup.deduplicated_lines(docs),
        decontaminate.contamination(docs, items),
        licenses.scan(docs, licenses.known_licenses(spark)),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("name", ["op1_license_scan", "op2_decontamination", "op4_line_dedup"])
def test_against_sql(spark, name):
    from flightlake.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert rows_of(df.select(*names)) == sorted(map(repr, cursor.fetchall()))
