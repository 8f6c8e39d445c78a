"""The pipeline's stages, each on its own input, against plain Python."""

from __future__ import annotations

import collections
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flightlake.llm import line_dedup

from . import cases
from .test_native import contaminated

FOLDER = "/root/testdata/sf0.001"


def test_stages_of_the_table(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in docs.collect()}
        if name == "packing":
            assert set(after) == set(before)
            continue
        assert docs.columns == columns
        if name == "language":
            assert set(after) == {d for d, r in before.items() if re.search(r"[^\W\d_]", r.text or "")}
        elif name == "line_dedup":
            seen = collections.defaultdict(set)
            key = lambda x: cases.folded(x.strip(line_dedup.STRIPPED))
            for d, r in before.items():
                for x in r.text.split("\n"):
                    seen[key(x)].add(d)
            for d, r in before.items():
                want = "\n".join(x for x in r.text.split("\n") if not key(x) or len(seen[key(x)]) < 10)
                assert after[d].text == want and after[d].n_chars == len(want)
        elif name == "near_duplicates":
            component = cases.linked([(d, r.text) for d, r in before.items()], corpus_pipeline.SHINGLE, 80)
            assert set(after) == {d for d in before if component.get(d, d) == d}
        else:
            bad = {w[0] for w in contaminated([(d, r.text) for d, r in before.items()], items) if w[-1]}
            assert set(after) == set(before) - bad


def test_language_of_unlabelled_tables(spark):
    """Where no language can be learned, only text without a letter goes."""
    docs = cases.odd_documents(spark)
    want = collections.Counter(r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or ""))
    none = F.lit(None).cast("string")
    held = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.col("lang"))
    for lang in (none, held):
        got = corpus_pipeline.identify_language(spark, docs.withColumn("lang", lang), FOLDER)
        assert collections.Counter(r.doc_id for r in got.collect()) == want
    letters = spark.createDataFrame([(1, "日本"), (2, "…— 12"), (3, "é"), (4, None)], "doc_id long, text string")
    got = corpus_pipeline.identify_language(spark, letters.withColumn("lang", none), FOLDER)
    assert {r.doc_id for r in got.collect()} == {1, 3}


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 100


@pytest.mark.parametrize("make", [cases.odd_documents, cases.empty_documents])
def test_odd_tables(spark, make, tmp_path):
    docs = make(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        if make is cases.odd_documents and name == "near_duplicates":
            ids = collections.Counter(r.doc_id for r in docs.collect())
            assert ids[10] == 1 and ids[None] == 1 and 1 in ids and 2 not in ids and 3 not in ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert (packed.count() > 0) == (make is cases.odd_documents)
