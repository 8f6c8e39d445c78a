"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``docs``, whatever these are; a stage works on all that came before it.

Defined results: a null id or text passes every stage that has no reason to drop it
(language identification drops text without a letter); a repeated row leaves the
near-duplicate stage once; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlake.llm import decontaminate, language, line_dedup, near_duplicates, packing
from flightlake.llm.common import KEY, join_documents, read_table, scratch_table, small

#: Words a shingle has, and how alike near duplicates are at least.
SHINGLE, ALIKE = 5, 0.8


def _rows(docs: DataFrame) -> DataFrame:
    """The whole row as one column beside its key, so no names clash."""
    return docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
    )


def _without(rows: DataFrame, gone: DataFrame, most: int) -> DataFrame:
    """Rows whose key is not among ``gone``, which are ``most`` at most."""
    gone = scratch_table(gone, "gone", rows=most)
    return join_documents(rows, small(gone, gone.count()), "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language, also where none could be learned; those without a letter go."""
    return language.languages(docs).where("lettered").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more documents share; ``n_chars`` follows."""
    bitmaps = line_dedup.keep_bitmaps(docs)
    rows = _rows(docs).withColumn("text", F.col("row.text"))
    applied = line_dedup.apply_bitmaps(rows, bitmaps)
    changed = F.col("n_dropped") > 0
    row = F.col("row").withField("text", F.when(changed, F.col("kept_text")).otherwise(F.col("row.text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.length("kept_text").cast(kind)
        row = row.withField("n_chars", F.when(changed, length).otherwise(F.col("row.n_chars")))
    return applied.select(row.alias("row")).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    found = near_duplicates.near_duplicates(docs, SHINGLE, ALIKE)
    most = docs.count()
    copies = scratch_table(found.where("NOT kept").select("doc_id").distinct(), "copies", rows=most)
    rows = _rows(docs)
    left = rows.join(small(copies, copies.count()), "doc_id", "left_anti")
    # A row that is there twice, id and text, is there once afterwards.
    twice = scratch_table(rows.groupBy(*KEY).count().where("count > 1").select(*KEY), "twice", rows=most)
    if not twice.count():
        return left.select("row.*")
    once = join_documents(left, small(twice, twice.count()), "left_semi").groupBy(*KEY).agg(F.first("row").alias("row"))
    return _without(left, twice, most).select("row").union(once.select("row")).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not consist of benchmark passages to a twentieth or more."""
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    gone = found.where("contaminated").select(*KEY).distinct()
    return _without(_rows(docs), gone, docs.count()).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in sequences of at most 1024 tokens."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Language, near duplicates and tokens are beyond SQL; the tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
