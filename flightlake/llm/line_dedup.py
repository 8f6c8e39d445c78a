"""Lines that repeat across documents, dropped everywhere; kept lines come back as bitmaps.

Line keys are hashed to 128 bits and range-partitioned by hash with the document as a
second and the position as a third sort key, so a line that a third of all rows share
spans many partitions.  Streaming a partition yields the first occurrence of a key in
each document; those are counted per key, partially before the shuffle.  What is
returned per document is a run-length coded keep bitmap, never text.

Defined results: null or empty text is one empty line, whose key has no code point and is
never dropped; a repeated row, of equal id and text, is one document and gets the answer
again; ties and order of rows do not matter; a text of any length is read whole; an empty
table gives no rows; columns beside id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightlake.llm.common import KEY, ascii_lower, join_documents, keyed, scratch_table, small

#: Characters stripped from both ends of a line before it is compared.
STRIPPED = " \t\n\x0b\x0c\r"


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line worth comparing: its document, position, and two hashes of its key."""
    key = F.btrim(F.col("line"), F.lit(STRIPPED))
    return (
        keyed(docs)
        .select(*KEY, text_lines(ascii_lower(F.col("text"))).alias("lines"))
        .select(*KEY, F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
        .select(*KEY, "n_lines", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select(*KEY, "n_lines", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )


def frequent_keys(hashes: DataFrame, min_docs: int) -> DataFrame:
    """Hashes found in at least ``min_docs`` documents."""
    order = ["h1", "h2", *KEY]
    ranged = hashes.select(*order, "pos").repartitionByRange(*order).sortWithinPartitions(*order, "pos")
    first = F.row_number().over(Window.partitionBy(*order).orderBy("pos")) == 1
    return (
        ranged.withColumn("is_first", first)
        .where("is_first")
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n_docs"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2")
    )


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``(doc_id, text_hash, n_dropped, kept_runs)`` of every document that loses a line.

    ``kept_runs`` is the keep bitmap in run-length form: the stretches of kept lines, as
    ``(start, length)``.  A document that is not listed keeps all its lines.
    """
    hashes = scratch_table(line_hashes(docs, min_chars), "line-hashes")
    frequent = scratch_table(frequent_keys(hashes, min_docs), "frequent-lines", rows=hashes.count() // max(1, min_docs))
    dropped = hashes.join(small(frequent, frequent.count()), ["h1", "h2"], "left_semi")
    positions = dropped.groupBy(*KEY).agg(
        F.max("n_lines").alias("n_lines"), F.sort_array(F.collect_set("pos")).alias("p")
    )
    p = F.col("p")
    ends = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) != x + 1))
    starts = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x - 1))
    runs = positions.select(
        *KEY, "n_lines", F.size(p).alias("n_dropped"), starts.alias("starts"), ends.alias("ends")
    )

    def kept(i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("ends"), i - 1) + 1)
        stop = F.coalesce(F.get(F.col("starts"), i), F.col("n_lines"))
        return F.struct(start.alias("start"), (stop - start).alias("length"))

    gaps = F.transform(F.sequence(F.lit(0), F.size("starts")), kept)
    return runs.select(
        *KEY, "n_dropped", F.filter(gaps, lambda r: r["length"] > 0).alias("kept_runs")
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Documents with ``kept_text``, ``n_lines`` and ``n_dropped``; ``docs`` has ``KEY`` and ``text``."""
    lines = text_lines(F.col("text"))
    kept = F.flatten(
        F.transform("kept_runs", lambda r: F.slice(lines, r["start"] + 1, r["length"]))
    )
    return (
        join_documents(docs, bitmaps)
        .withColumn(
            "kept_text",
            F.when(F.col("kept_runs").isNull(), F.coalesce("text", F.lit(""))).otherwise(
                F.array_join(kept, "\n")
            ),
        )
        .withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0)).cast("long"))
        .drop("kept_runs")
    )


def deduplicated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)`` of every document."""
    applied = apply_bitmaps(keyed(docs), keep_bitmaps(docs, min_docs, min_chars))
    return applied.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256")
    )


ORACLE = """
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, doc_id, text, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM numbered),
keys AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (SELECT key FROM keys WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT (doc_id, sha256(text))) >= 10)
SELECT doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
FROM keys k LEFT JOIN often o ON k.key = o.key GROUP BY r, doc_id
"""
