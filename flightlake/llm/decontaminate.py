"""Benchmark passages found in documents, by a prefix-filtered containment join.

A window is 13 consecutive words of a benchmark item (the whole item if it is shorter).
Being contained means containing every word of the window, so the necessary prefix is a
single word; the rarest is taken, by counts over all documents.  Document words are
joined to those prefix words; the word's place in the window fixes where the window
would have to start, which must lie inside the document (positional and length bounds);
only then are the words compared exactly, over a stretch as long as a window needs.

Words of documents first meet a table of fixed size, the hash buckets of the words asked
for, which is broadcast however many these are.  Only what passes is counted, or joined
with its stretch of at most 25 words: no text is shuffled, whether windows are few enough
to be broadcast or not.

Defined results: null or empty text has no words and is never contaminated; an item without
words has no window; repeated items count by their id, a repeated document row gets the same
answer; of equally rare words the first by bytes is the prefix; a text of any length is read
whole; an empty table gives no rows, an empty benchmark no contamination; other columns are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlake.llm.common import KEY, ascii_lower, join_documents, keyed, scratch_table, small

#: ASCII letters and digits, and everything beyond ASCII, make words.
WORD = r"[\p{Alnum}\P{ASCII}]+"
#: Windows of some hundred bytes each that are broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 100_000
#: Hash buckets that tell which words are asked for: at most so many numbers are broadcast.
BUCKETS = 1 << 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Distinct windows ``(window, item_ids)`` of all items."""
    words = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")
    ).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1))
    return (
        words.select("item_id", "words", F.explode(starts).alias("start"))
        .select("item_id", F.slice("words", F.col("start"), size).alias("window"))
        .groupBy("window")
        .agg(F.collect_set("item_id").alias("item_ids"))
    )


def among(rows: DataFrame, word: str, known: DataFrame) -> DataFrame:
    """Rows whose word is among the ``word`` of ``known``, and a few more that share a bucket."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    buckets = known.select(bucket(F.col("word")).alias("_bucket")).distinct()
    return rows.join(F.broadcast(buckets), bucket(F.col(word)) == F.col("_bucket"), "left_semi")


def prefix_index(docs: DataFrame, windows: DataFrame, n_windows: int | None = None, size: int = 13) -> DataFrame:
    """Each window under its prefix word: ``(word, offset, window, item_ids)``.

    Words are ordered by how often they occur in all documents, the word itself settling
    ties; windows without a word in any document drop out, as they occur nowhere.  Counts
    are partial before they are shuffled.
    """
    most = None if n_windows is None else n_windows * size
    vocabulary = scratch_table(windows.select(F.explode("window").alias("word")).distinct(), "vocabulary", rows=most)
    words = docs.select(F.explode(words_of(F.col("text"))).alias("word"))
    counts = among(words, "word", vocabulary).groupBy("word").count()
    placed = windows.select("window", "item_ids", F.posexplode("window").alias("offset", "word"))
    rarest = (
        placed.join(counts, "word", "left")
        .groupBy("window")
        .agg(
            F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word", "offset")).alias("rarest"),
            F.first("item_ids").alias("item_ids"),
        )
        .where("rarest.n > 0")
    )
    return rarest.select(
        F.col("rarest.word").alias("word"), F.col("rarest.offset").alias("offset"), "window", "item_ids"
    )


def occurrences(docs: DataFrame, index: DataFrame, n_index: int, size: int = 13) -> DataFrame:
    """``(doc_id, text_hash, start, length, item_ids)`` of every occurrence of a window.

    Bounds and the exact comparison are part of the join's condition.  A place brings the
    words a window of ``size`` around it can reach, never the document's.
    """
    words = keyed(docs).select(*KEY, words_of(F.col("text")).alias("words"))
    places = words.select(*KEY, F.size("words").alias("n"), "words", F.posexplode("words").alias("pos", "prefix"))
    before = F.least(F.col("pos"), F.lit(size - 1))
    around = among(places, "prefix", index).select(
        *KEY, "n", "pos", "prefix", before.alias("before"), F.slice("words", F.col("pos") - before + 1, before + size).alias("around")
    )
    start, length = F.col("pos") - F.col("offset"), F.size("window")
    inside = (start >= 0) & (start + length <= F.col("n"))
    same = F.slice("around", F.greatest(F.col("before") - F.col("offset"), F.lit(0)) + 1, length) == F.col("window")
    return around.join(
        small(index, n_index, BROADCAST_WINDOWS), (F.col("prefix") == F.col("word")) & inside & same
    ).select(*KEY, start.alias("start"), length.alias("length"), "item_ids")


def covered_words(spans: Column) -> Column:
    """Words inside any of the spans, sorted ``(start, length)`` structs."""
    begin = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))

    def add(acc: Column, span: Column) -> Column:
        stop = span["start"] + span["length"]
        new = F.greatest(F.lit(0), stop - F.greatest(span["start"], acc["upto"]))
        return F.struct(F.greatest(acc["upto"], stop).alias("upto"), (acc["n"] + new).alias("n"))

    return F.aggregate(spans, begin, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """``KEY, n_words, n_hit, n_items, items_sha256, contaminated`` of every document.

    Contaminated: a twentieth or more of a document's words lie in benchmark windows.
    """
    windows = scratch_table(item_windows(benchmark, size), "windows")
    n_windows = windows.count()
    index = scratch_table(prefix_index(docs, windows, n_windows, size), "prefixes", rows=n_windows)
    found = occurrences(docs, index, index.count(), size)
    spans = found.groupBy(*KEY).agg(
        F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("items"),
    )
    hits = spans.select(*KEY, covered_words(F.col("spans")).cast("long").alias("n_hit"), "items")
    counted = keyed(docs).select(
        *KEY, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_words")
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return join_documents(counted, hits).select(
        *KEY,
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
ORACLE = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS win
            FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT k FROM windows),
starts AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM docs, sizes WHERE len(w) >= k),
found AS (SELECT doc_id, s, starts.k, item_id FROM starts
          JOIN windows ON windows.k = starts.k AND windows.win = array_to_string(w[s:s + starts.k - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM found) GROUP BY 1),
items_of AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
             FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN items_of USING (doc_id)
"""
