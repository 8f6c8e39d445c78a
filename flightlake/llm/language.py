"""The languages of a document as a mixture, inferred by expectation-maximisation.

Each language has a distribution over byte trigrams of letters, learned from labelled
documents.  In a document every word gets a likelihood under each language from its
trigrams; expectation-maximisation finds the proportions of languages that explain the
words best; the set of languages kept is the one whose likelihood, less a penalty for
each further language, is highest.  The answer is the largest of that set and its share.

Learning uses at most about ``DOCS_PER_LANGUAGE`` documents of each language, chosen by
a hash, and never one that is held out; of the ``LANGUAGES`` languages that most documents
are in, so that what is gathered and sent to the workers has a bound.

Defined results: null text, or text without a letter, is ``und`` with score 0; so is
everything where nothing could be learned.  Repeated rows get the same answer; a null id is
not held out and teaches nothing; of languages with equal shares the first by name is
taken; a text of any length is read whole; an empty table gives no rows; the columns of
``docs`` come back inside ``row``, so none of their names can clash.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlake.llm import words
from flightlake.llm.common import held_out, ship

BUCKETS = 1 << 16
DOCS_PER_LANGUAGE = 2_000
LANGUAGES = 256
STEPS = 12
LETTER = re.compile(r"[^\W\d_]")
FOUND = "struct<lettered:boolean,lang_pred:string,score:double,languages:map<string,double>>"


def _trigrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of every word, a space at both ends, and where each word's begin."""
    n = ends - starts
    at = np.concatenate(([0], np.cumsum(n)))
    word = np.repeat(np.arange(len(n)), n)
    middle = starts[word] + (np.arange(at[-1]) - at[:-1][word])
    low = words.LOWER[data].astype(np.uint32)
    left = np.where(middle == starts[word], np.uint32(32), low[middle - 1])
    right = np.where(middle + 1 == ends[word], np.uint32(32), low[np.minimum(middle + 1, len(low) - 1)])
    key = (left << 16) | (low[middle] << 8) | right
    return ((key * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), at


def _texts(column: pa.Array) -> Iterator[tuple]:
    data, bounds = words.utf8(column)
    for a, b in words.portions(bounds, words.SLICE // 2):
        part, rows = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        starts, ends = words.spans(part, rows, words.NO_LETTERS)
        yield a, b, part, rows, starts, ends, np.searchsorted(starts, rows)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of each language in the partition."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch["lang"].to_pylist()
        for a, b, data, rows, starts, ends, at in _texts(batch["text"]):
            grams, begin = _trigrams(data, starts, ends)
            for i in range(a, b):
                own = grams[begin[at[i - a]] : begin[at[i - a + 1]]]
                total = totals.setdefault(langs[i], np.zeros(BUCKETS, np.int64))
                total += np.bincount(own, minlength=BUCKETS)
    for lang, total in totals.items():
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(total[seen])],
            ["lang", "bucket", "n"],
        )


def learn(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, most: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages, and the log-probability of every trigram bucket under each."""
    taught = docs.where(F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    counted = taught.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(most)
    sizes = {r["lang"]: r["n"] for r in counted.collect()}
    million = 1_000_000
    share = F.create_map(
        *[F.lit(x) for k, n in sizes.items() for x in (k, min(million, -(-million * per_language // n)))]
    )
    if not sizes:
        return [], np.zeros((BUCKETS, 0), np.float32)
    sample = taught.where(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < F.element_at(share, F.col("lang")))
    counts = (
        sample.select("lang", "text")
        .mapInArrow(_count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = sorted(sizes)
    table = np.full((BUCKETS, len(names)), 0.5)
    column = np.array([names.index(x) for x in counts["lang"].to_pylist()], np.int64)
    table[counts["bucket"].to_numpy(), column] += counts["n"].to_numpy()
    return names, np.log(table / table.sum(axis=0)).astype(np.float32)


def mixture(
    likelihood: np.ndarray, at: np.ndarray, penalty: float, steps: int = STEPS
) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of languages of every row, and which of them its set keeps.

    ``likelihood``: of each word under each language, as logarithms; ``at``: where each
    row's words begin.
    """
    rows, langs = len(at) - 1, likelihood.shape[1]
    n = np.diff(at)
    row = np.repeat(np.arange(rows), n)
    relative = np.exp(likelihood - likelihood.max(axis=1, keepdims=True)) + np.float32(1e-30)

    def settle(shares: np.ndarray, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            parts = relative * shares[row]
            parts /= parts.sum(axis=1, keepdims=True)
            shares = words.row_sums(parts, at) / np.maximum(n, 1)[:, None].astype(np.float32)
        return shares

    shares = settle(np.full((rows, langs), 1 / langs, np.float32), steps)
    rank = np.argsort(np.argsort(-shares, axis=1, kind="stable"), axis=1, kind="stable")
    best, chosen = np.full(rows, -np.inf), np.zeros((rows, langs), bool)
    for size in range(1, langs + 1):
        kept = rank < size
        within = np.where(kept, shares + np.float32(1e-6), np.float32(0))
        within /= within.sum(axis=1, keepdims=True)
        fit = words.row_sums(np.log((relative * within[row]).sum(axis=1) + 1e-30), at)
        fit = fit - penalty * (size - 1) * np.log(n + 2.0)
        better = fit > best
        best = np.where(better, fit, best)
        chosen[better] = kept[better]
    within = np.where(chosen, shares + np.float32(1e-6), np.float32(0))
    within /= within.sum(axis=1, keepdims=True)
    return settle(within, 2), chosen


def _predict(names: list[str], table: np.ndarray, penalty: float) -> Callable:
    def told(data: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> pa.StructArray:
        n = len(rows) - 1
        lettered = np.diff(at) > 0
        if len(starts):
            # Letters beyond ASCII need looking at; most texts have one of A-Z.
            ascii_word = np.logical_or.reduceat((data < 128) & ~words.NO_LETTERS[data], starts)
            plain = words.row_sums(ascii_word.astype(np.int64), at) > 0
            for i in np.flatnonzero(lettered & ~plain).tolist():
                lettered[i] = bool(LETTER.search(bytes(data[rows[i] : rows[i + 1]]).decode()))
        shares, chosen = np.zeros((n, len(names))), np.zeros((n, len(names)), bool)
        if names and len(starts):
            grams, begin = _trigrams(data, starts, ends)
            likelihood = np.add.reduceat(table[grams], begin[:-1], axis=0)
            shares, chosen = mixture(likelihood, at, penalty)
        sure = lettered & (len(names) > 0)
        top = shares.argmax(axis=1) if names else np.zeros(n, np.int64)
        found = [
            [(names[j], float(shares[i, j])) for j in np.flatnonzero(chosen[i]).tolist()] if sure[i] else []
            for i in range(n)
        ]
        columns = {
            "lettered": pa.array(lettered),
            "lang_pred": pa.array([names[t] if s else "und" for t, s in zip(top.tolist(), sure.tolist(), strict=True)], pa.string()),
            "score": pa.array([min(1.0, float(shares[i, top[i]])) if sure[i] else 0.0 for i in range(n)], pa.float64()),
            "languages": pa.array(found, pa.map_(pa.string(), pa.float64())),
        }
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            parts = [told(data, rows, starts, ends, at) for _, _, data, rows, starts, ends, at in _texts(column)]
            nothing = np.empty(0, np.int64)
            yield pa.concat_arrays(parts) if parts else told(np.empty(0, np.uint8), np.zeros(1, np.int64), nothing, nothing, np.zeros(1, np.int64))

    return run


def languages(docs: DataFrame, taught_by: DataFrame | None = None, penalty: float = 3.0) -> DataFrame:
    """``(row, held_out, lettered, lang_pred, score, languages)``: every row of ``docs`` and what was found.

    ``lettered``: the text has a letter, so it is in some language, be that known or not;
    ``penalty``: log-likelihood a further language must win, times the log of the number
    of words; ``languages``: the shares of the chosen set.  ``row`` holds the input's
    columns; of these only the text passes through Python.
    """
    ship(docs.sparkSession)
    known = taught_by if taught_by is not None else docs
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    names, table = learn(known)
    run = _predict(names, table, penalty)

    def predicted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(texts)

    verdict = F.arrow_udf(predicted, FOUND)(F.col("text"))
    return docs.select(
        F.struct(*docs.columns).alias("row"), held_out(F.col("doc_id").cast("long")).alias("held_out"), verdict.alias("verdict")
    ).select("row", "held_out", "verdict.*")
