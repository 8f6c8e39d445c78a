"""Toxic documents and the sentences that make them so, by multiple-instance learning.

A sentence's score is a logistic of weights of its words; a document is toxic unless
every sentence is innocent (noisy-or).  Only documents are labelled; the gradient of
the document's likelihood says which sentences to blame.  Training uses about
``SAMPLE`` labelled documents chosen by a hash, never a held-out one; scoring covers
every text whole and returns the offending sentences as character ranges.

Words are runs of letters, A-Z folded, and weigh through themselves and their first 4, 5
and 6 bytes, so inflected forms share what their stem has learned.  Sentences end at ``.``,
``!``, ``?`` or a line feed.

Defined results: null, empty or wordless text has the score of no sentence at all, 0;
without a label of either kind nothing is learned and every score is 0; repeated rows get
the same answer; several labels of a document count as its highest; a score of just 0.5 is
toxic; a text of any length is scored whole; an empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlake.llm import words
from flightlake.llm.common import held_out, scratch_table, ship, small

BUCKETS = 1 << 19
STEMS = (4, 5, 6)
#: Root of the likelihood ratio by which a feature must tell the classes apart to weigh anything.
CLEAR = 5.0
#: Labelled documents learned from, at most about.
SAMPLE = 8_000
OUTPUT = (
    "doc_id long, held_out boolean, score double, predicted int, "
    "offending array<struct<start:int,length:int,score:double>>"
)
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


#: Features of a word: itself and its stems.
WIDTH = 1 + len(STEMS)


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Buckets of every word and its stems; a word too short for a stem has itself again."""
    out = np.empty((len(starts), WIDTH), np.int32)
    for i, length in enumerate((None, *STEMS)):
        stop = ends if length is None else np.minimum(ends, starts + length)
        hashed = words.hashes(data, starts, stop)
        if length is not None:
            hashed = words.mixed(hashed + np.uint64(length) * (stop < ends).astype(np.uint64))
        out[:, i] = (hashed >> np.uint64(45)).astype(np.int32)
    return out.ravel()


def _sentences(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Word buckets; where each sentence's words and each row's sentences begin; the sentences' bytes."""
    data, bounds = words.utf8(batch["text"])
    for a, b in words.portions(bounds):
        part, rows = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        starts, ends = words.spans(part, rows, words.NO_LETTERS)
        first, last = words.spans(part, rows, _ENDS)
        held = np.searchsorted(starts, np.append(first, len(part)))
        worded = np.diff(held) > 0
        first, last = first[worded], last[worded]
        held = np.append(np.searchsorted(starts, first), len(starts))
        yield a, b, part, rows, _features(part, starts, ends), held * WIDTH, np.searchsorted(first, rows), first, last


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each labelled document as sentences of word buckets."""
    for batch in batches:
        for a, b, _, _, buckets, held, at, _, _ in _sentences(batch):
            part = batch.slice(a, b - a)
            inner = [held[at[i] : at[i + 1] + 1] for i in range(b - a)]
            yield pa.RecordBatch.from_arrays(
                [
                    part["toxic"],
                    pa.array([np.diff(x).astype(np.int32) for x in inner], pa.list_(pa.int32())),
                    pa.array([buckets[x[0] : x[-1]] if len(x) > 1 else buckets[:0] for x in inner], pa.list_(pa.int32())),
                ],
                ["toxic", "sizes", "buckets"],
            )


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of the partition, and toxic ones, every feature is."""
    with_it, bad = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for toxic, buckets in zip(batch["toxic"].to_pylist(), batch["buckets"], strict=True):
            seen = np.unique(buckets.values.to_numpy())
            with_it[seen] += 1
            if toxic:
                bad[seen] += 1
    met = np.flatnonzero(with_it)
    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(with_it[met]), pa.array(bad[met])], ["bucket", "n", "bad"])


def _clear_only(clear: np.ndarray) -> Callable:
    """Documents with the features that weigh anything, and sentences without one only counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            empty, kept_sizes, kept = [], [], []
            for sizes, buckets in zip(batch["sizes"], batch["buckets"], strict=True):
                sizes, buckets = sizes.values.to_numpy(), buckets.values.to_numpy()
                good = clear[buckets]
                left = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[good], minlength=len(sizes))
                empty.append(int((left == 0).sum()))
                kept_sizes.append(left[left > 0].astype(np.int32))
                kept.append(buckets[good])
            yield pa.RecordBatch.from_arrays(
                [
                    batch["toxic"],
                    pa.array(empty, pa.int64()),
                    pa.array(kept_sizes, pa.list_(pa.int32())),
                    pa.array(kept, pa.list_(pa.int32())),
                ],
                ["toxic", "empty", "sizes", "buckets"],
            )

    return run


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def clear_features(with_it: np.ndarray, bad: np.ndarray, n: int, n_bad: int) -> tuple[np.ndarray, np.ndarray]:
    """Which features tell the classes apart, and the weights to begin from.

    ``with_it``, ``bad``: documents, and toxic ones, that hold each; ``n``, ``n_bad``: of all.
    """
    good = with_it - bad
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n - n_bad + 1))
    share = n_bad / n
    surprise = 2 * (
        bad * np.log(np.maximum(bad, 1) / np.maximum(with_it * share, 1e-9))
        + good * np.log(np.maximum(good, 1) / np.maximum(with_it * (1 - share), 1e-9))
    )
    clear = (odds > 0) & (surprise > CLEAR**2)
    return clear, np.where(clear, odds / WIDTH, 0)


def train(
    toxic: np.ndarray, empty: np.ndarray, sizes: list[np.ndarray], buckets: np.ndarray, begin: np.ndarray, epochs: int = 150
) -> np.ndarray:
    """Weights of the word buckets, the bias last.

    ``empty``: sentences of each document without a feature that weighs; ``sizes``: features of
    each of the others; ``buckets``: all of them in order; ``begin``: the weights at first.
    """
    y = toxic.astype(bool)
    n_sentences = np.array([len(x) for x in sizes])
    per_sentence = np.concatenate(sizes) if len(sizes) else np.empty(0, np.int64)
    held = np.concatenate(([0], np.cumsum(per_sentence)))
    at = np.concatenate(([0], np.cumsum(n_sentences)))
    sentence = np.repeat(np.arange(len(per_sentence)), per_sentence)
    weights = np.append(begin, -4.0)
    speed = np.full(BUCKETS + 1, 1e-8)
    for _ in range(epochs):
        z = words.row_sums(weights[buckets], held) + weights[-1]
        # -log of no sentence being toxic
        calm = words.row_sums(_softplus(z), at) + empty * _softplus(weights[-1])
        blame = np.where(y, -np.exp(-calm) / np.maximum(-np.expm1(-calm), 1e-9), 1.0)
        slope = np.repeat(blame, n_sentences) * np.exp(-_softplus(-z)) / len(y)
        bias = slope.sum() + (blame * empty).sum() * np.exp(-_softplus(-weights[-1])) / len(y)
        gradient = np.append(np.bincount(buckets, weights=slope[sentence], minlength=BUCKETS), bias)
        gradient[:-1] += 1e-5 * weights[:-1]
        speed += gradient**2
        weights -= 0.3 * gradient / np.sqrt(speed)
    return weights


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from about ``sample`` labelled documents.

    Features are counted by class where the documents are; only those that tell the classes
    apart reach the driver, and sentences without one as a number.
    """
    taught = (
        labels.where(F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    million = 1_000_000
    share = min(million, -(-million * sample // max(1, taught.count())))
    taught = taught.where(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < share)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bags = (
        texts.join(small(taught, taught.count()), "doc_id")
        .groupBy(F.xxhash64("text").alias("copy"))  # a copied text teaches once
        .agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
        .mapInArrow(_bags, "toxic int, sizes array<int>, buckets array<int>")
    )
    bags = scratch_table(bags.where(F.size("sizes") > 0), "bags")
    n, n_bad = bags.agg(F.count(F.lit(1)), F.count_if(F.col("toxic") == 1)).first()
    if not n_bad or n_bad == n:
        return np.append(np.zeros(BUCKETS), -np.inf)
    met = bags.mapInArrow(_met, "bucket int, n long, bad long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).toArrow()
    with_it, bad = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    with_it[met["bucket"].to_numpy()], bad[met["bucket"].to_numpy()] = met["n"].to_numpy(), met["bad"].to_numpy()
    clear, begin = clear_features(with_it, bad, n, n_bad)
    kept = bags.mapInArrow(_clear_only(clear), "toxic int, empty long, sizes array<int>, buckets array<int>").toArrow()
    sizes = [np.asarray(x, np.int64) for x in kept["sizes"].to_pylist()]
    flat = kept["buckets"].combine_chunks().flatten().to_numpy()
    return train(kept["toxic"].to_numpy(), kept["empty"].to_numpy(), sizes, flat, begin)


def _score(weights: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, rows, buckets, held, at, first, last in _sentences(batch):
                part = batch.slice(a, b - a)
                z = words.row_sums(weights[buckets], held) + weights[-1]
                p = -np.expm1(-words.row_sums(_softplus(z), at)).astype(float)
                score = np.exp(-_softplus(-z))
                offending: list[list[dict]] = [[] for _ in range(b - a)]
                bad = np.flatnonzero(score >= 0.5)
                for row, s in zip((np.searchsorted(at, bad, "right") - 1).tolist(), bad.tolist(), strict=True):
                    before = data[rows[row] : first[s]]
                    inside = data[first[s] : last[s]]
                    offending[row].append({
                        "start": int(((before & 0xC0) != 0x80).sum()),
                        "length": int(((inside & 0xC0) != 0x80).sum()),
                        "score": float(score[s]),
                    })
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        part["held_out"],
                        pa.array(p),
                        pa.array((p >= 0.5).astype(np.int32)),
                        pa.array(offending, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))),
                    ],
                    ["doc_id", "held_out", "score", "predicted", "offending"],
                )

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted, offending)`` of every row."""
    ship(docs.sparkSession)
    weights = learn(docs, labels)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), "text"
    )
    return rows.mapInArrow(_score(weights.astype(np.float32)), OUTPUT)
