"""Document quality by weak supervision: rules vote, their accuracies are estimated, not set.

Each rule looks at one figure of a text and votes good, bad, or abstains.  Votes are
counted per pattern over all documents; expectation-maximisation on those counts
estimates how often each rule votes what under either class, and a document's quality is
the posterior probability of the good class given its votes.  That replaces demanding
that every rule pass; only the two base rules (too short, too repetitive) rule out
a document by themselves.

Figures are computed on whole texts as Arrow batches; the pattern table has at most
3 ** rules rows, which bounds what reaches the driver and is broadcast.

Defined results: null, empty or blank text has figures of 0 and fails the base rules;
repeated rows get the same answer; a null id is carried along; a document just as likely
good as not is kept; a text of any length is measured whole; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlake.llm import words
from flightlake.llm.common import scratch_table, ship

FIGURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_ended", "n_letters", "n_upper", "n_digits", "n_shouts",
)
SCHEMA = "doc_id long, " + ", ".join(f"{f} long" for f in FIGURES)
WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BREAK = np.zeros(256, bool)
_BREAK[ord("\n")] = True
_ENDING = np.zeros(256, bool)
_ENDING[[ord(c) for c in ".!?:;\"')"]] = True


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _class("0123456789")
_SHOUT = _class("!?")


def repeated_words(hashed: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Words of each row that lie in a window of ``k`` words the row has twice or more."""
    out = np.zeros(len(at) - 1, np.int64)
    grams, begin = words.windows(hashed, at, k)
    _, once = words.distinct(grams, begin)
    for i in np.flatnonzero(np.diff(once) < np.diff(begin)).tolist():
        own = grams[begin[i] : begin[i + 1]]
        _, inverse, counts = np.unique(own, return_inverse=True, return_counts=True)
        first = np.flatnonzero(counts[inverse] > 1)
        edges = np.zeros(len(own) + k, np.int64)
        edges[first] += 1
        edges[first + k] -= 1
        out[i] = int((np.cumsum(edges) > 0).sum())
    return out


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = words.utf8(batch["text"])
        for a, b in words.portions(bounds):
            part, rows = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]

            def per_row(flags: np.ndarray, rows: np.ndarray = rows) -> np.ndarray:
                return words.row_sums(flags.astype(np.int64), rows)

            starts, ends = words.spans(part, rows)
            at = np.searchsorted(starts, rows)
            hashed = words.hashes(part, starts, ends, words.AS_IS)
            first, last = words.spans(part, rows, _BREAK)
            # Lines without a word do not count.
            worded = np.diff(np.searchsorted(starts, np.append(first, len(part)))) > 0
            first, last = first[worded], last[worded]
            lines = words.hashes(part, first, last, words.AS_IS)
            line_at = np.searchsorted(first, rows)
            _, different = words.distinct(lines, line_at)
            ending = ends[np.searchsorted(starts, last) - 1] - 1 if len(last) else last
            figures = (
                np.diff(at),
                per_row(((part & 0xC0) != 0x80) & ~words.SPACES[part]),
                per_row(_SYMBOL[part]),
                np.diff(line_at) - np.diff(different),
                repeated_words(hashed, at, WINDOW),
                np.diff(line_at),
                words.row_sums(_ENDING[part[ending]].astype(np.int64), line_at),
                per_row(~words.NO_LETTERS[part] & ((part & 0xC0) != 0x80)),
                per_row(_UPPER[part]),
                per_row(_DIGIT[part]),
                per_row(_SHOUT[part]),
            )
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].slice(a, b - a), *[pa.array(f.astype(np.int64)) for f in figures]],
                ["doc_id", *FIGURES],
            )


def figures(docs: DataFrame) -> DataFrame:
    """The figures of every text, one row per row."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_figures, SCHEMA)


@dataclass(frozen=True)
class Rule:
    """Votes ``good`` (1) or bad (0) where ``when`` holds, and otherwise abstains."""

    name: str
    good: bool
    when: Callable[[], Column]


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _plain() -> Column:
    """No rule speaks for a text of marks."""
    return (_share("n_symbols", "n_words") <= 0.1) & (_share("n_letters", "word_chars") >= 0.8)


RULES = (
    Rule("short", False, lambda: F.col("n_words") < 30),
    Rule("odd_words", False, lambda: ~_share("word_chars", "n_words").between(2.0, 12.0)),
    Rule("symbols", False, lambda: _share("n_symbols", "n_words") > 0.2),
    Rule("equal_lines", False, lambda: _share("n_dup_lines", "n_lines") > 0.3),
    Rule("repetition", False, lambda: _share("n_repeat_words", "n_words") > 0.2),
    Rule("capitals", False, lambda: _share("n_upper", "n_letters") > 0.5),
    Rule("shouting", False, lambda: _share("n_shouts", "n_words") > 0.3),
    Rule("few_letters", False, lambda: _share("n_letters", "word_chars") < 0.6),
    Rule("digits", False, lambda: _share("n_digits", "word_chars") > 0.3),
    Rule("full_lines", True, lambda: _plain() & (F.col("n_words") >= 30) & (_share("n_ended", "n_lines") >= 0.8)),
    Rule("letters", True, lambda: _plain() & (_share("n_letters", "word_chars") >= 0.9)),
    Rule(
        "mixed_case",
        True,
        lambda: _plain()
        & (_share("n_upper", "n_letters") <= 0.15)
        & _share("word_chars", "n_words").between(3.0, 9.0),
    ),
    Rule(
        "unrepeated",
        True,
        lambda: _plain()
        & (F.col("n_words") >= 30)
        & (F.col("n_dup_lines") == 0)
        & (_share("n_repeat_words", "n_words") <= 0.05),
    ),
)
#: Accuracy a rule is taken to have before any vote is seen, and the votes that counts for.
TRUST, TRUST_SHARE = 0.8, 0.01


def vote(rule: Rule) -> Column:
    """1 good, 0 bad, 2 abstains."""
    return F.when(rule.when(), int(rule.good)).otherwise(2)


def posteriors(votes: np.ndarray, counts: np.ndarray, steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the good class for every vote pattern, and each rule's accuracy.

    A rule that does not abstain is right with its accuracy, whatever the class; when it
    abstains says nothing.  Both classes are as likely until a rule speaks.
    """
    accuracy = np.full(votes.shape[1], TRUST)
    if not len(votes):
        return np.empty(0), accuracy
    sign = np.where(votes == 1, 1.0, np.where(votes == 0, -1.0, 0.0))
    prior = TRUST_SHARE * counts.sum() + 1
    q = np.full(len(votes), 0.5)
    for _ in range(steps):
        weight = np.log(accuracy / (1 - accuracy))
        new = 1 / (1 + np.exp(-np.clip(sign @ weight, -500, 500)))
        right = np.where(sign > 0, new[:, None], 1 - new[:, None]) * (sign != 0) * counts[:, None]
        spoken = ((sign != 0) * counts[:, None]).sum(axis=0)
        accuracy = np.clip((right.sum(axis=0) + TRUST * prior) / (spoken + prior), 0.5, 0.999)
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return new, accuracy


def quality(docs: DataFrame, at_least: float = 0.5) -> DataFrame:
    """Figures of every row with ``base_failed``, ``quality`` (a probability) and ``kept``."""
    spark = docs.sparkSession
    pattern = F.concat(*[vote(r).cast("string") for r in RULES])
    seen = scratch_table(figures(docs).withColumn("pattern", pattern), "figures")
    counted = seen.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    names = [r["pattern"] for r in counted]
    votes = np.array([[int(c) for c in name] for name in names], np.int64).reshape(-1, len(RULES))
    q, _ = posteriors(votes, np.array([r["n"] for r in counted], float))
    table = spark.createDataFrame(
        [(n, float(x)) for n, x in zip(names, q, strict=True)], "pattern string, quality double"
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        seen.join(F.broadcast(table), "pattern")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("quality") >= at_least))
        .drop("pattern")
    )
