"""Collocations: phrases whose words stand together more often than their parts tell.

Every word of a piece begins a suffix of at most four words.  Suffixes are routed by their
leading words, so that whatever begins with the same words meets in one *bucket*; there
pointers to them are sorted by multikey three-way quicksort.  A partition of equal keys is
a phrase and its size the phrase's count; a partition too small to hold a phrase that is
often enough is abandoned, which is final, as no other bucket holds more of it.

Two passes over the texts.  The first counts words, and pairs and triples by *slots* (hashes
of their leading words).  The second routes suffixes by two words; those of a slot that is
too much for a bucket by three, and if need be by four.  What is routed deeper is counted
for its shorter beginnings too, without abandoning any, and summed over buckets.  Equal
suffixes routed deeper are merged before they are sent.  Words that are too rare to stand
in a phrase end their piece; they are told by a bit array of fixed size, which may let rare
ones pass but holds every frequent one.

A partition is sorted level by level: one step cuts every open partition at once, with
arrays, so memory is some numbers per suffix of a bucket, and buckets are of bounded size.

Words are numbered by a 64-bit hash.  Should two words of one language share one, the run
stops and says so, rather than counting them as one word.

Defined results: null text is empty and has no word; a null language is ``und``; a text
without a frequent phrase adds to ``n`` only; rows that repeat are counted each; a phrase
does not go beyond its piece, however long the text; equal scores go by count, then by the
phrase's bytes; an empty table gives no rows.  Columns beside lang and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightlake.llm import words
from flightlake.llm.common import scratch_table, ship, small

#: What ends a piece, and what else stands between words.
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
WORD_GAPS = " \t"
#: Words a phrase has at most.
DEPTH = 4
#: Suffixes a bucket is meant for; a slot that holds more is routed by more words.
TARGET = 1 << 20
#: Slots of leading words.  A slot should stay far below ``TARGET``: more words, more slots.
SLOTS = 1 << 16
CHUNK = 1 << 12
#: Bits that tell frequent words; a multiple of the 32 768 of one bitmap.
BITS = 1 << 22
BITMAP = 1 << 15
#: Distinct words, and suffixes, a task gathers before it sends them on.
GATHERED = 1 << 18
#: Scores are whole numbers of this part.
SCALE = 2_000_000

_SURVEY = "kind int, lang string, number long, n long, word string, counts binary"
_ROUTED = "bucket int, lang string, route int, suffixes binary, weights binary"
_FOUND = "lang string, words array<long>, n long"
_WHOLE = "decimal(38,0)"

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in PIECE_ENDS]] = True
_BETWEEN = _ENDS.copy()
_BETWEEN[[ord(c) for c in WORD_GAPS]] = True


def _lang_number(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


class _Text:
    """The words of some rows: hash, language, and which piece each stands in."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, codes: np.ndarray, langs: list[str]):
        self.data, self.langs = data, langs
        self.starts, self.ends = words.spans(data, bounds, _BETWEEN)
        self.hashes = words.hashes(data, self.starts, self.ends)
        self.hashes[self.hashes == 0] = 1  # 0 stands for no word
        row = np.searchsorted(bounds, self.starts, "right") - 1
        self.codes = codes[row]
        self.pieces = np.searchsorted(np.flatnonzero(_ENDS[data]), self.starts) + row

    def suffixes(self, usable: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes of two words or more, 0 where a piece has ended, and their languages."""
        n = len(self.hashes)
        out = np.zeros((n, DEPTH), np.uint64)
        out[:, 0] = self.hashes
        going = np.ones(n, bool) if usable is None else usable.copy()
        for j in range(1, DEPTH):
            there = np.zeros(n, bool)
            if n > j:
                there[:-j] = self.pieces[j:] == self.pieces[:-j]
                if usable is not None:
                    there[:-j] &= usable[j:]
            going &= there
            at = np.flatnonzero(going)
            out[at, j] = self.hashes[at + j]
        kept = out[:, 1] != 0
        return out[kept], self.codes[kept]

    def word(self, i: int) -> str:
        return words.LOWER[self.data[self.starts[i] : self.ends[i]]].tobytes().decode()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[_Text]:
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch["lang"].dictionary_encode()
        langs, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        data, bounds = words.utf8(batch["text"])
        for a, b in words.portions(bounds):
            yield _Text(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], codes[a:b], langs)


def _leading(suffixes: np.ndarray, codes: np.ndarray, langs: list[str], depth: int) -> np.ndarray:
    """A hash of the language and the first ``depth`` words of every suffix."""
    numbers = np.array([_lang_number(x) for x in langs], np.uint64)
    out = numbers[codes]
    for j in range(depth):
        out = words.mixed(out * np.uint64(3) + suffixes[:, j])
    return out


def _survey(slots: int) -> Callable:
    """Counts of words, and of leading pairs and triples by slot."""

    def told(found: dict[str, dict[int, list]]) -> pa.RecordBatch:
        rows = [(lang, h, n, word) for lang, held in found.items() for h, (n, word) in held.items()]
        lang, number, n, word = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([1] * len(rows), pa.int32()),
                pa.array(lang, pa.string()),
                pa.array(np.array(number, np.uint64).view(np.int64)),
                pa.array(n, pa.int64()),
                pa.array(word, pa.string()),
                pa.nulls(len(rows), pa.binary()),
            ],
            ["kind", "lang", "number", "n", "word", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, dict[int, list]] = {}
        held = {depth: np.zeros(slots, np.int64) for depth in (2, 3)}
        for text in _texts(batches):
            for code in np.unique(text.codes).tolist():
                of_lang = np.flatnonzero(text.codes == code)
                distinct, first, n = np.unique(text.hashes[of_lang], return_index=True, return_counts=True)
                known = found.setdefault(text.langs[code], {})
                for h, at, count in zip(distinct.tolist(), of_lang[first].tolist(), n.tolist(), strict=True):
                    entry = known.get(h)
                    if entry is None:
                        known[h] = [count, text.word(at)]
                    else:
                        entry[0] += count
            suffixes, codes = text.suffixes()
            for depth, total in held.items():
                longer = suffixes[:, depth - 1] != 0
                slot = _leading(suffixes[longer], codes[longer], text.langs, depth) % np.uint64(slots)
                total += np.bincount(slot.astype(np.int64), minlength=slots)
            if sum(map(len, found.values())) > GATHERED:
                yield told(found)
                found = {}
        yield told(found)
        for depth, total in held.items():
            if total.any():
                parts = [total[a : a + CHUNK].tobytes() for a in range(0, slots, CHUNK)]
                none = pa.nulls(len(parts), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([depth] * len(parts), pa.int32()),
                        none,
                        pa.array(range(len(parts)), pa.int64()),
                        pa.array([int(total[a : a + CHUNK].sum()) for a in range(0, slots, CHUNK)], pa.int64()),
                        none,
                        pa.array(parts, pa.binary()),
                    ],
                    ["kind", "lang", "number", "n", "word", "counts"],
                )

    return run


def _crowded(limit: int) -> Callable:
    """Slots that hold more than ``limit`` suffixes, from the counts of all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for kind, chunk, counts in zip(*(batch[c].to_pylist() for c in ("kind", "number", "counts")), strict=True):
                counts = np.frombuffer(counts, np.int64)
                total[kind, chunk] = total[kind, chunk] + counts if (kind, chunk) in total else counts
        for (kind, chunk), counts in total.items():
            slot = np.flatnonzero(counts > limit) + chunk * CHUNK
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(slot), kind, np.int32)), pa.array(slot)], ["kind", "slot"]
            )

    return run


def _merged(suffixes: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal suffixes of a language as one, with their weights summed."""
    order = np.lexsort((*suffixes.T[::-1], codes))
    suffixes, codes, weights = suffixes[order], codes[order], weights[order]
    fresh = np.ones(len(codes), bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (suffixes[1:] != suffixes[:-1]).any(axis=1)
    first = np.flatnonzero(fresh)
    return suffixes[first], codes[first], np.add.reduceat(weights, first)


def _routed(frequent: np.ndarray, crowded: dict[int, np.ndarray], slots: int, n_buckets: int) -> Callable:
    """Suffixes of frequent words, packed by bucket, language and route."""

    def packed(suffixes: np.ndarray, codes: np.ndarray, langs: list[str]) -> pa.RecordBatch:
        route = np.full(len(codes), 2, np.int64)
        for depth, full in crowded.items():
            at = np.flatnonzero(route == depth)
            slot = _leading(suffixes[at], codes[at], langs, depth) % np.uint64(slots)
            route[at[full[slot.astype(np.int64)]]] = depth + 1
        weights = np.ones(len(codes), np.int64)
        deep = route > 2
        if deep.any():
            plain = ~deep
            parts = [(suffixes[plain], codes[plain], weights[plain], route[plain])]
            for depth in (3, 4):
                at = route == depth
                if at.any():
                    merged = _merged(suffixes[at], codes[at], weights[at])
                    parts.append((*merged, np.full(len(merged[1]), depth)))
            suffixes, codes, weights, route = (np.concatenate(x) for x in zip(*parts, strict=True))
        bucket = np.zeros(len(codes), np.int64)
        for depth in (2, 3, 4):
            at = np.flatnonzero(route == depth)
            if len(at):
                led = words.mixed(_leading(suffixes[at], codes[at], langs, depth))
                bucket[at] = (led % np.uint64(n_buckets)).astype(np.int64)
        key = (bucket * len(langs) + codes) * 8 + route
        order = np.argsort(key, kind="stable")
        key, suffixes, weights = key[order], suffixes[order], weights[order]
        cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])) if len(key) else np.zeros(1, int)
        one = key[cuts[:-1]]
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        return pa.RecordBatch.from_arrays(
            [
                pa.array((one // 8 // len(langs)).astype(np.int32)),
                pa.array([langs[c] for c in (one // 8 % len(langs)).tolist()], pa.string()),
                pa.array((one % 8).astype(np.int32)),
                pa.array([suffixes[a:b].T.tobytes() for a, b in spans], pa.binary()),
                # without weights, every suffix was met once
                pa.array([weights[a:b].tobytes() if r > 2 else None for (a, b), r in zip(spans, (one % 8).tolist(), strict=True)], pa.binary()),
            ],
            ["bucket", "lang", "route", "suffixes", "weights"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for text in _texts(batches):
            suffixes, codes = text.suffixes(frequent[(text.hashes % np.uint64(BITS)).astype(np.int64)])
            mine = np.array([langs.setdefault(x, len(langs)) for x in text.langs], np.int64)
            held.append((suffixes, mine[codes]))
            if sum(len(x) for _, x in held) > GATHERED:
                yield packed(*map(np.concatenate, zip(*held, strict=True)), list(langs))
                langs, held = {}, []
        if held:
            yield packed(*map(np.concatenate, zip(*held, strict=True)), list(langs))

    return run


def frequent_prefixes(
    suffixes: np.ndarray, weights: np.ndarray | None, least: int, route: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of pointers to ``suffixes``; equal partitions and their weights.

    Yields ``(words, pointers, counts)``, a pointer to one suffix of every phrase of so many
    words.  Phrases of ``route`` words or more are complete here, and only told from
    ``least`` on; shorter ones are told whatever they weigh.
    """
    pointers = np.arange(len(suffixes))
    bounds, depth = np.array([0, len(suffixes)]), np.zeros(1, np.int64)
    while len(pointers):
        size = np.diff(bounds)
        part = np.repeat(np.arange(len(size)), size)
        key = suffixes[pointers, depth[part]]
        # The pivot is the middle of three.
        three = np.stack([key[bounds[:-1]], key[bounds[:-1] + size // 2], key[bounds[1:] - 1]])
        pivot = np.sort(three, axis=0)[1]
        against = pivot[part]
        less, equal = key < against, key == against
        side = part * 3 + np.where(equal, 1, np.where(less, 0, 2))
        n = np.bincount(side, minlength=3 * len(size))
        weight = n if weights is None else np.bincount(side, weights[pointers], 3 * len(size)).astype(np.int64)
        # Each pointer goes behind those of its side that stand before it.
        target = np.empty(len(pointers), np.int64)
        first = np.concatenate(([0], np.cumsum(n)[:-1]))
        for s, mine in ((0, less), (1, equal), (2, ~(less | equal))):
            at = np.flatnonzero(mine)
            rank = np.arange(len(at))
            begin = np.concatenate(([0], np.cumsum(n[s::3])[:-1]))
            target[at] = first[s::3][part[at]] + rank - begin[part[at]]
        moved = np.empty_like(pointers)
        moved[target] = pointers
        words_of = np.repeat(depth, 3)
        words_of[1::3] += 1
        is_equal = np.tile([False, True, False], len(size))
        ended = is_equal & (np.repeat(pivot, 3) == 0)
        # What the next phrases counted in a partition have in words, at least.
        ahead = np.maximum(words_of + 1, 2)
        phrase = is_equal & ~ended & (words_of >= 2) & ((weight >= least) | (words_of < route))
        for length in range(2, suffixes.shape[1] + 1):
            at = np.flatnonzero(phrase & (words_of == length))
            if len(at):
                yield length, moved[first[at]], weight[at]
        kept = (n > 0) & ~ended & (words_of < suffixes.shape[1]) & ((weight >= least) | (ahead < route))
        pointers = moved[np.repeat(kept, n)]
        bounds = np.concatenate(([0], np.cumsum(n[kept])))
        depth = words_of[kept]


def _counted(least: int) -> Callable:
    """Phrases of every bucket, whose rows lie together."""

    def counted(lang: str, route: int, held: list[tuple[bytes, bytes | None]]) -> Iterator[pa.RecordBatch]:
        suffixes = np.concatenate([np.frombuffer(s, np.uint64).reshape(DEPTH, -1) for s, _ in held], axis=1).T
        suffixes = np.ascontiguousarray(suffixes)
        weights = None if route == 2 else np.concatenate([np.frombuffer(w, np.int64) for _, w in held])
        for length, at, n in frequent_prefixes(suffixes, weights, least, route):
            flat = np.ascontiguousarray(suffixes[at, :length]).view(np.int64).ravel()
            offsets = np.arange(0, len(flat) + 1, length, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(at), pa.string()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.array(n.astype(np.int64)),
                ],
                ["lang", "words", "n"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, lang, route, suffixes, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, lang, route) != now:
                    if held:
                        yield from counted(now[1], now[2], held)
                    now, held = (bucket, lang, route), []
                held.append((suffixes, weights))
        if held:
            yield from counted(now[1], now[2], held)

    return run


def phrase_counts(docs: DataFrame, least: int = 30, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """``(lang, number, word, n)`` of all words, and ``(lang, words, n)`` of frequent phrases."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )
    survey = scratch_table(texts.mapInArrow(_survey(slots), _SURVEY), "survey")
    spelled = scratch_table(
        survey.where("kind = 1")
        .groupBy("lang", "number")
        .agg(F.sum("n").alias("n"), F.min("word").alias("word"), F.max("word").alias("other")),
        "words",
    )
    if clash := spelled.where("word <> other").first():
        raise ValueError(f"{clash['word']!r} and {clash['other']!r} share a hash in {clash['lang']!r}")
    often = spelled.where(F.col("n") >= least)
    bit = F.col("number").bitwiseAND(BITS - 1) + 1
    maps = (
        often.groupBy(F.bitmap_bucket_number(bit).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
        .collect()
    )
    frequent = np.zeros(BITS, bool)
    for row in maps:
        held = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
        frequent[(row["bucket"] - 1) * BITMAP : row["bucket"] * BITMAP] = held.astype(bool)
    by_slot = survey.where("kind > 1").select("kind", "number", "counts", "n")
    full = by_slot.repartition("kind", "number").mapInArrow(_crowded(TARGET), "kind int, slot long").collect()
    crowded = {depth: np.zeros(slots, bool) for depth in (2, 3)}
    for row in full:
        crowded[row["kind"]][row["slot"]] = True
    pairs = by_slot.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // TARGET))
    routed = texts.mapInArrow(_routed(frequent, crowded, slots, n_buckets), _ROUTED)
    together = routed.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "lang", "route")
    found = together.mapInArrow(_counted(least), _FOUND)
    phrases = found.groupBy("lang", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return spelled.drop("other"), scratch_table(phrases, "phrases")


def _parts(phrase: Column) -> Column:
    """Both parts of every cut of a phrase."""
    cuts = F.sequence(F.lit(1), F.size(phrase) - 1)
    part = lambda k, first, name: F.struct(
        k.alias("k"),
        F.lit(name).alias("side"),
        (F.slice(phrase, 1, k) if first else F.slice(phrase, k + 1, F.size(phrase) - k)).alias("part"),
    )
    return F.flatten(F.transform(cuts, lambda k: F.array(part(k, True, "l"), part(k, False, "r"))))


def _inner(phrase: Column) -> Column:
    """All shorter phrases of two words or more inside a longer one."""
    sizes = F.sequence(F.lit(2), F.size(phrase) - 1)
    return F.flatten(
        F.transform(
            sizes,
            lambda n: F.transform(F.sequence(F.lit(1), F.size(phrase) - n + 1), lambda at: F.slice(phrase, at, n)),
        )
    )


def scored(often: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(lang, words, a, l, r, score)`` of every phrase, by its lowest-scoring cut."""
    counts = scratch_table(
        often.select("lang", F.array("number").alias("part"), F.col("n").alias("f")).union(phrases), "parts"
    )
    cut = phrases.select("lang", "words", F.col("n").alias("a"), F.explode(_parts(F.col("words"))).alias("cut"))
    cut = cut.select("lang", "words", "a", "cut.*").join(small(counts, counts.count()), ["lang", "part"])
    both = cut.groupBy("lang", "words", "a", "k").agg(
        F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r")
    )
    product = F.lit(SCALE).cast("decimal(7,0)") * F.col("a").cast("decimal(19,0)")
    score = F.call_function("div", product.cast(_WHOLE), (F.col("l").cast("decimal(20,0)") + F.col("r")).cast(_WHOLE))
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low")
    return both.groupBy("lang", "words", "a").agg(lowest).select("lang", "words", "a", "low.score", "low.l", "low.r")


def outermost(found: DataFrame, phrases: DataFrame, percent: int) -> DataFrame:
    """Phrases that no longer one holds nearly as often as they are met at all."""
    longer = phrases.where(F.size("words") > 2).select("lang", "n", F.explode(_inner(F.col("words"))).alias("words"))
    most = longer.groupBy("lang", "words").agg(F.max("n").alias("most"))
    inside = F.col("most").cast(_WHOLE) * 100 >= F.col("a").cast(_WHOLE) * percent
    return found.join(most, ["lang", "words"], "left").where(~F.coalesce(inside, F.lit(False))).drop("most")


def collocations(
    docs: DataFrame, least: int = 30, first: int = 2000, percent: int = 80, slots: int = SLOTS
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``first`` phrases."""
    spelled, phrases = phrase_counts(docs, least, slots)
    often = scratch_table(spelled.where(F.col("n") >= least).select("lang", "number", "word", "n"), "often")
    found = outermost(scored(often, phrases), phrases, percent)
    by_score = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    leading = found.withColumn("place", F.rank().over(by_score)).where(F.col("place") <= first).drop("place")
    leading = scratch_table(leading, "leading")
    spoken = leading.select("*", F.posexplode("words").alias("at", "number"))
    named = spoken.join(small(often, often.count()).select("lang", "number", "word"), ["lang", "number"])
    whole = named.groupBy("lang", "words", "a", "l", "r", "score").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")
    )
    sizes = scratch_table(spelled.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    in_order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    return (
        whole.withColumn("rank", F.row_number().over(in_order).cast("long"))
        .where(F.col("rank") <= first)
        .join(small(sizes, sizes.count()), "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )


ORACLE = r"""
WITH p AS (SELECT row_number() OVER () AS i, lang, unnest(pieces) AS piece FROM
  (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(
     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda s: array_to_string(w[s:s + k - 1], ' '))) AS g
          FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY 1, 2, 3),
size AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, g, string_split(g, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 30),
cut AS (SELECT lang, k, g, w, a, unnest(range(1, k)) AS h FROM c),
s AS (SELECT cut.lang, cut.k, cut.g, cut.w, cut.a, h, x.f AS l, y.f AS r,
             ((2000000::HUGEINT * cut.a) // (x.f + y.f))::BIGINT AS score FROM cut
      JOIN f x ON x.lang = cut.lang AND x.k = h AND x.g = array_to_string(cut.w[1:h], ' ')
      JOIN f y ON y.lang = cut.lang AND y.k = cut.k - h AND y.g = array_to_string(cut.w[h + 1:cut.k], ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, h) = 1),
inner_ AS (SELECT lang, a, array_to_string(w[b:b + n - 1], ' ') AS g FROM
           (SELECT lang, w, a, k, n, unnest(range(1, k - n + 2)) AS b FROM (SELECT *, unnest(range(2, k)) AS n FROM c WHERE k > 2))),
most AS (SELECT lang, g, max(a) AS most FROM inner_ GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN most ON most.lang = best.lang AND most.g = best.g WHERE most IS NULL OR 100 * most < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank FROM kept)
SELECT r.lang, rank, g AS phrase, a, l, r, n, score FROM ranked r JOIN size ON size.lang = r.lang WHERE rank <= 2000
"""
