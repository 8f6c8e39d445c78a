"""Words of Arrow batches of texts, hashed with numpy without making a Python string each.

Texts are handled as the UTF-8 bytes Arrow already holds.  Words are what stands between
ASCII white space, A-Z folded to lower case.  A text of any length is worked through in
slices, so beside the text itself memory holds some numbers per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes hashed in one go.
SLICE = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
AS_IS = np.arange(256, dtype=np.uint8)
#: Bytes that are no part of a letter: all of ASCII but A-Z and a-z.
NO_LETTERS = np.arange(256) < 128
NO_LETTERS[ord("A") : ord("Z") + 1] = False
NO_LETTERS[ord("a") : ord("z") + 1] = False

_powers: dict[str, np.ndarray] = {}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.empty(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def portions(bounds: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, a longer row by itself."""
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = min(rows, max(first + 1, last))
        yield first, last
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, SLICE), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers[name][:n]


def spans(data: np.ndarray, bounds: np.ndarray, between: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word; a word never crosses a row's border."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~between[data]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = before
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hash of every span of bytes, lower-cased unless ``fold`` says otherwise."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + SLICE, "right")))
        base, stop = int(starts[a]), int(ends[b - 1])
        low = fold[data[base:stop]].astype(np.uint64)
        low += np.uint64(1)
        low *= _power("up", _BASE, stop - base)
        sums = np.zeros(stop - base + 1, np.uint64)
        np.cumsum(low, out=sums[1:])
        s, e = starts[a:b] - base, ends[a:b] - base
        out[a:b] = mixed((sums[e] - sums[s]) * _power("down", _INVERSE, stop - base)[s] + (e - s).astype(np.uint64))
        a = b
    return out


def word_hashes(
    data: np.ndarray, bounds: np.ndarray, between: np.ndarray = SPACES, fold: np.ndarray = LOWER
) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and where each row's words begin."""
    starts, ends = spans(data, bounds, between)
    return hashes(data, starts, ends, fold), np.searchsorted(starts, bounds)


def windows(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``k`` words and where each row's begin; fewer words are one window."""
    n = np.diff(bounds)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate(([0], np.cumsum(counts)))
    row = np.repeat(np.arange(len(n)), counts)
    first = bounds[:-1][row] + (np.arange(at[-1]) - at[:-1][row])
    out = words[first]
    for j in range(1, k):
        inside = first + j < bounds[1:][row]
        value = words[np.where(inside, first + j, 0)]
        out = np.where(inside, mixed(out * np.uint64(3) + value), out)
    return out, at


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted, without repeats."""
    values = values.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[bounds[:-1][np.diff(bounds) > 0]] = True
    return values[fresh], np.concatenate(([0], np.cumsum(fresh)))[bounds]


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each row's values, 0 for a row without; rows of a matrix are summed column by column."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0)
    return out
