"""Token ids in files: canonical Huffman codes of bounded length, decoded block by block.

``write_tokens`` encodes every text once, counts ids over all documents, and gives each
id a canonical code of at most ``max_bits`` bits (package-merge, so the best under that
bound).  A block is up to ``BLOCK`` ids of one document with the bit offset of every
``CHECKPOINT``-th id, so any block, and any stretch of one, is decoded by itself with a
table look-up per id.  Blocks are rows of Parquet files in ascending ``doc_id`` order,
written by Spark's committer; beside them lie the code lengths, which fix the code.

Defined results: null or empty text is its end id alone; a null id sorts first; rows that
repeat an id are kept apart by their place in the input; of ids as frequent the smaller has
the shorter code or an equal one; a text of any length is encoded whole, over as many blocks
as it needs; an empty table gives no rows and files without blocks; other columns are not
looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightlake.llm import words
from flightlake.llm.common import scratch_path, scratch_table, ship
from flightlake.llm.tokens import encoder, vocabulary_path

BLOCK, CHECKPOINT = 16_384, 256
#: Ids coded, and decoded, at once: what is coded should stay near the processor.
CODED, DECODED = 1 << 16, 1 << 19
#: Bytes of stretches a worker remembers here, where encoding has the worker to itself.
REMEMBERED = 160 << 20
BLOCK_SCHEMA = "doc_id long, row_no long, block int, n_ids int, checkpoints array<int>, bits binary"


def _encode(path: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, REMEMBERED)
        for batch in batches:
            for a, b in words.portions(words.utf8(batch["text"])[1]):
                part = batch.slice(a, b - a)
                ids = [
                    np.append(x, np.uint32(end_id)).astype("<u4").tobytes()
                    for x in encode(part["text"].to_pylist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["row_no"], pa.array([_narrow(x) for x in ids], pa.binary())],
                    ["doc_id", "row_no", "ids"],
                )

    return run


def _narrow(ids: bytes) -> bytes:
    """Two bytes an id where all fit, marked by an odd length."""
    wide = np.frombuffer(ids, "<u4")
    return wide.astype("<u2").tobytes() + b"\0" if len(wide) and wide.max() < 65536 else ids


def _wide(held: bytes) -> np.ndarray:
    return np.frombuffer(held[:-1], "<u2").astype("<u4") if len(held) % 2 else np.frombuffer(held, "<u4")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each id occurs in the partition."""
    total = np.zeros(1, np.int64)
    for batch in batches:
        held = batch["ids"].to_pylist()
        for a in range(0, len(held), 500):
            n = np.bincount(np.concatenate([_wide(x) for x in held[a : a + 500]]), minlength=len(total))
            n[: len(total)] += total
            total = n
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Bits of each symbol's code, none above ``max_bits``, by package-merge."""
    n = len(counts)
    if n == 1:
        return np.ones(1, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order]
    level, made = leaves, []
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate((leaves, pairs))
        rank = np.argsort(merged, kind="stable")
        made.append(rank < n)
        level = merged[rank]
    take, bits = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(made):
        used = int(is_leaf[:take].sum())
        bits[:used] += 1
        take = 2 * (take - used)
    bits[:take] += 1
    out = np.empty(n, np.int64)
    out[order] = bits
    return out


class Code:
    """Canonical codes from ``(ids, bits)``, and the table that undoes them."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = ids[order].astype(np.uint32), bits[order].astype(np.int64)
        self.most = int(self.bits[-1]) if len(bits) else 1
        step = np.int64(1) << (self.most - self.bits)
        first = np.concatenate(([0], np.cumsum(step)[:-1])).astype(np.int64)
        self.codes = (first >> (self.most - self.bits)).astype(np.uint32)
        self._first, self._step = first, step

    def encoding(self) -> tuple[np.ndarray, np.ndarray]:
        size = int(self.ids.max()) + 1 if len(self.ids) else 1
        codes, bits = np.zeros(size, np.uint32), np.zeros(size, np.int64)
        codes[self.ids], bits[self.ids] = self.codes, self.bits
        return codes, bits

    def decoding(self) -> tuple[np.ndarray, np.ndarray]:
        symbols, bits = np.zeros(1 << self.most, np.uint32), np.ones(1 << self.most, np.uint8)
        used = int(self._step.sum())
        symbols[:used] = np.repeat(self.ids, self._step)
        bits[:used] = np.repeat(self.bits, self._step).astype(np.uint8)
        return symbols, bits


def pack_bits(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, bits: np.ndarray) -> tuple:
    """Bytes of consecutive blocks, each begun at a byte; their bounds and the ids' bit offsets."""
    n = bits[ids]
    ends = np.cumsum(n)
    block_ends = np.cumsum(sizes)
    begins = np.concatenate(([0], ends))[np.concatenate(([0], block_ends[:-1]))]
    in_block = np.concatenate((begins[1:], ends[-1:])) - begins
    bounds = np.concatenate(([0], np.cumsum((in_block + 7) // 8)))
    within = ends - n - np.repeat(begins, sizes)
    at = within + np.repeat(bounds[:-1] * 8, sizes)
    shifted = codes[ids].astype(np.int64) << (32 - (at & 7) - n)
    out = np.zeros(int(bounds[-1]) + 4)
    for lane in range(4):
        value = (shifted >> (24 - 8 * lane)) & 255
        out += np.bincount((at >> 3) + lane, weights=value, minlength=len(out))
    return out[: int(bounds[-1])].astype(np.uint8), bounds, within


def unpack_bits(data: np.ndarray, at: np.ndarray, counts: np.ndarray, code: tuple, most: int) -> np.ndarray:
    """The ids of stretches of bits, all stretches a step at a time; longer stretches first."""
    symbols, bits = code
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint32)
    word = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    order = np.argsort(-counts, kind="stable")
    at, left = at[order].copy(), counts[order]
    begin = (np.cumsum(counts) - counts)[order]
    out = np.empty(int(counts.sum()), np.uint32)
    mask = np.uint32((1 << most) - 1)
    active = len(left)
    for step in range(int(left[0]) if len(left) else 0):
        active = int(np.searchsorted(-left[:active], -step, "left"))
        pos = at[:active]
        index = (word[pos >> 3] >> (32 - most - (pos & 7)).astype(np.uint32)) & mask
        out[begin[:active] + step] = symbols[index]
        pos += bits[index]
    return out


def _write(ids: np.ndarray, bits: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lengths = Code(ids, bits).encoding()
        for batch in batches:
            rows, held = [], 0
            docs, numbers = batch["doc_id"].to_pylist(), batch["row_no"].to_pylist()
            for doc, number, raw in zip(docs, numbers, batch["ids"].to_pylist(), strict=True):
                wide = _wide(raw)
                for block, a in enumerate(range(0, len(wide), BLOCK)):
                    rows.append((doc, number, block, wide[a : a + BLOCK]))
                    held += len(rows[-1][3])
                    if held >= CODED:
                        yield blocks(rows, codes, lengths)
                        rows, held = [], 0
            if rows:
                yield blocks(rows, codes, lengths)

    def blocks(rows: list, codes: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        sizes = np.array([len(r[3]) for r in rows], np.int64)
        data, bounds, within = pack_bits(np.concatenate([r[3] for r in rows]), sizes, codes, lengths)
        first = np.cumsum(sizes) - sizes
        marks = [within[a : a + n : CHECKPOINT].astype(np.int32) for a, n in zip(first, sizes, strict=True)]
        held = data.tobytes()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int32()),
                pa.array(sizes.astype(np.int32)),
                pa.array(marks, pa.list_(pa.int32())),
                pa.array([held[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
            ],
            ["doc_id", "row_no", "block", "n_ids", "checkpoints", "bits"],
        )

    return run


def write_tokens(
    docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, max_bits: int = 18
) -> None:
    """Write ``folder/blocks`` and ``folder/codebook``, files in ascending ``doc_id`` order."""
    spark = docs.sparkSession
    ship(spark)
    numbered = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), "text"
    )
    encoded = scratch_table(
        numbered.mapInArrow(_encode(path or vocabulary_path(), end_id), "doc_id long, row_no long, ids binary"),
        "ids",
    )
    counts = encoded.select("ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # At most one row per id of the vocabulary.
    table = counts.orderBy("id").toArrow()
    ids, n = table["id"].to_numpy(), table["n"].to_numpy()
    bits = code_lengths(n, max(max_bits, len(ids).bit_length())) if len(ids) else np.empty(0, np.int64)
    spark.createDataFrame(
        [(int(i), int(b)) for i, b in zip(ids, bits, strict=True)], "id long, bits int"
    ).coalesce(1).write.parquet(f"{folder}/codebook")
    # Ids are put in order before they are coded: to sample where ranges begin runs all that
    # comes before it, and so would code every id twice.
    (
        encoded.repartitionByRange("doc_id", "row_no")
        .sortWithinPartitions("doc_id", "row_no")
        .mapInArrow(_write(ids, bits), BLOCK_SCHEMA)
        .withColumn("part", F.spark_partition_id())
        .write.option("compression", "none")
        .parquet(f"{folder}/blocks")
    )


def _read(ids: np.ndarray, bits: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]:
    """Decoded ids of batches of blocks: ``(batch, ids, bounds)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        code = Code(ids, bits)
        table = code.decoding()
        for batch in batches:
            sizes = batch["n_ids"].to_numpy().astype(np.int64)
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            for a, b in words.portions(bounds, DECODED):
                part, n = batch.slice(a, b - a), sizes[a:b]
                held = [np.frombuffer(x, np.uint8) for x in part["bits"].to_pylist()]
                begin = np.concatenate(([0], np.cumsum([len(x) for x in held])))[:-1] * 8
                lanes = (n + CHECKPOINT - 1) // CHECKPOINT
                marks = part["checkpoints"].flatten().to_numpy().astype(np.int64)
                counts = np.full(len(marks), CHECKPOINT, np.int64)
                counts[np.cumsum(lanes) - 1] = n - (lanes - 1) * CHECKPOINT
                out = unpack_bits(np.concatenate(held), marks + np.repeat(begin, lanes), counts, table, code.most)
                yield part, out, np.concatenate(([0], np.cumsum(n)))

    return run


def _codebook(folder: str, spark) -> tuple[np.ndarray, np.ndarray]:
    table = spark.read.schema("id long, bits int").parquet(f"{folder}/codebook").toArrow()
    return table["id"].to_numpy(), table["bits"].to_numpy().astype(np.int64)


def read_tokens(spark, folder: str) -> DataFrame:
    """``(doc_id, row_no, block, ids)`` of the files."""
    decode = _read(*_codebook(folder, spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, out, bounds in decode(batches):
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(out.astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["row_no"], part["block"], lists], ["doc_id", "row_no", "block", "ids"]
            )

    blocks = spark.read.schema(f"{BLOCK_SCHEMA}, part int").parquet(f"{folder}/blocks")
    return blocks.mapInArrow(run, "doc_id long, row_no long, block int, ids array<long>")


def _sums(decode: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, out, bounds in decode(batches):
            held = out.astype("<u4").tobytes()
            crc = [zlib.crc32(held[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part["part"], part["doc_id"], part["row_no"], part["block"], pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                ["part", "doc_id", "row_no", "block", "n", "crc"],
            )

    return run


def _times(matrix: list[int], vector: int) -> int:
    total, i = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[i]
        vector >>= 1
        i += 1
    return total


def crc_joined(first: int, second: int, n_bytes: int) -> int:
    """crc32 of two stretches after one another, from their own and the second's length."""
    # The matrix that carries a crc over one zero bit, squared for every bit of the length.
    matrix = [0xEDB88320] + [1 << i for i in range(31)]
    n = n_bytes * 8
    while n:
        if n & 1:
            first = _times(matrix, first)
        matrix = [_times(matrix, row) for row in matrix]
        n >>= 1
    return first ^ second


def _whole_crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = []
        for blocks in batch["blocks"].to_pylist():
            crc = blocks[0]["crc"]
            for block in blocks[1:]:
                crc = crc_joined(crc, block["crc"], 4 * block["n"])
            crcs.append(crc)
        yield pa.RecordBatch.from_arrays(
            [batch["part"], batch["doc_id"], batch["row_no"], batch["n_tokens"], pa.array(crcs, pa.int64())],
            ["part", "doc_id", "row_no", "n_tokens", "ids_crc32"],
        )


def token_index(spark, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files alone."""
    blocks = spark.read.schema(f"{BLOCK_SCHEMA}, part int").parquet(f"{folder}/blocks")
    sums = blocks.mapInArrow(
        _sums(_read(*_codebook(folder, spark))), "part int, doc_id long, row_no long, block int, n long, crc long"
    )
    documents = scratch_table(
        sums.groupBy("row_no")
        .agg(
            F.min("part").alias("part"),
            F.first("doc_id").alias("doc_id"),
            F.sum("n").alias("n_tokens"),
            F.sort_array(F.collect_list(F.struct("block", "n", "crc"))).alias("blocks"),
        )
        .mapInArrow(_whole_crc, "part int, doc_id long, row_no long, n_tokens long, ids_crc32 long"),
        "token-index",
    )
    # One row per file: the ids in files before it.
    files = documents.groupBy("part").agg(F.sum("n_tokens").alias("in_file"))
    before = F.coalesce(
        F.sum("in_file").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    upto = F.sum("n_tokens").over(
        Window.partitionBy("part").orderBy("doc_id", "row_no").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        documents.join(F.broadcast(files.select("part", before.alias("before"))), "part")
        .select("doc_id", (F.col("before") + upto - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
    )


def token_files(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the ids of ``docs`` and return the index read back from the files."""
    folder = scratch_path(docs.sparkSession, "token-files")
    write_tokens(docs, folder, path, end_id)
    return token_index(docs.sparkSession, folder)
