"""What several corpus operators share: document keys, size-checked joins, ASCII folding.

A *document* is identified by its ``doc_id`` together with a hash of its text, so a
repeated row is the same document and two texts that share an id stay apart.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlake.scale import scratch_dir
from flightlake.session import ship

#: Rows of a few numbers each that a join may broadcast; counted before it does.
BROADCAST_ROWS = 500_000

#: Narrow rows that one task takes without effort.
ROWS_A_TASK = 50_000

KEY = ["doc_id", "text_hash"]

__all__ = [
    "BROADCAST_ROWS", "KEY", "ascii_lower", "held_out", "join_documents", "keyed", "read_table",
    "scratch_path", "scratch_table", "ship", "small",
]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def scratch_table(df: DataFrame, name: str, codec: str = "zstd", rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back, cutting its lineage.

    ``rows``: how many narrow rows it has at most, if known; they need no more tasks
    than hold ``ROWS_A_TASK`` each.
    """
    if rows is not None and rows <= ROWS_A_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(max(1, -(-rows // ROWS_A_TASK)))
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, *cols: str) -> DataFrame:
    """``doc_id``, ``text`` and ``text_hash`` only: whatever else a table carries cannot clash."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text"),
        F.xxhash64("text").alias("text_hash"),
        *cols,
    )


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else; ``lower`` does just that to an ASCII text, faster."""
    return F.when(
        text.rlike(r"[^\x00-\x7F]"),
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase),
    ).otherwise(F.lower(text))


def small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` keep to the bound; else Spark chooses."""
    return F.broadcast(df) if rows <= bound else df


def join_documents(docs: DataFrame, facts: DataFrame, how: str = "left") -> DataFrame:
    """Join per-document facts to documents on ``KEY``; a null id equals a null id."""
    renamed = facts.withColumnsRenamed({c: f"_k_{c}" for c in KEY})
    on = [docs[c].eqNullSafe(renamed[f"_k_{c}"]) for c in KEY]
    return docs.join(renamed, on, how).drop(*[f"_k_{c}" for c in KEY])


def held_out(doc_id: Column) -> Column:
    """Documents no model learns labels from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
