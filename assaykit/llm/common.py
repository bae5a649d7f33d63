"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

ROW = "_whole_row"


#: Bytes of one Arrow batch between the JVM and a Python worker; both sides hold several at a time.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Rows of long texts go to Python in batches of bounded size, whatever their number."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_struct(df: DataFrame, name: str = ROW):
    """All columns of ``df`` in one struct, so that helper columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def texts_of(array: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null gives the empty text."""
    return [x or "" for x in array.to_pylist()]


_CACHE: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What an operator keeps in a Python worker from task to task. One owner at a time: an operator
    that runs later in the same worker takes the memory over."""
    if owner not in _CACHE:
        _CACHE.clear()
        release_memory()
        _CACHE[owner] = {}
    return _CACHE[owner]


def release_memory() -> None:
    """Gives freed memory back to the system, which allocators otherwise keep for the same process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only the GNU C library has this
        ctypes.CDLL(None).malloc_trim(0)


def signed(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit numbers as the bigint with the same bits."""
    return pa.array(np.ascontiguousarray(values, dtype=np.uint64).view(np.int64))


def batches(rows: Iterable, size: int):
    """Lists of at most ``size`` consecutive items."""
    block = []
    for row in rows:
        block.append(row)
        if len(block) >= size:
            yield block
            block = []
    if block:
        yield block


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``edges(a, b)``; the component is its smallest node.

    Alternating large-star and small-star rounds on distributed edge tables: each node links its
    neighbours to the smallest one it knows, until nothing changes. Minima are combined before the
    shuffle, and a node with very many neighbours is split by the adaptive join. Each round is
    written to the shared folder, so a lost executor costs one round.
    """
    current = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # an edge points from the larger to the smaller node now
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").distinct()
        )
        current = cut_lineage(small)
        after = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            own = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


#: CRC-32 (reflected, polynomial 0xEDB88320) as a table of 256 numbers, and of a text ``s``.
CRC_TABLE = """SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
  lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t"""


def crc_sql(s: str) -> str:
    """CRC-32 of the UTF-8 text expression ``s``; the table is column t."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen({s})), lambda i: ('0x' || substr(hex(encode({s})), 2 * i::INTEGER + 1, 2))::BIGINT)),
  lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295::BIGINT)"""
