"""Shards of near equal bytes by histogram sort.

Rows are ordered by (hash of the text, doc_id), so equal texts are neighbours. Candidate boundaries
are probed: each round counts the exact bytes below every probe over all partitions and narrows the
interval of each wanted splitter, until it is within tolerance or no key lies between. Then rows move
once, to the piece of the key range they belong to.

Defined cases: null texts have no bytes and are a text of their own; a null doc_id sorts first; rows
equal in text and doc_id cannot be told apart and stay together; extra columns are carried along and
may have any name; with fewer rows than shards some shards are empty.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ROW, as_struct

SPAN = 1 << 64
#: Candidate boundaries that are counted for a splitter in one round.
PROBES = 16


def _unsigned(column: pa.Array) -> np.ndarray:
    """bigint as unsigned numbers of the same order."""
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def _place(high: np.ndarray, low: np.ndarray, bounds: list[int]) -> np.ndarray:
    """How many of the sorted 128-bit ``bounds`` are at most each key (high, low)."""
    tops = np.array([b >> 64 for b in bounds], np.uint64)
    first, last = np.searchsorted(tops, high, "left"), np.searchsorted(tops, high, "right")
    tied = np.flatnonzero(first < last)
    for top in np.unique(high[tied]):
        # bounds with the high part of these rows: the low part decides
        rows = tied[high[tied] == top]
        a, b = int(first[rows[0]]), int(last[rows[0]])
        lows = np.array([x & (SPAN - 1) for x in bounds[a:b]], np.uint64)
        first[rows] = a + np.searchsorted(lows, low[rows], "right")
    return first


def _histogram(keys: DataFrame, probes: list[int]) -> dict[int, tuple[int, int]]:
    """Interval between probes -> (bytes, rows), exact, over all rows."""

    def count(parts):
        sums = np.zeros((2, len(probes) + 1), np.int64)
        for part in parts:
            at = _place(_unsigned(part.column(0)), _unsigned(part.column(1)), probes)
            np.add.at(sums[0], at, part.column(2).to_numpy(zero_copy_only=False).astype(np.int64))
            np.add.at(sums[1], at, 1)
        some = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_pydict({"i": pa.array(some, pa.int64()), "bytes": pa.array(sums[0][some]), "rows": pa.array(sums[1][some])})

    found = keys.mapInArrow(count, "i bigint, bytes bigint, rows bigint").groupBy("i").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    return {r["i"]: (r["bytes"], r["rows"]) for r in found.collect()}


def splitters(keys: DataFrame, total: int, wanted: int, tolerance: float, max_rounds: int = 40) -> list[int]:
    """``wanted`` - 1 boundaries (128-bit keys) that cut ``keys(high, low, size)`` into near equal bytes.

    A boundary is settled when the bytes below it are within ``tolerance`` of a part's size of the
    target, or when at most one row or one key is left in its interval.
    """
    targets = [total * (i + 1) / wanted for i in range(wanted - 1)]
    slack = tolerance * total / wanted
    low = [(0, 0, 0)] * len(targets)  # (key, bytes and rows below it)
    high = [(SPAN * SPAN, total, SPAN)] * len(targets)
    settled: list[int | None] = [None] * len(targets)
    for _ in range(max_rounds):
        asked: dict[int, list[int]] = {}
        for i, done in enumerate(settled):
            if done is None:
                a, b = low[i][0], high[i][0]
                # boundaries between texts first (a multiple of SPAN cuts no group of equal texts)
                unit = SPAN if b - a > SPAN else 1
                lo, hi = a // unit, -(-b // unit)
                steps = {lo + (hi - lo) * k // (PROBES + 1) for k in range(1, PROBES + 1)}
                asked[i] = sorted(s * unit for s in steps if a < s * unit < b)
        probes = sorted({p for ps in asked.values() for p in ps})
        if not probes:
            break
        hist = _histogram(keys, probes)
        below, so_far, rows = {}, 0, 0
        for k, p in enumerate(probes):
            size, n = hist.get(k, (0, 0))
            so_far, rows = so_far + size, rows + n
            below[p] = (so_far, rows)
        for i in asked:
            first, last = bisect_left(probes, low[i][0] + 1), bisect_left(probes, high[i][0])
            for p in probes[first:last]:
                if below[p][0] <= targets[i]:
                    low[i] = max(low[i], (p, *below[p]))
                else:
                    high[i] = min(high[i], (p, *below[p]))
            near = min((low[i], high[i]), key=lambda x: (abs(x[1] - targets[i]), x[0]))
            if abs(near[1] - targets[i]) <= slack or high[i][0] - low[i][0] <= 1 or high[i][2] - low[i][2] <= 1:
                settled[i] = near[0]
        if None not in settled:
            break
    return sorted(min((low[i], high[i]), key=lambda x: abs(x[1] - targets[i]))[0] if s is None else s for i, s in enumerate(settled))


def shard(docs: DataFrame, n_shards: int = 40, extra: int = 16, tolerance: float = 0.005, piece_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` as ``_whole_row`` with size, shard and slot; each row is moved once.

    Size is the text's UTF-8 bytes plus ``extra``. A shard may be any part of a huge table: it is
    cut into pieces of about ``piece_bytes``, one task each, and a row's slot is the number of rows
    in the shard's earlier pieces plus its place in its own piece.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + extra
    hashed = F.when(F.col("text").isNull(), F.lit(-1)).otherwise(F.xxhash64("text"))
    least = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    keys = cut_lineage(docs.select(hashed.alias("high"), least.alias("low"), size.alias("size")))
    total = keys.agg(F.sum("size")).first()[0] or 0
    per_shard = max(2, -(-total // (n_shards * piece_bytes)))
    cuts = splitters(keys, total, n_shards, tolerance) if total else []
    # pieces need not be equal: even steps of the key range inside each shard
    edges = [0, *cuts, SPAN * SPAN]
    fine = [a + (b - a) * k // per_shard for a, b in zip(edges, edges[1:], strict=False) for k in range(per_shard)][1:]
    counts = _histogram(keys, fine) if total else {}
    before, so_far = [], 0
    for piece in range(n_shards * per_shard):
        so_far = 0 if piece % per_shard == 0 else so_far
        before.append(so_far)
        so_far += counts.get(piece, (0, 0))[1]

    @F.arrow_udf("int")
    def piece_of(highs: pa.Array, lows: pa.Array) -> pa.Array:
        return pa.array(_place(_unsigned(highs), _unsigned(lows), fine).astype(np.int32) if fine else np.zeros(len(highs), np.int32))

    rows = docs.select(as_struct(docs), hashed.alias("high"), least.alias("low"), size.alias("size"))
    rows = rows.withColumn("piece", piece_of("high", "low"))
    rows = rows.repartitionById(max(1, n_shards * per_shard), F.col("piece")).sortWithinPartitions("piece", "high", "low")

    @F.arrow_udf("bigint")
    def slot_of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        last, n = None, 0
        for part in parts:
            # the rows of a piece follow each other
            values = part.to_numpy(zero_copy_only=False)
            out = np.empty(len(values), np.int64)
            for i, p in enumerate(values.tolist()):
                n = n + 1 if p == last else 0
                last = p
                out[i] = before[p] + n
            yield pa.array(out)

    return rows.select(
        ROW, "size", F.floor(F.col("piece") / per_shard).cast("int").alias("shard"),
        slot_of(F.col("piece")).alias("slot"),
    )


def report(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    placed = shard(docs, n_shards)
    return placed.select(
        F.col(f"{ROW}.doc_id").alias("doc_id"), "size", F.crc32(F.coalesce(F.col(f"{ROW}.text"), F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
