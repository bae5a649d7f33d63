"""Ordered computations that never put an unbounded group into one task.

A plain ``Window.partitionBy(key).orderBy(...)`` sends all rows of a key to one task; without a
key, all rows. Here the order is first cut into chunks of bounded size, each chunk is summarised,
the few chunk summaries are folded into carries, and the window runs inside a chunk only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_CHUNK = 2_000_000
MAX_CHUNKS = 4096
#: Rows that one task ranks where the order is a hash.
ROWS_PER_TASK = 50_000
#: Counts that one task of ``exact_quantiles`` holds, and the bits that its passes look at.
MAX_COUNTERS = 4_000_000
_DIGITS = (16, 11, 11, 11, 11, 4)


def with_chunk(
    df: DataFrame, order: str, rows_per_chunk: int = ROWS_PER_CHUNK, max_chunks: int = MAX_CHUNKS
) -> tuple[DataFrame, int]:
    """Add ``_chunk``: chunks follow ``order`` and split all rows about evenly.

    Needs the row count and, above one chunk, approximate quantiles (one mergeable sketch). The
    edges only balance the work; they do not influence results.
    """
    n = df.count()
    chunks = min(max_chunks, max(1, math.ceil(n / rows_per_chunk)))
    if chunks == 1:
        return df.withColumn("_chunk", F.lit(0)), 1
    probes = [i / chunks for i in range(1, chunks)]
    as_double = df.withColumn("_order", F.col(order).cast("double"))
    cuts = sorted({float(q) for q in as_double.approxQuantile("_order", probes, 0.25 / chunks)})
    if not cuts:
        return df.withColumn("_chunk", F.lit(0)), 1
    splits = [-math.inf, *cuts, math.inf]
    out = Bucketizer(splits=splits, inputCol="_order", outputCol="_c", handleInvalid="keep").transform(
        as_double
    )
    return out.withColumn("_chunk", F.col("_c").cast("int")).drop("_order", "_c"), len(splits) - 1


_PLUS = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
_FOLDS = {
    "sum": (F.sum, _PLUS),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def running_fold(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    folds: dict[str, tuple[str, Column, bool]],
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Running sum / max / min per ``by`` group in ``order`` (unique inside a group).

    ``folds`` maps an output column to ``(kind, expression, inclusive)``. A group may hold any
    share of the rows: only ``(group, chunk)`` pairs meet in one task, and the rows are shuffled
    once, on that pair.
    """
    by = list(by)
    chunked, chunks = with_chunk(df, order, rows_per_chunk)
    names = list(folds)
    keys = [*by, "_chunk"]
    window = Window.partitionBy(*keys).orderBy(order)
    spans = {
        True: window.rowsBetween(Window.unboundedPreceding, Window.currentRow),
        False: window.rowsBetween(Window.unboundedPreceding, -1),
    }
    inside = chunked.select(
        "*",
        *[_FOLDS[kind][0](expr).over(spans[incl]).alias(f"_in_{name}")
          for name, (kind, expr, incl) in folds.items()],
    )
    if chunks == 1:
        return inside.select(
            *df.columns,
            *[(F.coalesce(F.col(f"_in_{n}"), F.lit(0)) if folds[n][0] == "sum" else F.col(f"_in_{n}")).alias(n)
              for n in names],
        )
    totals = chunked.groupBy(*keys).agg(
        *[_FOLDS[kind][0](expr).alias(f"_t_{name}") for name, (kind, expr, _) in folds.items()]
    )
    # at most one row per (group, chunk): a group has at most MAX_CHUNKS rows here
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carries = totals.select(
        *keys,
        *[_FOLDS[folds[n][0]][0](F.col(f"_t_{n}")).over(before).alias(f"_c_{n}") for n in names],
    )
    condition = reduce(
        lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    )
    joined = inside.alias("r").join(carries.alias("c"), condition, "left")
    return joined.select(
        *[F.col(f"r.{c}") for c in df.columns],
        *[_FOLDS[folds[n][0]][1](F.col(f"c._c_{n}"), F.col(f"r._in_{n}")).alias(n) for n in names],
    )


def hash_chunk(share: str, n_rows: int, rows_per_chunk: int) -> tuple[Column, int]:
    """Chunks of about ``rows_per_chunk`` rows by a column that is uniform in [0, 1), in its order."""
    chunks = min(MAX_CHUNKS, max(1, math.ceil(n_rows / rows_per_chunk)))
    return F.floor(F.col(share) * chunks).cast("int").alias("_chunk"), chunks


def rank_by_hash(
    df: DataFrame, by: Sequence[str], share: str, key: str, out: str, n_rows: int, rows_per_chunk: int = ROWS_PER_TASK
) -> DataFrame:
    """Adds ``out``: the row's place, from 0, in its group's order by (``share``, ``key``).

    ``share`` is a hash, uniform in [0, 1): it is cut into ranges, the rows of each are counted, and places
    are numbered inside a range from what came before. Ranges only divide the work, so the result is the
    same for any number of them, and a group may hold any share of the rows.
    """
    chunk, chunks = hash_chunk(share, n_rows, rows_per_chunk)
    tagged = df.select("*", chunk)
    inside = tagged.withColumn(out, F.row_number().over(Window.partitionBy(*by, "_chunk").orderBy(share, key)).cast("bigint") - 1)
    if chunks == 1:
        return inside.drop("_chunk")
    # at most one row per (group, chunk)
    before = Window.partitionBy(*by).orderBy("_chunk") if by else Window.partitionBy(F.lit(0)).orderBy("_chunk")
    carries = tagged.groupBy(*by, "_chunk").agg(F.count("*").alias("_n")).select(
        *by, "_chunk", (F.sum("_n").over(before) - F.col("_n")).alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*by, "_chunk"]])
    return inside.alias("r").join(carries.alias("c"), same).select(
        *[F.col(f"r.{c}") for c in df.columns], (F.col(f"r.{out}") + F.col("c._before")).alias(out))


def next_by_hash(
    df: DataFrame, column: str, share: str, key: str, out: str, n_rows: int, rows_per_chunk: int = ROWS_PER_TASK
) -> DataFrame:
    """Adds ``out``: ``column`` of the next row in the order by (``share``, ``key``), the last row taking the
    first's. As in ``rank_by_hash``, ranges of the hash only divide the work; a range sends its first value."""
    chunk, chunks = hash_chunk(share, n_rows, rows_per_chunk)
    tagged = df.select("*", chunk)
    order = Window.partitionBy("_chunk").orderBy(share, key)
    last = F.lead(F.lit(True)).over(order).isNull()
    if chunks == 1:
        return tagged.withColumn(out, F.when(last, F.first(column).over(order)).otherwise(F.lead(column).over(order))).drop("_chunk")
    inside = tagged.select("*", F.lead(column).over(order).alias(out), last.alias("_last"))
    # one row per chunk, at most MAX_CHUNKS
    firsts = tagged.groupBy("_chunk").agg(F.min_by(F.struct(column), F.struct(share, key)).alias("_first"))
    ring = Window.partitionBy(F.lit(0)).orderBy("_chunk")
    start = F.first("_first").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = firsts.select("_chunk", F.coalesce(F.lead("_first").over(ring), start).alias("_after"))
    value = F.when(F.col("_last"), F.col(f"_after.{column}")).otherwise(F.col(out))
    return inside.join(F.broadcast(after), "_chunk").select(*df.columns, value.alias(out))


def present(column: str) -> Column:
    """The column as double; NaN counts as missing."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def between_ranks(low: float, high: float, part: float) -> float:
    """Linear interpolation, from the nearer end."""
    if low == high:
        return low
    return low + (high - low) * part if part < 0.5 else high - (high - low) * (1 - part)


def exact_quantiles(
    df: DataFrame, probabilities: dict[str, Sequence[float]], direct_cells: int = MAX_COUNTERS, n_rows: int | None = None
) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of several columns (null and NaN ignored).

    The two order statistics of each quantile are found by their digits: numbers are read as 64 ordered
    bits, all columns are counted by their first bits in one pass, then only the cells that hold a
    wanted rank by their next bits, until a cell holds one value. Every task sends counts, at most
    ``direct_cells`` of them; no value is sorted or collected, and two or three passes are usual (six at
    most). More columns than that allows are taken in groups. ``n_rows`` is not needed any more and
    kept for callers.
    """
    columns = list(probabilities)
    wanted = max((2 * len(set(p)) for p in probabilities.values()), default=0)
    size = max(1, direct_cells // max(1 << _DIGITS[0], wanted << _DIGITS[1]))
    out: dict[str, list[float | None]] = {}
    for at in range(0, len(columns), size):
        group = {c: probabilities[c] for c in columns[at : at + size]}
        out |= _digit_select(df.select(*[present(c).alias(f"q{i}") for i, c in enumerate(group)]), group)
    return out


def _digit_select(df: DataFrame, probabilities: dict[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """Quantiles of the columns of ``df``, which stand in the order of ``probabilities``."""
    found: dict[tuple[int, int], float] = {}
    at: list[list[float]] = []
    # of each column: bits known of the cells looked into, and the ranks inside with those below the cell
    cells = [{0: None} for _ in probabilities]
    known = 0
    for bits in _DIGITS:
        counted = _digit_counts(df, [sorted(c) for c in cells], known, bits)
        if known == 0:
            totals = [sum(n for n, _, _ in counted.get((i, 0), {}).values()) for i in range(len(cells))]
            at = [[p * (n - 1) for p in ps] if n else [] for n, ps in zip(totals, probabilities.values(), strict=True)]
            cells = [{0: [(r, r) for r in sorted({r for x in own for r in (math.floor(x), math.ceil(x))})]} for own in at]
        grown: list[dict[int, list]] = [{} for _ in cells]
        for i, own in enumerate(cells):
            for prefix, ranks in own.items():
                digits = sorted(counted.get((i, prefix), {}).items())
                below = 0
                todo = list(ranks)
                for digit, (n, low, high) in digits:
                    while todo and todo[0][1] < below + n:
                        rank, inside = todo.pop(0)
                        if low == high:
                            found[i, rank] = low
                        else:
                            grown[i].setdefault(prefix << bits | digit, []).append((rank, inside - below))
                    below += n
        cells, known = grown, known + bits
        if not any(cells):
            break
    return {
        c: [between_ranks(found[i, math.floor(x)], found[i, math.ceil(x)], x - math.floor(x)) for x in at[i]]
        if at[i] else [None] * len(ps)
        for i, (c, ps) in enumerate(probabilities.items())
    }


def _ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; both zeros are one."""
    raw = (values + 0.0).view(np.uint64)
    return np.where(raw >> np.uint64(63), ~raw, raw | np.uint64(1 << 63))


def _digit_counts(
    df: DataFrame, prefixes: list[list[int]], known: int, bits: int
) -> dict[tuple[int, int], dict[int, tuple[int, float, float]]]:
    """(column, prefix) -> digit -> (count, smallest, largest value): the values whose first ``known`` bits
    are a prefix of their column, by their next ``bits``."""
    starts = [np.array(p, np.uint64) for p in prefixes]
    size, shift = 1 << bits, np.uint64(64 - known - bits)

    def count(parts):
        held = [(np.zeros(len(p) * size, np.int64), np.full(len(p) * size, np.inf), np.full(len(p) * size, -np.inf)) for p in starts]
        for part in parts:
            for i, own in enumerate(starts):
                values = part.column(i).to_numpy(zero_copy_only=False)
                values = values[~np.isnan(values)] + 0.0
                if not len(own) or not len(values):
                    continue
                key = _ordered_bits(values)
                digit = (key >> shift) & np.uint64(size - 1)
                if known:
                    top = key >> np.uint64(64 - known)
                    place = np.minimum(np.searchsorted(own, top), len(own) - 1)
                    hit = own[place] == top
                    values, digit = values[hit], digit[hit] + (place[hit] * size).astype(np.uint64)
                digit = digit.astype(np.int64)
                n, low, high = held[i]
                n += np.bincount(digit, minlength=len(n))
                np.minimum.at(low, digit, values)
                np.maximum.at(high, digit, values)
        for i, (n, low, high) in enumerate(held):
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({
                "c": pa.array(np.full(len(some), i), pa.int32()), "p": pa.array(some // size, pa.int32()), "d": pa.array(some % size, pa.int32()),
                "n": pa.array(n[some]), "low": pa.array(low[some]), "high": pa.array(high[some])})

    cells = df.mapInArrow(count, "c int, p int, d int, n bigint, low double, high double").groupBy("c", "p", "d").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    out: dict[tuple[int, int], dict[int, tuple[int, float, float]]] = {}
    for c, p, d, n, low, high in zip(*[x.to_pylist() for x in cells.toArrow().columns], strict=True):
        out.setdefault((c, prefixes[c][p]), {})[d] = (n, low, high)
    return out
