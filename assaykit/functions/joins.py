"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HOT_KEYS = 1000
BROADCAST_ROWS = 500_000


def _same(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    broadcast_rows: int = BROADCAST_ROWS,
    hot_share: float = 1.0 / MAX_HOT_KEYS,
    row_counts: str | None = None,
) -> DataFrame:
    """Join many rows to a lookup table that has at most one row per key.

    A lookup of checked small size is broadcast. Otherwise the keys holding more than
    ``hot_share`` of the rows are found with one counting pass: there can be at most
    ``1 / hot_share`` of them, so their part of the lookup is broadcast, and only the remaining
    keys are shuffled. Supports inner, left, left_semi and left_anti. A lookup that already holds
    the number of rows per key names that column in ``row_counts`` and saves the counting.
    """
    keys = list(keys)
    if lookup.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return _join(rows, F.broadcast(lookup.drop(row_counts) if row_counts else lookup), keys, how)
    total = rows.count()
    counts = (
        rows.groupBy(*keys).agg(F.count("*").alias("_n")) if row_counts is None
        else lookup.select(*keys, F.col(row_counts).alias("_n"))
    )
    hot = counts.filter(F.col("_n") > max(1.0, total * hot_share)).select(*keys)
    if row_counts is not None:
        lookup = lookup.drop(row_counts)
    hot_keys = F.broadcast(hot)
    hot_part = _join(
        _join(rows, hot_keys, keys, "left_semi"), F.broadcast(_join(lookup, hot_keys, keys, "left_semi")),
        keys, how,
    )
    cold_part = _join(_join(rows, hot_keys, keys, "left_anti"), lookup, keys, how)
    return hot_part.unionByName(cold_part)


def _join(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str) -> DataFrame:
    joined = rows.alias("l").join(lookup.alias("r"), _same(keys), how)
    if how in ("left_semi", "left_anti"):
        return joined
    extra = [F.col(f"r.{c}") for c in lookup.columns if c not in keys]
    return joined.select(*[F.col(f"l.{c}") for c in rows.columns], *extra)
