"""Bootstrap replicas as vectors: rows are never multiplied by the number of replicas.

A task holds the Poisson weights of the units it meets as a matrix (units x replicas). It reads cells in
Arrow batches and emits summaries with one number per replica, which can be merged:

* plain sums: one vector per group and cell key, a matrix product per batch;
* areas under a ranking: cells are sorted by (group, score) over all partitions, and a task sends one
  (positives, negatives, area) per group it holds a stretch of. Two neighbouring stretches merge by
  area = area1 + area2 + positives2 x negatives1.

So what follows works on (groups + tasks) x replicas numbers, whatever the number of rows, scores or ties,
and one group may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import poisson_matrix

#: Rows taken into one matrix product; numbers of kept weights and of sums that one task holds.
_BLOCK = 2048
_MAX_WEIGHTS = 64_000_000
_MAX_SUMS = 4_000_000
_DOUBLES = T.ArrayType(T.DoubleType(), False)


class Weights:
    """Weights of resampling units (rows) in all replicas (columns), computed when first met."""

    def __init__(self, n_boot: int, salt: str):
        self.n_boot, self.salt = n_boot, salt
        self.units = np.empty(0, np.int64)
        self.table = np.empty((0, n_boot), np.uint8)

    def of(self, units: np.ndarray) -> np.ndarray:
        some, where = np.unique(units, return_inverse=True)
        new = np.setdiff1d(some, self.units, assume_unique=True)
        if len(new):
            if (len(self.units) + len(new)) * self.n_boot > _MAX_WEIGHTS:
                return poisson_matrix(some, self.n_boot, self.salt)[where].astype(np.float64)
            units_ = np.concatenate([self.units, new])
            order = np.argsort(units_)
            self.table = np.concatenate([self.table, poisson_matrix(new, self.n_boot, self.salt)])[order]
            self.units = units_[order]
        return self.table[np.searchsorted(self.units, some)[where]].astype(np.float64)


def _weighted(weights: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values times weights, where a weight of zero takes no value, not even NaN."""
    product = weights * values[:, None]
    return product if np.isfinite(values).all() else np.where(weights > 0, product, 0.0)


def _numbers(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A numeric column as doubles; null is zero."""
    return batch.column(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)


def _codes(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """A number per row that tells the rows' values in ``columns`` apart (null is a value)."""
    if not columns:
        return np.zeros(batch.num_rows, np.int64)
    each = [batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy() for c in columns]
    return np.unique(np.stack(each, axis=1), axis=0, return_inverse=True)[1].reshape(-1)


def _row(batch: pa.RecordBatch, columns: Sequence[str], at: int) -> tuple:
    return tuple(batch.column(c)[at].as_py() for c in columns)


def _emit(rows: list[tuple], types: list[pa.DataType], names: Sequence[str], vectors: dict[str, list]) -> pa.RecordBatch:
    arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    arrays += [pa.array([v.tolist() for v in own], pa.list_(pa.float64())) for own in vectors.values()]
    return pa.RecordBatch.from_arrays(arrays, names=[*names, *vectors])


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for at in range(0, part.num_rows, _BLOCK):
            yield part.slice(at, _BLOCK)


def _schema(cells: DataFrame, keys: Sequence[str], vectors: Sequence[str]) -> T.StructType:
    return T.StructType([*[cells.schema[k] for k in keys], *[T.StructField(v, _DOUBLES) for v in vectors]])


def _per_replica(partials: DataFrame, keys: Sequence[str], vectors: Sequence[str]) -> DataFrame:
    """``partials`` with a row per replica: ``keys``, ``replica``, and the vectors' numbers."""
    out = partials.select(*keys, F.posexplode(F.arrays_zip(*vectors)).alias("_at", "_v"))
    return out.select(*keys, (F.col("_at") + 1).alias("replica"), *[F.col(f"_v.{v}").alias(v) for v in vectors])


def replica_sums(cells: DataFrame, keys: Sequence[str], sums: Sequence[str], n_boot: int, salt: str) -> DataFrame:
    """``keys``, ``replica`` and the sums over drawn cells; keys that a replica does not draw are left out.

    ``cells`` has a ``_unit``. As in SQL, a sum without any value is null.
    """
    keys, sums = list(keys), list(sums)
    vectors = ["_drawn", *[f"_v{i}" for i in range(len(sums))], *[f"_n{i}" for i in range(len(sums))]]

    def emit(parts):
        weights, held, types = Weights(n_boot, salt), {}, []

        def flush():
            rows = np.stack(list(held.values()))
            batch = _emit(list(held), types, keys, {v: list(rows[:, i]) for i, v in enumerate(vectors)})
            held.clear()
            return batch

        for part in _blocks(parts):
            types = [part.schema.field(k).type for k in keys]
            codes = _codes(part, keys)
            order = np.argsort(codes, kind="stable")
            drawn = weights.of(part.column("_unit").to_numpy(zero_copy_only=False))[order]
            values = [_numbers(part, s)[order] for s in sums]
            valid = [part.column(s).is_valid().to_numpy(zero_copy_only=False)[order].astype(np.float64) for s in sums]
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            flat = [np.add.reduceat(drawn, starts)]
            if len(starts) == 1 and all(np.isfinite(v).all() for v in values):
                flat += [(v @ drawn)[None] for v in [*values, *valid]]
            else:
                flat += [np.add.reduceat(_weighted(drawn, v), starts) for v in [*values, *valid]]
            for i, at in enumerate(order[starts].tolist()):
                key, own = _row(part, keys, at), np.stack([f[i] for f in flat])
                held[key] = held[key] + own if key in held else own
            if len(held) * len(vectors) * n_boot > _MAX_SUMS:
                yield flush()
        if held:
            yield flush()

    partials = cells.select(*keys, "_unit", *sums).mapInArrow(emit, _schema(cells, keys, vectors))
    each = _per_replica(partials, keys, vectors).where("_drawn > 0")
    value = lambda i: F.when(F.sum(f"_n{i}") > 0, F.sum(f"_v{i}"))
    return each.groupBy(*keys, "replica").agg(*[value(i).alias(s) for i, s in enumerate(sums)])


def replica_areas(
    cells: DataFrame, by: Sequence[str], score: str, pos: str, neg: str, n_boot: int, salt: str, partitions: int
) -> DataFrame:
    """``by``, ``replica``, ``value``: area under the ROC curve of drawn cells, equal scores counting half.

    Null if a replica draws no positive or no negative row. ``cells`` has a ``_unit``. Null is the lowest
    score and NaN the highest, as in Spark's order.
    """
    by = list(by)
    vectors = ["_pos", "_neg", "_area"]

    def emit(parts):
        weights = Weights(n_boot, salt)
        zero = np.zeros(n_boot)
        group = first = types = None
        tie = None  # score, positives and negatives of the last score met, to which more rows may come
        total = {}

        def close(tie):
            total["_area"] = total["_area"] + tie[1] * (total["_neg"] + tie[2] / 2)
            total["_pos"], total["_neg"] = total["_pos"] + tie[1], total["_neg"] + tie[2]

        def done():
            close(tie)
            return _emit([(*group, first)], types, [*by, score], {v: [total[v]] for v in vectors})

        for part in _blocks(parts):
            types = [part.schema.field(k).type for k in [*by, score]]
            scores = part.column(score)
            null = scores.is_null().to_numpy(zero_copy_only=False)
            s = _numbers(part, score)
            drawn = weights.of(part.column("_unit").to_numpy(zero_copy_only=False))
            p, n = _weighted(drawn, _numbers(part, pos)), _weighted(drawn, _numbers(part, neg))
            other = np.diff(_codes(part, by), prepend=-1) != 0
            differs = np.ones(len(s), bool)
            differs[1:] = (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1])) | (null[1:] != null[:-1])
            ties = np.flatnonzero(other | differs)
            p, n = np.add.reduceat(p, ties), np.add.reduceat(n, ties)
            edges = np.searchsorted(ties, [*np.flatnonzero(other).tolist(), len(s)])
            for a, b in zip(edges.tolist(), edges.tolist()[1:], strict=False):
                key = _row(part, by, int(ties[a]))
                at = [scores[int(t)].as_py() for t in (ties[a], ties[b - 1])]
                if key != group:
                    if group is not None:
                        yield done()
                    group, first, total = key, at[0], dict.fromkeys(vectors, zero)
                elif at[0] == tie[0] or (at[0] != at[0] and tie[0] is not None and tie[0] != tie[0]):
                    p[a] += tie[1]
                    n[a] += tie[2]
                else:
                    close(tie)
                below = np.cumsum(n[a : b - 1], axis=0)
                if b - 1 > a:
                    own = p[a : b - 1]
                    total["_area"] = total["_area"] + (own * (total["_neg"] + below - n[a : b - 1] / 2)).sum(axis=0)
                    total["_pos"], total["_neg"] = total["_pos"] + own.sum(axis=0), total["_neg"] + below[-1]
                tie = (at[1], p[b - 1].copy(), n[b - 1].copy())
        if group is not None:
            yield done()

    ordered = cells.select(*by, "_unit", score, pos, neg).repartitionByRange(partitions, *by, score).sortWithinPartitions(*by, score)
    stretches = ordered.mapInArrow(emit, _schema(cells, [*by, score], vectors))
    each = _per_replica(stretches, [*by, score], vectors)
    # one row per task that holds rows of the group
    before = Window.partitionBy(*by, "replica").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("_below", F.coalesce(F.sum("_neg").over(before), F.lit(0.0)))
    pos_, neg_ = F.sum("_pos"), F.sum("_neg")
    area = F.sum(F.col("_area") + F.col("_pos") * F.col("_below"))
    value = F.when((pos_ > 0) & (neg_ > 0), area / (pos_ * neg_))
    return each.groupBy(*by, "replica").agg(value.alias("value"))
