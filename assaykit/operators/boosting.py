"""Boosted trees on binned features, the models of all folds trained together, each on all rows of the other folds.

Trees see a row only by its bins. Rows of a large table are therefore binned and equal ones added up by
Spark, which loses nothing, and a task grows the trees of one fold from the sums; every row is then scored
by the model that did not see its fold. Only bin edges and grown trees pass the driver: the number of trees
is folds x rounds x classes, each of at most 2^depth leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import exact_quantiles
from .resample import subsample_rows

#: Rows of a table that are binned inside the tasks; rows looked at together inside a task.
AT_ONCE, CHUNK = 20_000, 1 << 20
BINS = 255

MODEL_SCHEMA = "fold bigint, round bigint, klass bigint, feature array<bigint>, threshold array<double>, value array<double>"


def bin_edges(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Increasing cuts; a value belongs to the bin of the first cut that is not below it."""
    distinct = np.unique(values)
    if len(distinct) <= bins:
        return (distinct[1:] + distinct[:-1]) / 2
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _sums(keys: Callable[[slice], np.ndarray], weights: np.ndarray | None, n: int, size: int) -> np.ndarray:
    """Weights of ``n`` rows added up by key, a chunk of rows at a time."""
    out = np.zeros(size)
    for at in range(0, n, CHUNK):
        own = slice(at, at + CHUNK)
        out += np.bincount(keys(own), None if weights is None else weights[own], size)
    return out


def grow_tree(
    binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, min_rows: int, rate: float,
    rows: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, value, leaf of each row) of one tree, level by level.

    Inner nodes lie in heap order; one that is not split has cut -1 in place of a bin and sends all
    rows to its left child. ``value`` holds the 2^depth leaves. A row may stand for several ``rows``.
    """
    n, d = binned.shape
    width = int(binned.max(initial=0)) + 1
    feature = np.zeros((1 << depth) - 1, dtype=np.int64)
    cut = np.full((1 << depth) - 1, -1, dtype=np.int64)
    node = np.zeros(n, dtype=np.int64)
    for level in range(depth):
        nodes = 1 << level
        best = np.full(nodes, 1e-9)
        at_feature, at_cut = np.zeros(nodes, dtype=np.int64), np.full(nodes, -1, dtype=np.int64)
        for j in range(d):
            def key(own: slice, j: int = j) -> np.ndarray:
                return node[own] * width + binned[own, j]

            g, h, c = (_sums(key, w, n, nodes * width).reshape(nodes, width).cumsum(1) for w in (gradient, hessian, rows))
            gain = _gain(g, h) + _gain(g[:, -1:] - g, h[:, -1:] - h) - _gain(g[:, -1:], h[:, -1:])
            gain[(c < min_rows) | (c[:, -1:] - c < min_rows)] = 0.0
            where = gain.argmax(1)
            found = gain[np.arange(nodes), where]
            better = found > best
            best[better], at_feature[better], at_cut[better] = found[better], j, where[better]
        feature[nodes - 1 : 2 * nodes - 1], cut[nodes - 1 : 2 * nodes - 1] = at_feature, at_cut
        for at in range(0, n, CHUNK):
            here, part = node[at : at + CHUNK], binned[at : at + CHUNK]
            own = at_cut[here]
            node[at : at + CHUNK] = 2 * here + ((own >= 0) & (part[np.arange(len(part)), at_feature[here]] > own))
    leaves = 1 << depth
    total, weight = (_sums(lambda own: node[own], w, n, leaves) for w in (gradient, hessian))
    return feature, cut, -rate * total / np.maximum(weight, 1e-12) * (weight > 0), node


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / np.maximum(h, 1e-12)


def _probabilities(raw: np.ndarray) -> np.ndarray:
    """Of raw scores (rows, outputs): one output is the log odds of the second class."""
    if raw.shape[1] == 1:
        p = 1 / (1 + np.exp(-np.clip(raw, -500, 500)))
        return np.hstack([1 - p, p])
    e = np.exp(raw - raw.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fold_edges(rows: DataFrame, k: int, bins: int = BINS) -> dict[int, list[np.ndarray]]:
    """Fold -> ``bin_edges`` of every feature over all rows outside the fold; folds that hold all rows have none."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            fold = batch.column("fold").to_numpy()
            for f in np.unique(fold).tolist():
                for j in range(x.shape[1]):
                    some = held.get((f, j), np.empty(0))
                    # one value more than there are bins says that there are too many
                    if len(some) <= bins:
                        held[f, j] = np.unique(np.concatenate([some, x[fold == f, j]]))[: bins + 1]
        for (f, j), some in held.items():
            yield pa.RecordBatch.from_pydict({"fold": pa.array([f]), "j": pa.array([j]), "v": pa.array([some.tolist()])})

    few = rows.select("fold", "x").mapInArrow(distinct, "fold bigint, j bigint, v array<double>").groupBy("fold", "j").agg(
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("v")))), 1, bins + 1).alias("v")).collect()
    values = {(r["fold"], r["j"]): np.array(r["v"]) for r in few}
    width, folds = max((j for _, j in values), default=-1) + 1, {f for f, _ in values}
    own = {(m, j): [v for (f, i), v in values.items() if i == j and f != m] for m in range(k) if folds - {m} for j in range(width)}
    edges = {at: np.unique(np.concatenate(v)) for at, v in own.items()}
    many = [at for at, v in edges.items() if len(v) > bins]
    edges = {at: (v[1:] + v[:-1]) / 2 for at, v in edges.items()}
    parts = rows.select(*[F.when(F.col("fold") != m, F.col("x").getItem(j)).alias(f"q{m}_{j}") for m, j in many])
    found = exact_quantiles(parts, {f"q{m}_{j}": (np.arange(1, bins) / bins).tolist() for m, j in many}) if many else {}
    edges |= {(m, j): np.unique(found[f"q{m}_{j}"]) for m, j in many}
    return {m: [edges[m, j] for j in range(width)] for m in range(k) if (m, 0) in edges}


@dataclass(frozen=True)
class BoostedTrees:
    """Settings; ``n_classes`` None means a numeric target."""

    n_classes: int | None
    rounds: int = 200
    rate: float = 0.1
    depth: int = 5
    min_rows: int = 20
    max_train: int | None = None
    seed: int = 0
    at_once: int = AT_ONCE

    def fit(self, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, list, list, list]]:
        """Rows (round, klass, feature, threshold, value); round -1 holds the starting scores."""
        edges = [bin_edges(column) for column in x.T]
        binned = np.column_stack([np.searchsorted(e, column) for e, column in zip(edges, x.T, strict=True)])
        return self._boost(binned, edges, self._wanted(y), None)

    def _wanted(self, y: np.ndarray) -> np.ndarray:
        """The target of every output: the value itself, the second class, or one class after the other."""
        return y[:, None] if self.n_classes in (None, 2) else (y[:, None] == np.arange(self.n_classes))

    def _boost(
        self, binned: np.ndarray, edges: list[np.ndarray], wanted: np.ndarray, rows: np.ndarray | None
    ) -> list[tuple[int, int, list, list, list]]:
        """Trees of binned rows; one that stands for several ``rows`` has the sums of their targets."""
        n, outputs = wanted.shape
        total = n if rows is None else rows.sum()
        if self.n_classes is None:
            start = np.array([wanted.mean() if rows is None else wanted.sum() / total])
        else:
            shares = wanted.sum(0) / total
            shares = np.maximum(np.array([(total - wanted.sum()) / total, shares[0]]) if self.n_classes == 2 else shares, 1e-6)
            start = np.array([np.log(shares[1] / shares[0])]) if self.n_classes == 2 else np.log(shares)
        raw, gradient, hessian = np.tile(start, (n, 1)), np.empty((n, outputs)), np.empty((n, outputs))
        found = [(-1, 0, [], [], start.tolist())]
        for step in range(self.rounds):
            for at in range(0, n, CHUNK):
                own = slice(at, at + CHUNK)
                each = 1.0 if rows is None else rows[own, None]
                p = raw[own] if self.n_classes is None else _probabilities(raw[own])[:, -outputs:]
                gradient[own] = each * p - wanted[own]
                hessian[own] = each if self.n_classes is None else each * (p * (1 - p))
            for klass in range(outputs):
                feature, cut, value, leaf = grow_tree(
                    binned, gradient[:, klass], hessian[:, klass], self.depth, self.min_rows, self.rate, rows)
                raw[:, klass] += value[leaf]
                threshold = [float(edges[f][c]) if c >= 0 else np.inf for f, c in zip(feature, cut, strict=True)]
                found.append((step, klass, feature.tolist(), threshold, value.tolist()))
        return found

    def train(self, rows: DataFrame, k: int) -> DataFrame:
        """The trees of every fold's model, which is trained on all rows of all other folds.

        ``max_train`` is for callers that want no more than so many of the rows.
        """
        narrow = rows.select("row_id", F.col("y").cast("double").alias("y"), "fold", "x")
        if self.max_train is not None:
            narrow = subsample_rows(narrow, self.max_train, seed=self.seed)
        elif narrow.count() > self.at_once:
            return self._train_sums(narrow, k)
        others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>"), lambda f: f != F.col("fold"))

        def grow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("row_id")
            x = np.vstack(part["x"].to_numpy()).astype(float)
            out = pd.DataFrame(self.fit(x, part["y"].to_numpy()), columns=["round", "klass", "feature", "threshold", "value"])
            out.insert(0, "fold", int(key[0]))
            return out

        # one task a model: a number of partitions that is asked for is not merged again
        copies = narrow.withColumn("model", F.explode(others)).repartition(k, "model")
        return copies.groupBy("model").applyInPandas(grow, MODEL_SCHEMA)

    def _train_sums(self, rows: DataFrame, k: int) -> DataFrame:
        """``train`` from sums: rows of equal bins have equal scores in every round, so they are one row of their number."""
        edges = fold_edges(rows, k)
        outputs = 1 if self.n_classes in (None, 2) else self.n_classes
        sums = ["n", *[f"w{i}" for i in range(outputs)]]
        schema = "model bigint, bins binary, " + ", ".join(f"{c} double" for c in sums)

        def added(binned: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.lexsort(binned.T[::-1])
            binned = binned[order]
            first = np.flatnonzero(np.concatenate([[True], (binned[1:] != binned[:-1]).any(1)]))
            return binned[first], np.add.reduceat(values[order], first, axis=0)

        def batch_of(model: int, binned: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            keys = pa.array([row.tobytes() for row in binned], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(binned), model)), keys, *map(pa.array, values.T.copy())], ["model", "bins", *sums])

        def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {model: [] for model in edges}
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                fold, y = batch.column("fold").to_numpy(), batch.column("y").to_numpy(zero_copy_only=False)
                values = np.column_stack([np.ones(len(y)), self._wanted(y)])
                for model, own in edges.items():
                    at = fold != model
                    if at.any():
                        binned = np.column_stack([np.searchsorted(e, x[at, j]) for j, e in enumerate(own)]).astype(np.uint8)
                        held[model].append((binned, values[at]))
                    if sum(len(b) for b, _ in held[model]) > CHUNK // 4:
                        held[model] = [added(*(np.concatenate(v) for v in zip(*held[model], strict=True)))]
                        if len(held[model][0][0]) > CHUNK // 8:
                            yield batch_of(model, *held[model].pop())
            for model, parts in held.items():
                if parts:
                    yield batch_of(model, *added(*(np.concatenate(v) for v in zip(*parts, strict=True))))

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for batch in batches:
                models = batch.column("model").to_numpy()
                for model in np.unique(models).tolist():
                    own = batch.filter(pa.array(models == model))
                    binned = np.frombuffer(b"".join(own.column("bins").to_pylist()), np.uint8).reshape(own.num_rows, -1)
                    held.setdefault(model, []).append((binned, np.column_stack([own.column(c).to_numpy() for c in sums])))
            for model in sorted(held):
                binned, values = (np.concatenate(v) for v in zip(*held.pop(model), strict=True))
                found = self._boost(binned, edges[model], values[:, 1:], values[:, 0].copy())
                columns = [pa.array(v) for v in zip(*found, strict=True)]
                for i, kind in ((2, pa.int64()), (3, pa.float64()), (4, pa.float64())):
                    columns[i] = columns[i].cast(pa.list_(kind))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), model)), *columns], ["fold", "round", "klass", "feature", "threshold", "value"])

        cells = rows.mapInArrow(bin_rows, schema).groupBy("model", "bins").agg(*[F.sum(c).alias(c) for c in sums])
        # in the order of the bins, wherever rows came from; sums of numeric targets may differ in their last digit
        return cells.repartition(k, "model").sortWithinPartitions("model", "bins").mapInArrow(grow, MODEL_SCHEMA)

    def out_of_fold(self, rows: DataFrame, k: int) -> DataFrame:
        """row_id, y, fold and ``probs`` or ``prediction``; a fold that holds all rows has no model, which is an error."""
        models: dict[int, tuple] = {}
        grown = self.train(rows, k).toPandas().sort_values(["fold", "round", "klass"])
        for fold, part in grown.groupby("fold"):
            trees = part[part["round"] >= 0]
            columns = [np.vstack(trees[c].to_numpy()) if len(trees) else None for c in ("feature", "threshold", "value")]
            models[int(fold)] = (np.array(part["value"].iloc[0]), trees["klass"].to_numpy(), *columns)
        shared = rows.sparkSession.sparkContext.broadcast(models)
        n_classes, depth = self.n_classes, self.depth
        output = "row_id bigint, y double, fold bigint, " + ("probs array<double>" if n_classes else "prediction double")

        def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for fold, own in part.groupby("fold"):
                    if int(fold) not in shared.value:
                        raise ValueError(f"no rows outside fold {fold} to train on")
                    start, klass, feature, threshold, value = shared.value[int(fold)]
                    x = np.vstack(own["x"].to_numpy()).astype(float)
                    raw, at = np.tile(start, (len(x), 1)), np.arange(len(x))
                    for t, output_of in enumerate(klass):
                        node = np.zeros(len(x), dtype=np.int64)
                        for _ in range(depth):
                            node = 2 * node + 1 + (x[at, feature[t][node]] > threshold[t][node])
                        raw[:, output_of] += value[t][node - len(feature[t])]
                    out = own[["row_id", "y", "fold"]].copy()
                    if n_classes:
                        out["probs"] = list(_probabilities(raw))
                    else:
                        out["prediction"] = raw[:, 0]
                    yield out

        return rows.select("row_id", F.col("y").cast("double").alias("y"), "fold", "x").mapInPandas(score, output)
