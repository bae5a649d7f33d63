"""Reference learners for the probes.

The default learner is additive: every feature is cut into bins, every bin gets a smoothed log
odds, a row's score is their sum. Its training data are counts, so one grouped aggregation trains
all folds, all shuffled copies of the labels and all training sizes at once (training counts of a
fold = all counts minus the fold's own). It differs on purpose from boosted trees: it sees no
interactions between features unless a feature carries them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import Context, known_metric
from ..session import cut_lineage
from .featurize import Binner, class_sizes, encode_classes, fit_bins
from .resample import shuffle_column, stratified_kfold

MAX_MODEL_CELLS = 20_000_000
SCORE_DIGITS = 4


@dataclass(frozen=True)
class Prepared:
    """Binned rows (row_id, y, fold, cells, kept columns) and what is needed to read them."""

    rows: DataFrame
    binner: Binner
    classes: list[str] | None
    k: int

    @property
    def binary(self) -> bool:
        return self.classes is not None and len(self.classes) == 2

    @property
    def scoring(self) -> str:
        return "r2" if self.classes is None else "roc_auc" if self.binary else "accuracy"


def prepare(
    df: DataFrame, target: str, features: Sequence[str], k: int = 5, seed: int = 0, bins: int = 16,
    keep: Sequence[str] = (),
) -> Prepared:
    """Encode once and write once; every later pass reads the narrow result."""
    # classes, levels and every pass of the quantiles read these columns: what makes them runs once
    wanted = {"row_id", target, *features, *keep}
    df = cut_lineage(df.select(*[F.col(f"`{c}`") for c in df.columns if c in wanted]))
    sizes = class_sizes(df, target)
    classes = [value for value, _ in sizes]
    if len(classes) < 2:
        raise ValueError("the target needs at least two classes")
    n, smallest = sum(n for _, n in sizes), min(n for _, n in sizes)
    coded = encode_classes(df, target, classes)
    binner = fit_bins(coded, list(features), bins, n_rows=n)
    if not binner.names:
        raise ValueError("no usable features after encoding")
    k = max(2, min(k, smallest))
    narrow = binner.apply(coded, ["row_id", "y", *keep])
    folded = stratified_kfold(narrow, "y", k, seed=seed, sizes=[n for _, n in sizes])
    return Prepared(cut_lineage(folded), binner, [str(c) for c in classes], k)


def cell_counts(
    rows: DataFrame, labels: Sequence[str], by: Sequence[str], cells: str = "cells"
) -> DataFrame:
    """Counts by (replica, by, label, cell): one replica per label column."""
    copies = F.array(*[F.struct(F.lit(i).alias("replica"), F.col(c).alias("label")) for i, c in enumerate(labels)])
    long = rows.select(*by, cells, F.explode(copies).alias("r"))
    cut = long.select(*by, F.col("r.replica").alias("replica"), F.col("r.label").alias("label"), F.explode(cells).alias("cell"))
    return cut.groupBy("replica", *by, "label", "cell").agg(F.count("*").alias("n"))


def counts_array(counts: DataFrame, shape: Sequence[int], by: Sequence[str]) -> np.ndarray:
    """Counts as an array [replica, *by, label, cell]; its size is checked, it holds no rows."""
    if math.prod(shape) > MAX_MODEL_CELLS:
        raise ValueError(f"a model of {math.prod(shape)} cells is too large")
    out = np.zeros(tuple(shape))
    table = counts.select("replica", *by, "label", "cell", "n").toPandas().to_numpy(dtype=np.int64)
    if len(table):
        out[tuple(table[:, i] for i in range(table.shape[1] - 1))] = table[:, -1]
    return out


def log_odds(train: np.ndarray, binner: Binner) -> tuple[np.ndarray, np.ndarray]:
    """Weights [..., class-1, cell] and priors [..., class-1] from counts [..., class, cell].

    Add-one smoothing per feature; class 0 is the reference.
    """
    starts, sizes = binner.starts, binner.sizes
    totals = train[..., starts[0] : starts[0] + sizes[0]].sum(-1)
    width = np.repeat(sizes, sizes)
    share = np.log(train + 1) - np.log(totals[..., None] + width)
    prior = np.log(totals + 1)
    return share[..., 1:, :] - share[..., :1, :], prior[..., 1:] - prior[..., :1]


def models_frame(spark, weights: np.ndarray, priors: np.ndarray) -> DataFrame:
    """Models [fold, model, class-1, cell] as one small row per fold, to be broadcast."""
    rows = [
        (f, weights[f].reshape(-1, weights.shape[-1]).tolist(), priors[f].reshape(-1).tolist())
        for f in range(weights.shape[0])
    ]
    return F.broadcast(spark.createDataFrame(rows, "model_fold bigint, w array<array<double>>, w0 array<double>"))


WRITTEN_OUT = 12


def logit(slot: int, n_features: int, cells: str = "cells", only: Sequence[int] | None = None) -> Column:
    """Sum of one model's weights over the row's cells (or the cells at positions ``only``).

    Short sums are written out, so that they are compiled; long ones fold over the cell array.
    """
    weights, prior = F.col("w").getItem(slot), F.col("w0").getItem(slot)
    at = range(n_features) if only is None else only
    if len(at) <= WRITTEN_OUT:
        return sum((F.get(weights, F.get(cells, F.lit(f))) for f in at), prior)
    chosen = F.col(cells) if only is None else F.transform(
        F.array(*[F.lit(f) for f in only]), lambda f: F.get(cells, f))
    return F.aggregate(chosen, prior, lambda total, cell: total + F.get(weights, cell))


def on_grid(value: Column, digits: int = SCORE_DIGITS) -> Column:
    """Rounded half up in plain arithmetic; ``round`` would build a decimal object per value."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / F.lit(scale)


def probabilities(logits: Sequence[Column]) -> Column:
    """Class probabilities (array) from logits of classes 1, 2, ... against class 0."""
    if len(logits) == 1:
        p = on_grid(1 / (1 + F.exp(-logits[0])))
        return F.array(on_grid(1 - p), p)
    top = F.greatest(F.lit(0.0), *logits)
    parts = [F.exp(-top), *[F.exp(x - top) for x in logits]]
    total = sum(parts[1:], parts[0])
    return F.array(*[on_grid(x / total) for x in parts])


def predicts(logits: Sequence[Column], label: Column) -> Column:
    """Whether the most probable class is the label (class 0 when two are equal)."""
    if len(logits) == 1:
        return (on_grid(1 / (1 + F.exp(-logits[0]))) > 0.5) == (label == 1)
    return arg_max(probabilities(logits)) == label


def arg_max(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("bigint")


def fold_models(prep: Prepared, labels: Sequence[str], rows: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights [fold, replica, class-1, cell] trained on all rows outside the fold."""
    rows = prep.rows if rows is None else rows
    shape = (len(labels), prep.k, len(prep.classes), prep.binner.n_cells)
    own = counts_array(cell_counts(rows, labels, ["fold"]), shape, ["fold"])
    train = own.sum(axis=1, keepdims=True) - own
    return log_odds(np.swapaxes(train, 0, 1), prep.binner)


def with_models(rows: DataFrame, models: DataFrame, fold: str = "fold") -> DataFrame:
    return rows.join(models, rows[fold] == models["model_fold"])


def out_of_fold(prep: Prepared) -> DataFrame:
    """row_id, y, fold, ``probs`` (per class), ``p`` (of the last class), kept columns."""
    weights, priors = fold_models(prep, ["y"])
    spark = prep.rows.sparkSession
    scored = with_models(prep.rows, models_frame(spark, weights, priors))
    n, classes = len(prep.binner.names), len(prep.classes)
    probs = probabilities([logit(c, n) for c in range(classes - 1)])
    keep = [c for c in prep.rows.columns if c != "cells"]
    return scored.select(*keep, probs.alias("probs")).withColumn("p", F.element_at("probs", -1))


def grouped_score(rows: DataFrame, by: Sequence[str], binary: bool) -> DataFrame:
    """``by`` + ``value``: AUC of ``p`` against ``y`` when binary, else share of ``hit``.

    Scores have four decimals, so a group has at most 10,001 score cells.
    """
    if not binary:
        return rows.groupBy(*by).agg(F.avg(F.col("hit").cast("double")).alias("value"))
    auc = known_metric("auc")
    named = rows.withColumnRenamed("y", "y_true").withColumnRenamed("p", "proba_1")
    ctx = Context(1, 0, 2, "proba_1")
    return auc.finish(auc.cells(named, by, ctx), list(by), ctx, bounded=True)


def importance(prep: Prepared, repeats: int = 3, salt: str = "perm") -> DataFrame:
    """(feature, importance): loss of accuracy when a feature is permuted, for the model on all rows.

    One random cyclic order per repeat moves whole cell arrays; a feature's permuted score only
    swaps that feature's weight, so all features are rescored from the same pass. A task adds up the hits
    of all features as arrays and sends one row per feature.
    """
    counts = counts_array(cell_counts(prep.rows, ["y"], []), (1, len(prep.classes), prep.binner.n_cells), [])
    weights, priors = log_odds(counts, prep.binner)
    salts = {f"_moved{r}": f"{salt}{r}" for r in range(repeats)}
    rows = shuffle_column(prep.rows, "cells", salts).filter("y is not null").select("y", "cells", *salts)
    n = len(prep.binner.names)
    hits = rows.mapInArrow(_swapped_hits(weights[0], priors[0], n), "f int, n bigint, base double, swapped double")
    total = hits.groupBy("f").agg(*[F.sum(c).alias(c) for c in ("n", "base", "swapped")])
    loss = F.col("base") / F.col("n") - F.col("swapped") / (F.col("n") * repeats)
    names = F.array(*[F.lit(name) for name in prep.binner.names])
    return total.filter("n > 0").select(F.get(names, F.col("f")).alias("feature"), loss.alias("importance"))


def _swapped_hits(weights: np.ndarray, prior: np.ndarray, n_features: int):
    """A task's rows (y, cells, permuted cells, ...) to (f, n, base, swapped): its rows, those whose label
    the model finds, and those it still finds with feature f permuted, added up over the permutations."""

    def hits(logits, y):
        grid = lambda x: np.floor(x * 10**SCORE_DIGITS + 0.5) / 10**SCORE_DIGITS
        if len(logits) == 1:
            return (grid(1 / (1 + np.exp(-logits[0]))) > 0.5) == (y == 1)
        top = np.maximum(logits.max(axis=0), 0.0)
        parts = [np.exp(-top), *np.exp(logits - top)]
        total = sum(parts[1:], parts[0])
        return np.argmax([grid(x / total) for x in parts], axis=0) == y

    def emit(parts):
        n, base, swapped = 0, 0, np.zeros(n_features)
        for part in parts:
            if not part.num_rows:
                continue
            y = part.column(0).to_numpy()
            cells, *moved = (c.flatten().to_numpy().reshape(-1, n_features) for c in part.columns[1:])
            logits = np.repeat(prior[:, None], len(y), axis=1)
            for f in range(n_features):
                logits = logits + weights[:, cells[:, f]]
            n += len(y)
            base += int(hits(logits, y).sum())
            for f in range(n_features):
                without = logits - weights[:, cells[:, f]]
                swapped[f] += sum(int(hits(without + weights[:, m[:, f]], y).sum()) for m in moved)
        yield pa.RecordBatch.from_pydict({
            "f": pa.array(range(n_features), pa.int32()), "n": pa.array([n] * n_features, pa.int64()),
            "base": pa.array([float(base)] * n_features), "swapped": pa.array(swapped)})

    return emit


def contributions(prep: Prepared, members: DataFrame, top: int = 5) -> DataFrame:
    """Mean centred weight per feature over the given rows, the most negative first.

    For an additive score the centred weight of a feature is its exact Shapley value.
    """
    counts = counts_array(cell_counts(prep.rows, ["y"], []), (1, len(prep.classes), prep.binner.n_cells), [])[0]
    weights = log_odds(counts, prep.binner)[0][-1]
    table = []
    for name, start, size in zip(prep.binner.names, prep.binner.starts, prep.binner.sizes):
        n, w = counts[:, start : start + size].sum(0), weights[start : start + size]
        centre = float((n * w).sum() / n.sum())
        table += [(start + i, name, float(w[i]) - centre) for i in range(size)]
    spark = prep.rows.sparkSession
    per_cell = F.broadcast(spark.createDataFrame(table, "cell int, feature string, weight double"))
    chosen = prep.rows.join(members.select("row_id"), "row_id", "left_semi")
    return (
        chosen.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
        .join(per_cell, "cell").groupBy("feature")
        .agg((F.sum(F.col("n") * F.col("weight")) / F.sum("n")).alias("contribution"))
        .orderBy("contribution", "feature").limit(top)
    )


