"""The additive learner for numeric targets.

Same cells as for classes, but a bin's weight is the shrunken deviation of its mean target from the
overall mean. Because deviations of related features overlap, their sum is scaled by one slope,
fitted by least squares. Scores come from six sums per fold, so no pass beyond training and
scoring is needed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import exact_quantiles
from ..session import cut_lineage
from .featurize import Binner, encode_target, fit_bins
from .forensics import SIZES, signal_summary
from .learners import MAX_MODEL_CELLS, Prepared, logit, models_frame, with_models
from .resample import kfold, learning_sizes, shuffle_column

SUMS = ("n", "s", "y", "ss", "sy", "yy")


def prepare_regression(
    df: DataFrame, target: str, features: Sequence[str], k: int = 5, seed: int = 0, bins: int = 16
) -> Prepared:
    coded, _ = encode_target(df, target, "regression")
    binner = fit_bins(coded, list(features), bins)
    if not binner.names:
        raise ValueError("no usable features after encoding")
    # scores do not change when the targets move, and sums of squares of a large offset would cancel
    center = coded.agg(F.avg("y")).first()[0] or 0.0
    centered = binner.apply(coded, ["row_id", "y"]).withColumn("y", F.col("y") - F.lit(float(center)))
    folded = kfold(centered, k, seed=seed)
    return Prepared(cut_lineage(folded), binner, None, k)


def target_classes(df: DataFrame, target: str, bins: int = 10) -> DataFrame:
    """Add ``target_bin``: the target cut at its quantiles, for mutual information with a number."""
    coded, _ = encode_target(df, target, "regression")
    edges = exact_quantiles(coded, {"y": [i / bins for i in range(1, bins)]})["y"]
    cuts = F.array(*[F.lit(e) for e in sorted(set(edges))])
    below = F.size(F.filter(cuts, lambda e: e < F.col("y"))).cast("bigint")
    return coded.withColumn("target_bin", below).drop("y")


def cell_sums(rows: DataFrame, labels: Sequence[str], by: Sequence[str]) -> DataFrame:
    copies = F.array(*[F.struct(F.lit(i).alias("replica"), F.col(c).alias("label")) for i, c in enumerate(labels)])
    long = rows.select(*by, "cells", F.explode(copies).alias("r")).select(*by, "r.*", F.explode("cells").alias("cell"))
    return long.groupBy("replica", *by, "cell").agg(F.count("*").alias("n"), F.sum("label").alias("s"))


def sums_array(table: DataFrame, shape: Sequence[int], keys: Sequence[str], values: Sequence[str]) -> np.ndarray:
    """Grouped sums as an array [*keys, value]; holds no rows."""
    if math.prod(shape) * len(values) > MAX_MODEL_CELLS:
        raise ValueError("too many cells for a model")
    out = np.zeros((*shape, len(values)))
    for row in table.collect():
        out[tuple(int(row[k]) for k in keys)] = [row[v] or 0.0 for v in values]
    return out


def deviations(train: np.ndarray, binner: Binner) -> tuple[np.ndarray, np.ndarray]:
    """Weights [..., 1, cell] and means [..., 1] from sums [..., cell, (n, s)]."""
    n, s = train[..., 0], train[..., 1]
    first = slice(0, binner.sizes[0])
    count = np.maximum(n[..., first].sum(-1), 1)
    mean = s[..., first].sum(-1) / count
    weights = (s - n * mean[..., None]) / (n + 1)
    return weights[..., None, :], mean[..., None]


def score_sums(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    s, y = F.col("s"), F.col("y")
    parts = dict(zip(SUMS, (F.lit(1.0), s, y, s * s, s * y, y * y)))
    return scored.groupBy(*by).agg(*[F.sum(c).alias(f"v_{n}") for n, c in parts.items()])


def r2_from_sums(fit: np.ndarray, held: np.ndarray) -> np.ndarray:
    """R2 on ``held`` of the line fitted on ``fit``; both [..., six sums]."""
    n, s, y, ss, sy, _ = np.moveaxis(fit, -1, 0)
    n = np.maximum(n, 1)
    spread = ss - s * s / n
    slope = np.divide(sy - s * y / n, spread, out=np.zeros_like(spread), where=spread > 1e-12)
    at = (y - slope * s) / n
    hn, hs, hy, hss, hsy, hyy = np.moveaxis(held, -1, 0)
    miss = hyy - 2 * at * hy - 2 * slope * hsy + hn * at**2 + 2 * at * slope * hs + slope**2 * hss
    total = hyy - hy * hy / np.maximum(hn, 1)
    return 1 - np.divide(miss, total, out=np.full_like(miss, np.nan), where=total > 0)


def _out_of_fold_r2(own: np.ndarray, fold_axis: int) -> np.ndarray:
    return r2_from_sums(own.sum(axis=fold_axis, keepdims=True) - own, own)


def signal_check(prep: Prepared, shuffles: int = 3, salt: str = "labels") -> DataFrame:
    salts = {f"y{r}": f"{salt}{r}" for r in range(1, shuffles + 1)}
    rows = cut_lineage(shuffle_column(prep.rows, "y", salts))
    labels = ["y", *salts]
    shape = (len(labels), prep.k, prep.binner.n_cells)
    own = sums_array(cell_sums(rows, labels, ["fold"]), shape, ["replica", "fold", "cell"], ["n", "s"])
    weights, means = deviations(np.swapaxes(own.sum(axis=1, keepdims=True) - own, 0, 1), prep.binner)
    spark, n = rows.sparkSession, len(prep.binner.names)
    scored = with_models(rows, models_frame(spark, weights, means))
    copies = F.array(*[
        F.struct(F.lit(i).alias("replica"), logit(i, n).alias("s"), F.col(label).alias("y")) for i, label in enumerate(labels)])
    sums = score_sums(scored.select("fold", F.explode(copies).alias("r")).select("fold", "r.*"), ["replica", "fold"])
    table = sums_array(sums, (len(labels), prep.k), ["replica", "fold"], [f"v_{c}" for c in SUMS])
    scores = np.nanmean(_out_of_fold_r2(table, 1), axis=1)
    return signal_summary(spark.createDataFrame([(i, float(x)) for i, x in enumerate(scores)], "replica int, score double"))


def learning_curve(prep: Prepared, sizes: Sequence[float] = SIZES, seed: int = 0) -> DataFrame:
    rows = learning_sizes(prep.rows, sizes, seed=seed)
    shape = (1, len(sizes), prep.k, prep.binner.n_cells)
    own = sums_array(cell_sums(rows, ["y"], ["_size", "fold"]), shape, ["replica", "_size", "fold", "cell"], ["n", "s"])[0]
    nested = own.cumsum(axis=0)
    train = nested.sum(axis=1, keepdims=True) - nested
    weights, means = deviations(np.swapaxes(train, 0, 1), prep.binner)
    n_train = train[..., : prep.binner.sizes[0], 0].sum(-1).mean(1)
    spark, n = rows.sparkSession, len(prep.binner.names)
    every = rows.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(prep.k - 1)).cast("array<bigint>")))
    scored = with_models(every, models_frame(spark, weights, means), "_at")
    own_fold = F.col("fold") == F.col("_at")
    copies = F.array(*[
        F.when(own_fold | (F.col("_size") <= i), F.struct(F.lit(i).alias("size_index"), logit(i, n).alias("s")))
        for i in range(len(sizes))])
    long = scored.select("_at", "y", own_fold.cast("int").alias("held"), F.explode(copies).alias("r")).filter("r is not null")
    sums = score_sums(long.select("_at", "y", "held", "r.*"), ["size_index", "_at", "held"])
    table = sums_array(sums, (len(sizes), prep.k, 2), ["size_index", "_at", "held"], [f"v_{c}" for c in SUMS])
    fit, held = table[:, :, 0], table[:, :, 1]
    train_r2, valid_r2 = np.nanmean(r2_from_sums(fit, fit), 1), np.nanmean(r2_from_sums(fit, held), 1)
    return spark.createDataFrame(
        [(float(s), float(n_train[i]), float(train_r2[i]), float(valid_r2[i])) for i, s in enumerate(sizes)],
        "size double, n_train double, score_train double, score_valid double")


def fold_gains(prep: Prepared, base: Sequence[str], sets: dict[str, Sequence[str]]) -> DataFrame:
    """(candidate, fold, value, base) in R2, as for classes."""
    names = list(prep.binner.names)
    position = {n: i for i, n in enumerate(names)}
    own = sums_array(
        cell_sums(prep.rows, ["y"], ["fold"]), (1, prep.k, prep.binner.n_cells), ["replica", "fold", "cell"], ["n", "s"])[0]
    weights, means = deviations(own.sum(axis=0, keepdims=True) - own, prep.binner)
    spark = prep.rows.sparkSession
    scored = with_models(prep.rows, models_frame(spark, weights, means))
    scored = scored.withColumn("_base", logit(0, len(names), only=[position[c] for c in base if c in position]))

    def entry(index: int, extra: Sequence[str]) -> Column:
        total = F.col("_base")
        for e in extra:
            if e in position:
                total = total + F.get(F.col("w").getItem(0), F.col("cells").getItem(position[e]))
        return F.struct(F.lit(index).alias("candidate"), total.alias("s"))

    order = ["", *sets]
    entries = F.array(*[entry(i, sets.get(n, ())) for i, n in enumerate(order)])
    long = scored.select("fold", "y", F.explode(entries).alias("e")).select("fold", "y", "e.*")
    sums = score_sums(long, ["candidate", "fold"])
    table = sums_array(sums, (len(order), prep.k), ["candidate", "fold"], [f"v_{c}" for c in SUMS])
    r2 = _out_of_fold_r2(table, 1)
    rows = [(n, f, float(r2[i, f]), float(r2[0, f])) for i, n in enumerate(order) if n for f in range(prep.k)]
    return spark.createDataFrame(rows, "candidate string, fold bigint, value double, base double")
