"""Metrics as three small shapes, each computed from additive cells.

A metric says which cells it needs (``cell_keys``), which sums per cell (``cell_sums``), and how
to finish the value from the cells of a group. Because all sums are additive, the same metric
serves one table, many runs in one pass, and bootstrap replicas: resampling only multiplies the
sums with a weight before they are added up again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import ROWS_PER_CHUNK, running_fold

EPSILON = 2.220446049250313e-16


def positive_proba(columns: Sequence[str]) -> str | None:
    """Name of the positive-class probability column, if it can be told from the names."""
    named = sorted(c for c in columns if c.startswith("proba_"))
    return named[-1] if len(named) in (1, 2) else None


@dataclass(frozen=True)
class Context:
    """What a metric must know about the whole table before it can be written as columns."""

    positive: object = None
    negative: object = None
    n_labels: int = 2
    proba: str | None = None
    weight: str | None = None
    #: Subtracted from numeric targets before squares are added up, so that a large offset does not cancel.
    center: float = 0.0

    def is_positive(self, column: str) -> Column:
        return F.col(column) == F.lit(self.positive)


def context_of(preds: DataFrame, weight: str | None = None) -> Context:
    """Positive class (the largest true label), number of labels and probability column: one pass."""
    labels = preds.filter("y_true is not null").select("y_true").distinct()
    row = labels.agg(F.max("y_true"), F.min("y_true"), F.count("*")).first()
    return Context(row[0], row[1], row[2], positive_proba(preds.columns), weight)


@dataclass(frozen=True)
class Metric:
    name: str
    task: str
    needs_proba: bool = False
    aliases: tuple[str, ...] = ()
    higher_is_better: bool = True

    def cell_keys(self, ctx: Context) -> dict[str, Column]:
        return {}

    def cell_sums(self, ctx: Context) -> dict[str, Column]:
        raise NotImplementedError

    def finish(self, cells: DataFrame, by: list[str], ctx: Context) -> DataFrame:
        """One row per ``by`` group with ``value`` (null when not computable)."""
        raise NotImplementedError

    def computable(self, ctx: Context) -> bool:
        """A score of one class says nothing about three or more labels."""
        return not (self.needs_proba and ctx.n_labels > 2)

    def cells(self, preds: DataFrame, by: Sequence[str], ctx: Context) -> DataFrame:
        weight = F.col(ctx.weight).cast("double") if ctx.weight else F.lit(1.0)
        keys = [c.alias(n) for n, c in self.cell_keys(ctx).items()]
        sums = [F.sum(c.cast("double") * weight).alias(n) for n, c in self.cell_sums(ctx).items()]
        return preds.groupBy(*by, *keys).agg(*sums)


def context_for(metric: Metric, preds: DataFrame) -> Context:
    """Regression metrics need a centre of the targets only, and those are not worth grouping."""
    if metric.task != "regression":
        return context_of(preds)
    return Context(center=preds.agg(F.avg(F.col("y_true").cast("double"))).first()[0] or 0.0)


@dataclass(frozen=True)
class SumMetric(Metric):
    """A formula over plain sums of per-row expressions."""

    sums: Callable[[Context], dict[str, Column]] = None
    formula: Callable[[], Column] = None

    def cell_sums(self, ctx):
        return self.sums(ctx)

    def finish(self, cells, by, ctx):
        totals = [F.sum(n).alias(n) for n in self.sums(ctx)]
        grouped = cells.groupBy(*by).agg(*totals) if by else cells.agg(*totals)
        value = self.formula() if self.computable(ctx) else F.lit(None).cast("double")
        return grouped.select(*by, F.when(~F.isnan(value), value).alias("value"))


@dataclass(frozen=True)
class LabelMetric(Metric):
    """Precision, recall or F1: of the positive label when there are two, else the mean over labels."""

    part: Callable[[Column, Column, Column], Column] = None

    def cell_keys(self, ctx):
        return {"_t": F.col("y_true"), "_p": F.col("y_pred")}

    def cell_sums(self, ctx):
        return {"_w": F.lit(1.0)}

    def finish(self, cells, by, ctx):
        hit = F.col("_t") == F.col("_p")
        zero = F.lit(0.0)

        def entry(label, tp, fp, fn):
            return F.struct(label.alias("label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))

        entries = F.when(hit, F.array(entry(F.col("_t"), F.col("_w"), zero, zero))).otherwise(
            F.array(
                entry(F.col("_t"), zero, zero, F.col("_w")),
                entry(F.col("_p"), zero, F.col("_w"), zero),
            )
        )
        labels = (
            cells.select(*by, F.explode(entries).alias("e")).filter("e.label is not null")
            .groupBy(*by, F.col("e.label").alias("label"))
            .agg(F.sum("e.tp").alias("tp"), F.sum("e.fp").alias("fp"), F.sum("e.fn").alias("fn"))
        )
        scored = labels.select(*by, "label", self.part(F.col("tp"), F.col("fp"), F.col("fn")).alias("v"))
        if ctx.n_labels <= 2:
            scored = scored.withColumn("v", F.when(F.col("label") == F.lit(ctx.positive), F.col("v")))
            return scored.groupBy(*by).agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("value"))
        return scored.groupBy(*by).agg(F.avg("v").alias("value"))


@dataclass(frozen=True)
class RankMetric(Metric):
    """Area under the ROC curve; equal scores count half."""

    def cell_keys(self, ctx):
        return {"_s": F.col(ctx.proba).cast("double")}

    def cell_sums(self, ctx):
        hit = ctx.is_positive("y_true")
        return {"_pos": F.when(hit, 1.0).otherwise(0.0), "_neg": F.when(hit, 0.0).otherwise(1.0)}

    def finish(self, cells, by, ctx, bounded: bool = False):
        merged = cells.groupBy(*by, "_s").agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
        if bounded:
            span = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
            below = merged.withColumn("_below", F.coalesce(F.sum("_neg").over(span), F.lit(0.0)))
        else:
            below = running_fold(
                merged, by, "_s", {"_below": ("sum", F.col("_neg"), False)}, ROWS_PER_CHUNK
            )
        pos, neg = F.sum("_pos"), F.sum("_neg")
        area = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2))
        value = F.when((pos > 0) & (neg > 0) & F.lit(self.computable(ctx)), area / (pos * neg)).alias("value")
        return below.groupBy(*by).agg(value) if by else below.agg(value)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _accuracy_sums(ctx):
    return {"_n": F.lit(1.0), "_ok": F.when(F.col("y_true") == F.col("y_pred"), 1.0).otherwise(0.0)}


def _logloss_sums(ctx):
    p = F.greatest(F.least(F.col(ctx.proba).cast("double"), F.lit(1 - EPSILON)), F.lit(EPSILON))
    return {"_n": F.lit(1.0), "_l": -F.ln(F.when(ctx.is_positive("y_true"), p).otherwise(1 - p))}


def _square_sums(ctx):
    y, gap = F.col("y_true").cast("double"), F.col("y_true").cast("double") - F.col("y_pred").cast("double")
    near = y - F.lit(float(ctx.center))
    return {"_n": F.lit(1.0), "_se": gap * gap, "_ae": F.abs(gap), "_y": near, "_yy": near * near}


def _only(sums, *names):
    return lambda ctx: {n: c for n, c in sums(ctx).items() if n in names}


def _per(name: str) -> Column:
    return F.when(F.col("_n") > 0, F.col(name) / F.col("_n"))


def _r2() -> Column:
    spread = F.col("_yy") - F.col("_y") * F.col("_y") / F.col("_n")
    return F.when(spread > 0, 1 - F.col("_se") / spread)


REGISTRY: tuple[Metric, ...] = (
    RankMetric("auc", "classification", True, ("roc_auc",)),
    SumMetric("accuracy", "classification", False, ("acc",), True, _accuracy_sums, lambda: _per("_ok")),
    LabelMetric("f1", "classification", part=lambda tp, fp, fn: _ratio(2 * tp, 2 * tp + fp + fn)),
    LabelMetric("precision", "classification", part=lambda tp, fp, fn: _ratio(tp, tp + fp)),
    LabelMetric("recall", "classification", part=lambda tp, fp, fn: _ratio(tp, tp + fn)),
    SumMetric("logloss", "classification", True, ("log_loss",), False, _logloss_sums, lambda: _per("_l")),
    SumMetric("rmse", "regression", False, (), False, _only(_square_sums, "_n", "_se"),
              lambda: F.sqrt(_per("_se"))),
    SumMetric("mae", "regression", False, (), False, _only(_square_sums, "_n", "_ae"), lambda: _per("_ae")),
    SumMetric("r2", "regression", False, (), True, _only(_square_sums, "_n", "_se", "_y", "_yy"), _r2),
)

FALLBACK = {"classification": "accuracy", "regression": "rmse"}


def known_metric(name: str | None) -> Metric | None:
    wanted = (name or "").strip().lower()
    return next((m for m in REGISTRY if wanted == m.name or wanted in m.aliases), None)


def resolve_metric(name: str | None, task: str) -> tuple[Metric, bool]:
    """The named metric, or a computable default and ``True``."""
    metric = known_metric(name)
    return (metric, False) if metric else (known_metric(FALLBACK[task]), True)


def custom_metric(
    name: str,
    sums: dict[str, Column] | Callable[[Context], dict[str, Column]],
    formula: Callable[[], Column],
    task: str = "classification",
    higher_is_better: bool = True,
) -> Metric:
    """A user metric: per-row expressions to add up (any column of the predictions) and a formula.

    It runs as built-in aggregates, so it also works per run and per bootstrap replica.
    """
    as_call = sums if callable(sums) else (lambda ctx: sums)
    return SumMetric(name, task, False, (), higher_is_better, as_call, formula)


def approximate_median_significance(regularisation: float = 10.0) -> Metric:
    """Example of a weighted user metric: significance of the selected rows (weights in ``weight``)."""
    chosen = lambda ctx: ctx.is_positive("y_pred")
    sums = lambda ctx: {
        "_s": F.when(chosen(ctx) & ctx.is_positive("y_true"), F.col("weight")).otherwise(0.0),
        "_b": F.when(chosen(ctx) & ~ctx.is_positive("y_true"), F.col("weight")).otherwise(0.0),
    }
    s, b = F.col("_s"), F.col("_b") + regularisation
    return custom_metric("ams", sums, lambda: F.sqrt(2 * ((s + b) * F.ln(1 + s / b) - s)))
