"""What would averaging the existing runs be worth?"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import Context, Metric, context_for
from ..functions.ordering import exact_quantiles
from .align import Aligned, align
from .resample import bar_of, paired_std

ENSEMBLE = "ensemble"


def _members(pair: Aligned, column: str) -> list:
    return [F.col(f"{column}__{i}") for i in range(len(pair.runs))]


def _mean(columns: list):
    return sum(columns[1:], columns[0]) / len(columns)


def mean_proba(pair: Aligned, proba: str = "proba_1") -> DataFrame:
    """row_id, y_true and the members' mean probability."""
    members = [c.cast("double") for c in _members(pair, proba)]
    return pair.wide.select("row_id", *_shared(pair), _mean(members).alias("proba_1"))


def _shared(pair: Aligned) -> list:
    """True label and columns that belong to the row, such as a weight, from the first member."""
    own = [c for c in pair.columns if c != "y_pred" and not c.startswith("proba_")]
    return [F.col(f"{c}__0").alias(c) for c in own]


def selection_threshold(pair: Aligned, mean: DataFrame, positive) -> tuple[float, float]:
    """Share of rows the members select on average (kept within 1-99 %) and the matching cut."""
    hits = [F.avg((c == F.lit(positive)).cast("double")) for c in _members(pair, "y_pred")]
    rates = pair.wide.agg(*[h.alias(f"r{i}") for i, h in enumerate(hits)]).first()
    rate = min(max(sum(rates) / len(rates), 0.01), 0.99)
    return rate, exact_quantiles(mean, {"proba_1": [1 - rate]})["proba_1"][0]


def vote(pair: Aligned, ctx: Context) -> DataFrame:
    """Prediction by vote: positive when at least half the members say so; most frequent label, the
    smallest among equals, when there are more than two labels."""
    members = _members(pair, "y_pred")
    if ctx.n_labels <= 2:
        share = _mean([(m == F.lit(ctx.positive)).cast("double") for m in members])
        label = F.when(share >= 0.5, F.lit(ctx.positive)).otherwise(F.lit(ctx.negative))
    else:
        ballots = F.array(*members)
        counted = F.transform(
            F.sort_array(F.array_distinct(ballots)),
            lambda v: F.struct(F.size(F.filter(ballots, lambda b: b == v)).alias("n"), v.alias("v")),
        )
        most = F.array_max(F.transform(counted, lambda c: c["n"]))
        label = F.filter(counted, lambda c: c["n"] == most)[0]["v"]
    return pair.wide.select("row_id", *_shared(pair), label.alias("y_pred"))


def mean_prediction(pair: Aligned) -> DataFrame:
    members = [c.cast("double") for c in _members(pair, "y_pred")]
    return pair.wide.select("row_id", *_shared(pair), _mean(members).alias("y_pred"))


def ensemble_rows(pair: Aligned, task: str, ctx: Context) -> DataFrame:
    """The ensemble as one more run, on the common rows."""
    if task == "regression":
        out = mean_prediction(pair)
    elif ctx.proba is not None:
        mean = mean_proba(pair, ctx.proba)
        _, cut = selection_threshold(pair, mean, ctx.positive)
        chosen = F.when(F.col("proba_1") >= cut, F.lit(ctx.positive)).otherwise(F.lit(ctx.negative))
        out = mean.withColumn("y_pred", chosen).withColumnRenamed("proba_1", ctx.proba)
    else:
        out = vote(pair, ctx)
    return out.withColumn("run_id", F.lit(ENSEMBLE))


def member_scores(pair: Aligned, metric: Metric, ctx: Context) -> DataFrame:
    rows = pair.long()
    return metric.finish(metric.cells(rows, ["run_id"], ctx), ["run_id"], ctx)


def ensemble_probe(
    preds: DataFrame, runs: Sequence[str], metric: Metric, task: str = "classification",
    maximize: bool | None = None, n_boot: int = 200, seed: int = 0, columns: Sequence[str] = (),
) -> DataFrame:
    """One row: best single run, ensemble score, paired gain and verdict. ``columns`` names what a
    metric of one's own reads besides labels, predictions, scores and ``weight``.

    Raises ``ValueError`` when the runs share too few rows, disagree on labels, or fewer than two
    can be scored.
    """
    named = [c for c in preds.columns if c in ("y_true", "y_pred", "weight") or c.startswith("proba_")]
    pair = align(preds, runs, [*named, *[c for c in columns if c not in named]])
    if not pair.enough:
        raise ValueError(f"the runs share only {pair.n_common} rows")
    differs = [~F.col(f"y_true__{i}").eqNullSafe(F.col("y_true__0")) for i in range(1, len(pair.runs))]
    if not pair.wide.filter(reduce(lambda a, b: a | b, differs, F.lit(False))).isEmpty():
        raise ValueError("the runs were scored against different true labels on shared rows")
    rows = pair.long()
    ctx = context_for(metric, rows)
    maximize = metric.higher_is_better if maximize is None else maximize
    sign = 1.0 if maximize else -1.0
    everything = rows.unionByName(ensemble_rows(pair, task, ctx), allowMissingColumns=True)
    scores = {
        r["run_id"]: r["value"]
        for r in metric.finish(metric.cells(everything, ["run_id"], ctx), ["run_id"], ctx).collect()
    }
    scored = {run: scores[run] for run in runs if scores.get(run) is not None}
    if len(scored) < 2:
        raise ValueError("fewer than two member runs could be scored")
    best = max(scored, key=lambda run: sign * scored[run])
    gain = sign * (scores[ENSEMBLE] - scored[best])
    spread = paired_std(everything, metric, ctx, best, ENSEMBLE, n_boot, seed, needed=20)
    bar = bar_of(F.col("paired_std"))
    worth = F.coalesce(F.lit(gain) > bar, F.lit(False))
    return spread.select(
        F.lit(pair.n_common).cast("bigint").alias("n_common"), F.lit(best).alias("best_run"),
        F.lit(scored[best]).alias("best_value"), F.lit(scores[ENSEMBLE]).alias("ensemble_value"),
        F.lit(gain).alias("gain"), "paired_std", bar.alias("bar"),
        F.when(worth, "ensemble_worth_testing").otherwise("ensemble_unlikely_to_help").alias("verdict"),
    )
