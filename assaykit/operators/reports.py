"""Whole reports as (item, key, value) rows of text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import Metric, context_for, resolve_metric
from ..session import cut_lineage
from . import align, forensics, learners, models, regression
from . import diagnose as d
from .forensics import long_items
from .resample import noise_floor

_FLOOR = ("n_boot", "mean", "std", "ci_low", "ci_high", "min_significant_delta")


def metric_floor(preds: DataFrame, metric: str | Metric, task: str, n_boot: int = 200) -> DataFrame:
    """One row: the noise floor in the goal's metric.

    ``requested`` is the goal's metric and ``metric`` the one resampled; they differ (``fallback``) where the
    goal names a metric that is not known. ``status`` is ``ok``, ``needs_probabilities`` or
    ``too_few_valid_resamples``; only the first has figures.
    """
    chosen, fallback = (metric, False) if isinstance(metric, Metric) else resolve_metric(metric, task)
    requested = metric.name if isinstance(metric, Metric) else metric
    ctx = context_for(chosen, preds)
    status, found = "needs_probabilities", None
    if ctx.proba is not None or not chosen.needs_proba:
        # one row, with a number per figure
        found = noise_floor(preds, chosen, n_boot=n_boot, ctx=ctx).first()
        status = "ok" if found else "too_few_valid_resamples"
    row = (requested, chosen.name, fallback, status)
    if found is None:
        return preds.sparkSession.createDataFrame([row], "requested string, metric string, fallback boolean, status string")
    return preds.sparkSession.createDataFrame(
        [(*row, *[found[c] for c in _FLOOR])],
        "requested string, metric string, fallback boolean, status string, n_boot bigint, mean double, std double, "
        "ci_low double, ci_high double, min_significant_delta double")


def run_diagnosis(
    preds: DataFrame, dataset: DataFrame, target: str, features: Sequence[str], task: str, metric: str | Metric,
    maximize: bool = True, run_metrics: Mapping[str, float] | None = None, n_boot: int = 200,
) -> DataFrame:
    """All diagnostics of one run that its task and its predictions allow.

    ``preds`` holds row_id, y_true, y_pred and any probabilities. Slices are numbered from the worst. With two
    labels the missed positives are counted, with probabilities too calibration and operating points; numeric
    targets have residuals instead of labels. ``run_metrics`` are what the run reported of itself.
    """
    preds = cut_lineage(preds)
    rows = cut_lineage(d.row_error(align.join_features(preds, dataset, target), task).select("error", *features))
    name = "error rate" if task == "classification" else "absolute error"
    parts = {
        "overall": rows.agg(F.count("*").alias("n"), F.lit(name).alias("error_name"), F.avg("error").alias("error")),
        "noise_floor": metric_floor(preds, metric, task, n_boot),
    }
    if task == "classification":
        parts["confusion"] = d.confused_pairs(preds, 1)
        parts["class_balance"] = d.class_balance(preds)
        ctx = context_for(resolve_metric(None, task)[0], preds)
        if ctx.n_labels == 2:
            parts["missed_positives"] = d.missed_positives(preds, ctx.positive)
            if ctx.proba is not None:
                parts["calibration"] = d.calibration_error(d.calibration_bins(preds, ctx.proba, ctx.positive))
                parts["scores"] = d.degenerate_scores(preds, ctx.proba)
                points = d.operating_points(d.roc_curve(preds, ctx.proba, ctx.positive))
                parts["operating_curve"] = points.agg(*[
                    F.max(F.when(F.col("point") == p, F.col("value"))).alias(p) for p in POINTS])
    else:
        parts["residuals"] = d.residual_stats(preds)
    if run_metrics is not None:
        asked = metric.name if isinstance(metric, Metric) else metric
        reported = preds.sparkSession.createDataFrame([("run", dict(run_metrics))], "run_id string, metrics map<string,double>")
        parts["overfit_gap"] = d.overfit_gap(reported, asked, maximize).drop("run_id")
    out = long_items(parts)
    # at most eight rows
    slices = d.error_slices(rows, features)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("lift"), F.desc("n"), "feature", "bucket"))
    ranked = slices.withColumn("_item", F.concat(F.lit("error_slice_"), place.cast("string")))
    return out.unionByName(long_items({"": ranked}, "_item"))


def run_forensics(
    df: DataFrame, target: str, features: Sequence[str], task: str, quick: bool = False, reference: bool = False,
) -> DataFrame:
    """What limits models of this dataset: the battery for labels or for a numeric target.

    ``input`` has the rows used, the features kept and the columns dropped. Labels also get the estimated
    label noise and the number of suspects listed, two labels the leakage check. A numeric target has no
    lower bound of the error from duplicates, so its verdict is signal and curve. ``reference`` adds the
    scores of trained models. ``quick`` uses fewer shuffles, sizes and folds.
    """
    df = cut_lineage(df.select("row_id", target, *features))
    k = 3 if quick else 5
    if task == "classification":
        prep = learners.prepare(df, target, features, k=k)
        parts = forensics.forensics_parts(prep, df, features, target, quick)
        flagged = forensics.flag_issues(learners.out_of_fold(prep), len(prep.classes))
        parts["label_suspects"] = forensics.label_suspects(flagged, prep.classes).agg(
            F.count("*").alias("n_listed"), F.min("quality").alias("lowest_quality"))
    else:
        prep = regression.prepare_regression(df, target, features, k=k)
        signal = regression.signal_check(prep, 2 if quick else 3)
        conflicts = forensics.conflict_spread(df, features, target)
        curve = forensics.curve_verdict(regression.learning_curve(prep, forensics.QUICK_SIZES if quick else forensics.SIZES))
        binned = learners.prepare(regression.target_classes(df, target), "target_bin", features)
        parts = {
            "signal_check": signal, "conflict_rate": conflicts, "learning_curve": curve,
            "feature_signal": forensics.feature_signal(binned, 1).select("feature", "mutual_info"),
            "verdict": forensics.verdict(signal, None, conflicts.withColumn("_bound", F.lit(0.0)), curve, "_bound"),
        }
    dropped = ",".join(c for c in features if c not in prep.binner.names)
    parts["input"] = prep.rows.agg(
        F.count("*").alias("n_rows"), F.lit(len(prep.binner.names)).alias("n_features"), F.lit(dropped).alias("dropped"),
        F.lit(prep.scoring).alias("scoring"))
    out = long_items(parts)
    if reference:
        rows, classes = models.folded_vectors(df, target, features, task, k)
        band = models.reference_band(rows, classes, k, rounds=60 if quick else 200)
        out = out.unionByName(long_items(
            {"": band.withColumn("_item", F.concat(F.lit("reference_"), F.col(band.columns[0]).cast("string")))}, "_item"))
    return out


POINTS = tuple(
    [f"recall_at_{round(x * 100)}pct_overkill" for x in d.OVERKILL_LEVELS]
    + [f"overkill_for_{round(x * 100)}pct_recall" for x in d.RECALL_LEVELS])
