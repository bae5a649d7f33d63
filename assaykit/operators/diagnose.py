"""Where and how a run's predictions fail."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import exact_quantiles, running_fold
from ..session import cut_lineage
from .align import annotate
from .resample import subsample_rows

MIN_BUCKET = 10
TOP_VALUES = 8
MANY_VALUES = 10


def row_error(preds: DataFrame, task: str = "classification") -> DataFrame:
    """Add ``error``: 1 for a mismatch (missing counts as one), or the absolute error."""
    if task == "classification":
        error = F.when(F.coalesce(F.col("y_true") == F.col("y_pred"), F.lit(False)), 0.0).otherwise(1.0)
    else:
        error = F.abs(F.col("y_true").cast("double") - F.col("y_pred").cast("double"))
    return preds.withColumn("error", error)


def is_number(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def numeric_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    return [f.name for f in df.schema.fields if f.name in features and is_number(f)]


def rough_distinct(columns: Sequence[str]) -> list[Column]:
    return [F.approx_count_distinct(c, 0.02).alias(f"c{i}") for i, c in enumerate(columns)]


def distinct_up_to(
    df: DataFrame, columns: Sequence[str], limit: int, rough: Sequence[int] | None = None
) -> dict[str, int]:
    """Distinct values per column, exact up to ``limit`` and ``limit + 1`` beyond.

    A sketch settles the clear cases (``rough``, when the caller has it already); exact counting is
    only done for columns near the limit, whose values are few.
    """
    if not columns:
        return {}
    rough = df.agg(*rough_distinct(columns)).first() if rough is None else rough
    near = [c for i, c in enumerate(columns) if rough[i] <= 4 * limit + 20]
    out = dict.fromkeys(columns, limit + 1)
    if near:
        exact = df.agg(*[F.countDistinct(c).alias(f"c{i}") for i, c in enumerate(near)]).first()
        out.update({c: min(exact[i], limit + 1) for i, c in enumerate(near)})
    return out


def bucket_by_edges(column: Column, edges: Sequence[float], name: str = "q") -> Column:
    """Right-closed buckets ``q1``, ``q2``, ... over sorted inner and outer edges; missing is ``nan``."""
    unique = sorted({e for e in edges if e is not None and e == e})
    bucket = F.when(column.isNull() | F.isnan(column.cast("double")), F.lit("nan"))
    for i, edge in enumerate(unique[1:], start=1):
        bucket = bucket.when(column <= F.lit(edge), F.lit(f"{name}{i}"))
    return bucket.otherwise(F.lit(f"{name}{max(1, len(unique) - 1)}"))


QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


def quartile_buckets(df: DataFrame, columns: Sequence[str], n_rows: int | None = None) -> dict[str, Column]:
    edges = exact_quantiles(df, {c: QUARTILES for c in columns}, n_rows=n_rows)
    return {
        c: bucket_by_edges(F.col(c), e) for c, e in edges.items() if e[0] is not None and len(set(e)) > 1
    }


def quartile_bucket(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("bucket", quartile_buckets(df, [column])[column])


def as_text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("nan"))


def top_values(cells: DataFrame, top: int = TOP_VALUES) -> DataFrame:
    """The ``top`` most frequent values per feature, from (feature, value, n) cells.

    The rank filter is applied before the shuffle as well, so a feature with very many values
    sends only a few of them per task.
    """
    order = Window.partitionBy("feature").orderBy(F.desc("n"), "value")
    return cells.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top).drop("_r")


def value_cells(df: DataFrame, columns: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """(feature, value, sums) over text columns: one pass, one shuffle for all columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), as_text(F.col(c)).alias("value")) for c in columns])
    long = df.select(*[c.alias(n) for n, c in sums.items()], F.explode(pairs).alias("e"))
    return long.groupBy("e.feature", "e.value").agg(*[F.sum(n).alias(n) for n in sums])


def top_values_other(df: DataFrame, column: str, top: int = TOP_VALUES) -> DataFrame:
    """Frequent values and ``(other)`` with their counts."""
    cells = value_cells(df, [column], {"n": F.lit(1)})
    kept = top_values(cells, top).select("feature", "value", F.lit(True).alias("_kept"))
    named = cells.join(F.broadcast(kept), ["feature", "value"], "left")
    return named.groupBy(
        "feature", F.when(F.col("_kept"), F.col("value")).otherwise("(other)").alias("bucket")
    ).agg(F.sum("n").alias("n"))


def slice_cells(
    rows: DataFrame, features: Sequence[str], n_rows: int | None = None, rough: Sequence[int] | None = None
) -> DataFrame:
    """(feature, bucket, n, error sum) over all sliced features.

    Numeric features with more than ten values are cut at their quartiles, all others are counted
    by value, and values outside the most frequent eight are merged into ``(other)`` afterwards.
    """
    features = list(features)
    numeric = numeric_features(rows, features)
    many = distinct_up_to(rows, numeric, MANY_VALUES, rough)
    cut = [c for c in numeric if many[c] > MANY_VALUES]
    by_value = [c for c in features if c not in cut]
    parts = []
    if cut:
        buckets = quartile_buckets(rows, cut, n_rows)
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), b.alias("bucket")) for c, b in buckets.items()])
        long = rows.select("error", F.explode(pairs).alias("e"))
        parts.append(long.groupBy("e.feature", "e.bucket").agg(
            F.count("*").alias("n"), F.sum("error").alias("total")))
    if by_value:
        cells = value_cells(rows, by_value, {"n": F.lit(1).cast("bigint"), "total": F.col("error")})
        kept = top_values(cells).select("feature", "value", F.lit(True).alias("_kept"))
        named = cells.join(F.broadcast(kept), ["feature", "value"], "left")
        bucket = F.when(F.col("_kept"), F.col("value")).otherwise("(other)").alias("bucket")
        parts.append(named.groupBy("feature", bucket).agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    return reduce(DataFrame.unionByName, parts)


def error_slices(
    rows: DataFrame, features: Sequence[str], meanings: DataFrame | None = None, top: int = 8
) -> DataFrame:
    """The segments with the highest error relative to the overall error.

    The sliced columns are written once: thresholds, edges and counts each read them again, and
    ``rows`` usually is the result of a join.
    """
    features = list(features)
    rows = cut_lineage(rows.select("error", *features))
    n, overall, *rough = rows.agg(
        F.count("*"), F.avg("error"), *rough_distinct(numeric_features(rows, features))).first()
    if not n or not overall:
        overall = 0.0
    smallest = max(MIN_BUCKET, int(0.02 * n))
    rate = F.col("total") / F.col("n")
    worse = (
        slice_cells(rows, features, n, rough).filter((F.col("n") >= smallest) & (rate > F.lit(overall)))
        .filter(F.lit(overall > 0))
        .select("feature", "bucket", "n", F.round(rate, 4).alias("error"),
                F.round(rate / F.lit(overall or 1.0), 2).alias("lift"))
        .orderBy(F.desc("lift"), F.desc("n"), "feature", "bucket").limit(top)
    )
    return annotate(worse, meanings) if meanings is not None else worse


# --- labels and scores --------------------------------------------------------------------------


def confusion(preds: DataFrame) -> DataFrame:
    """Count per (true, predicted) pair that occurs; pairs that never occur have no row."""
    return preds.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


def confused_pairs(preds: DataFrame, top: int = 5) -> DataFrame:
    return (
        confusion(preds).filter("y_true <> y_pred").orderBy(F.desc("n"), "y_true", "y_pred").limit(top)
    )


def calibration_bins(preds: DataFrame, proba: str, positive) -> DataFrame:
    """Ten equal-width bins: rows, mean confidence, observed rate."""
    p = F.col(proba).cast("double")
    hit = F.when(F.col("y_true") == F.lit(positive), 1.0).otherwise(0.0)
    bin_ = F.least(F.greatest((p * 10).cast("int"), F.lit(0)), F.lit(9))
    return preds.groupBy(bin_.cast("bigint").alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg(hit).alias("observed")
    )


def calibration_error(bins: DataFrame) -> DataFrame:
    gap = F.abs(F.col("observed") - F.col("confidence"))
    ece = F.sum(gap * F.col("n")) / F.sum("n")
    level = (
        F.when(F.col("ece") < 0.05, "well calibrated").when(F.col("ece") < 0.15, "moderately miscalibrated")
        .otherwise("badly miscalibrated")
    )
    return bins.agg(ece.alias("ece")).withColumn("quality", level)


def class_counts(preds: DataFrame) -> DataFrame:
    return preds.filter("y_true is not null").groupBy("y_true").agg(F.count("*").alias("n"))


def class_balance(preds: DataFrame) -> DataFrame:
    ratio = (F.max("n") / F.min("n")).alias("imbalance_ratio")
    r = F.col("imbalance_ratio")
    level = F.when(r < 2, "balanced").when(r < 10, "imbalanced").otherwise("severely imbalanced")
    return class_counts(preds).agg(F.count("*").alias("n_classes"), ratio).withColumn("level", level)


def residual_stats(preds: DataFrame) -> DataFrame:
    """Bias, spread and correlation of error size with the prediction; flags for the first and last."""
    y, p = F.col("y_true").cast("double"), F.col("y_pred").cast("double")
    gap = y - p
    # corr() itself fails on a column without spread
    spread = F.stddev_pop(p) * F.stddev_pop(F.abs(gap))
    corr = F.when((F.count(gap) > 2) & (spread > 0), F.covar_pop(p, F.abs(gap)) / spread)
    out = preds.agg(
        F.count(gap).alias("n"), F.avg(gap).alias("bias"), F.stddev_pop(gap).alias("residual_std"),
        F.coalesce(F.nanvl(corr, F.lit(0.0)), F.lit(0.0)).alias("heteroscedasticity_corr"),
        F.stddev_pop(y).alias("_sd"),
    )
    return out.select(
        "n", "bias", "residual_std", "heteroscedasticity_corr",
        (F.abs("bias") > 0.05 * (F.col("_sd") + 1e-12)).alias("biased"),
        (F.abs("heteroscedasticity_corr") > 0.3).alias("heteroscedastic"),
    )


def residual_sample(preds: DataFrame, rows: int = 2000, seed: int = 0) -> DataFrame:
    """At most ``rows`` points for a residual plot, the same ones every time."""
    return subsample_rows(preds, rows, seed=seed, salt="residual").select(
        "row_id", F.col("y_pred").alias("prediction"),
        (F.col("y_true").cast("double") - F.col("y_pred").cast("double")).alias("residual"))


def score_cells(preds: DataFrame, proba: str, positive) -> DataFrame:
    hit = F.col("y_true") == F.lit(positive)
    return preds.groupBy(F.col(proba).cast("double").alias("score")).agg(
        F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg")
    )


def roc_curve(preds: DataFrame, proba: str, positive) -> DataFrame:
    """False and true positive rate when selecting scores >= ``score``."""
    cells = score_cells(preds, proba, positive).withColumn("_down", -F.col("score"))
    run = running_fold(
        cells, [], "_down", {"tp": ("sum", F.col("pos"), True), "fp": ("sum", F.col("neg"), True)}
    )
    totals = cells.agg(F.sum("pos"), F.sum("neg")).first()
    pos, neg = max(totals[0] or 0, 1), max(totals[1] or 0, 1)
    return run.select("score", (F.col("fp") / neg).alias("fpr"), (F.col("tp") / pos).alias("tpr"))


OVERKILL_LEVELS = (0.05, 0.10, 0.20)
RECALL_LEVELS = (0.80, 0.90)


def operating_points(curve: DataFrame) -> DataFrame:
    """Recall within an allowed false-positive share, and the share that a wanted recall costs."""
    recalls = [
        F.struct(F.lit(f"recall_at_{round(x * 100)}pct_overkill").alias("point"),
                 F.coalesce(F.max(F.when(F.col("fpr") <= x, F.col("tpr"))), F.lit(0.0)).alias("value"))
        for x in OVERKILL_LEVELS
    ]
    costs = [
        F.struct(F.lit(f"overkill_for_{round(r * 100)}pct_recall").alias("point"),
                 F.min(F.when(F.col("tpr") >= r, F.col("fpr"))).alias("value"))
        for r in RECALL_LEVELS
    ]
    table = curve.agg(F.array(*recalls, *costs).alias("points"))
    return table.select(F.explode("points").alias("p")).select("p.point", F.round("p.value", 3).alias("value"))


def degenerate_scores(preds: DataFrame, proba: str) -> DataFrame:
    """Number of distinct scores, counted up to three, and whether ranking means anything."""
    few = preds.select(F.col(proba).cast("double").alias("s")).filter("s is not null").distinct().limit(3)
    return few.agg(F.count("*").alias("n_distinct")).withColumn("degenerate", F.col("n_distinct") < 3)


def missed_positives(preds: DataFrame, positive) -> DataFrame:
    true = F.col("y_true") == F.lit(positive)
    said = F.col("y_pred").eqNullSafe(F.lit(positive))
    return preds.agg(F.count_if(true & ~said).alias("n_missed"), F.count_if(true & said).alias("n_caught"))


def missed_split(missed: DataFrame, scores: DataFrame) -> DataFrame:
    """Of the missed rows, how many does an out-of-fold reference model also score below one half?"""
    hit = scores.join(missed.select("row_id"), "row_id", "left_semi")
    low = F.avg(F.when(F.col("p") < 0.5, 1.0).otherwise(0.0))
    return hit.agg(
        F.count("*").alias("n_missed"), F.round(low, 3).alias("fraction_feature_limited"),
        F.round(1 - low, 3).alias("fraction_learnable"), F.round(F.avg("p"), 3).alias("mean_oof_proba"),
    )


def overfit_gap(runs: DataFrame, metric: str, maximize: bool, limit: float = 0.05) -> DataFrame:
    """Training minus validation value in the good direction, from a map of reported metrics."""
    train, valid = F.col("metrics")[f"train_{metric}"], F.col("metrics")[metric]
    gap = (train - valid) if maximize else (valid - train)
    level = (
        F.when(gap.isNull(), "not measurable").when(gap > limit, "likely overfitting").otherwise("small gap")
    )
    return runs.select("run_id", train.alias("train"), valid.alias("validation"), gap.alias("gap"),
                       level.alias("level"))
