"""Whole reports: what each task and table allows, and the goal's metric."""

import pytest
from pyspark.sql import functions as F

from assaykit.functions.metrics import approximate_median_significance
from assaykit.operators import reports


def tables(spark, labels):
    ids = spark.range(400).withColumnRenamed("id", "row_id")
    data = ids.select("row_id", (F.col("row_id") % 4).alias("part"), (F.col("row_id") % labels).alias("target"))
    wrong = F.when(F.col("part") == 3, (F.col("target") + 1) % labels).otherwise(F.col("target"))
    preds = data.select("row_id", F.col("target").alias("y_true"), wrong.alias("y_pred"))
    return preds, data


def as_dict(report):
    return {(r["item"], r["key"]): r["value"] for r in report.collect()}


def test_two_labels_with_probabilities(spark):
    preds, data = tables(spark, 2)
    preds = preds.withColumn("proba_1", 0.2 + 0.6 * F.col("y_pred")).withColumn("weight", F.lit(1.0))
    report = as_dict(reports.run_diagnosis(
        preds, data, "target", ["part"], "classification", "auc", run_metrics={"auc": 0.7, "train_auc": 0.9}, n_boot=40))
    assert report["overall", "error"] == "0.250000" and report["error_slice_1", "bucket"] == "3"
    assert report["noise_floor", "metric"] == "auc" and report["noise_floor", "fallback"] == "false"
    assert report["missed_positives", "n_missed"] == "100" and report["overfit_gap", "level"] == "likely overfitting"
    assert ("operating_curve", "recall_at_5pct_overkill") in report and ("residuals", "bias") not in report
    own = as_dict(reports.metric_floor(preds, approximate_median_significance(), "classification", 40).select(
        F.lit("f").alias("item"), F.lit("metric").alias("key"), F.concat_ws(",", "metric", "status").alias("value")))
    assert own["f", "metric"] == "ams,ok"


def test_three_labels_have_no_positive_class(spark):
    preds, data = tables(spark, 3)
    report = as_dict(reports.run_diagnosis(preds, data, "target", ["part"], "classification", "auc", n_boot=40))
    items = {item for item, _ in report}
    assert {"confusion", "class_balance"} <= items and not items & {"missed_positives", "calibration", "overfit_gap"}
    assert report["noise_floor", "status"] == "needs_probabilities" and ("noise_floor", "std") not in report


def test_numbers_with_an_unknown_metric(spark):
    ids = spark.range(400).withColumnRenamed("id", "row_id")
    data = ids.select("row_id", (F.col("row_id") % 4).alias("part"), F.col("row_id").cast("double").alias("target"))
    preds = data.select("row_id", F.col("target").alias("y_true"), (F.col("target") + 1 + 9 * (F.col("part") == 2).cast("int")).alias("y_pred"))
    report = as_dict(reports.run_diagnosis(preds, data, "target", ["part"], "regression", "mape", False, {"mape": 1.0}, n_boot=40))
    assert report["noise_floor", "metric"] == "rmse" and report["noise_floor", "fallback"] == "true"
    assert float(report["residuals", "bias"]) == pytest.approx(-3.25) and report["error_slice_1", "bucket"] == "2"
    assert report["overfit_gap", "level"] == "not measurable" and ("confusion", "n") not in report


def test_an_empty_table_has_no_floor(spark):
    preds, data = tables(spark, 2)
    report = as_dict(reports.run_diagnosis(preds.limit(0), data, "target", ["part"], "classification", "accuracy"))
    assert report["overall", "n"] == "0" and report["noise_floor", "status"] == "too_few_valid_resamples"


def test_forensics_of_numbers_and_labels(spark):
    ids = spark.range(900).withColumnRenamed("id", "row_id")
    data = ids.withColumn("x", (F.col("row_id") * 37 % 101) / 101.0).withColumn("same", F.lit(3.0)).withColumn(
        "name", F.concat(F.lit("n"), F.col("row_id").cast("string"))).withColumn("z", (F.col("row_id") * 53 % 97) / 97.0)
    numbers = data.withColumn("y", 3 * F.col("x") + 1000.0)
    report = as_dict(reports.run_forensics(numbers, "y", ["x", "z", "name"], "regression", quick=True))
    assert report["signal_check", "has_signal"] == "true" and report["input", "scoring"] == "r2"
    assert report["feature_signal", "feature"] == "x" and report["input", "n_rows"] == "900"
    assert report["input", "dropped"] == "name" and not {i for i, _ in report} & {"label_noise", "leakage"}
    assert report["verdict", "verdict"] in ("model_limited", "more_data_needed")
    labels = data.withColumn("y", (F.col("x") > 0.5).cast("int"))
    report = as_dict(reports.run_forensics(labels, "y", ["x", "z", "name"], "classification", quick=True))
    assert report["leakage", "leakage"] == "true" and report["label_suspects", "n_listed"] is not None
    assert report["input", "scoring"] == "roc_auc" and report["input", "dropped"] == "name"


def test_forensics_with_reference_models(spark):
    ids = spark.range(300).withColumnRenamed("id", "row_id")
    labels = ids.withColumn("x", (F.col("row_id") * 37 % 101) / 101.0).withColumn("y", (F.col("x") > 0.5).cast("int"))
    report = as_dict(reports.run_forensics(labels, "y", ["x"], "classification", quick=True, reference=True))
    models_ = {i for i, _ in report if i.startswith("reference_")}
    assert len(models_) >= 3
