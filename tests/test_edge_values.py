"""Missing values, offsets, run ids and file orders that plain fixtures do not show."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.functions import ordering
from assaykit.functions.metrics import approximate_median_significance, context_for, known_metric
from assaykit.operators import diagnose, ensemble, history, resample
from assaykit.operators.scoring import metric_value
from assaykit.plans import views as v
from assaykit.session import scratch_path
from assaykit.streaming import events as stream


@pytest.mark.parametrize("cells", [10**7, 1])
def test_quantiles_ignore_nan_on_both_paths(spark, cells):
    values = [float(i) for i in range(100)]
    rows = [(math.nan if x < 40 else x, None if i % 3 else 5.0, math.nan) for i, x in enumerate(values)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    probes = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = ordering.exact_quantiles(df, {"a": probes, "b": probes, "c": probes}, direct_cells=cells)
    assert got["a"] == [40.0, 54.75, 69.5, 84.25, 99.0] and got["b"] == [5.0] * 5 and got["c"] == [None] * 5


def test_interpolation_from_the_nearer_end():
    rng = np.random.default_rng(3)
    for low, high, part in rng.random((500, 3)):
        low, high = min(low, high), max(low, high)
        assert ordering.between_ranks(low, high, part) == np.quantile([low, high], part)


def test_nan_rows_get_their_own_bucket(spark):
    df = spark.createDataFrame([(i, math.nan if i < 40 else float(i)) for i in range(100)], "row_id int, x double")
    sizes = {r["bucket"]: r["count"] for r in diagnose.quartile_bucket(df, "x").groupBy("bucket").count().collect()}
    assert sizes == {"nan": 40, "q1": 15, "q2": 15, "q3": 15, "q4": 15}


def test_every_feature_is_sliced(spark):
    df = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 5 == 0).cast("int").alias("error"),
                                 *[(F.col("id") % (i + 2)).alias(f"f{i}") for i in range(40) if i != 3], (F.col("id") % 5).alias("last"))
    features = [c for c in df.columns if c not in ("row_id", "error")]
    assert diagnose.error_slices(df, features).first()["feature"] in ("last", "f8", "f13", "f18")
    assert {r["feature"] for r in diagnose.slice_cells(df, features).collect()} == set(features)


def test_history_names_runs_by_their_id(spark):
    runs = spark.createDataFrame(
        [("p", 1, "r9", "baseline", "finished", '{"m": 1.0}'), ("p", 2, "r10", "experiment", "finished", '{"m": 3.0}'), ("p", 3, "r11", "experiment", "finished", '{"m": 2.0}')],
        "project_id string, seq bigint, run_id string, kind string, status string, metrics string").withColumn("given_parent", F.lit(None).cast("string"))
    goals = spark.createDataFrame([("p", "m", "maximize")], "project_id string, primary_metric string, direction string")
    valued = history.with_primary_value(runs, goals)
    assert history.best_run(valued).first()["run_id"] == "r10"
    assert {r["run_id"]: r["best_run_id"] for r in history.run_vs_best(valued).collect()} == {"r10": "r9", "r11": "r10"}
    assert {r["run_id"]: r["parent_run_id"] for r in history.default_parent(runs).collect()} == {"r9": None, "r10": "r9", "r11": "r10"}
    assert {r["run_id"]: r["delta"] for r in history.run_vs_parent(valued).collect()} == {"r10": 2.0, "r11": -1.0}
    assert history.undiagnosed(runs, spark.createDataFrame([("r10",)], "run_id string")).first()["run_id"] == "r11"


def test_r2_survives_a_large_offset(spark):
    rng = np.random.default_rng(1)
    y = rng.random(2000)
    rows = [(i, 1e9 + float(a), 1e9 + float(a) + 0.01 * float(b)) for i, (a, b) in enumerate(zip(y, rng.normal(size=2000), strict=True))]
    got = metric_value(spark.createDataFrame(rows, "row_id int, y_true double, y_pred double"), known_metric("r2")).first()["value"]
    assert got == pytest.approx(1 - 1e-4 / y.var(), abs=1e-4)


def test_scores_of_one_class_say_nothing_about_three(spark):
    df = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("y_true"), (F.col("id") % 3).alias("y_pred"), (F.col("id") / 300).alias("proba_1"))
    for name in ("auc", "logloss"):
        assert metric_value(df, known_metric(name)).first()["value"] is None
    assert metric_value(df, known_metric("accuracy")).first()["value"] == 1.0


def runs_of_three(spark):
    one = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("y_true"), (1 + F.col("id") % 7).cast("double").alias("weight"))
    make = lambda run, salt: one.withColumn("run_id", F.lit(run)).withColumn(
        "proba_yes", 0.35 * F.col("y_true") + 0.6 * v.u("row_id", salt)).withColumn("y_pred", (F.col("proba_yes") > 0.5).cast("bigint"))
    return make("a", "x").unionByName(make("b", "y")).unionByName(make("c", "z"))


def test_ensembles_of_other_score_columns_and_weights(spark):
    preds = runs_of_three(spark)
    row = ensemble.ensemble_probe(preds, ["a", "b", "c"], known_metric("auc"), n_boot=60).first()
    assert row["n_common"] == 400 and row["ensemble_value"] > row["best_value"]
    weighted = ensemble.ensemble_probe(preds, ["a", "b", "c"], approximate_median_significance(), n_boot=60).first()
    assert weighted["best_value"] > 0 and weighted["paired_std"] > 0
    wrong = preds.withColumn("y_true", F.when((F.col("run_id") == "b") & (F.col("row_id") == 3), 0).otherwise(F.col("y_true")))
    with pytest.raises(ValueError, match="true labels"):
        ensemble.ensemble_probe(wrong, ["a", "b", "c"], known_metric("auc"), n_boot=60)


def test_floor_by_group_and_units(spark):
    preds = runs_of_three(spark).withColumnRenamed("proba_yes", "proba_1")
    ctx = context_for(known_metric("auc"), preds)
    floors = {(r["run_id"]): r["std"] for r in resample.noise_floor(preds, known_metric("auc"), ["run_id"], ctx=ctx).collect()}
    assert set(floors) == {"a", "b", "c"} and all(0.005 < s < 0.1 for s in floors.values())
    # a plain row bootstrap of one run
    own = preds.filter("run_id = 'a'").select("y_true", "proba_1").collect()
    y, s = np.array([r[0] for r in own]), np.array([r[1] for r in own])
    rng, values = np.random.default_rng(0), []
    for _ in range(300):
        pick = rng.integers(0, len(y), len(y))
        a, b = s[pick][y[pick] == 1], s[pick][y[pick] == 0]
        values.append((a[:, None] > b[None, :]).mean())
    assert floors["a"] == pytest.approx(np.std(values), rel=0.25)
    few = resample.noise_floor(preds.filter("run_id = 'a'"), known_metric("auc"), units=128).first()["std"]
    assert few == pytest.approx(np.std(values), rel=0.35)


def test_streams_do_not_depend_on_the_order_of_files(spark, sf):
    path = scratch_path(spark, "stream-reversed")
    events = spark.read.parquet(f"{sf}/events.parquet")
    n = events.count()
    for i in (2, 1, 0):  # newest first
        part = events.filter((F.col("event_id") >= n * i // 3) & (F.col("event_id") < n * (i + 1) // 3))
        part.coalesce(1).write.mode("append").parquet(path)
    source = stream.Source(path, events.schema, {"maxFilesPerTrigger": "1"})
    counts = stream.event_counts(spark, source).collect()
    assert sum(r["n"] for r in counts) == n and sum(r["n_late"] for r in counts) > 0
    goals = v.goals(spark, sf)
    got = {r["project_id"]: tuple(r)[1:] for r in stream.stagnation(spark, source, lambda b: history.with_primary_value(v.runs_of(b), goals)).collect()}
    valued = history.with_primary_value(v.runs(spark, sf), goals)
    want = {r["project_id"]: tuple(r)[1:] for r in stream.summarize(valued).collect()}
    assert got == want


def test_payload_fields_join_time_and_kind(spark):
    from assaykit.sources import eventlog

    rows = [(1, '{"a": 1, "kind": "inner", "b": "x"}'), (2, "not json"), (3, None)]
    log = spark.createDataFrame(rows, "seq bigint, payload string").selectExpr("seq", "timestamp'2024-01-02 03:04:05' AS ts", "'outer' AS kind", "payload")
    got = {r["seq"]: r["fields"] for r in eventlog.merged_events(log).collect()}
    own = {"ts": "2024-01-02T03:04:05", "kind": "outer"}
    assert got == {1: {"a": "1", "b": "x", **own}, 2: own, 3: own}


def test_scratch_tables_are_removed_at_the_end(spark):
    import os

    from assaykit import session

    path = session.scratch_path(spark, "gone").removeprefix("file://")
    spark.range(3).write.parquet(path)
    kept, session._MARKED[:] = session._MARKED[:-1], session._MARKED[-1:]
    assert os.path.isdir(path)
    session._remove_scratch()
    assert not os.path.exists(path)
    session._MARKED[:] = kept
