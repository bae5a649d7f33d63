"""Replica vectors against rows multiplied by replicas."""

import math

import numpy as np
from pyspark.sql import functions as F

from assaykit.functions import hashing, replicas
from assaykit.functions.metrics import context_of, known_metric
from assaykit.operators import resample


def weights_of(units, n_boot, salt):
    w = hashing.poisson_weight(hashing.replica_value(F.col("c"), F.col("replica").cast("bigint")))
    return (
        units.withColumn("c", hashing.replica_coefficients(F.col("_unit"), salt))
        .withColumn("replica", F.explode(F.sequence(F.lit(1), F.lit(n_boot)))).withColumn("w", w)
    )


def test_matrix_holds_the_weights_of_the_columns(spark):
    rows = weights_of(spark.range(300).withColumnRenamed("id", "_unit"), 40, "s").collect()
    own = hashing.poisson_matrix(np.arange(300), 40, "s")
    assert all(own[r["_unit"], r["replica"] - 1] == r["w"] for r in rows)


def test_sums_with_nulls_nan_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(replicas, "_MAX_SUMS", 500)  # flushed more than once
    monkeypatch.setattr(replicas, "_MAX_WEIGHTS", 1_000)  # weights beyond are computed again
    values = [None, 1.5, float("nan"), -2.0, 0.0, float("inf")]
    data = [(i % 97, [None, "a", "b"][i % 3], values[i % 6] if i % 3 else None, float(i)) for i in range(500)]
    cells = spark.createDataFrame(data, "_unit bigint, g string, x double, y double").repartition(3)
    got = replicas.replica_sums(cells, ["g"], ["x", "y"], 25, "s")
    multiplied = weights_of(cells, 25, "s").where("w > 0").groupBy("g", "replica").agg(
        F.sum(F.col("x") * F.col("w")).alias("x"), F.sum(F.col("y") * F.col("w")).alias("y"))
    as_set = lambda df: {(r["g"], r["replica"], str(r["x"]), r["y"]) for r in df.collect()}
    assert as_set(got) == as_set(multiplied)


def brute_area(rows):
    pos, neg, area = 0.0, 0.0, 0.0
    order = lambda s: (0, 0.0) if s is None else (2, 0.0) if math.isnan(s) else (1, s)
    for key in sorted({order(r[0]) for r in rows}):
        p = sum(r[1] for r in rows if order(r[0]) == key)
        n = sum(r[2] for r in rows if order(r[0]) == key)
        area += p * (neg + n / 2)
        pos, neg = pos + p, neg + n
    return area / (pos * neg) if pos and neg else None


def test_areas_by_group_over_any_stretches(spark, monkeypatch):
    monkeypatch.setattr(replicas, "_BLOCK", 7)
    rng = np.random.default_rng(1)
    scores = [None, float("nan"), 0.0, 0.25, 0.5]
    data = []
    for i in range(400):
        group = ["hot", "hot", "b", None][i % 4]
        score = scores[i % 5] if i % 3 else float(rng.random())
        data.append((i % 83, group, score, float(i % 2), float(1 - i % 2)))
    data += [(5, "lone", 0.5, 1.0, 0.0)]
    cells = spark.createDataFrame(data, "_unit bigint, g string, s double, p double, n double").repartition(4)
    own = hashing.poisson_matrix(np.arange(83), 12, "s").astype(float)
    for partitions in (1, 6):
        got = {(r["g"], r["replica"]): r["value"]
               for r in replicas.replica_areas(cells, ["g"], "s", "p", "n", 12, "s", partitions).collect()}
        for group in ("hot", "b", None, "lone"):
            for replica in range(1, 13):
                drawn = [(s, p * own[u, replica - 1], n * own[u, replica - 1]) for u, g, s, p, n in data if g == group]
                want = brute_area([r for r in drawn if r[1] or r[2]])
                value = got.get((group, replica))
                assert value == want or math.isclose(value, want, rel_tol=1e-12)
    whole = replicas.replica_areas(cells, [], "s", "p", "n", 3, "s", 3).collect()
    assert sorted(r["replica"] for r in whole) == [1, 2, 3]


def test_no_row_is_multiplied_by_replicas(spark, capsys):
    data = [(i, i % 2, i % 2, (i % 7) / 7) for i in range(200)]
    preds = spark.createDataFrame(data, "row_id bigint, y_true int, y_pred int, proba_1 double")
    resample.noise_floor(preds, known_metric("auc")).explain()
    plan = capsys.readouterr().out
    assert "sequence(1" not in plan and "explode(sequence" not in plan


def test_three_labels_have_no_area_and_an_empty_table_no_floor(spark):
    preds = spark.createDataFrame([(i, i % 3, i % 3, 0.5) for i in range(60)], "row_id bigint, y_true int, y_pred int, proba_1 double")
    auc = known_metric("auc")
    assert resample.bootstrap_values(preds, auc, context_of(preds), n_boot=20).count() == 0
    empty = preds.limit(0)
    for name in ("auc", "f1", "accuracy"):
        assert resample.noise_floor(empty, known_metric(name)).count() == 0
    assert resample.noise_floor(preds, known_metric("f1"), n_boot=40).first()["n_boot"] == 40
