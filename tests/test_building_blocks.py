"""Hashing, ordered folds, quantiles, joins."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from assaykit.functions import hashing, joins, ordering


def test_uniform_is_uniform_and_ignores_partitioning(spark):
    df = spark.range(20_000).withColumn("u", hashing.uniform(F.col("id"), "a"))
    mean, sd = df.agg(F.avg("u"), F.stddev("u")).first()
    assert abs(mean - 0.5) < 0.01 and abs(sd - 1 / math.sqrt(12)) < 0.01
    total = lambda parts: spark.range(0, 1000, 1, parts).agg(F.sum(hashing.uniform(F.col("id"), "a"))).first()[0]
    assert abs(total(1) - total(32)) < 1e-9


def test_replica_weights_are_poisson_and_uncorrelated(spark):
    units = spark.range(20_000).withColumn("c", hashing.replica_coefficients(F.col("id"), "x"))
    w = lambda r: hashing.poisson_weight(hashing.replica_value(F.col("c"), F.lit(r).cast("bigint")))
    row = units.select(w(1).alias("a"), w(2).alias("b"), w(3).alias("d")).agg(
        F.avg("a"), F.variance("a"), F.corr("a", "b"), F.corr("b", "d"), F.avg((F.col("a") == 0).cast("int"))).first()
    assert abs(row[0] - 1) < 0.03 and abs(row[1] - 1) < 0.05
    assert abs(row[2]) < 0.03 and abs(row[3]) < 0.03
    assert abs(row[4] - math.exp(-1)) < 0.01


@pytest.mark.parametrize("chunk", [10_000, 50])
def test_running_fold_equals_plain_window(spark, chunk):
    # one group holds two thirds of the rows
    df = spark.range(1200).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 7).alias("g"), F.col("id").alias("o"),
        F.when(F.col("id") % 5 != 0, (F.col("id") * 37) % 101).alias("v"))
    got = ordering.running_fold(df, ["g"], "o", {
        "s": ("sum", F.col("v"), True), "m": ("max", F.col("v"), False), "l": ("min", F.col("v"), True)}, chunk)
    w = Window.partitionBy("g").orderBy("o")
    incl, excl = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.coalesce(F.sum("v").over(incl), F.lit(0)).alias("s"), F.max("v").over(excl).alias("m"),
                     F.min("v").over(incl).alias("l"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_running_fold_without_groups(spark):
    df = spark.range(500).select(F.col("id").alias("o"), F.lit(1).alias("one"))
    got = ordering.running_fold(df, [], "o", {"n": ("sum", F.col("one"), True)}, 37)
    assert {r.o: r.n for r in got.collect()} == {i: i + 1 for i in range(500)}


@pytest.mark.parametrize("cells", [10**7, 60])
def test_exact_quantiles_match_numpy(spark, cells):
    rng = np.random.default_rng(1)
    a = np.round(rng.lognormal(0, 3, 5000), 3)
    b = np.where(rng.random(5000) < 0.4, 7.0, rng.normal(0, 1, 5000))  # a third and more share one value
    df = spark.createDataFrame([(float(x), float(y) if i % 11 else None) for i, (x, y) in enumerate(zip(a, b))], "a double, b double")
    probes = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = ordering.exact_quantiles(df, {"a": probes, "b": probes}, direct_cells=cells)
    kept = np.array([y for i, y in enumerate(b) if i % 11])
    assert np.allclose(got["a"], np.quantile(a, probes), rtol=1e-12)
    assert np.allclose(got["b"], np.quantile(kept, probes), rtol=1e-12)


def test_exact_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "a double")
    assert ordering.exact_quantiles(df, {"a": [0.5]}) == {"a": [None]}


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_with_a_hot_key(spark, how):
    rows = spark.range(900).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    rows = rows.withColumn("k", F.when(F.col("v") % 50 == 1, None).otherwise(F.col("k")))
    lookup = spark.range(0, 900, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x")).unionByName(
        spark.createDataFrame([(5, 50)], "k bigint, x bigint"))
    small = joins.lookup_join(rows, lookup, ["k"], how)
    salted = joins.lookup_join(rows, lookup, ["k"], how, broadcast_rows=3, hot_share=0.05)
    plain = rows.join(lookup, "k", how)
    text = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert text(small) == text(salted) == text(plain)
