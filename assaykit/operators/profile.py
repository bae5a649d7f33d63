"""What a dataset is, and whether a run's files keep the contract."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import known_metric

REQUIRED_COLUMNS = ("row_id", "y_true", "y_pred")


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, dtype, n, n_null, n_distinct) in one pass.

    Distinct counts are exact; map-side only distinct values of a task leave it.
    """
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    measures = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        measures += [F.count(c).alias(f"f{i}"), F.countDistinct(c).alias(f"d{i}")]
    wide = df.agg(*measures)
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), F.col("n"),
                 (F.col("n") - F.col(f"f{i}")).alias("n_null"), F.col(f"d{i}").alias("n_distinct"))
        for i, c in enumerate(columns)
    ])
    return wide.select(F.inline(entries))


def content_hash(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """Identity of a table that does not depend on row order or partitioning.

    ``columns`` are text renderings; each row's md5 contributes two words to a sum and an xor.
    """
    text = F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns]))
    word = lambda at: F.conv(F.substring(text, at, 8), 16, 10).cast("bigint")
    words = df.select(word(1).alias("a"), word(9).alias("b"))
    return words.agg(
        F.count("*").alias("n_rows"), F.sum("a").cast("bigint").alias("hash_sum"),
        F.bit_xor("b").cast("bigint").alias("hash_xor"),
    )


def target_distribution(df: DataFrame, target: str, top: int = 10) -> DataFrame:
    counts = df.filter(F.col(target).isNotNull()).groupBy(F.col(target).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(top)


def majority_fraction(df: DataFrame, target: str) -> DataFrame:
    """Largest class over all rows; rows without a target count below the line only."""
    counts = df.groupBy(F.col(target).alias("value")).agg(F.count("*").alias("n"))
    largest = F.max(F.when(F.col("value").isNotNull(), F.col("n")))
    return counts.agg(F.round(largest / F.sum("n"), 4).alias("majority_fraction"))


def metric_advisory(df: DataFrame, target: str, task: str, metric: str) -> DataFrame:
    """Does the metric fit the task, and is accuracy a trap on these classes?"""
    spec = known_metric(metric)
    refused = spec is not None and spec.task != task
    trap = task == "classification" and spec is not None and spec.name == "accuracy"
    share = F.col("majority_fraction")
    return majority_fraction(df, target).select(
        F.lit(metric).alias("metric"), F.lit(refused).alias("refused"), share,
        (F.lit(trap) & (share >= 0.7)).alias("advise_other_metric"),
    )


def validate_predictions(preds: DataFrame, task: str, runs: DataFrame | None = None) -> DataFrame:
    """(run_id, severity, code) for every broken rule; no rows when all is well.

    Column rules are read off the schema, so they cost nothing and hold for every run of the table.
    ``runs`` lists the runs that should have rows.
    """
    spark = preds.sparkSession
    missing = [c for c in REQUIRED_COLUMNS if c not in preds.columns]
    found = [("*", "error", f"missing_column:{c}") for c in missing]
    if task == "classification" and not any(c.startswith("proba_") for c in preds.columns):
        found.append(("*", "warning", "no_probabilities"))
    out = spark.createDataFrame(found, "run_id string, severity string, code string")
    if runs is not None:
        present = preds.select("run_id").distinct()
        empty = runs.select("run_id").join(present, "run_id", "left_anti").select(
            F.col("run_id").cast("string").alias("run_id"), F.lit("error").alias("severity"), F.lit("no_rows").alias("code"))
        out = out.unionByName(empty)
    return out


# required keys of a run's meta text and the accepted types of their values
META_TYPES = {
    "model_desc": ("STRING",),
    "hyperparams": ("OBJECT",),
    "features": ("ARRAY",),
    "seed": ("BIGINT", "BOOLEAN"),
}
META_ADVISED = ("train_seconds", "feature_importance")


def validate_meta(runs: DataFrame) -> DataFrame:
    """(run_id, severity, code) over all runs' meta JSON text."""
    parsed = runs.select("run_id", F.col("meta").isNull().alias("absent"), F.try_parse_json("meta").alias("v"))
    kind = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
    typed = parsed.withColumn("kind", F.when(F.col("v").isNotNull(), kind))
    is_object = F.col("kind") == "OBJECT"
    problem = lambda test, severity, code: F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))
    checks = [
        problem(F.col("absent"), "error", "meta_missing"),
        problem(~F.col("absent") & F.col("v").isNull(), "error", "meta_not_json"),
        problem(F.col("v").isNotNull() & ~is_object, "error", "meta_not_object"),
    ]
    for key, accepted in META_TYPES.items():
        value = F.try_variant_get("v", f"$.{key}", "variant")
        value_kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
        checks.append(problem(is_object & value.isNull(), "error", f"missing_key:{key}"))
        checks.append(problem(is_object & value.isNotNull() & ~value_kind.isin(*accepted), "error", f"wrong_type:{key}"))
    for key in META_ADVISED:
        checks.append(problem(is_object & F.try_variant_get("v", f"$.{key}", "variant").isNull(), "warning", f"advised:{key}"))
    found = F.filter(F.array(*checks), lambda c: c.isNotNull())
    return typed.select("run_id", F.explode(found).alias("c")).select("run_id", "c.severity", "c.code")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
