"""Matching rows between predictions, datasets and runs by key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

MIN_COMMON_ROWS = 50
MIN_COMMON_FRACTION = 0.6


def join_features(preds: DataFrame, dataset: DataFrame, target: str, key: str = "row_id") -> DataFrame:
    """Attach the dataset's features to each prediction; the target column is left out.

    Both sides are unique on ``key``, so a plain equi join is balanced.
    """
    clash = [c for c in preds.columns if c != key]
    features = dataset.drop(target, *clash)
    return preds.join(features, key, "inner")


def row_intersection(preds: DataFrame, run_a: str, run_b: str) -> DataFrame:
    a = preds.filter(F.col("run_id") == run_a).select("row_id")
    b = preds.filter(F.col("run_id") == run_b).select("row_id")
    return a.intersect(b)


def label_union(preds: DataFrame) -> DataFrame:
    """Distinct values over true and predicted labels."""
    # distinct per side first: only distinct labels reach the union's shuffle
    true = preds.select(F.col("y_true").alias("label"))
    predicted = preds.select(F.col("y_pred").alias("label"))
    return true.union(predicted).filter("label is not null").distinct()


@dataclass(frozen=True)
class Aligned:
    """Rows of several runs side by side, and the numbers of the overlap rule."""

    wide: DataFrame
    runs: tuple[str, ...]
    columns: tuple[str, ...]
    n_common: int
    smallest: int

    @property
    def enough(self) -> bool:
        return self.n_common > 0 and self.n_common >= max(
            MIN_COMMON_ROWS, int(MIN_COMMON_FRACTION * self.smallest)
        )

    def long(self) -> DataFrame:
        """One row per run and common row."""
        parts = F.array(*[
            F.struct(F.lit(run).alias("run_id"), *[F.col(f"{c}__{i}").alias(c) for c in self.columns])
            for i, run in enumerate(self.runs)
        ])
        fields = [F.col(f"m.{c}").alias(c) for c in ("run_id", *self.columns)]
        return self.wide.select("row_id", F.explode(parts).alias("m")).select("row_id", *fields)


def side_by_side(preds: DataFrame, runs: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per row_id with the columns of every run (suffix ``__i``) and ``_present``.

    A single shuffle on the row key instead of an N-way join. Buffers have a fixed size: repeated
    row ids in a run show up as a count above the number of runs and are dropped by the caller.
    """
    one = [F.col("run_id") == run for run in runs]
    cells = [F.max(F.when(hit, F.col(c))).alias(f"{c}__{i}") for i, hit in enumerate(one) for c in columns]
    seen = [F.count_if(hit).alias(f"_in{i}") for i, hit in enumerate(one)]
    return preds.filter(F.col("run_id").isin(list(runs))).groupBy("row_id").agg(*cells, *seen)


def align(preds: DataFrame, runs: Sequence[str], columns: Sequence[str] | None = None) -> Aligned:
    """Rows present exactly once in all ``runs``, with the overlap rule's counts.

    The shuffled rows are written once: the counts and every later score read them back.
    """
    columns = tuple(columns or [c for c in preds.columns if c not in ("run_id", "row_id")])
    table = cut_lineage(side_by_side(preds, runs, columns))
    flags = [F.col(f"_in{i}") for i in range(len(runs))]
    in_all = reduce(lambda a, b: a & b, [f == 1 for f in flags])
    counts = table.agg(F.count_if(in_all), *[F.sum(f) for f in flags]).first()
    wide = table.filter(in_all).drop(*[f"_in{i}" for i in range(len(runs))])
    return Aligned(wide, tuple(runs), columns, counts[0], min(c or 0 for c in counts[1:]))


def label_disagreements(preds: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Rows on which the runs were scored against different true labels."""
    return (
        preds.filter(F.col("run_id").isin(list(runs))).groupBy("row_id")
        .agg(F.min("y_true").alias("low"), F.max("y_true").alias("high"),
             F.countDistinct("run_id").alias("n_runs"))
        .filter((F.col("n_runs") == len(runs)) & (F.col("low") != F.col("high")))
        .select("row_id", "low", "high")
    )


def missed_rows(dataset: DataFrame, preds: DataFrame, positive) -> DataFrame:
    """Dataset rows that are positives the run did not catch."""
    missed = preds.filter((F.col("y_true") == F.lit(positive)) & ~F.col("y_pred").eqNullSafe(F.lit(positive)))
    return dataset.join(missed.select("row_id"), "row_id", "left_semi")


def annotate(slices: DataFrame, meanings: DataFrame) -> DataFrame:
    """Attach the registered meaning of each feature (one per feature) to the few slices."""
    return slices.join(meanings.select("feature", "meaning"), "feature", "left")


def unknown_row_ids(preds: DataFrame, dataset: DataFrame) -> DataFrame:
    """Contract check on keys: ids outside the dataset, and ids repeated within a run."""
    by = ["run_id", "row_id"] if "run_id" in preds.columns else ["row_id"]
    outside = preds.join(dataset.select("row_id"), "row_id", "left_anti").select("row_id").distinct()
    repeated = preds.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1").select("row_id").distinct()
    return outside.withColumn("problem", F.lit("not_in_dataset")).unionByName(
        repeated.withColumn("problem", F.lit("repeated"))
    )
