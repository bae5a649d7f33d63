"""Resampling: noise floors, paired comparisons, samples, folds and label shuffles.

The bootstrap gives every resampling unit a Poisson(1) weight per replica. A unit is a random
group of rows (``UNITS`` hash slots of the row key): with fewer rows than slots that is nearly the
plain row bootstrap, with more it is the random-groups bootstrap, which has the same expected
variance because groups are assigned independently of the data. Rows are first added up per unit;
replicas are vectors over those sums (``functions.replicas``), no row is multiplied by their number.

Weights depend on the row key only. Two runs on the same rows therefore see identical resamples,
which is what makes a paired comparison paired.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import slot, uniform
from ..functions.metrics import Context, Metric, RankMetric, context_for
from ..functions.ordering import ROWS_PER_TASK, next_by_hash, rank_by_hash
from ..functions.replicas import replica_areas, replica_sums
from .align import Aligned, align

UNITS = 1 << 17
#: Bin width that suits continuous scores of very large tables; by default scores are kept.
SCORE_WIDTH = 1e-4


def coarse_scores(preds: DataFrame, ctx: Context, width: float | None) -> DataFrame:
    """Scores as multiples of ``width``: the same bins for every group and table size; None keeps them.

    Only used inside resampling. Within a bin all pairs count half, so a replica's area is off by
    at most half the sum over bins of positives x negatives, relative to all pairs.
    """
    if width is None:
        return preds
    return preds.withColumn(ctx.proba, F.floor(F.col(ctx.proba).cast("double") / width + 0.5) * F.lit(width))


def tasks_of(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bootstrap_values(
    preds: DataFrame,
    metric: Metric,
    ctx: Context,
    by: Sequence[str] = (),
    n_boot: int = 200,
    seed: int = 0,
    key: str = "row_id",
    units: int = UNITS,
    score_width: float | None = None,
) -> DataFrame:
    """Metric per replica: ``by`` columns, ``replica``, ``value`` (null values removed).

    ``units`` is the number of resampling units, ``score_width`` the width of score bins.
    """
    by = list(by)
    rank = isinstance(metric, RankMetric)
    if rank:
        preds = coarse_scores(preds, ctx, score_width)
    rows = preds.withColumn("_unit", slot(F.col(key), units, f"unit{seed}"))
    cells = metric.cells(rows, [*by, "_unit"], ctx)
    keys, sums = list(metric.cell_keys(ctx)), list(metric.cell_sums(ctx))
    if not rank:
        values = metric.finish(replica_sums(cells, [*by, *keys], sums, n_boot, f"boot{seed}"), [*by, "replica"], ctx)
    elif metric.computable(ctx):
        values = replica_areas(cells, by, *keys, *sums, n_boot, f"boot{seed}", tasks_of(cells))
    else:
        return no_values(cells, by)
    return values.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def no_values(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return cells.select(*by, F.lit(0).alias("replica"), F.lit(None).cast("double").alias("value")).limit(0)


def enough_replicas(n_boot: int) -> int:
    return max(20, n_boot // 4)


def noise_floor(
    preds: DataFrame,
    metric: Metric,
    by: Sequence[str] = (),
    n_boot: int = 200,
    seed: int = 0,
    ctx: Context | None = None,
    units: int = UNITS,
    score_width: float | None = None,
) -> DataFrame:
    """Spread of a metric under resampling and the smallest change worth believing (two sd).

    Groups with too few valid replicas are left out.
    """
    ctx = ctx or context_for(metric, preds)
    values = bootstrap_values(preds, metric, ctx, by, n_boot, seed, units=units, score_width=score_width)
    ends = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    stats = values.groupBy(*by).agg(
        F.count("value").alias("n_boot"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), ends.alias("_ends"),
    )
    return stats.filter(F.col("n_boot") >= enough_replicas(n_boot)).select(
        *by, F.lit(metric.name).alias("metric"), "n_boot", "mean", "std",
        F.col("_ends")[0].alias("ci_low"), F.col("_ends")[1].alias("ci_high"),
        (2 * F.col("std")).alias("min_significant_delta"),
    )


def paired_deltas(
    rows: DataFrame, metric: Metric, ctx: Context, run_a: str, run_b: str, n_boot: int, seed: int = 0,
    units: int = UNITS, score_width: float | None = None,
) -> DataFrame:
    """``replica``, ``delta`` = metric(b) - metric(a) on identical resamples of shared rows."""
    both = rows.filter(F.col("run_id").isin(run_a, run_b))
    values = bootstrap_values(both, metric, ctx, ["run_id"], n_boot, seed, units=units, score_width=score_width)
    pick = lambda run: F.max(F.when(F.col("run_id") == run, F.col("value")))
    return (
        values.groupBy("replica").agg((pick(run_b) - pick(run_a)).alias("delta"))
        .filter("delta is not null")
    )


def paired_std(
    rows: DataFrame, metric: Metric, ctx: Context, run_a: str, run_b: str, n_boot: int, seed: int = 0,
    needed: int | None = None, units: int = UNITS, score_width: float | None = None,
) -> DataFrame:
    """One row: number of valid replicas and ``paired_std`` (null when there are too few)."""
    needed = enough_replicas(n_boot) if needed is None else needed
    deltas = paired_deltas(rows, metric, ctx, run_a, run_b, n_boot, seed, units, score_width)
    return deltas.agg(
        F.count("delta").alias("n_boot"),
        F.when(F.count("delta") >= needed, F.stddev_samp("delta")).alias("paired_std"),
    )


def bar_of(std: Column) -> Column:
    return F.when(std.isNotNull(), F.greatest(2 * std, F.lit(1e-6)))


def compare_aligned(
    pair: Aligned, metric: Metric, n_boot: int, maximize: bool | None = None, seed: int = 0,
    ctx: Context | None = None, units: int = UNITS, score_width: float | None = None,
) -> DataFrame:
    run_a, run_b = pair.runs
    maximize = metric.higher_is_better if maximize is None else maximize
    sign = 1.0 if maximize else -1.0
    rows = pair.long()
    ctx = ctx or context_for(metric, rows)
    values = metric.finish(metric.cells(rows, ["run_id"], ctx), ["run_id"], ctx)
    pick = lambda run: F.max(F.when(F.col("run_id") == run, F.col("value")))
    points = values.agg(pick(run_a).alias("value_a"), pick(run_b).alias("value_b"))
    spread = paired_std(rows, metric, ctx, run_a, run_b, n_boot, seed, units=units, score_width=score_width)
    one = points.withColumn("_k", F.lit(0)).join(spread.withColumn("_k", F.lit(0)), "_k")
    improvement = sign * (F.col("value_b") - F.col("value_a"))
    return (
        one.withColumn("improvement", improvement).withColumn("bar", bar_of(F.col("paired_std")))
        .select(
            F.lit(run_a).alias("run_a"), F.lit(run_b).alias("run_b"), F.lit(metric.name).alias("metric"),
            F.lit(pair.n_common).cast("bigint").alias("n_common"), "value_a", "value_b", "improvement",
            "paired_std", "bar",
            F.coalesce(F.abs("improvement") > F.col("bar"), F.lit(False)).alias("significant"),
        )
    )


def compare_runs(
    preds: DataFrame, run_a: str, run_b: str, metric: Metric, n_boot: int = 150,
    maximize: bool | None = None, seed: int = 0, units: int = UNITS, score_width: float | None = None,
) -> DataFrame:
    """Paired, two-sided comparison of two runs on the rows both predicted.

    Raises ``ValueError`` when they share too few rows.
    """
    pair = align(preds, [run_a, run_b])
    if not pair.enough:
        raise ValueError(
            f"{run_a} and {run_b} share {pair.n_common} rows; at least {MIN_TEXT} are needed"
        )
    return compare_aligned(pair, metric, n_boot, maximize, seed, None, units, score_width)


MIN_TEXT = "50 rows and 60 % of the smaller run"


# --- samples, folds, shuffles -------------------------------------------------------------------


def subsample(df: DataFrame, fraction: float, key: str = "row_id", seed: int = 0) -> DataFrame:
    """Seeded sample by key: the same rows whatever the partitioning, no shuffle."""
    return df.filter(uniform(F.col(key), f"sample{seed}") < fraction)


def subsample_rows(df: DataFrame, rows: int, key: str = "row_id", seed: int = 0, salt: str = "sample") -> DataFrame:
    """Exactly ``rows`` rows with the smallest hashes (all when there are fewer).

    A hash threshold ten standard deviations above the wanted number goes first: without it every
    task would send ``rows`` candidates to the final merge.
    """
    n = df.count()
    share = (rows + 10 * math.sqrt(rows) + 10) / max(n, 1)
    tagged = df.withColumn("_u", uniform(F.col(key), f"{salt}{seed}"))
    near = tagged.filter(F.col("_u") < share) if share < 1 else tagged
    return near.orderBy("_u", key).limit(rows).drop("_u")


def kfold(df: DataFrame, k: int = 5, key: str = "row_id", seed: int = 0) -> DataFrame:
    return df.withColumn("fold", F.floor(uniform(F.col(key), f"fold{seed}") * k).cast("bigint"))


def stratified_kfold(
    df: DataFrame, label: str, k: int = 5, key: str = "row_id", seed: int = 0,
    sizes: Sequence[int] | None = None, rows_per_chunk: int = ROWS_PER_TASK,
) -> DataFrame:
    """Folds that hold each label evenly, to one row; k is lowered to the smallest class, at least two.

    The rows of a label are dealt out in hash order. Folds of a label depend on its own rows only, not on
    the size of the table, other labels or the partitioning. Known class ``sizes`` save the counting pass.
    """
    if sizes is None:
        counts = df.groupBy(label).agg(F.count("*").alias("n"))
        known = F.when(F.col(label).isNotNull(), F.col("n"))
        total, smallest = counts.agg(F.sum("n"), F.min(known)).first()
    else:
        total, smallest = sum(sizes), min(sizes)
    k = max(2, min(k, smallest or 2))
    tagged = df.withColumn("_u", uniform(F.col(key), f"fold{seed}"))
    ranked = rank_by_hash(tagged, [label], "_u", key, "_place", total or 0, rows_per_chunk)
    return ranked.withColumn("fold", F.pmod("_place", F.lit(k)).cast("bigint")).drop("_place", "_u")


def shuffle_column(
    df: DataFrame, column: str, salts: dict[str, str], key: str = "row_id", rows_per_chunk: int = ROWS_PER_TASK
) -> DataFrame:
    """Permuted copies of a column: each row takes the value of its successor in a random cycle.

    ``salts`` maps each output column to the salt of its order, one cycle through the whole table.
    Counts of values are kept exactly.
    """
    n = df.count()
    for name, salt in salts.items():
        df = next_by_hash(df.withColumn("_u", uniform(F.col(key), salt)), column, "_u", key, name, n, rows_per_chunk).drop("_u")
    return df


def learning_sizes(df: DataFrame, sizes: Sequence[float], key: str = "row_id", seed: int = 0) -> DataFrame:
    """``_size`` = index of the smallest nested training size that contains the row."""
    u = uniform(F.col(key), f"size{seed}")
    index = F.lit(len(sizes) - 1)
    for i in range(len(sizes) - 2, -1, -1):
        index = F.when(u < sizes[i], F.lit(i)).otherwise(index)
    return df.withColumn("_size", index.cast("bigint"))
