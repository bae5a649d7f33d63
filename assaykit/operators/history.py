"""Run history of many projects: best runs, streaks, budgets, stop conditions, rule audit.

Tables carry ``project_id`` and a sequence number ``seq`` that is unique over the whole table. One
project may hold any share of the runs, so nothing here sorts a whole project in one task: running
values use ``running_fold``, everything else is a grouped aggregation with map-side combining.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import lookup_join
from ..functions.ordering import ROWS_PER_CHUNK, running_fold

SCORED_KINDS = ("baseline", "experiment")
DEFAULT_MAX_RUNS = 30
PROJECT = ["project_id"]


def scored(runs: DataFrame) -> DataFrame:
    """Finished runs that count for progress; forensics runs use other evaluation protocols."""
    return runs.filter((F.col("status") == "finished") & F.col("kind").isin(*SCORED_KINDS))


def is_scored() -> Column:
    return (F.col("status") == "finished") & F.col("kind").isin(*SCORED_KINDS)


def with_primary_value(runs: DataFrame, goals: DataFrame) -> DataFrame:
    """Add ``value`` (the goal's primary metric), ``sign`` (+1 when larger is better)."""
    goal = goals.select("project_id", "primary_metric", "direction")
    joined = lookup_join(runs, goal, PROJECT, "inner")
    reported = F.from_json("metrics", "map<string,double>")
    return (
        joined.withColumn("value", F.element_at(reported, F.col("primary_metric")))
        .withColumn("sign", F.when(F.col("direction") == "maximize", 1.0).otherwise(-1.0))
        .drop("primary_metric", "direction")
    )


def _rank() -> Column:
    """Orders runs by quality; the earliest wins among equals."""
    return F.when(
        is_scored() & F.col("value").isNotNull(),
        F.struct((F.col("value") * F.col("sign")).alias("good"), (-F.col("seq")).alias("early"), F.col("value").alias("value"), F.col("run_id").alias("run_id")),
    )


def best_run(valued: DataFrame) -> DataFrame:
    return (
        valued.groupBy("project_id").agg(F.max(_rank()).alias("b")).filter("b is not null")
        .select("project_id", F.col("b.run_id").alias("run_id"), F.col("b.value").alias("value"))
    )


def running_best(valued: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Best value so far after each scored run that reported one."""
    rows = scored(valued).filter("value is not null").select("project_id", "seq", "run_id", "value", "sign")
    folded = running_fold(
        rows, PROJECT, "seq", {"_best": ("max", F.col("value") * F.col("sign"), True)}, rows_per_chunk)
    return folded.select("project_id", "run_id", "value", (F.col("_best") * F.col("sign")).alias("best_so_far"))


def stagnation(
    valued: DataFrame, goals: DataFrame, forensics: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Scored runs since the last strict improvement, and whether forensics is advised.

    The last strict improvement is the earliest run with the best value, so the streak is the
    number of scored runs after it: a running count, read at the best run and at the end.
    """
    rows = scored(valued).filter("value is not null").select("project_id", "seq", "value", "sign")
    at = running_fold(rows, PROJECT, "seq", {"_at": ("sum", F.lit(1).cast("bigint"), True)}, rows_per_chunk)
    best = F.max(F.struct((F.col("value") * F.col("sign")).alias("good"), (-F.col("seq")).alias("early"), "_at"))
    streaks = at.groupBy("project_id").agg((F.max("_at") - best.getField("_at")).alias("streak"))
    probed = forensics.select("project_id").distinct().withColumn("_probed", F.lit(True))
    return (
        goals.select("project_id", "forensics_after").join(streaks, "project_id", "left")
        .join(probed, "project_id", "left")
        .withColumn("streak", F.coalesce("streak", F.lit(0).cast("bigint")))
        .select("project_id", "streak",
                ((F.col("streak") >= F.col("forensics_after")) & F.col("_probed").isNull())
                .alias("forensics_recommended"))
    )


def train_budget(runs: DataFrame, goals: DataFrame) -> DataFrame:
    """Training hours used, over all runs; unreadable meta text counts nothing."""
    seconds = F.coalesce(F.try_variant_get(F.try_parse_json("meta"), "$.train_seconds", "double"), F.lit(0.0))
    used = runs.groupBy("project_id").agg((F.sum(seconds) / 3600).alias("hours_used"))
    return goals.select("project_id", "max_train_hours").join(used, "project_id", "left").select(
        "project_id", F.coalesce("hours_used", F.lit(0.0)).alias("hours_used"), "max_train_hours",
        F.coalesce(F.col("hours_used") >= F.col("max_train_hours"), F.lit(False)).alias("exhausted"))


def run_budget(runs: DataFrame, goals: DataFrame) -> DataFrame:
    started = runs.groupBy("project_id").agg(F.count("*").alias("runs_started"))
    limit = F.coalesce("max_runs", F.lit(DEFAULT_MAX_RUNS)).cast("bigint")
    begun = F.coalesce("runs_started", F.lit(0)).cast("bigint")
    return goals.select("project_id", "max_runs").join(started, "project_id", "left").select(
        "project_id", limit.alias("max_runs"), begun.alias("runs_started"),
        F.greatest(F.lit(0).cast("bigint"), limit - begun).alias("runs_remaining"))


def latest_forensics(forensics: DataFrame) -> DataFrame:
    return forensics.groupBy("project_id").agg(
        F.max(F.struct("seq", "verdict", "confidence")).alias("f")
    ).select("project_id", "f.seq", "f.verdict", "f.confidence")


def stop_conditions(runs: DataFrame, goals: DataFrame, forensics: DataFrame) -> DataFrame:
    best = best_run(with_primary_value(runs, goals)).select("project_id", F.col("value").alias("best"))
    verdicts = latest_forensics(forensics).select("project_id", "verdict", "confidence")
    budget = run_budget(runs, goals).select("project_id", (F.col("runs_remaining") == 0).alias("no_runs"))
    hours = train_budget(runs, goals).select("project_id", F.col("exhausted").alias("no_hours"))
    table = goals.select("project_id", "target_value", "direction")
    for part in (best, verdicts, budget, hours):
        table = table.join(part, "project_id", "left")
    reached = F.when(F.col("direction") == "maximize", F.col("best") >= F.col("target_value")).otherwise(
        F.col("best") <= F.col("target_value"))
    limited = F.col("verdict").isin("data_limited", "no_signal") & (F.col("confidence") == "high")
    no = F.lit(False)
    return table.select(
        "project_id", F.coalesce(reached, no).alias("target_met"), F.coalesce(limited, no).alias("data_limited"),
        (F.coalesce("no_runs", no) | F.coalesce("no_hours", no)).alias("budget_exhausted"),
    ).withColumn("stopping_justified", F.col("target_met") | F.col("data_limited") | F.col("budget_exhausted"))


def undiagnosed(runs: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """The latest scored run of each project, when it has no diagnosis."""
    last = scored(runs).groupBy("project_id").agg(F.max_by("run_id", "seq").alias("run_id"))
    return last.join(diagnoses.select("run_id").distinct(), "run_id", "left_anti").select("project_id", "run_id")


def project_state(projects: DataFrame, runs: DataFrame, goals: DataFrame, diagnoses: DataFrame) -> DataFrame:
    flags = runs.groupBy("project_id").agg(
        F.max(F.col("status") == "running").alias("_running"),
        F.max((F.col("status") == "finished") & (F.col("kind") == "baseline")).alias("_baseline"))
    pending = undiagnosed(runs, diagnoses).select("project_id", F.lit(True).alias("_pending"))
    goal = goals.select("project_id", "enforce_diagnosis", F.lit(True).alias("_goal"))
    table = projects.join(goal, "project_id", "left").join(flags, "project_id", "left").join(pending, "project_id", "left")
    state = (
        F.when(F.col("_goal").isNull(), "NEED_GOAL").when(F.col("_running"), "RUN_IN_PROGRESS")
        .when(~F.coalesce("_baseline", F.lit(False)), "NEED_BASELINE")
        .when(F.col("_pending") & F.col("enforce_diagnosis"), "DIAGNOSE_PENDING").otherwise("READY")
    )
    return table.select("project_id", state.alias("state"))


def hypothesis_counts(hypotheses: DataFrame) -> DataFrame:
    return hypotheses.groupBy("project_id", "status").agg(F.count("*").alias("n"))


def run_summary(valued: DataFrame, diagnoses: DataFrame, last: int = 20) -> DataFrame:
    """The latest runs with metric and diagnosis flag; the limit is applied before the lookups."""
    recent = valued.orderBy(F.desc("seq")).limit(last)
    done = diagnoses.join(F.broadcast(recent.select("run_id")), "run_id", "left_semi").select(
        "run_id", F.lit(True).alias("_done")).distinct()
    return recent.join(done, "run_id", "left").select(
        "project_id", "run_id", "kind", "status", "hypothesis_id", "value",
        F.coalesce("_done", F.lit(False)).alias("diagnosed"))


def metric_trajectory(valued: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    rows = scored(valued).filter("value is not null").select("project_id", "seq", "run_id", "value")
    at = running_fold(rows, PROJECT, "seq", {"position": ("sum", F.lit(1).cast("bigint"), True)}, rows_per_chunk)
    return at.select("project_id", "run_id", "position", "value")


def run_noise_floors(runs: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Smallest believable change of each run, from its stored diagnosis (newest version)."""
    path = "$.items.noise_floor.details.min_significant_delta"
    newest = diagnoses.groupBy("run_id").agg(F.max_by("results", "version").alias("results"))
    floors = newest.select("run_id", F.get_json_object("results", path).cast("double").alias("noise_floor"))
    return runs.select("project_id", "run_id").join(floors, "run_id", "left").select(
        "project_id", "run_id", "noise_floor")


def default_parent(runs: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add ``parent_run_id``: the given parent, else the last run of the project that is finished."""
    done = F.when(F.col("status") == "finished", F.struct("seq", "run_id"))
    return running_fold(runs, PROJECT, "seq", {"_last": ("max", done, False)}, rows_per_chunk).withColumn(
        "parent_run_id", F.coalesce("given_parent", "_last.run_id")).drop("_last")


def _improved(delta: Column) -> Column:
    return (delta * F.col("sign")) > 0


def run_vs_parent(valued: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Change against the parent's value, for scored runs with both values."""
    children = scored(default_parent(valued, rows_per_chunk)).filter("value is not null and parent_run_id is not null")
    parents = valued.filter("value is not null").select(
        "project_id", F.col("run_id").alias("parent_run_id"), F.col("value").alias("parent_value"))
    # a parent may have a large share of all runs as children
    both = lookup_join(children.select("project_id", "run_id", "parent_run_id", "value", "sign"), parents,
                       ["project_id", "parent_run_id"], "inner")
    delta = F.col("value") - F.col("parent_value")
    return both.select("project_id", "run_id", "parent_run_id", "value", "parent_value", delta.alias("delta"),
                       _improved(delta).alias("improved"))


def run_vs_best(valued: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Change against the best scored run before."""
    before = running_fold(valued, PROJECT, "seq", {"_b": ("max", _rank(), False)}, rows_per_chunk)
    rows = scored(before).filter("value is not null and _b is not null")
    delta = F.col("value") - F.col("_b.value")
    return rows.select("project_id", "run_id", F.col("_b.run_id").alias("best_run_id"), "value",
                       F.col("_b.value").alias("best_value"), delta.alias("delta"), _improved(delta).alias("improved"))


def evidence_links(hypotheses: DataFrame, runs: DataFrame) -> DataFrame:
    """Per resolved hypothesis: evidence that is unknown, not finished, and whether any tested it."""
    resolved = hypotheses.filter(~F.col("status").isin("open", "testing"))
    links = resolved.select("project_id", "hypothesis_id", "status", F.explode_outer("evidence_run_ids").alias("run_id"))
    facts = runs.select("project_id", "run_id", F.col("status").alias("run_status"), F.col("hypothesis_id").alias("tested"))
    joined = lookup_join(links, facts, ["project_id", "run_id"], "left")
    return joined.groupBy("project_id", "hypothesis_id").agg(
        F.count("run_id").alias("n_evidence"),
        F.count_if(F.col("run_id").isNotNull() & F.col("run_status").isNull()).alias("n_unknown"),
        F.count_if(F.col("run_status") != "finished").alias("n_unfinished"),
        F.max(F.coalesce(F.col("tested") == F.col("hypothesis_id"), F.lit(False))).alias("tested"))


def context_coverage(context: DataFrame, goals: DataFrame) -> DataFrame:
    known = context.groupBy("project_id").agg(F.countDistinct("feature").alias("registered"))
    return goals.select("project_id", (F.col("dataset_columns") - 1).alias("dataset_features")).join(
        known, "project_id", "left").select(
        "project_id", F.coalesce("registered", F.lit(0)).cast("bigint").alias("registered"), "dataset_features")


# pivots a stagnating project may be pointed to, in this order
PIVOTS = ("ensemble_probe", "fe_probe", "different_model_family", "forensics_run")


def suggested_pivots(streaks: DataFrame, runs: DataFrame, probes: DataFrame, forensics: DataFrame) -> DataFrame:
    """(project_id, pivot) for projects with a streak of two or more: what was never tried."""
    finished = scored(runs).groupBy("project_id").agg(F.count("*").alias("_n"))
    used = probes.groupBy("project_id").agg(
        F.max(F.col("probe") == "ensemble").alias("_ens"), F.max(F.col("probe") == "fe").alias("_fe"))
    probed = forensics.select("project_id").distinct().withColumn("_for", F.lit(True))
    table = streaks.filter("streak >= 2").select("project_id")
    for part in (finished, used, probed):
        table = table.join(part, "project_id", "left")
    no = F.lit(False)
    pivots = F.array(
        F.when((F.col("_n") >= 2) & ~F.coalesce("_ens", no), PIVOTS[0]), F.when(~F.coalesce("_fe", no), PIVOTS[1]),
        F.lit(PIVOTS[2]), F.when(F.col("_for").isNull(), PIVOTS[3]))
    return table.select("project_id", F.explode(F.filter(pivots, lambda p: p.isNotNull())).alias("pivot"))


def ensemble_members(runs: DataFrame, with_predictions: DataFrame) -> DataFrame:
    """Default members of an ensemble probe, and those skipped because they have no predictions."""
    have = with_predictions.select("run_id").distinct().withColumn("_have", F.lit(True))
    return scored(runs).select("project_id", "run_id").join(have, "run_id", "left").select(
        "project_id", "run_id", F.coalesce("_have", F.lit(False)).alias("has_predictions"))


def protocol_audit(
    runs: DataFrame, goals: DataFrame, hypotheses: DataFrame, diagnoses: DataFrame,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """(project_id, run_id, rule) for every run that broke a rule of the method when it started.

    One pass gives each run what its project looked like just before it; lookups add hypotheses,
    diagnoses and parents; then every rule is a predicate on the row.
    """
    policy = goals.select("project_id", "max_runs", "enforce_diagnosis", "max_train_hours")
    rows = lookup_join(runs, policy, PROJECT, "inner")
    rows = lookup_join(
        rows, diagnoses.select("run_id").distinct().withColumn("_diagnosed", F.lit(True)), ["run_id"], "left")
    open_end = F.coalesce("finished_at", F.lit("9999-01-01").cast("timestamp_ntz"))
    seconds = F.coalesce(F.try_variant_get(F.try_parse_json("meta"), "$.train_seconds", "double"), F.lit(0.0))
    last = F.when(is_scored(), F.struct("seq", F.coalesce("_diagnosed", F.lit(False)).alias("diagnosed")))
    before = running_fold(rows, PROJECT, "seq", {
        "_baseline": ("max", (F.col("status") == "finished") & (F.col("kind") == "baseline"), False),
        "_busy_until": ("max", open_end, False),
        "_started": ("sum", F.lit(1).cast("bigint"), False),
        "_seconds": ("sum", seconds, False),
        "_last": ("max", last, False),
    }, rows_per_chunk)
    known = hypotheses.select("project_id", "hypothesis_id", F.lit(True).alias("_known"), "resolved_seq")
    before = lookup_join(before, known, ["project_id", "hypothesis_id"], "left")
    parents = runs.select("project_id", F.col("run_id").alias("given_parent"), F.col("status").alias("_parent_status"))
    before = lookup_join(before, parents, ["project_id", "given_parent"], "left")
    no = F.lit(False)
    had_baseline = F.coalesce("_baseline", no)
    experiment, baseline = F.col("kind") == "experiment", F.col("kind") == "baseline"
    tests = F.col("hypothesis_id")
    rules = {
        "run_before_baseline": ~baseline & ~had_baseline,
        "second_baseline": baseline & had_baseline,
        "baseline_with_hypothesis": baseline & tests.isNotNull(),
        "experiment_without_hypothesis": experiment & tests.isNull(),
        "unknown_hypothesis": experiment & tests.isNotNull() & F.col("_known").isNull(),
        "resolved_hypothesis": experiment & (F.col("resolved_seq") < F.col("seq")),
        "overlapping_run": F.col("_busy_until") > F.col("created_at"),
        "run_budget_exhausted": F.col("_started") >= F.col("max_runs"),
        "time_budget_exhausted": F.col("_seconds") / 3600 >= F.col("max_train_hours"),
        "previous_not_diagnosed": experiment & F.col("enforce_diagnosis") & ~F.col("_last.diagnosed"),
        "unknown_parent": F.col("given_parent").isNotNull() & F.col("_parent_status").isNull(),
        "unfinished_parent": F.col("_parent_status") != "finished",
    }
    broken = F.filter(
        F.array(*[F.when(test, F.lit(rule)) for rule, test in rules.items()]), lambda r: r.isNotNull())
    by_run = before.select("project_id", "run_id", F.explode(broken).alias("rule"))
    links = evidence_links(hypotheses, runs)
    weak = links.filter("n_unknown > 0 or n_unfinished > 0 or not tested").select(
        "project_id", F.col("hypothesis_id").cast("string").alias("run_id"), F.lit("resolution_without_evidence").alias("rule"))
    return by_run.unionByName(weak)
