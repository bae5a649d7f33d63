"""Injected truths: every operator must find what was planted and nothing else."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.functions import hashing, ordering
from assaykit.functions.hashing import uniform
from assaykit.functions.metrics import (
    REGISTRY, approximate_median_significance, context_of, known_metric, positive_proba, resolve_metric,
)
from assaykit.operators import align, combos, diagnose, ensemble, featurize, forensics, learners, models, profile, regression, resample
from assaykit.operators import scoring
from assaykit.operators.scoring import metric_value, metrics_table


def u(salt):
    return uniform(F.col("row_id"), salt)


def base(spark, n, parts=4):
    return spark.range(0, n, 1, parts).withColumnRenamed("id", "row_id")


def preds(spark, n=2000, lift=0.2, noise="p", parts=4):
    d = base(spark, n, parts).withColumn("y_true", (u("y") < 0.4).cast("bigint"))
    p = F.round(0.1 + lift * F.col("y_true") + 0.6 * u(noise), 2)
    return d.withColumn("proba_1", p).withColumn("y_pred", (F.col("proba_1") >= 0.5).cast("bigint"))


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))


def test_metrics_against_numpy(spark):
    d = preds(spark)
    t = d.toPandas()
    y, s, h = t.y_true.to_numpy(), t.proba_1.to_numpy(), t.y_pred.to_numpy()
    value = lambda name: metric_value(d, known_metric(name)).first()["value"]
    assert value("roc_auc") == pytest.approx(auc(y, s))
    assert value("acc") == pytest.approx((y == h).mean())
    tp, fp, fn = ((y == 1) & (h == 1)).sum(), ((y == 0) & (h == 1)).sum(), ((y == 1) & (h == 0)).sum()
    assert value("precision") == pytest.approx(tp / (tp + fp))
    assert value("recall") == pytest.approx(tp / (tp + fn))
    assert value("f1") == pytest.approx(2 * tp / (2 * tp + fp + fn))
    assert value("logloss") == pytest.approx(-np.mean(np.where(y == 1, np.log(s), np.log(1 - s))))


def test_macro_metrics_count_labels_that_are_only_predicted(spark):
    d = spark.createDataFrame([("a", "a"), ("b", "a"), ("b", "b"), ("c", "d")], "y_true string, y_pred string")
    # recall: a 1, b 1/2, c 0, d 0
    assert metric_value(d, known_metric("recall")).first()["value"] == pytest.approx(1.5 / 4)


def test_metric_names():
    assert known_metric(" ROC_AUC ").name == "auc" and known_metric("nope") is None
    assert resolve_metric("nope", "regression")[0].name == "rmse" and resolve_metric("nope", "regression")[1]
    assert positive_proba(["proba_0", "proba_1"]) == "proba_1" and positive_proba(["proba_a", "proba_b", "proba_c"]) is None


def test_single_class_and_constant_target_give_null(spark):
    d = preds(spark, 100).withColumn("y_true", F.lit(1))
    assert metric_value(d, known_metric("auc")).first()["value"] is None
    r = base(spark, 10).select(F.lit(2.0).alias("y_true"), F.lit(1.0).alias("y_pred"))
    assert metric_value(r, known_metric("r2")).first()["value"] is None


def test_metrics_table_equals_single_metrics(spark):
    d = preds(spark).withColumn("run_id", F.when(F.col("row_id") % 3 == 0, "b").otherwise("a"))
    names = [m for m in REGISTRY if m.task == "classification"]
    table = {r["run_id"]: r for r in metrics_table(d, names, ["run_id"]).collect()}
    for m in names:
        for r in metric_value(d, m, ["run_id"]).collect():
            assert table[r["run_id"]][m.name] == pytest.approx(r["value"])


def test_noise_floor_is_near_the_binomial_formula_and_partition_free(spark):
    d = preds(spark, 4000)
    floor = lambda df: resample.noise_floor(df, known_metric("accuracy")).first()
    one, many = floor(d.repartition(1)), floor(d.repartition(32))
    p = metric_value(d, known_metric("accuracy")).first()["value"]
    assert one["std"] == pytest.approx((p * (1 - p) / 4000) ** 0.5, rel=0.2)
    assert one["std"] == pytest.approx(many["std"], abs=1e-12) and one["n_boot"] == 200
    assert one["ci_low"] < p < one["ci_high"]


def test_custom_metric_floor(spark):
    d = preds(spark, 500).withColumn("weight", 1 + u("w"))
    row = resample.noise_floor(d, approximate_median_significance()).first()
    assert row["metric"] == "ams" and row["std"] > 0


def test_rank_bins_keep_the_auc_floor(spark):
    d = preds(spark, 3000).withColumn("proba_1", 0.2 * F.col("y_true") + u("fine"))
    ctx = context_of(d)
    binned = resample.coarse_scores(d, ctx, 1 / 32)
    exact, rough = (metric_value(x, known_metric("auc")).first()["value"] for x in (d, binned))
    assert binned.select("proba_1").distinct().count() <= 65 and exact == pytest.approx(rough, abs=1 / 64)


def members(spark):
    one = preds(spark, 1500).withColumn("run_id", F.lit("one"))
    two = preds(spark, 1500, noise="q").withColumn("run_id", F.lit("two"))
    strong = preds(spark, 1500, lift=0.35).withColumn("run_id", F.lit("strong"))
    twin = strong.withColumn("run_id", F.lit("twin")).filter(u("h") < 0.9)
    return one.unionByName(two).unionByName(strong).unionByName(twin)


def test_paired_comparison_sees_a_real_gain_and_no_gain_between_twins(spark):
    d = members(spark)
    better = resample.compare_runs(d, "one", "strong", known_metric("auc")).first()
    same = resample.compare_runs(d, "strong", "twin", known_metric("auc")).first()
    assert better["significant"] and better["improvement"] > 0 and better["n_common"] == 1500
    assert not same["significant"] and same["improvement"] == 0 and same["bar"] == 1e-6


def test_disjoint_and_disagreeing_runs_are_refused(spark):
    a = preds(spark, 400).withColumn("run_id", F.when(F.col("row_id") < 200, "a").otherwise("b"))
    with pytest.raises(ValueError, match="share 0 rows"):
        resample.compare_runs(a, "a", "b", known_metric("auc"))
    flipped = members(spark).withColumn("y_true", F.when((F.col("run_id") == "two") & (F.col("row_id") == 3), 1 - F.col("y_true")).otherwise(F.col("y_true")))
    with pytest.raises(ValueError, match="different true labels"):
        ensemble.ensemble_probe(flipped, ["one", "two"], known_metric("auc"))


def test_repeated_row_ids_are_found_and_left_out_of_alignment(spark):
    d = members(spark)
    twice = d.unionByName(d.filter("run_id = 'one' and row_id < 30"))
    assert align.align(twice, ["one", "two"]).n_common == 1470
    found = align.unknown_row_ids(twice.select("run_id", "row_id"), base(spark, 1400))
    assert {r["problem"]: r["count"] for r in found.groupBy("problem").count().collect()} == {"not_in_dataset": 100, "repeated": 30}


def test_averaging_independent_members_pays(spark):
    row = ensemble.ensemble_probe(members(spark), ["one", "two"], known_metric("auc")).first()
    assert row["gain"] > 0 and row["verdict"] == "ensemble_worth_testing"


def test_multi_class_vote(spark):
    rows = [(r, run, "a", lab) for r in range(60) for run, lab in (("p", "b"), ("q", "c"), ("s", "c" if r else "a"))]
    d = spark.createDataFrame(rows, "row_id bigint, run_id string, y_true string, y_pred string")
    d = d.withColumn("y_true", F.when(F.col("row_id") % 3 == 0, "c").when(F.col("row_id") % 3 == 1, "b").otherwise("a"))
    pair = align.align(d, ["p", "q", "s"])
    votes = {r["row_id"]: r["y_pred"] for r in ensemble.vote(pair, context_of(pair.long())).collect()}
    assert votes[0] == "a" and votes[1] == "c"


def test_planted_slice_is_the_worst_and_carries_its_meaning(spark):
    d = preds(spark, 2000, lift=0.5).withColumn("y_pred", F.col("y_true"))
    d = d.withColumn("grp", (F.col("row_id") % 20).cast("string")).withColumn("num", u("num"))
    d = d.withColumn("y_pred", F.when(F.col("row_id") % 20 == 7, 1 - F.col("y_true")).otherwise(F.col("y_pred")))
    text = d.withColumn("grp", F.when(F.col("row_id") % 20 == 7, "bad").otherwise("ok"))
    meanings = spark.createDataFrame([("grp", "machine")], "feature string, meaning string")
    worst = diagnose.error_slices(diagnose.row_error(text), ["grp", "num"], meanings).orderBy(F.desc("lift")).first()
    assert (worst["feature"], worst["bucket"], worst["meaning"], worst["n"]) == ("grp", "bad", "machine", 100)
    assert worst["error"] == 1.0 and worst["lift"] == 20.0


def test_missing_values_get_their_own_bucket_and_count_as_errors(spark):
    d = base(spark, 200).select("row_id", F.lit(1).alias("y_true"), F.when(F.col("row_id") < 50, None).otherwise(F.lit(1)).alias("y_pred"),
                                F.when(F.col("row_id") < 50, None).otherwise(F.col("row_id")).cast("double").alias("x"))
    rows = diagnose.row_error(d)
    assert rows.agg(F.sum("error")).first()[0] == 50
    found = diagnose.error_slices(rows, ["x"]).collect()
    assert [(r["bucket"], r["n"], r["lift"]) for r in found] == [("nan", 50, 4.0)]


def test_constant_score_is_called_out(spark):
    d = preds(spark, 100).withColumn("proba_1", F.lit(0.5))
    assert diagnose.degenerate_scores(d, "proba_1").first().asDict() == {"n_distinct": 1, "degenerate": True}


def test_missed_positives_are_counted(spark):
    d = base(spark, 100).withColumn("y_true", (F.col("row_id") % 2).cast("bigint"))
    d = d.withColumn("y_pred", F.when(F.col("row_id") < 20, 0).otherwise(F.col("y_true")))
    assert diagnose.missed_positives(d, 1).first().asDict() == {"n_missed": 10, "n_caught": 40}


def test_unreachable_recall_is_null(spark):
    curve = spark.createDataFrame([(0.5, 0.1, 0.4), (0.4, 0.3, 0.7)], "score double, fpr double, tpr double")
    points = {r["point"]: r["value"] for r in diagnose.operating_points(curve).collect()}
    assert points["recall_at_10pct_overkill"] == 0.4 and points["overkill_for_80pct_recall"] is None


def test_residual_flags(spark):
    d = base(spark, 500).select(u("p").alias("y_pred"), (u("p") * (1 + u("e")) + 0.3).alias("y_true"))
    row = diagnose.residual_stats(d).first()
    assert row["biased"] and row["heteroscedastic"]
    tiny = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "y_true double, y_pred double")
    assert diagnose.residual_stats(tiny).first()["heteroscedasticity_corr"] == 0.0


# --- data forensics -----------------------------------------------------------------------------


def planted(spark, n=3000, flip=0.2):
    d = base(spark, n).withColumn("x1", u("a")).withColumn("x2", u("b"))
    d = d.withColumn("clean", (F.col("x1") + F.col("x2") > 1).cast("bigint"))
    return d.withColumn("y", F.when(u("c") < flip, 1 - F.col("clean")).otherwise(F.col("clean")))


def battery(spark, df, features=("x1", "x2")):
    prep = learners.prepare(df, "y", list(features))
    flagged = forensics.flag_issues(learners.out_of_fold(prep), len(prep.classes))
    signal = forensics.signal_check(prep)
    noise = forensics.label_noise(flagged, bool(signal.first()["has_signal"]))
    verdict = forensics.verdict(signal, noise, forensics.conflict_rate(df, list(features), "y"),
                                forensics.curve_verdict(forensics.learning_curve(prep)))
    return prep, flagged, signal.first(), noise.first(), verdict.first()


def test_planted_label_noise_is_estimated(spark):
    d = planted(spark)
    prep, flagged, signal, noise, verdict = battery(spark, d)
    assert signal["has_signal"] and 0.12 < noise["noise_rate"] < 0.28
    assert verdict["verdict"] == "data_limited"
    hits = flagged.filter("flagged").join(d, "row_id").agg(F.avg((d["y"] != F.col("clean")).cast("int"))).first()[0]
    assert hits > 0.75
    assert forensics.label_suspects(flagged, prep.classes).count() > 0


def test_no_signal_is_reported(spark):
    d = planted(spark).withColumn("y", (u("free") < 0.5).cast("bigint"))
    _, _, signal, noise, verdict = battery(spark, d)
    assert not signal["has_signal"] and noise["confidence"] == "low" and verdict["verdict"] == "no_signal"


def test_clean_labels_are_not_flagged(spark):
    _, _, _, noise, verdict = battery(spark, planted(spark, flip=0.0))
    assert noise["noise_rate"] < 0.08 and verdict["verdict"] in ("model_limited", "more_data_needed")


def test_confident_learning_matches_brute_force_with_three_classes(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 400)
    raw = rng.random((400, 3)) + 1.2 * np.eye(3)[(y + (rng.random(400) < 0.2)) % 3]
    p = np.round(raw / raw.sum(1, keepdims=True), 4)
    d = spark.createDataFrame([(i, int(y[i]), [float(v) for v in p[i]]) for i in range(400)], "row_id bigint, y bigint, probs array<double>")
    got = {r["row_id"] for r in forensics.flag_issues(d, 3).filter("flagged").collect()}
    t = np.array([p[y == c, c].mean() for c in range(3)])
    joint = np.zeros((3, 3))
    for i in range(400):
        sure = [c for c in range(3) if p[i, c] >= t[c]]
        if sure:
            joint[y[i], max(sure, key=lambda c: p[i, c])] += 1
    want = set()
    for i in range(3):
        for j in range(3):
            m = int(joint[i, j] * (y == i).sum() / joint[i].sum() + 0.5)
            if i != j and m:
                margins = sorted((round(p[r, j] - p[r, i], 4) for r in range(400) if y[r] == i), reverse=True)
                want |= {r for r in range(400) if y[r] == i and round(p[r, j] - p[r, i], 4) >= margins[m - 1]}
    want = {r for r in want if p[r].argmax() != y[r]}
    assert got == want and got


def places(spark, n):
    rows = spark.range(n).select(F.col("id"), hashing.uniform(F.col("id"), "prune").alias("u")).collect()
    return {r["id"]: (r["u"], r["id"]) for r in rows}


def flags_by_hand(y, p, order):
    """Per pair of classes the wanted number of largest margins, ties in hash order; also those numbers."""
    n, k = p.shape
    t = [p[y == c, c].mean() if (y == c).any() else 1.0 for c in range(k)]
    joint = np.zeros((k, k))
    for i in range(n):
        sure = [c for c in range(k) if p[i, c] >= t[c]]
        if sure:
            joint[y[i], max(sure, key=lambda c: (p[i, c], -c))] += 1
    taken, cut_through = set(), 0
    for i, j in zip(*np.nonzero(joint), strict=True):
        m = int(joint[i, j] * (y == i).sum() / joint[i].sum() + 0.5)
        if i != j and m:
            ranked = sorted((-round(p[r, j] - p[r, i], 4), *order[r]) for r in range(n) if y[r] == i)
            taken |= {x[2] for x in ranked[:m]}
            cut_through += m < len(ranked) and ranked[m][0] == ranked[m - 1][0]
    return {r for r in taken if p[r].argmax() != y[r]}, cut_through


def test_exactly_the_wanted_rows_are_flagged_where_margins_tie(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n, k = 600, 3
    y = rng.integers(0, k, n)
    weight = rng.integers(1, 4, (n, k)) + 2 * np.eye(k, dtype=int)[(y + (rng.random(n) < 0.3)) % k]
    p = np.round(weight / weight.sum(1, keepdims=True), 1)
    d = spark.createDataFrame([(i, int(y[i]), p[i].tolist()) for i in range(n)], "row_id bigint, y bigint, probs array<double>")
    want, cut_through = flags_by_hand(y, p, places(spark, n))
    assert cut_through > 0
    one = {r["row_id"] for r in forensics.flag_issues(d, k).filter("flagged").collect()}
    # ties ranked in many chunks, lookups shuffled instead of broadcast
    monkeypatch.setattr(forensics, "rank_by_hash", lambda *a: ordering.rank_by_hash(*a, rows_per_chunk=10))
    monkeypatch.setattr(forensics, "MAX_PAIRS", 1)
    many = {r["row_id"] for r in forensics.flag_issues(d.repartition(5), k).filter("flagged").collect()}
    assert one == want == many


def test_two_hundred_classes_are_pruned(spark):
    rng = np.random.default_rng(6)
    n, k = 1200, 200
    y = np.arange(n) % k
    looks = np.where(rng.random(n) < 0.1, (y + 1 + rng.integers(0, k - 1, n)) % k, y)
    p = np.full((n, k), 0.001)
    p[np.arange(n), looks] = np.round(0.5 + 0.3 * rng.random(n), 4)
    d = spark.createDataFrame([(i, int(y[i]), p[i].tolist()) for i in range(n)], "row_id bigint, y bigint, probs array<double>")
    want, _ = flags_by_hand(y, p, places(spark, n))
    got = {r["row_id"] for r in forensics.flag_issues(d, k).filter("flagged").collect()}
    assert got == want and len(got) > 50


@pytest.mark.parametrize("classes", [2, 3])
def test_importance_equals_rows_rescored_one_by_one(spark, classes):
    d = base(spark, 900).withColumn("x1", u("a")).withColumn("x2", u("b")).withColumn("x3", u("c"))
    d = d.withColumn("y", F.floor(F.least(F.col("x1") * 0.8 + F.col("x2") * 0.3, F.lit(0.99)) * classes).cast("bigint"))
    prep = learners.prepare(d, "y", ["x1", "x2", "x3"])
    got = {r["feature"]: r["importance"] for r in learners.importance(prep, repeats=2).collect()}
    counts = learners.counts_array(learners.cell_counts(prep.rows, ["y"], []), (1, classes, prep.binner.n_cells), [])
    weights, prior = (x[0] for x in learners.log_odds(counts, prep.binner))
    rows = resample.shuffle_column(prep.rows, "cells", {"m0": "perm0", "m1": "perm1"}).collect()

    def hit(cells, y):
        logits = [prior[c] + sum(weights[c][x] for x in cells) for c in range(classes - 1)]
        raw = np.exp([0.0, *logits])
        grid = np.floor(raw / raw.sum() * 1e4 + 0.5) / 1e4
        return (grid[1] > 0.5) == (y == 1) if classes == 2 else grid.argmax() == y

    before = np.mean([hit(r["cells"], r["y"]) for r in rows])
    for f, name in enumerate(prep.binner.names):
        swap = lambda r, m: [*r["cells"][:f], r[m][f], *r["cells"][f + 1:]]
        after = np.mean([hit(swap(r, m), r["y"]) for r in rows for m in ("m0", "m1")])
        assert got[name] == pytest.approx(before - after)
    assert got["x1"] > got["x3"]


def test_importance_of_five_hundred_features(spark):
    wide = base(spark, 300).select("row_id", (u("c0") > 0.5).cast("bigint").alias("y"), *[u(f"c{i}").alias(f"c{i}") for i in range(500)])
    found = learners.importance(learners.prepare(wide, "y", [f"c{i}" for i in range(500)], bins=4), repeats=1).collect()
    assert len(found) == 500 and max(found, key=lambda r: r["importance"])["feature"] == "c0"


def test_metrics_table_reads_the_predictions_once(spark, tmp_path, monkeypatch):
    d = spark.createDataFrame([(f"r{i % 2}", i, i % 2, (i // 2) % 2, i % 5 / 5) for i in range(80)],
                              "run_id string, row_id int, y_true int, y_pred int, proba_1 double")
    written = []
    monkeypatch.setattr(scoring, "cut_lineage", lambda df: written.append(df) or df.cache())
    wanted = [m for m in REGISTRY if m.task == "classification"]
    ctx = context_of(d)
    table = {r["run_id"]: r for r in metrics_table(d, wanted, ["run_id"], ctx).collect()}
    assert len(written) == 1
    for m in wanted:
        for r in metric_value(d, m, ["run_id"], ctx).collect():
            assert table[r["run_id"]][m.name] == pytest.approx(r["value"])


def test_conflicts_with_missing_labels(spark):
    rows = [("a", 1), ("a", 1), ("a", 0), ("a", None), ("b", None), ("b", None), ("c", 1), (None, 0), (None, 1)]
    d = spark.createDataFrame(rows, "f string, y int")
    row = forensics.conflict_rate(d, ["f"], "y").first()
    # a: 4 rows, majority 2; b has no label at all; missing features form a group
    assert row["n"] == 9 and row["duplicate_fraction"] == pytest.approx(8 / 9) and row["error_lower_bound"] == pytest.approx(3 / 9)
    assert forensics.duplicate_rows(d, ["f"]).count() == 8


def test_leakage_and_signal_ranking(spark):
    d = planted(spark).withColumn("leak", F.col("y") + 0.1 * F.col("x1"))
    prep = learners.prepare(d, "y", ["x1", "leak"])
    assert {r["feature"]: r["leakage"] for r in forensics.leakage_check(prep).collect()} == {"x1": False, "leak": True}
    assert forensics.feature_signal(prep).orderBy("rank").first()["feature"] == "leak"


def test_stratified_folds_are_even_and_shuffles_keep_counts(spark):
    d = base(spark, 3000).withColumn("y", (u("y") < 0.1).cast("bigint"))
    folds = resample.stratified_kfold(d, "y", 5, rows_per_chunk=400).groupBy("y", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in folds if r["y"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    moved = resample.shuffle_column(d, "y", {"z": "s1"}, rows_per_chunk=400)
    assert moved.agg(F.sum("y") == F.sum("z"), F.abs(F.corr("y", "z")) < 0.08).first()[:] == (True, True)


def test_folds_and_cycles_do_not_depend_on_chunks_or_other_labels(spark):
    d = base(spark, 1000).withColumn("y", F.when(u("y") < 0.1, "rare").when(u("y") < 0.9, "often"))
    folds = lambda df, rows: {r["row_id"]: (r["y"], r["fold"]) for r in resample.stratified_kfold(df, "y", rows_per_chunk=rows).collect()}
    one = folds(d, 10**6)
    assert one == folds(d.repartition(7), 90) and len(one) == 1000
    rare = {row: fold for row, (y, fold) in one.items() if y == "rare"}
    more = d.unionByName(d.select((F.col("row_id") + 5000).alias("row_id"), *[c for c in d.columns if c not in ("row_id", "y")], F.lit("often").alias("y")))
    grown = folds(more, 90)
    assert rare == {row: grown[row][1] for row in rare}
    cycle = lambda rows: {r["row_id"]: (r["a"], r["b"]) for r in resample.shuffle_column(
        d, "row_id", {"a": "s1", "b": "s2"}, rows_per_chunk=rows).collect()}
    small = cycle(30)
    assert small == cycle(10**6)
    # one cycle through the whole table
    at, seen = 0, set()
    while at not in seen:
        seen.add(at)
        at = small[at][0]
    assert len(seen) == 1000


def test_few_rows_lower_the_number_of_folds(spark):
    d = base(spark, 60).withColumn("x1", u("a")).withColumn("y", (F.col("row_id") < 3).cast("bigint"))
    assert learners.prepare(d, "y", ["x1"]).k == 3


def test_additive_contributions_sum_to_the_score(spark):
    prep = learners.prepare(planted(spark), "y", ["x1", "x2"])
    low = prep.rows.filter("y = 1")
    found = learners.contributions(prep, low).collect()
    assert len(found) == 2 and all(r["contribution"] > 0 for r in found)


def test_long_models_fold_over_the_array(spark, monkeypatch):
    d = planted(spark, 800)
    for i in range(14):
        d = d.withColumn(f"n{i}", u(f"n{i}"))
    prep = learners.prepare(d, "y", ["x1", "x2", *[f"n{i}" for i in range(14)]])
    scores = lambda: {r["row_id"]: r["p"] for r in learners.out_of_fold(prep).collect()}
    folded = scores()
    monkeypatch.setattr(learners, "WRITTEN_OUT", 100)
    assert scores() == pytest.approx(folded)


def test_regression_probe(spark):
    d = planted(spark).withColumn("y", 3 * F.col("x1") - 2 * F.col("x2") + 0.3 * u("e"))
    prep = regression.prepare_regression(d, "y", ["x1", "x2"])
    row = regression.signal_check(prep).first()
    assert row["score_real"] > 0.9 and row["has_signal"] and abs(row["score_shuffled_mean"]) < 0.05
    curve = regression.learning_curve(prep).orderBy("size").collect()
    assert len(curve) == 6 and curve[-1]["score_valid"] > 0.9


# --- feature probe ------------------------------------------------------------------------------


def test_interaction_is_found_by_its_product(spark):
    d = base(spark, 3000)
    for i in range(3):
        d = d.withColumn(f"x{i}", 2 * u(f"x{i}") - 1)
    d = d.withColumn("y", (F.col("x0") * F.col("x1") > 0).cast("bigint"))
    gains = combos.fe_probe(d, "y", ["x0", "x1", "x2"])
    found = {r["candidate"]: r for r in gains.collect()}
    assert found["product(x0,x1)"]["significant"] and found["product(x0,x1)"]["gain"] > 0.3
    assert combos.fe_verdict(gains, 9).first()["verdict"] == "fe_worth_testing"


def test_single_feature_target_needs_no_combinations(spark):
    d = base(spark, 3000)
    for i in range(3):
        d = d.withColumn(f"x{i}", 0.5 + 1.5 * u(f"x{i}"))
    d = d.withColumn("y", (F.col("x0") > 1.25).cast("bigint"))
    gains = combos.fe_probe(d, "y", ["x0", "x1", "x2"])
    assert combos.fe_verdict(gains, 9).first()["verdict"] == "fe_unlikely_to_help"


def test_ratio_with_zero_denominator_takes_the_median(spark):
    d = spark.createDataFrame([(1, 2.0, 0.0), (2, 6.0, 2.0), (3, 8.0, 4.0), (4, 5.0, 1.0)], "row_id bigint, a double, b double")
    wide, made = combos.arithmetic_combos(d, ["a", "b"])
    assert [c.name for c in made] == ["diff(a,b)", "product(a,b)", "ratio(a,b)"]
    assert wide.filter("row_id = 1").first()["ratio(a,b)"] == 3.0


# --- encodings and models -------------------------------------------------------------------------


def test_encodings(spark):
    d = spark.createDataFrame([(1, 1.0, "a", None), (2, None, None, None), (3, 3.0, "b", None), (4, float("nan"), "a", None)],
                              "row_id bigint, n double, t string, empty double")
    filled, gone = featurize.impute_median(d, ["n", "empty"])
    assert [r["n"] for r in filled.orderBy("row_id").collect()] == [1.0, 2.0, 3.0, 2.0] and gone == ["empty"]
    hot, dropped = featurize.one_hot(d, ["t"])
    assert hot.columns[-3:] == ["t_a", "t_b", "t_nan"] and not dropped
    many = base(spark, 40).withColumn("t", F.col("row_id").cast("string"))
    assert featurize.one_hot(many, ["t"])[1] == ["t"]


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(0)
    x, y, fold = rng.random((300, 4)), rng.integers(0, 3, 300), rng.integers(0, 4, 300)
    d = spark.createDataFrame([(i, int(y[i]), int(fold[i]), [float(v) for v in x[i]]) for i in range(300)],
                              "row_id bigint, y bigint, fold bigint, x array<double>")
    got = {r["row_id"]: r["probs"] for r in models.knn_out_of_fold(d, 7, 3).collect()}
    for i in range(300):
        other = np.flatnonzero(fold != fold[i])
        near = other[np.argsort(((x[other] - x[i]) ** 2).sum(1), kind="stable")[:7]]
        assert np.allclose(got[i], [(y[near] == c).mean() for c in range(3)])


def test_isolation_forest_singles_out_the_outlier(spark):
    d = base(spark, 600).select("row_id", F.when(F.col("row_id") == 5, F.array(F.lit(9.0), F.lit(9.0))).otherwise(F.array(u("a"), u("b"))).alias("x"))
    scores = models.isolation_score(d, trees=30).orderBy("score").collect()
    assert scores[0]["row_id"] == 5 and -1 <= scores[0]["score"] < scores[-1]["score"] <= 0


def test_profile_and_advisory(spark):
    d = base(spark, 100).withColumn("y", (F.col("row_id") < 85).cast("int"))
    assert profile.metric_advisory(d, "y", "classification", "accuracy").first()["advise_other_metric"]
    assert not profile.metric_advisory(d, "y", "classification", "auc").first()["advise_other_metric"]
    assert profile.metric_advisory(d, "y", "classification", "rmse").first()["refused"]
    a = profile.content_hash(d.repartition(1), [F.col("row_id"), F.col("y")]).first()
    b = profile.content_hash(d.repartition(9), [F.col("row_id"), F.col("y")]).first()
    c = profile.content_hash(d.withColumn("y", F.lit(1)), [F.col("row_id"), F.col("y")]).first()
    assert a == b and a != c


def test_contract_checks(spark):
    bad = spark.createDataFrame([("r1", 1)], "run_id string, row_id bigint")
    codes = {r["code"] for r in profile.validate_predictions(bad, "classification", spark.createDataFrame([("r1",), ("r2",)], "run_id string")).collect()}
    assert codes == {"missing_column:y_true", "missing_column:y_pred", "no_probabilities", "no_rows"}
    metas = [("ok", '{"model_desc": "m", "hyperparams": {}, "features": [], "seed": 1, "train_seconds": 2, "feature_importance": {}}'),
             ("bad", '{"model_desc": 3, "hyperparams": [], "seed": 1.5}'), ("text", "nope"), ("list", "[]"), ("none", None)]
    found = profile.validate_meta(spark.createDataFrame(metas, "run_id string, meta string")).collect()
    by = lambda run: sorted(r["code"] for r in found if r["run_id"] == run)
    assert by("ok") == [] and by("text") == ["meta_not_json"] and by("list") == ["meta_not_object"] and by("none") == ["meta_missing"]
    assert by("bad") == ["advised:feature_importance", "advised:train_seconds", "missing_key:features", "wrong_type:hyperparams", "wrong_type:model_desc", "wrong_type:seed"]
