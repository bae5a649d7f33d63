"""Boosted trees: splits against brute force, every kind of target, independence of partitioning."""

import numpy as np
import pytest

from assaykit.operators import boosting, models


def table(spark, x, y, fold):
    rows = [(i, int(a) if np.issubdtype(y.dtype, np.integer) else float(a), int(f), [float(v) for v in p]) for i, (p, a, f) in enumerate(zip(x, y, fold))]
    kind = "bigint" if np.issubdtype(y.dtype, np.integer) else "double"
    return spark.createDataFrame(rows, f"row_id bigint, y {kind}, fold bigint, x array<double>")


def test_first_split_is_the_best_one():
    rng = np.random.default_rng(1)
    binned, g, h = rng.integers(0, 6, (90, 3)), rng.normal(size=90), rng.random(90) + 0.1
    gains = {}
    for j in range(3):
        for b in range(6):
            left = binned[:, j] <= b
            if 7 <= left.sum() <= 83:
                gains[j, b] = sum(g[m].sum() ** 2 / h[m].sum() for m in (left, ~left))
    feature, cut, value, leaf = boosting.grow_tree(binned, g, h, 1, 7, 0.5)
    assert (feature[0], cut[0]) == max(gains, key=gains.get)
    side = binned[:, feature[0]] > cut[0]
    assert np.array_equal(leaf, side.astype(int))
    assert np.allclose(value, [-0.5 * g[m].sum() / h[m].sum() for m in (~side, side)])


def test_edges():
    assert list(boosting.bin_edges(np.array([3.0, 1.0, 1.0]))) == [2.0]
    assert len(boosting.bin_edges(np.ones(5))) == 0
    assert len(boosting.bin_edges(np.arange(1000.0), 10)) == 9


@pytest.mark.parametrize("n_classes", [2, 3, None])
def test_interactions_are_learnt(spark, n_classes):
    rng = np.random.default_rng(2)
    x, fold = rng.random((900, 3)), rng.integers(0, 3, 900)
    cell = (x[:, 0] > 0.5).astype(int) ^ (x[:, 1] > 0.5)
    y = {2: cell, 3: cell + (x[:, 2] > 0.5) * cell, None: cell * 2.0}[n_classes]
    df = table(spark, x, y, fold)
    learner = models.tree_learner(n_classes, 40)
    scored = models.ml_out_of_fold(df, learner, 3, n_classes)
    rows = {r["row_id"]: r for r in scored.collect()}
    assert len(rows) == 900
    if n_classes:
        p = np.array([rows[i]["probs"] for i in range(900)])
        assert np.allclose(p.sum(1), 1) and (p.argmax(1) == y).mean() > 0.93
    else:
        assert np.mean([(rows[i]["prediction"] - y[i]) ** 2 for i in range(900)]) < 0.1
    assert min(r["value"] for r in models.fold_scores(scored, n_classes).collect()) > 0.8
    again = models.ml_out_of_fold(df.repartition(7), learner, 3, n_classes)
    assert {r["row_id"]: r for r in again.collect()} == rows


def test_training_rows_are_bounded_and_all_rows_scored(spark):
    rng = np.random.default_rng(3)
    x, fold = rng.random((400, 1)), rng.integers(0, 2, 400)
    df = table(spark, x, (x[:, 0] > 0.5).astype(int), fold)
    learner = boosting.BoostedTrees(2, rounds=3, max_train=100, min_rows=5)
    assert learner.train(df, 2).filter("round >= 0").count() == 6
    assert learner.out_of_fold(df, 2).count() == 400


def test_failing_models_are_recorded(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.random((120, 2))
    df = table(spark, x, (x[:, 0] > 0.5).astype(int), np.arange(120) % 2)

    def broken(*_):
        raise ValueError("cannot be trained")

    monkeypatch.setattr(models, "linear_learner", broken)
    out = {r["model"]: r for r in models.reference_band(df, ["0", "1"], 2, rounds=5).collect()}
    assert out["linear"]["error"] == "ValueError: cannot be trained" and not out["linear"]["best"]
    assert all(r["error"] is None for name, r in out.items() if name != "linear")
    monkeypatch.setattr(models, "linear_learner", lambda *_: (_ for _ in ()).throw(NameError("a defect")))
    with pytest.raises(NameError):
        models.reference_band(df, ["0", "1"], 2, rounds=5)


@pytest.mark.parametrize("n_classes", [2, 3, None])
def test_trees_from_sums_are_those_of_all_rows(spark, n_classes):
    rng = np.random.default_rng(6)
    x, fold = rng.random((3000, 2)), rng.integers(0, 3, 3000)
    x[:, 1] = np.round(x[:, 1], 1)
    cell = (x[:, 0] > 0.5).astype(int) ^ (x[:, 1] > 0.45)
    y = {2: cell, 3: cell + (x[:, 0] > 0.7) * cell, None: cell + np.round(rng.random(3000) * 4) / 4}[n_classes]
    df = table(spark, x, y, fold)
    plain, sums = (boosting.BoostedTrees(n_classes, rounds=6, at_once=n) for n in (10_000, 0))
    trees = [{(r["fold"], r["round"], r["klass"]): r for r in t.train(df, 3).collect()} for t in (plain, sums)]
    assert set(trees[0]) == set(trees[1]) and len(trees[0]) == 3 * (6 * (3 if n_classes == 3 else 1) + 1)
    for at, tree in trees[0].items():
        assert tree["feature"] == trees[1][at]["feature"]
        assert np.allclose(tree["threshold"], trees[1][at]["threshold"], rtol=1e-12)
        assert np.allclose(tree["value"], trees[1][at]["value"])


def test_edges_of_folds_are_those_of_the_rows_outside(spark):
    rng = np.random.default_rng(7)
    x, fold = np.column_stack([rng.random(2500), rng.integers(0, 300, 2500) // 2, np.ones(2500)]), rng.integers(0, 3, 2500)
    got = boosting.fold_edges(table(spark, x, fold, fold), 3)
    for f in range(3):
        for j in range(3):
            assert np.allclose(got[f][j], boosting.bin_edges(x[fold != f, j]), rtol=1e-13, atol=0)
    alone = boosting.fold_edges(table(spark, x[:50], fold[:50], np.zeros(50)), 3)
    assert set(alone) == {1, 2} and len(alone[1]) == 3


def test_all_rows_train_the_trees(spark):
    """In the old way 20,000 rows of a larger table trained: trees then hold few of the rows of rare cells."""
    n = boosting.AT_ONCE + 10_000
    df = spark.range(n).selectExpr("id AS row_id", "CAST(id % 1501 = 0 AS bigint) AS y", "id % 2 AS fold", "array(CAST(id % 1501 = 0 AS double), 0D) AS x")
    # a cell of min_rows rows outside the fold in the whole table only is told apart
    outside = df.filter("y = 1").groupBy("fold").count().collect()
    least = min(r["count"] for r in outside)
    learner = boosting.BoostedTrees(2, rounds=1, min_rows=least)
    roots = learner.train(df, 2).filter("round = 0").collect()
    assert len(roots) == 2 and all(r["threshold"][0] == 0.5 for r in roots)
