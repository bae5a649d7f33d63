"""Registered probes train with all folds and rounds and rank as many columns as their operators do."""

from assaykit.operators import combos, models
from assaykit.plans import queries_probe as q


def test_probes_are_not_cut(monkeypatch):
    seen = {}
    monkeypatch.setattr(q.v, "ratio", lambda *_: None)
    monkeypatch.setattr(q.v, "noisy", lambda *_: None)
    monkeypatch.setattr(models, "folded_vectors", lambda *_, k: seen.setdefault("k", set()).add(k) or (None, ["0", "1"]))
    monkeypatch.setattr(models, "tree_learner", lambda _, rounds: seen.setdefault("rounds", rounds))
    monkeypatch.setattr(models, "ml_out_of_fold", lambda rows, estimator, k, n: seen.setdefault("folds", k))
    monkeypatch.setattr(models, "fold_scores", lambda *_: None)
    monkeypatch.setattr(models, "reference_band", lambda rows, classes, k, rounds: seen.setdefault("band", (k, rounds)))
    monkeypatch.setattr(combos, "fe_probe", lambda df, y, names, top_k=5: seen.setdefault("probe", (len(names), top_k)))
    q.probe_learner_trees(None, None)
    q.reference_band(None, None)
    q.fe_probe(None, None)
    assert seen == {"k": {5}, "rounds": 200, "folds": 5, "band": (5, 200), "probe": (6, 5)}
