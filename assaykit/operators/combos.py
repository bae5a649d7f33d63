"""Which engineered features are worth a run?

Candidates are priced on shared folds with the additive learner: base score plus the candidate's
own weight. All candidates are trained by one count and scored by one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import exact_quantiles
from .diagnose import distinct_up_to, is_number
from .featurize import impute_median
from .forensics import _outcome, mutual_information
from .learners import (
    Prepared, cell_counts, counts_array, grouped_score, importance, log_odds, logit, models_frame, prepare,
    WRITTEN_OUT, with_models,
)

MIN_GAIN = 0.005
TOP_COMBOS = 6


def usable_numeric(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Numeric features with more than two distinct values."""
    numeric = [f.name for f in df.schema.fields if f.name in features and is_number(f)]
    sizes = distinct_up_to(df, numeric, 2)
    return [c for c in numeric if sizes[c] > 2]


@dataclass(frozen=True)
class Combo:
    kind: str
    a: str
    b: str

    @property
    def name(self) -> str:
        return f"{self.kind}({self.a},{self.b})"


def pairs(columns: Sequence[str]) -> list[Combo]:
    """Difference, product and ratio of every pair of columns (columns, not rows)."""
    return [
        Combo(kind, a, b)
        for i, a in enumerate(columns) for b in columns[i + 1 :] for kind in ("diff", "product", "ratio")
    ]


def _safe_ratio(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) > 1e-12, a / b)


def arithmetic_combos(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[Combo]]:
    """Add all combinations; a ratio with a denominator near zero takes the median ratio (zero if
    there is none)."""
    combos = pairs(columns)
    ratios = {c.name: _safe_ratio(F.col(c.a), F.col(c.b)) for c in combos if c.kind == "ratio"}
    probe = df.select(*[r.alias(n) for n, r in ratios.items()])
    medians = exact_quantiles(probe, {n: [0.5] for n in ratios}) if ratios else {}
    added = {}
    for c in combos:
        a, b = F.col(c.a), F.col(c.b)
        if c.kind == "diff":
            added[c.name] = a - b
        elif c.kind == "product":
            added[c.name] = a * b
        else:
            middle = medians[c.name][0]
            added[c.name] = F.coalesce(ratios[c.name], F.lit(0.0 if middle is None else middle))
    return df.withColumns(added), combos


def _add_weights(total: Column, weights: Column, at: Sequence[int]) -> Column:
    """``total`` plus the weights of the cells at positions ``at``; many are folded over, not written out."""
    if len(at) > WRITTEN_OUT:
        return F.aggregate(F.array(*[F.lit(i) for i in at]), total, lambda acc, i: acc + F.get(weights, F.get("cells", i)))
    return sum((F.get(weights, F.get("cells", F.lit(i))) for i in at), total)


def fold_gains(prep: Prepared, base: Sequence[str], sets: dict[str, Sequence[str]]) -> DataFrame:
    """(candidate, fold, value, base): fold scores of the base features plus each candidate set."""
    names = list(prep.binner.names)
    position = {n: i for i, n in enumerate(names)}
    shape = (1, prep.k, len(prep.classes), prep.binner.n_cells)
    own = counts_array(cell_counts(prep.rows, ["y"], ["fold"]), shape, ["fold"])[0]
    weights, priors = log_odds(own.sum(axis=0, keepdims=True) - own, prep.binner)
    scored = with_models(prep.rows, models_frame(prep.rows.sparkSession, weights, priors))
    width = len(prep.classes) - 1
    at_base = [position[c] for c in base if c in position]
    scored = scored.withColumn("_base", F.array(*[logit(c, len(names), only=at_base) for c in range(width)]))

    def entry(name: str, extra: Sequence[str]) -> Column:
        logits = []
        for c in range(width):
            at = [position[e] for e in extra if e in position]
            total = _add_weights(F.col("_base").getItem(c), F.col("w").getItem(c), at)
            logits.append(total)
        return F.struct(F.lit(name).alias("candidate"), *_outcome(logits, F.col("y")))

    entries = F.array(entry("", ()), *[entry(n, extra) for n, extra in sets.items()])
    long = scored.select("fold", F.explode(entries).alias("s")).select("fold", "s.*")
    folds = grouped_score(long, ["candidate", "fold"], prep.binary)
    plain = folds.filter("candidate = ''").select("fold", F.col("value").alias("base"))
    return folds.filter("candidate <> ''").join(F.broadcast(plain), "fold").select("candidate", "fold", "value", "base")


def paired_gain(folds: DataFrame) -> DataFrame:
    """Mean paired difference per candidate; significant beyond three standard errors and 0.005."""
    diff = F.col("value") - F.col("base")
    out = folds.groupBy("candidate").agg(
        F.avg(diff).alias("gain"), (F.stddev_samp(diff) / F.sqrt(F.count("*"))).alias("sem"))
    bar = F.greatest(3 * F.col("sem"), F.lit(MIN_GAIN))
    return out.select("candidate", "gain", "sem", (F.col("gain") > bar).alias("significant"))


def rank_numeric(prep: Prepared, columns: Sequence[str], top_k: int = 5) -> list[str]:
    """Columns by permutation importance; by mutual information when fewer than two matter."""
    found = {r["feature"]: r["importance"] for r in importance(prep).collect()}
    if sum(found.get(c, 0.0) > 0 for c in columns) < 2:
        found = information(prep)
    return sorted(columns, key=lambda c: (-found.get(c, 0.0), c))[:top_k]


def information(prep: Prepared) -> dict[str, float]:
    shape = (1, len(prep.classes), prep.binner.n_cells)
    counts: np.ndarray = counts_array(cell_counts(prep.rows, ["y"], []), shape, [])[0]
    b = prep.binner
    return {n: mutual_information(counts[:, s : s + z]) for n, s, z in zip(b.names, b.starts, b.sizes)}


def best_combos(info: dict[str, float], names: Sequence[str], most: int = TOP_COMBOS) -> list[str]:
    """The most informative names; equal to nine decimals means equal, then by name."""
    return sorted(names, key=lambda n: (-round(info.get(n, 0.0), 9), n))[:most]


def fe_probe(
    df: DataFrame, target: str, features: Sequence[str], top_k: int = 5, k: int = 5, seed: int = 0,
    stacked: DataFrame | None = None,
) -> DataFrame:
    """Gains of the combined set, of the most informative combinations, and of stacked features.

    ``stacked`` may bring more candidate columns per row_id (anomaly score, neighbour prediction).
    Columns: candidate, gain, sem, significant.
    """
    base = prepare(df, target, features, k, seed)
    columns = usable_numeric(df, [c for c in features if c in base.binner.names])
    filled, _ = impute_median(df, columns)
    ranked = rank_numeric(base, columns, top_k) if len(columns) >= 2 else []
    wide, combos = arithmetic_combos(filled, ranked)
    extra = [c for c in stacked.columns if c != "row_id"] if stacked is not None else []
    if stacked is not None:
        wide = wide.join(stacked, "row_id")
    names = [c.name for c in combos]
    if not names and not extra:
        raise ValueError("no candidates to price")
    aug = prepare(wide, target, [*features, *names, *extra], k, seed)
    sets = {"combined": names} if names else {}
    sets |= {e: [e] for e in extra}
    info = information(aug)
    best = best_combos(info, names)
    # all of them in one pass; single combinations are only reported when the combined set helps
    gains = paired_gain(fold_gains(aug, list(features), sets | {n: [n] for n in best}))
    helps = [r for r in gains.filter("candidate = 'combined'").collect() if r["significant"] or r["gain"] > MIN_GAIN]
    return gains if helps else gains.filter(~F.col("candidate").isin(best))


def fe_verdict(gains: DataFrame, n_swept: int) -> DataFrame:
    """Best significant candidate, else the best of all."""
    order = F.struct(F.col("significant"), F.col("gain"), F.col("candidate"))
    top = gains.agg(F.max(order).alias("t"))
    sure = F.coalesce(F.col("t.significant"), F.lit(False))
    return top.select(
        F.when(sure, "fe_worth_testing").otherwise("fe_unlikely_to_help").alias("verdict"),
        F.col("t.candidate").alias("best_candidate"), F.col("t.gain").alias("best_gain"),
        F.lit(n_swept).cast("bigint").alias("n_swept"))


