"""Is the ceiling set by the data or by the modelling?"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..functions.joins import lookup_join
from ..functions.ordering import rank_by_hash
from ..session import cut_lineage
from .learners import (
    Prepared, arg_max, cell_counts, counts_array, fold_models, grouped_score, log_odds, logit, models_frame,
    on_grid, out_of_fold, predicts, with_models,
)
from .resample import learning_sizes, shuffle_column

NOISE_ALARM = 0.08
SIZES = (0.2, 0.36, 0.52, 0.68, 0.84, 1.0)
QUICK_SIZES = (0.2, 0.2 + 0.8 / 3, 0.2 + 1.6 / 3, 1.0)


def _outcome(logits: Sequence[Column], label: Column) -> list[Column]:
    if len(logits) == 1:
        return [on_grid(1 / (1 + F.exp(-logits[0]))).alias("p"), label.alias("y")]
    return [predicts(logits, label).alias("hit")]


def signal_check(prep: Prepared, shuffles: int = 3, salt: str = "labels") -> DataFrame:
    """Cross-validated score on the real labels against shuffled labels, trained in one pass."""
    salts = {f"y{r}": f"{salt}{r}" for r in range(1, shuffles + 1)}
    # read twice (training and scoring), so the sorted copies are written once
    rows = cut_lineage(shuffle_column(prep.rows, "y", salts))
    labels = ["y", *salts]
    weights, priors = fold_models(prep, labels, rows)
    scored = with_models(rows, models_frame(rows.sparkSession, weights, priors))
    n, width = len(prep.binner.names), len(prep.classes) - 1
    copies = F.array(*[
        F.struct(F.lit(i).alias("replica"),
                 *_outcome([logit(i * width + c, n) for c in range(width)], F.col(label)))
        for i, label in enumerate(labels)
    ])
    long = scored.select("fold", F.explode(copies).alias("s")).select("fold", "s.*")
    folds = grouped_score(long, ["replica", "fold"], prep.binary)
    return signal_summary(folds.groupBy("replica").agg(F.avg("value").alias("score")))


def signal_summary(scores: DataFrame) -> DataFrame:
    """From (replica, score), replica 0 being the real labels."""
    real = F.max(F.when(F.col("replica") == 0, F.col("score")))
    fake = F.when(F.col("replica") > 0, F.col("score"))
    spread = F.when(F.stddev_pop(fake) > 0, F.stddev_pop(fake)).otherwise(F.lit(1e-6))
    out = scores.agg(real.alias("score_real"), F.avg(fake).alias("score_shuffled_mean"), spread.alias("score_shuffled_std"))
    gap, std = F.col("gap"), F.col("score_shuffled_std")
    signal = gap > F.greatest(3 * std, F.lit(0.02))
    sure = F.when(signal, gap > 0.1).otherwise(gap < std)
    return out.withColumn("gap", F.col("score_real") - F.col("score_shuffled_mean")).select(
        "*", signal.alias("has_signal"), F.when(sure, "high").otherwise("medium").alias("confidence"))


# --- label noise (confident learning, Northcutt et al. 2021) -------------------------------------


def class_thresholds(scored: DataFrame, classes: int) -> list[float]:
    """Mean probability of class c among rows labelled c."""
    means = scored.groupBy("y").agg(F.avg(F.element_at("probs", (F.col("y") + 1).cast("int"))).alias("t")).collect()
    found = {r["y"]: r["t"] for r in means}
    return [found.get(c, 1.0) for c in range(classes)]


def likely_label(thresholds: Sequence[float]) -> Column:
    """Most probable class among those at or above their threshold; null when there is none."""
    cut = F.array(*[F.lit(float(t)) for t in thresholds])
    sure = F.zip_with("probs", cut, lambda p, t: F.when(p >= t, p).otherwise(F.lit(-1.0)))
    best = F.array_max(sure)
    return F.when(best >= 0, (F.array_position(sure, best) - 1).cast("bigint"))


#: Entries (label, other class) of a table of labels that is broadcast.
MAX_PAIRS = 4_000_000


def prune_numbers(scored: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(y, other, need): how many rows labelled y look like another class, scaled so that the numbers of a
    label, its own included, sum to its rows."""
    cells = scored.groupBy("y", likely_label(thresholds).alias("other")).agg(F.count("*").alias("n"))
    # at most one row per class
    own = Window.partitionBy("y")
    size, known = F.sum("n").over(own), F.sum(F.when(F.col("other").isNotNull(), F.col("n"))).over(own)
    need = F.floor(F.col("n") * size.cast("double") / known + 0.5).cast("bigint")
    return cells.select("y", "other", need.alias("need")).filter("other is not null and other <> y and need > 0")


def _with_pairs(rows: DataFrame, pairs: DataFrame, classes: int, how: str) -> DataFrame:
    """``rows`` with ``_pairs``, the entries of ``pairs`` for their label: one row per label is looked up."""
    entry = F.struct(*[c for c in pairs.columns if c != "y"])
    by_label = pairs.groupBy("y").agg(F.collect_list(entry).alias("_pairs"))
    return lookup_join(rows, by_label, ["y"], how, broadcast_rows=max(1, MAX_PAIRS // classes))


def _margin(other: Column) -> Column:
    return on_grid(F.get("probs", other.cast("int")) - F.element_at("probs", (F.col("y") + 1).cast("int")))


def margin_cuts(scored: DataFrame, needs: DataFrame, classes: int) -> DataFrame:
    """(y, other, cut, rest, ties): margin p_other - p_y of the last row to prune, how many rows of that
    margin are to go, and how many have it.

    Margins have four decimals, so counting them gives at most 20,001 cells per pair and the search for
    the cut never sees rows.
    """
    rows = _with_pairs(scored.select("y", "probs"), needs, classes, "inner")
    long = rows.select("y", "probs", F.explode("_pairs").alias("e")).select(
        "y", "e.other", "e.need", _margin(F.col("e.other")).alias("margin"))
    cells = long.groupBy("y", "other", "need", "margin").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("y", "other").orderBy(F.desc("margin")))
    rest = F.col("need") - (F.col("upto") - F.col("n"))
    reached = cells.withColumn("upto", upto).select("*", rest.alias("rest")).filter("rest > 0")
    return reached.groupBy("y", "other").agg(
        F.min("margin").alias("cut"), F.min_by("rest", "margin").alias("rest"), F.min_by("n", "margin").alias("ties"))


def flag_issues(scored: DataFrame, classes: int, key: str = "row_id") -> DataFrame:
    """Add ``flagged`` to out-of-fold rows (key, y, probs).

    Per pair of classes exactly the wanted number of rows with the largest margins is taken; of rows with
    the margin at the cut, those first in a hash order of the key. Of these, rows whose most probable
    class is not their label are flagged.
    """
    scored = cut_lineage(scored)
    cuts = cut_lineage(margin_cuts(scored, prune_numbers(scored, class_thresholds(scored, classes)), classes))
    tagged = _with_pairs(scored, cuts, classes, "left")
    whole = lambda c: (_margin(c["other"]) > c["cut"]) | ((_margin(c["other"]) == c["cut"]) & (c["rest"] >= c["ties"]))
    beyond = F.coalesce(F.exists("_pairs", whole), F.lit(False))
    n_ties = cuts.filter("rest < ties").agg(F.sum("ties")).first()[0]
    if n_ties:
        cut_through = lambda c: (_margin(c["other"]) == c["cut"]) & (c["rest"] < c["ties"])
        ties = tagged.select(key, "y", F.explode(F.filter("_pairs", cut_through)).alias("e")).select(
            key, "y", "e.other", "e.rest", uniform(F.col(key), "prune").alias("_u"))
        ranked = rank_by_hash(ties, ["y", "other"], "_u", key, "_place", n_ties)
        taken = ranked.filter("_place < rest").select(key).distinct().withColumn("_taken", F.lit(True))
        tagged = tagged.join(taken, key, "left")
        beyond = beyond | F.col("_taken").isNotNull()
    return tagged.select(*scored.columns, (beyond & (arg_max(F.col("probs")) != F.col("y"))).alias("flagged"))


def noise_confidence(rate: Column, has_signal: bool) -> Column:
    if not has_signal:
        return F.lit("low")
    clear = (rate > 2 * NOISE_ALARM) | (rate < NOISE_ALARM / 2)
    return F.when(clear, "high").otherwise("medium")


def label_noise(flagged: DataFrame, has_signal: bool = True) -> DataFrame:
    rate = F.try_divide("n_flagged", "n")
    return flagged.agg(F.count("*").alias("n"), F.count_if("flagged").alias("n_flagged")).select(
        "n", "n_flagged", rate.alias("noise_rate"), noise_confidence(rate, has_signal).alias("confidence"))


def label_suspects(flagged: DataFrame, classes: Sequence[str], worst: int = 30) -> DataFrame:
    """Of the rows least in line with their label, those flagged, with the label they look like."""
    names = F.array(*[F.lit(c) for c in classes])
    given = F.element_at("probs", (F.col("y") + 1).cast("int")).alias("quality")
    low = flagged.select("row_id", "y", "probs", "flagged", given).orderBy("quality", "row_id").limit(worst)
    return low.filter("flagged").select(
        "row_id", F.get(names, F.col("y")).alias("given"), F.get(names, arg_max(F.col("probs"))).alias("suggested"), "quality")


# --- duplicates ---------------------------------------------------------------------------------


def conflict_rate(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Exact duplicates in all features, and the error no model on these features can avoid."""
    cells = df.groupBy(*features, F.col(label).alias("_label")).agg(F.count("*").alias("n"))
    most = F.max(F.when(F.col("_label").isNotNull(), F.col("n")))
    groups = cells.groupBy(*features).agg(F.sum("n").alias("size"), most.alias("most"))
    repeated = F.when(F.col("size") > 1, F.col("size"))
    excess = F.when((F.col("size") > 1) & F.col("most").isNotNull(), F.col("size") - F.col("most"))
    zero = F.lit(0)
    return groups.agg(
        F.sum("size").alias("n"),
        (F.coalesce(F.sum(repeated), zero) / F.sum("size")).alias("duplicate_fraction"),
        (F.coalesce(F.sum(excess), zero) / F.sum("size")).alias("error_lower_bound"))


def conflict_spread(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Mean spread of a numeric target inside duplicate groups, against its overall spread."""
    y = F.col(target).cast("double")
    groups = df.groupBy(*features).agg(F.count("*").alias("size"), F.stddev_pop(y).alias("sd"))
    inside = F.avg(F.when(F.col("size") > 1, F.col("sd"))).alias("within_std")
    share = (F.coalesce(F.sum(F.when(F.col("size") > 1, F.col("size"))), F.lit(0)) / F.sum("size")).alias("duplicate_fraction")
    parts = groups.agg(F.sum("size").alias("n"), share, inside).withColumn("_k", F.lit(0))
    overall = df.agg(F.stddev_pop(y).alias("overall_std")).withColumn("_k", F.lit(0))
    return parts.join(overall, "_k").drop("_k").withColumn("relative", F.try_divide("within_std", "overall_std"))


def duplicate_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """All rows whose features occur more than once; very frequent groups are handled apart."""
    counts = df.groupBy(*features).agg(F.count("*").alias("_rows")).filter("_rows > 1")
    return lookup_join(df, cut_lineage(counts), list(features), "left_semi", row_counts="_rows")


# --- learning curve, feature signal, leakage -----------------------------------------------------


def learning_curve(prep: Prepared, sizes: Sequence[float] = SIZES, seed: int = 0) -> DataFrame:
    """Training and validation score at nested training sizes, all trained from one count."""
    rows = learning_sizes(prep.rows, sizes, seed=seed)
    shape = (1, len(sizes), prep.k, len(prep.classes), prep.binner.n_cells)
    counts = counts_array(cell_counts(rows, ["y"], ["_size", "fold"]), shape, ["_size", "fold"])[0]
    nested = counts.cumsum(axis=0)
    train = nested.sum(axis=1, keepdims=True) - nested  # [size, fold, class, cell]
    weights, priors = log_odds(np.swapaxes(train, 0, 1), prep.binner)
    first = prep.binner.sizes[0]
    n_train = train[..., :first].sum(axis=(-1, -2)).mean(axis=1)
    n, width = len(prep.binner.names), len(prep.classes) - 1
    spark = rows.sparkSession
    every = rows.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(prep.k - 1)).cast("array<bigint>")))
    scored = with_models(every, models_frame(spark, weights, priors), "_at")
    own = F.col("fold") == F.col("_at")
    copies = F.array(*[
        F.when(own | (F.col("_size") <= i), F.struct(
            F.lit(i).alias("size_index"), *_outcome([logit(i * width + c, n) for c in range(width)], F.col("y"))))
        for i in range(len(sizes))
    ])
    long = scored.select("_at", own.alias("held_out"), F.explode(copies).alias("s")).filter("s is not null")
    folds = grouped_score(long.select("_at", "held_out", "s.*"), ["size_index", "_at", "held_out"], prep.binary)
    part = lambda held: F.avg(F.when(F.col("held_out") == held, F.col("value")))
    curve = folds.groupBy("size_index").agg(part(False).alias("score_train"), part(True).alias("score_valid"))
    labels = F.broadcast(spark.createDataFrame(
        [(i, float(s), float(n_train[i])) for i, s in enumerate(sizes)], "size_index int, size double, n_train double"))
    return curve.join(labels, "size_index").select("size", "n_train", "score_train", "score_valid")


def curve_verdict(curve: DataFrame) -> DataFrame:
    """Last step and total gain of the curve; flat when the last step is small against both bars."""
    points = F.sort_array(F.collect_list(F.struct("size", "score_valid"))).alias("c")
    score = lambda i: F.element_at("c", i).getField("score_valid")
    out = curve.agg(points).select((score(-1) - score(-2)).alias("last_gain"), (score(-1) - score(1)).alias("total_gain"))
    flat = F.abs("last_gain") < F.greatest(0.2 * F.abs("total_gain"), F.lit(0.005))
    return out.select("last_gain", "total_gain", flat.alias("plateaued"), (F.col("last_gain") > 0).alias("rising"))


def mutual_information(counts: np.ndarray) -> float:
    """From counts [class, bin]."""
    joint = counts / counts.sum()
    expected = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
    seen = joint > 0
    return float((joint[seen] * np.log(joint[seen] / expected[seen])).sum())


def label_counts(prep: Prepared) -> np.ndarray:
    shape = (1, prep.k, len(prep.classes), prep.binner.n_cells)
    return counts_array(cell_counts(prep.rows, ["y"], ["fold"]), shape, ["fold"])[0]


def feature_signal(prep: Prepared, top: int = 15, counts: np.ndarray | None = None) -> DataFrame:
    """Mutual information of each binned feature with the label, over all rows."""
    counts = (label_counts(prep) if counts is None else counts).sum(axis=0)
    b = prep.binner
    found = [(n, mutual_information(counts[:, s : s + z])) for n, s, z in zip(b.names, b.starts, b.sizes)]
    found.sort(key=lambda t: (-t[1], t[0]))
    table = [(n, mi, i + 1, mi > 0.01) for i, (n, mi) in enumerate(found[:top])]
    return prep.rows.sparkSession.createDataFrame(
        table, "feature string, mutual_info double, rank bigint, informative boolean")


def cell_auc(pos: np.ndarray, neg: np.ndarray, score: np.ndarray) -> float:
    """AUC when all rows of a cell share a score."""
    values, at = np.unique(score, return_inverse=True)
    p, n = np.bincount(at, pos, len(values)), np.bincount(at, neg, len(values))
    below = np.concatenate(([0.0], np.cumsum(n)[:-1]))
    return float((p * (below + n / 2)).sum() / (p.sum() * n.sum()))


def leakage_check(prep: Prepared, alarm: float = 0.95, counts: np.ndarray | None = None) -> DataFrame:
    """Cross-validated AUC of every feature alone (two classes), from the same counts.

    A single binned feature gives all rows of a bin the same score, so held-out counts are enough.
    """
    own = label_counts(prep) if counts is None else counts
    weights, _ = log_odds(own.sum(axis=0, keepdims=True) - own, prep.binner)
    b, table = prep.binner, []
    for name, start, size in zip(b.names, b.starts, b.sizes):
        part = slice(start, start + size)
        aucs = [cell_auc(own[f, 1, part], own[f, 0, part], np.round(weights[f, 0, part], 9)) for f in range(prep.k)]
        table.append((name, float(np.mean(aucs)), bool(np.mean(aucs) > alarm)))
    return prep.rows.sparkSession.createDataFrame(table, "feature string, single_feature_auc double, leakage boolean")


# --- verdict ------------------------------------------------------------------------------------


def verdict(
    signal: DataFrame, noise: DataFrame | None, conflicts: DataFrame, curve: DataFrame, bound: str = "error_lower_bound",
    bound_share: str | None = None,
) -> DataFrame:
    """One row: what limits the result, how sure that is, and which findings count.

    For regression pass ``bound='relative'`` (spread inside duplicates over overall spread).
    """
    key = F.lit(0).alias("_k")
    one = signal.select(key, "has_signal", F.col("confidence").alias("signal_confidence"))
    rate = noise.select(key, "noise_rate") if noise is not None else signal.select(key, F.lit(0.0).alias("noise_rate"))
    one = one.join(rate, "_k").join(conflicts.select(key, F.coalesce(bound, F.lit(0.0)).alias("bound")), "_k")
    one = one.join(curve.select(key, "plateaued"), "_k").drop("_k")
    noisy, flat, conflict = F.col("noise_rate") >= NOISE_ALARM, F.col("plateaued"), F.col("bound") > 0.01
    limited = noisy | (flat & conflict)
    label = (
        F.when(~F.col("has_signal"), "no_signal").when(limited, "data_limited")
        .when(~flat, "more_data_needed").otherwise("model_limited"))
    sure = F.when(~F.col("has_signal"), F.col("signal_confidence") == "high").otherwise(limited & noisy & flat)
    found = F.filter(F.array(
        F.when(~F.col("has_signal"), "no_signal"),
        F.when(F.col("has_signal") & noisy, "label_noise"),
        F.when(F.col("has_signal") & conflict, "conflicting_duplicates"),
        F.when(F.col("has_signal"), F.when(flat, "curve_flat").otherwise("curve_moving"))), lambda x: x.isNotNull())
    advice = F.filter(F.array(
        F.when(~F.col("has_signal"), "change_features_or_verify_labels"),
        F.when(F.col("has_signal") & noisy, "review_suspect_labels"),
        F.when(F.col("has_signal") & conflict, "collect_distinguishing_features"),
        F.when(F.col("has_signal"), F.when(flat, "invest_in_features_or_labels").otherwise("collect_more_data"))),
        lambda x: x.isNotNull())
    return one.select(
        label.alias("verdict"), F.when(sure, "high").otherwise("medium").alias("confidence"),
        F.concat_ws(",", found).alias("findings"), F.concat_ws(",", advice).alias("recommendations"))


def forensics_table(prep: Prepared, dataset: DataFrame, features: Sequence[str], target: str, quick: bool = False) -> DataFrame:
    """The whole battery as (item, key, value) rows of text."""
    return long_items(forensics_parts(prep, dataset, features, target, quick))


def forensics_parts(
    prep: Prepared, dataset: DataFrame, features: Sequence[str], target: str, quick: bool = False
) -> dict[str, DataFrame]:
    """The battery for labels: results of one row by item."""
    counts = label_counts(prep)
    signal = signal_check(prep, 2 if quick else 3)
    signal = prep.rows.sparkSession.createDataFrame([signal.first()], signal.schema)
    has_signal = bool(signal.first()["has_signal"])
    noise = label_noise(flag_issues(out_of_fold(prep), len(prep.classes)), has_signal)
    conflicts = conflict_rate(dataset, features, target)
    curve = curve_verdict(learning_curve(prep, QUICK_SIZES if quick else SIZES))
    top = feature_signal(prep, 1, counts).select("feature", "mutual_info")
    parts = {"signal_check": signal, "label_noise": noise, "conflict_rate": conflicts, "learning_curve": curve,
             "feature_signal": top}
    if prep.binary:
        leak = leakage_check(prep, counts=counts).orderBy(F.desc("single_feature_auc"), "feature").limit(1)
        parts["leakage"] = leak
    parts["verdict"] = verdict(signal, noise, conflicts, curve)
    return parts


def as_item_text(df: DataFrame, column: str) -> Column:
    """Numbers with six decimals, so that text results compare."""
    if dict(df.dtypes)[column] in ("double", "float"):
        value = F.round(F.col(column).cast("double"), 6) + 0.0
        return F.when(value.isNotNull(), F.format_string("%.6f", value))
    return F.col(column).cast("string")


def long_items(parts: dict[str, DataFrame], item_column: str | None = None) -> DataFrame:
    """Results stacked as (item, key, value). A part is one row, or has its items in ``item_column``."""
    out = None
    for item, df in parts.items():
        pairs = F.array(*[
            F.struct(F.lit(c).alias("key"), as_item_text(df, c).alias("value")) for c in df.columns if c != item_column])
        name = F.col(item_column) if item_column else F.lit(item)
        rows = df.select(name.alias("item"), F.explode(pairs).alias("e")).select("item", "e.key", "e.value")
        out = rows if out is None else out.unionByName(rows)
    return out
