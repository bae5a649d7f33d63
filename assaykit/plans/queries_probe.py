"""Featurizing, learners, dataset forensics and feature engineering (groups E12, F17-F20, G, H, I)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import known_metric
from ..operators import align, combos, featurize, forensics, learners, models, regression, reports
from ..operators import diagnose as d
from ..operators.resample import noise_floor
from ..session import cut_lineage
from . import views as v
from .catalog import query
from .queries_diagnose import LABEL_ITEMS, SLICES_SQL, items_sql
from .queries_resample import floor_sql, ring_sql, strat_sql

# --- oracle side of the additive learner ----------------------------------------------------------

PROBES = ", ".join(f"{i}/16.0::DOUBLE" for i in range(1, 16))


def _list(items) -> str:
    return "[" + ", ".join(items) + "]"


def long_sql(view: str, numeric: tuple[str, ...], text: tuple[str, ...] = (), label: str = "y") -> str:
    """CTEs ``folds``, ``edges_`` and ``long_``(row_id, y, fold, f, b, nb): one row per feature."""
    quantiles = ", ".join(
        [f"list_sort(list_distinct(quantile_cont({c}::DOUBLE, [{PROBES}]))) AS e_{c}, quantile_cont({c}::DOUBLE, 0.5) AS m_{c}" for c in numeric]
        + [f"list_sort(list_distinct(list(coalesce({c}::VARCHAR, 'nan')))) AS e_{c}" for c in text])
    parts = [
        f"SELECT row_id, y, fold, '{c}' AS f, len([e FOR e IN e_{c} IF e < coalesce({c}::DOUBLE, m_{c})]) AS b, len(e_{c}) + 1 AS nb FROM folds, edges_"
        for c in numeric
    ] + [
        f"SELECT row_id, y, fold, '{c}' AS f, list_position(e_{c}, coalesce({c}::VARCHAR, 'nan')) - 1 AS b, len(e_{c}) AS nb FROM folds, edges_"
        for c in text
    ]
    source = view if label == "y" else f"(SELECT *, {label} AS y FROM {view})"
    folds = strat_sql(source, "y")
    return f"folds AS MATERIALIZED ({folds}), edges_ AS (SELECT {quantiles} FROM {view}), long_ AS MATERIALIZED ({' UNION ALL '.join(parts)})"


# training rows t(rep, fold, f, b, lab) and row labels tl(rep, fold, lab) -> weights and priors per
# (rep, fold), trained on all rows outside the fold
WEIGHTS = """grid AS (SELECT DISTINCT f, b, nb FROM long_), reps AS (SELECT DISTINCT rep FROM tl), fs AS (SELECT DISTINCT fold FROM folds),
  own AS (SELECT rep, fold, f, b, count(*) FILTER (lab = 1) AS n1, count(*) FILTER (lab = 0) AS n0 FROM t GROUP BY ALL),
  tot AS (SELECT rep, f, b, sum(n1) AS n1, sum(n0) AS n0 FROM own GROUP BY ALL),
  cls AS (SELECT rep, fs.fold, count(*) FILTER (lab = 1 AND tl.fold <> fs.fold) AS c1, count(*) FILTER (lab = 0 AND tl.fold <> fs.fold) AS c0
    FROM tl, fs GROUP BY ALL),
  w AS MATERIALIZED (SELECT reps.rep, fs.fold, grid.f, grid.b,
      ln(coalesce(tot.n1, 0) - coalesce(own.n1, 0) + 1) - ln(c1 + nb) - ln(coalesce(tot.n0, 0) - coalesce(own.n0, 0) + 1) + ln(c0 + nb) AS wt,
      ln(c1 + 1) - ln(c0 + 1) AS prior
    FROM reps CROSS JOIN fs CROSS JOIN grid JOIN cls ON cls.rep = reps.rep AND cls.fold = fs.fold
    LEFT JOIN tot ON tot.rep = reps.rep AND tot.f = grid.f AND tot.b = grid.b
    LEFT JOIN own ON own.rep = reps.rep AND own.fold = fs.fold AND own.f = grid.f AND own.b = grid.b)"""

PLAIN = """t AS (SELECT 0 AS rep, fold, f, b, y AS lab FROM long_), tl AS (SELECT 0 AS rep, fold, y AS lab FROM folds)"""
PROBA = "round(1 / (1 + exp(-(any_value(prior) + sum(wt)))), 4)"
OOF = f"""oof AS MATERIALIZED (SELECT row_id, any_value(y) AS y, fold, {PROBA} AS p FROM long_ JOIN w USING (fold, f, b) GROUP BY row_id, fold)"""


def auc_sql(source: str, by: str, score: str = "p", label: str = "y") -> str:
    return f"""SELECT {by}, sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)) AS value FROM (
      SELECT {by}, pos, neg, coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY {score} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT {by}, {score}, sum({label}) AS pos, sum(1 - {label}) AS neg FROM {source} GROUP BY {by}, {score})) GROUP BY {by}"""


NOISY = long_sql("noisy", ("x1", "x2"))
FEAT = long_sql("feat", ("total_price", "nation", "month"), ("priority", "segment"), "target")
RATIO = long_sql("ratio", tuple(f"x{i}" for i in range(1, 7)))


def _noisy(spark, sf, **more):
    return learners.prepare(v.noisy(spark, sf), "y", ["x1", "x2"], **more)


def _feat(spark, sf):
    return learners.prepare(v.feat(spark, sf), "target", list(v.FEATURES))


# --- H ------------------------------------------------------------------------------------------


@query("impute_median", ("feat",),
       "SELECT row_id, coalesce(total_price, (SELECT quantile_cont(total_price, 0.5) FROM feat)) AS total_price FROM feat",
       ("total_price",))
def impute_median(spark, sf):
    return featurize.impute_median(v.feat(spark, sf).select("row_id", "total_price"), ["total_price"])[0]


@query("one_hot", ("feat", "quality"),
       """SELECT 'segment_' || coalesce(segment, 'nan') AS feature, count(*) AS n FROM feat GROUP BY 1
          UNION ALL SELECT 'priority_' || priority, count(*) FROM feat GROUP BY 1
          UNION ALL SELECT 'dropped:source', 1 FROM quality HAVING count(DISTINCT source) > 15""")
def one_hot(spark, sf):
    wide, _ = featurize.one_hot(v.feat(spark, sf).select("row_id", "segment", "priority"), ["segment", "priority"])
    names = [c for c in wide.columns if c != "row_id"]
    sums = wide.agg(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.sum(F.col(f"`{c}`")).cast("bigint").alias("n")) for c in names]).alias("s"))
    _, dropped = featurize.one_hot(v.quality(spark, sf).select("row_id", "source"), ["source"])
    gone = spark.createDataFrame([(f"dropped:{c}", 1) for c in dropped], "feature string, n bigint")
    return sums.select(F.inline("s")).unionByName(gone)


@query("encode_target", ("feat", "quality"),
       """SELECT 'classification' AS task, row_id, (dense_rank() OVER (ORDER BY segment) - 1)::DOUBLE AS y FROM feat WHERE segment IS NOT NULL
          UNION ALL SELECT 'regression', row_id, n_chars::DOUBLE FROM quality WHERE row_id % 7 <> 0""", ("y",))
def encode_target(spark, sf):
    classes, _ = featurize.encode_target(v.feat(spark, sf), "segment", "classification")
    q = v.quality(spark, sf).withColumn(
        "target", F.when(F.col("row_id") % 7 == 0, "bad").otherwise(F.col("n_chars").cast("string")))
    numbers, _ = featurize.encode_target(q, "target", "regression")
    pick = lambda df, task: df.select(F.lit(task).alias("task"), "row_id", F.col("y").cast("double").alias("y"))
    return pick(classes, "classification").unionByName(pick(numbers, "regression"))


@query("out_of_fold", ("noisy",), f"WITH {NOISY}, {PLAIN}, {WEIGHTS}, {OOF} SELECT row_id, y, fold, p FROM oof", ("p",))
def out_of_fold(spark, sf):
    return learners.out_of_fold(_noisy(spark, sf)).select("row_id", "y", "fold", "p")


@query("probe_learner_binned", ("feat",),
       f"WITH {FEAT}, {PLAIN}, {WEIGHTS}, {OOF}, folded AS ({auc_sql('oof', 'fold')}) SELECT fold, value FROM folded", ("value",))
def probe_learner_binned(spark, sf):
    return learners.grouped_score(learners.out_of_fold(_feat(spark, sf)), ["fold"], True)


# --- G ------------------------------------------------------------------------------------------

LABELS = {f"y{i}": f"labels{i}" for i in (1, 2, 3)}


def signal_sql(view: str) -> str:
    labs = " UNION ALL ".join(f"SELECT {i} AS rep, row_id, fold, y{'' if i == 0 else i} AS lab FROM shuffled" for i in range(4))
    return f"""{long_sql(view, ("x1", "x2"))}, shuffled AS ({ring_sql('(SELECT row_id, y, fold FROM folds)', 'y', LABELS)}),
      labs AS MATERIALIZED ({labs}), t AS (SELECT rep, l.fold, f, b, lab FROM labs l JOIN long_ USING (row_id)), tl AS (SELECT rep, fold, lab FROM labs),
      {WEIGHTS}, scored AS (SELECT l.rep AS rep, l.fold AS fold, any_value(lab) AS y, {PROBA} AS p FROM labs l JOIN long_ g USING (row_id)
        JOIN w ON w.rep = l.rep AND w.fold = l.fold AND w.f = g.f AND w.b = g.b GROUP BY l.rep, l.fold, row_id),
      folded AS ({auc_sql('scored', 'rep, fold')}), means AS (SELECT rep, avg(value) AS s FROM folded GROUP BY rep),
      one AS (SELECT max(s) FILTER (rep = 0) AS score_real, avg(s) FILTER (rep > 0) AS score_shuffled_mean,
        CASE WHEN stddev_pop(s) FILTER (rep > 0) > 0 THEN stddev_pop(s) FILTER (rep > 0) ELSE 1e-6 END AS score_shuffled_std FROM means),
      two AS (SELECT *, score_real - score_shuffled_mean AS gap FROM one)
      SELECT *, gap > greatest(3 * score_shuffled_std, 0.02) AS has_signal,
        CASE WHEN (CASE WHEN gap > greatest(3 * score_shuffled_std, 0.02) THEN gap > 0.1 ELSE gap < score_shuffled_std END) THEN 'high' ELSE 'medium' END AS confidence
      FROM two"""


_SIGNAL = ("score_real", "score_shuffled_mean", "score_shuffled_std", "gap")


@query("signal_check", ("noisy",), "WITH " + signal_sql("noisy"), _SIGNAL)
def signal_check(spark, sf):
    return forensics.signal_check(_noisy(spark, sf))


@query("signal_check_none", ("nosignal",), "WITH " + signal_sql("nosignal"), _SIGNAL)
def signal_check_none(spark, sf):
    return forensics.signal_check(learners.prepare(v.nosignal(spark, sf), "y", ["x1", "x2"]))


FLAGS = f"""{NOISY}, {PLAIN}, {WEIGHTS}, {OOF},
  pr AS (SELECT row_id, y, p AS p1, round(1 - p, 4) AS p0 FROM oof),
  th AS (SELECT avg(p0) FILTER (y = 0) AS t0, avg(p1) FILTER (y = 1) AS t1 FROM pr),
  lk AS (SELECT y, CASE WHEN p0 >= t0 AND p1 >= t1 THEN (p1 > p0)::INT WHEN p0 >= t0 THEN 0 WHEN p1 >= t1 THEN 1 END AS likely FROM pr, th),
  need AS (SELECT y, floor(count(*) FILTER (likely = 1 - y) * count(*)::DOUBLE / count(likely) + 0.5) AS m FROM lk GROUP BY y),
  placed AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY round(CASE WHEN y = 1 THEN p0 - p1 ELSE p1 - p0 END, 4) DESC,
      {v.u_sql('row_id', 'prune')}, row_id) AS place FROM pr),
  fl AS (SELECT row_id, y, p0, p1, CASE WHEN y = 1 THEN p1 ELSE p0 END AS quality,
      coalesce(place <= m, false) AND (p1 > p0)::INT <> y AS flagged FROM placed LEFT JOIN need USING (y))"""


NOISE = f"""WITH {FLAGS}, r AS (SELECT count(*) AS n, count(*) FILTER (flagged) AS n_flagged FROM fl)
  SELECT n, n_flagged, n_flagged / n AS noise_rate,
    CASE WHEN n_flagged / n > 0.16 OR n_flagged / n < 0.04 THEN 'high' ELSE 'medium' END AS confidence FROM r"""


@query("label_noise", ("noisy",), NOISE, ("noise_rate",))
def label_noise(spark, sf):
    return forensics.label_noise(forensics.flag_issues(learners.out_of_fold(_noisy(spark, sf)), 2))


@query("label_suspects", ("noisy",),
       f"""WITH {FLAGS} SELECT row_id, y::VARCHAR AS given, (p1 > p0)::INT::VARCHAR AS suggested, quality
          FROM (SELECT * FROM fl ORDER BY quality, row_id LIMIT 30) WHERE flagged""", ("quality",))
def label_suspects(spark, sf):
    prep = _noisy(spark, sf)
    return forensics.label_suspects(forensics.flag_issues(learners.out_of_fold(prep), 2), prep.classes)


GROUPS = "quantity, discount, tax, returnflag"
CONFLICT = f"""SELECT sum(size)::BIGINT AS n, coalesce(sum(size) FILTER (size > 1), 0) / sum(size) AS duplicate_fraction,
    coalesce(sum(size - most) FILTER (size > 1), 0) / sum(size) AS error_lower_bound
  FROM (SELECT sum(c) AS size, max(c) FILTER (label IS NOT NULL) AS most FROM (
    SELECT {GROUPS}, label, count(*) AS c FROM dups GROUP BY ALL) GROUP BY {GROUPS})"""


@query("conflict_rate_cls", ("dups",), CONFLICT, ("duplicate_fraction", "error_lower_bound"))
def conflict_rate_cls(spark, sf):
    return forensics.conflict_rate(v.dups(spark, sf), v.DUP_FEATURES, "label")


@query("conflict_rate_reg", ("dups",),
       f"""SELECT *, within_std / overall_std AS relative FROM (
            SELECT sum(size)::BIGINT AS n, coalesce(sum(size) FILTER (size > 1), 0) / sum(size) AS duplicate_fraction,
              avg(sd) FILTER (size > 1) AS within_std, (SELECT stddev_pop(price) FROM dups) AS overall_std
            FROM (SELECT count(*) AS size, stddev_pop(price) AS sd FROM dups GROUP BY {GROUPS}))""",
       ("duplicate_fraction", "within_std", "overall_std", "relative"))
def conflict_rate_reg(spark, sf):
    return forensics.conflict_spread(v.dups(spark, sf), v.DUP_FEATURES, "price")


@query("duplicate_rows", ("dups",),
       f"SELECT * FROM dups WHERE ({GROUPS}) IN (SELECT ({GROUPS}) FROM dups GROUP BY {GROUPS} HAVING count(*) > 1)",
       ("quantity", "discount", "tax", "price"))
def duplicate_rows(spark, sf):
    return forensics.duplicate_rows(v.dups(spark, sf), v.DUP_FEATURES)


CURVE = f"""{NOISY},
  sz AS (SELECT row_id, fold, y, (SELECT count(*) FROM (SELECT unnest([{', '.join(str(s) for s in forensics.SIZES[:-1])}]) AS s) WHERE u >= s) AS size_index
    FROM (SELECT row_id, fold, y, {v.u_sql('row_id', 'size0')} AS u FROM folds)),
  ss AS (SELECT unnest(range(0, {len(forensics.SIZES)})) AS rep),
  t AS (SELECT rep, l.fold, f, b, l.y AS lab FROM long_ l JOIN sz USING (row_id) JOIN ss ON size_index <= rep),
  tl AS MATERIALIZED (SELECT rep, fold, y AS lab FROM sz JOIN ss ON size_index <= rep), {WEIGHTS},
  scored AS (SELECT rep, w.fold AS mf, w.fold = l.fold AS held, row_id, any_value(l.y) AS y, {PROBA} AS p
    FROM long_ l JOIN sz USING (row_id) JOIN w ON w.f = l.f AND w.b = l.b AND (w.fold = l.fold OR size_index <= w.rep)
    GROUP BY rep, w.fold, l.fold, row_id),
  folded AS ({auc_sql('scored', 'rep, mf, held')}),
  ntr AS (SELECT rep, avg(n) AS n_train FROM (SELECT rep, fs.fold, count(*) FILTER (tl.fold <> fs.fold) AS n FROM tl, fs GROUP BY ALL) GROUP BY rep),
  curve AS (SELECT {_list([str(s) + '::DOUBLE' for s in forensics.SIZES])}[rep + 1] AS size, n_train,
      avg(value) FILTER (NOT held) AS score_train, avg(value) FILTER (held) AS score_valid
    FROM folded JOIN ntr USING (rep) GROUP BY rep, n_train)"""


@query("learning_curve", ("noisy",), f"WITH {CURVE} SELECT * FROM curve", ("size", "n_train", "score_train", "score_valid"))
def learning_curve(spark, sf):
    return forensics.learning_curve(_noisy(spark, sf))


TREND = f"""WITH {CURVE}, g AS (SELECT arg_max(score_valid, size) - arg_max(score_valid, size) FILTER (size < 1) AS last_gain,
    arg_max(score_valid, size) - arg_min(score_valid, size) AS total_gain FROM curve)
  SELECT last_gain, total_gain, abs(last_gain) < greatest(0.2 * abs(total_gain), 0.005) AS plateaued, last_gain > 0 AS rising FROM g"""


@query("curve_verdict", ("noisy",), TREND, ("last_gain", "total_gain"))
def curve_verdict(spark, sf):
    return forensics.curve_verdict(forensics.learning_curve(_noisy(spark, sf)))


MI = """mi AS (SELECT f AS feature, sum(n / nn * ln(n * nn / (nb_ * ny))) AS mutual_info FROM (
    SELECT f, n::DOUBLE AS n, sum(n) OVER (PARTITION BY f)::DOUBLE AS nn, sum(n) OVER (PARTITION BY f, b)::DOUBLE AS nb_, sum(n) OVER (PARTITION BY f, y)::DOUBLE AS ny
    FROM (SELECT f, b, y, count(*) AS n FROM long_ GROUP BY ALL)) GROUP BY f)"""


@query("feature_signal", ("feat",),
       f"""WITH {FEAT}, {MI} SELECT feature, mutual_info, row_number() OVER (ORDER BY mutual_info DESC, feature) AS rank, mutual_info > 0.01 AS informative
          FROM mi ORDER BY rank LIMIT 15""", ("mutual_info",))
def feature_signal(spark, sf):
    return forensics.feature_signal(_feat(spark, sf))


def leakage_sql(cte: str) -> str:
    return f"""WITH {cte}, {PLAIN}, {WEIGHTS},
      single AS (SELECT l.f, l.fold, y, round(wt, 9) AS p FROM long_ l JOIN w ON w.fold = l.fold AND w.f = l.f AND w.b = l.b),
      folded AS ({auc_sql('single', 'f, fold')})
      SELECT f AS feature, avg(value) AS single_feature_auc, avg(value) > 0.95 AS leakage FROM folded GROUP BY f"""


@query("leakage_check", ("noisy",), leakage_sql(long_sql("(SELECT *, y + 0.1 * x1 AS leak FROM noisy)", ("x1", "x2", "leak"))),
       ("single_feature_auc",))
def leakage_check(spark, sf):
    leaky = v.noisy(spark, sf).withColumn("leak", F.col("y") + 0.1 * F.col("x1"))
    return forensics.leakage_check(learners.prepare(leaky, "y", ["x1", "x2", "leak"]))


NO_CONFLICT = """SELECT sum(c)::BIGINT AS n, coalesce(sum(c) FILTER (c > 1), 0) / sum(c) AS duplicate_fraction,
    coalesce(sum(c - m) FILTER (c > 1), 0) / sum(c) AS error_lower_bound
  FROM (SELECT sum(n) AS c, max(n) AS m FROM (SELECT x1, x2, y, count(*) AS n FROM noisy GROUP BY ALL) GROUP BY x1, x2)"""


VERDICT = f"""WITH a AS (SELECT s.has_signal AS sig, s.confidence AS sc, n.noise_rate >= 0.08 AS nz, t.plateaued AS flat, c.error_lower_bound > 0.01 AS cf
    FROM (WITH {signal_sql("noisy")}) s, ({NOISE}) n, ({NO_CONFLICT}) c, ({TREND}) t)
  SELECT CASE WHEN NOT sig THEN 'no_signal' WHEN nz OR (flat AND cf) THEN 'data_limited' WHEN NOT flat THEN 'more_data_needed' ELSE 'model_limited' END AS verdict,
    CASE WHEN (NOT sig AND sc = 'high') OR (sig AND nz AND flat) THEN 'high' ELSE 'medium' END AS confidence,
    concat_ws(',', CASE WHEN NOT sig THEN 'no_signal' END, CASE WHEN sig AND nz THEN 'label_noise' END,
      CASE WHEN sig AND cf THEN 'conflicting_duplicates' END, CASE WHEN sig AND flat THEN 'curve_flat' WHEN sig THEN 'curve_moving' END) AS findings,
    concat_ws(',', CASE WHEN NOT sig THEN 'change_features_or_verify_labels' END, CASE WHEN sig AND nz THEN 'review_suspect_labels' END,
      CASE WHEN sig AND cf THEN 'collect_distinguishing_features' END,
      CASE WHEN sig AND flat THEN 'invest_in_features_or_labels' WHEN sig THEN 'collect_more_data' END) AS recommendations
  FROM a"""


@query("verdict", ("noisy",), VERDICT)
def verdict(spark, sf):
    prep = _noisy(spark, sf)
    flagged = forensics.flag_issues(learners.out_of_fold(prep), 2)
    return forensics.verdict(
        forensics.signal_check(prep), forensics.label_noise(flagged),
        forensics.conflict_rate(v.noisy(spark, sf), ["x1", "x2"], "y"),
        forensics.curve_verdict(forensics.learning_curve(prep)))


_TOP_SIGNAL = f"WITH {NOISY}, {MI} SELECT feature, mutual_info FROM mi ORDER BY mutual_info DESC, feature LIMIT 1"


@query("forensics_summary", ("noisy",), " UNION ALL ".join(f"({x})" for x in (
    items_sql("'signal_check'", "WITH " + signal_sql("noisy"), _SIGNAL, ("has_signal", "confidence")),
    items_sql("'label_noise'", NOISE, ("noise_rate",), ("n", "n_flagged", "confidence")),
    items_sql("'conflict_rate'", NO_CONFLICT, ("duplicate_fraction", "error_lower_bound"), ("n",)),
    items_sql("'learning_curve'", TREND, ("last_gain", "total_gain"), ("plateaued", "rising")),
    items_sql("'feature_signal'", _TOP_SIGNAL, ("mutual_info",), ("feature",)),
    items_sql("'leakage'", f"SELECT * FROM ({leakage_sql(NOISY)}) ORDER BY single_feature_auc DESC, feature LIMIT 1",
              ("single_feature_auc",), ("feature", "leakage")),
    items_sql("'verdict'", VERDICT, (), ("verdict", "confidence", "findings", "recommendations")))))
def forensics_summary(spark, sf):
    return forensics.forensics_table(_noisy(spark, sf), v.noisy(spark, sf), ["x1", "x2"], "y")


# --- F17, F18, F20 ------------------------------------------------------------------------------


@query("missed_split", ("preds_cls", "feat"),
       f"""WITH {FEAT}, {PLAIN}, {WEIGHTS}, {OOF}
          SELECT count(*) AS n_missed, round(avg((p < 0.5)::INT), 3) AS fraction_feature_limited,
            round(1 - avg((p < 0.5)::INT), 3) AS fraction_learnable, round(avg(p), 3) AS mean_oof_proba
          FROM oof WHERE row_id IN (SELECT row_id FROM preds_cls WHERE y_true = 1 AND y_pred <> 1)""",
       ("fraction_feature_limited", "fraction_learnable", "mean_oof_proba"))
def missed_split(spark, sf):
    missed = align.missed_rows(v.feat(spark, sf), v.preds_cls(spark, sf), 1)
    return d.missed_split(missed, learners.out_of_fold(_feat(spark, sf)))


# training on all rows: one pseudo fold that no row belongs to
ALL_ROWS = WEIGHTS.replace("fs AS (SELECT DISTINCT fold FROM folds)", "fs AS (SELECT -1 AS fold)")


@query("missed_attribution", ("preds_cls", "feat"),
       f"""WITH {FEAT}, {PLAIN}, {ALL_ROWS}, centre AS (SELECT f, avg(wt) AS c FROM long_ JOIN w USING (f, b) GROUP BY f)
          SELECT f AS feature, avg(wt - c) AS contribution FROM long_ JOIN w USING (f, b) JOIN centre USING (f)
          WHERE row_id IN (SELECT row_id FROM preds_cls WHERE y_true = 1 AND y_pred <> 1)
          GROUP BY f ORDER BY contribution, feature LIMIT 5""", ("contribution",))
def missed_attribution(spark, sf):
    missed = align.missed_rows(v.feat(spark, sf), v.preds_cls(spark, sf), 1)
    return learners.contributions(_feat(spark, sf), missed)


_WORST = f"SELECT feature, bucket, n, error, lift FROM ({SLICES_SQL}) ORDER BY lift DESC, n DESC, feature, bucket LIMIT 1"


@query("diagnose_summary", ("preds_slice", "feat", "meanings"), " UNION ALL ".join(f"({x})" for x in (
    items_sql("'overall'", "SELECT count(*) AS n, avg((y_true <> y_pred)::INT) AS error FROM preds_slice JOIN feat USING (row_id)", ("error",), ("n",)),
    items_sql("'worst_slice'", _WORST, ("error", "lift"), ("feature", "bucket", "n")),
    items_sql("'noise_floor'", floor_sql("accuracy", 200).replace("FROM preds_cls", "FROM preds_slice"),
              ("mean", "std", "ci_low", "ci_high", "min_significant_delta"), ("metric", "n_boot")),
    *[x for x in LABEL_ITEMS if "'scores'" not in x])))
def diagnose_summary(spark, sf):
    preds = v.preds_slice(spark, sf)
    rows = d.row_error(align.join_features(preds, v.feat(spark, sf), "target"))
    curve = d.roc_curve(preds, "proba_1", 1)
    points = d.operating_points(curve).groupBy().pivot(
        "point", [f"recall_at_{round(x * 100)}pct_overkill" for x in d.OVERKILL_LEVELS]
        + [f"overkill_for_{round(x * 100)}pct_recall" for x in d.RECALL_LEVELS]).agg(F.max("value"))
    parts = {
        "overall": rows.agg(F.count("*").alias("n"), F.avg("error").alias("error")),
        "worst_slice": d.error_slices(rows, v.FEATURES, top=1),
        "noise_floor": noise_floor(preds, known_metric("accuracy")),
        "confusion": d.confused_pairs(preds, 1), "calibration": d.calibration_error(d.calibration_bins(preds, "proba_1", 1)),
        "operating_curve": points, "class_balance": d.class_balance(preds), "missed_positives": d.missed_positives(preds, 1),
    }
    return forensics.long_items(parts)


# --- I ------------------------------------------------------------------------------------------

XS = tuple(f"x{i}" for i in range(1, 7))


@query("usable_numeric", ("feat",),
       " UNION ALL ".join(f"SELECT '{c}' AS feature FROM feat HAVING count(DISTINCT {c}) > 2" for c in ("total_price", "nation", "month", "target")))
def usable_numeric(spark, sf):
    feat = v.feat(spark, sf)
    found = combos.usable_numeric(feat, ["total_price", "priority", "nation", "month", "target"])
    return spark.createDataFrame([(c,) for c in found], "feature string")


def _combo_sql(kind: str, a: str, b: str) -> str:
    if kind != "ratio":
        return f"{a} {'-' if kind == 'diff' else '*'} {b}"
    return f"CASE WHEN abs({b}) > 1e-12 THEN {a} / {b} ELSE (SELECT quantile_cont({a} / {b}, 0.5) FROM ratio WHERE abs({b}) > 1e-12) END"


COMBO_SQL = {
    f"{kind}({a},{b})": _combo_sql(kind, a, b)
    for i, a in enumerate(XS) for b in XS[i + 1 :] for kind in ("diff", "product", "ratio")
}


@query("arith_combos", ("ratio",), "SELECT row_id, " + ", ".join(f'{s} AS "{n}"' for n, s in COMBO_SQL.items()) + " FROM ratio",
       tuple(f'"{n}"' for n in COMBO_SQL))
def arith_combos(spark, sf):
    wide, made = combos.arithmetic_combos(v.ratio(spark, sf), XS)
    return wide.select("row_id", *[f"`{c.name}`" for c in made])


PERMS = {f"r{i}": f"perm{i}" for i in range(3)}


def _hit(p: str) -> str:
    return f"((round(1 / (1 + exp(-({p}))), 4) > round(1 - round(1 / (1 + exp(-({p}))), 4), 4))::BIGINT = y)::INT"


@query("permutation_importance", ("ratio",),
       f"""WITH {RATIO}, {PLAIN}, {ALL_ROWS},
          nxt AS (SELECT row_id, unnest([r0, r1, r2]) AS mate FROM ({ring_sql('(SELECT row_id FROM folds)', 'row_id', PERMS)})),
          cell AS MATERIALIZED (SELECT row_id, y, l.f, wt, prior FROM long_ l JOIN w USING (f, b)),
          base AS (SELECT row_id, any_value(y) AS y, any_value(prior) + sum(wt) AS s FROM cell GROUP BY row_id),
          swap AS (SELECT c.f, {_hit('bs.s - c.wt + m.wt').replace('= y', '= bs.y')} AS hit
            FROM cell c JOIN base bs USING (row_id) JOIN nxt USING (row_id) JOIN cell m ON m.row_id = mate AND m.f = c.f)
          SELECT f AS feature, (SELECT avg({_hit('s')}) FROM base) - avg(hit) AS importance FROM swap GROUP BY f""", ("importance",))
def permutation_importance(spark, sf):
    return learners.importance(learners.prepare(v.ratio(spark, sf), "y", list(XS)))


@query("importance_fallback", ("nosignal",),
       f"""WITH {long_sql('nosignal', ('x1', 'x2'))}, {MI} SELECT feature, mutual_info, row_number() OVER (ORDER BY mutual_info DESC, feature) AS rank FROM mi""",
       ("mutual_info",))
def importance_fallback(spark, sf):
    prep = learners.prepare(v.nosignal(spark, sf), "y", ["x1", "x2"])
    info = combos.information(prep)
    ranked = sorted(info, key=lambda c: (-info[c], c))
    return spark.createDataFrame([(c, info[c], i + 1) for i, c in enumerate(ranked)], "feature string, mutual_info double, rank bigint")


_WIDE = "(SELECT *, " + ", ".join(f"{s} AS c{i}" for i, s in enumerate(COMBO_SQL.values())) + " FROM ratio)"
_CS = tuple(f"c{i}" for i in range(len(COMBO_SQL)))
_NAMES = _list([f"'{n}'" for n in COMBO_SQL])
_NAME = f"{_NAMES}[substr(feature, 2)::INT + 1]"
_BEST = f"""best AS MATERIALIZED (SELECT feature AS f, {_NAME} AS candidate, mutual_info FROM mi WHERE feature LIKE 'c%'
    ORDER BY round(mutual_info, 9) DESC, candidate LIMIT {combos.TOP_COMBOS})"""
_AUG = long_sql(_WIDE, (*XS, *_CS))
# priced are all combinations together and the most informative ones by themselves
GAINS = f"""{_AUG}, {MI}, {_BEST}, {PLAIN}, {WEIGHTS},
  cell AS MATERIALIZED (SELECT row_id, l.fold, y, l.f, wt, prior FROM long_ l JOIN w ON w.fold = l.fold AND w.f = l.f AND w.b = l.b),
  sets AS (SELECT candidate, f FROM best UNION ALL SELECT 'combined', unnest({_list([f"'{c}'" for c in _CS])})),
  plain_ AS (SELECT row_id, fold, any_value(y) AS y, any_value(prior) + sum(wt) AS s FROM cell WHERE f LIKE 'x%' GROUP BY row_id, fold),
  more AS (SELECT candidate, row_id, sum(wt) AS e FROM sets JOIN cell USING (f) GROUP BY candidate, row_id
    UNION ALL SELECT '', row_id, 0 FROM plain_),
  scored AS (SELECT candidate, fold, y, round(1 / (1 + exp(-(s + e))), 4) AS p FROM plain_ JOIN more USING (row_id)),
  folded AS ({auc_sql('scored', 'candidate, fold')}),
  diffs AS (SELECT c.candidate, c.value - b.value AS diff FROM folded c JOIN folded b ON b.fold = c.fold AND b.candidate = '' WHERE c.candidate <> ''),
  gains AS (SELECT candidate, avg(diff) AS gain, stddev_samp(diff) / sqrt(count(*)) AS sem,
    avg(diff) > greatest(3 * stddev_samp(diff) / sqrt(count(*)), 0.005) AS significant FROM diffs GROUP BY candidate)"""


def _gains(spark, sf) -> tuple[DataFrame, int]:
    wide, made = combos.arithmetic_combos(v.ratio(spark, sf), XS)
    names = [c.name for c in made]
    prep = learners.prepare(wide, "y", [*XS, *names])
    best = combos.best_combos(combos.information(prep), names)
    gains = combos.fold_gains(prep, XS, {"combined": names, **{n: [n] for n in best}})
    return combos.paired_gain(gains), len(names)


@query("paired_gain", ("ratio",), f"WITH {GAINS} SELECT * FROM gains", ("gain", "sem"))
def paired_gain(spark, sf):
    return _gains(spark, sf)[0]


@query("combo_candidates", ("ratio",), f"WITH {long_sql(_WIDE, _CS)}, {MI}, {_BEST} SELECT candidate, mutual_info FROM best", ("mutual_info",))
def combo_candidates(spark, sf):
    wide, made = combos.arithmetic_combos(v.ratio(spark, sf), XS)
    names = [c.name for c in made]
    info = combos.information(learners.prepare(wide, "y", names))
    return spark.createDataFrame([(n, info[n]) for n in combos.best_combos(info, names)], "candidate string, mutual_info double")


@query("fe_verdict", ("ratio",),
       f"""WITH {GAINS}, top AS (SELECT arg_max(candidate, row(significant, gain, candidate)) AS c, arg_max(gain, row(significant, gain, candidate)) AS g,
            bool_or(significant) AS s FROM gains)
          SELECT CASE WHEN s THEN 'fe_worth_testing' ELSE 'fe_unlikely_to_help' END AS verdict, c AS best_candidate, g AS best_gain, {len(COMBO_SQL)}::BIGINT AS n_swept FROM top""",
       ("best_gain",))
def fe_verdict(spark, sf):
    return combos.fe_verdict(*_gains(spark, sf))



# --- model-based items ----------------------------------------------------------------------------


def _vectors(spark, sf):
    from ..operators.resample import stratified_kfold

    rows = v.vectors(spark, sf).select(
        "row_id", F.col("y").cast("bigint").alias("y"), F.col("embedding").cast("array<double>").alias("x"))
    return stratified_kfold(rows, "y", 5)


@query("knn_predict", ("vectors",),
       f"""WITH folds AS MATERIALIZED ({strat_sql('(SELECT row_id, y, embedding::DOUBLE[] AS x FROM vectors)', 'y')}),
          near AS (SELECT a.row_id, a.y, b.y AS label, row_number() OVER (PARTITION BY a.row_id ORDER BY
              list_sum([(a.x[i] - b.x[i]) ** 2 FOR i IN range(1, 65)]), b.row_id) AS r
            FROM folds a JOIN folds b ON a.fold <> b.fold),
          n AS (SELECT greatest(3, least(25, count(*) // 20)) AS k FROM vectors),
          votes AS (SELECT row_id, label, count(*) AS c FROM near, n WHERE r <= k GROUP BY ALL)
          SELECT row_id, max(c) / (SELECT k FROM n) AS share FROM votes GROUP BY row_id""", ("share",))
def knn_predict(spark, sf):
    rows = cut_lineage(_vectors(spark, sf))
    k = models.neighbours_wanted(rows.count())
    classes = rows.agg(F.max("y")).first()[0] + 1
    return models.knn_out_of_fold(rows, k, classes).select("row_id", F.array_max("probs").alias("share"))


#: Folds and boosting rounds of trained models.
FOLDS, ROUNDS = 5, 200


def _folded(spark, sf, k=FOLDS):
    return models.folded_vectors(v.noisy(spark, sf), "y", ["x1", "x2"], k=k)


@query("isolation_score")
def isolation_score(spark, sf):
    return models.isolation_score(_folded(spark, sf)[0])


@query("probe_learner_trees")
def probe_learner_trees(spark, sf):
    rows, classes = _folded(spark, sf)
    return models.fold_scores(models.ml_out_of_fold(rows, models.tree_learner(len(classes), ROUNDS), FOLDS, len(classes)), len(classes))


@query("reference_band")
def reference_band(spark, sf):
    rows, classes = _folded(spark, sf)
    return models.reference_band(rows, classes, FOLDS, rounds=ROUNDS)


@query("reference_facts", ("noisy",),
       f"""WITH folds AS ({strat_sql('noisy', 'y')}),
          per AS (SELECT fold, count(*) AS n_rows, count(*) FILTER (y = 1) AS n_last FROM folds GROUP BY fold),
          truth AS (SELECT corr(y0, y) > 0.2 AS better, greatest(3, least(15, count(*) // 20)) AS near FROM noisy)
          SELECT unnest(['linear', 'knn_' || near, 'trees']) AS model, fold, n_rows, n_last, true AS sound, better FROM per, truth""")
def reference_facts(spark, sf):
    rows, classes = _folded(spark, sf)
    return models.reference_facts(rows, classes, FOLDS, rounds=ROUNDS)


@query("stacked_features")
def stacked_features(spark, sf):
    rows, classes = _folded(spark, sf)
    stacked = models.stacked_features(rows, len(classes))
    data = v.noisy(spark, sf).join(stacked, "row_id")
    names = ["isolation_forest_score", "knn_oof_prediction"]
    prep = learners.prepare(data, "y", ["x1", "x2", *names])
    return combos.paired_gain(combos.fold_gains(prep, ["x1", "x2"], {n: [n] for n in names}))


@query("fe_probe")
def fe_probe(spark, sf):
    return combos.fe_probe(v.ratio(spark, sf), "y", list(XS))


# --- numeric targets ------------------------------------------------------------------------------

_KFOLDS = f"(SELECT *, floor({v.u_sql('row_id', 'fold0')} * 5)::BIGINT AS fold FROM number_target)"
REG_LONG = f"""folds AS MATERIALIZED {_KFOLDS},
  edges_ AS (SELECT {", ".join(f"list_sort(list_distinct(quantile_cont({c}, [{PROBES}]))) AS e_{c}" for c in ("x1", "x2"))} FROM number_target),
  long_ AS MATERIALIZED ({" UNION ALL ".join(
      f"SELECT row_id, fold, '{c}' AS f, len([e FOR e IN e_{c} IF e < {c}]) AS b FROM folds, edges_" for c in ("x1", "x2"))}),
  shuffled AS ({ring_sql('(SELECT row_id, y, fold FROM folds)', 'y', LABELS)}),
  labs AS MATERIALIZED ({" UNION ALL ".join(f"SELECT {i} AS rep, row_id, fold, y{'' if i == 0 else i} AS lab FROM shuffled" for i in range(4))}),
  fs AS (SELECT DISTINCT fold FROM folds),
  own AS (SELECT rep, l.fold, f, b, count(*) AS n, sum(lab) AS s FROM labs l JOIN long_ USING (row_id) GROUP BY ALL),
  tot AS (SELECT rep, f, b, sum(n) AS n, sum(s) AS s FROM own GROUP BY ALL),
  mean_ AS (SELECT rep, fs.fold, avg(lab) FILTER (labs.fold <> fs.fold) AS m FROM labs, fs GROUP BY ALL),
  w AS MATERIALIZED (SELECT tot.rep, m.fold, tot.f, tot.b, m.m AS prior,
      (tot.s - coalesce(own.s, 0) - (tot.n - coalesce(own.n, 0)) * m.m) / (tot.n - coalesce(own.n, 0) + 1) AS wt
    FROM tot JOIN mean_ m ON m.rep = tot.rep
    LEFT JOIN own ON own.rep = tot.rep AND own.fold = m.fold AND own.f = tot.f AND own.b = tot.b),
  scored AS (SELECT l.rep, l.fold, any_value(lab) AS y, any_value(prior) + sum(wt) AS s FROM labs l JOIN long_ g USING (row_id)
    JOIN w ON w.rep = l.rep AND w.fold = l.fold AND w.f = g.f AND w.b = g.b GROUP BY l.rep, l.fold, row_id),
  line AS (SELECT a.rep, fs.fold, regr_slope(y, s) FILTER (a.fold <> fs.fold) AS slope, regr_intercept(y, s) FILTER (a.fold <> fs.fold) AS icept
    FROM scored a, fs GROUP BY ALL),
  r2 AS (SELECT rep, fold, 1 - sum((y - icept - slope * s) ** 2) / (var_pop(y) * count(*)) AS value FROM scored JOIN line USING (rep, fold) GROUP BY ALL),
  means AS (SELECT rep, avg(value) AS s FROM r2 GROUP BY rep),
  one AS (SELECT max(s) FILTER (rep = 0) AS score_real, avg(s) FILTER (rep > 0) AS score_shuffled_mean,
    stddev_pop(s) FILTER (rep > 0) AS score_shuffled_std FROM means)"""


SIGNAL_REG = f"""WITH {REG_LONG} SELECT *, gap > greatest(3 * score_shuffled_std, 0.02) AS has_signal,
    CASE WHEN (CASE WHEN gap > greatest(3 * score_shuffled_std, 0.02) THEN gap > 0.1 ELSE gap < score_shuffled_std END) THEN 'high' ELSE 'medium' END AS confidence
  FROM (SELECT *, score_real - score_shuffled_mean AS gap FROM one)"""


@query("signal_check_reg", ("number_target",), SIGNAL_REG, _SIGNAL)
def signal_check_reg(spark, sf):
    return regression.signal_check(regression.prepare_regression(v.number_target(spark, sf), "y", ["x1", "x2"]))


# every model (size, fold) is trained on the rows of its size outside the fold, and a line is fitted on them
CURVE_REG = f"""{REG_LONG[:REG_LONG.index("shuffled AS")]}
  sz AS MATERIALIZED (SELECT row_id, fold, y, (SELECT count(*) FROM (SELECT unnest([{', '.join(str(s) for s in forensics.SIZES[:-1])}]) AS s) WHERE u >= s) AS size_index
    FROM (SELECT row_id, fold, y, {v.u_sql('row_id', 'size0')} AS u FROM folds)),
  ss AS (SELECT unnest(range(0, {len(forensics.SIZES)})) AS rep), fs AS (SELECT DISTINCT fold FROM folds),
  own AS (SELECT rep, z.fold, f, b, count(*) AS n, sum(y) AS s FROM sz z JOIN ss ON size_index <= rep JOIN long_ l ON l.row_id = z.row_id GROUP BY ALL),
  tot AS (SELECT rep, f, b, sum(n) AS n, sum(s) AS s FROM own GROUP BY ALL),
  mean_ AS (SELECT rep, fs.fold, avg(y) FILTER (z.fold <> fs.fold) AS m, count(*) FILTER (z.fold <> fs.fold) AS n_train
    FROM sz z JOIN ss ON size_index <= rep, fs GROUP BY ALL),
  grid AS (SELECT DISTINCT f, b FROM long_),
  w AS MATERIALIZED (SELECT m.rep, m.fold, grid.f, grid.b, m.m AS prior,
      (coalesce(tot.s, 0) - coalesce(own.s, 0) - (coalesce(tot.n, 0) - coalesce(own.n, 0)) * m.m) / (coalesce(tot.n, 0) - coalesce(own.n, 0) + 1) AS wt
    FROM mean_ m CROSS JOIN grid LEFT JOIN tot ON tot.rep = m.rep AND tot.f = grid.f AND tot.b = grid.b
    LEFT JOIN own ON own.rep = m.rep AND own.fold = m.fold AND own.f = grid.f AND own.b = grid.b),
  scored AS MATERIALIZED (SELECT rep, w.fold AS mf, w.fold = l.fold AS held, l.row_id, any_value(z.y) AS y, any_value(prior) + sum(wt) AS s
    FROM long_ l JOIN sz z ON z.row_id = l.row_id JOIN w ON w.f = l.f AND w.b = l.b AND (w.fold = l.fold OR size_index <= w.rep)
    GROUP BY rep, w.fold, l.fold, l.row_id),
  line AS (SELECT rep, mf, regr_slope(y, s) FILTER (NOT held) AS slope, regr_intercept(y, s) FILTER (NOT held) AS icept FROM scored GROUP BY ALL),
  r2 AS (SELECT rep, mf, held, 1 - sum((y - icept - slope * s) ** 2) / (var_pop(y) * count(*)) AS value FROM scored JOIN line USING (rep, mf) GROUP BY ALL),
  ntr AS (SELECT rep, avg(n_train) AS n_train FROM mean_ GROUP BY rep),
  curve AS (SELECT {_list([str(s) + '::DOUBLE' for s in forensics.SIZES])}[rep + 1] AS size, n_train,
      avg(value) FILTER (NOT held) AS score_train, avg(value) FILTER (held) AS score_valid
    FROM r2 JOIN ntr USING (rep) GROUP BY rep, n_train)"""


@query("learning_curve_reg", ("number_target",), f"WITH {CURVE_REG} SELECT * FROM curve", ("size", "n_train", "score_train", "score_valid"))
def learning_curve_reg(spark, sf):
    return regression.learning_curve(regression.prepare_regression(v.number_target(spark, sf), "y", ["x1", "x2"]))


_REG3 = ("x1", "x2", "x3")
GAINS_REG = f"""wide_ AS (SELECT *, x1 - x2 AS x3, floor({v.u_sql('row_id', 'fold0')} * 5)::BIGINT AS fold FROM number_target),
  edges_ AS (SELECT {", ".join(f"list_sort(list_distinct(quantile_cont({c}, [{PROBES}]))) AS e_{c}" for c in _REG3)} FROM wide_),
  long_ AS MATERIALIZED ({" UNION ALL ".join(
      f"SELECT row_id, fold, y, '{c}' AS f, len([e FOR e IN e_{c} IF e < {c}]) AS b FROM wide_, edges_" for c in _REG3)}),
  fs AS (SELECT DISTINCT fold FROM wide_),
  own AS (SELECT fold, f, b, count(*) AS n, sum(y) AS s FROM long_ GROUP BY ALL),
  tot AS (SELECT f, b, sum(n) AS n, sum(s) AS s FROM own GROUP BY ALL),
  mean_ AS (SELECT fs.fold, avg(y) FILTER (wide_.fold <> fs.fold) AS m FROM wide_, fs GROUP BY ALL),
  w AS MATERIALIZED (SELECT m.fold, tot.f, tot.b, m.m AS prior,
      (tot.s - coalesce(own.s, 0) - (tot.n - coalesce(own.n, 0)) * m.m) / (tot.n - coalesce(own.n, 0) + 1) AS wt
    FROM mean_ m CROSS JOIN tot LEFT JOIN own ON own.fold = m.fold AND own.f = tot.f AND own.b = tot.b),
  sets AS (SELECT unnest(['', 'x2', 'x2', 'diff', 'diff']) AS candidate, unnest(['x1', 'x1', 'x2', 'x1', 'x3']) AS f),
  scored AS MATERIALIZED (SELECT candidate, l.fold, row_id, any_value(y) AS y, any_value(prior) + sum(wt) AS s
    FROM long_ l JOIN sets USING (f) JOIN w ON w.fold = l.fold AND w.f = l.f AND w.b = l.b GROUP BY candidate, l.fold, row_id),
  line AS (SELECT candidate, fs.fold, regr_slope(y, s) FILTER (a.fold <> fs.fold) AS slope, regr_intercept(y, s) FILTER (a.fold <> fs.fold) AS icept
    FROM scored a, fs GROUP BY ALL),
  folded AS (SELECT candidate, fold, 1 - sum((y - icept - slope * s) ** 2) / (var_pop(y) * count(*)) AS value
    FROM scored JOIN line USING (candidate, fold) GROUP BY ALL),
  diffs AS (SELECT c.candidate, c.value - b.value AS diff FROM folded c JOIN folded b ON b.fold = c.fold AND b.candidate = '' WHERE c.candidate <> '')"""


@query("paired_gain_reg", ("number_target",),
       f"""WITH {GAINS_REG} SELECT candidate, avg(diff) AS gain, stddev_samp(diff) / sqrt(count(*)) AS sem,
            avg(diff) > greatest(3 * stddev_samp(diff) / sqrt(count(*)), 0.005) AS significant FROM diffs GROUP BY candidate""", ("gain", "sem"))
def paired_gain_reg(spark, sf):
    data = v.number_target(spark, sf).withColumn("x3", F.col("x1") - F.col("x2"))
    prep = regression.prepare_regression(data, "y", ["x1", "x2", "x3"])
    return combos.paired_gain(regression.fold_gains(prep, ["x1"], {"x2": ["x2"], "diff": ["x3"]}))


_FEATURE_SIGNAL_REG = f"""WITH edges AS (SELECT list_sort(list_distinct(quantile_cont(y, [{", ".join(f"{i}/10.0::DOUBLE" for i in range(1, 10))}]))) AS e FROM number_target),
          nt AS (SELECT row_id, x1, x2, len([q FOR q IN e IF q < y]) AS y FROM number_target, edges), {long_sql('nt', ('x1', 'x2'))}, {MI}
          SELECT feature, mutual_info, row_number() OVER (ORDER BY mutual_info DESC, feature) AS rank, mutual_info > 0.01 AS informative FROM mi"""


@query("feature_signal_reg", ("number_target",), _FEATURE_SIGNAL_REG, ("mutual_info",))
def feature_signal_reg(spark, sf):
    binned = regression.target_classes(v.number_target(spark, sf), "y")
    return forensics.feature_signal(learners.prepare(binned, "target_bin", ["x1", "x2"]))


_TREND_REG = TREND.replace(CURVE, CURVE_REG)
_CONFLICT_REG = """SELECT *, within_std / overall_std AS relative FROM (
  SELECT sum(size)::BIGINT AS n, coalesce(sum(size) FILTER (size > 1), 0) / sum(size) AS duplicate_fraction, avg(sd) FILTER (size > 1) AS within_std,
    (SELECT stddev_pop(y) FROM number_target) AS overall_std
  FROM (SELECT count(*) AS size, stddev_pop(y) AS sd FROM number_target GROUP BY x1, x2))"""
_VERDICT_REG = f"""SELECT CASE WHEN NOT sig THEN 'no_signal' WHEN NOT flat THEN 'more_data_needed' ELSE 'model_limited' END AS verdict,
    CASE WHEN NOT sig AND sc = 'high' THEN 'high' ELSE 'medium' END AS confidence,
    CASE WHEN NOT sig THEN 'no_signal' WHEN flat THEN 'curve_flat' ELSE 'curve_moving' END AS findings,
    CASE WHEN NOT sig THEN 'change_features_or_verify_labels' WHEN flat THEN 'invest_in_features_or_labels' ELSE 'collect_more_data' END AS recommendations
  FROM (SELECT s.has_signal AS sig, s.confidence AS sc, t.plateaued AS flat FROM ({SIGNAL_REG}) s, ({_TREND_REG}) t)"""


@query("forensics_summary_reg", ("number_target",), " UNION ALL ".join(f"({x})" for x in (
    items_sql("'signal_check'", SIGNAL_REG, _SIGNAL, ("has_signal", "confidence")),
    items_sql("'conflict_rate'", _CONFLICT_REG, ("duplicate_fraction", "within_std", "overall_std", "relative"), ("n",)),
    items_sql("'learning_curve'", _TREND_REG, ("last_gain", "total_gain"), ("plateaued", "rising")),
    items_sql("'feature_signal'", f"SELECT * FROM ({_FEATURE_SIGNAL_REG}) WHERE rank = 1", ("mutual_info",), ("feature",)),
    items_sql("'verdict'", _VERDICT_REG, (), ("verdict", "confidence", "findings", "recommendations")),
    items_sql("'input'", "SELECT count(*) AS n_rows, 2 AS n_features, '' AS dropped, 'r2' AS scoring FROM number_target", (),
              ("n_rows", "n_features", "dropped", "scoring")))))
def forensics_summary_reg(spark, sf):
    return reports.run_forensics(v.number_target(spark, sf), "y", ["x1", "x2"], "regression")
