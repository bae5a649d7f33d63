"""Per-run diagnostics (group F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, reports
from ..operators import diagnose as d
from . import views as v
from .catalog import query
from .queries_resample import floor_sql


def _rows(spark, sf):
    return d.row_error(align.join_features(v.preds_slice(spark, sf), v.feat(spark, sf), "target"))


def _quartile(column: str, source: str) -> str:
    cut = lambda p: f"(SELECT quantile_cont({column}::DOUBLE, {p}) FROM {source})"
    return f"""CASE WHEN {column} IS NULL THEN 'nan' WHEN {column} <= {cut(0.25)} THEN 'q1' WHEN {column} <= {cut(0.5)} THEN 'q2'
      WHEN {column} <= {cut(0.75)} THEN 'q3' ELSE 'q4' END"""


def _by_value(column: str, source: str) -> str:
    text = f"coalesce({column}::VARCHAR, 'nan')"
    return f"""CASE WHEN {text} IN (SELECT x FROM (SELECT {text} AS x, count(*) AS c FROM {source} GROUP BY 1
      ORDER BY c DESC, x LIMIT 8)) THEN {text} ELSE '(other)' END"""


BUCKETS = {
    "total_price": _quartile("total_price", "rows_"), "priority": _by_value("priority", "rows_"),
    "segment": _by_value("segment", "rows_"), "nation": _quartile("nation", "rows_"),
    "month": _quartile("month", "rows_"),
}
ROWS_CTE = """rows_ AS (SELECT *, (y_true <> y_pred)::INT AS error FROM preds_slice JOIN feat USING (row_id))"""
CELLS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {b} AS bucket, error FROM rows_" for c, b in BUCKETS.items())

SLICES_SQL = f"""WITH {ROWS_CTE}, total AS (SELECT avg(error) AS overall, count(*) AS n_all FROM rows_)
  SELECT s.feature, bucket, n, rate AS error, lift, meaning FROM (
    SELECT feature, bucket, count(*) AS n, round(avg(error), 4) AS rate, round(avg(error) / overall, 2) AS lift
    FROM ({CELLS}), total GROUP BY feature, bucket, overall, n_all
    HAVING count(*) >= greatest(10, floor(0.02 * n_all)) AND avg(error) > overall
    ORDER BY lift DESC, n DESC, feature, bucket LIMIT 8) s LEFT JOIN meanings m ON m.feature = s.feature"""


@query("row_error", ("preds_slice", "preds_reg"),
       """SELECT 'classification' AS task, count(*) AS n, avg((y_true <> y_pred)::INT) AS overall FROM preds_slice
          UNION ALL SELECT 'regression', count(*), avg(abs(y_true - y_pred)) FROM preds_reg""", ("overall",))
def row_error(spark, sf):
    measure = lambda df, task: d.row_error(df, task).agg(
        F.lit(task).alias("task"), F.count("*").alias("n"), F.avg("error").alias("overall"))
    return measure(v.preds_slice(spark, sf), "classification").unionByName(
        measure(v.preds_reg(spark, sf), "regression"))


@query("error_slices", ("preds_slice", "feat", "meanings"), SLICES_SQL, ("error", "lift"))
def error_slices(spark, sf):
    return d.error_slices(_rows(spark, sf), v.FEATURES, v.meanings(spark, sf))


@query("quartile_bucket", ("feat",),
       f"SELECT row_id, {_quartile('total_price', 'feat')} AS bucket FROM feat")
def quartile_bucket(spark, sf):
    return d.quartile_bucket(v.feat(spark, sf), "total_price").select("row_id", "bucket")


@query("quartile_bucket_nan", ("feat",),
       f"""SELECT row_id, {_quartile('price', 'odd')} AS bucket FROM odd""".replace("SELECT row_id", f"""WITH odd AS (
         SELECT row_id, CASE WHEN {v.u_sql('row_id', 'nan')} >= 0.4 THEN total_price END AS price FROM feat) SELECT row_id""", 1))
def quartile_bucket_nan(spark, sf):
    """Two fifths of the values are NaN: they are missing values, as null is."""
    price = F.when(v.u("row_id", "nan") < 0.4, F.lit(float("nan"))).otherwise(F.col("total_price"))
    return d.quartile_bucket(v.feat(spark, sf).withColumn("price", price), "price").select("row_id", "bucket")


WIDE = tuple(f"w{i}" for i in range(36))
_WIDE_VALUES = ", ".join(f"floor({v.u_sql('row_id', c)} * {2 + i % 9})::BIGINT AS {c}" for i, c in enumerate(WIDE[:-1]))
_WIDE_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS feature, {_by_value(c, 'rows_')} AS bucket, error FROM rows_" for c in WIDE)


@query("error_slices_wide", ("preds_slice", "feat"),
       f"""WITH rows_ AS (SELECT row_id, (y_true <> y_pred)::INT AS error, {_WIDE_VALUES}, priority AS w35
            FROM preds_slice JOIN feat USING (row_id)), total AS (SELECT avg(error) AS overall, count(*) AS n_all FROM rows_)
          SELECT feature, bucket, count(*) AS n, round(avg(error), 4) AS error, round(avg(error) / overall, 2) AS lift
            FROM ({_WIDE_CELLS}), total GROUP BY feature, bucket, overall, n_all
            HAVING count(*) >= greatest(10, floor(0.02 * n_all)) AND avg(error) > overall
            ORDER BY lift DESC, n DESC, feature, bucket LIMIT 8""", ("error", "lift"))
def error_slices_wide(spark, sf):
    """36 features, the one that tells the errors comes last."""
    values = {c: F.floor(v.u("row_id", c) * (2 + i % 9)) for i, c in enumerate(WIDE[:-1])}
    rows = _rows(spark, sf)
    return d.error_slices(rows.withColumns(values).withColumn(WIDE[-1], F.col("priority")), WIDE)


@query("top_values_other", ("quality",),
       f"SELECT 'source' AS feature, {_by_value('source', 'quality')} AS bucket, count(*) AS n FROM quality GROUP BY 1, 2")
def top_values_other(spark, sf):
    return d.top_values_other(v.quality(spark, sf), "source")


@query("confusion_matrix", ("preds_multi",), "SELECT y_true, y_pred, count(*) AS n FROM preds_multi GROUP BY 1, 2")
def confusion_matrix(spark, sf):
    return d.confusion(v.preds_multi(spark, sf))


@query("confused_pairs", ("preds_multi",),
       """SELECT y_true, y_pred, count(*) AS n FROM preds_multi WHERE y_true <> y_pred GROUP BY 1, 2
          ORDER BY n DESC, y_true, y_pred LIMIT 5""")
def confused_pairs(spark, sf):
    return d.confused_pairs(v.preds_multi(spark, sf))


BINS = """SELECT least(greatest(trunc(proba_1 * 10)::BIGINT, 0), 9) AS bin, count(*) AS n, avg(proba_1) AS confidence,
  avg(y_true) AS observed FROM preds_cls GROUP BY 1"""


@query("calibration_bins", ("preds_cls",), BINS, ("confidence", "observed"))
def calibration_bins(spark, sf):
    return d.calibration_bins(v.preds_cls(spark, sf), "proba_1", 1)


@query("ece", ("preds_cls",),
       f"""SELECT ece, CASE WHEN ece < 0.05 THEN 'well calibrated' WHEN ece < 0.15 THEN 'moderately miscalibrated'
            ELSE 'badly miscalibrated' END AS quality
          FROM (SELECT sum(abs(observed - confidence) * n) / sum(n) AS ece FROM ({BINS}))""", ("ece",))
def ece(spark, sf):
    return d.calibration_error(d.calibration_bins(v.preds_cls(spark, sf), "proba_1", 1))


@query("class_balance", ("preds_cls",),
       """SELECT n_classes, r AS imbalance_ratio,
            CASE WHEN r < 2 THEN 'balanced' WHEN r < 10 THEN 'imbalanced' ELSE 'severely imbalanced' END AS level
          FROM (SELECT count(*) AS n_classes, max(n)::DOUBLE / min(n) AS r FROM (SELECT count(*) AS n FROM preds_cls GROUP BY y_true))""",
       ("imbalance_ratio",))
def class_balance(spark, sf):
    return d.class_balance(v.preds_cls(spark, sf))


@query("residual_stats", ("preds_reg",),
       """SELECT n, bias, residual_std, c AS heteroscedasticity_corr, abs(bias) > 0.05 * (sd + 1e-12) AS biased,
            abs(c) > 0.3 AS heteroscedastic
          FROM (SELECT count(*) AS n, avg(y_true - y_pred) AS bias, stddev_pop(y_true - y_pred) AS residual_std,
            corr(y_pred, abs(y_true - y_pred)) AS c, stddev_pop(y_true) AS sd FROM preds_reg)""",
       ("bias", "residual_std", "heteroscedasticity_corr"))
def residual_stats(spark, sf):
    return d.residual_stats(v.preds_reg(spark, sf))


@query("residual_sample", ("preds_reg",),
       f"""SELECT row_id, y_pred AS prediction, y_true - y_pred AS residual FROM preds_reg
          ORDER BY {v.u_sql('row_id', 'residual0')}, row_id LIMIT 2000""", ("prediction", "residual"))
def residual_sample(spark, sf):
    return d.residual_sample(v.preds_reg(spark, sf))


ROC = """SELECT s AS score, sum(neg) OVER w / (sum(neg) OVER ())::DOUBLE AS fpr, sum(pos) OVER w / (sum(pos) OVER ())::DOUBLE AS tpr
  FROM (SELECT proba_1 AS s, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM preds_cls GROUP BY 1)
  WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query("roc_curve", ("preds_cls",), ROC, ("score", "fpr", "tpr"))
def roc_curve(spark, sf):
    return d.roc_curve(v.preds_cls(spark, sf), "proba_1", 1)


@query("operating_points", ("preds_cls",),
       f"""WITH c AS ({ROC})
          SELECT 'recall_at_5pct_overkill' AS point, round(max(tpr) FILTER (fpr <= 0.05), 3) AS value FROM c
          UNION ALL SELECT 'recall_at_10pct_overkill', round(max(tpr) FILTER (fpr <= 0.1), 3) FROM c
          UNION ALL SELECT 'recall_at_20pct_overkill', round(max(tpr) FILTER (fpr <= 0.2), 3) FROM c
          UNION ALL SELECT 'overkill_for_80pct_recall', round(min(fpr) FILTER (tpr >= 0.8), 3) FROM c
          UNION ALL SELECT 'overkill_for_90pct_recall', round(min(fpr) FILTER (tpr >= 0.9), 3) FROM c""", ("value",))
def operating_points(spark, sf):
    return d.operating_points(d.roc_curve(v.preds_cls(spark, sf), "proba_1", 1))


@query("degenerate_scores", ("preds_cls", "preds_const"),
       """SELECT 'constant' AS run, least(count(DISTINCT proba_1), 3) AS n_distinct, count(DISTINCT proba_1) < 3 AS degenerate FROM preds_const
          UNION ALL SELECT 'normal', least(count(DISTINCT proba_1), 3), count(DISTINCT proba_1) < 3 FROM preds_cls""")
def degenerate_scores(spark, sf):
    check = lambda df, run: d.degenerate_scores(df, "proba_1").withColumn("run", F.lit(run))
    return check(v.preds_const(spark, sf), "constant").unionByName(check(v.preds_cls(spark, sf), "normal"))


@query("missed_positives", ("preds_cls",),
       """SELECT count(*) FILTER (y_true = 1 AND y_pred <> 1) AS n_missed, count(*) FILTER (y_true = 1 AND y_pred = 1) AS n_caught FROM preds_cls""")
def missed_positives(spark, sf):
    return d.missed_positives(v.preds_cls(spark, sf), 1)


@query("overfit_gap", ("runs",),
       """SELECT run_id, t AS train, s AS validation, t - s AS gap,
            CASE WHEN t - s IS NULL THEN 'not measurable' WHEN t - s > 0.05 THEN 'likely overfitting' ELSE 'small gap' END AS level
          FROM (SELECT run_id, (metrics->>'$.train_score')::DOUBLE AS t, (metrics->>'$.score')::DOUBLE AS s FROM runs)""",
       ("train", "validation", "gap"))
def overfit_gap(spark, sf):
    runs = v.runs(spark, sf).withColumn("metrics", F.from_json("metrics", "map<string,double>"))
    return d.overfit_gap(runs, "score", True)




# --- whole reports ------------------------------------------------------------------------------


def items_sql(item: str, source: str, doubles: tuple[str, ...] = (), others: tuple[str, ...] = ()) -> str:
    """(item, key, value) of the columns of a one-row ``source``; ``item`` is an expression."""
    keys = ", ".join(f"'{c}'" for c in (*doubles, *others))
    values = ", ".join([f"printf('%.6f', round({c}::DOUBLE, 6) + 0.0)" for c in doubles] + [f"{c}::VARCHAR" for c in others])
    return f"SELECT {item} AS item, unnest([{keys}]) AS key, unnest([{values}]) AS value FROM ({source})"


def _report_sql(preds: str, error: str, error_name: str, requested: str, metric: str, fallback: str, parts: list[str]) -> str:
    floor = floor_sql(metric, 200)
    floor_preds = "preds_cls" if metric in ("auc", "accuracy") else "preds_reg"
    floor = floor.replace(f"FROM {floor_preds}", f"FROM {preds}")
    rows = f"rows_all AS (SELECT *, {error} AS error FROM {preds} JOIN feat USING (row_id))"
    # the buckets read rows_, a name that the floor's SQL uses for itself
    cells = CELLS.replace("rows_", "rows_all")
    slices = f"""SELECT *, row_number() OVER (ORDER BY lift DESC, n DESC, feature, bucket) AS place FROM (
        SELECT feature, bucket, count(*) AS n, round(avg(error), 4) AS error, round(avg(error) / overall, 2) AS lift
        FROM ({cells}), (SELECT avg(error) AS overall, count(*) AS n_all FROM rows_all) GROUP BY feature, bucket, overall, n_all
        HAVING count(*) >= greatest(10, floor(0.02 * n_all)) AND avg(error) > overall ORDER BY lift DESC, n DESC, feature, bucket LIMIT 8)"""
    own = [
        items_sql("'overall'", f"SELECT count(*) AS n, '{error_name}' AS error_name, avg(error) AS error FROM rows_all", ("error",), ("n", "error_name")),
        items_sql("'noise_floor'", f"SELECT *, '{requested}' AS requested, {fallback} AS fallback, 'ok' AS status FROM ({floor})",
                  ("mean", "std", "ci_low", "ci_high", "min_significant_delta"), ("n_boot", "requested", "metric", "fallback", "status")),
        items_sql("'error_slice_' || place", slices, ("error", "lift"), ("feature", "bucket", "n")),
    ]
    return f"WITH {rows} " + " UNION ALL ".join(f"({x})" for x in [*own, *parts])


@query("run_diagnosis_reg", ("preds_reg", "feat"), _report_sql(
    "preds_reg", "abs(y_true - y_pred)", "absolute error", "mape", "rmse", "true", [items_sql(
        "'residuals'",
        """SELECT n, bias, residual_std, c AS heteroscedasticity_corr, abs(bias) > 0.05 * (sd + 1e-12) AS biased, abs(c) > 0.3 AS heteroscedastic
           FROM (SELECT count(*) AS n, avg(y_true - y_pred) AS bias, stddev_pop(y_true - y_pred) AS residual_std,
             corr(y_pred, abs(y_true - y_pred)) AS c, stddev_pop(y_true) AS sd FROM preds_reg)""",
        ("bias", "residual_std", "heteroscedasticity_corr"), ("n", "biased", "heteroscedastic"))]))
def run_diagnosis_reg(spark, sf):
    """A numeric target whose goal names a metric that is not known: the floor is that of the fallback."""
    return reports.run_diagnosis(v.preds_reg(spark, sf), v.feat(spark, sf), "target", v.FEATURES, "regression", "mape", False)


_ROC = """SELECT sum(pos) OVER w / (SELECT sum(y_true) FROM preds_slice) AS tpr, sum(neg) OVER w / (SELECT sum(1 - y_true) FROM preds_slice) AS fpr
  FROM (SELECT proba_1 AS s, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM preds_slice GROUP BY 1) WINDOW w AS (ORDER BY s DESC)"""
_POINTS_SQL = ", ".join(
    [f"round(coalesce(max(tpr) FILTER (fpr <= {x}), 0), 3) AS recall_at_{round(x * 100)}pct_overkill" for x in d.OVERKILL_LEVELS]
    + [f"round(min(fpr) FILTER (tpr >= {x}), 3) AS overkill_for_{round(x * 100)}pct_recall" for x in d.RECALL_LEVELS])


#: Items of a run with two labels and probabilities.
LABEL_ITEMS = [
    items_sql("'confusion'", "SELECT y_true, y_pred, count(*) AS n FROM preds_slice WHERE y_true <> y_pred GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 1",
                  (), ("y_true", "y_pred", "n")),
    items_sql("'class_balance'", """SELECT n_classes, r AS imbalance_ratio,
              CASE WHEN r < 2 THEN 'balanced' WHEN r < 10 THEN 'imbalanced' ELSE 'severely imbalanced' END AS level
            FROM (SELECT count(*) AS n_classes, max(n)::DOUBLE / min(n) AS r FROM (SELECT count(*) AS n FROM preds_slice GROUP BY y_true))""",
                  ("imbalance_ratio",), ("n_classes", "level")),
    items_sql("'missed_positives'", """SELECT count(*) FILTER (y_pred <> 1) AS n_missed, count(*) FILTER (y_pred = 1) AS n_caught
            FROM preds_slice WHERE y_true = 1""", (), ("n_missed", "n_caught")),
    items_sql("'calibration'", """SELECT e AS ece, CASE WHEN e < 0.05 THEN 'well calibrated' WHEN e < 0.15 THEN 'moderately miscalibrated'
              ELSE 'badly miscalibrated' END AS quality
            FROM (SELECT sum(abs(o - c) * n) / sum(n) AS e FROM (SELECT avg(y_true) AS o, avg(proba_1) AS c, count(*) AS n
              FROM preds_slice GROUP BY least(floor(proba_1 * 10), 9)))""", ("ece",), ("quality",)),
    items_sql("'scores'", """SELECT least(count(DISTINCT proba_1), 3) AS n_distinct, count(DISTINCT proba_1) < 3 AS degenerate FROM preds_slice""",
                  (), ("n_distinct", "degenerate")),
    items_sql("'operating_curve'", f"SELECT {_POINTS_SQL} FROM ({_ROC})", reports.POINTS),
]


@query("run_diagnosis", ("preds_slice", "feat"), _report_sql(
    "preds_slice", "(y_true <> y_pred)::INT", "error rate", "roc_auc", "auc", "false", LABEL_ITEMS))
def run_diagnosis(spark, sf):
    """Two labels with probabilities, in the goal's metric under its other name."""
    return reports.run_diagnosis(v.preds_slice(spark, sf), v.feat(spark, sf), "target", v.FEATURES, "classification", "roc_auc")
