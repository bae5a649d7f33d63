"""Metrics (group D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.metrics import REGISTRY, approximate_median_significance, context_of, known_metric
from ..operators.scoring import metric_value, metrics_table
from . import views as v
from .catalog import query

AUC = """(SELECT sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)) FROM (
  SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM (SELECT proba_1 AS s, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM {t} GROUP BY 1)))"""


def _one(key, view, metric, sql, reader):
    @query(key, (view,), f"SELECT {sql} AS value FROM {view}", ("value",))
    def run(spark, sf):
        return metric_value(reader(spark, sf), known_metric(metric))

    return run


@query("metric_auc", ("preds_cls",), f"SELECT {AUC.format(t='preds_cls')} AS value", ("value",))
def metric_auc(spark, sf):
    return metric_value(v.preds_cls(spark, sf), known_metric("roc_auc"))


EPS = "2.220446049250313e-16::DOUBLE"
_P = f"greatest(least(proba_1, 1 - {EPS}), {EPS})"
_one("metric_accuracy", "preds_cls", "acc", "avg((y_true = y_pred)::INT)", v.preds_cls)
_one("metric_logloss", "preds_cls", "log_loss", f"-avg(CASE WHEN y_true = 1 THEN ln({_P}) ELSE ln(1 - {_P}) END)", v.preds_cls)
_one("metric_rmse", "preds_reg", "rmse", "sqrt(avg((y_true - y_pred) ** 2))", v.preds_reg)
_one("metric_mae", "preds_reg", "mae", "avg(abs(y_true - y_pred))", v.preds_reg)
_one("metric_r2", "preds_reg", "r2", "1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*))", v.preds_reg)

_COUNTS = {
    "f1": "CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END",
    "precision": "CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END",
    "recall": "CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END",
}


def label_counts(view: str) -> str:
    return f"""(SELECT l.label, count(*) FILTER (y_true = l.label AND y_pred = l.label) AS tp,
      count(*) FILTER (y_true <> l.label AND y_pred = l.label) AS fp,
      count(*) FILTER (y_true = l.label AND y_pred <> l.label) AS fn
      FROM {view}, (SELECT y_true AS label FROM {view} UNION SELECT y_pred FROM {view}) l GROUP BY l.label)"""


def _label_metric(name):
    formula = _COUNTS[name]
    sql = f"""SELECT 'binary' AS mode, {formula} AS value FROM {label_counts('preds_cls')} WHERE label = 1
      UNION ALL SELECT 'macro', avg({formula}) FROM {label_counts('preds_multi')}"""

    @query(f"metric_{name}", ("preds_cls", "preds_multi"), sql, ("value",))
    def run(spark, sf):
        m = known_metric(name)
        two = metric_value(v.preds_cls(spark, sf), m).select(F.lit("binary").alias("mode"), "value")
        many = metric_value(v.preds_multi(spark, sf), m).select(F.lit("macro").alias("mode"), "value")
        return two.unionByName(many)

    return run


for _name in _COUNTS:
    _label_metric(_name)


AMS = """sqrt(2 * ((s + b + 10) * ln(1 + s / (b + 10)) - s))"""
AMS_SUMS = """sum(CASE WHEN y_pred = 1 AND y_true = 1 THEN weight ELSE 0 END) AS s,
  sum(CASE WHEN y_pred = 1 AND y_true = 0 THEN weight ELSE 0 END) AS b"""


@query("metric_custom", ("runs_preds",),
       f"SELECT run_id, {AMS} AS value FROM (SELECT run_id, {AMS_SUMS} FROM runs_preds GROUP BY run_id)", ("value",))
def metric_custom(spark, sf):
    return metric_value(v.runs_preds(spark, sf), approximate_median_significance(), ["run_id"])


@query("metrics_by_run", ("runs_preds",),
       f"""SELECT run_id, auc, acc AS accuracy, f1, precision, recall, logloss FROM (
            SELECT run_id, avg((y_true = y_pred)::INT) AS acc,
              -avg(CASE WHEN y_true = 1 THEN ln({_P}) ELSE ln(1 - {_P}) END) AS logloss,
              2.0::DOUBLE * count(*) FILTER (y_true = 1 AND y_pred = 1) / (2 * count(*) FILTER (y_true = 1 AND y_pred = 1)
                + count(*) FILTER (y_true <> y_pred)) AS f1,
              count(*) FILTER (y_true = 1 AND y_pred = 1)::DOUBLE / count(*) FILTER (y_pred = 1) AS precision,
              count(*) FILTER (y_true = 1 AND y_pred = 1)::DOUBLE / count(*) FILTER (y_true = 1) AS recall
            FROM runs_preds GROUP BY run_id)
          JOIN (SELECT run_id, sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)) AS auc FROM (
            SELECT run_id, pos, neg, coalesce(sum(neg) OVER (PARTITION BY run_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
            FROM (SELECT run_id, proba_1 AS s, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM runs_preds GROUP BY 1, 2)) GROUP BY run_id)
          USING (run_id)""", ("auc", "accuracy", "f1", "precision", "recall", "logloss"))
def metrics_by_run(spark, sf):
    preds = v.runs_preds(spark, sf)
    wanted = [m for m in REGISTRY if m.task == "classification"]
    out = metrics_table(preds, wanted, ["run_id"], context_of(preds))
    return out.select("run_id", "auc", "accuracy", "f1", "precision", "recall", "logloss")
