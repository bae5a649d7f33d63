"""Sources, sinks, profiling and contract checks (groups A, B) and row matching (group C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, profile
from ..operators.diagnose import error_slices, row_error
from ..session import scratch_path
from ..sources import datasets, eventlog
from . import views as v
from .catalog import query
from .views import table


# --- A ------------------------------------------------------------------------------------------


@query("scan_dataset", (), "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
       ("o_totalprice",))
def scan_dataset(spark, sf):
    df = datasets.scan_dataset(spark, f"{sf}/orders.parquet")
    return df.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("scan_predictions", ("runs_preds",),
       """SELECT run_id, count(*) AS n, sum(y_true)::BIGINT AS n_pos, sum(y_pred)::BIGINT AS n_said, avg(proba_1) AS mean_p
          FROM runs_preds GROUP BY run_id""", ("mean_p",))
def scan_predictions(spark, sf):
    root = scratch_path(spark, "predictions")
    datasets.write_predictions(v.runs_preds(spark, sf), root)
    return datasets.scan_predictions(spark, root).groupBy("run_id").agg(
        F.count("*").alias("n"), F.sum("y_true").alias("n_pos"), F.sum("y_pred").alias("n_said"),
        F.avg("proba_1").alias("mean_p"))


@query("sink_predictions_csv", ("preds_cls",), "SELECT row_id, y_true, y_pred, proba_1, weight FROM preds_cls",
       ("proba_1", "weight"))
def sink_predictions_csv(spark, sf):
    path = scratch_path(spark, "export") + ".csv"
    preds = v.preds_cls(spark, sf).select("row_id", "y_true", "y_pred", "proba_1", "weight")
    datasets.write_predictions_csv(preds, path)
    return datasets.scan_dataset(spark, path, preds.schema)


def _log(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
                    F.col("event_type").alias("kind"), F.col("props").alias("payload"))


@query("scan_event_log", (),
       """SELECT seq, kind, k FROM (SELECT event_id AS seq, event_type AS kind, (props->>'$.k')::BIGINT AS k
          FROM events ORDER BY event_id DESC LIMIT 20)""")
def scan_event_log(spark, sf):
    latest = eventlog.latest_events(_log(spark, sf), 20)
    return latest.select("seq", "kind", F.get_json_object("payload", "$.k").cast("bigint").alias("k"))


@query("append_event_log", (),
       """SELECT event_type AS kind, count(*) AS n, min(event_id) AS first_seq, max(event_id) AS last_seq,
            sum((props->>'$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1""")
def append_event_log(spark, sf):
    path = scratch_path(spark, "log")
    log = _log(spark, sf)
    odd = F.col("seq") % 2 == 1
    eventlog.append_events(log.filter(odd), path)
    eventlog.append_events(log.filter(~odd), path)
    back = eventlog.read_events(spark, path)
    return back.groupBy("kind").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.sum(F.get_json_object("payload", "$.k").cast("bigint")).alias("k"))


@query("upsert_context", ("context_log",),
       """SELECT project_id, feature, min(seq) AS created_seq, max(seq) AS updated_seq, arg_max(meaning, seq) AS meaning
          FROM context_log GROUP BY project_id, feature""")
def upsert_context(spark, sf):
    log = v.context_log(spark, sf).select(
        "project_id", "feature", F.col("seq").alias("created_seq"), F.col("seq").alias("updated_seq"), "meaning")
    half = log.filter("created_seq % 2 = 0")
    keys = ["project_id", "feature"]
    base = eventlog.upsert(half.limit(0), half, keys, "created_seq", "updated_seq")
    return eventlog.upsert(base, log.filter("created_seq % 2 = 1"), keys, "created_seq", "updated_seq")


@query("replace_diagnosis", ("diagnoses",),
       """SELECT project_id, run_id, max(version) AS version, arg_max(results, version) AS results
          FROM diagnoses GROUP BY project_id, run_id""")
def replace_diagnosis(spark, sf):
    return eventlog.latest_version(v.diagnoses(spark, sf), ["project_id", "run_id"], "version")


# --- B ------------------------------------------------------------------------------------------

_PROFILED = {
    "total_price": "double", "priority": "string", "segment": "string", "nation": "bigint", "month": "bigint",
    "target": "bigint",
}


@query("profile_dataset", ("feat",), " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) AS n, count(*) - count({c}) AS n_null,
        count(DISTINCT {c}) AS n_distinct FROM feat""" for c, t in _PROFILED.items()))
def profile_dataset(spark, sf):
    return profile.profile_columns(v.feat(spark, sf), list(_PROFILED))


@query("content_hash", (),
       """SELECT count(*) AS n_rows, sum(('0x' || substr(t, 1, 8))::BIGINT)::BIGINT AS hash_sum,
            bit_xor(('0x' || substr(t, 9, 8))::BIGINT) AS hash_xor
          FROM (SELECT md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_totalprice::DECIMAL(18, 2)::VARCHAR)) AS t FROM orders)""")
def content_hash(spark, sf):
    o = table(spark, sf, "orders")
    return profile.content_hash(
        o, [F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_totalprice").cast("decimal(18,2)")])


@query("target_distribution", ("quality",),
       "SELECT source AS value, count(*) AS n FROM quality GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def target_distribution(spark, sf):
    return profile.target_distribution(v.quality(spark, sf), "source")


@query("majority_fraction", ("feat",),
       """SELECT round(max(n) FILTER (segment IS NOT NULL) / sum(n), 4) AS majority_fraction
          FROM (SELECT segment, count(*) AS n FROM feat GROUP BY 1)""", ("majority_fraction",))
def majority_fraction(spark, sf):
    return profile.majority_fraction(v.feat(spark, sf), "segment")


@query("validate_predictions", ("preds_multi",),
       """SELECT '*' AS run_id, 'warning' AS severity, 'no_probabilities' AS code
          UNION ALL SELECT n_name, 'error', 'no_rows' FROM nation WHERE n_name NOT IN (
            SELECT n_name FROM nation WHERE n_nationkey IN (SELECT o_orderkey % 7 FROM orders))""")
def validate_predictions(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("n"), F.col("n_name").alias("run_id"))
    preds = v.preds_multi(spark, sf).withColumn("n", F.col("row_id") % 7).join(F.broadcast(nation), "n").drop("n")
    return profile.validate_predictions(preds, "classification", nation)


def _meta_rule(test, severity, code):
    return f"SELECT run_id, '{severity}' AS severity, '{code}' AS code FROM t WHERE {test}"


_META_TESTS = [
    _meta_rule("meta IS NULL", "error", "meta_missing"),
    _meta_rule("meta IS NOT NULL AND NOT ok", "error", "meta_not_json"),
    _meta_rule("ok AND kind <> 'OBJECT'", "error", "meta_not_object"),
    *[_meta_rule(f"kind = 'OBJECT' AND json_type(j, '$.{k}') IS NULL", "error", f"missing_key:{k}")
      for k in profile.META_TYPES],
    *[_meta_rule(f"kind = 'OBJECT' AND json_type(j, '$.{k}') NOT IN ({types})", "error", f"wrong_type:{k}")
      for k, types in {"model_desc": "'VARCHAR'", "hyperparams": "'OBJECT'", "features": "'ARRAY'",
                       "seed": "'BIGINT', 'UBIGINT', 'BOOLEAN'"}.items()],
    *[_meta_rule(f"kind = 'OBJECT' AND json_type(j, '$.{k}') IS NULL", "warning", f"advised:{k}")
      for k in profile.META_ADVISED],
]


@query("validate_meta", ("runs",),
       """WITH t AS (SELECT run_id, meta, ok, j, json_type(j) AS kind FROM (
            SELECT run_id, meta, json_valid(meta) AS ok, CASE WHEN json_valid(meta) THEN meta::JSON END AS j FROM runs))
          """ + " UNION ALL ".join(_META_TESTS))
def validate_meta(spark, sf):
    return profile.validate_meta(v.runs(spark, sf))


@query("validate_row_ids", ("runs_preds",),
       """SELECT DISTINCT row_id, 'not_in_dataset' AS problem FROM runs_preds WHERE row_id NOT IN (SELECT event_id FROM events)
          UNION ALL SELECT DISTINCT row_id, 'repeated' FROM (
            SELECT run_id, row_id FROM (SELECT run_id, row_id FROM runs_preds
              UNION ALL SELECT run_id, row_id FROM runs_preds WHERE run_id = 'R2' AND row_id % 9 = 0)
            GROUP BY 1, 2 HAVING count(*) > 1)""")
def validate_row_ids(spark, sf):
    preds = v.runs_preds(spark, sf).select("run_id", "row_id")
    with_repeats = preds.unionByName(preds.filter("run_id = 'R2' and row_id % 9 = 0"))
    dataset = table(spark, sf, "events").select(F.col("event_id").alias("row_id"))
    return align.unknown_row_ids(with_repeats, dataset)


@query("metric_advisory", ("quality",),
       """SELECT 'accuracy' AS metric, false AS refused, f AS majority_fraction, f >= 0.7 AS advise_other_metric
          FROM (SELECT round(max(n) / sum(n), 4) AS f FROM (SELECT count(*) AS n FROM quality GROUP BY quality))
          UNION ALL SELECT 'rmse', true, f, false
          FROM (SELECT round(max(n) / sum(n), 4) AS f FROM (SELECT count(*) AS n FROM quality GROUP BY quality))""",
       ("majority_fraction",))
def metric_advisory(spark, sf):
    q = v.quality(spark, sf)
    return profile.metric_advisory(q, "quality", "classification", "accuracy").unionByName(
        profile.metric_advisory(q, "quality", "classification", "rmse"))


# --- C ------------------------------------------------------------------------------------------


@query("join_features_predictions", ("preds_cls", "feat"),
       """SELECT row_id, y_true, y_pred, proba_1, weight, total_price, priority, segment, nation, month
          FROM preds_cls JOIN feat USING (row_id)""", ("proba_1", "weight", "total_price"))
def join_features_predictions(spark, sf):
    return align.join_features(v.preds_cls(spark, sf), v.feat(spark, sf), "target")


@query("align_pair", ("runs_preds",),
       """SELECT row_id, a.y_true, a.y_pred AS y_pred_a, b.y_pred AS y_pred_b, a.proba_1 AS proba_a, b.proba_1 AS proba_b
          FROM (SELECT * FROM runs_preds WHERE run_id = 'R1') a JOIN (SELECT * FROM runs_preds WHERE run_id = 'R4') b USING (row_id)""",
       ("proba_a", "proba_b"))
def align_pair(spark, sf):
    pair = align.align(v.runs_preds(spark, sf), ["R1", "R4"], ["y_true", "y_pred", "proba_1"])
    assert pair.enough
    return pair.wide.select(
        "row_id", F.col("y_true__0").alias("y_true"), F.col("y_pred__0").alias("y_pred_a"),
        F.col("y_pred__1").alias("y_pred_b"), F.col("proba_1__0").alias("proba_a"), F.col("proba_1__1").alias("proba_b"))


@query("align_many", ("runs_preds",),
       """SELECT r.run_id, r.row_id, r.y_true, r.y_pred, r.proba_1 FROM runs_preds r
          JOIN (SELECT row_id FROM runs_preds GROUP BY row_id HAVING count(DISTINCT run_id) = 4) c USING (row_id)""", ("proba_1",))
def align_many(spark, sf):
    group = align.align(v.runs_preds(spark, sf), list(v.RUNS), ["y_true", "y_pred", "proba_1"])
    assert group.enough
    return group.long().select("run_id", "row_id", "y_true", "y_pred", "proba_1")


@query("label_agreement", ("runs_preds",),
       """SELECT row_id, min(y) AS low, max(y) AS high FROM (
            SELECT run_id, row_id, CASE WHEN run_id = 'R2' AND row_id % 50 = 3 THEN 1 - y_true ELSE y_true END AS y
            FROM runs_preds WHERE run_id IN ('R1', 'R2'))
          GROUP BY row_id HAVING count(DISTINCT run_id) = 2 AND min(y) <> max(y)""")
def label_agreement(spark, sf):
    flipped = (F.col("run_id") == "R2") & (F.col("row_id") % 50 == 3)
    preds = v.runs_preds(spark, sf).withColumn(
        "y_true", F.when(flipped, 1 - F.col("y_true")).otherwise(F.col("y_true")))
    return align.label_disagreements(preds, ["R1", "R2"])


@query("semi_missed_rows", ("preds_cls", "feat"),
       """SELECT * FROM feat WHERE row_id IN (SELECT row_id FROM preds_cls WHERE y_true = 1 AND y_pred <> 1)""", ("total_price",))
def semi_missed_rows(spark, sf):
    return align.missed_rows(v.feat(spark, sf), v.preds_cls(spark, sf), 1)


@query("annotate_slices", ("preds_slice", "feat", "meanings"),
       """SELECT 'priority' AS feature, priority AS bucket, count(*) AS n,
            round(avg((y_true <> y_pred)::INT), 4) AS error,
            round(avg((y_true <> y_pred)::INT) / (SELECT avg((y_true <> y_pred)::INT) FROM preds_slice), 2) AS lift,
            (SELECT meaning FROM meanings WHERE feature = 'priority') AS meaning
          FROM preds_slice JOIN feat USING (row_id) GROUP BY priority
          HAVING avg((y_true <> y_pred)::INT) > (SELECT avg((y_true <> y_pred)::INT) FROM preds_slice)""",
       ("error", "lift"))
def annotate_slices(spark, sf):
    rows = row_error(align.join_features(v.preds_slice(spark, sf), v.feat(spark, sf), "target"))
    return align.annotate(error_slices(rows, ["priority"]), v.meanings(spark, sf))


@query("label_union", ("preds_multi",), "SELECT y_true AS label FROM preds_multi UNION SELECT y_pred FROM preds_multi")
def label_union(spark, sf):
    return align.label_union(v.preds_multi(spark, sf))


@query("row_intersection", ("runs_preds",),
       "SELECT row_id FROM runs_preds WHERE run_id = 'R1' INTERSECT SELECT row_id FROM runs_preds WHERE run_id = 'R4'")
def row_intersection(spark, sf):
    return align.row_intersection(v.runs_preds(spark, sf), "R1", "R4")
