"""Resampling (group E) and the ensemble probe (group J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import REPLICA_PRIME, poisson_cuts
from ..functions.metrics import approximate_median_significance, context_of, known_metric
from ..operators import align, ensemble
from ..operators import resample as r
from . import views as v
from .catalog import query
from .queries_metrics import AMS, AMS_SUMS
from .views import table

# --- oracle side of the bootstrap ---------------------------------------------------------------


def unit_sql(key: str = "row_id", seed: int = 0) -> str:
    return f"({v.h_sql(key, f'unit{seed}')} % {r.UNITS})"


def draws_sql(n_boot: int, seed: int = 0) -> str:
    """(unit, replica, w): Poisson(1) weights of all units with rows in table ``rows_``."""
    word = lambda i: f"(('0x' || substr(t, {1 + 8 * i}, 8))::BIGINT % {REPLICA_PRIME})"
    poly = f"(((({word(3)} * rep + {word(2)}) % {REPLICA_PRIME}) * rep + {word(1)}) % {REPLICA_PRIME} * rep + {word(0)}) % {REPLICA_PRIME}"
    # w = number of cumulative cuts at or below the value
    weight = " + ".join(f"(val >= {c})::INT" for c in poisson_cuts())
    return f"""SELECT unit, rep AS replica, {weight} AS w FROM (
      SELECT unit, rep, {poly} AS val FROM (
        SELECT unit, md5(concat_ws('|', unit, 'boot{seed}')) AS t FROM (SELECT DISTINCT unit FROM rows_)),
        (SELECT unnest(range(1, {n_boot + 1})) AS rep))"""


def auc_values_sql(by: str = "") -> str:
    """(by, replica, value) from rows_(unit, y_true, s) and draws."""
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}replica, sum(pos * (below + neg / 2.0::DOUBLE)) / nullif(sum(pos)::DOUBLE * sum(neg), 0) AS value FROM (
      SELECT {lead}replica, pos, neg, coalesce(sum(neg) OVER (PARTITION BY {lead}replica ORDER BY s
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT {lead}replica, s, sum(w * y_true) AS pos, sum(w * (1 - y_true)) AS neg
            FROM rows_ JOIN draws USING (unit) WHERE w > 0 GROUP BY {lead}replica, s)) GROUP BY {lead}replica"""


FLOOR = """count(value) AS n_boot, avg(value) AS mean, stddev_samp(value) AS std,
  quantile_cont(value, 0.025) AS ci_low, quantile_cont(value, 0.975) AS ci_high, 2 * stddev_samp(value) AS min_significant_delta"""
FLOOR_COLS = ("mean", "std", "ci_low", "ci_high", "min_significant_delta")

# plain-sum metrics by replica: (view, formula)
_SIMPLE = {
    "accuracy": ("preds_cls", "sum(w * (y_true = y_pred)::INT)::DOUBLE / sum(w)"),
    "f1": ("preds_cls", """2.0::DOUBLE * sum(w * y_true * y_pred) / (2 * sum(w * y_true * y_pred) + sum(w * (y_true <> y_pred)::INT))"""),
    "rmse": ("preds_reg", "sqrt(sum(w * (y_true - y_pred) ** 2) / sum(w))"),
    "r2": ("preds_reg", """1 - sum(w * (y_true - y_pred) ** 2) / (sum(w * y_true * y_true) - sum(w * y_true) ** 2 / sum(w))"""),
}


def floor_sql(metric: str, n_boot: int) -> str:
    if metric == "auc":
        return f"""WITH rows_ AS (SELECT {unit_sql()} AS unit, y_true, proba_1 AS s FROM preds_cls),
          draws AS ({draws_sql(n_boot)})
          SELECT 'auc' AS metric, {FLOOR} FROM ({auc_values_sql()})"""
    view, formula = _SIMPLE[metric]
    return f"""WITH rows_ AS (SELECT {unit_sql()} AS unit, y_true, y_pred FROM {view}), draws AS ({draws_sql(n_boot)})
      SELECT '{metric}' AS metric, {FLOOR} FROM (
        SELECT replica, {formula} AS value FROM rows_ JOIN draws USING (unit) WHERE w > 0 GROUP BY replica)"""


def _floor_query(key, metric, view, reader, n_boot=200):
    @query(key, (view,), floor_sql(metric, n_boot), FLOOR_COLS)
    def run(spark, sf):
        return r.noise_floor(reader(spark, sf), known_metric(metric), n_boot=n_boot)

    return run


_floor_query("noise_floor", "auc", "preds_cls", v.preds_cls)


@query("noise_floor_continuous", ("preds_cls",),
       f"""WITH rows_ AS (SELECT {unit_sql()} AS unit, y_true,
            floor((0.6 * {v.u_sql('row_id', 'p')} + 0.1 + 0.2 * y_true) / {r.SCORE_WIDTH}::DOUBLE + 0.5) * {r.SCORE_WIDTH}::DOUBLE AS s FROM preds_cls),
          draws AS ({draws_sql(200)})
          SELECT 'auc' AS metric, {FLOOR} FROM ({auc_values_sql()})""", FLOOR_COLS)
def noise_floor_continuous(spark, sf):
    """Scores that are not rounded: binned to the documented width at every size."""
    score = 0.6 * v.u("row_id", "p") + 0.1 + 0.2 * F.col("y_true")
    return r.noise_floor(v.preds_cls(spark, sf).withColumn("proba_1", score), known_metric("auc"), n_boot=200, score_width=r.SCORE_WIDTH)


_floor_query("noise_floor_accuracy", "accuracy", "preds_cls", v.preds_cls)
_floor_query("noise_floor_f1", "f1", "preds_cls", v.preds_cls)
_floor_query("noise_floor_rmse", "rmse", "preds_reg", v.preds_reg)
_floor_query("noise_floor_r2", "r2", "preds_reg", v.preds_reg)


@query("noise_floor_custom", ("preds_cls",),
       f"""WITH rows_ AS (SELECT {unit_sql()} AS unit, y_true, y_pred, weight FROM preds_cls), draws AS ({draws_sql(200)})
          SELECT 'ams' AS metric, {FLOOR} FROM (SELECT replica, {AMS} AS value FROM (
            SELECT replica, {AMS_SUMS.replace('weight', 'w * weight')} FROM rows_ JOIN draws USING (unit) GROUP BY replica))""",
       FLOOR_COLS)
def noise_floor_custom(spark, sf):
    return r.noise_floor(v.preds_cls(spark, sf), approximate_median_significance(), n_boot=200)


def _pair_rows(a: str, b: str) -> str:
    return f"""SELECT run_id, {unit_sql()} AS unit, y_true, proba_1 AS s, y_pred FROM runs_preds WHERE run_id IN ('{a}', '{b}')
      AND row_id IN (SELECT row_id FROM runs_preds WHERE run_id = '{a}' INTERSECT SELECT row_id FROM runs_preds WHERE run_id = '{b}')"""


def _deltas(a: str, b: str, n_boot: int) -> str:
    return f"""rows_ AS ({_pair_rows(a, b)}), draws AS ({draws_sql(n_boot)}), vals AS ({auc_values_sql('run_id')}),
      deltas AS (SELECT replica, max(value) FILTER (run_id = '{b}') - max(value) FILTER (run_id = '{a}') AS delta FROM vals GROUP BY replica)"""


def _point(run: str) -> str:
    return f"""(SELECT sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)) FROM (
      SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT s, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM rows_ WHERE run_id = '{run}' GROUP BY 1)))"""


def _compare_sql(a: str, b: str, n_boot: int) -> str:
    return f"""WITH {_deltas(a, b, n_boot)}, one AS (SELECT {_point(a)} AS value_a, {_point(b)} AS value_b,
        (SELECT stddev_samp(delta) FROM deltas) AS paired_std, (SELECT count(*) FROM rows_ WHERE run_id = '{a}') AS n_common)
      SELECT '{a}' AS run_a, '{b}' AS run_b, 'auc' AS metric, n_common, value_a, value_b, value_b - value_a AS improvement,
        paired_std, greatest(2 * paired_std, 1e-6) AS bar, abs(value_b - value_a) > greatest(2 * paired_std, 1e-6) AS significant FROM one"""


_COMPARE_COLS = ("value_a", "value_b", "improvement", "paired_std", "bar")


@query("paired_bootstrap", ("runs_preds",),
       f"WITH {_deltas('R1', 'R3', 100)} SELECT count(delta) AS n_boot, stddev_samp(delta) AS paired_std FROM deltas",
       ("paired_std",))
def paired_bootstrap(spark, sf):
    pair = align.align(v.runs_preds(spark, sf), ["R1", "R3"], ["y_true", "y_pred", "proba_1"])
    rows = pair.long()
    return r.paired_std(rows, known_metric("auc"), context_of(rows), "R1", "R3", 100)


@query("compare_runs", ("runs_preds",),
       " UNION ALL ".join(f"SELECT * FROM ({_compare_sql(a, b, 150)})" for a, b in (("R1", "R3"), ("R3", "R4"))), _COMPARE_COLS)
def compare_runs(spark, sf):
    preds = v.runs_preds(spark, sf).drop("weight")
    auc = known_metric("auc")
    return r.compare_runs(preds, "R1", "R3", auc).unionByName(r.compare_runs(preds, "R3", "R4", auc))


@query("paired_entry", ("runs_preds",),
       " UNION ALL ".join(f"SELECT '{w}' AS against, * FROM ({_compare_sql(a, 'R4', 100)})" for w, a in (("parent", "R1"), ("best", "R3"))),
       _COMPARE_COLS)
def paired_entry(spark, sf):
    preds = v.runs_preds(spark, sf).drop("weight")
    auc = known_metric("auc")
    against = lambda run, name: r.compare_runs(preds, run, "R4", auc, n_boot=100).withColumn("against", F.lit(name))
    return against("R1", "parent").unionByName(against("R3", "best"))


# --- samples and folds --------------------------------------------------------------------------


@query("subsample", ("feat",),
       f"""SELECT 'share' AS mode, row_id FROM feat WHERE {v.u_sql('row_id', 'sample0')} < 0.1
          UNION ALL SELECT 'rows', row_id FROM (SELECT row_id FROM feat ORDER BY {v.u_sql('row_id', 'sample0')}, row_id LIMIT 500)""")
def subsample(spark, sf):
    feat = v.feat(spark, sf).select("row_id")
    share = r.subsample(feat, 0.1).withColumn("mode", F.lit("share"))
    return share.unionByName(r.subsample_rows(feat, 500).withColumn("mode", F.lit("rows")))


@query("kfold", ("noisy",), f"SELECT row_id, floor({v.u_sql('row_id', 'fold0')} * 5)::BIGINT AS fold FROM noisy")
def kfold(spark, sf):
    return r.kfold(v.noisy(spark, sf).select("row_id"), 5)


def strat_sql(view: str, label: str, k: int = 5, seed: int = 0) -> str:
    """Folds for inputs without missing labels whose smallest class has at least ``k`` rows."""
    return f"""SELECT * EXCLUDE (_u), ((row_number() OVER (PARTITION BY {label} ORDER BY _u, row_id) - 1) % {k})::BIGINT AS fold
      FROM (SELECT *, {v.u_sql('row_id', f'fold{seed}')} AS _u FROM {view})"""


@query("stratified_kfold", ("quality",), f"SELECT row_id, quality, fold FROM ({strat_sql('quality', 'quality')})")
def stratified_kfold(spark, sf):
    q = v.quality(spark, sf).select("row_id", "quality")
    return r.stratified_kfold(q, "quality", 5).select("row_id", "quality", "fold")


def ring_sql(view: str, column: str, salts: dict[str, str]) -> str:
    """``view`` plus copies of ``column``, each taken from the next row in a hash order; the last row takes the first's."""
    us = ", ".join(f"{v.u_sql('row_id', salt)} AS _u{i}" for i, salt in enumerate(salts.values()))
    outs = ", ".join(
        f"coalesce(lead({column}) OVER w{i}, first_value({column}) OVER w{i}) AS {out}" for i, out in enumerate(salts))
    wins = ", ".join(f"w{i} AS (ORDER BY _u{i}, row_id)" for i in range(len(salts)))
    drop = ", ".join(f"_u{i}" for i in range(len(salts)))
    return f"""SELECT * EXCLUDE ({drop}), {outs} FROM (SELECT *, {us} FROM {view}) WINDOW {wins}"""


@query("shuffle_labels", ("noisy",),
       f"SELECT row_id, y, y1, y2 FROM ({ring_sql('noisy', 'y', {'y1': 'labels1', 'y2': 'labels2'})})")
def shuffle_labels(spark, sf):
    d = v.noisy(spark, sf).select("row_id", "y")
    return r.shuffle_column(d, "y", {"y1": "labels1", "y2": "labels2"})


SIZES = (0.2, 0.36, 0.52, 0.68, 0.84, 1.0)


@query("learning_sizes", ("noisy",),
       " UNION ALL ".join(
           f"SELECT {s}::DOUBLE AS size, count(*) AS n_train, sum(y)::BIGINT AS n_pos FROM noisy WHERE {v.u_sql('row_id', 'size0')} < {s}"
           for s in SIZES), ("size",))
def learning_sizes(spark, sf):
    from functools import reduce

    from pyspark.sql import DataFrame

    # one pass over the rows; the nested sizes are running sums of the few size groups
    groups = r.learning_sizes(v.noisy(spark, sf), SIZES).groupBy("_size").agg(
        F.count("*").alias("n"), F.sum("y").alias("pos"))
    parts = [
        groups.filter(F.col("_size") <= i).agg(
            F.lit(s).alias("size"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_train"), F.sum("pos").alias("n_pos"))
        for i, s in enumerate(SIZES)
    ]
    return reduce(DataFrame.unionByName, parts)


# --- J ------------------------------------------------------------------------------------------

MEMBERS = ["R1", "R2"]
COMMON = """common AS (SELECT row_id FROM runs_preds WHERE run_id IN ('R1', 'R2') GROUP BY row_id HAVING count(*) = 2),
  m AS (SELECT row_id, max(y_true) AS y_true, avg(proba_1) AS p, avg((y_pred = 1)::INT) AS share
        FROM runs_preds JOIN common USING (row_id) WHERE run_id IN ('R1', 'R2') GROUP BY row_id),
  rate AS (SELECT least(greatest(avg(share), 0.01), 0.99) AS rate FROM m),
  cut AS (SELECT lo + (pos - floor(pos)) * (hi - lo) AS cut FROM (
    SELECT pos, max(p) FILTER (rn = floor(pos) + 1) AS lo, max(p) FILTER (rn = ceil(pos) + 1) AS hi
    FROM (SELECT p, row_number() OVER (ORDER BY p) AS rn FROM m),
         (SELECT (1 - rate) * ((SELECT count(*) FROM m) - 1) AS pos FROM rate) GROUP BY pos))"""


def _pair(spark, sf):
    return align.align(v.runs_preds(spark, sf), MEMBERS, ["y_true", "y_pred", "proba_1"])


@query("ensemble_mean_proba", ("runs_preds",), f"WITH {COMMON} SELECT row_id, y_true, p AS proba_1 FROM m", ("proba_1",))
def ensemble_mean_proba(spark, sf):
    return ensemble.mean_proba(_pair(spark, sf))


def _rate_cut(spark, sf):
    pair = _pair(spark, sf)
    return pair, ensemble.selection_threshold(pair, ensemble.mean_proba(pair), 1)


@query("ensemble_threshold", ("runs_preds",),
       f"""WITH {COMMON} SELECT (SELECT rate FROM rate) AS rate, (SELECT cut FROM cut) AS threshold, count(*) AS n_selected
          FROM m WHERE p >= (SELECT cut FROM cut)""", ("rate", "threshold"))
def ensemble_threshold(spark, sf):
    pair, (rate, cut) = _rate_cut(spark, sf)
    chosen = ensemble.mean_proba(pair).filter(F.col("proba_1") >= cut)
    return chosen.agg(F.lit(rate).alias("rate"), F.lit(cut).alias("threshold"), F.count("*").alias("n_selected"))


@query("ensemble_vote", ("runs_preds",),
       """SELECT row_id, max(y_true) AS y_true, (avg((y_pred = 1)::INT) >= 0.5)::BIGINT AS y_pred FROM runs_preds
          WHERE row_id IN (SELECT row_id FROM runs_preds GROUP BY row_id HAVING count(*) = 4) GROUP BY row_id""")
def ensemble_vote(spark, sf):
    pair = align.align(v.runs_preds(spark, sf), list(v.RUNS), ["y_true", "y_pred"])
    rows = pair.long()
    return ensemble.vote(pair, context_of(rows))


@query("ensemble_mean_reg", ("preds_reg",),
       """SELECT row_id, y_true, y_true * ((0.9 + 0.2 * {a}) + (0.9 + 0.2 * {b})) / 2 AS y_pred FROM preds_reg""".format(
           a=v.u_sql("row_id", "ra"), b=v.u_sql("row_id", "rb")), ("y_pred",))
def ensemble_mean_reg(spark, sf):
    base = v.preds_reg(spark, sf).select("row_id", "y_true")
    member = lambda run, salt: base.withColumn("run_id", F.lit(run)).withColumn(
        "y_pred", F.col("y_true") * (0.9 + 0.2 * v.u("row_id", salt)))
    pair = align.align(member("A", "ra").unionByName(member("B", "rb")), ["A", "B"], ["y_true", "y_pred"])
    return ensemble.mean_prediction(pair)


@query("member_scores", ("runs_preds",),
       f"""WITH common AS (SELECT row_id FROM runs_preds GROUP BY row_id HAVING count(*) = 4),
          rows_ AS (SELECT run_id, y_true, proba_1 AS s FROM runs_preds JOIN common USING (row_id))
          {" UNION ALL ".join(f"SELECT '{x}' AS run_id, {_point(x)} AS value" for x in v.RUNS)}""", ("value",))
def member_scores(spark, sf):
    group = align.align(v.runs_preds(spark, sf), list(v.RUNS), ["y_true", "y_pred", "proba_1"])
    rows = group.long()
    return ensemble.member_scores(group, known_metric("auc"), context_of(rows))


ENSEMBLE_SQL = f"""WITH {COMMON},
  all_ AS (SELECT run_id, row_id, y_true, proba_1 AS s FROM runs_preds JOIN common USING (row_id) WHERE run_id IN ('R1', 'R2')
    UNION ALL SELECT 'ensemble', row_id, y_true, p FROM m),
  rows_ AS (SELECT run_id, {unit_sql()} AS unit, y_true, s FROM all_), draws AS ({draws_sql(200)}),
  vals AS ({auc_values_sql('run_id')}),
  points AS ({" UNION ALL ".join(f"SELECT '{x}' AS run_id, {_point(x)} AS value" for x in ("R1", "R2", "ensemble"))}),
  best AS (SELECT run_id, value FROM points WHERE run_id <> 'ensemble' ORDER BY value DESC, run_id LIMIT 1),
  deltas AS (SELECT replica, max(value) FILTER (run_id = 'ensemble') - max(value) FILTER (run_id = (SELECT run_id FROM best)) AS delta
    FROM vals GROUP BY replica),
  one AS (SELECT (SELECT count(*) FROM m) AS n_common, run_id AS best_run, value AS best_value,
    (SELECT value FROM points WHERE run_id = 'ensemble') AS ensemble_value, (SELECT stddev_samp(delta) FROM deltas) AS paired_std FROM best)
  SELECT n_common, best_run, best_value, ensemble_value, ensemble_value - best_value AS gain, paired_std,
    greatest(2 * paired_std, 1e-6) AS bar FROM one"""
_ENS_COLS = ("best_value", "ensemble_value", "gain", "paired_std", "bar")


def _probe(spark, sf):
    return ensemble.ensemble_probe(v.runs_preds(spark, sf), MEMBERS, known_metric("auc"))


@query("ensemble_gain", ("runs_preds",), ENSEMBLE_SQL, _ENS_COLS)
def ensemble_gain(spark, sf):
    return _probe(spark, sf).drop("verdict")


@query("ensemble_verdict", ("runs_preds",),
       f"""SELECT best_run, CASE WHEN gain > bar THEN 'ensemble_worth_testing' ELSE 'ensemble_unlikely_to_help' END AS verdict
          FROM ({ENSEMBLE_SQL})""")
def ensemble_verdict(spark, sf):
    return _probe(spark, sf).select("best_run", "verdict")


@query("ensemble_members", ("runs",),
       f"""SELECT project_id, run_id, run_id IN (SELECT {v.run_name_sql('o_custkey')} FROM orders) AS has_predictions
          FROM runs WHERE status = 'finished' AND kind IN ('baseline', 'experiment')""")
def ensemble_members(spark, sf):
    from ..operators.history import ensemble_members as members

    with_rows = table(spark, sf, "orders").select(v.run_name(F.col("o_custkey")).alias("run_id"))
    return members(v.runs(spark, sf), with_rows)


