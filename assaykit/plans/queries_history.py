"""Run history (group K), history lookups of group C, and the event stream (group M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as h
from ..session import cut_lineage
from ..streaming import events as stream
from . import views as v
from .catalog import query
from .views import table

# runs with the primary value and direction sign, as SQL
VALUED = """valued AS (SELECT r.*, (metrics->>'$.score')::DOUBLE AS value,
    CASE WHEN direction = 'maximize' THEN 1 ELSE -1 END AS sign FROM runs r JOIN goals USING (project_id)),
  scored AS (SELECT * FROM valued WHERE status = 'finished' AND kind IN ('baseline', 'experiment') AND value IS NOT NULL),
  best AS (SELECT project_id, max(row(value * sign, -seq, seq))[3] AS seq, arg_max(run_id, row(value * sign, -seq)) AS run_id, arg_max(value, row(value * sign, -seq)) AS value
    FROM scored GROUP BY project_id)"""
BASE = ("runs", "goals")


def _valued(spark, sf):
    return h.with_primary_value(v.runs(spark, sf), v.goals(spark, sf))


@query("primary_value", BASE, f"WITH {VALUED} SELECT project_id, run_id, value FROM valued", ("value",))
def primary_value(spark, sf):
    return _valued(spark, sf).select("project_id", "run_id", "value")


@query("best_run", BASE, f"WITH {VALUED} SELECT project_id, run_id, value FROM best", ("value",))
def best_run(spark, sf):
    return h.best_run(_valued(spark, sf))


@query("running_best", BASE,
       f"""WITH {VALUED} SELECT project_id, run_id, value,
            sign * max(value * sign) OVER (PARTITION BY project_id ORDER BY seq) AS best_so_far FROM scored""",
       ("value", "best_so_far"))
def running_best(spark, sf):
    return h.running_best(_valued(spark, sf))


# the streak the long way round: mark improvements against the best before, count after the last
STREAK = f"""{VALUED},
  marked AS (SELECT project_id, seq, value * sign > coalesce(max(value * sign) OVER (PARTITION BY project_id ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-infinity'::DOUBLE) AS better FROM scored),
  last_better AS (SELECT project_id, max(seq) FILTER (better) AS seq FROM marked GROUP BY project_id),
  streaks AS (SELECT g.project_id, count(m.seq) AS streak, forensics_after,
      g.project_id IN (SELECT project_id FROM forensics_log) AS probed
    FROM goals g LEFT JOIN last_better b USING (project_id)
    LEFT JOIN marked m ON m.project_id = g.project_id AND m.seq > b.seq GROUP BY ALL)"""
STREAK_BASE = ("runs", "goals", "forensics_log")


def _streaks(spark, sf):
    return h.stagnation(_valued(spark, sf), v.goals(spark, sf), v.forensics_log(spark, sf))


@query("stagnation_streak", STREAK_BASE,
       f"WITH {STREAK} SELECT project_id, streak, streak >= forensics_after AND NOT probed AS forensics_recommended FROM streaks")
def stagnation_streak(spark, sf):
    return _streaks(spark, sf)


HOURS = """hours AS (SELECT project_id, coalesce(sum(CASE WHEN json_valid(meta) THEN (meta->>'$.train_seconds')::DOUBLE END), 0) / 3600 AS used
  FROM runs GROUP BY project_id)"""


@query("train_budget", BASE,
       f"""WITH {HOURS} SELECT project_id, used AS hours_used, max_train_hours, coalesce(used >= max_train_hours, false) AS exhausted
          FROM goals JOIN hours USING (project_id)""", ("hours_used", "max_train_hours"))
def train_budget(spark, sf):
    return h.train_budget(v.runs(spark, sf), v.goals(spark, sf))


@query("run_budget", BASE,
       """SELECT project_id, max_runs, count(*) AS runs_started, greatest(0, max_runs - count(*)) AS runs_remaining
          FROM goals JOIN runs USING (project_id) GROUP BY 1, 2""")
def run_budget(spark, sf):
    return h.run_budget(v.runs(spark, sf), v.goals(spark, sf))


@query("latest_forensics", ("forensics_log",),
       "SELECT project_id, max(seq) AS seq, arg_max(verdict, seq) AS verdict, arg_max(confidence, seq) AS confidence FROM forensics_log GROUP BY 1")
def latest_forensics(spark, sf):
    return h.latest_forensics(v.forensics_log(spark, sf))


@query("stop_conditions", STREAK_BASE,
       f"""WITH {VALUED}, {HOURS},
          f AS (SELECT project_id, arg_max(verdict, seq) AS verdict, arg_max(confidence, seq) AS confidence FROM forensics_log GROUP BY 1),
          n AS (SELECT project_id, count(*) AS started FROM runs GROUP BY 1),
          c AS (SELECT g.project_id,
            coalesce(CASE WHEN direction = 'maximize' THEN b.value >= target_value ELSE b.value <= target_value END, false) AS target_met,
            coalesce(verdict IN ('no_signal', 'data_limited') AND confidence = 'high', false) AS data_limited,
            coalesce(started >= max_runs, false) OR coalesce(used >= max_train_hours, false) AS budget_exhausted
            FROM goals g LEFT JOIN best b USING (project_id) LEFT JOIN f USING (project_id) LEFT JOIN n USING (project_id) LEFT JOIN hours USING (project_id))
          SELECT *, target_met OR data_limited OR budget_exhausted AS stopping_justified FROM c""")
def stop_conditions(spark, sf):
    return h.stop_conditions(v.runs(spark, sf), v.goals(spark, sf), v.forensics_log(spark, sf))


UNDIAGNOSED = """SELECT project_id, run_id FROM (SELECT project_id, arg_max(run_id, seq) AS run_id FROM runs
  WHERE status = 'finished' AND kind IN ('baseline', 'experiment') GROUP BY 1) WHERE run_id NOT IN (SELECT run_id FROM diagnoses)"""


@query("undiagnosed_runs", ("runs", "diagnoses"), UNDIAGNOSED)
def undiagnosed_runs(spark, sf):
    return h.undiagnosed(v.runs(spark, sf), v.diagnoses(spark, sf))


@query("project_state", ("runs", "goals", "diagnoses"),
       f"""SELECT c_custkey AS project_id, CASE WHEN g.project_id IS NULL THEN 'NEED_GOAL'
            WHEN c_custkey IN (SELECT project_id FROM runs WHERE status = 'running') THEN 'RUN_IN_PROGRESS'
            WHEN c_custkey NOT IN (SELECT project_id FROM runs WHERE status = 'finished' AND kind = 'baseline') THEN 'NEED_BASELINE'
            WHEN enforce_diagnosis AND c_custkey IN (SELECT project_id FROM ({UNDIAGNOSED})) THEN 'DIAGNOSE_PENDING'
            ELSE 'READY' END AS state
          FROM customer LEFT JOIN goals g ON g.project_id = c_custkey""")
def project_state(spark, sf):
    projects = table(spark, sf, "customer").select(F.col("c_custkey").alias("project_id"))
    return h.project_state(projects, v.runs(spark, sf), v.goals(spark, sf), v.diagnoses(spark, sf))


@query("hypothesis_counts", ("hypotheses",),
       "SELECT project_id, status, count(*) AS n FROM hypotheses GROUP BY 1, 2")
def hypothesis_counts(spark, sf):
    return h.hypothesis_counts(v.hypotheses(spark, sf))


@query("run_summary", ("runs", "goals", "diagnoses"),
       f"""WITH {VALUED} SELECT project_id, run_id, kind, status, hypothesis_id, value,
            run_id IN (SELECT run_id FROM diagnoses) AS diagnosed FROM (SELECT * FROM valued ORDER BY seq DESC LIMIT 20)""", ("value",))
def run_summary(spark, sf):
    return h.run_summary(_valued(spark, sf), v.diagnoses(spark, sf))


@query("metric_trajectory", BASE,
       f"WITH {VALUED} SELECT project_id, run_id, row_number() OVER (PARTITION BY project_id ORDER BY seq) AS position, value FROM scored",
       ("value",))
def metric_trajectory(spark, sf):
    return h.metric_trajectory(_valued(spark, sf))


@query("run_noise_floors", ("runs", "diagnoses"),
       """SELECT project_id, run_id, (results->>'$.items.noise_floor.details.min_significant_delta')::DOUBLE AS noise_floor
          FROM runs LEFT JOIN (SELECT run_id, arg_max(results, version) AS results FROM diagnoses GROUP BY 1) USING (run_id)""",
       ("noise_floor",))
def run_noise_floors(spark, sf):
    return h.run_noise_floors(v.runs(spark, sf), v.diagnoses(spark, sf))


PARENTS = """parents AS (SELECT *, coalesce(given_parent, arg_max(run_id, seq) FILTER (status = 'finished') OVER (
    PARTITION BY project_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS parent_run_id FROM runs)"""


@query("default_parent", ("runs",), f"WITH {PARENTS} SELECT project_id, run_id, parent_run_id FROM parents")
def default_parent(spark, sf):
    return h.default_parent(v.runs(spark, sf)).select("project_id", "run_id", "parent_run_id")


@query("run_vs_parent", BASE,
       f"""WITH {VALUED}, {PARENTS} SELECT s.project_id, s.run_id, p.parent_run_id, s.value, q.value AS parent_value,
            s.value - q.value AS delta, (s.value - q.value) * s.sign > 0 AS improved
          FROM scored s JOIN parents p ON p.run_id = s.run_id
          JOIN valued q ON q.run_id = p.parent_run_id AND q.project_id = s.project_id WHERE q.value IS NOT NULL""",
       ("value", "parent_value", "delta"))
def run_vs_parent(spark, sf):
    return h.run_vs_parent(_valued(spark, sf))


@query("run_vs_best", BASE,
       f"""WITH {VALUED}, b AS (SELECT *, arg_max(run_id, row(value * sign, -seq)) OVER w AS best_run_id, arg_max(value, row(value * sign, -seq)) OVER w AS best_value
            FROM scored WINDOW w AS (PARTITION BY project_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
          SELECT project_id, run_id, best_run_id, value, best_value, value - best_value AS delta, (value - best_value) * sign > 0 AS improved
          FROM b WHERE best_run_id IS NOT NULL""", ("value", "best_value", "delta"))
def run_vs_best(spark, sf):
    return h.run_vs_best(_valued(spark, sf))


LINKS = """links AS (SELECT project_id, hypothesis_id, count(e) AS n_evidence,
    count(*) FILTER (e IS NOT NULL AND r.run_id IS NULL) AS n_unknown, count(*) FILTER (r.status <> 'finished') AS n_unfinished,
    bool_or(coalesce(r.hypothesis_id = x.hypothesis_id, false)) AS tested
  FROM (SELECT project_id, hypothesis_id, unnest(evidence_run_ids) AS e FROM hypotheses WHERE status NOT IN ('open', 'testing')) x
  LEFT JOIN (SELECT project_id AS p, run_id, status, hypothesis_id FROM runs) r ON r.run_id = e AND r.p = x.project_id GROUP BY project_id, x.hypothesis_id)"""
LINKS = LINKS.replace("SELECT project_id, hypothesis_id, count(e)", "SELECT project_id, x.hypothesis_id AS hypothesis_id, count(e)")


@query("evidence_links", ("hypotheses", "runs"), f"WITH {LINKS} SELECT * FROM links")
def evidence_links(spark, sf):
    return h.evidence_links(v.hypotheses(spark, sf), v.runs(spark, sf))


@query("context_coverage", ("context_log", "goals"),
       """SELECT project_id, count(DISTINCT feature) AS registered, dataset_columns - 1 AS dataset_features
          FROM goals LEFT JOIN context_log USING (project_id) GROUP BY project_id, dataset_columns""")
def context_coverage(spark, sf):
    return h.context_coverage(v.context_log(spark, sf), v.goals(spark, sf))


@query("suggested_pivots", ("runs", "goals", "forensics_log", "probes"),
       f"""WITH {STREAK}, s AS (SELECT * FROM streaks WHERE streak >= 2)
          SELECT project_id, 'ensemble_probe' AS pivot FROM s WHERE project_id NOT IN (SELECT project_id FROM probes WHERE probe = 'ensemble')
            AND project_id IN (SELECT project_id FROM valued WHERE status = 'finished' AND kind IN ('baseline', 'experiment') GROUP BY 1 HAVING count(*) >= 2)
          UNION ALL SELECT project_id, 'fe_probe' FROM s WHERE project_id NOT IN (SELECT project_id FROM probes WHERE probe = 'fe')
          UNION ALL SELECT project_id, 'different_model_family' FROM s
          UNION ALL SELECT project_id, 'forensics_run' FROM s WHERE NOT probed""")
def suggested_pivots(spark, sf):
    return h.suggested_pivots(_streaks(spark, sf), v.runs(spark, sf), v.probes(spark, sf), v.forensics_log(spark, sf))


_RULES = {
    "run_before_baseline": "kind <> 'baseline' AND NOT had_baseline",
    "second_baseline": "kind = 'baseline' AND had_baseline",
    "baseline_with_hypothesis": "kind = 'baseline' AND hypothesis_id IS NOT NULL",
    "experiment_without_hypothesis": "kind = 'experiment' AND hypothesis_id IS NULL",
    "unknown_hypothesis": """kind = 'experiment' AND hypothesis_id IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM hypotheses x WHERE x.project_id = a.project_id AND x.hypothesis_id = a.hypothesis_id)""",
    "resolved_hypothesis": """kind = 'experiment' AND EXISTS (SELECT 1 FROM hypotheses x WHERE x.project_id = a.project_id
        AND x.hypothesis_id = a.hypothesis_id AND x.resolved_seq < a.seq)""",
    "overlapping_run": "busy_until > created_at",
    "run_budget_exhausted": "started >= max_runs",
    "time_budget_exhausted": "seconds / 3600 >= max_train_hours",
    "previous_not_diagnosed": """kind = 'experiment' AND enforce_diagnosis AND last_scored IS NOT NULL
        AND last_scored NOT IN (SELECT run_id FROM diagnoses)""",
    "unknown_parent": "given_parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM runs x WHERE x.run_id = a.given_parent AND x.project_id = a.project_id)",
    "unfinished_parent": "EXISTS (SELECT 1 FROM runs x WHERE x.run_id = a.given_parent AND x.project_id = a.project_id AND x.status <> 'finished')",
}


@query("protocol_audit", ("runs", "goals", "hypotheses", "diagnoses"),
       f"""WITH {LINKS}, a AS (SELECT r.*, max_runs, enforce_diagnosis, max_train_hours,
            coalesce(bool_or(status = 'finished' AND kind = 'baseline') OVER w, false) AS had_baseline,
            max(coalesce(finished_at, '9999-01-01'::TIMESTAMP)) OVER w AS busy_until,
            count(*) OVER w AS started,
            coalesce(sum(CASE WHEN json_valid(meta) THEN (meta->>'$.train_seconds')::DOUBLE END) OVER w, 0) AS seconds,
            arg_max(run_id, seq) FILTER (status = 'finished' AND kind IN ('baseline', 'experiment')) OVER w AS last_scored
            FROM runs r JOIN goals USING (project_id)
            WINDOW w AS (PARTITION BY project_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
          {" UNION ALL ".join(f"SELECT project_id, run_id, '{rule}' AS rule FROM a WHERE {test}" for rule, test in _RULES.items())}
          UNION ALL SELECT project_id, hypothesis_id::VARCHAR, 'resolution_without_evidence' FROM links
            WHERE n_unknown > 0 OR n_unfinished > 0 OR NOT tested""")
def protocol_audit(spark, sf):
    return h.protocol_audit(v.runs(spark, sf), v.goals(spark, sf), v.hypotheses(spark, sf), v.diagnoses(spark, sf))


# --- M ------------------------------------------------------------------------------------------


@query("stream_event_counts", (),
       """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_event_counts(spark, sf):
    return stream.event_counts(spark, stream.event_files(spark, sf), "1 day").drop("n_late")


@query("stream_stagnation", STREAK_BASE,
       f"""WITH {VALUED}, marked AS (SELECT project_id, seq, value * sign AS good FROM scored)
          SELECT s.project_id, s.value AS best, s.run_id AS best_run_id, count(m.seq) AS streak
          FROM best s LEFT JOIN marked m ON m.project_id = s.project_id AND m.seq > s.seq GROUP BY ALL""", ("best",))
def stream_stagnation(spark, sf):
    goals = cut_lineage(v.goals(spark, sf))

    def finished_runs(batch):
        return h.with_primary_value(v.runs_of(batch), goals)

    return stream.stagnation(spark, stream.event_files(spark, sf), finished_runs)
