"""Input shapes derived from the given tables, as DataFrames and as SQL text.

Each view is written twice on purpose: the DataFrame is what the queries read, the SQL is what the
oracle reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import uniform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One that is read in fewer pieces than there are cores (a small single file)
    is dealt out first; a large table is read as it is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def u(key: str, salt: str):
    return uniform(F.col(key), salt)


def h_sql(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {key}, '{salt}')), 1, 8))::BIGINT)"


def u_sql(key: str, salt: str) -> str:
    return f"({h_sql(key, salt)}::DOUBLE / 4294967296.0)"


View = Callable[[SparkSession, str], DataFrame]
SQL: dict[str, tuple[str, tuple[str, ...]]] = {}


def with_views(names: tuple[str, ...], body: str) -> str:
    """``body`` behind a WITH clause holding the named views and those they read."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for needed in SQL[name][1]:
            add(needed)
        order.append(name)

    for name in names:
        add(name)
    views = ",\n".join(f"{n} AS ({SQL[n][0]})" for n in order)
    body = body.strip()
    if not views:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


# --- predictions --------------------------------------------------------------------------------


def preds_cls(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    y = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("bigint")
    out = o.select(F.col("o_orderkey").alias("row_id"), y.alias("y_true"), F.col("o_totalprice").alias("weight"))
    out = out.withColumn("proba_1", F.round(0.6 * u("row_id", "p") + 0.1 + 0.2 * F.col("y_true"), 3))
    return out.withColumn("y_pred", (F.col("proba_1") >= 0.5).cast("bigint"))


SQL["preds_cls"] = (
    f"""SELECT *, (proba_1 >= 0.5)::BIGINT AS y_pred FROM (
  SELECT *, round(0.6 * {u_sql('row_id', 'p')} + 0.1 + 0.2 * y_true, 3) AS proba_1 FROM (
    SELECT o_orderkey AS row_id, (o_orderstatus = 'F')::BIGINT AS y_true, o_totalprice AS weight FROM orders))""",
    (),
)


def preds_const(spark, sf_dir):
    return preds_cls(spark, sf_dir).withColumn("proba_1", F.lit(0.5))


SQL["preds_const"] = ("SELECT row_id, y_true, y_pred, weight, 0.5::DOUBLE AS proba_1 FROM preds_cls", ("preds_cls",))


def preds_slice(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderpriority")
    flip = (F.col("o_orderpriority") == "1-URGENT") & (u("row_id", "s") < 0.5)
    wrong = F.when(flip, 1 - F.col("y_true")).otherwise(F.col("y_pred"))
    return preds_cls(spark, sf_dir).join(o, "row_id").withColumn("y_pred", wrong).drop("o_orderpriority")


SQL["preds_slice"] = (
    f"""SELECT p.row_id, p.y_true, p.weight, p.proba_1,
  CASE WHEN o_orderpriority = '1-URGENT' AND {u_sql('p.row_id', 's')} < 0.5 THEN 1 - p.y_true ELSE p.y_pred END AS y_pred
  FROM preds_cls p JOIN orders o ON o.o_orderkey = p.row_id""",
    ("preds_cls",),
)


def preds_multi(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = F.col("o_orderstatus")
    nxt = F.when(s == "F", "O").when(s == "O", "P").otherwise("F")
    return o.select(
        F.col("o_orderkey").alias("row_id"), s.alias("y_true"),
        F.when(u("o_orderkey", "m") < 0.2, nxt).otherwise(s).alias("y_pred"),
    )


SQL["preds_multi"] = (
    f"""SELECT o_orderkey AS row_id, o_orderstatus AS y_true,
  CASE WHEN {u_sql('o_orderkey', 'm')} < 0.2
       THEN CASE o_orderstatus WHEN 'F' THEN 'O' WHEN 'O' THEN 'P' ELSE 'F' END
       ELSE o_orderstatus END AS y_pred FROM orders""",
    (),
)


def preds_reg(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    y = F.col("o_totalprice")
    return o.select(
        F.col("o_orderkey").alias("row_id"), y.alias("y_true"),
        (y * (0.9 + 0.2 * u("o_orderkey", "r"))).alias("y_pred"),
    )


SQL["preds_reg"] = (
    f"""SELECT o_orderkey AS row_id, o_totalprice AS y_true,
  o_totalprice * (0.9 + 0.2 * {u_sql('o_orderkey', 'r')}) AS y_pred FROM orders""",
    (),
)


RUNS = ("R1", "R2", "R3", "R4")


def runs_preds(spark, sf_dir):
    """Four runs: R1 and R2 with independent noise, R3 with R1's noise and more signal, R4 a near
    copy of R3 on four fifths of the rows."""
    base = preds_cls(spark, sf_dir).select("row_id", "y_true", "weight")
    y = F.col("y_true")
    strong = F.round(0.05 + 0.35 * y + 0.6 * u("row_id", "p"), 3)
    member = lambda run, p, keep: F.struct(F.lit(run).alias("run_id"), p.alias("proba_1"), keep.alias("keep"))
    members = F.array(
        member("R1", F.round(0.6 * u("row_id", "p") + 0.1 + 0.2 * y, 3), F.lit(True)),
        member("R2", F.round(0.6 * u("row_id", "q") + 0.1 + 0.2 * y, 3), F.lit(True)),
        member("R3", strong, F.lit(True)),
        member("R4", F.round(F.when(u("row_id", "t") < 0.1, strong - 0.04).otherwise(strong), 3),
               u("row_id", "h") < 0.8),
    )
    long = base.select("row_id", "y_true", "weight", F.explode(members).alias("m")).filter("m.keep")
    return long.select(
        "m.run_id", "row_id", "y_true", "weight", "m.proba_1", (F.col("m.proba_1") >= 0.5).cast("bigint").alias("y_pred")
    )


_STRONG = f"round(0.05 + 0.35 * y_true + 0.6 * {u_sql('row_id', 'p')}, 3)"
SQL["runs_preds"] = (
    f"""SELECT run_id, row_id, y_true, weight, proba_1, (proba_1 >= 0.5)::BIGINT AS y_pred FROM (
  SELECT 'R1' AS run_id, row_id, y_true, weight, round(0.6 * {u_sql('row_id', 'p')} + 0.1 + 0.2 * y_true, 3) AS proba_1 FROM preds_cls
  UNION ALL SELECT 'R2', row_id, y_true, weight, round(0.6 * {u_sql('row_id', 'q')} + 0.1 + 0.2 * y_true, 3) FROM preds_cls
  UNION ALL SELECT 'R3', row_id, y_true, weight, {_STRONG} FROM preds_cls
  UNION ALL SELECT 'R4', row_id, y_true, weight,
    round(CASE WHEN {u_sql('row_id', 't')} < 0.1 THEN {_STRONG} - 0.04 ELSE {_STRONG} END, 3)
    FROM preds_cls WHERE {u_sql('row_id', 'h')} < 0.8)""",
    ("preds_cls",),
)


# --- datasets -----------------------------------------------------------------------------------


def feat(spark, sf_dir):
    """orders with customer attributes; about 5 % of two columns missing."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return (
        o.join(c, o.o_custkey == c.c_custkey).select(
            F.col("o_orderkey").alias("row_id"),
            F.when(u("o_orderkey", "n1") >= 0.05, F.col("o_totalprice")).alias("total_price"),
            F.col("o_orderpriority").alias("priority"),
            F.when(u("o_orderkey", "n2") >= 0.05, F.col("c_mktsegment")).alias("segment"),
            F.col("c_nationkey").cast("bigint").alias("nation"),
            F.month("o_orderdate").cast("bigint").alias("month"),
            F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("bigint").alias("target"),
        )
    )


FEATURES = ("total_price", "priority", "segment", "nation", "month")
SQL["feat"] = (
    f"""SELECT o_orderkey AS row_id,
  CASE WHEN {u_sql('o_orderkey', 'n1')} >= 0.05 THEN o_totalprice END AS total_price,
  o_orderpriority AS priority,
  CASE WHEN {u_sql('o_orderkey', 'n2')} >= 0.05 THEN c_mktsegment END AS segment,
  c_nationkey::BIGINT AS nation, month(o_orderdate)::BIGINT AS month, (o_orderstatus = 'F')::BIGINT AS target
  FROM orders JOIN customer ON o_custkey = c_custkey""",
    (),
)


def meanings(spark, sf_dir):
    """Registered feature meanings: one per feature, taken from the nations' region names."""
    n = table(spark, sf_dir, "region")
    name = F.element_at(F.array(*[F.lit(c) for c in FEATURES]), (F.col("r_regionkey") + 1).cast("int"))
    return n.filter(F.col("r_regionkey") < len(FEATURES)).select(
        name.alias("feature"), F.concat(F.lit("kept by "), F.col("r_name")).alias("meaning")
    )


SQL["meanings"] = (
    f"""SELECT list_extract([{", ".join(f"'{c}'" for c in FEATURES)}], r_regionkey::INT + 1) AS feature,
  'kept by ' || r_name AS meaning FROM region WHERE r_regionkey < {len(FEATURES)}""",
    (),
)


def noisy(spark, sf_dir):
    """Two uniform features, label x1 + x2 > 1, a fifth of the labels flipped."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    d = o.select("row_id", u("row_id", "a").alias("x1"), u("row_id", "b").alias("x2"))
    clean = (F.col("x1") + F.col("x2") > 1).cast("bigint")
    return d.withColumn("y0", clean).withColumn(
        "y", F.when(u("row_id", "c") < 0.2, 1 - F.col("y0")).otherwise(F.col("y0"))
    )


SQL["noisy"] = (
    f"""SELECT *, CASE WHEN {u_sql('row_id', 'c')} < 0.2 THEN 1 - y0 ELSE y0 END AS y FROM (
  SELECT *, (x1 + x2 > 1)::BIGINT AS y0 FROM (
    SELECT o_orderkey AS row_id, {u_sql('o_orderkey', 'a')} AS x1, {u_sql('o_orderkey', 'b')} AS x2 FROM orders))""",
    (),
)


def nosignal(spark, sf_dir):
    return noisy(spark, sf_dir).select(
        "row_id", "x1", "x2", (u("row_id", "d") < 0.5).cast("bigint").alias("y")
    )


SQL["nosignal"] = (f"SELECT row_id, x1, x2, ({u_sql('row_id', 'd')} < 0.5)::BIGINT AS y FROM noisy", ("noisy",))


def number_target(spark, sf_dir):
    """Two uniform features and a noisy number that depends on both."""
    d = noisy(spark, sf_dir).select("row_id", "x1", "x2")
    return d.withColumn("y", 3 * F.col("x1") - 2 * F.col("x2") * F.col("x2") + u("row_id", "e"))


SQL["number_target"] = (
    f"SELECT row_id, x1, x2, 3 * x1 - 2 * x2 * x2 + {u_sql('row_id', 'e')} AS y FROM noisy", ("noisy",))


def ratio(spark, sf_dir):
    """Six log-uniform features, label x1 / x2 > 1."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    xs = [F.exp(6 * u("row_id", f"x{i}") - 3).alias(f"x{i}") for i in range(1, 7)]
    return o.select("row_id", *xs).withColumn("y", (F.col("x1") / F.col("x2") > 1).cast("bigint"))


SQL["ratio"] = (
    "SELECT *, (x1 / x2 > 1)::BIGINT AS y FROM (SELECT o_orderkey AS row_id, "
    + ", ".join(f"exp(6 * {u_sql('o_orderkey', f'x{i}')} - 3) AS x{i}" for i in range(1, 7))
    + " FROM orders)",
    (),
)


DUP_FEATURES = ("quantity", "discount", "tax", "returnflag")


def dups(spark, sf_dir):
    """lineitem without its keys: many rows share all features."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("label"),
        F.col("l_extendedprice").alias("price"),
    )


SQL["dups"] = (
    """SELECT l_quantity AS quantity, l_discount AS discount, l_tax AS tax, l_returnflag AS returnflag,
  l_linestatus AS label, l_extendedprice AS price FROM lineitem""",
    (),
)


def quality(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id").withColumnRenamed("doc_id", "row_id")


SQL["quality"] = (
    "SELECT d.doc_id AS row_id, lang, source, n_chars, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    (),
)


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding", F.col("label").alias("y"))


SQL["vectors"] = ("SELECT vec_id AS row_id, embedding, label AS y FROM embeddings", ())


# --- run history --------------------------------------------------------------------------------

# One event is one run: project = user, sequence number = event id. The number in props decides
# status, gaps and links, so that every rule of the audit is both kept and broken somewhere.


def _k():
    return F.get_json_object("props", "$.k").cast("bigint")


def run_name(number):
    """Run ids are text that does not sort like the runs' order."""
    return F.concat(F.lit("r"), F.substring(F.md5(number.cast("string")), 1, 10))


def run_name_sql(number: str) -> str:
    return f"('r' || substr(md5(({number})::VARCHAR), 1, 10))"


def runs(spark, sf_dir):
    return runs_of(table(spark, sf_dir, "events"))


def runs_of(events: DataFrame) -> DataFrame:
    e = events.withColumn("k", _k())
    t = F.col("event_type")
    kind = F.when(t == "signup", "baseline").when(t == "error", "forensics").otherwise("experiment")
    status = F.when(F.col("k") % 33 == 1, "running").when(F.col("k") % 10 == 0, "abandoned").otherwise("finished")
    e = e.withColumn("kind", kind).withColumn("status", status)
    hyp = F.when((F.col("kind") == "experiment") & (F.col("k") % 11 != 0), F.col("event_id") % 5)
    hyp = F.when((F.col("kind") == "baseline") & (F.col("k") % 19 == 0), F.lit(0)).otherwise(hyp).cast("bigint")
    text = F.col("value").cast("string")
    metrics = F.when(F.col("k") % 7 != 0, F.concat(
        F.lit('{"score": '), text, F.lit(', "train_score": '), (F.col("value") + F.col("k") / 1000).cast("string"), F.lit("}")))
    meta = (
        F.when(F.col("k") % 13 == 0, F.lit("{not json"))
        .when(F.col("k") % 17 == 0, F.lit("[1, 2]"))
        .otherwise(F.concat(
            F.lit('{"model_desc": "m'), F.col("k").cast("string"), F.lit('"'),
            F.when(F.col("k") % 11 == 0, F.lit(', "hyperparams": [1]')).otherwise(F.concat(F.lit(', "hyperparams": {"k": '), F.col("k").cast("string"), F.lit("}"))),
            F.when(F.col("k") % 7 == 0, F.lit("")).otherwise(F.lit(', "features": ["a", "b"]')),
            F.when(F.col("k") % 5 == 0, F.lit(', "seed": "7"')).otherwise(F.concat(F.lit(', "seed": '), F.col("k").cast("string"))),
            F.when(F.col("k") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(', "train_seconds": '), text)),
            F.when(F.col("k") % 2 == 0, F.lit(', "feature_importance": {"a": 1}')).otherwise(F.lit("")),
            F.lit("}")))
    )
    finished = F.when(F.col("status") != "running", F.col("ts") + F.make_dt_interval(mins=F.col("k").cast("int")))
    parent = F.when(F.col("k") % 5 == 0, run_name(F.col("event_id") - F.col("k") - 1))
    return e.select(
        F.col("user_id").alias("project_id"), F.col("event_id").alias("seq"), run_name(F.col("event_id")).alias("run_id"),
        F.col("ts").alias("created_at"), finished.alias("finished_at"), parent.alias("given_parent"),
        hyp.alias("hypothesis_id"), "kind", "status", metrics.alias("metrics"), meta.alias("meta"), "k",
    )


SQL["runs"] = (
    f"""SELECT project_id, seq, run_id, created_at,
  CASE WHEN status <> 'running' THEN created_at + to_minutes(k) END AS finished_at,
  CASE WHEN k % 5 = 0 THEN {run_name_sql('seq - k - 1')} END AS given_parent,
  (CASE WHEN kind = 'baseline' AND k % 19 = 0 THEN 0 WHEN kind = 'experiment' AND k % 11 <> 0 THEN seq % 5 END)::BIGINT AS hypothesis_id,
  kind, status,
  CASE WHEN k % 7 <> 0 THEN '{{"score": ' || value::VARCHAR || ', "train_score": ' || (value + k / 1000.0::DOUBLE)::VARCHAR || '}}' END AS metrics,
  CASE WHEN k % 13 = 0 THEN '{{not json' WHEN k % 17 = 0 THEN '[1, 2]' ELSE
    '{{"model_desc": "m' || k || '"' ||
    CASE WHEN k % 11 = 0 THEN ', "hyperparams": [1]' ELSE ', "hyperparams": {{"k": ' || k || '}}' END ||
    CASE WHEN k % 7 = 0 THEN '' ELSE ', "features": ["a", "b"]' END ||
    CASE WHEN k % 5 = 0 THEN ', "seed": "7"' ELSE ', "seed": ' || k END ||
    CASE WHEN k % 3 = 0 THEN '' ELSE ', "train_seconds": ' || value::VARCHAR END ||
    CASE WHEN k % 2 = 0 THEN ', "feature_importance": {{"a": 1}}' ELSE '' END || '}}' END AS meta, k
  FROM (SELECT user_id AS project_id, event_id AS seq, {run_name_sql('event_id')} AS run_id, ts AS created_at, value,
    (props->>'$.k')::BIGINT AS k,
    CASE event_type WHEN 'signup' THEN 'baseline' WHEN 'error' THEN 'forensics' ELSE 'experiment' END AS kind,
    CASE WHEN (props->>'$.k')::BIGINT % 33 = 1 THEN 'running' WHEN (props->>'$.k')::BIGINT % 10 = 0 THEN 'abandoned' ELSE 'finished' END AS status
    FROM events)""",
    (),
)


def goals(spark, sf_dir):
    """One goal per project; even projects maximise."""
    p = table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id")).distinct()
    pid = F.col("project_id")
    return p.select(
        "project_id", F.lit("score").alias("primary_metric"),
        F.when(pid % 2 == 0, "maximize").otherwise("minimize").alias("direction"),
        F.when(pid % 3 == 0, F.lit(150.0)).when(pid % 3 == 1, F.lit(5.0)).alias("target_value"),
        F.when(pid % 4 == 0, F.lit(90)).otherwise(F.lit(30)).cast("bigint").alias("max_runs"),
        F.when(pid % 5 == 0, F.lit(0.4)).alias("max_train_hours"),
        (pid % 7 != 0).alias("enforce_diagnosis"), F.lit(3).cast("bigint").alias("forensics_after"),
        F.lit(6).cast("bigint").alias("dataset_columns"),
    )


SQL["goals"] = (
    """SELECT project_id, 'score' AS primary_metric,
  CASE WHEN project_id % 2 = 0 THEN 'maximize' ELSE 'minimize' END AS direction,
  CASE WHEN project_id % 3 = 0 THEN 150.0::DOUBLE WHEN project_id % 3 = 1 THEN 5.0::DOUBLE END AS target_value,
  (CASE WHEN project_id % 4 = 0 THEN 90 ELSE 30 END)::BIGINT AS max_runs,
  CASE WHEN project_id % 5 = 0 THEN 0.4::DOUBLE END AS max_train_hours,
  project_id % 7 <> 0 AS enforce_diagnosis, 3::BIGINT AS forensics_after, 6::BIGINT AS dataset_columns
  FROM (SELECT DISTINCT user_id AS project_id FROM events)""",
    (),
)


def hypotheses(spark, sf_dir):
    """Per project hypotheses 0..3 (4 stays unknown), with first and last event as evidence."""
    e = table(spark, sf_dir, "events").withColumn("h", F.col("event_id") % 5).filter("h < 4")
    g = e.groupBy(F.col("user_id").alias("project_id"), F.col("h").alias("hypothesis_id")).agg(
        F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
    code = (F.col("project_id") + F.col("hypothesis_id")) % 5
    status = (
        F.when(code == 0, "open").when(code == 1, "testing").when(code == 2, "confirmed")
        .when(code == 3, "refuted").otherwise("inconclusive")
    )
    evidence = F.when(code == 3, F.array(run_name(F.col("first_id")), F.lit("unknown"))).when(
        code == 4, F.array(run_name(F.col("first_id") + 1))).otherwise(F.array(run_name(F.col("first_id")), run_name(F.col("last_id"))))
    return g.withColumn("status", status).select(
        "project_id", "hypothesis_id", "status",
        F.when(code >= 2, evidence).otherwise(F.array().cast("array<string>")).alias("evidence_run_ids"),
        F.when(code >= 2, F.col("last_id") - 50).alias("resolved_seq"),
    )


SQL["hypotheses"] = (
    f"""SELECT project_id, hypothesis_id,
  CASE code WHEN 0 THEN 'open' WHEN 1 THEN 'testing' WHEN 2 THEN 'confirmed' WHEN 3 THEN 'refuted' ELSE 'inconclusive' END AS status,
  CASE WHEN code = 3 THEN [{run_name_sql('first_id')}, 'unknown'] WHEN code = 4 THEN [{run_name_sql('first_id + 1')}] WHEN code = 2 THEN [{run_name_sql('first_id')}, {run_name_sql('last_id')}] ELSE [] END AS evidence_run_ids,
  CASE WHEN code >= 2 THEN last_id - 50 END AS resolved_seq
  FROM (SELECT *, (project_id + hypothesis_id) % 5 AS code FROM (
    SELECT user_id AS project_id, event_id % 5 AS hypothesis_id, min(event_id) AS first_id, max(event_id) AS last_id
    FROM events WHERE event_id % 5 < 4 GROUP BY ALL))""",
    (),
)


def diagnoses(spark, sf_dir):
    """Stored diagnoses as versions: seq of writing, run, JSON result; some runs have two."""
    e = table(spark, sf_dir, "events").withColumn("k", _k()).filter("k % 3 <> 0")
    versions = F.when(F.col("k") % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    floor = F.concat(
        F.lit('{"items": {"noise_floor": {"details": {"min_significant_delta": '),
        (F.col("value") / 100 + F.col("version")).cast("string"), F.lit("}}}}"))
    empty = F.lit('{"items": {"noise_floor": {"details": {}}}}')
    return e.withColumn("version", F.explode(versions)).select(
        F.col("user_id").alias("project_id"), run_name(F.col("event_id")).alias("run_id"),
        F.col("version").cast("bigint").alias("version"),
        F.when(F.col("k") % 5 == 0, empty).otherwise(floor).alias("results"),
    )


SQL["diagnoses"] = (
    f"""SELECT user_id AS project_id, {run_name_sql('event_id')} AS run_id, version::BIGINT AS version,
  CASE WHEN k % 5 = 0 THEN '{{"items": {{"noise_floor": {{"details": {{}}}}}}}}'
       ELSE '{{"items": {{"noise_floor": {{"details": {{"min_significant_delta": ' || (value / 100 + version)::VARCHAR || '}}}}}}}}' END AS results
  FROM (SELECT *, unnest(CASE WHEN k % 4 = 0 THEN [1, 2] ELSE [1] END) AS version
    FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events) WHERE k % 3 <> 0)""",
    (),
)


def forensics_log(spark, sf_dir):
    """Stored verdicts: one per abandoned forensics-type event."""
    e = table(spark, sf_dir, "events").withColumn("k", _k()).filter((F.col("event_type") == "error") & (F.col("k") % 8 == 0))
    code = F.col("event_id") % 4
    return e.filter("user_id % 3 <> 1").select(
        F.col("user_id").alias("project_id"), F.col("event_id").alias("seq"),
        F.when(code == 0, "no_signal").when(code == 1, "data_limited").when(code == 2, "more_data_needed")
        .otherwise("model_limited").alias("verdict"),
        F.when(F.col("k") % 16 == 0, "high").otherwise("medium").alias("confidence"),
    )


SQL["forensics_log"] = (
    """SELECT user_id AS project_id, event_id AS seq,
  CASE event_id % 4 WHEN 0 THEN 'no_signal' WHEN 1 THEN 'data_limited' WHEN 2 THEN 'more_data_needed' ELSE 'model_limited' END AS verdict,
  CASE WHEN k % 16 = 0 THEN 'high' ELSE 'medium' END AS confidence
  FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)
  WHERE event_type = 'error' AND k % 8 = 0 AND user_id % 3 <> 1""",
    (),
)


def probes(spark, sf_dir):
    """Which probe a project has stored: (project, probe)."""
    e = table(spark, sf_dir, "events").withColumn("k", _k())
    ens = e.filter("k = 50 and event_type = 'view'").select(F.col("user_id").alias("project_id"), F.lit("ensemble").alias("probe"))
    fe = e.filter("k = 60 and event_type = 'click'").select(F.col("user_id").alias("project_id"), F.lit("fe").alias("probe"))
    return ens.unionByName(fe)


SQL["probes"] = (
    """SELECT user_id AS project_id, 'ensemble' AS probe FROM events WHERE (props->>'$.k')::BIGINT = 50 AND event_type = 'view'
  UNION ALL SELECT user_id, 'fe' FROM events WHERE (props->>'$.k')::BIGINT = 60 AND event_type = 'click'""",
    (),
)


def context_log(spark, sf_dir):
    """Feature meanings as written over time: (project, feature, seq, meaning)."""
    e = table(spark, sf_dir, "events").withColumn("k", _k()).filter("event_type = 'view'")
    return e.select(
        F.col("user_id").alias("project_id"), F.concat(F.lit("f"), (F.col("k") % 8).cast("string")).alias("feature"),
        F.col("event_id").alias("seq"), F.concat(F.lit("meaning "), F.col("k").cast("string")).alias("meaning"),
    )


SQL["context_log"] = (
    """SELECT user_id AS project_id, 'f' || ((props->>'$.k')::BIGINT % 8) AS feature, event_id AS seq,
  'meaning ' || ((props->>'$.k')::BIGINT) AS meaning FROM events WHERE event_type = 'view'""",
    (),
)

