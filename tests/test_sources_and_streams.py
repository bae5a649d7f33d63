import pytest
from pyspark.sql import functions as F

from assaykit.operators import history as h
from assaykit.plans import views as v
from assaykit.session import scratch_path
from assaykit.sources import datasets, eventlog
from assaykit.streaming import events as stream


def test_datasets_by_suffix(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "n int, t string")
    for name, sep in (("x.csv", ","), ("x.TSV", "\t")):
        d.coalesce(1).write.option("header", True).option("sep", sep).csv(str(tmp_path / name))
        assert sorted(datasets.scan_dataset(spark, str(tmp_path / name)).collect()) == sorted(d.collect())
    d.write.parquet(str(tmp_path / "x.pq"))
    assert datasets.scan_dataset(spark, str(tmp_path / "x.pq")).count() == 2
    with pytest.raises(ValueError, match="unsupported"):
        datasets.scan_dataset(spark, "x.json")
    with pytest.raises(FileNotFoundError):
        datasets.scan_dataset(spark, str(tmp_path / "gone.csv"))
    assert datasets.scan_predictions(spark, str(tmp_path / "none")) is None


def test_row_id_is_the_file_position(spark, sf):
    rows = datasets.with_row_id(spark.read.parquet(f"{sf}/orders.parquet"))
    n = rows.count()
    assert rows.agg(F.countDistinct("row_id"), F.min("row_id"), F.max("row_id")).first()[:] == (n, 0, n - 1)
    size = datasets.file_bytes(spark.read.parquet(f"{sf}/orders.parquet")).first()
    assert size["n_files"] == 1 and size["bytes"] > 0


def test_runs_with_other_columns_are_merged(spark, tmp_path):
    root = str(tmp_path / "runs")
    a = spark.createDataFrame([("a", 1, 0.5)], "run_id string, row_id bigint, proba_1 double")
    b = spark.createDataFrame([("b", 1, 2.0)], "run_id string, row_id bigint, weight double")
    datasets.write_predictions(a, root)
    datasets.write_predictions(b, root)
    got = {r["run_id"]: (r["proba_1"], r["weight"]) for r in datasets.scan_predictions(spark, root).collect()}
    assert got == {"a": (0.5, None), "b": (None, 2.0)}


def test_upsert_keeps_the_first_creation(spark):
    base = spark.createDataFrame([("f", 1, 1, "old"), ("g", 2, 2, "g")], "feature string, created int, updated int, meaning string")
    new = spark.createDataFrame([("f", 9, 9, "new"), ("h", 9, 9, "h")], base.schema)
    got = sorted(tuple(r) for r in eventlog.upsert(base, new, ["feature"], "created", "updated").collect())
    assert got == [("f", 1, 9, "new"), ("g", 2, 2, "g"), ("h", 9, 9, "h")]


def test_history_does_not_depend_on_chunks(spark, sf):
    valued = h.with_primary_value(v.runs(spark, sf), v.goals(spark, sf))
    goals, log = v.goals(spark, sf), v.forensics_log(spark, sf)
    text = lambda df: sorted(map(str, df.collect()))
    for fn in (lambda n: h.running_best(valued, n), lambda n: h.run_vs_best(valued, n), lambda n: h.run_vs_parent(valued, n),
               lambda n: h.stagnation(valued, goals, log, n),
               lambda n: h.protocol_audit(v.runs(spark, sf), goals, v.hypotheses(spark, sf), v.diagnoses(spark, sf), n)):
        assert text(fn(10**6)) == text(fn(90))


def test_one_project_with_nearly_all_runs(spark, sf):
    runs = v.runs(spark, sf).withColumn("project_id", F.when(F.col("project_id") < 12, F.col("project_id")).otherwise(2))
    goals = v.goals(spark, sf).filter("project_id < 12")
    valued = h.with_primary_value(runs, goals)
    assert sorted(map(str, h.running_best(valued, 60).collect())) == sorted(map(str, h.running_best(valued).collect()))


def test_streams_over_several_files_equal_the_batch(spark, sf):
    path = scratch_path(spark, "stream-input")
    events = spark.read.parquet(f"{sf}/events.parquet")
    n = events.count()
    for i in range(3):
        part = events.filter((F.col("event_id") >= n * i // 3) & (F.col("event_id") < n * (i + 1) // 3))
        part.coalesce(1).write.mode("append").parquet(path)
    source = stream.Source(path, events.schema, {"maxFilesPerTrigger": "1"})
    counts = {(r["day"], r["kind"]): r["n"] for r in stream.event_counts(spark, source).collect()}
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    want = {(r["day"], r["event_type"]): r["count"] for r in events.groupBy(day, "event_type").count().collect()}
    assert counts == want
    goals, log = v.goals(spark, sf), v.forensics_log(spark, sf)
    state = stream.stagnation(spark, source, lambda batch: h.with_primary_value(v.runs_of(batch), goals))
    got = {r["project_id"]: (r["best_run_id"], r["streak"]) for r in state.collect()}
    valued = h.with_primary_value(v.runs(spark, sf), goals)
    streaks = {r["project_id"]: r["streak"] for r in h.stagnation(valued, goals, log).collect()}
    best = {r["project_id"]: r["run_id"] for r in h.best_run(valued).collect()}
    assert got == {p: (best[p], streaks[p]) for p in best}
