"""Event counts and stagnation as streams.

Every micro-batch writes what it adds below the shared folder, under its own number. A batch that is
run again after a failure rewrites its own part, so the outcome is the same as if it had run once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.history import scored
from ..functions.ordering import running_fold
from ..session import scratch_path


@dataclass(frozen=True)
class Source:
    """A folder of event files, read file by file as they appear."""

    path: str
    schema: object
    options: dict


def event_files(spark: SparkSession, sf_dir: str) -> Source:
    """The events table as a stream. The pattern matches that one name only, a file or a folder."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return Source(f"{sf_dir}/event[s].parquet", schema, {"maxFilesPerTrigger": "100"})


def _read(spark: SparkSession, source: Source) -> DataFrame:
    return spark.readStream.schema(source.schema).options(**source.options).parquet(source.path)


def _run(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str, checkpoint: str) -> None:
    query = (
        stream.writeStream.foreachBatch(write).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _write_batches(stream: DataFrame, root: str, part: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """What ``part`` makes of every micro-batch, each below its own number (written again, the same)."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        part(batch).write.mode("overwrite").parquet(f"{root}/batch={number}")

    spark.createDataFrame([], schema).write.parquet(f"{root}/batch=-1")
    _run(stream, write, "append", f"{root}-state")
    return spark.read.option("basePath", root).schema(f"{schema}, batch int").parquet(root)


def event_counts(spark: SparkSession, source: Source, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per kind and tumbling window, and how many of them came late.

    Counts add up, so every batch writes what it adds to its windows, and files may come in any
    order: no event is lost. Events are late if an earlier batch already had one that is more than
    ``late`` younger than the end of their window.
    """
    rows = _read(spark, source).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))
    window = F.window("ts", width)["start"].alias("start")
    newest = F.max("ts").alias("newest")
    parts = _write_batches(
        rows, scratch_path(spark, "event-counts"),
        lambda batch: batch.groupBy(window, "kind").agg(F.count("*").alias("n"), newest),
        "start timestamp, kind string, n bigint, newest timestamp")
    # one row per batch: the youngest event of all batches before it
    seen = parts.where("batch >= 0").groupBy("batch").agg(F.max("newest").alias("newest"))
    before = seen.select("batch", F.max("newest").over(
        Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    passed = F.col("start") + F.expr(f"INTERVAL {width}") + F.expr(f"INTERVAL {late}") <= F.col("before")
    counted = parts.join(F.broadcast(before), "batch").groupBy("start", "kind").agg(
        F.sum("n").alias("n"), F.sum(F.when(passed, F.col("n")).otherwise(0)).alias("n_late"))
    return counted.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "kind", "n", "n_late")


def summarize(valued: DataFrame) -> DataFrame:
    """Best value, its run, and the number of scored runs after it, per project."""
    rows = scored(valued).filter("value is not null").select("project_id", "seq", "run_id", "value", "sign")
    at = running_fold(rows, ["project_id"], "seq", {"_at": ("sum", F.lit(1).cast("bigint"), True)})
    best = F.max(F.struct((F.col("value") * F.col("sign")).alias("good"), (-F.col("seq")).alias("early"), "_at", "value", "run_id")).alias("b")
    return at.groupBy("project_id").agg(best, F.max("_at").alias("n")).select(
        "project_id", F.col("b.value").alias("best"), F.col("b.run_id").alias("best_run_id"), (F.col("n") - F.col("b._at")).alias("streak"))


RUNS = "project_id bigint, seq bigint, run_id string, kind string, status string, value double, sign double"


def stagnation(
    spark: SparkSession, source: Source, finished_runs: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Best run and streak per project, over runs that arrive in batches of any order.

    ``finished_runs`` turns a batch of events into runs with ``value`` and ``sign``. A run that
    arrives late may become the best and change which others count, so the log keeps one narrow row
    per scored run, and the result is read from it.
    """
    columns = [c.split()[0] for c in RUNS.split(", ")]
    log = _write_batches(
        _read(spark, source), scratch_path(spark, "stagnation"),
        lambda batch: scored(finished_runs(batch)).filter("value is not null").select(*columns), RUNS)
    return summarize(log)
