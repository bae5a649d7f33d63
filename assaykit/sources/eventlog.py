"""The append-only event log, and tables that keep one current row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG_SCHEMA = "seq bigint, ts timestamp, kind string, payload string"


def append_events(events: DataFrame, path: str) -> None:
    """Append (seq, ts, kind, payload) as JSON lines."""
    events.select("seq", "ts", "kind", "payload").write.mode("append").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)


def merged_events(events: DataFrame) -> DataFrame:
    """seq and ``fields``: everything in the payload, with ts and kind beside it (these win over equal names)."""
    payload = F.coalesce(F.from_json("payload", "map<string,string>"), F.create_map().cast("map<string,string>"))
    own = F.create_map(F.lit("ts"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("kind"), F.col("kind"))
    rest = F.map_filter(payload, lambda name, _: ~name.isin("ts", "kind"))
    return events.select("seq", F.map_concat(rest, own).alias("fields"))


def latest_events(events: DataFrame, limit: int = 20) -> DataFrame:
    """The last ``limit`` events, oldest first (a distributed top-n, not a full sort)."""
    return events.orderBy(F.desc("seq")).limit(limit).orderBy("seq")


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str], created: str, updated: str) -> DataFrame:
    """New version of a keyed table: updated rows replace, and keep the first ``created`` value.

    Base rows and updates go through one grouped aggregation per key, newest by ``updated``; a key
    that is rewritten very often is combined map-side first.
    """
    rest = [c for c in base.columns if c not in (*keys, created)]
    newest = F.max_by(F.struct(*rest), F.col(updated)).alias("_new")
    both = base.unionByName(updates)
    return both.groupBy(*keys).agg(F.min(created).alias(created), newest).select(*keys, created, "_new.*")


def latest_version(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row with the highest version per key; only one candidate per key and task is shuffled."""
    order = Window.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
