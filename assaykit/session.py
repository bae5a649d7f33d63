"""Session helpers: a local session for tests and benches, and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "assaykit", memory: str = "12g") -> SparkSession:
    """Small single-machine session. On a cluster, pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset in a local session
    (tests on one machine, whose executors are the driver) a temporary folder is made, once per session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured is None:
        configured = sc.getCheckpointDir()
    if configured is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        configured = tempfile.mkdtemp(prefix="assaykit-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver's session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _MARKED.append(place)
    return path


_MARKED: list = []


def _remove_scratch() -> None:
    """Deletes what this driver's session has written to the shared folder."""
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    if context is None:
        return
    with suppress(Py4JError, OSError):  # the JVM may be gone at exit
        conf = context._jsc.hadoopConfiguration()
        while _MARKED:
            place = _MARKED.pop()
            place.getFileSystem(conf).delete(place, True)


atexit.register(_remove_scratch)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder, so that later passes read it back from there.

    Used where several jobs read the same expensive rows: a lost executor then costs a re-read,
    not a re-computation. Parquet, so that later passes still read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "rows")
    df.write.parquet(path)
    # for drivers that stop the session themselves: the JVM removes it when it ends
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
