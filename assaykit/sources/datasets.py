"""Reading datasets and predictions, writing exports."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = {".csv": ",", ".tsv": "\t"}
PARQUET = (".parquet", ".pq")


def scan_dataset(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a csv, tsv or parquet dataset by suffix (any case).

    Give a ``schema`` for large text files: without one Spark reads them twice to infer types.
    """
    suffix = os.path.splitext(urlparse(path).path.rstrip("/"))[1].lower()
    if suffix not in (*PARQUET, *SEPARATORS):
        raise ValueError(f"unsupported dataset format '{suffix}' (use csv, tsv, or parquet)")
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        if suffix in PARQUET:
            return reader.parquet(path)
        reader = reader.option("header", True).option("sep", SEPARATORS[suffix])
        return (reader if schema is not None else reader.option("inferSchema", True)).csv(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"dataset not found: {path}") from error
        raise


def with_row_id(df: DataFrame) -> DataFrame:
    """0-based position in the file as ``row_id``, for a dataset kept in one parquet file.

    With several files positions are not unique; such a dataset must bring its own key.
    """
    return df.select("*", F.col("_metadata.row_index").alias("row_id"))


def scan_predictions(spark: SparkSession, root: str) -> DataFrame | None:
    """All runs' predictions below ``root``/run_id=<run>/; None when there are none.

    ``run_id`` comes from the folder name, so a filter on runs prunes whole folders.
    """
    try:
        return spark.read.option("mergeSchema", True).option("basePath", root).parquet(f"{root}/run_id=*")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_predictions(preds: DataFrame, root: str) -> None:
    preds.write.mode("append").partitionBy("run_id").parquet(root)


def write_predictions_csv(preds: DataFrame, path: str) -> None:
    """Text copy of predictions, one file per task, with header."""
    preds.write.mode("overwrite").option("header", True).csv(path)


def file_bytes(df: DataFrame) -> DataFrame:
    """Size in bytes of the files behind a scan."""
    files = df.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")
    ).distinct()
    return files.agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))
