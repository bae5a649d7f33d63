"""Registry of queries: key -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .views import with_views

DIGITS = 6


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Entry] = {}


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles and widen integers, so that results compare across engines."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # adding zero turns -0.0 into 0.0
            out.append((F.round(F.col(f.name).cast("double"), digits) + 0.0).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def finish_sql(body: str, doubles: tuple[str, ...]) -> str:
    """Round the named double columns of a query the same way as ``rounded``."""
    if not doubles:
        return f"SELECT * FROM ({body.strip()})"
    swaps = ", ".join(f"round({c}::DOUBLE, {DIGITS}) + 0.0 AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({swaps}) FROM ({body.strip()})"


def query(key: str, views: tuple[str, ...] = (), sql: str | None = None, doubles: tuple[str, ...] = ()):
    """Register a query. ``sql`` may use the named views as tables."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        CATALOG[key] = Entry(run, with_views(views, finish_sql(sql, doubles)) if sql else None)
        return fn

    return register


def load() -> dict[str, Entry]:
    """Import every query module, so that all keys are registered."""
    from . import (  # noqa: F401
        queries_dataset,
        queries_diagnose,
        queries_history,
        queries_metrics,
        queries_probe,
        queries_resample,
    )

    return CATALOG
