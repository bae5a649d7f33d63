"""Simple encodings: median fill, indicators, target codes, bins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import lookup_join
from ..functions.ordering import exact_quantiles
from .diagnose import as_text, distinct_up_to, is_number

MAX_LEVELS = 15
MAX_CLASSES = 10_000
BINS = 16


def _clean(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def impute_median(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Fill missing numbers with the exact column median; all-missing columns are dropped and named."""
    cleaned = df.withColumns({c: _clean(c) for c in columns})
    medians = {c: q[0] for c, q in exact_quantiles(cleaned, {c: [0.5] for c in columns}).items()}
    empty = [c for c in columns if medians[c] is None]
    filled = cleaned.withColumns({c: F.coalesce(c, F.lit(m)) for c, m in medians.items() if m is not None})
    return filled.drop(*empty), empty


def text_levels(df: DataFrame, columns: Sequence[str], limit: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Sorted values of the columns that have at most ``limit``, missing counted as ``nan``."""
    if not columns:
        return {}
    texts = df.select(*[as_text(F.col(c)).alias(c) for c in columns])
    sizes = distinct_up_to(texts, columns, limit)
    short = [c for c in columns if sizes[c] <= limit]
    if not short:
        return {}
    row = texts.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in short]).first()
    return {c: list(row[c]) for c in short}


def one_hot(df: DataFrame, columns: Sequence[str], limit: int = MAX_LEVELS) -> tuple[DataFrame, list[str]]:
    """Indicators ``column_value`` for columns with few values; the others are dropped and named."""
    levels = text_levels(df, columns, limit)
    indicators = [
        (as_text(F.col(c)) == F.lit(value)).cast("double").alias(f"{c}_{value}")
        for c in columns if c in levels for value in levels[c]
    ]
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, *indicators), [c for c in columns if c not in levels]


def class_sizes(df: DataFrame, target: str) -> list[tuple[object, int]]:
    """(class, rows) in the order of the classes; one grouped pass, refused beyond MAX_CLASSES."""
    found = (
        df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n"))
        .limit(MAX_CLASSES + 1).collect()
    )
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {target}")
    return sorted((r[0], r[1]) for r in found)


def encode_classes(df: DataFrame, target: str, classes: Sequence[object]) -> DataFrame:
    """Add ``y``, the position of the row's class; rows without a class are dropped."""
    labelled = df.filter(F.col(target).isNotNull())
    if len(classes) <= 64:
        values = F.array(*[F.lit(value) for value in classes]).cast(T.ArrayType(df.schema[target].dataType))
        return labelled.withColumn("y", (F.array_position(values, F.col(target)) - 1).cast("bigint"))
    schema = T.StructType([df.schema[target], T.StructField("y", T.LongType())])
    codes = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(classes)], schema)
    return lookup_join(labelled, codes, [target], "inner")


def encode_target(df: DataFrame, target: str, task: str) -> tuple[DataFrame, list[str] | None]:
    """Add ``y`` and drop rows without a usable target.

    Classes are coded 0, 1, ... in the order of their values; regression targets must be finite.
    """
    if task == "regression":
        # missing fails the test as well, and NaN is larger than any number
        number = F.expr(f"try_cast(`{target}` AS DOUBLE)")
        return df.withColumn("y", number).filter(F.abs("y") < float("inf")), None
    classes = [value for value, _ in class_sizes(df, target)]
    return encode_classes(df, target, classes), [str(v) for v in classes]


def bin_number(value: Column, edges: Sequence[float], first: int = 0) -> Column:
    """Index of the right-closed bin: a balanced tree of comparisons."""
    if not edges:
        return F.lit(first)
    middle = len(edges) // 2
    return F.when(value <= F.lit(edges[middle]), bin_number(value, edges[:middle], first)).otherwise(
        bin_number(value, edges[middle + 1 :], first + middle + 1))


@dataclass(frozen=True)
class Binner:
    """How each feature becomes a small integer; ``cells`` numbers the bins of all features."""

    names: tuple[str, ...]
    edges: dict[str, list[float]]
    levels: dict[str, list[str]]
    medians: dict[str, float]
    dropped: tuple[str, ...] = field(default=())

    def size(self, name: str) -> int:
        return len(self.edges[name]) + 1 if name in self.edges else len(self.levels[name])

    @property
    def sizes(self) -> list[int]:
        return [self.size(n) for n in self.names]

    @property
    def starts(self) -> list[int]:
        out, at = [], 0
        for s in self.sizes:
            out.append(at)
            at += s
        return out

    @property
    def n_cells(self) -> int:
        return sum(self.sizes)

    def apply(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` columns and ``cells``, one global bin number per feature.

        Values are cleaned in a projection of their own, so that the comparisons refer to a column
        instead of repeating the cleaning.
        """
        values, bins = {}, []
        for i, (name, start) in enumerate(zip(self.names, self.starts)):
            if name in self.edges:
                values[f"_v{i}"] = F.coalesce(_clean(name), F.lit(self.medians[name]))
                at = bin_number(F.col(f"_v{i}"), self.edges[name])
            else:
                values[f"_v{i}"] = as_text(F.col(name))
                known = F.array(*[F.lit(value) for value in self.levels[name]])
                at = F.greatest(F.array_position(known, F.col(f"_v{i}")) - 1, F.lit(0))
            bins.append((at + F.lit(start)).cast("int"))
        return df.withColumns(values).select(*keep, F.array(*bins).alias("cells"))


def fit_bins(
    df: DataFrame, features: Sequence[str], bins: int = BINS, max_encoded: int | None = None,
    n_rows: int | None = None,
) -> Binner:
    """Quantile bins for numbers (missing = median), levels for short text; the rest is in ``dropped``,
    as are features beyond ``max_encoded`` columns, if such a limit is given.

    Only edges, levels and medians come to the driver.
    """
    numeric = [f.name for f in df.schema.fields if f.name in features and is_number(f)]
    text = [c for c in features if c not in numeric]
    probes = [0.5, *[i / bins for i in range(1, bins)]]
    cleaned = df.select(*[_clean(c).alias(c) for c in numeric]) if numeric else df
    quantiles = exact_quantiles(cleaned, {c: probes for c in numeric}, n_rows=n_rows)
    levels = text_levels(df, text)
    names, dropped, edges, medians, encoded = [], [], {}, {}, 0
    for c in features:
        width = 1 if c in numeric else len(levels.get(c, []))
        usable = (c in numeric and quantiles[c][0] is not None) or c in levels
        if not usable or (max_encoded is not None and encoded >= max_encoded):
            dropped.append(c)
            continue
        encoded += width
        names.append(c)
        if c in numeric:
            medians[c] = quantiles[c][0]
            edges[c] = sorted(set(quantiles[c][1:]))
    return Binner(tuple(names), edges, {c: levels[c] for c in names if c in levels}, medians, tuple(dropped))
