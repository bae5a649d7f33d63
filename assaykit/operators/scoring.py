"""Metric values of one table or of many runs at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import Context, Metric, SumMetric, context_for, context_of
from ..session import cut_lineage


def metric_value(
    preds: DataFrame, metric: Metric, by: Sequence[str] = (), ctx: Context | None = None
) -> DataFrame:
    """``by`` columns and ``value``."""
    ctx = ctx or context_for(metric, preds)
    by = list(by)
    return metric.finish(metric.cells(preds, by, ctx), by, ctx)


def metrics_table(
    preds: DataFrame, metrics: Sequence[Metric], by: Sequence[str], ctx: Context | None = None
) -> DataFrame:
    """One column per metric, one row per group.

    All metrics share one pass: plain sums, confusion cells and score cells are grouping sets of one
    aggregation, which is written and read by every metric.
    """
    labelled = any(m.task == "classification" for m in metrics)
    ctx = ctx or (context_of(preds) if labelled else Context())
    by = list(by)
    usable = [m for m in metrics if not (m.needs_proba and ctx.proba is None)]
    if not usable:
        return preds.select(*by).distinct()
    # metrics with the same cell keys share a grouping set
    sets: dict[tuple[str, ...], dict[str, Column]] = {}
    keys: dict[str, Column] = {}
    for m in usable:
        own = m.cell_keys(ctx)
        keys |= own
        sets.setdefault(tuple(own), {}).update(m.cell_sums(ctx))
    weight = F.col(ctx.weight).cast("double") if ctx.weight else F.lit(1.0)
    names = {(i, n): f"_sum{i}_{n}" for i, own in enumerate(sets.values()) for n in own}
    inputs = [(c.cast("double") * weight).alias(names[i, n]) for i, own in enumerate(sets.values()) for n, c in own.items()]
    renamed = {k: f"_key{k}" for k in keys}
    narrow = preds.select(*by, *[c.alias(renamed[k]) for k, c in keys.items()], *inputs)
    grouped = narrow.groupingSets(
        [[F.col(c) for c in [*by, *[renamed[k] for k in own]]] for own in sets], *by, *renamed.values())
    absent = [F.grouping(renamed[k]).alias(f"_no{k}") for k in keys]
    cells = cut_lineage(grouped.agg(*absent, *[F.sum(n).alias(n) for n in names.values()]))

    def cells_of(own: tuple[str, ...]) -> DataFrame:
        at = list(sets).index(own)
        chosen = cells
        for k in keys:
            chosen = chosen.filter(F.col(f"_no{k}") == (0 if k in own else 1))
        return chosen.select(*by, *[F.col(renamed[k]).alias(k) for k in own], *[F.col(names[at, n]).alias(n) for n in sets[own]])

    plain = [m for m in usable if isinstance(m, SumMetric)]
    # plain sums have one row per group
    out = cells_of(()).select(*by, *[m.formula().alias(m.name) for m in plain]) if plain else None
    for m in usable:
        if m in plain:
            continue
        value = m.finish(cells_of(tuple(m.cell_keys(ctx))), by, ctx).withColumnRenamed("value", m.name)
        out = value if out is None else out.join(value, by, "left")
    return out
