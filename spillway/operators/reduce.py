"""Grouped reduction with the nine aggregates, as one Spark aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spillway.functions.semantics import ORDER, group_key, ordered, top_level
from spillway.plans.spec import Aggregate, Reduce


#: Aggregates that ask in which order rows were met.
ORDERED = ("FIRST", "LAST", "COLLECT")


def aggregate(agg: Aggregate, schema: T.StructType, streaming: bool = False) -> Column:
    value = top_level(agg.of or "", schema)
    number = value.number()
    order = F.col(ORDER)
    if agg.kind == "COUNT":
        return F.count(F.lit(1))
    if agg.kind == "SUM":
        return F.coalesce(F.sum(number), F.lit(0.0))
    if agg.kind == "AVG":  # by all rows, numbers or not
        return F.coalesce(F.sum(number), F.lit(0.0)) / F.count(F.lit(1))
    if agg.kind == "MIN":
        return F.coalesce(F.min(number), F.lit(0.0))
    if agg.kind == "MAX":
        return F.coalesce(F.max(number), F.lit(0.0))
    if agg.kind == "DISTINCT_COUNT":
        return F.size(F.collect_set(value.text())).cast("long") if streaming else F.count_distinct(value.text())
    if agg.kind == "FIRST":
        return F.first(value.column, True) if streaming else F.min_by(value.column, F.when(~value.null(), order))
    if agg.kind == "LAST":
        return F.last(value.column) if streaming else F.max_by(value.column, order)
    if agg.kind == "COLLECT":  # numbers as doubles, else texts; in order, without nulls
        item = number if value.is_number else value.text()
        if streaming:
            return F.collect_list(item)
        kept = F.collect_list(F.when(item.isNotNull(), F.struct(order.alias("o"), item.alias("x"))))
        return F.transform(F.array_sort(kept), lambda s: s["x"])
    raise ValueError(f"unknown aggregate kind '{agg.kind}'")


def reduce(df: DataFrame, spec: Reduce) -> DataFrame:
    """Keys are texts; groups keep the place where they were first met, if rows have places; without keys and rows there is no row.

    ``shuffle`` and ``buckets`` change no result and nothing here: Spark combines rows before it deals them, so a hot key is no hot task,
    and sizes the partitions itself.
    """
    streaming = df.isStreaming
    if any(a.kind in ORDERED for a in spec.aggs):
        df = ordered(df)
    keys = {k: group_key(k, df.schema).alias(k) for k in spec.group_by}
    made = {a.name: aggregate(a, df.schema, streaming).alias(a.name) for a in spec.aggs}
    order = [F.min(ORDER).alias(ORDER)] if ORDER in df.columns and not streaming else []
    # An aggregate named like a key stands in its place.
    named = [c.alias(f"__k_{k}") if k in made else c for k, c in keys.items()]
    out = df.groupBy(*(named or [F.lit(0).alias("__all")])).agg(*(made.values() or [F.count(F.lit(1)).alias("__n")]), *order)
    names = [*(k for k in spec.group_by if k not in made), *made]
    return out.select(*(F.col(f"`{c}`") for c in names), *([ORDER] if order else []))
