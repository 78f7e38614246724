"""Metrics by grain of time and dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import item, number, parsed, string_scalar
from ..model import MetricField, MetricsModel

GRAINS = {"hourly": ("hour", "yyyy-MM-dd'T'HH"), "daily": ("day", "yyyy-MM-dd"), "weekly": ("week", "yyyy-MM-dd"), "monthly": ("month", "yyyy-MM-dd")}


def grain_column(ts: Column, grain: str) -> Column:
    unit, shape = GRAINS[grain]
    return F.date_format(F.date_trunc(unit, ts.cast("timestamp_ntz")), shape)


def _matches(m: MetricField) -> Column:
    v = F.col("_v")
    if m.aggregation in ("sum_delta", "last_value", "max_value"):
        p = (F.col("event_type") == "field_changed") & (string_scalar(item(v, "field_name")) == m.field_name)
    else:
        p = F.col("event_type") == m.field_name
    return F.coalesce(p, F.lit(False))


def _aggregate(m: MetricField) -> Column:
    v, p = F.col("_v"), _matches(m)
    new, old = number(item(v, "new_value")), number(item(v, "old_value"))
    if m.aggregation == "sum_delta":
        out = F.sum(F.when(p, new - old))
    elif m.aggregation == "last_value":
        out = F.max_by(new, F.when(p & new.isNotNull(), F.struct(F.col("ts").cast("timestamp_ntz").alias("t"), new.alias("n"))))
    elif m.aggregation == "max_value":
        out = F.max(F.when(p, new))
    elif m.aggregation == "count":
        out = F.nullif(F.count_if(p), F.lit(0))
    else:
        out = F.count_distinct(F.when(p, string_scalar(item(v, m.distinct_field))))
    return out.alias(m.output_name)


def aggregate_metrics(events: DataFrame, model: MetricsModel) -> DataFrame:
    """_date, the dimensions that events have, one column for each metric; sorted by date and dimensions."""
    dims = [d for d in model.dimensions if d in events.columns]
    rows = events.filter(F.col("source").isin(model.sources)).withColumn("_v", parsed(F.col("payload")))
    any_ = F.lit(False)
    for m in model.metric_fields:
        any_ = any_ | _matches(m)
    rows = rows.filter(any_).withColumn("_date", grain_column(F.col("ts"), model.grain))
    return rows.groupBy("_date", *dims).agg(*map(_aggregate, model.metric_fields)).orderBy("_date", *dims)
