"""Metrics and activities over event streams. An extension: the batch operators define the results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ActivityDefinition, MetricsModel
from ..operators.activities import apply_activities
from ..operators.events import SCHEMA
from ..operators.metrics import _aggregate, _matches, parsed

WINDOWS = {"hourly": "1 hour", "daily": "1 day", "weekly": "1 week", "monthly": "30 days"}


def read_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Events as parquet files arrive in a folder."""
    reader = spark.readStream.schema(SCHEMA)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def stream_activities(events: DataFrame, definitions: list[ActivityDefinition]) -> DataFrame:
    return apply_activities(events, definitions)


def stream_metrics(events: DataFrame, model: MetricsModel, lateness: str = "1 hour") -> DataFrame:
    """Metrics in tumbling windows; events later than ``lateness`` are dropped, and so state is bounded.

    Weeks start on Monday. Exact distinct counts and months of calendar length are batch only.
    """
    if model.grain == "monthly" or any(m.aggregation == "count_distinct" for m in model.metric_fields):
        raise ValueError("calendar months and exact distinct counts are not streamed")
    rows = events.filter(F.col("source").isin(model.sources)).withColumn("_v", parsed(F.col("payload")))
    any_ = F.lit(False)
    for m in model.metric_fields:
        any_ = any_ | _matches(m)
    rows = rows.filter(any_).withColumn("_ts", F.col("ts").cast("timestamp")).withWatermark("_ts", lateness)
    size = WINDOWS[model.grain]
    window = F.window("_ts", size, size, "4 days") if model.grain == "weekly" else F.window("_ts", size)
    dims = [d for d in model.dimensions if d in events.columns]
    return rows.groupBy(window.alias("_window"), *dims).agg(*map(_aggregate, model.metric_fields))


def each_batch(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands every micro-batch to a batch operator, such as a snapshot diff; started with what is there, then stopped."""
    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
