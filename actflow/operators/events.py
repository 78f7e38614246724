"""The universal event stream: source, entity_id, ts, event_type, payload, all text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsonx import packed
from ..model import EventSource

COLUMNS = ("source", "entity_id", "ts", "event_type", "payload")
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])


def empty_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def plain(df: DataFrame, name: str) -> Column:
    """A column as a payload holds it: dates and times as text."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    return c.cast("string") if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType) else c


def nested_as_text(df: DataFrame, name: str) -> Column:
    """Arrays, structs and maps as JSON text."""
    c = F.col(f"`{name}`")
    return F.to_json(c) if isinstance(df.schema[name].dataType, T.ArrayType | T.StructType | T.MapType | T.VariantType) else plain(df, name)


def events_of(df: DataFrame, source: EventSource) -> DataFrame:
    """Rows of an event source as events: what isn't id, time or type is payload."""
    used = {source.entity_id_field, source.timestamp_field, source.event_type_field}
    kind = F.lit(source.event_type) if source.event_type else F.col(source.event_type_field).cast("string") if source.event_type_field else F.lit(source.name)
    rest = [c for c in df.columns if c not in used and c not in source.payload_exclude]
    return df.select(
        F.lit(source.name).alias("source"),
        F.col(source.entity_id_field).cast("string").alias("entity_id"),
        F.col(source.timestamp_field).cast("string").alias("ts"),
        kind.alias("event_type"),
        packed({c: nested_as_text(df, c) for c in rest}).alias("payload"),
    )


def concat_events(parts: list[DataFrame]) -> DataFrame:
    """All streams one after another, as five text columns."""
    return reduce(DataFrame.unionByName, [p.select(*(F.col(c).cast("string").alias(c) for c in COLUMNS)) for p in parts])
