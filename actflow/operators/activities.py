"""Named business activities found in events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import item, packed, parsed, string_scalar
from ..model import ActivityDefinition, EventOccurred, FieldChanged, RowAppeared, RowDisappeared
from .events import COLUMNS


def predicate(a: ActivityDefinition, v: Column) -> Column:
    """Whether an event is this activity; unknown counts as no. v: the parsed payload."""
    mine, kind, t = F.col("source") == a.source, F.col("event_type"), a.trigger
    if isinstance(t, RowAppeared):
        p = mine & (kind == "row_appeared")
    elif isinstance(t, RowDisappeared):
        p = mine & (kind == "row_disappeared")
    elif isinstance(t, FieldChanged):
        p = mine & (kind == "field_changed") & (string_scalar(item(v, "field_name")) == t.field)
        if t.from_values is not None:
            p = p & string_scalar(item(v, "old_value")).isin(t.from_values)
        if t.to_values is not None:
            p = p & string_scalar(item(v, "new_value")).isin(t.to_values)
    elif isinstance(t, EventOccurred):
        p = mine & (kind == t.event_type) if t.event_type else mine
    else:
        raise TypeError(f"unknown trigger {t!r}")
    return F.coalesce(p, F.lit(False))


def apply_activities(events: DataFrame, definitions: list[ActivityDefinition]) -> DataFrame:
    """Each match is a renamed copy of its event; events without a match stay as they are. One pass over the events."""
    base = events.select(*COLUMNS)
    if not definitions:
        return base
    v = F.col("_v")

    def copy(a: ActivityDefinition) -> Column:
        payload = packed({f: item(v, f) for f in a.include_fields}) if a.include_fields else F.col("payload")
        return F.when(predicate(a, v), F.struct(F.lit(a.name).alias("event_type"), payload.alias("payload")))

    found = F.array_compact(F.array(*map(copy, definitions)))
    itself = F.array(F.struct(F.col("event_type"), F.col("payload")))
    rows = base.withColumn("_v", parsed(F.col("payload"))).select("source", "entity_id", "ts", F.col("event_type"), "payload", found.alias("_found"))
    return rows.select("source", "entity_id", "ts", F.inline(F.when(F.size("_found") > 0, F.col("_found")).otherwise(itself)))
