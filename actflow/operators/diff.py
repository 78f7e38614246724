"""Change events from two snapshots of a state source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsonx import packed
from .events import empty_events, plain


def appeared(df: DataFrame, source: str, id_field: str, ts: str) -> DataFrame:
    """Every row as row_appeared."""
    return df.select(
        F.lit(source).alias("source"), F.col(id_field).cast("string").alias("entity_id"), F.lit(ts).alias("ts"), F.lit("row_appeared").alias("event_type"),
        packed({c: plain(df, c) for c in df.columns if c != id_field}).alias("payload"),
    )


def diff_snapshots(current: DataFrame, previous: DataFrame | None, source: str, id_field: str, ts: str, exclude: list[str] | None = None) -> DataFrame:
    """row_appeared, row_disappeared and field_changed events.

    Both snapshots meet in one full outer join on the id's text; every pair of rows gives an array of
    events. A column that the previous snapshot lacks was null then.
    """
    if previous is None:
        return appeared(current, source, id_field, ts)
    fields = [c for c in current.columns if c != id_field and c not in (exclude or [])]
    for c in fields:
        if c not in previous.columns:
            previous = previous.withColumn(c, F.lit(None).cast(current.schema[c].dataType))
    key = lambda df: F.col(id_field).cast("string").alias("id")
    cur = current.select(key(current), F.struct(*(plain(current, c).alias(c) for c in current.columns if c != id_field), F.lit(True).alias("_")).alias("c"))
    old = previous.select(key(previous), F.struct(*(plain(previous, c).alias(c) for c in previous.columns if c != id_field), F.lit(True).alias("_")).alias("p"))
    event = T.ArrayType(T.StructType([T.StructField("event_type", T.StringType()), T.StructField("payload", T.StringType())]))
    one = lambda kind, payload: F.struct(F.lit(kind).alias("event_type"), payload.alias("payload"))

    def change(c: str):
        now, then = F.col(f"c.`{c}`"), F.col(f"p.`{c}`")
        payload = packed({"field_name": F.lit(c), "old_value": then, "new_value": now})
        return F.when(~now.cast("string").eqNullSafe(then.cast("string")), one("field_changed", payload))

    changes = F.array_compact(F.array(*map(change, fields))) if fields else F.array().cast(event)
    whole = lambda side, df: packed({c: F.col(f"{side}.`{c}`") for c in df.columns if c != id_field})
    found = (
        F.when(F.col("p").isNull(), F.array(one("row_appeared", whole("c", current))))
        .when(F.col("c").isNull(), F.array(one("row_disappeared", whole("p", previous))))
        .otherwise(changes)
    )
    rows = cur.join(old, "id", "full_outer").select("id", found.alias("found"))
    return rows.select(F.lit(source).alias("source"), F.col("id").alias("entity_id"), F.lit(ts).alias("ts"), F.inline("found"))


def snapshot_diff(store, df: DataFrame, source: str, id_field: str, date: str, exclude: list[str] | None = None, full_refresh: bool = False) -> DataFrame:
    """Saves this snapshot, and returns its differences from the newest earlier one. What is compared are written tables.

    If nothing changed since a snapshot that exists, every row is replayed as row_appeared.
    """
    if full_refresh:
        return appeared(df, source, id_field, date)
    previous = store.get_previous(source, date)
    store.save(source, date, df)
    df = store.load(source, date)
    events = diff_snapshots(df, previous, source, id_field, date, exclude)
    if previous is not None and events.isEmpty():
        events = empty_events(df.sparkSession) if df.isEmpty() else appeared(df, source, id_field, date)
    return events
