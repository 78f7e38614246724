"""Linking records of several sources by hashed match keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import item, json_text, parsed
from ..model import IdentityGraph


def canonical_id(key):
    """The first 16 hex digits of the key's SHA-256."""
    return F.substring(F.sha2(key, 256), 1, 16)


def resolve_identities(events: DataFrame, graph: IdentityGraph) -> DataFrame:
    """source, entity_id, canonical_id: one row for each record of the graph's sources.

    A record's key is its match key in any payload, or else its id. Where several keys compete, one that
    was in a payload wins, then the earliest, then the least id.
    """
    fields: dict[str, list[str]] = {}
    for s in graph.sources:
        fields.setdefault(s.source, []).append(s.match_key_field)
    of = lambda name: F.replace(json_text(item(F.col("_v"), name)), F.lit('"'), F.lit(""))
    # One scan, one parse: each source's keys by CASE.
    keys = F.lit(None).cast("array<string>")
    for source, names in fields.items():
        keys = F.when(F.col("source") == source, F.array(*map(of, names))).otherwise(keys)
    rows = events.filter(F.col("source").isin(list(fields)) & (F.col("event_type") != "field_changed")).withColumn("_v", parsed(F.col("payload")))
    given = F.explode(keys) if max(map(len, fields.values())) > 1 else keys[0]
    rows = rows.select("source", "entity_id", "ts", given.alias("given")).withColumn("key", F.coalesce("given", "entity_id")).filter("key is not null")
    rows = rows.withColumn("canonical_id", canonical_id(F.col("key")))
    order = F.struct(F.col("given").isNull().alias("fallback"), F.col("ts"), F.col("canonical_id").alias("id"))
    return rows.groupBy("source", "entity_id").agg(F.min(order)["id"].alias("canonical_id"))


def enrich_events(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Events with canonical_id: the mapping's, or the one they had, or their entity's id."""
    old = F.col("canonical_id") if "canonical_id" in events.columns else F.lit(None).cast("string")
    m = mapping.select("source", "entity_id", F.col("canonical_id").alias("_new"))
    named = events.withColumn("_old", old).drop("canonical_id")
    return named.join(m, ["source", "entity_id"], "left").withColumn("canonical_id", F.coalesce("_new", "_old", "entity_id")).drop("_new", "_old").select(*[c for c in events.columns if c != "canonical_id"], "canonical_id")
