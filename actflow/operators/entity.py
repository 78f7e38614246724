"""One row for each entity: state fields, measures, property bags, computed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import row_expression
from ..functions.jsonx import item, json_text, number, parsed, string_scalar, unquoted
from ..model import AnalyticsEntity, Measure, StateField


def state_value(field: str) -> Column:
    """JSON text of a field as an event tells it: a change of the field its new value, other changes nothing, other events their payload's.

    Over the columns _v (parsed payload) and _name (its field_name).
    """
    v, changed = F.col("_v"), F.col("event_type") == "field_changed"
    return F.when(changed & (F.col("_name") == field), json_text(item(v, "new_value"))).when(changed, F.lit(None)).otherwise(json_text(item(v, field)))


def _extreme(pick, value: Column, condition: Column) -> Column:
    """The value at the first or last time among rows of a condition with a value; ties by type and value."""
    return pick(value, F.when(condition & value.isNotNull(), F.struct(F.col("ts"), F.col("event_type"), value.alias("v"))))


def _shaped(text: Column, kind: str | None) -> Column:
    return unquoted(text).try_cast(kind) if kind else unquoted(text)


def state_column(f: StateField, value: Column) -> Column:
    of = lambda s, pick=F.max_by: _extreme(pick, value, F.col("source") == s)
    if f.strategy == "coalesce":
        text = F.coalesce(*map(of, f.priority))
    else:
        text = of(f.source, F.min_by if f.strategy == "first" else F.max_by)
    return _shaped(text, f.type).alias(f.name)


def measure_column(m: Measure, value: Column | None) -> Column:
    mine = F.col("event_type") == m.activity
    if m.aggregation == "count":
        return F.count_if(mine).alias(m.name)
    if m.aggregation == "sum":
        return F.coalesce(F.sum(F.when(mine, value)), F.lit(0.0)).alias(m.name)
    return _shaped(_extreme(F.max_by, value, mine), m.type).alias(m.name)


def relevant(e: AnalyticsEntity) -> Column:
    sources = sorted({s for f in e.state_fields for s in (f.source, *(f.priority or []))} | {b.source for b in e.property_bags})
    return F.col("source").isin(sources) | F.col("event_type").isin(sorted({m.activity for m in e.measures}))


def project_entity(events: DataFrame, e: AnalyticsEntity) -> DataFrame:
    """One filter, one grouping; computed fields on top. The key is canonical_id if there is one."""
    key = "canonical_id" if "canonical_id" in events.columns else "entity_id"
    # Every payload is parsed once, and every field read once, before rows are grouped.
    rows = events.filter(relevant(e)).withColumn("_v", parsed(F.col("payload"))).withColumn("_name", string_scalar(item(F.col("_v"), "field_name")))
    states = {f: f"_s{i}" for i, f in enumerate(dict.fromkeys(x.field for x in (*e.state_fields, *e.property_bags)))}
    read = {"sum": number, "latest": json_text}
    measured = {(m.aggregation, m.field): f"_m{i}" for i, m in enumerate(e.measures) if m.aggregation in read}
    columns = {c: state_value(f) for f, c in states.items()} | {c: read[how](item(F.col("_v"), f)) for (how, f), c in measured.items()}
    rows = rows.withColumns(columns).drop("_v", "_name", "payload") if columns else rows
    bags = [_extreme(F.max_by, F.col(states[b.field]), F.col("source") == b.source).alias(b.name) for b in e.property_bags]
    aggregates = [
        *(state_column(f, F.col(states[f.field])) for f in e.state_fields),
        *(measure_column(m, F.col(measured[m.aggregation, m.field]) if m.aggregation in read else None) for m in e.measures),
        *bags,
    ]
    out = rows.groupBy(key).agg(*aggregates) if aggregates else rows.select(key).distinct()
    for c in e.computed_fields:
        out = out.withColumn(c.name, row_expression(c.expression, out.columns) if isinstance(c.expression, str) else c.expression)
    return out
