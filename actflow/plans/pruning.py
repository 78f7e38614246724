"""Which columns of a source the declared assets read, so that a scan reads no others.

A source is pruned only if what it feeds can't depend on further columns. Not pruned are sources that others
join, those with column expressions, those whose rows are compared with a snapshot (a change of any column is
an event, and a source without any change is replayed), and those from which any event is counted, whatever it is.
"""

from __future__ import annotations

import re

from ..model import ComputedColumn, EventOccurred, EventSource, FieldChanged, StateSource, TableSource
from ..operators.quality import ForeignKey

_NAME = re.compile(r"[^\W\d]\w*")


def fields_read(assets: dict) -> dict[str, set[str] | None]:
    """For each source the columns of its finished table that assets read; None for all."""
    of = lambda kind: list(assets.get(kind, ()))
    sources = {s.name: s for s in (*of("state_sources"), *of("event_sources"))}
    activities = of("activities")
    read: dict[str, set[str]] = {}
    whole = {j.source_name for s in sources.values() for j in s.joins}
    for s in sources.values():
        if isinstance(s, EventSource):
            read[s.name] = {c for c in (s.entity_id_field, s.timestamp_field, s.event_type_field) if c}
        else:
            read[s.name] = {s.id_field}
            if not s.full_refresh:
                whole.add(s.name)
        read[s.name] |= {j.join_key for j in s.joins}

    def need(source: str, *names: str | None) -> None:
        read.setdefault(source, set()).update(n for n in names if n)

    def need_of_event(kind: str, *names: str | None) -> None:
        """An event's field, whoever makes such events: activities of that name, or any source."""
        makers = {a.source for a in activities if a.name == kind}
        for source in makers or set(sources):
            need(source, *names)

    for a in activities:
        need(a.source, a.entity_id_field, a.person_id_field, *a.include_fields)
        if isinstance(a.trigger, FieldChanged):
            need(a.source, a.trigger.field)
        elif isinstance(a.trigger, EventOccurred) and a.source in sources and isinstance(sources[a.source], StateSource):
            whole.add(a.source)
    for g in of("identity_graphs"):
        for s in g.sources:
            need(s.source, s.id_field, s.match_key_field)
    for e in of("entities"):
        for f in e.state_fields:
            for source in (f.source, *(f.priority or ())):
                need(source, f.field)
        for b in e.property_bags:
            need(b.source, b.field)
        for m in e.measures:
            need_of_event(m.activity, m.field)
        whole |= {c.references.split(".")[0] for c in e.quality_checks if isinstance(c, ForeignKey)}
    for m in of("metrics_models"):
        for source in m.sources:
            need(source, *m.dimensions, *(n for f in m.metric_fields for n in (f.field_name, f.distinct_field)))
    return {name: None if name in whole else {part for c in read[name] for part in (c, c.split(".")[0])} for name in sources}


def raw_columns(source: TableSource, fields: set[str] | None) -> set[str] | None:
    """The columns to read for a finished table's ``fields``, through filter, computed columns, JSON paths and transforms; None for all."""
    computed: list[ComputedColumn] = getattr(source, "computed_columns", [])
    if fields is None or any(not isinstance(c.expression, str) for c in computed):
        return None
    names = set(fields) | {n for c in computed for n in _NAME.findall(c.expression)} | {c.name for c in computed}
    if source.fixture_is_transformed and source.path:
        return names
    names |= set(_NAME.findall(source.filter or ""))
    names |= {f.source_column or f.name for f in source.fields or () if f.json_path}
    if source.transforms:
        t = source.transforms
        names |= {x.field for x in (*t.type_casts, *t.divides, *t.multiplies)} | {r.from_name for r in t.renames}
        back = {r.to_name: r.from_name for r in t.renames}
        names |= {back[n] for n in names if n in back}
    return names
