"""Whether assets can run as column expressions on the cluster: known before any job starts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from ..functions.expressions import ExpressionError, row_expression
from ..model import AnalyticsEntity
from .registry import Registry


@dataclass(frozen=True)
class Finding:
    asset: str
    feature: str
    reason: str
    fatal: bool = True


class UnsupportedAssetError(ValueError):
    pass


def _of_entity(e: AnalyticsEntity) -> list[Finding]:
    out = []
    for f in (*e.state_fields, *e.measures):
        if f.type:
            try:
                T.DataType.fromDDL(f.type)
            except Exception as error:
                out.append(Finding(e.name, f"type of {f.name}", f"{f.type}: {str(error).splitlines()[0]}"))
    names = [e.identity_graph and "canonical_id" or "entity_id", *(x.name for x in (*e.state_fields, *e.measures, *e.property_bags))]
    for c in e.computed_fields:
        if isinstance(c.expression, str):
            try:
                row_expression(c.expression, names)
            except (ExpressionError, SyntaxError) as error:
                out.append(Finding(e.name, f"computed field {c.name}", str(error)))
        names.append(c.name)
    return out


def findings(assets: dict[str, Registry]) -> list[Finding]:
    """What can't be run as declared: types Spark doesn't have, expressions without a column form; and, not fatal, names that nothing declares."""
    out = []
    sources = {s.name for k in ("state_sources", "event_sources") for s in assets[k]}
    for a in assets["activities"]:
        if a.source not in sources:
            out.append(Finding(a.name, "source", f"no source {a.source}", False))
    for g in assets["identity_graphs"]:
        out += [Finding(g.name, "source", f"no source {s.source}", False) for s in g.sources if s.source not in sources]
    for e in assets["entities"]:
        out += _of_entity(e)
        if e.identity_graph and e.identity_graph not in assets["identity_graphs"]:
            out.append(Finding(e.name, "identity graph", f"no graph {e.identity_graph}", False))
    return out


def assert_supported(assets: dict[str, Registry]) -> None:
    if found := [f for f in findings(assets) if f.fatal]:
        raise UnsupportedAssetError("\n".join(f"{f.asset}: {f.feature}: {f.reason}" for f in found))
