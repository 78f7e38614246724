"""A bounded, read-only query layer over models: declared metrics, dimensions, and keys of property bags."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import AnalyticsEntity, MetricsModel

DEFAULT_LIMIT, MAX_LIMIT = 50, 500
OPERATORS = ("eq", "in", "gte", "lte", "gt", "lt")
BAG_OPERATORS = ("eq", "in", "contains", "is_null", "not_null")
_BAG = re.compile(r"""^(\w+)(?:\.([\w-]+)|\['([^'\\]+)'\])$""")
_KEY = re.compile(r"^[\w .:/-]{1,200}$")


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class CatalogModel:
    name: str
    metrics: dict[str, str] = field(default_factory=dict)  # physical column -> aggregation
    dimensions: tuple[str, ...] = ()
    bags: tuple[str, ...] = ()
    kind: str = "metrics"


def catalog_of(models: list[MetricsModel | AnalyticsEntity]) -> dict[str, CatalogModel]:
    out = {}
    for m in models:
        if isinstance(m, MetricsModel):
            out[m.name] = CatalogModel(m.name, {f.output_name: f.aggregation for f in m.metric_fields}, ("_date", *m.dimensions))
        else:
            names = (*(f.name for f in m.state_fields), *(c.name for c in m.computed_fields))
            out[m.name] = CatalogModel(m.name, {x.name: x.aggregation for x in m.measures}, names, tuple(b.name for b in m.property_bags), "entity")
    return out


def list_models(catalog: dict[str, CatalogModel]) -> list[dict]:
    return [{"name": m.name, "kind": m.kind, "metrics": len(m.metrics), "dimensions": len(m.dimensions)} for m in sorted(catalog.values(), key=lambda m: m.name)]


def describe_model(catalog: dict[str, CatalogModel], name: str) -> dict:
    m = _model(catalog, name)
    return {"name": m.name, "kind": m.kind, "metrics": [{"metric_id": f"{m.name}.{k}", "name": k, "aggregation": a} for k, a in m.metrics.items()], "dimensions": list(m.dimensions), "property_bags": list(m.bags)}


def list_metrics(catalog: dict[str, CatalogModel], model: str | None = None) -> list[dict]:
    """Metrics of all models or one, each with the aggregation by which queries combine its rows."""
    return [
        {"metric_id": f"{m.name}.{k}", "name": k, "model": m.name, "aggregation": a, "reaggregated_by": "max" if a == "max_value" else "sum", "additive": a in ("count", "sum", "sum_delta")}
        for m in _models(catalog, model)
        for k, a in m.metrics.items()
    ]


def list_dimensions(catalog: dict[str, CatalogModel], model: str | None = None) -> list[dict]:
    """Dimensions of all models or one, property bags included: whether queries group or filter by them."""
    out = []
    for m in _models(catalog, model):
        out += [{"dimension_id": f"{m.name}.{d}", "name": d, "model": m.name, "kind": "time" if d == "_date" else "column", "operators": list(OPERATORS)} for d in m.dimensions]
        out += [{"dimension_id": f"{m.name}.{b}", "name": b, "model": m.name, "kind": "property_bag", "operators": list(BAG_OPERATORS)} for b in m.bags]
    return out


def _described(found: list[dict], id_: str, name: str) -> dict:
    matches = sorted((x for x in found if name in (x["name"], x[id_])), key=lambda x: x[id_])
    return {"query": name, "matches": matches, "count": len(matches), "ambiguous": len(matches) > 1}


def describe_metric(catalog: dict[str, CatalogModel], metric: str, model: str | None = None) -> dict:
    """Metrics of that name or id; one alone comes with the dimensions it can be grouped by."""
    out = _described(list_metrics(catalog, model), "metric_id", metric)
    return out | ({"dimensions": [d["name"] for d in list_dimensions(catalog, out["matches"][0]["model"])]} if out["count"] == 1 else {})


def describe_dimension(catalog: dict[str, CatalogModel], dimension: str, model: str | None = None) -> dict:
    """Dimensions of that name or id; one alone comes with the metrics it can group."""
    out = _described(list_dimensions(catalog, model), "dimension_id", dimension)
    return out | ({"metrics": [m["name"] for m in list_metrics(catalog, out["matches"][0]["model"])]} if out["count"] == 1 else {})


def _models(catalog: dict[str, CatalogModel], name: str | None) -> list[CatalogModel]:
    return [_model(catalog, name)] if name else [catalog[k] for k in sorted(catalog)]


def query_syntax() -> dict:
    return {
        "request": {"model": "name", "metrics": ["metric"], "dimensions": ["column", "bag.key", "bag['a key']"], "filters": [{"field": "column", "op": "eq", "value": 1}], "order_by": [{"field": "metric", "direction": "desc"}], "limit": DEFAULT_LIMIT},
        "operators": list(OPERATORS), "bag_operators": list(BAG_OPERATORS), "max_limit": MAX_LIMIT,
    }


def _model(catalog: dict[str, CatalogModel], name: str) -> CatalogModel:
    if name not in catalog:
        raise QueryError(f"unknown model {name}")
    return catalog[name]


def load_model(spark: SparkSession, name: str, output_dir: str | None = None) -> DataFrame:
    """The model's table, or else its parquet."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    if output_dir is None:
        raise QueryError(f"{name} has no table")
    return spark.read.parquet(f"{output_dir.rstrip('/')}/{name}.parquet")


def bag_value(bag: str, key: str) -> Column:
    if not _KEY.match(key):
        raise QueryError(f"{key!r} can't be a key")
    return F.get_json_object(F.col(bag), f"$['{key}']")


def _bag_key(m: CatalogModel, name: str) -> tuple[str, str] | None:
    if (got := _BAG.match(name)) and got[1] in m.bags:
        return got[1], got[2] or got[3]
    return None


def _dimension(m: CatalogModel, df: DataFrame, name: str) -> Column:
    if key := _bag_key(m, name):
        return bag_value(*key).alias(f"{key[0]}__{key[1]}")
    if name not in m.dimensions or name not in df.columns:
        raise QueryError(f"{m.name} has no dimension {name}")
    return F.col(f"`{name}`")


def _filter(m: CatalogModel, df: DataFrame, f: dict) -> Column:
    if set(f) - {"field", "op", "value"} or "field" not in f or "op" not in f:
        raise QueryError("a filter has field, op and value")
    name, op, value = f["field"], f["op"], f.get("value")
    if key := _bag_key(m, name):
        if op not in BAG_OPERATORS:
            raise QueryError(f"unknown operator {op}")
        c = bag_value(*key)
        if op == "contains":
            text = re.sub(r"([\\%_])", r"\\\1", str(value))
            return c.ilike(f"%{text}%")
        if op in ("is_null", "not_null"):
            return c.isNull() if op == "is_null" else c.isNotNull()
        return c == str(value) if op == "eq" else c.isin([str(v) for v in value])
    if name not in (*m.dimensions, *(m.metrics if m.kind == "entity" else ())) or name not in df.columns:
        raise QueryError(f"{m.name} has no field {name} to filter by")
    if op not in OPERATORS:
        raise QueryError(f"unknown operator {op}")
    c = F.col(f"`{name}`")
    return {"eq": lambda: c == value, "in": lambda: c.isin(list(value)), "gte": lambda: c >= value, "lte": lambda: c <= value, "gt": lambda: c > value, "lt": lambda: c < value}[op]()


def limit_of(n: int | None) -> int:
    n = DEFAULT_LIMIT if n is None else n
    if not isinstance(n, int) or n < 1:
        raise QueryError("limit is a whole number from 1")
    return min(n, MAX_LIMIT)


def build_query(df: DataFrame, model: CatalogModel, metrics: list[str], dimensions: list[str] = (), filters: list[dict] = (), order_by: list[dict] = (), limit: int | None = None) -> DataFrame:
    """Filter, group by the dimensions, aggregate the metrics again (max_value by max, all others by sum), order, limit."""
    if not metrics and not dimensions:
        raise QueryError("name a metric or a dimension")
    for f in filters:
        df = df.filter(_filter(model, df, f))
    dims = [_dimension(model, df, d) for d in dimensions]
    aggregates = []
    for name in metrics:
        if name not in model.metrics or name not in df.columns:
            raise QueryError(f"{model.name} has no metric {name}")
        aggregates.append((F.max if model.metrics[name] == "max_value" else F.sum)(f"`{name}`").alias(name))
    out = df.groupBy(*dims).agg(*aggregates) if aggregates else df.select(*dims).distinct()
    order = []
    for o in order_by:
        if set(o) - {"field", "direction"} or o.get("field") is None or o.get("direction", "desc") not in ("asc", "desc"):
            raise QueryError("an order has field, and direction asc or desc")
        if (name := _column_name(model, o["field"])) not in out.columns:
            raise QueryError(f"{o['field']} isn't selected")
        order.append(F.col(f"`{name}`").asc_nulls_last() if o.get("direction") == "asc" else F.col(f"`{name}`").desc_nulls_last())
    return (out.orderBy(*order) if order else out).limit(limit_of(limit))


def _column_name(m: CatalogModel, name: str) -> str:
    return f"{key[0]}__{key[1]}" if (key := _bag_key(m, name)) else name


def query_model(spark: SparkSession, catalog: dict[str, CatalogModel], request: dict[str, Any], output_dir: str | None = None) -> list[dict]:
    request = dict(request)
    m = _model(catalog, request.pop("model"))
    return [r.asDict(recursive=True) for r in build_query(load_model(spark, m.name, output_dir), m, **request).collect()]


def preview_query(spark: SparkSession, catalog: dict[str, CatalogModel], request: dict[str, Any], output_dir: str | None = None) -> str:
    """The plan of a request, without running it."""
    request = dict(request)
    m = _model(catalog, request.pop("model"))
    return build_query(load_model(spark, m.name, output_dir), m, **request)._jdf.queryExecution().toString()


def discover_keys(df: DataFrame, bag: str, limit: int | None = None) -> DataFrame:
    """key, rows, distinct_values of a bag's keys; most frequent first."""
    rows = df.select(F.explode(F.from_json(F.col(bag), "map<string,string>")).alias("key", "value"))
    out = rows.groupBy("key").agg(F.count("*").alias("rows"), F.count_distinct("value").alias("distinct_values"))
    return out.orderBy(F.desc("rows"), "key").limit(limit_of(limit))


def sample_values(df: DataFrame, bag: str, key: str, limit: int | None = None) -> DataFrame:
    """Values of a key, missing ones included, so that their kind can be inferred."""
    return df.select(bag_value(bag, key).alias("value")).limit(limit_of(limit))


def infer_kind(values: list[str | None]) -> str:
    """number, boolean, date-ish, string, mixed, null-heavy or unknown."""
    some = [v for v in values if v is not None and v != ""]
    if not some:
        return "unknown"
    if len(some) * 2 < len(values):
        return "null-heavy"
    kinds = set()
    for v in some:
        if v.lower() in ("true", "false"):
            kinds.add("boolean")
        elif re.match(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$", v):
            kinds.add("number")
        elif re.match(r"^\d{4}-\d{2}-\d{2}", v):
            kinds.add("date-ish")
        else:
            kinds.add("string")
    return kinds.pop() if len(kinds) == 1 else "mixed"
