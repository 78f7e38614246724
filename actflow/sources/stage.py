"""From a source's rows to the table that events are made of.

Order: read, prune, casts, divides, multiplies, renames, joins, JSON paths, computed columns, filter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import evaluate_expression
from ..functions.jsonx import typed_path
from ..model import Divide, EventSource, Field, Join, Multiply, SourceTransforms, StateSource, TableSource

#: Declared types and Spark's names for them.
TYPES = {"string": "string", "int64": "bigint", "int": "int", "int32": "int", "float64": "double", "float": "float", "boolean": "boolean", "bool": "boolean", "date": "date", "timestamp": "timestamp", "bytes": "binary", "decimal": "decimal(38,9)", "numeric": "decimal(38,9)"}


def spark_type(name: str) -> str:
    return TYPES.get(name.lower(), name)


def _need(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        raise ValueError(f"no column {name}; there are {', '.join(df.columns)}")
    return F.col(f"`{name}`")


def apply_transforms(df: DataFrame, t: SourceTransforms | None) -> DataFrame:
    if t is None:
        return df
    for c in t.type_casts:
        df = df.withColumn(c.field, _need(df, c.field).cast(spark_type(c.target_type)))
    for d in (*t.divides, *t.multiplies):
        by = _need(df, d.field) / d.divisor if isinstance(d, Divide) else _need(df, d.field) * d.multiplier
        df = df.withColumn(d.field + d.suffix, by.cast(spark_type(d.target_type)))
    for r in t.renames:
        _need(df, r.from_name)
        df = df.withColumnRenamed(r.from_name, r.to_name)
    return df


def apply_joins(df: DataFrame, joins: list[Join], table_of: Callable[[str], tuple[StateSource, DataFrame]]) -> DataFrame:
    """Left joins in order. A right column whose name is taken gets _{source}_{key}; left names stay.

    The right key is kept once: where it equals the left key's name it is left out.
    """
    for j in joins:
        source, right = table_of(j.source_name)
        taken = set(df.columns)
        if j.join_key == source.id_field:
            shown = {c: c if c not in taken else f"{c}_{source.name}_{j.join_key}" for c in right.columns if c != source.id_field}
        else:
            shown = {c: c if c not in taken else f"{c}_{source.name}_{j.join_key}" for c in right.columns}
        key = "_join_key"
        side = right.select(F.col(f"`{source.id_field}`").alias(key), *(F.col(f"`{c}`").alias(n) for c, n in shown.items()))
        df = df.join(side, _need(df, j.join_key) == F.col(key), "left").drop(key)
    return df


def apply_json_paths(df: DataFrame, fields: list[Field] | None) -> DataFrame:
    for f in fields or []:
        if f.json_path:
            df = df.withColumn(f.name, typed_path(_need(df, f.source_column or f.name), f.json_path, f.type))
    return df


def apply_computed(df: DataFrame, source: TableSource) -> DataFrame:
    for c in getattr(source, "computed_columns", []):
        if source.fixture_is_transformed and source.path and c.name in df.columns:
            continue
        value = evaluate_expression(c.expression, df) if isinstance(c.expression, str) else c.expression
        df = df.withColumn(c.name, value if isinstance(value, Column) else F.lit(value))
    return df


def build_stage(df: DataFrame, source: TableSource, table_of: Callable | None = None, columns: set[str] | None = None) -> DataFrame:
    """The whole chain over rows that were read. ``columns`` prunes what is read.

    Columns that a joined table has too are read nevertheless: by them the joined ones get their names.
    A fixture that is in its final shape skips transforms, joins, JSON paths and filter.
    """
    if columns is not None:
        joined = {c for j in getattr(source, "joins", None) or () for c in table_of(j.source_name)[1].columns}
        wanted = {c.lower() for c in columns | joined}
        df = df.select(*(f"`{c}`" for c in df.columns if c.lower() in wanted))
    if source.fixture_is_transformed and source.path:
        return apply_computed(df, source)
    df = apply_transforms(df, source.transforms)
    if getattr(source, "joins", None):
        df = apply_joins(df, source.joins, table_of)
    df = apply_computed(apply_json_paths(df, source.fields), source)
    return df.filter(evaluate_expression(source.filter, df)) if source.filter else df


def join_levels(sources: list[StateSource | EventSource]) -> list[list[str]]:
    """Sources in levels: each joins only earlier levels. Declaration order within a level."""
    by_name = {s.name: s for s in sources}
    for s in sources:
        for j in s.joins:
            if j.source_name not in by_name:
                raise ValueError(f"{s.name} joins unknown source {j.source_name}")
            if isinstance(by_name[j.source_name], EventSource):
                raise ValueError(f"{s.name} joins {j.source_name}, which is an event source")
    left, done, levels = list(by_name), set(), []
    while left:
        level = [n for n in left if all(j.source_name in done for j in by_name[n].joins)]
        if not level:
            raise ValueError("joins form a cycle: " + " -> ".join(_cycle(by_name, left)))
        levels.append(level)
        done.update(level)
        left = [n for n in left if n not in done]
    return levels


def _cycle(by_name: dict, left: list[str]) -> list[str]:
    path = [left[0]]
    while True:
        nxt = next(j.source_name for j in by_name[path[-1]].joins if j.source_name in left)
        if nxt in path:
            return [*path[path.index(nxt) :], nxt]
        path.append(nxt)


__all__ = ["Divide", "Multiply", "apply_computed", "apply_joins", "apply_json_paths", "apply_transforms", "build_stage", "join_levels"]
