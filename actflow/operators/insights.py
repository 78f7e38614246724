"""Insight recipes: the top rows of a table, or of two tables joined."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT, MAX_LIMIT = 20, 100


@dataclass(frozen=True)
class Recipe:
    """kind table_top or joined_top; a filter and an order name only allowed columns."""

    name: str
    table: str
    columns: list[str]
    order_columns: list[str]
    filter_columns: list[str] = field(default_factory=list)
    kind: str = "table_top"
    join_table: str | None = None
    left_key: str | None = None
    right_key: str | None = None
    tags: list[str] = field(default_factory=list)
    default_filters: dict[str, object] = field(default_factory=dict)
    default_limit: int = DEFAULT_LIMIT
    max_limit: int = MAX_LIMIT

    def __post_init__(self) -> None:
        if self.kind not in ("table_top", "joined_top"):
            raise ValueError(f"unknown kind {self.kind}")
        if self.kind == "joined_top" and not (self.join_table and self.left_key and self.right_key):
            raise ValueError("joined_top names a table and two keys")
        if not self.columns or not self.order_columns:
            raise ValueError("a recipe has columns and columns to order by")


def recipe_limit(n: int | None, default: int = DEFAULT_LIMIT, most: int = MAX_LIMIT) -> int:
    return max(1, min(default if n is None else int(n), most))


def parse_recipe(name: str, raw: dict) -> Recipe:
    """A recipe from its mapping: type, table, columns, order_by {default, allowed}, filters {allowed, defaults},
    limit {default, max}, tags; joined_top also has join {right, left_on, right_on}."""

    def mapping(key: str) -> dict:
        value = raw.get(key) or {}
        if not isinstance(value, dict):
            raise ValueError(f"{name}: {key} is no mapping")
        return value

    def strings(value: object, key: str) -> list[str]:
        if not isinstance(value, list | tuple) or not all(isinstance(x, str) and x for x in value):
            raise ValueError(f"{name}: {key} is no list of names")
        return list(value)

    if not isinstance(raw, dict):
        raise ValueError(f"{name} is no mapping")
    columns = strings(raw.get("columns") or [], "columns")
    order, limits, wanted, join = mapping("order_by"), mapping("limit"), mapping("filters"), mapping("join")
    allowed = strings(order.get("allowed", columns), "order_by.allowed")
    default = order.get("default", allowed[0] if allowed else None)
    if default not in allowed or not set(allowed) <= set(columns):
        raise ValueError(f"{name}: rows are ordered by selected columns, the default among them")
    few, most = int(limits.get("default", DEFAULT_LIMIT)), int(limits.get("max", MAX_LIMIT))
    if not 1 <= few <= most:
        raise ValueError(f"{name}: limits are positive, the default at most the greatest")
    source = raw.get("table") or raw.get("primary" if raw.get("type") == "joined_top" else "source")
    if not source:
        raise ValueError(f"{name} has no table")
    table = source["name"] if isinstance(source, dict) else source
    return Recipe(
        name, table, columns, [default, *(c for c in allowed if c != default)], strings(wanted.get("allowed", []), "filters.allowed"), raw.get("type"), join.get("right"), join.get("left_on"), join.get("right_on"),
        strings(raw.get("tags", []), "tags"), dict(wanted.get("defaults") or {}), few, most,
    )


def top_rows(tables: dict[str, DataFrame], recipe: Recipe, order_by: str | None = None, filters: dict[str, object] | None = None, limit: int | None = None) -> DataFrame:
    df = tables[recipe.table]
    if recipe.kind == "joined_top":
        right = tables[recipe.join_table]
        keep = [c for c in right.columns if c not in df.columns or c == recipe.right_key]
        side = right.select(F.col(recipe.right_key).alias("_right_key"), *(c for c in keep if c not in df.columns))
        df = df.join(side, F.col(recipe.left_key) == F.col("_right_key"), "left").drop("_right_key")
    order = order_by or recipe.order_columns[0]
    if order not in recipe.order_columns:
        raise ValueError(f"{recipe.name} can't be ordered by {order}")
    for k in filters or {}:
        if k not in recipe.filter_columns:
            raise ValueError(f"{recipe.name} can't be filtered by {k}")
    for k, v in (recipe.default_filters | (filters or {})).items():
        df = df.filter(F.col(k) == v)
    return df.select(*recipe.columns).orderBy(F.col(order).desc_nulls_last()).limit(recipe_limit(limit, recipe.default_limit, recipe.max_limit))


def by_tag(recipes: list[Recipe], tag: str) -> list[Recipe]:
    return [r for r in recipes if tag in r.tags]
