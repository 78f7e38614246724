"""Staging views: SQL rendered from parameters, created level by level, skipped while unchanged."""

from __future__ import annotations

import hashlib
import re
from typing import Any

from pyspark.sql import SparkSession

from ..model import StagingView
from .readers import materialize_view, table_name, view_exists, write_table

STATE_TABLE = "actflow_state"

_NAME = re.compile(r"\{\{\s*(\w+)\s*\}\}")


def render_sql(view: StagingView) -> str:
    """The SQL with every {{ name }} replaced; an unknown name is an error."""

    def value(m: re.Match) -> str:
        if m[1] not in view.sql_params:
            raise KeyError(f"{view.name}: no parameter {m[1]}")
        return str(view.sql_params[m[1]])

    return _NAME.sub(value, view.sql)


def content_hash(view: StagingView) -> str:
    """Of the rendered SQL, white space apart."""
    return hashlib.sha256(" ".join(render_sql(view).split()).encode()).hexdigest()


def staging_levels(views: list[StagingView]) -> list[list[StagingView]]:
    left, done, levels = {v.name: v for v in views}, set(), []
    for v in views:
        for d in v.depends_on:
            if d not in left:
                raise ValueError(f"{v.name} depends on unknown view {d}")
    while left:
        level = [v for v in left.values() if done.issuperset(v.depends_on)]
        if not level:
            raise ValueError(f"views depend on one another in a cycle: {', '.join(left)}")
        levels.append(level)
        for v in level:
            done.add(v.name)
            del left[v.name]
    return levels


def materialize_staging(spark: SparkSession, views: list[StagingView], state: dict[str, str] | None = None, shadowed: set[str] = frozenset(), lasting: bool = False) -> dict[str, list[str]]:
    """Creates views that changed; ``state`` maps names to hashes and is brought up to date.

    With ``lasting``, views go to their dataset in the catalog and the state to a table beside them; SQL may then
    read no views of the session.
    """
    if len({(v.project, v.dataset) for v in views}) > 1:
        raise ValueError("staging views of one run share project and dataset")
    if lasting and views:
        state = load_state(spark, views[0].dataset) | (state or {})
    state = {} if state is None else state
    report: dict[str, list[str]] = {"created": [], "skipped": [], "shadowed": []}
    for level in staging_levels(views):
        for v in level:
            if v.name in shadowed:
                report["shadowed"].append(v.name)
            elif state.get(v.name) == content_hash(v) and view_exists(spark, v.name, v.dataset if lasting else None):
                report["skipped"].append(v.name)
            else:
                materialize_view(spark, v.name, render_sql(v), v.dataset if lasting else None)
                state[v.name] = content_hash(v)
                report["created"].append(v.name)
    if lasting and report["created"]:
        write_table(spark.createDataFrame(state_rows(state), "name string, hash string").coalesce(1), views[0].dataset, STATE_TABLE)
    return report


def load_state(spark: SparkSession, dataset: str) -> dict[str, str]:
    """Hashes by view, one row for each declared view."""
    name = table_name(None, dataset, STATE_TABLE)
    return dict(map(tuple, spark.table(name).select("name", "hash").collect())) if spark.catalog.tableExists(name) else {}


def state_rows(state: dict[str, str]) -> list[dict[str, Any]]:
    return [{"name": k, "hash": v} for k, v in sorted(state.items())]
