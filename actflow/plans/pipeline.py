"""Running declared assets: staging, sources, events, activities, identities, entities, metrics, output."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..model import AnalyticsEntity, EventSource, MetricsModel, StateSource
from ..operators.activities import apply_activities
from ..operators.diff import snapshot_diff
from ..operators.entity import project_entity
from ..operators.events import concat_events, empty_events, events_of
from ..operators.identity import enrich_events, resolve_identities
from ..operators.metrics import aggregate_metrics
from ..operators.quality import EntityResult, QualityRunner
from ..sources.readers import read_source, write_parquet, write_table
from ..sources.snapshots import SnapshotStore
from ..sources.stage import build_stage, join_levels
from ..sources.staging import materialize_staging
from .policy import assert_supported
from .pruning import fields_read, raw_columns
from .registry import Registry


@dataclass
class RunResult:
    outputs: dict[str, str] = field(default_factory=dict)
    quality: dict[str, EntityResult] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)
    timings: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def phase(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.timings[name] = self.timings.get(name, 0.0) + time.perf_counter() - began


class Pipeline:
    def __init__(self, spark: SparkSession, assets: dict[str, Registry], data_dir: str, output_dir: str, snapshot_dir: str, run_date: str, shadowed: set[str] = frozenset(), check_quality: bool = False, parallel: int = 4):
        self.spark, self.assets, self.data_dir, self.output_dir, self.run_date = spark, assets, data_dir, output_dir, run_date
        self.store, self.shadowed, self.check_quality = SnapshotStore(spark, snapshot_dir), shadowed, check_quality
        self.parallel = parallel
        self.staged: dict[str, DataFrame] = {}
        self.view_state: dict[str, str] = {}

    def sources(self) -> list[StateSource | EventSource]:
        return [*self.assets["state_sources"], *self.assets["event_sources"]]

    def load(self) -> DataFrame:
        """All sources' events, in order of their joins."""
        by_name = {s.name: s for s in self.sources()}
        parts, read = [], fields_read(self.assets)
        for level in join_levels(list(by_name.values())):

            def one(name: str) -> DataFrame:
                s = by_name[name]
                raw = read_source(self.spark, s, self.data_dir)
                self.staged[name] = table = build_stage(raw, s, lambda n: (by_name[n], self.staged[n]), raw_columns(s, read[name]))
                return events_of(table, s) if isinstance(s, EventSource) else snapshot_diff(self.store, table, s.name, s.id_field, self.run_date, full_refresh=s.full_refresh)

            parts += self.each(one, level)
        return concat_events(parts) if parts else empty_events(self.spark)

    def each(self, work: Callable[[Any], Any], items: Iterable[Any]) -> list[Any]:
        """Results in order. Jobs that don't wait for one another are sent at once, so that none leaves the cluster idle."""
        with ThreadPoolExecutor(self.parallel) as pool:
            return list(pool.map(work, items))

    def run(self) -> RunResult:
        """Staging, activity and identity failures are reported and the run goes on; others end it."""
        assert_supported(self.assets)
        out = RunResult()
        with out.phase("staging"):
            try:
                materialize_staging(self.spark, self.assets["staging_views"].all(), self.view_state, self.shadowed)
            except Exception as e:
                out.errors.append(f"staging: {e}")
        with out.phase("sources"):
            events = self.load()
        with out.phase("activities"):
            try:
                events = apply_activities(events, self.assets["activities"].all())
            except Exception as e:
                out.errors.append(f"activities: {e}")
        with out.phase("identity"):
            for g in self.assets["identity_graphs"]:
                try:
                    events = enrich_events(events, resolve_identities(events, g))
                except Exception as e:
                    out.errors.append(f"identity {g.name}: {e}")
        # Every model reads these events: they are kept once, on disk where memory is short.
        events = events.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            with out.phase("entities"):
                made = {e.name: project_entity(events, e) for e in self.assets["entities"]}
                out.outputs |= zip(made, self.each(lambda e: self.write(e, made[e.name]), self.assets["entities"]))
                for e in self.assets["entities"]:
                    df = made[e.name]
                    if self.check_quality and e.quality_checks:
                        out.quality[e.name] = QualityRunner(self.staged).run_entity(e.name, df, e.quality_checks)
            with out.phase("metrics"):
                models = self.assets["metrics_models"].all()
                out.outputs |= zip((m.name for m in models), self.each(lambda m: self.write(m, aggregate_metrics(events, m)), models))
        finally:
            events.unpersist()
        return out

    def write(self, model: AnalyticsEntity | MetricsModel, df: DataFrame) -> str:
        if model.materialization == "table":
            return write_table(df, model.dataset or "default", model.table or model.name, getattr(model, "project", None))
        return write_parquet(df, self.output_dir, model.name)
