"""Declarations: sources, activities, identity graphs, entities, metrics models."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column


def _filled(**values: Any) -> None:
    for name, v in values.items():
        if not v:
            raise ValueError(f"{name} must not be empty")


@dataclass(frozen=True)
class ComputedColumn:
    name: str
    expression: str | Column


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    description: str | None = None
    nullable: bool = True
    json_path: str | None = None
    source_column: str | None = None


@dataclass(frozen=True)
class TypeCast:
    field: str
    target_type: str


@dataclass(frozen=True)
class Rename:
    from_name: str
    to_name: str


@dataclass(frozen=True)
class Divide:
    field: str
    divisor: float
    target_type: str = "decimal"
    suffix: str = "_amount"


@dataclass(frozen=True)
class Multiply:
    field: str
    multiplier: float
    target_type: str = "decimal"
    suffix: str = "_value"


@dataclass(frozen=True)
class Join:
    """A left join to the state source ``source_name`` on ``join_key`` = its id field."""

    source_name: str
    join_key: str


@dataclass(frozen=True)
class SourceTransforms:
    type_casts: list[TypeCast] = field(default_factory=list)
    renames: list[Rename] = field(default_factory=list)
    divides: list[Divide] = field(default_factory=list)
    multiplies: list[Multiply] = field(default_factory=list)


@dataclass(frozen=True)
class StagingView:
    """A named SQL view; ``{{ name }}`` in the SQL is replaced by the parameter of that name."""

    name: str
    project: str
    dataset: str
    sql: str
    sql_params: dict[str, Any] = field(default_factory=dict)
    depends_on: list[str] = field(default_factory=list)
    description: str | None = None
    tags: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        _filled(name=self.name, project=self.project, dataset=self.dataset, sql=self.sql)


@dataclass(frozen=True)
class TableSource:
    """Where rows come from: a parquet path, a table of a catalog, or a staging view upstream."""

    project: str | None = None
    dataset: str | None = None
    table: str | None = None
    path: str | None = None
    fixture_is_transformed: bool = False
    upstream: StagingView | None = None
    filter: str | None = None
    transforms: SourceTransforms | None = None
    fields: list[Field] | None = None

    def __post_init__(self) -> None:
        if self.upstream and getattr(self, "joins", None):
            raise ValueError("a source with an upstream view can't have joins; join in the view's SQL")
        if not (self.path or self.table or self.upstream):
            raise ValueError("a source needs a path, a table or an upstream view")
        if self.filter is not None and not self.filter.strip():
            raise ValueError("filter must not be empty")


@dataclass(frozen=True)
class StateSource(TableSource):
    """A snapshot of current state, one row for each ``id_field``."""

    name: str = ""
    id_field: str = ""
    full_refresh: bool = False
    computed_columns: list[ComputedColumn] = field(default_factory=list)
    joins: list[Join] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__post_init__()
        _filled(name=self.name, id_field=self.id_field)


@dataclass(frozen=True)
class EventSource(TableSource):
    """Events that are only appended. The type is fixed, or in a column, or else the source's name."""

    name: str = ""
    entity_id_field: str = ""
    timestamp_field: str = ""
    event_type: str | None = None
    event_type_field: str | None = None
    computed_columns: list[ComputedColumn] = field(default_factory=list)
    payload_exclude: list[str] = field(default_factory=list)
    joins: list[Join] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__post_init__()
        _filled(name=self.name, entity_id_field=self.entity_id_field, timestamp_field=self.timestamp_field)
        if self.event_type and self.event_type_field:
            raise ValueError("event_type and event_type_field exclude each other")


@dataclass(frozen=True)
class RowAppeared:
    pass


@dataclass(frozen=True)
class RowDisappeared:
    pass


@dataclass(frozen=True)
class FieldChanged:
    field: str
    from_values: list[str] | None = None
    to_values: list[str] | None = None


@dataclass(frozen=True)
class EventOccurred:
    event_type: str | None = None


@dataclass(frozen=True)
class ActivityDefinition:
    name: str
    source: str
    trigger: RowAppeared | RowDisappeared | FieldChanged | EventOccurred
    entity_id_field: str = "entity_id"
    person_id_field: str | None = None
    include_fields: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        _filled(name=self.name, source=self.source)


@dataclass(frozen=True)
class IdentitySource:
    source: str
    id_field: str
    match_key_field: str


@dataclass(frozen=True)
class IdentityGraph:
    name: str
    canonical_id: str
    sources: list[IdentitySource]
    resolution_strategy: str = "match_key"

    def __post_init__(self) -> None:
        if len(self.sources) < 2:
            raise ValueError("an identity graph links two sources at least")


@dataclass(frozen=True)
class StateField:
    """``type`` is a Spark type to cast to; without one the value is text."""

    name: str
    source: str
    field: str
    strategy: str = "latest"
    priority: list[str] | None = None
    type: str | None = None

    def __post_init__(self) -> None:
        if self.strategy not in ("latest", "first", "coalesce"):
            raise ValueError(f"unknown strategy {self.strategy}")
        if self.strategy == "coalesce" and not self.priority:
            raise ValueError("coalesce needs a priority of sources")


@dataclass(frozen=True)
class Measure:
    name: str
    activity: str
    aggregation: str
    field: str | None = None
    type: str | None = None

    def __post_init__(self) -> None:
        if self.aggregation not in ("count", "sum", "latest"):
            raise ValueError(f"unknown aggregation {self.aggregation}")
        if self.aggregation != "count" and not self.field:
            raise ValueError(f"{self.aggregation} needs a field")


@dataclass(frozen=True)
class PropertyBag:
    name: str
    source: str
    field: str
    discoverable: bool = True


@dataclass(frozen=True)
class AnalyticsEntity:
    name: str
    identity_graph: str | None = None
    state_fields: list[StateField] = field(default_factory=list)
    property_bags: list[PropertyBag] = field(default_factory=list)
    measures: list[Measure] = field(default_factory=list)
    computed_fields: list[ComputedColumn] = field(default_factory=list)
    quality_checks: list[Any] = field(default_factory=list)
    materialization: str = "parquet"
    project: str | None = None
    dataset: str | None = None
    table: str | None = None

    def __post_init__(self) -> None:
        names = [x.name for x in (*self.state_fields, *self.measures, *self.computed_fields)]
        if len(set(names)) < len(names):
            raise ValueError(f"{self.name}: field names repeat")


@dataclass(frozen=True)
class MetricField:
    field_name: str
    aggregation: str
    distinct_field: str | None = None

    def __post_init__(self) -> None:
        if self.aggregation not in ("sum_delta", "last_value", "max_value", "count", "count_distinct"):
            raise ValueError(f"unknown aggregation {self.aggregation}")
        if (self.aggregation == "count_distinct") != bool(self.distinct_field):
            raise ValueError("distinct_field goes with count_distinct")

    @property
    def output_name(self) -> str:
        return f"{self.field_name}_{self.aggregation}"


@dataclass(frozen=True)
class MetricsModel:
    name: str
    sources: list[str]
    grain: str
    metric_fields: list[MetricField]
    dimensions: list[str] = field(default_factory=list)
    materialization: str = "parquet"
    project: str | None = None
    dataset: str | None = None
    table: str | None = None

    def __post_init__(self) -> None:
        if self.grain not in ("hourly", "daily", "weekly", "monthly"):
            raise ValueError(f"unknown grain {self.grain}")
        _filled(sources=self.sources, metric_fields=self.metric_fields)
