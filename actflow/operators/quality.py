"""Data-quality checks: the rows that fail, or for uniqueness the groups that repeat."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 10


def _any(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cs)


@dataclass(frozen=True)
class QualityCheck:
    def failing(self, df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
        return df.filter(F.coalesce(self.condition(), F.lit(False)))

    def condition(self) -> Column:
        raise NotImplementedError


@dataclass(frozen=True, init=False)
class NotNull(QualityCheck):
    columns: tuple[str, ...]

    def __init__(self, *columns: str):
        object.__setattr__(self, "columns", columns)

    def condition(self) -> Column:
        return _any([F.col(c).isNull() for c in self.columns])


@dataclass(frozen=True, init=False)
class NotEmpty(QualityCheck):
    columns: tuple[str, ...]

    def __init__(self, *columns: str):
        object.__setattr__(self, "columns", columns)

    def condition(self) -> Column:
        return _any([F.col(c).isNull() | (F.trim(F.col(c)) == "") for c in self.columns])


def _bound(x: Any) -> Column:
    return F.expr(x) if isinstance(x, str) else F.lit(x)


@dataclass(frozen=True)
class InRange(QualityCheck):
    """Bounds given as text are SQL. Nulls pass."""

    column: str
    min: Any = None
    max: Any = None

    def condition(self) -> Column:
        c, out = F.col(self.column), F.lit(False)
        if self.min is not None:
            out = out | (c < _bound(self.min))
        return out if self.max is None else out | (c > _bound(self.max))


@dataclass(frozen=True)
class InSet(QualityCheck):
    column: str
    values: list

    def condition(self) -> Column:
        return ~F.col(self.column).isin(self.values)


@dataclass(frozen=True)
class MatchesPattern(QualityCheck):
    """The pattern occurs in the value. Nulls pass."""

    column: str
    pattern: str

    def condition(self) -> Column:
        return ~F.col(self.column).rlike(self.pattern)


@dataclass(frozen=True)
class ForeignKey(QualityCheck):
    column: str
    references: str  # table.column

    def failing(self, df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
        name, key = self.references.split(".")
        other = tables[name].select(F.col(key).alias("_fk"))
        return df.filter(F.col(self.column).isNotNull()).join(other, F.col(self.column) == F.col("_fk"), "left_anti")


@dataclass(frozen=True, init=False)
class Unique(QualityCheck):
    columns: tuple[str, ...]

    def __init__(self, *columns: str):
        object.__setattr__(self, "columns", columns)

    def failing(self, df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
        n = "n"
        while n in self.columns:
            n += "_"
        return df.groupBy(*self.columns).agg(F.count("*").alias(n)).filter(F.col(n) > 1)


@dataclass(frozen=True)
class MaxAge(QualityCheck):
    """The newest value is at most ``days`` old; ``today`` is a date, the current one by default."""

    column: str
    days: int
    today: str | None = None

    def failing(self, df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
        today = F.lit(self.today).cast("date") if self.today else F.current_date()
        newest = df.agg(F.max(self.column).cast("date").alias("newest"))
        return newest.filter(F.datediff(today, "newest") > self.days)


@dataclass(frozen=True)
class CustomSQL(QualityCheck):
    name: str
    sql: str

    def condition(self) -> Column:
        return F.expr(f"NOT ({self.sql})")


@dataclass
class CheckResult:
    check: str
    passed: bool
    failures: int
    sample: list[dict] = field(default_factory=list)
    error: str | None = None


@dataclass
class EntityResult:
    entity: str
    results: list[CheckResult]

    @property
    def passed(self) -> bool:
        return all(r.passed for r in self.results)

    @property
    def counts(self) -> tuple[int, int]:
        good = sum(r.passed for r in self.results)
        return good, len(self.results) - good


class QualityRunner:
    def __init__(self, tables: dict[str, DataFrame] | None = None):
        self.tables = tables or {}

    def check(self, df: DataFrame, c: QualityCheck) -> CheckResult:
        """A sample of what fails; the exact count only where the sample is full."""
        try:
            bad = c.failing(df, self.tables)
            sample = [r.asDict() for r in bad.limit(SAMPLE).collect()]
            n = bad.count() if len(sample) == SAMPLE else len(sample)
            return CheckResult(type(c).__name__, n == 0, n, sample)
        except Exception as e:  # a check that can't run is a failed check
            return CheckResult(type(c).__name__, False, 0, [], str(e)[:500])

    def run_entity(self, name: str, df: DataFrame, checks: list[QualityCheck]) -> EntityResult:
        return EntityResult(name, [self.check(df, c) for c in checks])


def column_report(df: DataFrame, not_null: list[str] = (), unique: list[str] = ()) -> DataFrame:
    """check, column, failures: nulls, and rows less distinct values (a null is no value). One pass for all."""
    one = lambda kind, c, n: F.struct(F.lit(kind).alias("check"), F.lit(c).alias("column"), n.cast("long").alias("failures"))
    parts = [one("not_null", c, F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0))) for c in not_null]
    parts += [one("unique", c, F.count("*") - F.count_distinct(c)) for c in unique]
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))
