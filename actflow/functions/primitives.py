"""Scalar, aggregate and window primitives as columns."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Domains of personal mail.
PERSONAL_DOMAINS = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com", "aol.com", "protonmail.com", "mail.com")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# hashes
def hash_email(c) -> Column:
    return F.sha2(F.trim(F.lower(_c(c))), 256)


def hash_id(c, salt: str = "") -> Column:
    return F.sha2(F.concat(_c(c).cast("string"), F.lit(salt)), 256)


def hash_sha256(c) -> Column:
    return F.sha2(_c(c), 256)


def hash_md5(c) -> Column:
    return F.md5(_c(c))


def concat_hash(*cs) -> Column:
    return F.sha2(F.concat(*(F.coalesce(_c(c).cast("string"), F.lit("")) for c in cs)), 256)


# dates
def date_diff_days(start, end=None) -> Column:
    return F.datediff(F.current_date() if end is None else _c(end), _c(start))


def days_since(c, today=None) -> Column:
    return date_diff_days(c, today)


def date_trunc_month(c) -> Column:
    return F.date_trunc("month", _c(c))


def date_trunc_quarter(c) -> Column:
    return F.date_trunc("quarter", _c(c))


def date_trunc_year(c) -> Column:
    return F.date_trunc("year", _c(c))


def extract_year(c) -> Column:
    return F.year(_c(c))


def extract_month(c) -> Column:
    return F.month(_c(c))


def extract_day(c) -> Column:
    return F.dayofmonth(_c(c))


def _date(text: str) -> Column:
    return F.lit(text).cast("date")


def earliest_date(*cs) -> Column:
    """Nulls count as 9999-12-31, which is the result if all are null."""
    all_ = [F.coalesce(_c(c).cast("date"), _date("9999-12-31")) for c in cs]
    return F.least(*all_) if len(all_) > 1 else all_[0]


def latest_date(*cs) -> Column:
    """Nulls count as 1970-01-01, which is the result if all are null."""
    all_ = [F.coalesce(_c(c).cast("date"), _date("1970-01-01")) for c in cs]
    return F.greatest(*all_) if len(all_) > 1 else all_[0]


# categories
def case(cases: list[tuple[Column, object]], default: object = None) -> Column:
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return F.lit(default) if out is None else out.otherwise(default)


def categorize(c, thresholds: list[tuple[float, str]], default: str) -> Column:
    """The label of the first threshold that the value is below."""
    return case([(_c(c) < t, label) for t, label in thresholds], default)


def categorize_contains(c, categories: dict[str, list[str]], default: str) -> Column:
    low = F.lower(F.coalesce(_c(c), F.lit("")))
    return case([(contains_any(low, [p.lower() for p in patterns]), k) for k, patterns in categories.items()], default)


def lifecycle_flag(c, states: list[str]) -> Column:
    return _c(c).isin(states)


def boolean_to_int(c) -> Column:
    return _c(c).cast("bigint")


def contains_any(c, values: list[str]) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | F.coalesce(_c(c).contains(v), F.lit(False))
    return out


def isin_literal(c, values: list) -> Column:
    return _c(c).isin(values)


# JSON
def to_json_struct(items: dict[str, Column | str]) -> Column:
    return F.to_json(F.struct(*(_c(c).alias(k) for k, c in items.items())), {"ignoreNullFields": "false"})


def json_extract_scalar(c, path: str) -> Column:
    """The scalar at a path as text; null for objects and arrays."""
    x = F.try_variant_get(F.try_parse_json(_c(c)), path, "variant")
    scalar = ~F.schema_of_variant(x).rlike("^(OBJECT|ARRAY)")
    return F.when(scalar, F.try_variant_get(x, "$", "string"))


json_value = json_extract_scalar


def json_extract_string(c, key: str) -> Column:
    x = F.try_variant_get(F.try_parse_json(_c(c)), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise("")


def json_extract_bool(c, key: str) -> Column:
    x = F.try_variant_get(F.try_parse_json(_c(c)), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean")).otherwise(False)


def json_extract_raw(c, key: str) -> Column:
    return F.coalesce(F.to_json(F.try_variant_get(F.try_parse_json(_c(c)), f"$.{key}", "variant")), F.lit(""))


clickhouse_json_extract_string, clickhouse_json_extract_bool, clickhouse_json_extract_raw = json_extract_string, json_extract_bool, json_extract_raw


# windows
def _window(partition, order=(), descending: bool = False):
    many = lambda x: [x] if isinstance(x, str | Column) else list(x)
    w = Window.partitionBy(*map(_c, many(partition)))
    return w.orderBy(*((_c(o).desc() if descending else _c(o)) for o in many(order))) if many(order) else w


def row_number_by(partition, order) -> Column:
    return F.row_number().over(_window(partition, order))


def dedup_by(partition, order, descending: bool = True) -> Column:
    """A row's number in its partition, from 0."""
    return F.row_number().over(_window(partition, order, descending)) - 1


def cumulative_sum(c, partition, order) -> Column:
    return F.sum(_c(c)).over(_window(partition, order).rowsBetween(Window.unboundedPreceding, 0))


def lag_value(c, partition, order, offset: int = 1) -> Column:
    return F.lag(_c(c), offset).over(_window(partition, order))


def lead_value(c, partition, order, offset: int = 1) -> Column:
    return F.lead(_c(c), offset).over(_window(partition, order))


def first_value(c, partition, order) -> Column:
    return F.first(_c(c)).over(_window(partition, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def last_value(c, partition, order) -> Column:
    return F.last(_c(c)).over(_window(partition, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


first_value_by, last_value_by = first_value, last_value


# aggregates
def sum_(c) -> Column:
    return F.sum(_c(c))


def count_(c="*") -> Column:
    return F.count(c)


def count_distinct(c) -> Column:
    return F.count_distinct(_c(c))


def avg_(c) -> Column:
    return F.avg(_c(c))


def min_(c) -> Column:
    return F.min(_c(c))


def max_(c) -> Column:
    return F.max(_c(c))


def any_value(c) -> Column:
    return F.any_value(_c(c))


# strings
def extract_email_domain(c) -> Column:
    return F.split_part(_c(c), F.lit("@"), F.lit(2))


def is_personal_email_domain(c) -> Column:
    return _c(c).isin(*PERSONAL_DOMAINS)


def account_id_from_domain(c) -> Column:
    """Null for a personal domain; else the MD5 of the domain."""
    return F.when(is_personal_email_domain(c), F.lit(None).cast("string")).otherwise(F.md5(_c(c)))


def parse_iso8601_duration(c) -> Column:
    """Seconds of PT..H..M..S; 0 where nothing matches, null for null."""
    part = lambda unit: F.coalesce(F.regexp_extract(_c(c), rf"(\d+){unit}", 1).try_cast("bigint"), F.lit(0))
    return F.when(_c(c).isNotNull(), part("H") * 3600 + part("M") * 60 + part("S"))


# components
def lifecycle_flags(status, active: list[str], churned: list[str], at_risk: list[str] | None = None) -> dict[str, Column]:
    out = {"is_active": lifecycle_flag(status, active), "is_churned": lifecycle_flag(status, churned)}
    return out | ({"is_at_risk": lifecycle_flag(status, at_risk)} if at_risk else {})


def time_based_metrics(created, updated=None, today=None) -> dict[str, Column]:
    out = {"days_since_created": days_since(created, today), "created_month": date_trunc_month(created), "created_year": extract_year(created)}
    if updated is not None:
        out |= {"days_since_updated": days_since(updated, today), "days_between_created_and_updated": date_diff_days(created, updated)}
    return out


def data_quality_flags(checks: dict[str, str]) -> dict[str, Column]:
    """``has_<name>`` of SQL expressions."""
    return {f"has_{k}": F.expr(v) for k, v in checks.items()}


def component_measures(measures: dict[str, str]) -> list[Column]:
    """Aggregates from SQL expressions."""
    return [F.expr(v).alias(k) for k, v in measures.items()]
