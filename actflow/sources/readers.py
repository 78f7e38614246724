"""Scans, sinks and SQL over a session."""

from __future__ import annotations

import os
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..model import TableSource


class SourceNotFoundError(FileNotFoundError):
    pass


def session(backend: str = "spark", **config: Any) -> SparkSession:
    """A session for a backend: spark, or a warehouse reached through a catalog or JDBC that ``config`` sets up."""
    if backend not in ("spark", "duckdb", "bigquery", "clickhouse"):
        raise ValueError(f"unknown backend {backend}")
    builder = SparkSession.builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in config.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def resolve_path(path: str, data_dir: str | None = None) -> str:
    path = os.path.expanduser(path)
    if "://" in path or os.path.isabs(path) or not data_dir:
        return path
    return f"{data_dir.rstrip('/')}/{path}"


def read_parquet(spark: SparkSession, path: str, data_dir: str | None = None) -> DataFrame:
    full = resolve_path(path, data_dir)
    try:
        return spark.read.parquet(full)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise SourceNotFoundError(full) from e
        raise


def table_name(project: str | None, dataset: str | None, table: str, backend: str = "spark") -> str:
    """Where a table lives: dataset.table, project.dataset.table, or dataset___table in a project."""
    if backend == "clickhouse":
        return ".".join(f"`{x}`" for x in (project, f"{dataset}___{table}" if dataset else table) if x)
    return ".".join(f"`{x}`" for x in (project, dataset, table) if x)


def read_source(spark: SparkSession, source: TableSource, data_dir: str | None = None, backend: str = "spark") -> DataFrame:
    if source.path:
        return read_parquet(spark, source.path, data_dir)
    if source.upstream:
        view = source.upstream
        return spark.table(view.name if backend == "spark" else table_name(view.project, view.dataset, view.name, backend))
    return spark.table(table_name(source.project if backend != "spark" else None, source.dataset, source.table, backend))


def register_parquet(spark: SparkSession, name: str, path: str, data_dir: str | None = None) -> None:
    read_parquet(spark, path, data_dir).createOrReplaceTempView(name)


def write_parquet(df: DataFrame, output_dir: str, name: str) -> str:
    path = f"{output_dir.rstrip('/')}/{name}.parquet"
    df.write.mode("overwrite").parquet(path)
    return path


def write_table(df: DataFrame, dataset: str, name: str, project: str | None = None) -> str:
    """Replaces the table, in the catalog ``project`` if given, with its database created if it is missing."""
    df.sparkSession.sql(f"CREATE DATABASE IF NOT EXISTS {table_name(None, project, dataset)}")
    full = table_name(project, dataset, name)
    df.write.mode("overwrite").option("overwriteSchema", "true").saveAsTable(full)
    return full.replace("`", "")


def materialize_view(spark: SparkSession, name: str, sql: str, dataset: str | None = None) -> None:
    """A view of the session, or of the catalog in ``dataset``: that one lasts as long as the catalog does."""
    if dataset is None:
        spark.sql(sql).createOrReplaceTempView(name)
        return
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{dataset}`")
    spark.sql(f"CREATE OR REPLACE VIEW {table_name(None, dataset, name)} AS {sql}")


def view_exists(spark: SparkSession, name: str, dataset: str | None = None) -> bool:
    return spark.catalog.tableExists(table_name(None, dataset, name))


def drop_view(spark: SparkSession, name: str, dataset: str | None = None) -> None:
    if dataset is None:
        spark.catalog.dropTempView(name)
    elif spark.catalog.databaseExists(dataset):
        spark.sql(f"DROP VIEW IF EXISTS {table_name(None, dataset, name)}")


def execute_parameterized(spark: SparkSession, sql: str, params: dict[str, Any] | None = None) -> DataFrame:
    """SQL with @name parameters; Python values give their types."""
    import re

    if not params:
        return spark.sql(sql)
    named = re.sub(r"@(" + "|".join(map(re.escape, sorted(params, key=len, reverse=True))) + r")\b", r":\1", sql)
    return spark.sql(named, args=params)


def execute_query(spark: SparkSession, sql: str) -> list:
    return spark.sql(sql).collect()
