"""Dated snapshots of state sources: {base}/{source}/{date}.parquet."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_DATE = re.compile(r"^(\d{4}-\d{2}-\d{2}(?:T\d{2}-\d{2}-\d{2})?)\.parquet$")


class SnapshotStore:
    """Works on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def path(self, source: str, date: str) -> str:
        if not _DATE.match(f"{date}.parquet"):
            raise ValueError(f"{date!r} is no snapshot date")
        return f"{self.base}/{source}/{date}.parquet"

    def dates(self, source: str) -> list[str]:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{source}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(m[1] for n in names if (m := _DATE.match(n)))

    def save(self, source: str, date: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.path(source, date))

    def load(self, source: str, date: str) -> DataFrame | None:
        return self.spark.read.parquet(self.path(source, date)) if date in self.dates(source) else None

    def get_previous(self, source: str, date: str) -> DataFrame | None:
        """The newest snapshot before the date."""
        earlier = [d for d in self.dates(source) if d < date]
        return self.spark.read.parquet(self.path(source, earlier[-1])) if earlier else None
