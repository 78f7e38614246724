"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: the tables; BENCH_CPUS: local threads. Each query runs once to warm up and then
``RUNS`` times; the median counts. Results are written to Spark's noop sink, so that every row and column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from actflow.model import AnalyticsEntity, Measure, StateField
from actflow.operators.entity import project_entity
from actflow.plans.queries import QUERIES

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3
HEADLINE = ["e_measures", "e_state_fields", "d_snapshot_diff", "d_concat", "a_events", "i_enriched_stream", "m_daily", "m_hourly", "m_state_changes", "q_group_filter_order", "j_chain", "c_unique", "f_windows"]


def timed(run) -> float:
    run().write.format("noop").mode("overwrite").save()
    took = []
    for _ in range(RUNS):
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return round(median(took), 4)


def projection_events(spark: SparkSession, n: int):
    """n events of 1000 entities: appearances with a few fields, and purchases."""
    i = F.col("id")
    state = F.to_json(F.struct(F.concat(F.lit("name"), i % 1000).alias("name"), (i % 7).alias("plan"), (i * 0.5).alias("score")))
    bought = F.to_json(F.struct((i % 100).alias("amount")))
    appeared = i % 2 == 0
    return spark.range(n).select(
        F.lit("crm").alias("source"), (F.floor(i / 2) % 1000).cast("string").alias("entity_id"), F.date_format(F.timestamp_seconds(i), "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.when(appeared, "row_appeared").otherwise("purchase").alias("event_type"), F.when(appeared, state).otherwise(bought).alias("payload"),
    ).cache()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {name: timed(lambda f=QUERIES[name]: f(spark, SF)) for name in HEADLINE}
    entity = AnalyticsEntity(
        "e", state_fields=[StateField(k, "crm", k, s) for k, s in (("name", "latest"), ("plan", "first"), ("score", "latest"))], measures=[Measure("purchases", "purchase", "count"), Measure("spent", "purchase", "sum", "amount")]
    )
    for n in (1_000, 10_000, 50_000):
        events = projection_events(spark, n)
        events.count()
        times[f"projection_{n // 1000}k"] = timed(lambda: project_entity(events, entity))
        events.unpersist()
    # Larger streams show the time an event; they aren't part of the total.
    scaling = {}
    for n in (1_000_000, 10_000_000):
        events = projection_events(spark, n)
        events.count()
        scaling[f"projection_{n // 1_000_000}m"] = timed(lambda: project_entity(events, entity))
        events.unpersist()
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "scaling": scaling, "sf": float(SF.rstrip("/").rsplit("sf", 1)[-1]) if "sf" in SF else None}))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
