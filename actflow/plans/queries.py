"""One query for each operator over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import primitives as p
from ..functions.expressions import evaluate_expression
from ..model import (
    ActivityDefinition, AnalyticsEntity, ComputedColumn, Divide, EventOccurred, EventSource, Field, FieldChanged, IdentityGraph, IdentitySource, Join, Measure, MetricField, MetricsModel, Multiply,
    PropertyBag, Rename, RowAppeared, RowDisappeared, SourceTransforms, StagingView, StateField, StateSource, TableSource, TypeCast,
)
from ..operators import quality as q
from ..operators.activities import apply_activities
from ..operators.diff import appeared, diff_snapshots, snapshot_diff
from ..operators.entity import project_entity
from ..operators.events import concat_events, events_of
from ..operators.identity import enrich_events, resolve_identities
from ..operators.insights import Recipe, top_rows
from ..operators.metrics import aggregate_metrics
from ..operators.query import build_query, catalog_of, discover_keys, load_model
from ..sources.readers import execute_parameterized, read_source, register_parquet, write_parquet
from ..sources.snapshots import SnapshotStore
from ..sources.stage import build_stage, join_levels
from ..sources.staging import materialize_staging
from .pruning import fields_read, raw_columns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workplace(spark: SparkSession) -> str:
    """A new folder that all executors see; a local master's goes when the process ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/actflow-{uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    folder = tempfile.mkdtemp(prefix="actflow-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def json(x, *keys: str):
    for k in keys:
        x = F.get_json_object(x, f"$.{k}")
    return x


# --- sources and events -------------------------------------------------------------------------------
APP = EventSource(path="events.parquet", name="app", entity_id_field="user_id", timestamp_field="ts", event_type_field="event_type")
SHOP = EventSource(path="orders.parquet", name="shop", entity_id_field="o_custkey", timestamp_field="o_orderdate", event_type="ordered", payload_exclude=["o_orderpriority", "no_such_column"])
NATION = StateSource(path="nation.parquet", name="nation", id_field="n_nationkey")
REGION = StateSource(path="region.parquet", name="region", id_field="r_regionkey")


def app_events(spark, d):
    return events_of(build_stage(read_source(spark, APP, d), APP), APP)


def crm_now(spark, d):
    """The customers as of today: some new, some gone, some changed."""
    k = F.col("c_custkey")
    rows = t(spark, d, "customer").filter(k % 50 != 1)
    return rows.withColumn("c_acctbal", F.when(k % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))).withColumn("c_mktsegment", F.when(k % 11 == 0, "MACHINERY").otherwise(F.col("c_mktsegment")))


def crm_before(spark, d):
    return t(spark, d, "customer").filter(F.col("c_custkey") % 10 != 0)


_NOW = "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 11 = 0 THEN 'MACHINERY' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 50 <> 1"
_BEFORE = "SELECT * FROM customer WHERE c_custkey % 10 <> 0"


def crm_events(spark, d):
    return diff_snapshots(crm_now(spark, d), crm_before(spark, d), "crm", "c_custkey", "2024-02-01")


_CHANGES = f"""now AS ({_NOW}), was AS ({_BEFORE}),
changes AS (
  SELECT n.c_custkey AS k, 'row_appeared' AS event_type, NULL AS field_name, NULL AS new_text, NULL::DOUBLE AS old_n, NULL::DOUBLE AS new_n FROM now n WHERE n.c_custkey NOT IN (SELECT c_custkey FROM was)
  UNION ALL SELECT w.c_custkey, 'row_disappeared', NULL, NULL, NULL, NULL FROM was w WHERE w.c_custkey NOT IN (SELECT c_custkey FROM now)
  UNION ALL SELECT n.c_custkey, 'field_changed', 'c_acctbal', NULL, w.c_acctbal, n.c_acctbal FROM now n JOIN was w USING (c_custkey) WHERE n.c_acctbal IS DISTINCT FROM w.c_acctbal
  UNION ALL SELECT n.c_custkey, 'field_changed', 'c_mktsegment', n.c_mktsegment, NULL, NULL FROM now n JOIN was w USING (c_custkey) WHERE n.c_mktsegment IS DISTINCT FROM w.c_mktsegment)"""


@query("SELECT r_regionkey, r_name FROM region")
def s_parquet_scan(spark, d):
    return read_source(spark, REGION, d).select("r_regionkey", "r_name")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000.0 AND o_orderpriority IS NOT NULL GROUP BY o_orderstatus")
def s_parameterized_sql(spark, d):
    t(spark, d, "orders").createOrReplaceTempView("_orders")
    return execute_parameterized(spark, "SELECT o_orderstatus, count(*) AS n FROM _orders WHERE o_totalprice > @least AND o_orderpriority IS NOT NULL GROUP BY o_orderstatus", {"least": 1000.0})


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
def s_register_parquet(spark, d):
    register_parquet(spark, "_suppliers", "supplier.parquet", d)
    return spark.sql("SELECT s_suppkey, s_name FROM _suppliers WHERE s_acctbal > 0")


@query("SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_acctbal > 1000 GROUP BY c_nationkey")
def s_staging_views(spark, d):
    register_parquet(spark, "_staged_customers", "customer.parquet", d)
    rich = StagingView("_stg_rich", "demo", "stg", "SELECT c_custkey, c_nationkey, c_acctbal FROM _staged_customers WHERE c_acctbal > {{ least }}", sql_params={"least": 1000})
    by_nation = StagingView("_stg_by_nation", "demo", "stg", "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM _stg_rich GROUP BY c_nationkey", depends_on=["_stg_rich"])
    materialize_staging(spark, [by_nation, rich])
    return read_source(spark, TableSource(upstream=by_nation))


@query(_NOW)
def s_snapshots(spark, d):
    store = SnapshotStore(spark, workplace(spark))
    store.save("crm", "2024-01-01", crm_before(spark, d))
    store.save("crm", "2024-02-01", crm_now(spark, d))
    store.save("crm", "2024-03-01", crm_before(spark, d))
    return store.get_previous("crm", "2024-03-01").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("SELECT user_id::VARCHAR AS entity_id, event_type, 'app' AS source, value, event_id FROM events")
def d_event_source(spark, d):
    e = app_events(spark, d)
    return e.select("entity_id", "event_type", "source", json(F.col("payload"), "value").cast("double").alias("value"), json(F.col("payload"), "event_id").cast("bigint").alias("event_id"))


@query("SELECT o_custkey::VARCHAR AS entity_id, 'ordered' AS event_type, o_orderkey, o_orderstatus, false AS has_priority FROM orders")
def d_payload_exclude(spark, d):
    e = events_of(t(spark, d, "orders"), SHOP)
    x = F.col("payload")
    return e.select("entity_id", "event_type", json(x, "o_orderkey").cast("bigint").alias("o_orderkey"), json(x, "o_orderstatus").alias("o_orderstatus"), json(x, "o_orderpriority").isNotNull().alias("has_priority"))


@query("SELECT vec_id::VARCHAR AS entity_id, len(embedding)::INT AS n, label FROM embeddings")
def d_nested_payload(spark, d):
    src = EventSource(path="x", name="vec", entity_id_field="vec_id", timestamp_field="label")
    e = events_of(t(spark, d, "embeddings").withColumn("l", F.col("label")), src)
    x = F.col("payload")
    return e.select("entity_id", F.size(F.from_json(json(x, "embedding"), "array<float>")).alias("n"), json(x, "l").cast("int").alias("label"))


@query("SELECT c_custkey::VARCHAR AS entity_id, 'row_appeared' AS event_type, c_name, c_nationkey FROM customer")
def d_row_appeared(spark, d):
    e = appeared(t(spark, d, "customer"), "crm", "c_custkey", "2024-02-01")
    x = F.col("payload")
    return e.select("entity_id", "event_type", json(x, "c_name").alias("c_name"), json(x, "c_nationkey").cast("int").alias("c_nationkey"))


@query(f"WITH {_CHANGES} SELECT k::VARCHAR AS entity_id, event_type, field_name, new_text, round(old_n, 2) AS old_n, round(new_n, 2) AS new_n FROM changes")
def d_snapshot_diff(spark, d):
    x = F.col("payload")
    name = json(x, "field_name")
    n = lambda k: F.when(name == "c_acctbal", F.round(json(x, k).cast("double"), 2))
    changed = F.col("event_type") == "field_changed"
    return crm_events(spark, d).select(
        "entity_id", "event_type", F.when(changed, name).alias("field_name"), F.when(name == "c_mktsegment", json(x, "new_value")).alias("new_text"), n("old_value").alias("old_n"), n("new_value").alias("new_n")
    )


@query(f"WITH now AS ({_NOW}), was AS ({_BEFORE}) SELECT w.c_custkey::VARCHAR AS entity_id, w.c_mktsegment FROM was w WHERE w.c_custkey NOT IN (SELECT c_custkey FROM now)")
def d_row_disappeared(spark, d):
    e = crm_events(spark, d).filter("event_type = 'row_disappeared'")
    return e.select("entity_id", json(F.col("payload"), "c_mktsegment").alias("c_mktsegment"))


@query("SELECT 'app' AS source, count(*) AS n FROM events UNION ALL SELECT 'shop', count(*) FROM orders UNION ALL SELECT 'nation', count(*) FROM nation")
def d_concat(spark, d):
    parts = [app_events(spark, d), events_of(t(spark, d, "orders"), SHOP), appeared(t(spark, d, "nation"), "nation", "n_nationkey", "2024-02-01")]
    return concat_events(parts).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT 'app' AS source, user_id::VARCHAR AS entity_id, event_type FROM events UNION ALL SELECT 'shop', o_custkey::VARCHAR, 'ordered' FROM orders UNION ALL SELECT 'nation', n_nationkey::VARCHAR, 'row_appeared' FROM nation")
def d_concat_rows(spark, d):
    parts = [app_events(spark, d), events_of(t(spark, d, "orders"), SHOP), appeared(t(spark, d, "nation"), "nation", "n_nationkey", "2024-02-01")]
    return concat_events(parts).select("source", "entity_id", "event_type")


def _second_load(spark, d, second, **options):
    """The events of a second load, after one of crm_before."""
    store = SnapshotStore(spark, workplace(spark))
    snapshot_diff(store, crm_before(spark, d), "crm", "c_custkey", "2024-01-01")
    e = snapshot_diff(store, second, "crm", "c_custkey", "2024-02-01", **options)
    x = F.col("payload")
    return e.select("entity_id", "ts", "event_type", json(x, "field_name").alias("field_name"), json(x, "c_mktsegment").alias("segment"))


@query(f"""WITH {_CHANGES} SELECT k::VARCHAR AS entity_id, '2024-02-01' AS ts, event_type, field_name,
  CASE event_type WHEN 'row_appeared' THEN n.c_mktsegment WHEN 'row_disappeared' THEN w.c_mktsegment END AS segment FROM changes LEFT JOIN now n ON n.c_custkey = k LEFT JOIN was w ON w.c_custkey = k""")
def d_second_load(spark, d):
    return _second_load(spark, d, crm_now(spark, d))


@query(f"WITH was AS ({_BEFORE}) SELECT c_custkey::VARCHAR AS entity_id, '2024-02-01' AS ts, 'row_appeared' AS event_type, NULL::VARCHAR AS field_name, c_mktsegment AS segment FROM was")
def d_replay_unchanged(spark, d):
    return _second_load(spark, d, crm_before(spark, d))


@query(f"WITH now AS ({_NOW}) SELECT c_custkey::VARCHAR AS entity_id, '2024-02-01' AS ts, 'row_appeared' AS event_type, NULL::VARCHAR AS field_name, c_mktsegment AS segment FROM now")
def d_full_refresh(spark, d):
    return _second_load(spark, d, crm_now(spark, d), full_refresh=True)


# --- source stage -------------------------------------------------------------------------------------
@query(
    """SELECT p_partkey, p_size::VARCHAR AS size_text, (p_retailprice / 100.0)::DECIMAL(18,3)::DOUBLE AS price_amount, (p_retailprice * 1.17)::DECIMAL(18,3)::DOUBLE AS p_retailprice_value, p_retailprice FROM part"""
)
def p_transforms(spark, d):
    tr = SourceTransforms([TypeCast("p_size", "string")], [Rename("p_size", "size_text"), Rename("p_retailprice_amount", "price_amount")], [Divide("p_retailprice", 100.0, "decimal(18,3)")], [Multiply("p_retailprice", 1.17, "decimal(18,3)")])
    s = TableSource(path="part.parquet", transforms=tr)
    out = build_stage(read_source(spark, s, d), s)
    return out.select("p_partkey", "size_text", F.col("price_amount").cast("double").alias("price_amount"), F.col("p_retailprice_value").cast("double").alias("p_retailprice_value"), "p_retailprice")


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, NULL::VARCHAR AS k_text, json_extract(props, '$.k')::DOUBLE AS k_number FROM events")
def p_json_path(spark, d):
    fields = [Field("k", "INT64", json_path="$.k", source_column="props"), Field("k_text", "STRING", json_path="$.k", source_column="props"), Field("k_number", "FLOAT64", json_path="$.k", source_column="props")]
    s = TableSource(path="events.parquet", fields=fields)
    return build_stage(read_source(spark, s, d), s).select("event_id", "k", "k_text", "k_number")


@query("SELECT c_custkey, c_acctbal * 2 + 1 AS double_plus, upper(c_mktsegment) AS segment, CASE WHEN c_acctbal > 0 THEN 'owed' ELSE 'owing' END AS side FROM customer WHERE c_acctbal > 100 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def p_computed_and_filter(spark, d):
    cols = [ComputedColumn("double_plus", "t.c_acctbal * 2 + 1"), ComputedColumn("segment", "F.upper(t['c_mktsegment'])"), ComputedColumn("side", "'owed' if t.c_acctbal > 0 else 'owing'")]
    s = StateSource(path="customer.parquet", name="crm", id_field="c_custkey", computed_columns=cols, filter="(t.c_acctbal > 100) and (t.c_mktsegment in ['BUILDING', 'MACHINERY'])")
    return build_stage(read_source(spark, s, d), s).select("c_custkey", "double_plus", "segment", "side")


@query("SELECT c_custkey, c_name, 'kept' AS side FROM customer")
def p_fixture_shadow(spark, d):
    s = StateSource(path="x", name="crm", id_field="c_custkey", fixture_is_transformed=True, filter="t.c_custkey < 0", computed_columns=[ComputedColumn("side", "'made'")])
    return build_stage(t(spark, d, "customer").withColumn("side", F.lit("kept")), s).select("c_custkey", "c_name", "side")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def p_column_pruning(spark, d):
    s = StateSource(path="customer.parquet", name="crm", id_field="c_custkey", full_refresh=True)
    e = AnalyticsEntity("person", state_fields=[StateField("segment", "crm", "c_mktsegment")])
    return build_stage(read_source(spark, s, d), s, columns=raw_columns(s, fields_read({"state_sources": [s], "entities": [e]})["crm"]))


# --- joins --------------------------------------------------------------------------------------------
@query("SELECT c.c_custkey, c.c_nationkey, n.n_name, n.n_regionkey, r.r_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey")
def j_chain(spark, d):
    tables = {"nation": (NATION, t(spark, d, "nation")), "region": (REGION, t(spark, d, "region"))}
    s = StateSource(path="customer.parquet", name="crm", id_field="c_custkey", joins=[Join("nation", "c_nationkey"), Join("region", "n_regionkey")])
    return build_stage(read_source(spark, s, d), s, tables.__getitem__).select("c_custkey", "c_nationkey", "n_name", "n_regionkey", "r_name")


@query("SELECT c_custkey, a.n_name, b.n_name AS n_name_nation_other FROM (SELECT *, (c_nationkey + 1) % 25 AS other FROM customer) c LEFT JOIN nation a ON c.c_nationkey = a.n_nationkey LEFT JOIN nation b ON c.other = b.n_nationkey")
def j_same_target_twice(spark, d):
    s = StateSource(path="x", name="crm", id_field="c_custkey", joins=[Join("nation", "c_nationkey"), Join("nation", "other")])
    rows = t(spark, d, "customer").withColumn("other", (F.col("c_nationkey") + 1) % 25)
    return build_stage(rows, s, lambda _: (NATION, t(spark, d, "nation"))).select("c_custkey", "n_name", "n_name_nation_other")


@query("SELECT e.user_id::VARCHAR AS entity_id, count(*) AS n, count(DISTINCT m.c) AS ids FROM events e LEFT JOIN (SELECT DISTINCT user_id, substr(sha256('u' || (user_id % 5)), 1, 16) AS c FROM events WHERE user_id % 2 = 0) m ON e.user_id = m.user_id GROUP BY e.user_id")
def j_enrich(spark, d):
    e = app_events(spark, d)
    u = F.col("entity_id").cast("bigint")
    m = e.filter(u % 2 == 0).select("source", "entity_id", F.substring(F.sha2(F.concat(F.lit("u"), (u % 5).cast("string")), 256), 1, 16).alias("canonical_id")).distinct()
    return enrich_events(e, m).groupBy("entity_id").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("canonical_id") != F.col("entity_id"), F.col("canonical_id"))).alias("ids"))


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j_levels(spark, d):
    """Sources built level by level; each joins what earlier levels made."""
    crm = StateSource(path="customer.parquet", name="crm", id_field="c_custkey", joins=[Join("nation", "c_nationkey")])
    nation = StateSource(path="nation.parquet", name="nation", id_field="n_nationkey", joins=[Join("region", "n_regionkey")])
    sources, built = {s.name: s for s in (crm, nation, REGION)}, {}
    for level in join_levels(list(sources.values())):
        for name in level:
            built[name] = (sources[name], build_stage(read_source(spark, sources[name], d), sources[name], built.__getitem__))
    return built["crm"][1].select("c_custkey", "n_name", "r_name")


# --- activities ---------------------------------------------------------------------------------------
ACTIVITIES = [
    ActivityDefinition("bought", "app", EventOccurred("purchase"), include_fields=["value", "missing"]),
    ActivityDefinition("spent", "app", EventOccurred("purchase")),
    ActivityDefinition("joined", "crm", RowAppeared()),
    ActivityDefinition("left", "crm", RowDisappeared()),
    ActivityDefinition("to_machinery", "crm", FieldChanged("c_mktsegment", to_values=["MACHINERY"])),
    ActivityDefinition("from_building", "crm", FieldChanged("c_mktsegment", from_values=["BUILDING"])),
]


@query("""SELECT event_type, count(*) AS n FROM (
  SELECT unnest(CASE WHEN event_type = 'purchase' THEN ['bought', 'spent'] ELSE [event_type] END) AS event_type FROM events) GROUP BY event_type""")
def a_events(spark, d):
    return apply_activities(app_events(spark, d), ACTIVITIES).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"""WITH {_CHANGES}, building AS (SELECT c_custkey AS k FROM was WHERE c_mktsegment = 'BUILDING')
SELECT event_type, count(*) AS n FROM (
  SELECT unnest(CASE WHEN event_type = 'row_appeared' THEN ['joined'] WHEN event_type = 'row_disappeared' THEN ['left']
    WHEN field_name = 'c_mktsegment' THEN (CASE WHEN k IN (SELECT k FROM building) THEN ['to_machinery', 'from_building'] ELSE ['to_machinery'] END) ELSE [event_type] END) AS event_type FROM changes) GROUP BY event_type""")
def a_state_changes(spark, d):
    return apply_activities(crm_events(spark, d), ACTIVITIES).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"""WITH {_CHANGES}, building AS (SELECT c_custkey AS k FROM was WHERE c_mktsegment = 'BUILDING')
SELECT k::VARCHAR AS entity_id, field_name, unnest(CASE WHEN event_type = 'row_appeared' THEN ['joined'] WHEN event_type = 'row_disappeared' THEN ['left']
  WHEN field_name = 'c_mktsegment' THEN (CASE WHEN k IN (SELECT k FROM building) THEN ['to_machinery', 'from_building'] ELSE ['to_machinery'] END) ELSE [event_type] END) AS event_type FROM changes""")
def a_state_rows(spark, d):
    return apply_activities(crm_events(spark, d), ACTIVITIES).select("entity_id", json(F.col("payload"), "field_name").alias("field_name"), "event_type")


@query("SELECT user_id::VARCHAR AS entity_id, value, 2 AS n_keys FROM events WHERE event_type = 'purchase'")
def a_include_fields(spark, d):
    e = apply_activities(app_events(spark, d), ACTIVITIES).filter("event_type = 'bought'")
    x = F.col("payload")
    return e.select("entity_id", json(x, "value").cast("double").alias("value"), F.size(F.json_object_keys(x)).alias("n_keys"))


# --- identity -----------------------------------------------------------------------------------------
GRAPH = IdentityGraph("people", "person_id", [IdentitySource("crm", "id", "mail"), IdentitySource("app", "user_id", "mail")])


def people(spark, d):
    mail = F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com"))
    crm = appeared(t(spark, d, "customer").withColumn("mail", mail), "crm", "c_custkey", "2024-01-01")
    return concat_events([crm, app_events(spark, d)])


_MAPPING = """mapping AS (SELECT 'crm' AS source, c_custkey::VARCHAR AS entity_id, substr(sha256(lower(replace(c_name, '#', '.')) || '@example.com'), 1, 16) AS canonical_id FROM customer
  UNION ALL SELECT DISTINCT 'app', user_id::VARCHAR, substr(sha256(user_id::VARCHAR), 1, 16) FROM events)"""


@query(f"WITH {_MAPPING} SELECT * FROM mapping")
def i_resolve(spark, d):
    return resolve_identities(people(spark, d), GRAPH)


@query(f"WITH {_MAPPING} SELECT canonical_id, count(*) AS n FROM (SELECT 'app' AS source, user_id::VARCHAR AS entity_id FROM events UNION ALL SELECT 'crm', c_custkey::VARCHAR FROM customer) JOIN mapping USING (source, entity_id) GROUP BY canonical_id")
def i_enriched_stream(spark, d):
    e = people(spark, d)
    return enrich_events(e, resolve_identities(e, GRAPH)).groupBy("canonical_id").agg(F.count("*").alias("n"))


_KEYS = """keys AS (SELECT 'crm' AS source, c_custkey::VARCHAR AS entity_id, lower(replace(c_name, '#', '.')) || '@example.com' AS given, TIMESTAMP '2024-01-01' AS ts FROM customer
  UNION ALL SELECT 'app', user_id::VARCHAR, CASE user_id % 3 WHEN 1 THEN 'customer.' || lpad(user_id::VARCHAR, 9, '0') || '@example.com' WHEN 2 THEN (CASE WHEN event_type = 'purchase' THEN 'a' ELSE 'b' END) || (user_id % 5) || '@example.com' END, ts FROM events),
ids AS (SELECT *, substr(sha256(coalesce(given, entity_id)), 1, 16) AS id FROM keys),
mapping AS (SELECT source, entity_id, arg_min(id, (given IS NULL, ts, id)) AS canonical_id FROM ids GROUP BY source, entity_id)"""


@query(f"WITH {_KEYS} SELECT canonical_id, count(*) AS n, count(DISTINCT source) AS sources FROM keys JOIN mapping USING (source, entity_id) GROUP BY canonical_id")
def i_linked_sources(spark, d):
    """Both sources have the key: app's is another customer's, missing, or differs between an entity's events."""
    u = F.col("user_id")
    own = F.concat(F.when(F.col("event_type") == "purchase", "a").otherwise("b"), (u % 5).cast("string"), F.lit("@example.com"))
    mail = F.when(u % 3 == 1, F.concat(F.lit("customer."), F.lpad(u.cast("string"), 9, "0"), F.lit("@example.com"))).when(u % 3 == 2, own)
    e = concat_events([people(spark, d).filter("source = 'crm'"), events_of(t(spark, d, "events").withColumn("mail", mail), APP)])
    return enrich_events(e, resolve_identities(e, GRAPH)).groupBy("canonical_id").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


# --- entities -----------------------------------------------------------------------------------------
CUSTOMER_360 = AnalyticsEntity(
    "user", measures=[Measure("purchases", "purchase", "count"), Measure("spent", "purchase", "sum", "value"), Measure("last_purchase_value", "purchase", "latest", "value", "double"), Measure("views", "view", "count")]
)


@query("""SELECT user_id::VARCHAR AS entity_id, count(*) FILTER (event_type = 'purchase') AS purchases, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 4) AS spent,
  arg_max(value, (ts, value::VARCHAR)) FILTER (event_type = 'purchase') AS last_purchase_value, count(*) FILTER (event_type = 'view') AS views
FROM events WHERE event_type IN ('purchase', 'view') GROUP BY user_id""")
def e_measures(spark, d):
    return project_entity(app_events(spark, d), CUSTOMER_360).withColumn("spent", F.round("spent", 4))


STATES = AnalyticsEntity(
    "customer",
    state_fields=[
        StateField("segment", "crm", "c_mktsegment"), StateField("first_segment", "crm", "c_mktsegment", "first"), StateField("balance", "crm", "c_acctbal", type="double"),
        StateField("nation", "none", "c_nationkey", "coalesce", ["none", "crm"], "int"),
    ],
    measures=[Measure("changes", "field_changed", "count")],
    computed_fields=[ComputedColumn("is_machinery", "segment == 'MACHINERY'"), ComputedColumn("band", "'high' if (t.balance or 0) > 5000 else 'low'"), ComputedColumn("short", "segment.split('I')[0].lower()")],
)


@query(f"""WITH {_CHANGES}, history AS (
  SELECT c_custkey AS k, '2024-01-01' AS ts, c_mktsegment AS s, c_acctbal AS b, c_nationkey AS n FROM was
  UNION ALL SELECT c_custkey, '2024-02-01', c_mktsegment, c_acctbal, c_nationkey FROM now WHERE c_custkey NOT IN (SELECT c_custkey FROM was)
  UNION ALL SELECT k, '2024-02-01', new_text, NULL, NULL FROM changes WHERE field_name = 'c_mktsegment'
  UNION ALL SELECT k, '2024-02-01', NULL, new_n, NULL FROM changes WHERE field_name = 'c_acctbal'),
state AS (SELECT k, arg_max(s, ts) AS segment, arg_min(s, ts) AS first_segment, arg_max(b, ts) AS balance, arg_max(n, ts) AS nation FROM history GROUP BY k)
SELECT k::VARCHAR AS entity_id, segment, first_segment, round(balance, 2) AS balance, nation, (SELECT count(*) FROM changes c WHERE c.k = state.k AND event_type = 'field_changed') AS changes,
  segment IS NOT DISTINCT FROM 'MACHINERY' AS is_machinery, CASE WHEN coalesce(balance, 0) > 5000 THEN 'high' ELSE 'low' END AS band, lower(split_part(segment, 'I', 1)) AS short FROM state""")
def e_state_fields(spark, d):
    past = appeared(crm_before(spark, d), "crm", "c_custkey", "2024-01-01")
    gone = F.col("event_type") != "row_disappeared"
    return project_entity(concat_events([past, crm_events(spark, d).filter(gone)]), STATES).withColumn("balance", F.round("balance", 2))


@query("SELECT user_id::VARCHAR AS entity_id, json_extract(arg_max(props, (ts, props)), '$.k')::BIGINT AS k FROM events GROUP BY user_id")
def e_property_bag(spark, d):
    e = AnalyticsEntity("user", property_bags=[PropertyBag("props", "app", "props")])
    out = project_entity(app_events(spark, d), e)
    text = F.try_variant_get(F.try_parse_json("props"), "$", "string")
    return out.select("entity_id", json(text, "k").cast("bigint").alias("k"))


# --- metrics ------------------------------------------------------------------------------------------
def _metrics(spark, d, grain):
    m = MetricsModel("usage", ["app"], grain, [MetricField("purchase", "count"), MetricField("view", "count"), MetricField("click", "count_distinct", "props")], ["event_type", "nothing"])
    return aggregate_metrics(app_events(spark, d), m)


def _metrics_sql(date: str) -> str:
    return f"""SELECT {date} AS _date, event_type, nullif(count(*) FILTER (event_type = 'purchase'), 0) AS purchase_count, nullif(count(*) FILTER (event_type = 'view'), 0) AS view_count,
  count(DISTINCT props) FILTER (event_type = 'click') AS click_count_distinct FROM events WHERE event_type IN ('purchase', 'view', 'click') GROUP BY 1, 2"""


@query(_metrics_sql("strftime(ts, '%Y-%m-%dT%H')"))
def m_hourly(spark, d):
    return _metrics(spark, d, "hourly")


@query(_metrics_sql("strftime(ts, '%Y-%m-%d')"))
def m_daily(spark, d):
    return _metrics(spark, d, "daily")


@query(_metrics_sql("strftime(date_trunc('week', ts), '%Y-%m-%d')"))
def m_weekly(spark, d):
    return _metrics(spark, d, "weekly")


@query(_metrics_sql("strftime(date_trunc('month', ts), '%Y-%m-%d')"))
def m_monthly(spark, d):
    return _metrics(spark, d, "monthly")


@query(f"""WITH {_CHANGES} SELECT '2024-02-01' AS _date, k::VARCHAR AS entity_id, round(sum(new_n - old_n), 2) AS c_acctbal_sum_delta, round(max(new_n), 2) AS c_acctbal_last_value, round(max(new_n), 2) AS c_acctbal_max_value
FROM changes WHERE field_name = 'c_acctbal' GROUP BY k""")
def m_state_changes(spark, d):
    m = MetricsModel("balance", ["crm"], "daily", [MetricField("c_acctbal", a) for a in ("sum_delta", "last_value", "max_value")], ["entity_id"])
    out = aggregate_metrics(crm_events(spark, d), m)
    return out.select("_date", "entity_id", *(F.round(c, 2).alias(c) for c in out.columns[2:]))


@query(f"""WITH now AS ({_NOW}), was AS ({_BEFORE}), steps AS (
  SELECT c_custkey AS k, 1 AS step, w.c_acctbal AS o, n.c_acctbal AS v FROM now n JOIN was w USING (c_custkey) WHERE n.c_acctbal IS DISTINCT FROM w.c_acctbal
  UNION ALL SELECT c_custkey, 2, c_acctbal, c_acctbal - 50 FROM now)
SELECT '2024-02-01' AS _date, k::VARCHAR AS entity_id, round(sum(v - o), 2) AS c_acctbal_sum_delta, round(arg_max(v, step), 2) AS c_acctbal_last_value, round(max(v), 2) AS c_acctbal_max_value FROM steps GROUP BY k""")
def m_last_value(spark, d):
    """Two changes a day, of which the later one is smaller."""
    now = crm_now(spark, d)
    later = now.withColumn("c_acctbal", F.col("c_acctbal") - 50)
    e = concat_events([diff_snapshots(later, now, "crm", "c_custkey", "2024-02-01 20:00:00"), diff_snapshots(now, crm_before(spark, d), "crm", "c_custkey", "2024-02-01 08:00:00")])
    m = MetricsModel("balance", ["crm"], "daily", [MetricField("c_acctbal", a) for a in ("sum_delta", "last_value", "max_value")], ["entity_id"])
    out = aggregate_metrics(e, m)
    return out.select("_date", "entity_id", *(F.round(c, 2).alias(c) for c in out.columns[2:]))


# --- semantic queries ---------------------------------------------------------------------------------
USAGE = MetricsModel("daily_usage", ["app"], "daily", [MetricField("purchase", "count"), MetricField("view", "count"), MetricField("value", "max_value")], ["event_type"])
_DAILY = "daily AS (SELECT strftime(ts, '%Y-%m-%d') AS _date, event_type, count(*) FILTER (event_type = 'purchase') AS purchase_count, count(*) FILTER (event_type = 'view') AS view_count, max(value) AS value_max_value FROM events GROUP BY 1, 2)"


def daily(spark, d):
    day = F.date_format("ts", "yyyy-MM-dd")
    kind = F.col("event_type")
    return t(spark, d, "events").groupBy(day.alias("_date"), "event_type").agg(F.count_if(kind == "purchase").alias("purchase_count"), F.count_if(kind == "view").alias("view_count"), F.max("value").alias("value_max_value"))


@query(f"WITH {_DAILY} SELECT _date, sum(purchase_count)::BIGINT AS purchase_count, max(value_max_value) AS value_max_value FROM daily WHERE _date >= '2024-01-05' AND event_type IN ('purchase', 'view') GROUP BY _date ORDER BY purchase_count DESC NULLS LAST, _date LIMIT 20")
def q_group_filter_order(spark, d):
    return build_query(
        daily(spark, d), catalog_of([USAGE])["daily_usage"], ["purchase_count", "value_max_value"], ["_date"], [{"field": "_date", "op": "gte", "value": "2024-01-05"}, {"field": "event_type", "op": "in", "value": ["purchase", "view"]}],
        [{"field": "purchase_count"}, {"field": "_date", "direction": "asc"}], 20,
    )


@query(f"WITH {_DAILY} SELECT sum(view_count)::BIGINT AS view_count FROM daily WHERE event_type = 'view' AND _date < '2024-01-20' AND _date > '2024-01-02' AND _date <= '2024-01-19'")
def q_global(spark, d):
    ops = [("event_type", "eq", "view"), ("_date", "lt", "2024-01-20"), ("_date", "gt", "2024-01-02"), ("_date", "lte", "2024-01-19")]
    return build_query(daily(spark, d), catalog_of([USAGE])["daily_usage"], ["view_count"], filters=[dict(zip(("field", "op", "value"), o)) for o in ops])


@query(f"WITH {_DAILY} SELECT event_type, sum(view_count)::BIGINT AS view_count, max(value_max_value) AS value_max_value FROM daily GROUP BY event_type")
def q_written_model(spark, d):
    """A model that was written as parquet, found by its name."""
    folder = workplace(spark)
    write_parquet(daily(spark, d), folder, "daily_usage")
    return build_query(load_model(spark, "daily_usage", folder), catalog_of([USAGE])["daily_usage"], ["view_count", "value_max_value"], ["event_type"], limit=500)


BAGGED = AnalyticsEntity("visits", measures=[Measure("value", "x", "sum", "value")], property_bags=[PropertyBag("props", "app", "props")])


@query("SELECT json_extract_string(props, '$.k') AS props__k, round(sum(value), 4) AS value FROM events WHERE json_extract_string(props, '$.k') ILIKE '%1%' AND json_extract_string(props, '$.k') NOT IN ('nothing') GROUP BY 1 ORDER BY props__k LIMIT 500")
def q_property_dimension(spark, d):
    out = build_query(t(spark, d, "events"), catalog_of([BAGGED])["visits"], ["value"], ["props.k"], [{"field": "props['k']", "op": "contains", "value": "1"}, {"field": "props.k", "op": "not_null"}], [{"field": "props.k", "direction": "asc"}], 500)
    return out.withColumn("value", F.round("value", 4))


@query("SELECT 'k' AS key, count(*) AS rows, count(DISTINCT json_extract(props, '$.k')::VARCHAR) AS distinct_values FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def q_discover_keys(spark, d):
    return discover_keys(t(spark, d, "events"), "props")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 100")
def k_table_top(spark, d):
    r = Recipe("rich", "customer", ["c_custkey", "c_name", "c_acctbal"], ["c_acctbal"], ["c_mktsegment"])
    return top_rows({"customer": t(spark, d, "customer")}, r, filters={"c_mktsegment": "BUILDING"}, limit=1000)


@query("SELECT s_suppkey, s_acctbal, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey ORDER BY s_acctbal DESC NULLS LAST, s_suppkey LIMIT 20")
def k_joined_top(spark, d):
    r = Recipe("suppliers", "supplier", ["s_suppkey", "s_acctbal", "n_name"], ["s_acctbal"], [], "joined_top", "nation", "s_nationkey", "n_nationkey")
    return top_rows({k: t(spark, d, k) for k in ("supplier", "nation")}, r)


# --- quality ------------------------------------------------------------------------------------------
def _labelled(spark, d):
    return t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", "text").join(t(spark, d, "labels"), "doc_id", "left")


_LABELLED = "FROM documents LEFT JOIN labels USING (doc_id)"


@query(f"SELECT doc_id {_LABELLED} WHERE quality IS NULL OR toxic IS NULL")
def c_not_null(spark, d):
    return q.NotNull("quality", "toxic").failing(_labelled(spark, d), {}).select("doc_id")


@query("SELECT p_partkey FROM part WHERE p_partkey % 7 = 0")
def c_not_empty(spark, d):
    name = F.when(F.col("p_partkey") % 7 > 0, F.col("p_name")).when(F.col("p_partkey") % 2 == 0, "  ")
    return q.NotEmpty("name").failing(t(spark, d, "part").withColumn("name", name), {}).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_acctbal > 2 * 2500")
def c_in_range(spark, d):
    return q.InRange("c_acctbal", 0, "2 * 2500").failing(t(spark, d, "customer"), {}).select("c_custkey")


@query("SELECT doc_id FROM documents WHERE lang NOT IN ('en', 'de')")
def c_in_set(spark, d):
    return q.InSet("lang", ["en", "de"]).failing(t(spark, d, "documents"), {}).select("doc_id")


@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(source, '[02468]$')")
def c_matches_pattern(spark, d):
    return q.MatchesPattern("source", "[02468]$").failing(t(spark, d, "documents"), {}).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def c_foreign_key(spark, d):
    return q.ForeignKey("doc_id", "labels.doc_id").failing(t(spark, d, "documents"), {"labels": t(spark, d, "labels")}).select("doc_id")


@query("SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def c_unique(spark, d):
    return q.Unique("l_orderkey", "l_returnflag").failing(t(spark, d, "lineitem"), {})


@query("SELECT max(ts)::DATE AS newest FROM events HAVING date_diff('day', max(ts)::DATE, DATE '2024-03-01') > 7")
def c_max_age(spark, d):
    return q.MaxAge("ts", 7, "2024-03-01").failing(t(spark, d, "events"), {})


@query("SELECT o_orderkey FROM orders WHERE NOT (o_totalprice > 50000 OR o_orderstatus = 'F')")
def c_custom_sql(spark, d):
    return q.CustomSQL("large", "o_totalprice > 50000 OR o_orderstatus = 'F'").failing(t(spark, d, "orders"), {}).select("o_orderkey")


@query(f"SELECT 'not_null' AS check, 'quality' AS column, count(*) FILTER (quality IS NULL) AS failures {_LABELLED} UNION ALL SELECT 'unique', 'source', count(*) - count(DISTINCT source) {_LABELLED}")
def c_column_report(spark, d):
    return q.column_report(_labelled(spark, d), ["quality"], ["source"])


@query(f"""SELECT 'NotNull' AS check, count(*) FILTER (quality IS NULL) = 0 AS passed, count(*) FILTER (quality IS NULL) AS failures {_LABELLED}
UNION ALL SELECT 'InSet', count(*) FILTER (lang NOT IN ('en', 'de')) = 0, count(*) FILTER (lang NOT IN ('en', 'de')) {_LABELLED} UNION ALL SELECT 'NotNull', true, 0""")
def c_entity_run(spark, d):
    got = q.QualityRunner().run_entity("documents", _labelled(spark, d), [q.NotNull("quality"), q.InSet("lang", ["en", "de"]), q.NotNull("doc_id")])
    return spark.createDataFrame([(r.check, r.passed, r.failures) for r in got.results], "check string, passed boolean, failures long")


# --- primitives ---------------------------------------------------------------------------------------
@query("""SELECT c_custkey, sha256(trim(lower(' ' || c_name || ' '))) AS email, sha256(c_custkey::VARCHAR || 'salt') AS id, sha256(c_name) AS sha, md5(c_name) AS md, sha256(c_name || c_mktsegment) AS both FROM customer""")
def f_hashes(spark, d):
    c = t(spark, d, "customer")
    mail = F.concat(F.lit(" "), F.col("c_name"), F.lit(" "))
    return c.select("c_custkey", p.hash_email(mail).alias("email"), p.hash_id("c_custkey", "salt").alias("id"), p.hash_sha256("c_name").alias("sha"), p.hash_md5("c_name").alias("md"), p.concat_hash("c_name", "c_mktsegment").alias("both"))


@query("""SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2024-03-01') AS age, date_trunc('month', o_orderdate)::DATE AS m, date_trunc('quarter', o_orderdate)::DATE AS q, date_trunc('year', o_orderdate)::DATE AS y,
  year(o_orderdate)::INT AS yy, month(o_orderdate)::INT AS mm, day(o_orderdate)::INT AS dd, least(o_orderdate::DATE, DATE '1995-01-01') AS first, greatest(o_orderdate::DATE, DATE '1970-01-01') AS last FROM orders""")
def f_dates(spark, d):
    o, day, null = t(spark, d, "orders"), F.col("o_orderdate"), F.lit(None).cast("date")
    fixed = lambda x: F.lit(x).cast("date")
    return o.select(
        "o_orderkey", p.days_since(day, fixed("2024-03-01")).cast("bigint").alias("age"), p.date_trunc_month(day).cast("date").alias("m"), p.date_trunc_quarter(day).cast("date").alias("q"), p.date_trunc_year(day).cast("date").alias("y"),
        p.extract_year(day).alias("yy"), p.extract_month(day).alias("mm"), p.extract_day(day).alias("dd"), p.earliest_date(day, fixed("1995-01-01"), null).alias("first"), p.latest_date(day, null).alias("last"),
    )


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size, CASE WHEN lower(p_name) LIKE '%red%' OR lower(p_name) LIKE '%1%' THEN 'one' WHEN lower(p_type) LIKE '%e%' THEN 'two' ELSE 'none' END AS kind,
  (p_size > 25)::BIGINT AS big, p_brand IN ('Brand#1', 'Brand#2') AS flagged, p_name LIKE '%1%' OR p_name LIKE '%2%' AS has_digit FROM part""")
def f_categories(spark, d):
    x = t(spark, d, "part")
    kind = F.when(p.contains_any(F.lower("p_name"), ["red", "1"]), "one").otherwise(p.categorize_contains("p_type", {"two": ["E"]}, "none"))
    return x.select(
        "p_partkey", p.categorize("p_size", [(10, "small"), (30, "medium")], "large").alias("size"), kind.alias("kind"), p.boolean_to_int(F.col("p_size") > 25).alias("big"), p.lifecycle_flag("p_brand", ["Brand#1", "Brand#2"]).alias("flagged"),
        p.contains_any("p_name", ["1", "2"]).alias("has_digit"),
    )


@query("SELECT p_partkey, p_size IN (1, 5, 9) AS sized, p_brand IN ('Brand#1', 'Brand#2') AS branded FROM part")
def f_isin_literal(spark, d):
    return t(spark, d, "part").select("p_partkey", p.isin_literal("p_size", [1, 5, 9]).alias("sized"), p.isin_literal("p_brand", ["Brand#1", "Brand#2"]).alias("branded"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS obj, '' AS text, false AS flag, json_extract(props, '$.k')::VARCHAR AS raw, event_type AS round_trip FROM events""")
def f_json(spark, d):
    e = t(spark, d, "events")
    made = p.to_json_struct({"type": "event_type", "inner": F.struct("event_id")})
    return e.select(
        "event_id", p.json_extract_scalar("props", "$.k").alias("k"), p.json_value(made, "$.inner").alias("obj"), p.json_extract_string("props", "k").alias("text"), p.json_extract_bool("props", "k").alias("flag"),
        p.json_extract_raw("props", "k").alias("raw"), p.json_value(made, "$.type").alias("round_trip"),
    )


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER w AS rn, row_number() OVER w2 - 1 AS latest, sum(l_quantity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running, lag(l_partkey, 1) OVER w AS before, lead(l_partkey, 2) OVER w AS later,
  first_value(l_partkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first, last_value(l_partkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice), w2 AS (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC)""")
def f_windows(spark, d):
    k, o = "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return t(spark, d, "lineitem").select(
        k, o[0], p.row_number_by(k, o).alias("rn"), p.dedup_by(k, o).alias("latest"), p.cumulative_sum("l_quantity", k, o).alias("running"), p.lag_value("l_partkey", k, o).alias("before"), p.lead_value("l_partkey", k, o, 2).alias("later"),
        p.first_value("l_partkey", k, o).alias("first"), p.last_value("l_partkey", k, o).alias("last"),
    )


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS s, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, round(avg(l_discount), 6) AS mean, min(l_tax) AS least, max(l_extendedprice) AS most, any_value(l_returnflag) AS flag, sum(l_linenumber * 2)::BIGINT AS component
FROM lineitem GROUP BY 1, 2""")
def f_aggregates(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return g.agg(
        p.sum_("l_quantity").alias("s"), p.count_().alias("n"), p.count_distinct("l_suppkey").alias("suppliers"), F.round(p.avg_("l_discount"), 6).alias("mean"), p.min_("l_tax").alias("least"), p.max_("l_extendedprice").alias("most"),
        p.any_value("l_returnflag").alias("flag"), *p.component_measures({"component": "sum(l_linenumber * 2)"}),
    )


@query("""WITH m AS (SELECT c_custkey, 'u' || c_custkey || '@' || CASE WHEN c_custkey % 3 = 0 THEN 'gmail.com' ELSE 'firm' || c_nationkey || '.com' END AS mail FROM customer)
SELECT c_custkey, split_part(mail, '@', 2) AS domain, split_part(mail, '@', 2) = 'gmail.com' AS personal, CASE WHEN split_part(mail, '@', 2) <> 'gmail.com' THEN md5(split_part(mail, '@', 2)) END AS account FROM m""")
def f_domains(spark, d):
    k = F.col("c_custkey")
    mail = F.concat(F.lit("u"), k, F.lit("@"), F.when(k % 3 == 0, "gmail.com").otherwise(F.concat(F.lit("firm"), "c_nationkey", F.lit(".com"))))
    domain = p.extract_email_domain(mail)
    return t(spark, d, "customer").select(k, domain.alias("domain"), p.is_personal_email_domain(domain).alias("personal"), p.account_id_from_domain(domain).alias("account"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0 ELSE (p_size // 10) * 3600 + (p_size % 10) * 60 + 5 END::BIGINT AS seconds FROM part")
def f_duration(spark, d):
    n = F.col("p_size")
    text = F.when(n % 4 == 0, "junk").otherwise(F.concat(F.lit("PT"), F.floor(n / 10).cast("string"), F.lit("H"), (n % 10).cast("string"), F.lit("M5S")))
    return t(spark, d, "part").select("p_partkey", p.parse_iso8601_duration(text).alias("seconds"))


@query("""SELECT o_orderkey, o_orderstatus IN ('O', 'P') AS is_active, o_orderstatus = 'F' AS is_churned, o_orderstatus = 'P' AS is_at_risk, date_diff('day', o_orderdate::DATE, DATE '2024-03-01') AS days_since_created, date_trunc('month', o_orderdate)::DATE AS created_month,
  year(o_orderdate)::INT AS created_year, date_diff('day', o_orderdate::DATE + 3, DATE '2024-03-01') AS days_since_updated, 3 AS days_between_created_and_updated, o_totalprice > 100000 AS has_large, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band FROM orders""")
def f_components(spark, d):
    day = F.col("o_orderdate").cast("date")
    cols = p.lifecycle_flags("o_orderstatus", ["O", "P"], ["F"], ["P"]) | p.time_based_metrics(day, F.date_add(day, 3), F.lit("2024-03-01").cast("date")) | p.data_quality_flags({"large": "o_totalprice > 100000"})
    cols["created_month"] = cols["created_month"].cast("date")
    cols["days_since_created"], cols["days_since_updated"] = cols["days_since_created"].cast("bigint"), cols["days_since_updated"].cast("bigint")
    price = F.col("o_totalprice")
    return t(spark, d, "orders").select("o_orderkey", *(c.alias(k) for k, c in cols.items()), p.case([(price > 200000, "big"), (price > 50000, "mid")], "low").alias("band"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 0 AND NOT (s_nationkey IN (1, 2)) THEN floor(s_acctbal / 100) ELSE -1 END::DOUBLE AS hundreds, (s_nationkey % 5) ** 2 AS square FROM supplier")
def f_expressions(spark, d):
    s = t(spark, d, "supplier")
    h = evaluate_expression("(t.s_acctbal // 100) if (t.s_acctbal > 0 and not (t.s_nationkey in (1, 2))) else -1", s)
    return s.select("s_suppkey", h.cast("double").alias("hundreds"), evaluate_expression("(t.s_nationkey % 5) ** 2", s).alias("square"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e_measures(spark, sf_dir)
