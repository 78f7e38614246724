import json
import re

import pytest
from pyspark.sql import functions as F

from actflow.functions.expressions import ExpressionError, evaluate_expression, row_expression
from actflow.functions.jsonx import check_path
from actflow.model import (
    ActivityDefinition, AnalyticsEntity, ComputedColumn, EventOccurred, EventSource, Field, FieldChanged, IdentityGraph, IdentitySource, Join, Measure, MetricField, MetricsModel, StagingView, StateField, StateSource, TableSource,
)
from actflow.operators.activities import apply_activities
from actflow.operators.diff import diff_snapshots, snapshot_diff
from actflow.operators.entity import project_entity
from actflow.operators.events import SCHEMA, events_of
from actflow.operators.identity import enrich_events, resolve_identities
from actflow.operators.insights import Recipe, parse_recipe, recipe_limit, top_rows
from actflow.operators.metrics import aggregate_metrics
from actflow.operators.quality import CustomSQL, InSet, MatchesPattern, NotNull, QualityRunner, Unique
from actflow.operators.query import QueryError, build_query, catalog_of, describe_dimension, describe_metric, describe_model, infer_kind, limit_of, list_dimensions, list_metrics, list_models, query_model, query_syntax
from actflow.plans.config import resolve_config
from actflow.plans.pipeline import Pipeline
from actflow.plans.policy import UnsupportedAssetError, assert_supported, findings
from actflow.plans.registry import KINDS, Registry, dag_html, discover, manifest_hash, manifest_json
from actflow.sources.readers import SourceNotFoundError, drop_view, execute_parameterized, materialize_view, read_parquet, view_exists, write_parquet, write_table
from actflow.sources.snapshots import SnapshotStore
from actflow.sources.stage import build_stage, join_levels
from actflow.sources.staging import content_hash, materialize_staging, render_sql


def events(spark, *rows):
    return spark.createDataFrame([(s, e, t, k, p if isinstance(p, str) else json.dumps(p)) for s, e, t, k, p in rows], SCHEMA)


def change(field, old, new):
    return {"field_name": field, "old_value": old, "new_value": new}


def test_event_payload_keeps_nulls_and_nested_values(spark):
    df = spark.createDataFrame([(1, "2024-01-01", None, [1, 2])], "u int, at string, page string, xs array<int>")
    row = events_of(df, EventSource(path="x", name="web", entity_id_field="u", timestamp_field="at")).first()
    assert row.event_type == "web" and json.loads(row.payload) == {"page": None, "xs": "[1,2]"}
    only = events_of(df.select("u", "at"), EventSource(path="x", name="web", entity_id_field="u", timestamp_field="at", event_type="seen")).first()
    assert (only.event_type, only.payload) == ("seen", "{}")


def test_diff(spark):
    old = spark.createDataFrame([(1, "free"), (2, None), (3, "pro")], "id int, plan string")
    new = spark.createDataFrame([(1, "pro"), (2, "free"), (4, "x")], "id int, plan string")
    got = {(r.entity_id, r.event_type): json.loads(r.payload) for r in diff_snapshots(new, old, "crm", "id", "2024-01-02").collect()}
    assert got == {("1", "field_changed"): change("plan", "free", "pro"), ("2", "field_changed"): change("plan", None, "free"), ("3", "row_disappeared"): {"plan": "pro"}, ("4", "row_appeared"): {"plan": "x"}}
    assert diff_snapshots(new, old, "crm", "id", "d", ["plan"]).count() == 2
    assert diff_snapshots(new, None, "crm", "id", "d").count() == 3


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "free")], "id int, plan string")
    assert {r.event_type for r in snapshot_diff(store, df, "crm", "id", "2024-01-01").collect()} == {"row_appeared"}
    (tmp_path / "crm" / "junk.parquet").mkdir()
    assert [r.event_type for r in snapshot_diff(store, df, "crm", "id", "2024-01-02").collect()] == ["row_appeared"]  # nothing changed: replayed
    assert [r.event_type for r in snapshot_diff(store, df.withColumn("plan", F.lit("pro")), "crm", "id", "2024-01-03").collect()] == ["field_changed"]
    assert store.dates("crm") == ["2024-01-01", "2024-01-02", "2024-01-03"] and store.get_previous("crm", "2024-01-01") is None
    assert store.load("crm", "2024-01-03").first().plan == "pro"
    with pytest.raises(ValueError):
        store.save("crm", "yesterday", df)


def test_activities(spark):
    e = events(spark, ("crm", "1", "t", "field_changed", change("plan", "free", "pro")), ("crm", "1", "t", "field_changed", change("plan", 1, 2)), ("app", "1", "t", "click", {"a": 1, "b": 2}))
    defs = [ActivityDefinition("up", "crm", FieldChanged("plan", ["free"], ["pro"])), ActivityDefinition("any", "app", EventOccurred()), ActivityDefinition("clicked", "app", EventOccurred("click"), include_fields=["a", "z"])]
    got = sorted((r.event_type, r.payload) for r in apply_activities(e, defs).collect())
    assert [k for k, _ in got] == ["any", "clicked", "field_changed", "up"]
    assert json.loads(dict(got)["clicked"]) == {"a": 1, "z": None}
    assert apply_activities(e, []).count() == 3


def test_identity(spark):
    e = events(spark, ("crm", "1", "1", "row_appeared", {"mail": "k"}), ("crm", "2", "1", "row_appeared", {"mail": None}), ("bill", "9", "1", "row_appeared", {"mail": "k"}), ("bill", "9", "2", "paid", {}), ("web", "5", "1", "seen", {}))
    m = resolve_identities(e, IdentityGraph("g", "c", [IdentitySource("crm", "id", "mail"), IdentitySource("bill", "id", "mail")]))
    ids = {(r.source, r.entity_id): r.canonical_id for r in m.collect()}
    assert ids["crm", "1"] == ids["bill", "9"] != ids["crm", "2"] and len(ids) == 3
    out = {(r.source, r.entity_id): r.canonical_id for r in enrich_events(e, m).collect()}
    assert out["web", "5"] == "5"
    with pytest.raises(ValueError):
        IdentityGraph("g", "c", [IdentitySource("crm", "id", "mail")])


def test_entity(spark):
    e = events(
        spark, ("crm", "A", "1", "row_appeared", {"plan": "free", "n": 1}), ("crm", "A", "2", "field_changed", change("plan", "free", "pro")), ("crm", "A", "3", "field_changed", change("plan", "pro", None)),
        ("bill", "A", "1", "row_appeared", {"plan": "x"}), ("app", "A", "1", "pay", {"amount": "5"}), ("app", "A", "2", "pay", {"amount": 2.5}), ("app", "A", "3", "pay", {"amount": "no"}), ("app", "B", "1", "pay", {}), ("zzz", "C", "1", "other", {}),
    )
    ent = AnalyticsEntity(
        "x", state_fields=[StateField("plan", "crm", "plan"), StateField("first", "crm", "plan", "first"), StateField("n", "crm", "n", type="int"), StateField("best", "bill", "plan", "coalesce", ["none", "bill", "crm"])],
        measures=[Measure("pays", "pay", "count"), Measure("total", "pay", "sum", "amount"), Measure("last", "pay", "latest", "amount")],
        computed_fields=[ComputedColumn("rich", "total > 5 and plan != 'free'"), ComputedColumn("label", "(plan or 'none').upper()")],
    )
    got = {r.entity_id: r.asDict() for r in project_entity(e, ent).collect()}
    assert set(got) == {"A", "B"}
    a = got["A"]
    assert (a["plan"], a["first"], a["n"], a["best"], a["pays"], a["total"], a["last"], a["rich"], a["label"]) == ("pro", "free", 1, "x", 3, 7.5, "no", True, "PRO")
    assert got["B"]["plan"] is None and got["B"]["total"] == 0.0 and got["B"]["label"] == "NONE"


def test_metrics(spark):
    e = events(spark, ("crm", "1", "2024-01-03 10:15:00", "field_changed", change("n", "100", "150")), ("crm", "1", "2024-01-03 10:45:00", "field_changed", change("n", "150", "x")), ("crm", "2", "2024-01-08", "field_changed", change("n", 1, 4)), ("app", "1", "2024-01-03", "click", {"u": "a"}))
    m = MetricsModel("m", ["crm"], "weekly", [MetricField("n", "sum_delta"), MetricField("n", "last_value"), MetricField("n", "max_value"), MetricField("click", "count")])
    assert [tuple(r) for r in aggregate_metrics(e, m).collect()] == [("2024-01-01", 50.0, 150.0, 150.0, None), ("2024-01-08", 3.0, 4.0, 4.0, None)]
    with pytest.raises(ValueError):
        MetricField("n", "count_distinct")


def test_stage_and_joins(spark):
    stages = StateSource(path="x", name="stage", id_field="id")
    table = spark.createDataFrame([(1, "new"), (2, "old")], "id int, name string")
    history = spark.createDataFrame([("a", 1, 2), ("b", 2, None)], "id string, prev int, next int")
    s = StateSource(path="x", name="history", id_field="id", joins=[Join("stage", "prev"), Join("stage", "next")])
    out = build_stage(history, s, lambda _: (stages, table))
    assert out.columns == ["id", "prev", "next", "id_stage_prev", "name", "id_stage_next", "name_stage_next"]
    assert [r.name_stage_next for r in out.orderBy("id").collect()] == ["old", None]
    assert join_levels([s, stages]) == [["stage"], ["history"]]
    a, b = StateSource(path="x", name="a", id_field="i", joins=[Join("b", "k")]), StateSource(path="x", name="b", id_field="i", joins=[Join("a", "k")])
    with pytest.raises(ValueError, match="cycle"):
        join_levels([a, b])
    with pytest.raises(ValueError, match="event source"):
        join_levels([a, EventSource(path="x", name="b", entity_id_field="e", timestamp_field="t")])


def test_json_path_types(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "7", "c": 1.5, "d": true, "e": "2024-01-02"}',), ("junk",)], "doc string")
    kinds = {"a": "INT64", "b": "INT64", "c": "FLOAT64", "d": "BOOLEAN", "e": "DATE"}
    s = TableSource(path="x", fields=[Field(k, t, json_path=f"$.{k}", source_column="doc") for k, t in kinds.items()])
    first, second = build_stage(df, s).select(*kinds).collect()
    assert (first.a, first.b, first.c, first.d, str(first.e)) == (1, None, 1.5, True, "2024-01-02")
    assert set(second) == {None}
    with pytest.raises(ValueError):
        check_path("$['a']")


def test_expressions(spark):
    df = spark.createDataFrame([(1, "a@b"), (None, None)], "x int, s string")
    assert [r[0] for r in df.select(evaluate_expression("t.x == 1", df)).collect()] == [True, None]
    assert [r[0] for r in df.select(row_expression("x == 1", df.columns)).collect()] == [True, False]
    assert [r[0] for r in df.select(row_expression("s.split('@')[1] if s else 'none'", df.columns)).collect()] == ["b", "none"]
    for bad in ("__import__('os')", "t._df", "lambda: 1", "[x for x in t]", "nothing", "t.nothing", "1 +"):
        with pytest.raises(ExpressionError):
            evaluate_expression(bad, df)


def test_quality(spark):
    df = spark.createDataFrame([("a", 1), (None, 1), ("it's", 2)], "k string, n int")
    result = QualityRunner().run_entity("e", df, [NotNull("k"), Unique("n"), InSet("k", ["a", "it's"]), MatchesPattern("k", "^[a-z']+$"), CustomSQL("pos", "n > 0"), CustomSQL("bad", "nothing > 0")])
    assert [r.failures for r in result.results] == [1, 1, 0, 0, 0, 0] and result.counts == (3, 3) and result.results[5].error and not result.passed


def test_queries(spark):
    cat = catalog_of([MetricsModel("daily", ["a"], "daily", [MetricField("n", "count"), MetricField("v", "max_value")], ["source"])])
    df = spark.createDataFrame([("d1", "a", 1, 5.0), ("d1", "b", 2, 7.0), ("d2", "a", 3, None)], "_date string, source string, n_count int, v_max_value double")
    df.createOrReplaceTempView("daily")
    assert query_model(spark, cat, {"model": "daily", "metrics": ["n_count", "v_max_value"], "dimensions": ["_date"], "order_by": [{"field": "v_max_value", "direction": "asc"}]}) == [{"_date": "d1", "n_count": 3, "v_max_value": 7.0}, {"_date": "d2", "n_count": 3, "v_max_value": None}]
    for bad in ({"metrics": ["x"]}, {"metrics": ["n_count"], "filters": [{"field": "n_count", "op": "eq", "value": 1}]}, {"metrics": ["n_count"], "order_by": [{"field": "source"}]}, {"metrics": ["n_count"], "limit": 0}, {"metrics": []}):
        with pytest.raises(QueryError):
            build_query(df, cat["daily"], **bad)
    assert limit_of(10_000) == 500 and list_models(cat)[0]["metrics"] == 2 and describe_model(cat, "daily")["metrics"][0]["metric_id"] == "daily.n_count" and query_syntax()["max_limit"] == 500
    assert [infer_kind(v) for v in (["1", "2.5"], ["true"], ["2024-01-01"], ["x"], ["1", "x"], [None, None, "1"], [])] == ["number", "boolean", "date-ish", "string", "mixed", "null-heavy", "unknown"]


def test_insights(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, k string")
    r = Recipe("top", "t", ["n"], ["n"], ["k"])
    assert [x.n for x in top_rows({"t": df}, r).collect()] == [2, 1] and recipe_limit(1000) == 100
    with pytest.raises(ValueError):
        top_rows({"t": df}, r, filters={"n": 1})


def test_sql_and_views(spark, tmp_path):
    materialize_view(spark, "_v", "SELECT 1 AS id, 'a' AS k")
    assert view_exists(spark, "_v") and execute_parameterized(spark, "SELECT * FROM _v WHERE k = @k AND id < @k2", {"k": "a", "k2": 5}).count() == 1
    drop_view(spark, "_v")
    assert not view_exists(spark, "_v")
    with pytest.raises(SourceNotFoundError):
        read_parquet(spark, "missing.parquet", str(tmp_path))
    assert spark.read.parquet(write_parquet(spark.range(3), str(tmp_path), "x")).count() == 3


def test_staging(spark):
    a = StagingView("_sa", "p", "d", "SELECT {{ n }} AS id", {"n": 1})
    b = StagingView("_sb", "p", "d", "SELECT id + 1 AS id FROM _sa", depends_on=["_sa"])
    state = {}
    assert materialize_staging(spark, [b, a], state)["created"] == ["_sa", "_sb"]
    assert materialize_staging(spark, [b, a], state)["skipped"] == ["_sa", "_sb"] and spark.table("_sb").first().id == 2
    assert content_hash(a) != content_hash(StagingView("_sa", "p", "d", "SELECT {{ n }} AS id", {"n": 2}))
    with pytest.raises(KeyError):
        render_sql(StagingView("_sa", "p", "d", "SELECT {{ m }}"))
    with pytest.raises(ValueError):
        materialize_staging(spark, [a, StagingView("o", "other", "d", "SELECT 1")])


def test_pipeline(spark, tmp_path):
    (tmp_path / "entities").mkdir()
    (tmp_path / "entities" / "a.py").write_text(
        "from actflow import *\n"
        "src = StateSource(name='crm', path='crm.parquet', id_field='id')\n"
        "web = EventSource(name='web', path='web.parquet', entity_id_field='u', timestamp_field='at', event_type='seen')\n"
        "act = ActivityDefinition('joined', 'crm', RowAppeared())\n"
        "ent = AnalyticsEntity('person', state_fields=[StateField('plan', 'crm', 'plan')], measures=[Measure('joins', 'joined', 'count'), Measure('seen', 'seen', 'count')], quality_checks=[NotNull('entity_id')])\n"
        "met = MetricsModel('usage', ['web'], 'daily', [MetricField('seen', 'count')])\n"
    )
    spark.createDataFrame([("1", "pro"), ("2", "free")], "id string, plan string").write.parquet(str(tmp_path / "crm.parquet"))
    spark.createDataFrame([("1", "2024-01-01"), ("1", "2024-01-01"), ("3", "2024-01-02")], "u string, at string").write.parquet(str(tmp_path / "web.parquet"))
    assets = discover(str(tmp_path / "entities"), strict=True)
    r = Pipeline(spark, assets, str(tmp_path), str(tmp_path / "out"), str(tmp_path / "snap"), "2024-01-05", check_quality=True).run()
    assert not r.errors and r.quality["person"].passed and set(r.timings) == {"staging", "sources", "activities", "identity", "entities", "metrics"}
    assert {x.entity_id: (x.plan, x.joins, x.seen) for x in spark.read.parquet(r.outputs["person"]).collect()} == {"1": ("pro", 1, 2), "2": ("free", 1, 0), "3": (None, 0, 1)}
    assert sorted(tuple(x) for x in spark.read.parquet(r.outputs["usage"]).collect()) == [("2024-01-01", 2), ("2024-01-02", 1)]
    assert manifest_hash(assets) == manifest_hash(discover(str(tmp_path / "entities"))) and ["crm", "person"] in json.loads(manifest_json(assets))["edges"]


def test_config(tmp_path):
    (tmp_path / "actflow.json").write_text('{"data_dir": "d"}')
    c = resolve_config(str(tmp_path), output_dir="o")
    assert c.data_dir == str(tmp_path / "d") and c.output_dir == str(tmp_path / "o")
    with pytest.raises(ValueError):
        resolve_config(str(tmp_path), max_parallel_io=0)


def test_streaming(spark, tmp_path):
    from actflow.streaming.metrics import each_batch, read_events, stream_activities, stream_metrics

    events(spark, ("web", "1", "2024-01-01 00:10:00", "seen", {}), ("web", "1", "2024-01-01 00:20:00", "seen", {})).write.parquet(str(tmp_path / "in"))
    got = []
    stream = stream_activities(read_events(spark, str(tmp_path / "in")), [ActivityDefinition("looked", "web", EventOccurred("seen"))])
    each_batch(stream, lambda df, _: got.extend(r.event_type for r in df.collect()), str(tmp_path / "c1")).awaitTermination(60)
    assert got == ["looked", "looked"]
    m = stream_metrics(read_events(spark, str(tmp_path / "in")), MetricsModel("m", ["web"], "hourly", [MetricField("seen", "count")]))
    q = m.writeStream.format("memory").queryName("_m").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("_m").first().seen_count == 2


# --- column pruning from assets
def test_pruned_scan_gives_the_same_results(spark, tmp_path):
    from actflow import model as m
    from actflow.plans import pipeline as pl
    from actflow.plans.pruning import fields_read, raw_columns
    from actflow.sources.readers import read_source
    from actflow.sources.stage import build_stage

    spark.createDataFrame([("1", "pro", 5, "a", 7), ("2", "free", 6, "b", 8)], "id string, plan_raw string, cents long, secret string, keep long").write.parquet(str(tmp_path / "crm.parquet"))
    spark.createDataFrame([("1", "2024-01-01", "x", 1.0, "p"), ("1", "2024-01-02", "y", 2.0, "q"), ("3", "2024-01-02", "x", 4.0, "r")], "u string, at string, kind string, value double, unread string").write.parquet(str(tmp_path / "web.parquet"))
    crm = m.StateSource(name="crm", path="crm.parquet", id_field="id", full_refresh=True, filter="t.keep > 0", transforms=m.SourceTransforms(renames=[m.Rename("plan_raw", "plan")], divides=[m.Divide("cents", 100.0)]))
    web = m.EventSource(name="web", path="web.parquet", entity_id_field="u", timestamp_field="at", event_type_field="kind")
    whole = m.EventSource(name="all", path="web.parquet", entity_id_field="u", timestamp_field="at", event_type_field="kind", computed_columns=[m.ComputedColumn("c", F.lit(1))])
    entity = m.AnalyticsEntity("person", state_fields=[m.StateField("plan", "crm", "plan"), m.StateField("paid", "crm", "cents_amount")], measures=[m.Measure("total", "x", "sum", "value")])
    assets = {"state_sources": [crm], "event_sources": [web, whole], "activities": [], "identity_graphs": [], "entities": [entity], "metrics_models": [], "staging_views": []}
    read = fields_read(assets)
    raw = {s.name: raw_columns(s, read[s.name]) for s in (crm, web, whole)}
    assert raw["all"] is None and "secret" not in raw["crm"] and "unread" not in raw["web"]
    plan = build_stage(read_source(spark, crm, str(tmp_path)), crm, columns=raw["crm"])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert {c.split(":")[0] for c in re.search(r"ReadSchema: struct<(.*?)>", plan)[1].split(",")} == {"id", "plan_raw", "cents", "keep"}

    class Assets(dict):
        def __getitem__(self, k):
            class L(list):
                all = list.copy
            return L(dict.__getitem__(self, k))

    got = []
    for prune in (True, False):
        keep = pl.raw_columns
        if not prune:
            pl.raw_columns = lambda *_: None
        try:
            r = pl.Pipeline(spark, Assets(assets), str(tmp_path), str(tmp_path / f"out{prune}"), str(tmp_path / f"snap{prune}"), "2024-02-01").run()
        finally:
            pl.raw_columns = keep
        assert not r.errors
        got.append(sorted(map(str, spark.read.parquet(r.outputs["person"]).collect())))
    assert got[0] == got[1] and len(got[0]) == 3


def test_what_may_need_any_column_is_not_pruned():
    from actflow import model as m
    from actflow.operators.quality import ForeignKey
    from actflow.plans.pruning import fields_read

    state = lambda n, **k: m.StateSource(name=n, path="x", id_field="id", **k)
    sources = [state("diffed"), state("target", full_refresh=True), state("joins", full_refresh=True, joins=[m.Join("target", "k")]), state("counted", full_refresh=True), state("checked", full_refresh=True)]
    read = fields_read({"state_sources": sources, "activities": [m.ActivityDefinition("any", "counted", m.EventOccurred())], "entities": [m.AnalyticsEntity("e", measures=[m.Measure("n", "any", "count")], quality_checks=[ForeignKey("a", "checked.id")])]})
    assert [k for k, v in read.items() if v is None] == ["diffed", "target", "counted", "checked"] and read["joins"] >= {"id", "k"}


# --- identities across sources
def test_sources_are_linked_by_their_key(spark):
    from actflow.model import IdentityGraph, IdentitySource
    from actflow.operators.identity import canonical_id, enrich_events, resolve_identities

    rows = [("crm", "1", "t1", "row_appeared", '{"mail":"a@x"}'), ("app", "u1", "t2", "seen", '{"email":"a@x"}'), ("app", "u1", "t1", "seen", '{"email":"b@x"}'), ("app", "u2", "t1", "seen", '{"email":null}'), ("app", "u3", "t1", "seen", "{}"), ("crm", "2", "t1", "field_changed", '{"mail":"c@x"}'), ("log", "1", "t1", "seen", '{"mail":"a@x"}')]
    events = spark.createDataFrame(rows, "source string, entity_id string, ts string, event_type string, payload string")
    graph = IdentityGraph("g", "p", [IdentitySource("crm", "id", "mail"), IdentitySource("app", "u", "email")])
    h = lambda k: spark.range(1).select(canonical_id(F.lit(k))).first()[0]
    got = {(r.source, r.entity_id): r.canonical_id for r in resolve_identities(events, graph).collect()}
    assert got == {("crm", "1"): h("a@x"), ("app", "u1"): h("b@x"), ("app", "u2"): h("u2"), ("app", "u3"): h("u3")}
    both = IdentityGraph("g", "p", [*graph.sources, IdentitySource("app", "u", "mail")])
    more = events.unionByName(spark.createDataFrame([("app", "u9", "t1", "seen", '{"mail":"a@x"}')], events.schema))
    found = {(r.source, r.entity_id): r.canonical_id for r in enrich_events(more, resolve_identities(more, both)).collect()}
    assert found["app", "u9"] == found["crm", "1"] == h("a@x") and found["log", "1"] == "1" and found["crm", "2"] == "2"


def test_last_value_is_the_latest(spark):
    from actflow.model import MetricField, MetricsModel
    from actflow.operators.metrics import aggregate_metrics

    change = lambda ts, old, new: ("crm", "1", ts, "field_changed", f'{{"field_name":"n","old_value":{old},"new_value":{new}}}')
    events = spark.createDataFrame([change("2024-01-01T08:00:00", 1, 9), change("2024-01-01T10:00:00", 9, 4), change("2024-01-01T09:00:00", 9, 7)], "source string, entity_id string, ts string, event_type string, payload string")
    r = aggregate_metrics(events, MetricsModel("m", ["crm"], "daily", [MetricField("n", a) for a in ("last_value", "max_value", "sum_delta")])).first()
    assert (r.n_last_value, r.n_max_value, r.n_sum_delta) == (4, 9, 1)


def registries(*assets):
    out = {k: Registry(t) for k, t in KINDS.items()}
    for a in assets:
        next(r for r in out.values() if r.kind is type(a)).add(a)
    return out


def test_unsupported_assets_fail_before_any_job(spark, tmp_path):
    good = AnalyticsEntity("ok", state_fields=[StateField("n", "s", "n", type="int")], computed_fields=[ComputedColumn("m", "n + 1"), ComputedColumn("k", "m * 2")])
    src = StateSource(name="s", path="missing.parquet", id_field="id")
    assert_supported(registries(src, good, ActivityDefinition("a", "nowhere", EventOccurred("x"))))
    bad = AnalyticsEntity("bad", identity_graph="g", state_fields=[StateField("n", "s", "n", type="nosuchtype")], computed_fields=[ComputedColumn("m", "__import__('os')")])
    assets = registries(src, bad, ActivityDefinition("a", "nowhere", EventOccurred("x")))
    assert {(f.asset, f.feature) for f in findings(assets)} == {("a", "source"), ("bad", "type of n"), ("bad", "computed field m"), ("bad", "identity graph")}
    with pytest.raises(UnsupportedAssetError):
        Pipeline(spark, assets, str(tmp_path), str(tmp_path), str(tmp_path), "2024-01-01").run()


def test_lasting_views_and_their_state(spark):
    a = StagingView("_la", "p", "actflow_views", "SELECT {{ n }} AS id", {"n": 1})
    b = StagingView("_lb", "p", "actflow_views", "SELECT id + 1 AS id FROM actflow_views._la", depends_on=["_la"])
    try:
        assert materialize_staging(spark, [a, b], lasting=True)["created"] == ["_la", "_lb"]
        assert materialize_staging(spark, [a, b], lasting=True)["skipped"] == ["_la", "_lb"] and spark.table("actflow_views._lb").first().id == 2
        changed = StagingView("_la", "p", "actflow_views", "SELECT {{ n }} AS id", {"n": 5})
        assert materialize_staging(spark, [changed, b], lasting=True) == {"created": ["_la"], "skipped": ["_lb"], "shadowed": []} and spark.table("actflow_views._lb").first().id == 6
        drop_view(spark, "_lb", "actflow_views")
        assert not view_exists(spark, "_lb", "actflow_views") and materialize_staging(spark, [changed, b], lasting=True)["created"] == ["_lb"]
        assert write_table(spark.range(3), "actflow_views", "t", "spark_catalog") == "spark_catalog.actflow_views.t" and spark.table("actflow_views.t").count() == 3
    finally:
        spark.sql("DROP DATABASE IF EXISTS actflow_views CASCADE")


def test_recipes_are_parsed(spark):
    raw = {"type": "table_top", "table": {"name": "t"}, "columns": ["n", "k"], "order_by": {"default": "k", "allowed": ["n", "k"]}, "filters": {"allowed": ["k"], "defaults": {"k": "b"}}, "limit": {"default": 1, "max": 2}, "tags": ["x"]}
    r = parse_recipe("top", raw)
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "n int, k string")
    assert r.order_columns == ["k", "n"] and [x.k for x in top_rows({"t": df}, r).collect()] == ["b"]
    assert [x.n for x in top_rows({"t": df}, r, "n", limit=50).collect()] == [3, 2] and [x.n for x in top_rows({"t": df}, r, "n", {"k": "a"}).collect()] == [1]
    joined = parse_recipe("j", {"type": "joined_top", "primary": "t", "columns": ["n"], "join": {"right": "u", "left_on": "k", "right_on": "k2"}})
    assert (joined.join_table, joined.left_key, joined.right_key) == ("u", "k", "k2")
    for bad in ({"type": "other"}, {"columns": []}, {"order_by": {"allowed": ["z"]}}, {"limit": {"default": 5, "max": 2}}, {"table": None}, {"filters": ["k"]}, {"type": "joined_top"}):
        with pytest.raises(ValueError):
            parse_recipe("top", raw | bad)


def test_catalog_listings():
    fields = [MetricField("n", "count"), MetricField("v", "max_value")]
    cat = catalog_of([MetricsModel("daily", ["a"], "daily", fields, ["source"]), MetricsModel("hourly", ["a"], "hourly", fields[:1])])
    assert [m["metric_id"] for m in list_metrics(cat)] == ["daily.n_count", "daily.v_max_value", "hourly.n_count"] and len(list_dimensions(cat, "hourly")) == 1
    assert describe_metric(cat, "n_count")["ambiguous"] and describe_metric(cat, "n_count", "daily")["dimensions"] == ["_date", "source"]
    assert describe_metric(cat, "daily.v_max_value")["matches"][0]["reaggregated_by"] == "max" and describe_dimension(cat, "source")["metrics"] == ["n_count", "v_max_value"]
    assert describe_metric(cat, "none")["count"] == 0


def test_dag_page_draws_edges():
    page = dag_html(registries(StateSource(name="s", path="x", id_field="id"), AnalyticsEntity("e", state_fields=[StateField("n", "s", "n")])))
    assert page.count("<rect") == 2 and page.count("<path") == 1
