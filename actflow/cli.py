"""Command line: init, run, bench, dag, manifest, materialize, drop, list-staging."""

from __future__ import annotations

import argparse
import datetime
import json
from pathlib import Path

from .plans.config import FILE, resolve_config
from .plans.pipeline import Pipeline
from .plans.registry import dag_html, discover, manifest_json
from .sources.readers import drop_view, session
from .sources.staging import materialize_staging

_EXAMPLE = '''from actflow.model import AnalyticsEntity, Measure, StateField, StateSource

customers = StateSource(name="customers", path="customers.parquet", id_field="id")
entity = AnalyticsEntity(
    name="customer",
    state_fields=[StateField("plan", source="customers", field="plan")],
    measures=[Measure("appearances", activity="row_appeared", aggregation="count")],
)
'''


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="actflow")
    parser.add_argument("command", choices=["init", "run", "bench", "dag", "manifest", "materialize", "drop", "list-staging"])
    for name in ("entities-dir", "data-dir", "output-dir", "snapshot-dir"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--date", default=datetime.date.today().isoformat())
    parser.add_argument("--output")
    args = parser.parse_args(argv)
    if args.command == "init":
        for d in ("entities", "data"):
            Path(d).mkdir(exist_ok=True)
        Path(FILE).write_text(json.dumps({"entities_dir": "entities", "data_dir": "data"}, indent=2))
        Path("entities/customer.py").write_text(_EXAMPLE)
        return 0
    config = resolve_config(entities_dir=args.entities_dir, data_dir=args.data_dir, output_dir=args.output_dir, snapshot_dir=args.snapshot_dir)
    assets = discover(config.entities_dir, strict=True)
    if args.command in ("dag", "manifest"):
        text = dag_html(assets) if args.command == "dag" else manifest_json(assets)
        Path(args.output).write_text(text) if args.output else print(text)
        return 0
    if args.command == "list-staging":
        print(*(v.name for v in assets["staging_views"]), sep="\n")
        return 0
    spark = session(**config.spark)
    if args.command == "materialize":
        print(json.dumps(materialize_staging(spark, assets["staging_views"].all(), lasting=True)))
    elif args.command == "drop":
        for v in assets["staging_views"]:
            drop_view(spark, v.name, v.dataset)
    else:
        result = Pipeline(spark, assets, config.data_dir, config.output_dir, config.snapshot_dir, args.date, parallel=config.max_parallel_io).run()
        print(json.dumps({"outputs": result.outputs, "errors": result.errors} | ({"timings": result.timings} if args.command == "bench" else {}), indent=2))
        return bool(result.errors)
    return 0
