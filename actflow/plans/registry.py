"""Assets by kind and name, and finding them in Python files."""

from __future__ import annotations

import hashlib
import importlib.util
import json
from collections.abc import Iterator
from pathlib import Path
from typing import Any

from ..model import ActivityDefinition, AnalyticsEntity, EventSource, IdentityGraph, MetricsModel, StagingView, StateSource

#: Kinds of assets, in the order in which they run.
KINDS = {
    "staging_views": StagingView, "state_sources": StateSource, "event_sources": EventSource, "activities": ActivityDefinition, "identity_graphs": IdentityGraph, "entities": AnalyticsEntity,
    "metrics_models": MetricsModel,
}


class Registry:
    """Assets of one kind; a name is used once."""

    def __init__(self, kind: type):
        self.kind, self._items = kind, {}

    def add(self, asset: Any) -> None:
        if not isinstance(asset, self.kind):
            raise TypeError(f"{asset!r} is no {self.kind.__name__}")
        if self._items.get(asset.name, asset) != asset:
            raise ValueError(f"{self.kind.__name__} {asset.name} is declared twice")
        self._items[asset.name] = asset

    def get(self, name: str) -> Any:
        return self._items[name]

    def all(self) -> list[Any]:
        return [self._items[k] for k in sorted(self._items)]

    def items(self):
        return [(k, self._items[k]) for k in sorted(self._items)]

    def __iter__(self) -> Iterator[Any]:
        return iter(self.all())

    def __len__(self) -> int:
        return len(self._items)

    def __contains__(self, name: str) -> bool:
        return name in self._items


def discover(folder: str, strict: bool = False) -> dict[str, Registry]:
    """Assets of all Python files below a folder. A file that fails is skipped unless ``strict``."""
    found = {k: Registry(t) for k, t in KINDS.items()}
    for path in sorted(Path(folder).rglob("*.py")):
        spec = importlib.util.spec_from_file_location(f"_asset_{hashlib.md5(str(path).encode()).hexdigest()}", path)
        module = importlib.util.module_from_spec(spec)
        try:
            spec.loader.exec_module(module)
        except Exception:
            if strict:
                raise
            continue
        for value in vars(module).values():
            for x in value if isinstance(value, list | tuple) else [value]:
                for k, kind in KINDS.items():
                    if type(x) is kind:
                        found[k].add(x)
    return found


def manifest(assets: dict[str, Registry]) -> dict[str, Any]:
    """Names by kind, and edges (from, to), sorted: equal assets give equal JSON."""
    edges = set()
    for s in (*assets["state_sources"], *assets["event_sources"]):
        edges |= {(j.source_name, s.name) for j in s.joins}
        edges |= {(s.upstream.name, s.name)} if s.upstream else set()
    for v in assets["staging_views"]:
        edges |= {(d, v.name) for d in v.depends_on}
    for a in assets["activities"]:
        edges.add((a.source, a.name))
    for g in assets["identity_graphs"]:
        edges |= {(s.source, g.name) for s in g.sources}
    for e in assets["entities"]:
        edges |= {(f.source, e.name) for f in e.state_fields} | {(m.activity, e.name) for m in e.measures}
        edges |= {(e.identity_graph, e.name)} if e.identity_graph else set()
    for m in assets["metrics_models"]:
        edges |= {(s, m.name) for s in m.sources}
    return {"assets": {k: [a.name for a in r] for k, r in assets.items()}, "edges": sorted(map(list, edges))}


def manifest_json(assets: dict[str, Registry]) -> str:
    return json.dumps(manifest(assets), sort_keys=True, indent=2)


def manifest_hash(assets: dict[str, Registry]) -> str:
    return hashlib.sha256(manifest_json(assets).encode()).hexdigest()


def dag_html(assets: dict[str, Registry]) -> str:
    """The manifest's graph as a page without scripts: a column of boxes for each kind, lines along the edges, and a list of them."""
    from html import escape

    m = manifest(assets)
    wide, high, step = 190, 28, 250
    place = {n: (x * step + 10, y * (high + 16) + 50) for x, names in enumerate(m["assets"].values()) for y, n in enumerate(names)}
    heads = "".join(f"<text x='{x * step + 10}' y='24' font-weight='bold'>{escape(k.replace('_', ' '))}</text>" for x, k in enumerate(m["assets"]))
    drawn = [(place[a], place[b]) for a, b in m["edges"] if a in place and b in place]
    lines = "".join(f"<path d='M{x0 + wide},{y0 + high // 2} C{x0 + step},{y0 + high // 2} {x1 - step + wide},{y1 + high // 2} {x1},{y1 + high // 2}' fill='none' stroke='#888'/>" for (x0, y0), (x1, y1) in drawn)
    boxes = "".join(f"<rect x='{x}' y='{y}' width='{wide}' height='{high}' fill='#eef' stroke='#446'/><text x='{x + 6}' y='{y + 19}'>{escape(n)}</text>" for n, (x, y) in place.items())
    size = f"width='{step * len(m['assets'])}' height='{max((y for _, y in place.values()), default=20) + 60}'"
    edges = "".join(f"<li>{escape(a)} &rarr; {escape(b)}</li>" for a, b in m["edges"])
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>DAG</title><style>svg{{font:13px sans-serif}}</style></head><body><svg xmlns='http://www.w3.org/2000/svg' {size}>{heads}{lines}{boxes}</svg><h2>edges</h2><ol>{edges}</ol></body></html>"
