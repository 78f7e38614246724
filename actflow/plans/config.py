"""Project settings: from the command line, else from actflow.json in this folder or one above, else defaults."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

FILE = "actflow.json"


@dataclass(frozen=True)
class Config:
    entities_dir: str = "entities"
    data_dir: str = "data"
    output_dir: str = "generated"
    snapshot_dir: str = "snapshots"
    max_parallel_io: int = 4
    spark: dict[str, str] = field(default_factory=dict)  # settings of the session, such as its catalog

    def __post_init__(self) -> None:
        if self.max_parallel_io < 1:
            raise ValueError("max_parallel_io is 1 at least")


def find_config(start: str = ".") -> Path | None:
    here = Path(start).resolve()
    return next((p / FILE for p in (here, *here.parents) if (p / FILE).is_file()), None)


def resolve_config(start: str = ".", **given) -> Config:
    path = find_config(start)
    values = json.loads(path.read_text()) if path else {}
    known = {f.name for f in fields(Config)}
    if unknown := set(values) - known:
        raise ValueError(f"{FILE} has unknown settings: {', '.join(sorted(unknown))}")
    root = path.parent if path else Path(start).resolve()
    values |= {k: v for k, v in given.items() if v is not None}
    config = Config(**values)
    place = {k: str((root / getattr(config, k)).resolve()) for k in known if k.endswith("_dir")}
    return Config(**place, max_parallel_io=config.max_parallel_io, spark=config.spark)
