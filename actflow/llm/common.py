"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that separate words: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Rows that a worker takes from a batch, and sends back, at once.
PART_ROWS = 512

_local_dir: str | None = None
#: By its name, what the operator that ran last in this worker keeps from task to task.
_kept: dict[str, dict] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode."""
    global _local_dir
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_dir is None:
        _local_dir = "file://" + tempfile.mkdtemp(prefix="actflow-")
    return _local_dir


#: Paths written in each open scratch() block, the innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that materialize() writes within the block are deleted at its end: write or collect a result before."""
    mine: list[str] = []
    token = _scopes.set((*_scopes.get(), mine))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in mine:
            delete(spark, path)


def materialize(df: DataFrame, label: str, outer: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    The table outlives the innermost scratch() block if ``outer``, and goes with the one around it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/actflow/{label}-{uuid.uuid4().hex}"
    scopes = _scopes.get()[: -1 if outer else None]
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(operator: str) -> dict:
    """What an operator keeps in this worker from task to task. A worker serves the tasks of all stages in turn, so what another operator kept goes."""
    if operator not in _kept:
        _kept.clear()
        give_back()
    return _kept.setdefault(operator, {})


def give_back() -> None:
    """Memory that this process has freed goes back to the system: an idle worker would hold it beside the JVM's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def by_parts(operator: str, start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: ``start`` gives, once a task, a function that is applied to every ``PART_ROWS`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(operator)
        work, batch = start(), None
        for batch in batches:
            for at in range(0, batch.num_rows, PART_ROWS):
                yield work(batch.slice(at, PART_ROWS))
        del work, batch
        give_back()

    return run


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have in any letter case."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in fields)])


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id's text leaves ``rest`` when divided by ``mod``; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(True))
