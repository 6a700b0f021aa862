"""What operators with Python tasks share: importable code on executors, row plumbing."""

from __future__ import annotations

import functools
import gc
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rows that go to a Python task at once, where the session does not say.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it, and bound the batches they get.

    Rows here hold whole texts, one or two each: Spark's 10,000 rows or 64 MiB a batch stand in
    the executor and in its worker, twice while a buffer grows. A longer text is a batch of its own.
    """
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, known) if p)
    if BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


_KEPT: list[Callable] = []


def kept_by_worker(make: Callable) -> Callable:
    """``make`` with its last result kept by the worker, until :func:`let_go`."""
    held = functools.lru_cache(maxsize=1)(make)
    _KEPT.append(held)
    return held


def let_go() -> None:
    """Drop what other operators' tasks left in this worker: a pipeline's stages share the workers, not the caches."""
    full = [held for held in _KEPT if held.cache_info().currsize]
    for held in full:
        held.cache_clear()
    if full:
        gc.collect()
        pa.default_memory_pool().release_unused()


def typed(df: DataFrame, name: str, as_name: str | None = None) -> T.StructField:
    """The field of ``name`` in ``df``, nullable, for schemas that hand a key through."""
    return T.StructField(as_name or name, df.schema[name].dataType, True)


def texts(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def one_by_one(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Cut batches to ``rows`` rows, which bounds what is built from a batch at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores in front as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def packed(docs: DataFrame, **names: str) -> DataFrame:
    """``docs`` with the columns ``names`` under new names and all others in one struct ``rest``.

    Inside an operator no user's column can then clash with one of its own.
    """
    others = [c for c in docs.columns if c not in names.values()]
    rest = F.struct(*(F.col(f"`{c}`") for c in others), F.lit(0).alias(fresh(docs, "pad")))
    return docs.select(*(F.col(f"`{old}`").alias(new) for new, old in names.items()), rest.alias("rest"))


def unpacked(df: DataFrame, docs: DataFrame, **names: str) -> DataFrame:
    """The columns of ``docs`` from what :func:`packed` made of it."""
    inner = {old: new for new, old in names.items()}
    return df.select(*((F.col(inner[c]) if c in inner else F.col("rest").getField(c)).alias(c) for c in docs.columns))
