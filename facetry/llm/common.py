"""Small helpers for Arrow-batched operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from facetry.session import ship

ROWS_PER_SLICE = 512
#: Bytes of a batch between Spark and Python where texts are sent, at about most.
BATCH_BYTES = 4 << 20


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], dict[str, list] | pa.RecordBatch], schema: str) -> DataFrame:
    """Map every slice of at most ``ROWS_PER_SLICE`` rows with ``work``; it returns
    the output columns as lists (or arrays) in the order of ``schema``."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_SLICE):
                yield from _as_batches(work(batch.slice(start, ROWS_PER_SLICE)), types)

    types = arrow_types(df, schema)
    return df.mapInArrow(giving_back(run), schema)


def give_back() -> None:
    """Return the memory that was freed to the system. Python workers outlive their task
    and else keep what it took, beside all that other stages take in the same executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def giving_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` that returns its task's memory at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Whatever runs in here sends at most about ``BATCH_BYTES`` to Python at once; by
    default it is 64 MB, which a task holds more than once, there and in the JVM."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def arrow_types(df: DataFrame, schema: str) -> pa.Schema:
    """The Arrow schema of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _as_batches(columns: dict[str, list], types: pa.Schema) -> Iterator[pa.RecordBatch]:
    arrays = [v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(columns.values(), types, strict=True)]
    yield pa.RecordBatch.from_arrays(arrays, schema=types)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as Python strings, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]
