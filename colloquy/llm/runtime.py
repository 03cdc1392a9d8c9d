"""What the operators share: per-process caches, written intermediates, files in shared storage."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.session import scratch_path

# Bytes of one Arrow batch that a Python function hands back.
OUT_BYTES = 16 << 20


def once_per_process(key: tuple, make: Callable[[], Any]) -> Any:
    """`make()` the first time a worker process asks for `key`; what it had for other keys goes.

    Kept on `sys`: functions travel to executors by value, so a module's own
    globals would be new in every task. Workers live on from stage to stage, so
    that only one operator's tables may stay.
    """
    kept = sys.__dict__.setdefault("_colloquy_once", {})
    if key not in kept:
        forget()
        kept[key] = make()
    return kept[key]


def forget() -> None:
    """Give back what earlier tasks left in this worker process; for operators that keep nothing.

    Freed memory stays with the allocators otherwise, and the workers of a
    pipeline would grow to the sum of its stages.
    """
    sys.__dict__.setdefault("_colloquy_once", {}).clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str, arrow_rows: int | None = None) -> DataFrame:
    """Write `df` once to the shared scratch folder and read it back.

    Cuts lineage, so that a lost executor costs a re-read and jobs with side
    files run once. `arrow_rows` bounds the rows of the batches that go to Python
    meanwhile, for rows with whole texts.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(ARROW_ROWS)
    try:
        if arrow_rows:
            spark.conf.set(ARROW_ROWS, str(arrow_rows))
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark, name: str) -> str:
    """A new folder that every executor can write to, as a URI."""
    uri = scratch_path(spark, name)
    files, path = pafs.FileSystem.from_uri(uri)
    files.create_dir(path, recursive=True)
    return uri


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI (file, hdfs, s3, gs); plain paths are local."""
    return pafs.FileSystem.from_uri(uri)


def batches(rows: Iterable[tuple], schema: pa.Schema, sized: int | None = None, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size, `most` bytes if given; `sized` is a column of texts or bytes that counts towards it."""
    most = most or OUT_BYTES
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 64 + (len(row[sized]) if sized is not None and row[sized] is not None else 0)
        if size >= most:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(values, type=field.type) for values, field in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def picked(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named inputs, under the operator's own names: other columns cannot clash."""
    return df.select(*(F.col(f"`{c}`").alias(n) if isinstance(c, str) else c.alias(n) for n, c in columns.items()))
