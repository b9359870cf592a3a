"""Helpers of the operators: reading tables, Arrow batches, state kept by a worker."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from emberlog.session import checkpoint_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back.

    A lost executor then costs a reread and not the work before; what a task
    numbered by its partition also stays as it was.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_cache(key: tuple, build: Callable[[], Any]) -> Any:
    """A value a Python worker builds once and keeps over its tasks, until it builds
    another one: a worker that has served all stages then holds the state of one.

    Functions are shipped by value, so module globals would start anew per task.
    """
    store = sys.__dict__.setdefault("_emberlog_worker_cache", {})
    if key not in store:
        store.clear()
        store[key] = build()
    return store[key]


def give_back_memory() -> None:
    """Return what Arrow and, where it can, the C library hold free. Workers wait for
    their next task beside others, and an executor counts them all."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


# Documents are wide: a batch of them is held some times over by a worker and by the JVM.
MOST_ROWS_PER_BATCH = 500
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def gathered(batches: Iterator[pa.RecordBatch], least_rows: int) -> Iterator[pa.RecordBatch]:
    """The batches, joined until they have so many rows; the last may have fewer."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= least_rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def map_batches(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]],
    schema: str,
    least_rows: int = 1,
) -> DataFrame:
    """Rows made batch by batch: ``make()`` runs in the task and gives the function
    from a record batch to output columns by name. Lowers the session's limit of rows
    per Arrow batch if it is larger than the one above. ``least_rows``: rows that the
    function should see at once, if the rows are narrow."""
    settings = df.sparkSession.conf
    if not 0 < int(settings.get(BATCH_SETTING)) <= MOST_ROWS_PER_BATCH:
        settings.set(BATCH_SETTING, str(MOST_ROWS_PER_BATCH))
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = make()
        for batch in gathered(batches, least_rows):
            if batch.num_rows:
                columns = convert(batch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], f.type) for f in arrow], schema=arrow
                )
        give_back_memory()

    return df.mapInArrow(run, schema)


# Of all rows a key has at least this share or is no hot one; so there are no more hot ones.
HOT_KEYS = 1000


def join_hot(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``values``, which has a row per key and ``n``, how many
    of the ``total`` rows the key has.

    Spark splits a hot key only where both sides are bare shuffles. Here the values of
    the keys with a thousandth of all rows or more are broadcast, and their rows stay
    where they are; no task gets more than a thousandth of the rows for one key."""
    hot = F.col("n") * HOT_KEYS >= total
    known = rows.join(F.broadcast(values.where(hot)), key, "left")
    others = known.where("n IS NULL").select(*rows.columns).join(values.where(~hot), key)
    return known.where("n IS NOT NULL").unionByName(others)


def crc32_mod(column: str, modulus: int):
    """crc32 of the decimal text of a column, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
