"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Named at every write of a table too, for sessions that others built.
CODEC = "zstd"
# Of a written table. The newer encodings store numbers that are too many for a dictionary
# as differences in few bits, which is smaller and takes less time.
TABLE_OPTIONS = {"compression": CODEC, "parquet.writer.version": "v2"}

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": CODEC,
    # Checkpoints go with the DataFrames that made them; tables written to the shared
    # folder stay until its owner removes them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    app_name: str = "emberlog",
    master: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings above. ``master=None`` keeps spark-submit's."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="emberlog-checkpoint-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


@contextmanager
def _with_setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def open_writers(spark: SparkSession, most: int) -> Iterator[None]:
    """Tasks that write to sub-folders keep up to ``most`` files open. By default Spark
    sorts the rows of each task by sub-folder first, and spills whole texts for it."""
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    with _with_setting(spark, setting, str(max(most, int(spark.conf.get(setting))))):
        yield


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a plan go once it has run. By default they stay on the disks
    until the driver collects garbage, and with them those of every table before."""
    with _with_setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


@contextmanager
def small_partitions(spark: SparkSession, size: str) -> Iterator[None]:
    """Shuffled partitions are merged up to ``size`` only: for tasks that make rows much
    wider than those they read, and would spill."""
    with _with_setting(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", size):
        yield


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def written_aside(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    Unlike a checkpoint it forgets how the rows were partitioned: a join then shuffles
    both sides alike, which is what lets Spark split a skewed key.
    """
    path = f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
