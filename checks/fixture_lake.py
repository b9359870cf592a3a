"""The written tables behind the checked queries, made once per session and folder."""

from __future__ import annotations

import hashlib
import threading

from pyspark.sql import DataFrame, SparkSession

from checks.adapter import CLUSTER, event_lines
from emberlog.plans.lake import BRONZE, TABLES, Lake, write_bronze, write_table
from emberlog.session import checkpoint_root, open_writers, shuffles_dropped
from emberlog.sources.eventlog import app_id_from_path, log_path
from emberlog.sources.quality import TABLE_RULES, drop_bad_rows

# Applications that a task writes at once; the rows of more would be sorted.
MOST_FOLDERS = 1_000

# At the usual level compressing takes as long as making the lines.
LOG_OPTIONS = {"compression": "gzip", "zlib.compress.level": "FOUR"}

_written: dict[tuple[str, str], set[str]] = {}
_lock = threading.RLock()


def _lake(spark: SparkSession, sf_dir: str) -> tuple[Lake, set[str]]:
    application = spark.sparkContext.applicationId
    folder = hashlib.sha256(sf_dir.encode()).hexdigest()[:12]
    lake = Lake(spark, f"{checkpoint_root(spark)}/tables-{application}-{folder}")
    return lake, _written.setdefault((application, sf_dir), set())


def written(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table read back from the shared folder; written on first use."""
    with _lock:
        lake, done = _lake(spark, sf_dir)
        if name not in done:
            if name == BRONZE:
                write_bronze(lake, event_lines(spark, sf_dir), CLUSTER)
            else:
                for needed in TABLES[name].inputs:
                    written(spark, sf_dir, needed)
                write_table(lake, name)
            done.add(name)
    return lake.read(name)


def computed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The lazy plan that makes a table from its written inputs."""
    table = TABLES[name]
    df = table.build(*[written(spark, sf_dir, i) for i in table.inputs])
    return drop_bad_rows(df, TABLE_RULES.get(name, ()))


def registered(spark: SparkSession, sf_dir: str, names: list[str]) -> str:
    """Views of the tables by name; the prefix of the views' names."""
    for name in names:
        written(spark, sf_dir, name)
    lake, _ = _lake(spark, sf_dir)
    prefix = f"t{hashlib.sha256(sf_dir.encode()).hexdigest()[:8]}_"
    lake.register_views(prefix)
    return prefix


def log_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of compressed log files, a sub-folder per application; made on first use."""
    with _lock:
        lake, done = _lake(spark, sf_dir)
        root = f"{lake.root}/logs"
        if "log files" not in done:
            lines = event_lines(spark, sf_dir, by_application=True)
            lines = lines.select("value", app_id_from_path("source_file").alias("app"))
            with open_writers(spark, MOST_FOLDERS), shuffles_dropped(spark):
                lines.write.mode("overwrite").partitionBy("app").options(**LOG_OPTIONS).text(
                    log_path(root, CLUSTER)
                )
            done.add("log files")
    return root
