"""The named tables, how each is made, and writing them in order."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F

from emberlog import schemas as S
from emberlog.functions.metrics import MIB
from emberlog.plans import gold, silver
from emberlog.session import (
    CODEC,
    TABLE_OPTIONS,
    open_writers,
    shuffles_dropped,
    small_partitions,
    written_aside,
)
from emberlog.sources.eventlog import fill_app_ids, read_lines, stated_ids, tag_events
from emberlog.sources.quality import TABLE_RULES, count_violations, drop_bad_rows

# SQL end events are broadcast up to this many rows (about 100 bytes each).
BROADCAST_MAX_EXECUTIONS = 1_000_000


@dataclass(frozen=True)
class Table:
    """A named table: its inputs by name and the function that makes it.

    ``build`` starts no Spark job. ``build_written`` may: it is used where the inputs
    are written tables, whose sizes cost only a look at their metadata.
    """

    layer: str
    comment: str
    inputs: tuple[str, ...]
    build: Callable[..., DataFrame]
    build_written: Callable[..., DataFrame] | None = None


BRONZE = "bronze_raw_events"


def _sql_executions(bronze_raw_events: DataFrame) -> DataFrame:
    return silver.sql_executions(bronze_raw_events, BROADCAST_MAX_EXECUTIONS)


# In build order: every input is above the table that reads it.
TABLES: dict[str, Table] = {
    BRONZE: Table("bronze", "one row per event-log line that is an event", (), fill_app_ids),
    "silver_application_events": Table(
        "silver", "application start and end", (BRONZE,), silver.application_events
    ),
    "silver_job_events": Table("silver", "job start and end", (BRONZE,), silver.job_events),
    "silver_stage_events": Table(
        "silver", "completed stage attempts with their metrics", (BRONZE,), silver.stage_events
    ),
    "silver_task_events": Table(
        "silver", "finished tasks with their metrics", (BRONZE,), silver.task_events
    ),
    "silver_executor_events": Table(
        "silver", "executors added and removed", (BRONZE,), silver.executor_events
    ),
    "silver_resource_profiles": Table(
        "silver", "memory and CPU requests per profile", (BRONZE,), silver.resource_profiles
    ),
    "silver_spark_config": Table(
        "silver", "performance-related settings", (BRONZE,), silver.spark_config
    ),
    "silver_sql_executions": Table(
        "silver",
        "SQL executions with their plan text",
        (BRONZE,),
        silver.sql_executions,
        _sql_executions,
    ),
    "work_stage_task_profile": Table(
        "work", "task distribution per stage attempt", ("silver_task_events",),
        gold.stage_task_profile,
        partial(gold.stage_task_profile, exact=True),
    ),
    "work_job_stage_map": Table(
        "work", "stages of each job", ("silver_job_events",), gold.job_stage_map
    ),
    "work_executor_load": Table(
        "work", "task sums per executor", ("silver_task_events",), gold.executor_load
    ),
    "gold_application_summary": Table(
        "gold",
        "key figures per application",
        ("silver_application_events", "silver_stage_events", "silver_job_events"),
        gold.application_summary,
    ),
    "gold_job_performance": Table(
        "gold", "duration and outcome per job", ("silver_job_events",), gold.job_performance
    ),
    "gold_stage_performance": Table(
        "gold",
        "task distribution, bottleneck and advice per stage attempt",
        ("silver_stage_events", "work_stage_task_profile"),
        gold.stage_performance,
    ),
    "gold_executor_analysis": Table(
        "gold",
        "load balance per executor",
        ("work_executor_load", "silver_executor_events", "silver_resource_profiles"),
        gold.executor_analysis,
        partial(gold.executor_analysis, write_norms=True),
    ),
    "gold_bottleneck_report": Table(
        "gold",
        "stages with a bottleneck, per job",
        ("gold_stage_performance", "work_job_stage_map"),
        gold.bottleneck_report,
    ),
    "gold_job_concurrency": Table(
        "gold",
        "jobs running at the start of each job, with its CPU figures",
        ("gold_job_performance", "work_stage_task_profile", "work_job_stage_map"),
        gold.job_concurrency,
    ),
    "gold_sql_photon_analysis": Table(
        "gold",
        "accelerated share and joins per SQL execution",
        ("silver_sql_executions",),
        gold.sql_photon_analysis,
    ),
}


def build_tables(bronze: DataFrame, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Tables as lazy DataFrames over tagged lines, nothing written; all by default."""
    made = {BRONZE: fill_app_ids(bronze)}

    def build(name: str) -> DataFrame:
        if name not in made:
            df = TABLES[name].build(*[build(i) for i in TABLES[name].inputs])
            made[name] = drop_bad_rows(df, TABLE_RULES.get(name, ()))
        return made[name]

    return {name: build(name) for name in (TABLES if names is None else names)}


# Log text shrinks ten- to a hundredfold, and a row group counts its pages as they are
# written. A page that may grow larger than its group keeps the count in bytes of text, so
# that a group ends after so much of it and the parsing of one file stays divisible.
ROW_GROUP_TEXT = 32 * MIB
ROW_GROUP_ROWS = 20_000
# Compressing log text is a good part of writing it. This level takes half the time of
# level 6, and no more space than Parquet's level 3.
TEXT_LEVEL = 1
# A few bytes of a shuffled row become a kilobyte of text.
SHUFFLED_FOR_TEXT = "16m"


# A kind of event is in crumbs if it has more files than this and so small ones on average.
MANY_FILES, SMALL_FILE = 16, MIB


def _bronze_writer(df: DataFrame) -> DataFrameWriter:
    return (
        df.write.mode("overwrite")
        .partitionBy("event_kind")
        .option("compression", CODEC)
        .option("parquet.compression.codec.zstd.level", TEXT_LEVEL)
        # Lines do not repeat: a dictionary of them is begun in vain in each row group.
        .option("parquet.enable.dictionary#value", "false")
        .option("parquet.block.size", ROW_GROUP_TEXT)
        .option("parquet.page.size", 2 * ROW_GROUP_TEXT)
        .option("parquet.block.row.count.limit", ROW_GROUP_ROWS)
    )


def _kinds_in_crumbs(spark: SparkSession, path: str) -> list[str]:
    """By listing alone; there are a dozen kinds."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.regexp_extract("path", "/event_kind=([^/]*)/[^/]*$", 1).alias("kind")
    kinds = files.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    found = kinds.where((F.col("n") > MANY_FILES) & (F.col("mean") < SMALL_FILE)).collect()
    return [row["kind"] for row in found if row["kind"]]


def write_bronze_rows(df: DataFrame, path: str) -> None:
    """Write Bronze rows, split by event kind in small row groups.

    Lines are by far the largest rows of all, so they are neither shuffled nor sorted: a
    task writes a file for each kind it meets. Of rare kinds these are crumbs, which are
    gathered afterwards.
    """
    spark = df.sparkSession
    with shuffles_dropped(spark):
        with (
            open_writers(spark, len(S.KNOWN_EVENTS) + 1),
            small_partitions(spark, SHUFFLED_FOR_TEXT),
        ):
            _bronze_writer(df).parquet(path)
        crumbs = _kinds_in_crumbs(spark, path)
        if crumbs:
            rows = spark.read.schema(df.schema).parquet(path)
            rows = rows.where(F.col("event_kind").isin(crumbs)).hint("rebalance", "event_kind")
            gathered = written_aside(rows, "gathered")
            _bronze_writer(gathered).option("partitionOverwriteMode", "dynamic").parquet(path)


@dataclass(frozen=True)
class Lake:
    """A folder with one Parquet table per name; Bronze is split by event kind."""

    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def write(self, name: str, df: DataFrame) -> None:
        if name == BRONZE:
            write_bronze_rows(df, self.path(name))
        else:
            with shuffles_dropped(self.spark):
                df.write.mode("overwrite").options(**TABLE_OPTIONS).parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def register_views(self, prefix: str = "") -> list[str]:
        """Make the tables that are written readable by name from SQL; their names."""
        found = []
        for name in TABLES:
            try:
                df = self.read(name)
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
                continue
            df.createOrReplaceTempView(prefix + name)
            found.append(name)
        return found

    def register_tables(self, database: str) -> None:
        """Add the written tables to a catalog database, with comment and layer.

        They are external tables over this folder. Register again after Bronze got
        new kinds of events.
        """
        catalog = self.spark.catalog
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        for name, table in TABLES.items():
            full = f"`{database}`.`{name}`"
            if not catalog.tableExists(full):
                catalog.createTable(
                    full, path=self.path(name), source="parquet", description=table.comment
                )
                self.spark.sql(
                    f"ALTER TABLE {full} SET TBLPROPERTIES ('quality' = '{table.layer}')"
                )
            if name == BRONZE:
                catalog.recoverPartitions(full)


def write_table(lake: Lake, name: str, bronze: DataFrame | None = None) -> dict[str, int]:
    """Make one table from its written inputs; returns the counts of its rules.

    ``bronze``: Bronze as already read, to list its files once for many tables.
    """
    table, rules = TABLES[name], TABLE_RULES.get(name, ())
    df = (table.build_written or table.build)(
        *[
            bronze if i == BRONZE and bronze is not None else lake.read(i)
            for i in table.inputs
        ]
    )
    if not rules:
        lake.write(name, df)
        return {}
    observation = Observation(name)
    lake.write(name, drop_bad_rows(count_violations(df, rules, observation), rules))
    return {k: int(v or 0) for k, v in observation.get.items()}


def write_bronze(lake: Lake, lines: DataFrame, cluster_id: str) -> None:
    """Tag and write the lines in one pass. Only if some have no id in their path are they
    written again, with the ids that their files state."""
    tagged, missing = tag_events(lines, cluster_id), Observation("without_app_id")
    lake.write(BRONZE, tagged.observe(missing, F.count_if(F.col("app_id").isNull()).alias("rows")))
    if missing.get.get("rows"):
        stated = written_aside(stated_ids(lake.read(BRONZE)), "stated-ids")
        lake.write(BRONZE, fill_app_ids(tagged, stated=stated))


def run(
    spark: SparkSession,
    log_root: str,
    cluster_id: str,
    output_root: str,
    lines: DataFrame | None = None,
) -> dict[str, dict[str, int]]:
    """Read the logs of a cluster and write every table below ``output_root``.

    Returns the rule counts per table. Each table reads written inputs, so a lost
    executor costs at most the running step. ``lines`` replaces the log reader.
    """
    lake = Lake(spark, output_root)
    lines = read_lines(spark, log_root, cluster_id) if lines is None else lines
    write_bronze(lake, lines, cluster_id)
    bronze = lake.read(BRONZE)
    return {name: write_table(lake, name, bronze) for name in TABLES if name != BRONZE}


# Session settings that name the input.
LOG_ROOT_SETTING = "pipeline.log_root"
CLUSTER_ID_SETTING = "pipeline.cluster_id"


def run_configured(spark: SparkSession, output_root: str) -> dict[str, dict[str, int]]:
    """``run`` with the log root and cluster id taken from the session settings."""
    return run(
        spark, spark.conf.get(LOG_ROOT_SETTING), spark.conf.get(CLUSTER_ID_SETTING), output_root
    )


def table_sizes(lake: Lake) -> DataFrame:
    """(table, rows) of the written tables."""
    counts = [
        lake.read(name).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
        for name in TABLES
    ]
    total = counts[0]
    for count in counts[1:]:
        total = total.unionByName(count)
    return total
