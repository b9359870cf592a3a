"""Typed tables, one per kind of event, each from one parse of its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog import schemas as S
from emberlog.functions.metrics import (
    cpu_percent,
    difference,
    gc_percent,
    millis_to_ts,
    numbers_found,
    to_double,
    to_int,
    to_long,
)
from emberlog.operators.dedup import latest_by_key


def _parsed(bronze: DataFrame, events: tuple[str, ...], shape: str) -> DataFrame:
    """Lines of the given events with their payload as struct ``p``.

    On a Bronze table, which is partitioned by event kind, the filter prunes partitions.
    """
    return bronze.where(F.col("event_kind").isin(*events)).select(
        "cluster_id",
        "app_id",
        "event_type",
        "source_file",
        "ingested_at",
        F.from_json("value", shape).alias("p"),
    )


def _field(*path: str) -> Column:
    column = F.col("p")
    for name in path:
        column = column.getField(name)
    return column


def application_events(bronze_raw_events: DataFrame) -> DataFrame:
    ms = to_long(_field("Timestamp"))
    return _parsed(
        bronze_raw_events, (S.APPLICATION_START, S.APPLICATION_END), S.APPLICATION_EVENT
    ).select(
        "cluster_id",
        "app_id",
        "event_type",
        _field("App Name").alias("app_name"),
        F.coalesce(_field("Spark User"), _field("User")).alias("spark_user"),
        millis_to_ts(ms).alias("timestamp_ts"),
        ms.alias("timestamp_ms"),
        "source_file",
        "ingested_at",
    )


def job_events(bronze_raw_events: DataFrame) -> DataFrame:
    submitted = to_long(_field("Submission Time"))
    completed = to_long(_field("Completion Time"))
    return _parsed(bronze_raw_events, (S.JOB_START, S.JOB_END), S.JOB_EVENT).select(
        "cluster_id",
        "app_id",
        "event_type",
        to_int(_field("Job ID")).alias("job_id"),
        millis_to_ts(submitted).alias("submission_ts"),
        millis_to_ts(completed).alias("completion_ts"),
        submitted.alias("submission_ms"),
        completed.alias("completion_ms"),
        _field("Job Result", "Result").alias("job_result"),
        _field("Stage IDs").alias("stage_ids"),
        "source_file",
        "ingested_at",
    )


# Column order of the two wide tables.
STAGE_COLUMNS = """
    cluster_id app_id stage_id attempt_id stage_name status failure_reason num_tasks
    submission_ts first_task_ts completion_ts duration_ms scheduling_delay_ms
    executor_run_time_ms executor_cpu_time_ns jvm_gc_time_ms gc_overhead_pct
    cpu_efficiency_pct deserialize_ms result_serialize_ms result_size_bytes
    peak_exec_memory_bytes memory_bytes_spilled disk_bytes_spilled
    input_bytes input_records output_bytes output_records
    shuffle_read_bytes shuffle_read_records shuffle_remote_bytes shuffle_local_bytes
    shuffle_remote_blocks shuffle_local_blocks shuffle_fetch_wait_ms
    shuffle_write_bytes shuffle_write_records shuffle_write_time_ns
    source_file ingested_at
""".split()
TASK_COLUMNS = """
    cluster_id app_id stage_id attempt_id task_id index task_type task_result
    executor_id host locality speculative launch_ts task_duration_ms
    executor_run_time_ms executor_cpu_time_ns deserialize_ms result_serialize_ms
    gc_time_ms gc_overhead_pct cpu_efficiency_pct result_size_bytes
    peak_exec_memory_bytes memory_bytes_spilled disk_bytes_spilled
    shuffle_read_bytes shuffle_read_records shuffle_remote_bytes shuffle_local_bytes
    shuffle_remote_blocks shuffle_local_blocks shuffle_fetch_wait_ms
    shuffle_write_bytes shuffle_write_records shuffle_write_time_ns
    input_bytes input_records output_bytes output_records ingested_at
""".split()


def stage_events(bronze_raw_events: DataFrame) -> DataFrame:
    info = _parsed(bronze_raw_events, (S.STAGE_COMPLETED,), S.STAGE_EVENT).select(
        "cluster_id", "app_id", "source_file", "ingested_at", _field("Stage Info").alias("p")
    )
    # A stage lists every SQL metric too: keep the internal ones once and look all
    # wanted names up in two arrays of their fields.
    internal = F.filter(
        _field("Accumulables"), lambda a: a["Name"].startswith(S.ACCUMULATOR_PREFIX)
    )
    fields = {"names": F.col("m").getField("Name"), "texts": F.col("m").getField("Value")}
    info = info.withColumn("m", internal).withColumns(fields)
    metrics = numbers_found(F.col("names"), F.col("texts"), [*S.STAGE_METRICS.values()])
    with_metrics = info.withColumns(dict(zip(S.STAGE_METRICS, metrics)))
    submitted, first_task = _field("Submission Time"), _field("First Task Launched Time")
    completed, reason = _field("Completion Time"), _field("Failure Reason")
    base = with_metrics.select(
        "cluster_id",
        "app_id",
        _field("Stage ID").alias("stage_id"),
        _field("Stage Attempt ID").alias("attempt_id"),
        _field("Stage Name").alias("stage_name"),
        F.when(reason != "", "FAILED").otherwise("COMPLETED").alias("status"),
        reason.alias("failure_reason"),
        _field("Number of Tasks").alias("num_tasks"),
        millis_to_ts(submitted).alias("submission_ts"),
        millis_to_ts(first_task).alias("first_task_ts"),
        millis_to_ts(completed).alias("completion_ts"),
        difference(completed, submitted).alias("duration_ms"),
        F.when(first_task.isNotNull(), difference(first_task, submitted))
        .otherwise(F.lit(0))
        .alias("scheduling_delay_ms"),
        *S.STAGE_METRICS,
        "source_file",
        "ingested_at",
    )
    return base.withColumns(
        {
            "shuffle_read_bytes": F.try_add(
                F.col("shuffle_remote_bytes"), F.col("shuffle_local_bytes")
            ),
            "gc_overhead_pct": gc_percent("jvm_gc_time_ms", "executor_run_time_ms"),
            "cpu_efficiency_pct": cpu_percent("executor_cpu_time_ns", "executor_run_time_ms"),
        }
    ).select(*STAGE_COLUMNS)


# Output column -> place in the task-end payload.
TASK_FIELDS = {
    "stage_id": ("Stage ID",),
    "attempt_id": ("Stage Attempt ID",),
    "task_type": ("Task Type",),
    "task_result": ("Task End Reason", "Reason"),
    "task_id": ("Task Info", "Task ID"),
    "index": ("Task Info", "Index"),
    "executor_id": ("Task Info", "Executor ID"),
    "host": ("Task Info", "Host"),
    "locality": ("Task Info", "Locality"),
    "speculative": ("Task Info", "Speculative"),
    "executor_run_time_ms": ("Task Metrics", "Executor Run Time"),
    "executor_cpu_time_ns": ("Task Metrics", "Executor CPU Time"),
    "deserialize_ms": ("Task Metrics", "Executor Deserialize Time"),
    "result_serialize_ms": ("Task Metrics", "Result Serialization Time"),
    "gc_time_ms": ("Task Metrics", "JVM GC Time"),
    "result_size_bytes": ("Task Metrics", "Result Size"),
    "peak_exec_memory_bytes": ("Task Metrics", "Peak Execution Memory"),
    "memory_bytes_spilled": ("Task Metrics", "Memory Bytes Spilled"),
    "disk_bytes_spilled": ("Task Metrics", "Disk Bytes Spilled"),
    "shuffle_remote_blocks": ("Task Metrics", "Shuffle Read Metrics", "Remote Blocks Fetched"),
    "shuffle_local_blocks": ("Task Metrics", "Shuffle Read Metrics", "Local Blocks Fetched"),
    "shuffle_fetch_wait_ms": ("Task Metrics", "Shuffle Read Metrics", "Fetch Wait Time"),
    "shuffle_remote_bytes": ("Task Metrics", "Shuffle Read Metrics", "Remote Bytes Read"),
    "shuffle_local_bytes": ("Task Metrics", "Shuffle Read Metrics", "Local Bytes Read"),
    "shuffle_read_records": ("Task Metrics", "Shuffle Read Metrics", "Total Records Read"),
    "shuffle_write_bytes": ("Task Metrics", "Shuffle Write Metrics", "Shuffle Bytes Written"),
    "shuffle_write_time_ns": ("Task Metrics", "Shuffle Write Metrics", "Shuffle Write Time"),
    "shuffle_write_records": (
        "Task Metrics",
        "Shuffle Write Metrics",
        "Shuffle Records Written",
    ),
    "input_bytes": ("Task Metrics", "Input Metrics", "Bytes Read"),
    "input_records": ("Task Metrics", "Input Metrics", "Records Read"),
    "output_bytes": ("Task Metrics", "Output Metrics", "Bytes Written"),
    "output_records": ("Task Metrics", "Output Metrics", "Records Written"),
}


def task_events(bronze_raw_events: DataFrame) -> DataFrame:
    launched = _field("Task Info", "Launch Time")
    zero = F.lit(0).cast("long")
    flat = _parsed(bronze_raw_events, (S.TASK_END,), S.TASK_EVENT).select(
        "cluster_id",
        "app_id",
        *[_field(*path).alias(name) for name, path in TASK_FIELDS.items()],
        millis_to_ts(launched).alias("launch_ts"),
        difference(_field("Task Info", "Finish Time"), launched).alias("task_duration_ms"),
        "ingested_at",
    )
    return flat.withColumns(
        {
            "shuffle_read_bytes": F.try_add(
                F.coalesce("shuffle_remote_bytes", zero), F.coalesce("shuffle_local_bytes", zero)
            ),
            "gc_overhead_pct": gc_percent("gc_time_ms", "task_duration_ms"),
            "cpu_efficiency_pct": cpu_percent("executor_cpu_time_ns", "executor_run_time_ms"),
        }
    ).select(*TASK_COLUMNS)


def executor_events(bronze_raw_events: DataFrame) -> DataFrame:
    return _parsed(
        bronze_raw_events, (S.EXECUTOR_ADDED, S.EXECUTOR_REMOVED), S.EXECUTOR_EVENT
    ).select(
        "cluster_id",
        "app_id",
        "event_type",
        _field("Executor ID").alias("executor_id"),
        millis_to_ts(to_long(_field("Timestamp"))).alias("timestamp_ts"),
        _field("Executor Info", "Host").alias("host"),
        to_int(_field("Executor Info", "Total Cores")).alias("total_cores"),
        _field("Removed Reason").alias("removed_reason"),
        to_int(_field("Executor Info", "Resource Profile Id")).alias("resource_profile_id"),
        "ingested_at",
    )


def resource_profiles(bronze_raw_events: DataFrame) -> DataFrame:
    requests = "Executor Resource Requests"
    return _parsed(
        bronze_raw_events, (S.RESOURCE_PROFILE_ADDED,), S.RESOURCE_PROFILE_EVENT
    ).select(
        "cluster_id",
        "app_id",
        to_int(_field("Resource Profile Id")).alias("resource_profile_id"),
        to_double(_field(requests, "memory", "Amount")).alias("onheap_memory_mb"),
        to_double(_field(requests, "offHeap", "Amount")).alias("offheap_memory_mb"),
        to_double(_field("Task Resource Requests", "cpus", "Amount")).alias("task_cpus"),
        "ingested_at",
    )


def spark_config(bronze_raw_events: DataFrame) -> DataFrame:
    """Performance settings; of a key set twice one value is kept.

    Rolled files count by their number, properties by their place in the list. Lines
    have no order in the table, so of two updates in one file the choice is arbitrary
    but repeatable.
    """
    text = _field("Spark Properties")
    pairs = F.transform(
        F.from_json(text, "array<array<string>>"),
        lambda pair: F.struct(
            F.get(pair, F.lit(0)).alias("key"), F.get(pair, F.lit(1)).alias("value")
        ),
    )
    entries = F.map_entries(F.from_json(text, "map<string,string>"))
    settings = (
        _parsed(bronze_raw_events, (S.ENVIRONMENT_UPDATE,), S.ENVIRONMENT_EVENT)
        .select(
            "cluster_id",
            "app_id",
            "source_file",
            "ingested_at",
            F.posexplode(F.coalesce(pairs, entries)).alias("place", "setting"),
        )
        .select(
            "*",
            F.col("setting.key").alias("config_key"),
            F.col("setting.value").alias("config_value"),
        )
        .where(F.col("config_key").rlike(S.CONFIG_KEEP_PATTERN))
    )
    rolled = F.regexp_extract("source_file", S.ROLLED_FILE_PATTERN, 1).try_cast("long")
    newness = ["ingested_at", rolled, "source_file", "place", "config_value"]
    return latest_by_key(settings, ["cluster_id", "app_id", "config_key"], newness).select(
        "cluster_id", "app_id", "config_key", "config_value", "ingested_at"
    )


def sql_executions(
    bronze_raw_events: DataFrame, broadcast_max_rows: int | None = None
) -> DataFrame:
    """Start of each SQL execution with its end time, NULL while it runs.

    Plan texts are long, so the side carrying them should not be shuffled. With
    ``broadcast_max_rows`` the end events are counted first (a metadata-only
    count on a written Bronze table) and broadcast up to that many rows, about
    100 bytes each. Beyond it, or without it, Spark chooses the join.
    """
    end_lines = bronze_raw_events.where(F.col("event_kind") == S.SQL_END)
    starts = _parsed(bronze_raw_events, (S.SQL_START,), S.SQL_START_EVENT).select(
        "cluster_id",
        "app_id",
        to_long(_field("executionId")).alias("execution_id"),
        _field("description").alias("description"),
        _field("physicalPlanDescription").alias("physical_plan"),
        to_long(_field("time")).alias("start_time_ms"),
        "ingested_at",
    )
    ends = _parsed(bronze_raw_events, (S.SQL_END,), S.SQL_END_EVENT).select(
        "cluster_id",
        "app_id",
        to_long(_field("executionId")).alias("execution_id"),
        to_long(_field("time")).alias("end_time_ms"),
    )
    if broadcast_max_rows is not None and end_lines.count() <= broadcast_max_rows:
        ends = F.broadcast(ends)
    return starts.join(ends, ["cluster_id", "app_id", "execution_id"], "left")
