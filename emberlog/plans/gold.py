"""Diagnostic tables composed from the typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog import schemas as S
from emberlog.functions import plan_text as P
from emberlog.functions.metrics import (
    count_where,
    difference,
    guarded_percent,
    in_gib,
    in_mib,
    in_seconds,
    millis_to_ts,
    skew_ratio,
)
from emberlog.operators.concurrency import interval_concurrency
from emberlog.operators.distribution import Spread, distribution_profile
from emberlog.operators.idlists import explode_id_list
from emberlog.operators.lifecycle import lifecycle_pivot
from emberlog.operators.peers import peer_load
from emberlog.operators.rules import (
    RECOMMENDATIONS,
    Thresholds,
    bottleneck_rules,
    classify,
)

APP = ["cluster_id", "app_id"]
JOB = [*APP, "job_id"]
STAGE = [*APP, "stage_id"]
ATTEMPT = [*STAGE, "attempt_id"]
EXECUTOR = [*APP, "executor_id"]

MILLIS_PER_MINUTE = 60_000


# --- intermediate tables, each used by more than one diagnostic --------------------


def stage_task_profile(silver_task_events: DataFrame, exact: bool = False) -> DataFrame:
    """Successful tasks of each stage attempt: distribution and sums in one pass.

    ``exact``: see :func:`distribution_profile`; it starts jobs.
    """
    return distribution_profile(
        silver_task_events.where(F.col("task_result") == "Success"),
        ATTEMPT,
        [
            Spread(
                "task_duration_ms",
                {
                    "task_p50_ms": 0.50,
                    "task_p75_ms": 0.75,
                    "task_p95_ms": 0.95,
                    "task_p99_ms": 0.99,
                },
                low="task_min_ms",
                high="task_max_ms",
                mean="task_avg_ms",
            ),
            Spread("gc_time_ms", {"gc_p95_ms": 0.95}),
            Spread("peak_exec_memory_bytes", {"peak_mem_p95_bytes": 0.95}),
            Spread(
                "shuffle_read_bytes",
                {"task_shuffle_p50_bytes": 0.50},
                low="task_shuffle_min_bytes",
                high="task_shuffle_max_bytes",
            ),
        ],
        extra=[
            F.count("task_id").alias("task_count"),
            # Only successful tasks are left, so this is 0; kept as published.
            count_where(F.col("task_result") != "Success").alias("failed_tasks"),
            count_where(F.col("speculative")).alias("speculative_tasks"),
            count_where(F.col("disk_bytes_spilled") > 0).alias("tasks_with_disk_spill"),
            F.try_sum("executor_cpu_time_ns").alias("cpu_ns"),
            F.count("executor_cpu_time_ns").alias("cpu_tasks"),
            F.try_sum("executor_run_time_ms").alias("run_ms"),
            F.try_sum("gc_time_ms").alias("gc_ms"),
        ],
        exact=exact,
    )


def job_stage_map(silver_job_events: DataFrame) -> DataFrame:
    """(job, stage) pairs; a stage may belong to several jobs."""
    starts = silver_job_events.where(F.col("event_type") == S.JOB_START)
    return explode_id_list(starts, JOB, "stage_ids", "stage_id")


def executor_load(silver_task_events: DataFrame) -> DataFrame:
    """Successful tasks of each executor and host, summed."""
    return (
        silver_task_events.where(F.col("task_result") == "Success")
        .groupBy(*EXECUTOR, "host")
        .agg(
            F.count("task_id").alias("total_tasks"),
            F.try_sum("task_duration_ms").alias("total_task_ms"),
            F.avg("task_duration_ms").alias("avg_task_ms"),
            F.try_sum("gc_time_ms").alias("total_gc_ms"),
            F.avg("gc_overhead_pct").alias("avg_gc_pct"),
            F.avg("cpu_efficiency_pct").alias("avg_cpu_efficiency_pct"),
            F.try_sum("input_bytes").alias("input_bytes"),
            F.try_sum("shuffle_read_bytes").alias("shuffle_read_bytes"),
            F.try_sum("shuffle_write_bytes").alias("shuffle_write_bytes"),
            F.try_sum("memory_bytes_spilled").alias("total_memory_spilled"),
            F.try_sum("disk_bytes_spilled").alias("total_disk_spilled"),
            F.max("peak_exec_memory_bytes").alias("peak_memory_bytes"),
            count_where(F.col("speculative")).alias("speculative_tasks"),
        )
    )


# --- diagnostics -------------------------------------------------------------------


def application_summary(
    silver_application_events: DataFrame,
    silver_stage_events: DataFrame,
    silver_job_events: DataFrame,
) -> DataFrame:
    def application(event: str, ts: str, ms: str, *more: str) -> DataFrame:
        return silver_application_events.where(F.col("event_type") == event).select(
            *APP, *more, F.col("timestamp_ts").alias(ts), F.col("timestamp_ms").alias(ms)
        )

    stages = silver_stage_events.groupBy(*APP).agg(
        F.count("stage_id").alias("total_stages"),
        count_where(F.col("status") == "COMPLETED").alias("completed_stages"),
        count_where(F.col("status") == "FAILED").alias("failed_stages"),
        F.try_sum("num_tasks").alias("total_tasks"),
        F.try_sum("input_bytes").alias("input_bytes"),
        F.try_sum("shuffle_read_bytes").alias("shuffle_bytes"),
        F.try_sum("disk_bytes_spilled").alias("disk_spill"),
        F.try_sum("memory_bytes_spilled").alias("memory_spill"),
        F.try_sum("jvm_gc_time_ms").alias("total_gc_time_ms"),
        F.try_sum("executor_run_time_ms").alias("total_exec_run_ms"),
        count_where(F.col("disk_bytes_spilled") > 0).alias("stages_with_disk_spill"),
    )
    jobs = (
        silver_job_events.where(F.col("event_type") == S.JOB_END)
        .groupBy(*APP)
        .agg(
            F.count("job_id").alias("total_jobs"),
            count_where(F.col("job_result") == "JobSucceeded").alias("succeeded_jobs"),
            count_where(F.col("job_result") != "JobSucceeded").alias("failed_jobs"),
        )
    )
    duration = difference("end_ms", "start_ms")
    gc = F.round(guarded_percent("total_gc_time_ms", "total_exec_run_ms", 0.0), 2)
    return (
        application(S.APPLICATION_START, "start_ts", "start_ms", "app_name", "spark_user")
        .join(application(S.APPLICATION_END, "end_ts", "end_ms"), APP, "left")
        .join(stages, APP, "left")
        .join(jobs, APP, "left")
        .select(
            *APP,
            "app_name",
            "spark_user",
            "start_ts",
            "end_ts",
            duration.alias("duration_ms"),
            (duration / F.lit(MILLIS_PER_MINUTE)).alias("duration_min"),
            "total_jobs",
            "succeeded_jobs",
            "failed_jobs",
            F.round(guarded_percent("succeeded_jobs", "total_jobs"), 1).alias("job_success_rate"),
            "total_stages",
            "completed_stages",
            "failed_stages",
            "total_tasks",
            in_gib("input_bytes").alias("total_input_gb"),
            in_gib("shuffle_bytes").alias("total_shuffle_gb"),
            in_gib(F.try_add("disk_spill", "memory_spill")).alias("total_spill_gb"),
            "stages_with_disk_spill",
            "total_gc_time_ms",
            gc.alias("gc_overhead_pct"),
            "total_exec_run_ms",
        )
    )


def job_performance(silver_job_events: DataFrame) -> DataFrame:
    """Start and end of each job; no row order (see reports for sorted views)."""
    starts = silver_job_events.where(F.col("event_type") == S.JOB_START).select(
        *JOB,
        "stage_ids",
        F.col("submission_ts").alias("submit_ts"),
        F.col("submission_ms").alias("submit_ms"),
    )
    ends = silver_job_events.where(F.col("event_type") == S.JOB_END).select(
        *JOB,
        "job_result",
        F.col("completion_ts").alias("complete_ts"),
        F.col("completion_ms").alias("complete_ms"),
    )
    duration = difference("complete_ms", "submit_ms")
    result = F.col("job_result")
    status = F.when(result.isNull(), "RUNNING").otherwise(
        F.when(result == "JobSucceeded", "SUCCEEDED").otherwise("FAILED")
    )
    return starts.join(ends, JOB, "left").select(
        *JOB,
        status.alias("status"),
        "submit_ts",
        "complete_ts",
        duration.alias("duration_ms"),
        F.round(duration / F.lit(MILLIS_PER_MINUTE), 2).alias("duration_min"),
        "job_result",
        "stage_ids",
    )


# Column order of the stage table.
STAGE_PERFORMANCE_COLUMNS = """
    cluster_id app_id stage_id attempt_id stage_name status failure_reason
    num_tasks task_count failed_tasks submission_ts first_task_ts completion_ts
    duration_ms scheduling_delay_ms executor_run_time_ms gc_overhead_pct
    cpu_efficiency_pct jvm_gc_time_ms input_mb output_mb shuffle_read_mb
    shuffle_write_mb shuffle_fetch_wait_ms disk_spill_mb memory_spill_mb
    has_disk_spill has_memory_spill peak_exec_memory_bytes
    task_min_ms task_avg_ms task_p50_ms task_p75_ms task_p95_ms task_p99_ms task_max_ms
    task_skew_ratio time_skew_gap_ms
    task_shuffle_min_mb task_shuffle_p50_mb task_shuffle_max_mb
    shuffle_skew_ratio data_skew_gap_mb data_skew_gap_p50_mb
    gc_p95_ms peak_mem_p95_mb speculative_tasks tasks_with_disk_spill
    bottleneck_type severity recommendation
""".split()


def stage_performance(
    silver_stage_events: DataFrame,
    work_stage_task_profile: DataFrame,
    thresholds: Thresholds = Thresholds(),
    language: str = "ja",
    ignore_failures_like: str | None = None,
) -> DataFrame:
    """Stage attempts with task distribution, bottleneck class and advice.

    ``ignore_failures_like``: optional pattern of failure reasons (for example
    cancellations by adaptive execution) not to report as STAGE_FAILURE.
    """
    biggest, median = F.col("task_shuffle_max_bytes"), F.col("task_shuffle_p50_bytes")
    derived = {
        "task_skew_ratio": skew_ratio("task_max_ms", "task_p50_ms"),
        "time_skew_gap_ms": difference("task_max_ms", "task_p50_ms"),
        "task_shuffle_min_mb": in_mib("task_shuffle_min_bytes", 2),
        "task_shuffle_p50_mb": in_mib(median, 2),
        "task_shuffle_max_mb": in_mib(biggest, 2),
        "shuffle_skew_ratio": skew_ratio(biggest, median),
        "data_skew_gap_mb": in_mib(difference(biggest, "task_shuffle_min_bytes"), 2),
        "data_skew_gap_p50_mb": in_mib(difference(biggest, median), 2),
        "input_mb": in_mib("input_bytes", 1),
        "output_mb": in_mib("output_bytes", 1),
        "shuffle_read_mb": in_mib("shuffle_read_bytes", 1),
        "shuffle_write_mb": in_mib("shuffle_write_bytes", 1),
        "disk_spill_mb": in_mib("disk_bytes_spilled", 1),
        "memory_spill_mb": in_mib("memory_bytes_spilled", 1),
        "peak_mem_p95_mb": in_mib("peak_mem_p95_bytes", 1),
        "has_disk_spill": F.col("disk_bytes_spilled") > 0,
        "has_memory_spill": F.col("memory_bytes_spilled") > 0,
    }
    rules = bottleneck_rules(thresholds)
    if ignore_failures_like is not None:
        ignored = F.coalesce(F.col("failure_reason").rlike(ignore_failures_like), F.lit(False))
        rules[0] = (rules[0][0], rules[0][1] & ~ignored)
    joined = silver_stage_events.join(work_stage_task_profile, ATTEMPT, "left")
    return classify(
        joined.withColumns(derived), rules, recommendations=RECOMMENDATIONS[language]
    ).select(*STAGE_PERFORMANCE_COLUMNS)


def stage_task_extras(
    silver_stage_events: DataFrame, silver_task_events: DataFrame
) -> DataFrame:
    """Two facts the stage table does not show, per stage attempt.

    ``failed_task_attempts`` counts tasks that did not succeed;
    ``scheduling_delay_from_tasks_ms`` uses the first launch seen in the tasks,
    for logs whose stages do not state it.
    """
    tasks = silver_task_events.groupBy(*ATTEMPT).agg(
        count_where(F.col("task_result") != "Success").alias("failed_task_attempts"),
        F.min(F.unix_millis("launch_ts")).alias("first_launch_ms"),
    )
    delay = difference("first_launch_ms", F.unix_millis("submission_ts"))
    return silver_stage_events.join(tasks, ATTEMPT, "left").select(
        *ATTEMPT,
        F.coalesce("failed_task_attempts", F.lit(0)).alias("failed_task_attempts"),
        delay.alias("scheduling_delay_from_tasks_ms"),
    )


def executor_analysis(
    work_executor_load: DataFrame,
    silver_executor_events: DataFrame,
    silver_resource_profiles: DataFrame,
    write_norms: bool = False,
) -> DataFrame:
    """``write_norms``: see :func:`peer_load`; it starts a job."""
    lifecycle = lifecycle_pivot(
        silver_executor_events,
        EXECUTOR,
        "event_type",
        {
            "total_cores": (F.max, S.EXECUTOR_ADDED, "total_cores"),
            "add_ts": (F.min, S.EXECUTOR_ADDED, "timestamp_ts"),
            "remove_ts": (F.max, S.EXECUTOR_REMOVED, "timestamp_ts"),
            "removed_reason": (F.max, S.EXECUTOR_REMOVED, "removed_reason"),
            "resource_profile_id": (F.max, S.EXECUTOR_ADDED, "resource_profile_id"),
        },
    )
    profile = [*APP, "resource_profile_id"]
    return (
        peer_load(
            work_executor_load,
            APP,
            "total_task_ms",
            "app_avg_task_ms",
            write_norms=write_norms,
        )
        .join(lifecycle, EXECUTOR, "left")
        .join(silver_resource_profiles.drop("ingested_at"), profile, "left")
        .select(
            *EXECUTOR,
            "host",
            "total_cores",
            "add_ts",
            "remove_ts",
            "removed_reason",
            "resource_profile_id",
            "onheap_memory_mb",
            "offheap_memory_mb",
            "task_cpus",
            "total_tasks",
            "total_task_ms",
            "avg_task_ms",
            "total_gc_ms",
            "avg_gc_pct",
            "avg_cpu_efficiency_pct",
            in_gib("input_bytes").alias("input_gb"),
            in_gib("shuffle_read_bytes").alias("shuffle_read_gb"),
            in_gib("shuffle_write_bytes").alias("shuffle_write_gb"),
            "total_memory_spilled",
            "total_disk_spilled",
            in_mib("peak_memory_bytes", 1).alias("peak_memory_mb"),
            "speculative_tasks",
            "app_avg_task_ms",
            "load_vs_avg",
            "z_score",
            "is_straggler",
            "is_underutilized",
        )
    )


# Output columns in their order.
BOTTLENECK_COLUMNS = """
    cluster_id app_id job_id stage_id stage_name status severity bottleneck_type
    duration_ms num_tasks task_skew_ratio gc_overhead_pct disk_spill_mb memory_spill_mb
    shuffle_read_mb task_p95_ms task_p99_ms recommendation failure_reason
""".split()


def bottleneck_report(
    gold_stage_performance: DataFrame, work_job_stage_map: DataFrame
) -> DataFrame:
    """Stage attempts with a bottleneck, once per job that lists the stage."""
    return (
        gold_stage_performance.where(F.col("bottleneck_type") != "OK")
        .join(work_job_stage_map, STAGE, "left")
        .select(*BOTTLENECK_COLUMNS)
    )


def job_concurrency(
    gold_job_performance: DataFrame,
    work_stage_task_profile: DataFrame,
    work_job_stage_map: DataFrame,
) -> DataFrame:
    """Jobs open when a job was submitted, next to the job's CPU figures.

    Tasks are summed per stage attempt before they meet the jobs, so a stage
    listed by several jobs multiplies one row and not its tasks.
    """
    described = [
        *JOB,
        "status",
        "job_result",
        "submit_ts",
        "complete_ts",
        "duration_ms",
        "duration_min",
    ]
    jobs = gold_job_performance.where(F.col("submit_ts").isNotNull()).select(
        *described,
        F.unix_millis("submit_ts").alias("submit_ms"),
        F.unix_millis("complete_ts").alias("complete_ms"),
    )
    # A job logged twice is one row with the counts of both.
    concurrent = (
        interval_concurrency(jobs, APP, "job_id", "submit_ms", "complete_ms", "others")
        .groupBy(*described)
        .agg(F.try_sum("others").alias("concurrent_jobs_at_start"))
    )
    cpu = (
        work_stage_task_profile.join(work_job_stage_map, STAGE)
        .groupBy(*JOB)
        .agg(
            F.try_sum("task_count").alias("job_total_tasks"),
            F.try_sum("cpu_ns").alias("cpu_ns"),
            F.try_sum("cpu_tasks").alias("cpu_tasks"),
            F.try_sum("run_ms").alias("run_ms"),
            F.try_sum("gc_ms").alias("gc_ms"),
        )
    )
    cpu_ms = F.col("cpu_ns") / F.lit(1e6)
    mean_cpu_ns = F.when(F.col("cpu_tasks") > 0, F.col("cpu_ns") / F.col("cpu_tasks"))
    return concurrent.join(cpu, JOB, "left").select(
        *JOB,
        F.col("job_id").cast("string").alias("job_id_str"),
        "status",
        "job_result",
        "submit_ts",
        "complete_ts",
        "duration_ms",
        in_seconds("duration_ms", 1).alias("duration_sec"),
        "duration_min",
        "concurrent_jobs_at_start",
        "job_total_tasks",
        F.round(F.col("cpu_ns") / F.lit(1e9), 2).alias("total_cpu_time_sec"),
        in_seconds("run_ms", 1).alias("total_exec_run_time_sec"),
        F.round(cpu_ms / F.greatest("run_ms", F.lit(1)) * 100, 1).alias(
            "job_cpu_efficiency_pct"
        ),
        F.round(mean_cpu_ns / F.lit(1e6), 1).alias("avg_task_cpu_time_ms"),
        in_seconds("gc_ms", 1).alias("total_gc_time_sec"),
    )


def sql_photon_analysis(
    silver_sql_executions: DataFrame,
    prefix: str = P.ACCELERATED_PREFIX,
    with_other_joins: bool = False,
) -> DataFrame:
    """Accelerated share and join mix of each SQL execution."""
    operators, total, fast = (
        F.col("operators"),
        F.col("total_operators"),
        F.col("photon_operators"),
    )
    counted = (
        silver_sql_executions.withColumn("operators", P.plan_operators("physical_plan"))
        .withColumns(
            {
                "total_operators": F.array_size(operators),
                "photon_operators": P.count_accelerated(operators, prefix),
                "bhj_count": P.count_named(operators, P.BROADCAST_HASH_JOIN),
                "photon_bhj_count": P.count_named(
                    operators, P.ACCELERATED_BROADCAST_HASH_JOIN
                ),
                "smj_count": P.count_named(operators, P.SORT_MERGE_JOIN),
            }
        )
    )
    joins = F.col("bhj_count") + F.col("photon_bhj_count") + F.col("smj_count")
    duration = difference("end_time_ms", "start_time_ms")
    others = (
        [P.count_named(operators, *P.OTHER_JOINS).alias("other_join_count")]
        if with_other_joins
        else []
    )
    return counted.select(
        *APP,
        "execution_id",
        P.squeeze_spaces("description").alias("description_short"),
        millis_to_ts("start_time_ms").alias("start_ts"),
        in_seconds(duration, 2).alias("duration_sec"),
        "total_operators",
        "photon_operators",
        F.round(guarded_percent(fast, total), 1).alias("photon_pct"),
        (fast > 0).cast("string").alias("is_photon"),
        "bhj_count",
        "photon_bhj_count",
        "smj_count",
        joins.alias("total_join_count"),
        P.plain_operator_list(operators, prefix).alias("non_photon_op_list"),
        *others,
    )
