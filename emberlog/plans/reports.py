"""Report queries over the diagnostic tables. Each takes and returns a DataFrame.

Sorted reports end in unique columns so that equal values keep one order.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.metrics import in_seconds
from emberlog.operators.rollup import chart_series, counters
from emberlog.operators.rules import severity_order
from emberlog.operators.topshare import top_tile_mean
from emberlog.plans.gold import BOTTLENECK_COLUMNS


def _text(name: str) -> Column:
    return F.col(name).cast("string")


# --- datasets ----------------------------------------------------------------------

# Columns of the report datasets.
APPLICATION_COLUMNS = """
    cluster_id app_id app_name spark_user start_ts end_ts duration_ms duration_min
    total_jobs succeeded_jobs failed_jobs job_success_rate total_stages completed_stages
    failed_stages total_tasks total_input_gb total_shuffle_gb total_spill_gb
    stages_with_disk_spill total_gc_time_ms gc_overhead_pct total_exec_run_ms
""".split()
CONCURRENCY_COLUMNS = """
    cluster_id app_id job_id job_id_str status job_result submit_ts complete_ts
    duration_ms duration_sec duration_min concurrent_jobs_at_start job_total_tasks
    total_cpu_time_sec total_exec_run_time_sec job_cpu_efficiency_pct
    avg_task_cpu_time_ms total_gc_time_sec
""".split()
SQL_COLUMNS = """
    cluster_id app_id execution_id description_short start_ts duration_sec
    total_operators photon_operators photon_pct is_photon bhj_count photon_bhj_count
    smj_count total_join_count non_photon_op_list
""".split()


def application_dataset(applications: DataFrame) -> DataFrame:
    return applications.select(*APPLICATION_COLUMNS)


def job_dataset(jobs: DataFrame) -> DataFrame:
    return jobs.select(
        "cluster_id",
        "app_id",
        _text("job_id").alias("job_id_str"),
        "status",
        "submit_ts",
        "complete_ts",
        "duration_ms",
        in_seconds("duration_ms").alias("duration_sec"),
        "duration_min",
        "job_result",
        "stage_ids",
    )


def jobs_by_submit_time(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy("submit_ts", "cluster_id", "app_id", "job_id")


def stage_dataset(stages: DataFrame) -> DataFrame:
    # Output columns in their order.
    return stages.select(
        "cluster_id",
        "app_id",
        "stage_id",
        _text("stage_id").alias("stage_id_str"),
        "attempt_id",
        "stage_name",
        "status",
        "failure_reason",
        "num_tasks",
        "task_count",
        "failed_tasks",
        "submission_ts",
        "first_task_ts",
        "completion_ts",
        "duration_ms",
        "scheduling_delay_ms",
        in_seconds("scheduling_delay_ms", 2).alias("scheduling_delay_sec"),
        "gc_overhead_pct",
        "cpu_efficiency_pct",
        "shuffle_read_mb",
        "shuffle_write_mb",
        "shuffle_fetch_wait_ms",
        in_seconds("shuffle_fetch_wait_ms", 2).alias("shuffle_fetch_wait_sec"),
        "disk_spill_mb",
        "memory_spill_mb",
        "task_min_ms",
        "task_avg_ms",
        "task_p50_ms",
        "task_p75_ms",
        "task_p95_ms",
        "task_p99_ms",
        "task_max_ms",
        "task_skew_ratio",
        "time_skew_gap_ms",
        in_seconds("task_p50_ms", 3).alias("task_p50_sec"),
        in_seconds("task_max_ms", 3).alias("task_max_sec"),
        in_seconds("time_skew_gap_ms", 3).alias("time_skew_gap_sec"),
        "task_shuffle_min_mb",
        "task_shuffle_p50_mb",
        "task_shuffle_max_mb",
        "shuffle_skew_ratio",
        "data_skew_gap_mb",
        "bottleneck_type",
        "severity",
        "recommendation",
    )


def executor_dataset(executors: DataFrame) -> DataFrame:
    # Output columns in their order.
    return executors.select(
        "cluster_id",
        "app_id",
        "executor_id",
        "host",
        "total_cores",
        "resource_profile_id",
        "onheap_memory_mb",
        "offheap_memory_mb",
        "task_cpus",
        "add_ts",
        "remove_ts",
        "removed_reason",
        "total_tasks",
        "total_task_ms",
        "avg_task_ms",
        in_seconds("avg_task_ms").alias("avg_task_sec"),
        "total_gc_ms",
        "avg_gc_pct",
        "avg_cpu_efficiency_pct",
        "input_gb",
        "shuffle_read_gb",
        "shuffle_write_gb",
        "total_memory_spilled",
        "total_disk_spilled",
        "peak_memory_mb",
        "app_avg_task_ms",
        "load_vs_avg",
        "z_score",
        _text("is_straggler").alias("is_straggler_str"),
        _text("is_underutilized").alias("is_underutilized_str"),
    )


def concurrency_dataset(concurrency: DataFrame) -> DataFrame:
    return concurrency.select(*CONCURRENCY_COLUMNS).orderBy(
        "submit_ts", "cluster_id", "app_id", "job_id"
    )


def bottleneck_dataset(bottlenecks: DataFrame) -> DataFrame:
    return bottlenecks.select(*BOTTLENECK_COLUMNS)


def bottlenecks_by_severity(bottlenecks: DataFrame) -> DataFrame:
    """Worst first: severity, then duration. The sort key is not an output."""
    return bottlenecks.orderBy(
        severity_order(), F.desc("duration_ms"), "cluster_id", "app_id", "stage_id", "job_id"
    ).select(*BOTTLENECK_COLUMNS)


def sql_dataset(executions: DataFrame) -> DataFrame:
    return executions.select(*SQL_COLUMNS).orderBy(
        F.desc_nulls_last("duration_sec"), "cluster_id", "app_id", "execution_id"
    )


def slowest_share(executions: DataFrame, tiles: int, output: str) -> DataFrame:
    """Mean accelerated share of the slowest 1/tiles of finished executions."""
    finished = executions.where(F.col("duration_sec").isNotNull()).select(
        "cluster_id", "app_id", "execution_id", "duration_sec", "photon_pct"
    )
    order = [
        F.desc("duration_sec"),
        F.asc("cluster_id"),
        F.asc("app_id"),
        F.asc("execution_id"),
    ]
    return top_tile_mean(finished, "photon_pct", order, tiles, output, "duration_sec")


def slowest_5_percent(executions: DataFrame) -> DataFrame:
    return slowest_share(executions, 20, "avg_photon_pct_top5")


def slowest_10_percent(executions: DataFrame) -> DataFrame:
    return slowest_share(executions, 10, "avg_photon_pct_top10")


# --- figures for a written summary ----------------------------------------------------


def application_figures(applications: DataFrame) -> DataFrame:
    """Rounded figures of one application: the earliest."""
    return (
        applications.orderBy("start_ts", "cluster_id", "app_id")
        .limit(1)
        .select(
            "total_jobs",
            "succeeded_jobs",
            "failed_jobs",
            F.round("job_success_rate", 1).alias("job_success_rate"),
            F.round("total_shuffle_gb", 2).alias("total_shuffle_gb"),
            F.round("total_spill_gb", 2).alias("total_spill_gb"),
            F.round("gc_overhead_pct", 1).alias("gc_overhead_pct"),
            F.round("duration_min", 1).alias("duration_min"),
        )
    )


def bottleneck_counts(bottlenecks: DataFrame) -> DataFrame:
    return (
        bottlenecks.groupBy("bottleneck_type", "severity")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(severity_order(), F.desc("cnt"), "bottleneck_type")
    )


def slowest_jobs(jobs: DataFrame, n: int = 5) -> DataFrame:
    return (
        jobs.orderBy(F.desc_nulls_last("duration_ms"), "cluster_id", "app_id", "job_id")
        .limit(n)
        .select(
            "job_id",
            in_seconds("duration_ms", 1).alias("duration_sec"),
            "job_result",
            "stage_ids",
        )
    )


def worst_stages(stages: DataFrame, n: int = 5) -> DataFrame:
    return (
        stages.where(F.col("bottleneck_type") != "OK")
        .orderBy(
            F.desc_nulls_last("duration_ms"), "cluster_id", "app_id", "stage_id", "attempt_id"
        )
        .limit(n)
        .select(
            "stage_id",
            "stage_name",
            "bottleneck_type",
            "severity",
            in_seconds("duration_ms", 1).alias("duration_sec"),
            "num_tasks",
            F.round("task_skew_ratio", 1).alias("task_skew_ratio"),
            F.round("shuffle_read_mb", 0).alias("shuffle_read_mb"),
            F.round("gc_overhead_pct", 1).alias("gc_overhead_pct"),
            "recommendation",
        )
    )


def least_efficient_jobs(concurrency: DataFrame, n: int = 5) -> DataFrame:
    return (
        concurrency.orderBy(
            F.asc_nulls_last("job_cpu_efficiency_pct"), "cluster_id", "app_id", "job_id"
        )
        .limit(n)
        .select(
            "job_id",
            F.round("duration_sec", 1).alias("duration_sec"),
            "concurrent_jobs_at_start",
            F.round("job_cpu_efficiency_pct", 1).alias("cpu_efficiency_pct"),
            F.round("total_gc_time_sec", 1).alias("gc_time_sec"),
        )
    )


def least_accelerated(executions: DataFrame, n: int = 5) -> DataFrame:
    """Unknown shares come first, as an ascending sort puts NULLs."""
    return (
        executions.where(F.col("duration_sec").isNotNull())
        .orderBy(
            F.asc_nulls_first("photon_pct"),
            F.desc_nulls_last("duration_sec"),
            "cluster_id",
            "app_id",
            "execution_id",
        )
        .limit(n)
        .select(
            "description_short",
            F.round("duration_sec", 1).alias("duration_sec"),
            F.round("photon_pct", 1).alias("photon_pct"),
            "non_photon_op_list",
        )
    )


def first_rows(df: DataFrame, n: int = 10) -> list[dict]:
    """At most ``n`` rows on the driver as plain values, ready for JSON."""
    return [
        {k: float(v) if isinstance(v, Decimal) else v for k, v in row.asDict().items()}
        for row in df.limit(n).collect()
    ]


# --- counters, chart series, scatter and detail tables --------------------------------

# Counter -> (aggregate, column).
APPLICATION_COUNTERS = {
    "total_tasks": ("SUM", "total_tasks"),
    "total_stages": ("SUM", "total_stages"),
    "total_jobs": ("SUM", "total_jobs"),
    "total_shuffle_gb": ("SUM", "total_shuffle_gb"),
    "total_spill_gb": ("SUM", "total_spill_gb"),
    "job_success_rate": ("AVG", "job_success_rate"),
}
SQL_COUNTERS = {
    "avg_photon_pct": ("AVG", "photon_pct"),
    "photon_operators": ("SUM", "photon_operators"),
    "total_operators": ("SUM", "total_operators"),
    "smj_count": ("SUM", "smj_count"),
    "bhj_count": ("SUM", "bhj_count"),
    "photon_bhj_count": ("SUM", "photon_bhj_count"),
}
CONCURRENCY_COUNTERS = {
    "max_concurrent_jobs": ("MAX", "concurrent_jobs_at_start"),
    "avg_concurrent_jobs": ("AVG", "concurrent_jobs_at_start"),
    "avg_cpu_efficiency_pct": ("AVG", "job_cpu_efficiency_pct"),
    "total_cpu_time_sec": ("SUM", "total_cpu_time_sec"),
    "total_gc_time_sec": ("SUM", "total_gc_time_sec"),
}
STAGE_COUNTERS = {"max_scheduling_delay_sec": ("MAX", "scheduling_delay_sec")}


def application_counters(applications: DataFrame) -> DataFrame:
    return counters(applications, APPLICATION_COUNTERS)


def sql_counters(executions: DataFrame) -> DataFrame:
    return counters(executions, SQL_COUNTERS)


def concurrency_counters(concurrency: DataFrame) -> DataFrame:
    return counters(concurrency, CONCURRENCY_COUNTERS)


def stage_counters(stages: DataFrame) -> DataFrame:
    return counters(stage_dataset(stages), STAGE_COUNTERS)


# Series -> (dataset, x, color, y, aggregate, largest value first).
CHARTS = {
    "job_duration": ("job", "job_id_str", "status", "duration_sec", "MAX", False),
    "bottlenecks": ("bottleneck", "bottleneck_type", "severity", "stage_id", "COUNT", True),
    "stage_duration": ("stage", "stage_id_str", "bottleneck_type", "duration_ms", "MAX", False),
    "executor_mean_task": (
        "executor", "executor_id", "is_straggler_str", "avg_task_sec", "MAX", False,
    ),
    "time_skew_gap": (
        "stage", "stage_id_str", "bottleneck_type", "time_skew_gap_sec", "MAX", True,
    ),
    "data_skew_gap": (
        "stage", "stage_id_str", "bottleneck_type", "data_skew_gap_mb", "MAX", True,
    ),
    "shuffle_read": (
        "stage", "stage_id_str", "bottleneck_type", "shuffle_read_mb", "MAX", True,
    ),
    "shuffle_write": (
        "stage", "stage_id_str", "bottleneck_type", "shuffle_write_mb", "MAX", True,
    ),
    "fetch_wait": (
        "stage", "stage_id_str", "bottleneck_type", "shuffle_fetch_wait_sec", "MAX", True,
    ),
    "executor_shuffle": (
        "executor", "executor_id", "is_straggler_str", "shuffle_read_gb", "MAX", False,
    ),
    "cpu_efficiency": (
        "concurrency", "job_id_str", "status", "job_cpu_efficiency_pct", "MAX", True,
    ),
    "concurrency": (
        "concurrency", "job_id_str", "status", "concurrent_jobs_at_start", "MAX", True,
    ),
    "scheduling_delay": (
        "stage", "stage_id_str", "bottleneck_type", "scheduling_delay_sec", "MAX", True,
    ),
}
# Scatter -> (dataset, x, y, color).
SCATTERS = {
    "skew_vs_duration": ("stage", "task_skew_ratio", "duration_ms", "bottleneck_type"),
    "data_vs_time_skew": ("stage", "shuffle_skew_ratio", "task_skew_ratio", "bottleneck_type"),
    "concurrency_vs_cpu": (
        "concurrency", "concurrent_jobs_at_start", "job_cpu_efficiency_pct", "status",
    ),
    "concurrency_vs_duration": (
        "concurrency", "concurrent_jobs_at_start", "duration_sec", "status",
    ),
}
# Detail table -> (dataset, columns).
DETAILS = {
    "bottleneck": (
        "bottleneck",
        "job_id stage_id recommendation num_tasks status bottleneck_type failure_reason",
    ),
    "stage": (
        "stage",
        "stage_id_str recommendation disk_spill_mb duration_ms failed_tasks memory_spill_mb"
        " num_tasks shuffle_read_mb shuffle_write_mb stage_id scheduling_delay_ms task_count"
        " status attempt_id cpu_efficiency_pct gc_overhead_pct task_avg_ms task_max_ms"
        " task_min_ms task_p50_ms task_p75_ms task_p95_ms task_p99_ms task_skew_ratio app_id"
        " bottleneck_type failure_reason severity stage_name completion_ts first_task_ts"
        " submission_ts",
    ),
    "executor": (
        "executor",
        "executor_id host total_cores task_cpus resource_profile_id onheap_memory_mb"
        " offheap_memory_mb is_straggler_str is_underutilized_str removed_reason avg_task_sec"
        " total_tasks total_task_ms avg_gc_pct avg_cpu_efficiency_pct load_vs_avg z_score"
        " input_gb shuffle_read_gb shuffle_write_gb peak_memory_mb total_memory_spilled"
        " total_disk_spilled add_ts remove_ts",
    ),
    "skew": (
        "stage",
        "stage_id_str stage_name bottleneck_type num_tasks task_p50_sec task_max_sec"
        " time_skew_gap_sec task_skew_ratio task_shuffle_min_mb task_shuffle_p50_mb"
        " task_shuffle_max_mb data_skew_gap_mb shuffle_skew_ratio",
    ),
    "sql": (
        "sql",
        "execution_id description_short start_ts duration_sec photon_pct is_photon"
        " total_join_count photon_bhj_count bhj_count smj_count non_photon_op_list",
    ),
    "shuffle": (
        "stage",
        "stage_id_str stage_name bottleneck_type num_tasks shuffle_read_mb shuffle_write_mb"
        " shuffle_fetch_wait_sec task_shuffle_min_mb task_shuffle_p50_mb task_shuffle_max_mb"
        " shuffle_skew_ratio data_skew_gap_mb duration_ms severity recommendation",
    ),
    "concurrency": (
        "concurrency",
        "job_id_str status job_result submit_ts complete_ts duration_sec"
        " concurrent_jobs_at_start job_total_tasks total_cpu_time_sec total_exec_run_time_sec"
        " job_cpu_efficiency_pct avg_task_cpu_time_ms total_gc_time_sec",
    ),
}

# Dataset name -> (table it comes from, function).
DATASETS = {
    "application": ("gold_application_summary", application_dataset),
    "job": ("gold_job_performance", job_dataset),
    "stage": ("gold_stage_performance", stage_dataset),
    "executor": ("gold_executor_analysis", executor_dataset),
    "concurrency": ("gold_job_concurrency", lambda df: df.select(*CONCURRENCY_COLUMNS)),
    "bottleneck": ("gold_bottleneck_report", bottleneck_dataset),
    "sql": ("gold_sql_photon_analysis", lambda df: df.select(*SQL_COLUMNS)),
}


def chart(name: str, dataset: DataFrame) -> DataFrame:
    """Series of a chart over its dataset; sorted where the chart is."""
    _, x, color, y, how, largest_first = CHARTS[name]
    series = chart_series(dataset, x, color, y, how)
    if not largest_first:
        return series
    return series.orderBy(F.desc_nulls_last("value"), x, color)


def scatter(name: str, dataset: DataFrame) -> DataFrame:
    _, x, y, color = SCATTERS[name]
    return dataset.select(x, y, color)


def detail(name: str, dataset: DataFrame) -> DataFrame:
    return dataset.select(*DETAILS[name][1].split())


# --- acceptance queries ----------------------------------------------------------------


def acceptance_bottlenecks(bottlenecks: DataFrame) -> DataFrame:
    return bottlenecks.select(
        "bottleneck_type", "severity", "stage_name", "recommendation"
    ).orderBy("severity", "stage_name")


def acceptance_skew(stages: DataFrame) -> DataFrame:
    return stages.select(
        "stage_id",
        "stage_name",
        "task_skew_ratio",
        "task_p50_ms",
        "task_max_ms",
        "time_skew_gap_ms",
    ).orderBy(F.desc_nulls_last("task_skew_ratio"), "stage_id")


def acceptance_sql(executions: DataFrame) -> DataFrame:
    return executions.select(
        "execution_id", "description_short", "duration_sec", "photon_pct", "non_photon_op_list"
    ).orderBy(F.desc("duration_sec"), "execution_id").drop("execution_id")


def acceptance_concurrency(concurrency: DataFrame) -> DataFrame:
    return concurrency.select(
        "job_id", "concurrent_jobs_at_start", "job_cpu_efficiency_pct", "duration_sec"
    ).orderBy(F.desc("concurrent_jobs_at_start"), "job_id")
