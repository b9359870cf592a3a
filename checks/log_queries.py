"""Every table and report over logs made from the TPC-H-like tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from checks.fixture_lake import computed, written
from emberlog.plans import gold
from emberlog.plans import reports as R
from emberlog.plans.lake import BRONZE, TABLES
from emberlog.sources.quality import TABLE_RULES, violation_counts

Query = Callable[[SparkSession, str], DataFrame]

# Averages and sums of fractions depend on the order of addition in their last bits.
UNORDERED = {
    "avg_gc_pct",
    "avg_cpu_efficiency_pct",
    "avg_photon_pct",
    "avg_photon_pct_top5",
    "avg_photon_pct_top10",
    "job_success_rate",
    "total_shuffle_gb",
    "total_spill_gb",
    "total_cpu_time_sec",
    "total_gc_time_sec",
}


def comparable(df: DataFrame) -> DataFrame:
    """Times as epoch milliseconds, without the wall-clock and file columns."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if field.name in ("ingested_at", "source_file"):
            continue
        if isinstance(field.dataType, TimestampType):
            column = F.unix_millis(column)
        elif field.name in UNORDERED:
            column = F.round(column, 6)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _table(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(computed(spark, sf_dir, name))


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        written(spark, sf_dir, BRONZE)
        .groupBy("cluster_id", "app_id", "event_type")
        .agg(F.count(F.lit(1)).alias("events"))
    )


def _report(
    function: Callable[[DataFrame], DataFrame], table: str, spark: SparkSession, sf_dir: str
) -> DataFrame:
    return comparable(function(written(spark, sf_dir, table)))


def _over_dataset(
    function: Callable[[DataFrame], DataFrame], dataset: str, spark: SparkSession, sf_dir: str
) -> DataFrame:
    table, make = R.DATASETS[dataset]
    return comparable(function(make(written(spark, sf_dir, table))))


APPS, JOBS, STAGES = (
    "gold_application_summary",
    "gold_job_performance",
    "gold_stage_performance",
)
CONCURRENCY, BOTTLENECKS, SQLS = (
    "gold_job_concurrency",
    "gold_bottleneck_report",
    "gold_sql_photon_analysis",
)

REPORTS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "dataset_application": (R.application_dataset, APPS),
    "dataset_job": (R.job_dataset, JOBS),
    "dataset_stage": (R.stage_dataset, STAGES),
    "dataset_executor": (R.executor_dataset, "gold_executor_analysis"),
    "dataset_concurrency": (R.concurrency_dataset, CONCURRENCY),
    "dataset_bottleneck": (R.bottleneck_dataset, BOTTLENECKS),
    "dataset_sql": (R.sql_dataset, SQLS),
    "jobs_by_submit_time": (R.jobs_by_submit_time, JOBS),
    "bottlenecks_by_severity": (R.bottlenecks_by_severity, BOTTLENECKS),
    "slowest_5_percent": (R.slowest_5_percent, SQLS),
    "slowest_10_percent": (R.slowest_10_percent, SQLS),
    "application_figures": (R.application_figures, APPS),
    "bottleneck_counts": (R.bottleneck_counts, BOTTLENECKS),
    "slowest_jobs": (R.slowest_jobs, JOBS),
    "worst_stages": (R.worst_stages, STAGES),
    "least_efficient_jobs": (R.least_efficient_jobs, CONCURRENCY),
    "least_accelerated": (R.least_accelerated, SQLS),
    "counters_application": (R.application_counters, APPS),
    "counters_sql": (R.sql_counters, SQLS),
    "counters_concurrency": (R.concurrency_counters, CONCURRENCY),
    "counters_stage": (R.stage_counters, STAGES),
    "acceptance_bottlenecks": (R.acceptance_bottlenecks, BOTTLENECKS),
    "acceptance_skew": (R.acceptance_skew, STAGES),
    "acceptance_sql": (R.acceptance_sql, SQLS),
    "acceptance_concurrency": (R.acceptance_concurrency, CONCURRENCY),
}


def english_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = gold.stage_performance(
        written(spark, sf_dir, "silver_stage_events"),
        written(spark, sf_dir, "work_stage_task_profile"),
        language="en",
    )
    return stages.select(
        "app_id", "stage_id", "attempt_id", "bottleneck_type", "severity", "recommendation"
    )


def ignored_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = gold.stage_performance(
        written(spark, sf_dir, "silver_stage_events"),
        written(spark, sf_dir, "work_stage_task_profile"),
        ignore_failures_like="^abort",
    )
    return stages.select("app_id", "stage_id", "attempt_id", "status", "bottleneck_type")


def other_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    analysed = gold.sql_photon_analysis(
        written(spark, sf_dir, "silver_sql_executions"), with_other_joins=True
    )
    return analysed.select("app_id", "execution_id", "total_join_count", "other_join_count")


def task_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.stage_task_extras(
        written(spark, sf_dir, "silver_stage_events"), written(spark, sf_dir, "silver_task_events")
    )


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break each rule, before any is dropped."""
    bronze_table = written(spark, sf_dir, BRONZE)
    counts = []
    for name, rules in TABLE_RULES.items():
        row = TABLES[name].build(bronze_table).agg(
            F.count(F.lit(1)).alias("rows"), *violation_counts(rules)
        )
        counts += [
            row.select(
                F.lit(name).alias("table_name"),
                F.lit(rule.name).alias("rule"),
                "rows",
                F.col(rule.name).alias("broken"),
            )
            for rule in rules
        ]
    return reduce(DataFrame.unionByName, counts)


# Sorted reports of a few rows, whose order is checked by the place of each row.
RANKED = ("slowest_jobs", "worst_stages", "least_efficient_jobs", "least_accelerated")


def _ranked(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report that ends in a limit comes in one ordered partition."""
    function, table = REPORTS[name]
    report = function(written(spark, sf_dir, table))
    return comparable(report.select("*", (F.monotonically_increasing_id() + 1).alias("place")))


QUERIES: dict[str, Query] = {
    BRONZE: bronze,
    "option_english_texts": english_texts,
    "option_ignored_failures": ignored_failures,
    "option_other_joins": other_joins,
    "stage_task_extras": task_extras,
    "rule_counts": rule_counts,
}
QUERIES |= {name: partial(_table, name) for name in TABLES if name != BRONZE}
QUERIES |= {f"report_{n}": partial(_report, f, t) for n, (f, t) in REPORTS.items()}
QUERIES |= {f"ranked_{n}": partial(_ranked, n) for n in RANKED}
QUERIES |= {
    f"report_chart_{n}": partial(_over_dataset, partial(R.chart, n), c[0])
    for n, c in R.CHARTS.items()
}
QUERIES |= {
    f"report_scatter_{n}": partial(_over_dataset, partial(R.scatter, n), s[0])
    for n, s in R.SCATTERS.items()
}
QUERIES |= {
    f"report_detail_{n}": partial(_over_dataset, partial(R.detail, n), d[0])
    for n, d in R.DETAILS.items()
}
