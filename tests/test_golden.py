"""The golden scenario, from a log file to every table, with hand-derived answers."""

import pytest
from pyspark.sql import functions as F

from emberlog.plans import reports as R
from emberlog.plans.lake import TABLES, Lake, run, run_configured, table_sizes
from tests.logs import APP, CLUSTER, golden_events, write_log


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("golden")
    write_log(root / "logs", golden_events())
    counts = run(spark, f"{root}/logs/", CLUSTER, str(root / "lake"))
    assert counts["silver_task_events"] == {"rows": 250, "valid_task_id": 0, "has_metrics": 0}
    return Lake(spark, str(root / "lake"))


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_every_event_is_kept(lake):
    assert lake.read("bronze_raw_events").count() == 269
    assert {r["table"] for r in table_sizes(lake).collect()} == set(TABLES)


def test_stage_performance(lake):
    got = rows(
        lake.read("gold_stage_performance").orderBy("stage_id"),
        "stage_id", "duration_ms", F.round("gc_overhead_pct", 9), "task_p50_ms", "task_max_ms",
        "task_skew_ratio", "time_skew_gap_ms", "shuffle_read_mb", "task_shuffle_p50_mb",
        "disk_spill_mb", "memory_spill_mb", "bottleneck_type", "severity",
    )
    assert got == [
        (0, 2000, 5.0, 1000, 1000, 1.0, 0, 100.0, 5.0, 0.0, 0.0, "OK", "NONE"),
        (1, 51000, 5.0, 1000, 50000, 50.0, 49000, 100.0, 5.0, 0.0, 0.0, "DATA_SKEW", "MEDIUM"),
        (2, 5500, 5.0, 3000, 3000, 1.0, 0, 100.0, 5.0, 10240.0, 2048.0, "DISK_SPILL", "HIGH"),
        (3, 3500, 28.0, 2000, 2000, 1.0, 0, 100.0, 5.0, 0.0, 0.0, "HIGH_GC", "MEDIUM"),
        (4, 6000, 5.0, 4000, 4000, 1.0, 0, 15360.0, 300.0, 0.0, 0.0, "HEAVY_SHUFFLE", "LOW"),
        (5, 5000, 5.0, None, None, None, None, 100.0, None, 0.0, 0.0, "STAGE_FAILURE", "HIGH"),
    ]
    shared = rows(
        lake.read("gold_stage_performance").orderBy("stage_id"),
        "num_tasks", "scheduling_delay_ms", "cpu_efficiency_pct", "tasks_with_disk_spill",
        "failed_tasks", "task_count",
    )
    assert [r[:3] for r in shared] == [(50, 200, 90.0)] * 6
    assert [r[3] for r in shared] == [0, 0, 50, 0, 0, None]
    assert [r[4] for r in shared] == [0, 0, 0, 0, 0, None]
    assert [r[5] for r in shared] == [50, 50, 50, 50, 50, None]


def test_bottlenecks_in_order(lake):
    report = R.bottlenecks_by_severity(lake.read("gold_bottleneck_report"))
    assert rows(report, "stage_id", "job_id") == [(2, 1), (5, 2), (1, 0), (3, 1), (4, 2)]


def test_jobs(lake):
    assert rows(
        R.jobs_by_submit_time(lake.read("gold_job_performance")),
        "job_id", "status", "duration_ms", "duration_min", "stage_ids",
    ) == [
        (0, "SUCCEEDED", 119000, 1.98, "[0,1]"),
        (1, "SUCCEEDED", 279500, 4.66, "[2,3]"),
        (2, "FAILED", 214500, 3.58, "[4,5]"),
    ]
    assert rows(
        lake.read("gold_job_concurrency").orderBy("job_id"),
        "job_id_str", "concurrent_jobs_at_start", "job_total_tasks", "total_cpu_time_sec",
        "total_exec_run_time_sec", "job_cpu_efficiency_pct", "avg_task_cpu_time_ms",
        "total_gc_time_sec",
    ) == [
        ("0", 0, 100, 120.69, 134.1, 90.0, 1206.9, 6.0),
        ("1", 0, 100, 202.5, 225.0, 90.0, 2025.0, 35.5),
        ("2", 0, 50, 162.0, 180.0, 90.0, 3240.0, 10.0),
    ]


def test_application(lake):
    assert rows(
        lake.read("gold_application_summary"),
        "app_id", "app_name", "spark_user", "duration_ms", "total_jobs", "succeeded_jobs",
        "failed_jobs", "job_success_rate", "total_stages", "completed_stages", "failed_stages",
        "total_tasks", "total_input_gb", "total_shuffle_gb", "total_spill_gb",
        "stages_with_disk_spill", "total_gc_time_ms", "gc_overhead_pct", "total_exec_run_ms",
    ) == [
        (
            APP, "TestSparkApp", "tester", 620500, 3, 2, 1, 66.7, 6, 5, 1, 300, 6.0, 15.488,
            12.0, 1, 50750, 9.14, 555000,
        )
    ]


def test_executors(lake):
    assert rows(
        lake.read("gold_executor_analysis").orderBy("executor_id"),
        "executor_id", "total_tasks", "total_task_ms", "app_avg_task_ms", "load_vs_avg",
        "z_score", "is_straggler", "is_underutilized", "onheap_memory_mb", "total_cores",
        "removed_reason",
    ) == [
        ("1", 150, 349000, 299500.0, 1.17, 0.71, False, False, None, 4, "Job finished"),
        ("2", 100, 250000, 299500.0, 0.83, -0.71, False, False, None, 4, "Job finished"),
    ]


def test_settings(lake):
    kept = {r["config_key"] for r in lake.read("silver_spark_config").collect()}
    assert len(kept) == 6 and "spark.app.name" not in kept


def test_read_by_name_from_sql(spark, lake):
    lake.register_views("golden_")
    top = spark.sql(
        "SELECT stage_id FROM golden_gold_stage_performance"
        " ORDER BY task_skew_ratio DESC NULLS LAST LIMIT 1"
    )
    assert top.collect()[0][0] == 1


def test_acceptance_reports(lake):
    kinds = R.acceptance_bottlenecks(lake.read("gold_bottleneck_report")).collect()
    assert {r["bottleneck_type"] for r in kinds} == {
        "DATA_SKEW", "DISK_SPILL", "HIGH_GC", "HEAVY_SHUFFLE", "STAGE_FAILURE",
    }
    assert R.acceptance_skew(lake.read("gold_stage_performance")).first()["stage_id"] == 1


def test_summary_figures(lake):
    counts = R.bottleneck_counts(lake.read("gold_bottleneck_report")).collect()
    assert [r["severity"] for r in counts] == ["HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW"]
    assert [r["job_id"] for r in R.slowest_jobs(lake.read("gold_job_performance")).collect()] == [
        1, 2, 0,
    ]
    worst = R.worst_stages(lake.read("gold_stage_performance")).collect()
    assert [r["stage_id"] for r in worst] == [1, 4, 2, 5, 3]


def test_columns_of_the_wide_tables(lake):
    assert len(lake.read("silver_stage_events").columns) == 40
    assert len(lake.read("silver_task_events").columns) == 40
    assert len(lake.read("gold_stage_performance").columns) == 51


def test_read_by_qualified_name(spark, lake):
    lake.register_tables("golden_lake")
    lake.register_tables("golden_lake")
    got = spark.sql(
        "SELECT count(*) FROM golden_lake.bronze_raw_events"
        " WHERE event_type = 'SparkListenerTaskEnd'"
    )
    assert got.first()[0] == 250
    assert spark.table("golden_lake.gold_job_performance").count() == 3
    about = {r[0]: r[1] for r in spark.sql("DESCRIBE EXTENDED golden_lake.silver_task_events").collect()}
    assert about["Comment"] == "finished tasks with their metrics"
    assert "quality=silver" in about["Table Properties"]


def test_input_named_by_settings(spark, tmp_path):
    write_log(tmp_path / "logs", golden_events())
    spark.conf.set("pipeline.log_root", str(tmp_path / "logs"))
    spark.conf.set("pipeline.cluster_id", CLUSTER)
    counts = run_configured(spark, str(tmp_path / "lake"))
    assert counts["silver_job_events"] == {"rows": 6, "valid_job_id": 0}
