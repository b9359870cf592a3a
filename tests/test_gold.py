"""Cases the golden scenario does not have, one small log each."""

import pytest

from emberlog.operators.rules import Thresholds
from emberlog.plans import gold
from tests.logs import (
    GIB,
    T0,
    app_end,
    app_start,
    executor_added,
    executor_removed,
    job_end,
    job_start,
    profile_added,
    sql_end,
    sql_start,
    stage,
    tables_of,
    task,
)


def by(rows, key):
    return {r[key]: r for r in rows}


METRIC_CASES = {
    "MEMORY_SPILL": {"executorRunTime": 100, "memoryBytesSpilled": 1},
    "MODERATE_GC": {"executorRunTime": 100, "jvmGCTime": 11},
    "HIGH_GC": {"executorRunTime": 100, "jvmGCTime": 21},
    "HEAVY_SHUFFLE": {"shuffle.read.localBytesRead": 10 * GIB + 1},
    "DISK_SPILL": {"diskBytesSpilled": 1, "memoryBytesSpilled": 9, "jvmGCTime": 99,
                   "executorRunTime": 100},
    "OK": {"executorRunTime": 100, "jvmGCTime": 10, "shuffle.read.localBytesRead": 10 * GIB},
}


def test_classes_and_thresholds(spark):
    kinds = list(METRIC_CASES)
    events = [stage(n, 0, 10, METRIC_CASES[kind]) for n, kind in enumerate(kinds)]
    # Exactly 20 % is not HIGH_GC; a ratio of exactly 5 is not skew, 5.01 is.
    events.append(stage(50, 0, 10, {"executorRunTime": 100, "jvmGCTime": 20}))
    events += [stage(51, 0, 10, {}), stage(52, 0, 10, {})]
    for sid, longest in ((51, 500), (52, 501)):
        events += [task(i, sid, 0, 100) for i in range(3)] + [task(3, sid, 0, longest)]
    got = by(tables_of(spark, events)["gold_stage_performance"].collect(), "stage_id")
    assert [got[n]["bottleneck_type"] for n in range(len(kinds))] == kinds
    assert got[50]["bottleneck_type"] == "MODERATE_GC"
    assert (got[51]["task_skew_ratio"], got[51]["bottleneck_type"]) == (5.0, "OK")
    assert (got[52]["task_skew_ratio"], got[52]["bottleneck_type"]) == (5.01, "DATA_SKEW")
    assert got[5]["recommendation"] == "ボトルネックなし。" and got[5]["severity"] == "NONE"


def test_options_of_the_stage_table(spark):
    tables = tables_of(
        spark,
        [
            stage(1, 0, 10, {"executorRunTime": 100, "jvmGCTime": 30}),
            stage(2, 0, 10, {}, reason="Stage cancelled by adaptive execution"),
        ],
    )
    got = by(
        gold.stage_performance(
            tables["silver_stage_events"], tables["work_stage_task_profile"],
            Thresholds(high_gc_pct=50), "en", "cancelled",
        ).collect(),
        "stage_id",
    )
    assert got[1]["bottleneck_type"] == "MODERATE_GC"
    assert got[1]["recommendation"].startswith("Monitor GC")
    assert got[2]["bottleneck_type"] == "OK"


def test_failed_speculative_and_retried_tasks(spark):
    events = [
        stage(1, 100, 900, {}, attempt=0, reason="lost"),
        stage(1, 1000, 1900, {}, attempt=1),
        task(1, 1, 120, 10, result="ExceptionFailure"),
        task(2, 1, 110, 10, attempt=1, speculative=True, disk=5),
        task(3, 1, 1100, 30, attempt=1),
        task(4, 1, 1100, 30, attempt=1, result="TaskKilled"),
    ]
    tables = tables_of(spark, events)
    got = by(tables["gold_stage_performance"].collect(), "attempt_id")
    assert (got[0]["task_count"], got[0]["failed_tasks"]) == (None, None)
    assert (got[1]["task_count"], got[1]["failed_tasks"]) == (2, 0)
    assert (got[1]["speculative_tasks"], got[1]["tasks_with_disk_spill"]) == (1, 1)
    extras = by(
        gold.stage_task_extras(
            tables["silver_stage_events"], tables["silver_task_events"]
        ).collect(),
        "attempt_id",
    )
    assert [extras[a]["failed_task_attempts"] for a in (0, 1)] == [1, 1]
    assert extras[0]["scheduling_delay_from_tasks_ms"] == 20


def test_stage_in_two_jobs_counts_for_both(spark):
    events = [
        job_start(1, 0, [7]), job_start(2, 5, [7, 8]), job_start(3, 6, []),
        stage(7, 0, 10, {"diskBytesSpilled": 1}),
        task(1, 7, 0, 1000, cpu=500_000_000, gc=100), task(2, 7, 0, 3000, cpu=1_500_000_000),
        task(3, 7, 0, 9, result="ExceptionFailure"),
        stage(9, 0, 10, {"diskBytesSpilled": 1}),
    ]
    tables = tables_of(spark, events)
    report = tables["gold_bottleneck_report"].collect()
    assert sorted((r["stage_id"], r["job_id"] or 0) for r in report) == [(7, 1), (7, 2), (9, 0)]
    jobs = by(tables["gold_job_concurrency"].collect(), "job_id")
    for job in (1, 2):
        assert (jobs[job]["job_total_tasks"], jobs[job]["total_cpu_time_sec"]) == (2, 2.0)
        assert jobs[job]["job_cpu_efficiency_pct"] == 50.0
        assert (jobs[job]["avg_task_cpu_time_ms"], jobs[job]["total_gc_time_sec"]) == (1000.0, 0.1)
    assert jobs[3]["job_total_tasks"] is None


def test_running_overlapping_and_repeated_jobs(spark):
    events = [
        job_start(1, 1000, []), job_end(1, 2000),
        job_start(2, 1000, []), job_end(2, 1500),  # same submit time: both count
        job_start(3, 2000, []),                    # job 1 ends exactly here: still counts
        job_start(4, 2500, []), job_end(4, 2400),  # ends before it starts: never counts
        job_start(5, 3000, []), job_end(5, 3100, "JobFailed"),
        job_start(5, 3000, []),                    # logged twice, ends once
    ]
    tables = tables_of(spark, events)
    jobs = by(tables["gold_job_performance"].dropDuplicates(["job_id"]).collect(), "job_id")
    assert [jobs[j]["status"] for j in (1, 3, 5)] == ["SUCCEEDED", "RUNNING", "FAILED"]
    got = by(tables["gold_job_concurrency"].collect(), "job_id")
    assert {j: r["concurrent_jobs_at_start"] for j, r in got.items()} == {
        1: 1, 2: 1, 3: 1, 4: 1, 5: 2,
    }


def test_job_end_without_result_is_neither(spark):
    end = {"Event": "SparkListenerJobEnd", "Job ID": 1, "Completion Time": 9}
    (row,) = tables_of(spark, [app_start(), job_start(1, 1, []), end])[
        "gold_application_summary"
    ].collect()
    assert (row["total_jobs"], row["succeeded_jobs"], row["failed_jobs"]) == (1, 0, 0)
    assert row["job_success_rate"] == 0.0


def test_application_without_end_stages_or_jobs(spark):
    (row,) = tables_of(spark, [app_start()])["gold_application_summary"].collect()
    assert row["end_ts"] is None and row["duration_ms"] is None
    assert row["total_spill_gb"] is None and row["job_success_rate"] is None
    assert row["gc_overhead_pct"] == 0.0


def test_repeated_application_events_fan_out(spark):
    events = [app_start(), app_end(T0 + 60_000), app_end(T0 + 120_000)]
    got = tables_of(spark, events)["gold_application_summary"].collect()
    assert sorted(r["duration_min"] for r in got) == [1.0, 2.0]


def test_executors(spark):
    events = [
        profile_added(0, 4096, 512, 1), executor_added(1, T0, "h1", 4, 0),
        executor_added(1, T0 + 9, "h1", 8, 0), executor_removed(1, T0 + 20, "a"),
        executor_removed(1, T0 + 30, "b"),
        *[task(i, 1, 0, 100, executor=1) for i in range(16)],
        *[task(30 + i, 1, 0, 100, executor=2, host="h2") for i in range(4)],
        task(99, 1, 0, 10_000, executor=2, result="ExceptionFailure"),
    ]
    got = by(tables_of(spark, events)["gold_executor_analysis"].collect(), "executor_id")
    one, two = got["1"], got["2"]
    assert (one["load_vs_avg"], one["is_straggler"], two["is_underutilized"]) == (1.6, True, True)
    assert (one["total_cores"], one["removed_reason"], one["onheap_memory_mb"]) == (8, "b", 4096.0)
    assert (one["remove_ts"] - one["add_ts"]).microseconds == 30_000
    assert (two["total_tasks"], two["add_ts"], two["onheap_memory_mb"]) == (4, None, None)


@pytest.mark.parametrize(("loads", "flags"), [((3, 1), (False, False)), ((0, 0), (None, None))])
def test_exact_load_limits_and_zero_loads(spark, loads, flags):
    events = [task(n, 1, 0, ms, executor=n) for n, ms in enumerate(loads)]
    got = by(tables_of(spark, events)["gold_executor_analysis"].collect(), "executor_id")
    assert (got["0"]["is_straggler"], got["1"]["is_underutilized"]) == flags


def test_single_executor_has_no_z_score(spark):
    (row,) = tables_of(spark, [task(1, 1, 0, 10)])["gold_executor_analysis"].collect()
    assert (row["z_score"], row["load_vs_avg"]) == (None, 1.0)


def test_sql_executions(spark):
    plan = (
        "== Physical Plan ==\n* PhotonResultStage (5)\n\n(1) Scan parquet x\n(2) PhotonScan\n"
        "(3) PhotonBroadcastHashJoin Inner\n(4) SortMergeJoin\n(5) BroadcastHashJoin\n"
        "(6) Scan csv\n(7) ShuffledHashJoin\n"
    )
    tables = tables_of(
        spark,
        [
            sql_start(1, 1000, "  a \n\t b  ", plan), sql_end(1, 3456),
            sql_start(2, 1000, "c", ""), sql_start(3, 1000, "d"),
        ],
    )
    got = by(
        gold.sql_photon_analysis(
            tables["silver_sql_executions"], with_other_joins=True
        ).collect(),
        "execution_id",
    )
    first = got[1]
    assert (first["total_operators"], first["photon_operators"], first["photon_pct"]) == (7, 2, 28.6)
    assert (first["is_photon"], first["duration_sec"]) == ("true", 2.46)
    assert (first["bhj_count"], first["photon_bhj_count"], first["smj_count"]) == (1, 1, 1)
    assert (first["total_join_count"], first["other_join_count"]) == (3, 1)
    assert first["non_photon_op_list"] == "Scan, SortMergeJoin, BroadcastHashJoin, ShuffledHashJoin"
    assert first["description_short"] == "a b"
    assert (got[2]["total_operators"], got[2]["photon_pct"], got[2]["is_photon"]) == (
        0, None, "false",
    )
    assert (got[3]["total_operators"], got[3]["is_photon"]) == (None, None)
