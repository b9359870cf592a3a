"""Spellings of the log format, missing and malformed values, quality rules."""

import json
import re

from pyspark.sql import Observation
from pyspark.sql import functions as F

from emberlog.functions.metrics import all_found, first_found
from emberlog.plans.lake import TABLES, build_tables
from emberlog.sources.eventlog import tag_events
from emberlog.sources.quality import TABLE_RULES, count_violations, drop_bad_rows
from tests.logs import (
    APP,
    CLUSTER,
    T0,
    app_end,
    app_start,
    environment,
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


def one(tables, name):
    (row,) = tables[name].collect()
    return row


def test_both_user_spellings(spark):
    for field in ("Spark User", "User"):
        row = one(tables_of(spark, [app_start(user_field=field)]), "silver_application_events")
        assert (row["spark_user"], row["app_name"], row["timestamp_ms"]) == (
            "tester", "TestSparkApp", T0,
        )


def test_gc_spellings_and_value_types(spark):
    for name in ("jvmGarbageCollectionTime", "jvmGCTime"):
        for value in (7, "7"):
            metrics = {"executorRunTime": 100, name: value}
            row = one(tables_of(spark, [stage(1, 0, 10, metrics)]), "silver_stage_events")
            assert (row["jvm_gc_time_ms"], row["gc_overhead_pct"]) == (7, 7.000000000000001)


def test_accumulables_missing_repeated_and_malformed(spark):
    def entry(name, value):
        return {"Name": f"internal.metrics.{name}", "Value": value}

    repeated = [
        {"Name": "number of output rows", "Value": "1"},
        {"Name": None, "Value": "3"},
        entry("executorRunTime", "5"),
        entry("executorRunTime", "9"),
        entry("resultSize", "many"),
    ]
    got = {
        r["stage_id"]: r
        for r in tables_of(
            spark, [stage(1, 0, 1, repeated), stage(2, 0, 1, []), stage(3, 0, 1, None)]
        )["silver_stage_events"].collect()
    }
    assert got[1]["executor_run_time_ms"] == 5
    assert got[1]["result_size_bytes"] is None
    assert got[1]["disk_bytes_spilled"] == 0
    for empty in (got[2], got[3]):
        assert (empty["executor_run_time_ms"], empty["shuffle_read_bytes"]) == (0, 0)
        assert (empty["gc_overhead_pct"], empty["cpu_efficiency_pct"]) == (0.0, None)


def test_stage_status_and_delay(spark):
    events = [
        stage(1, 100, 900, {}, first=130),
        stage(2, 100, 900, {}, reason="boom"),
        stage(3, 100, 900, {}, reason=None),
    ]
    got = {r["stage_id"]: r for r in tables_of(spark, events)["silver_stage_events"].collect()}
    assert [got[i]["status"] for i in (1, 2, 3)] == ["COMPLETED", "FAILED", "COMPLETED"]
    assert [got[i]["scheduling_delay_ms"] for i in (1, 2, 3)] == [30, 0, 0]
    assert got[1]["duration_ms"] == 800


def test_task_without_metrics(spark):
    row = one(tables_of(spark, [task(1, 1, 10, 50, metrics=False)]), "silver_task_events")
    assert row["executor_run_time_ms"] is None and row["gc_time_ms"] is None
    assert row["shuffle_read_bytes"] == 0 and row["gc_overhead_pct"] is None
    assert row["cpu_efficiency_pct"] is None and row["task_duration_ms"] == 50


def test_zero_duration_task(spark):
    row = one(tables_of(spark, [task(1, 1, 10, 0, gc=5)]), "silver_task_events")
    assert (row["gc_overhead_pct"], row["cpu_efficiency_pct"]) == (0.0, None)


def test_non_numeric_text_becomes_null(spark):
    tables = tables_of(
        spark,
        [
            job_start("12", 5, [1]),
            job_start("twelve", 5, [1]),
            executor_added("1", "soon", "h", cores="x", profile="0"),
            profile_added(0, "1e3", "much", 1),
        ],
    )
    assert [r["job_id"] for r in tables["silver_job_events"].collect()] == [12]
    row = one(tables, "silver_executor_events")
    assert (row["timestamp_ts"], row["total_cores"], row["resource_profile_id"]) == (None, None, 0)
    row = one(tables, "silver_resource_profiles")
    assert (row["onheap_memory_mb"], row["offheap_memory_mb"], row["task_cpus"]) == (
        1000.0, None, 1.0,
    )


def test_property_shapes_and_repeats(spark):
    pairs = [["spark.executor.cores", "2"], ["spark.executor.cores", "4"], ["spark.ui.port", "1"]]
    for properties in (pairs, {"spark.executor.cores": "4", "spark.ui.port": "1"}):
        row = one(tables_of(spark, [environment(properties)]), "silver_spark_config")
        assert (row["config_key"], row["config_value"]) == ("spark.executor.cores", "4")
    for nothing in ({}, [], None):
        assert tables_of(spark, [environment(nothing)])["silver_spark_config"].count() == 0


def test_executor_and_sql_events(spark):
    tables = tables_of(
        spark,
        [
            executor_added(1, T0, "h1", 8, 3),
            executor_removed(1, T0 + 5, "idle"),
            sql_start(1, 10, "a", "(1) Scan"),
            sql_end(1, 30),
            sql_start(2, 11),
        ],
    )
    events = {r["event_type"]: r for r in tables["silver_executor_events"].collect()}
    assert events["SparkListenerExecutorAdded"]["resource_profile_id"] == 3
    assert events["SparkListenerExecutorRemoved"]["removed_reason"] == "idle"
    sql = {r["execution_id"]: r for r in tables["silver_sql_executions"].collect()}
    assert (sql[1]["start_time_ms"], sql[1]["end_time_ms"]) == (10, 30)
    assert (sql[2]["end_time_ms"], sql[2]["physical_plan"]) == (None, None)


def test_job_events(spark):
    got = tables_of(spark, [job_start(1, 5, [3, 4]), job_end(1, 9, "JobFailed")])
    start, end = sorted(got["silver_job_events"].collect(), key=lambda r: r["event_type"])[::-1]
    assert (start["stage_ids"], start["submission_ms"], start["job_result"]) == ("[3,4]", 5, None)
    assert (end["completion_ms"], end["job_result"], end["stage_ids"]) == (9, "JobFailed", None)


def test_rules_count_and_drop(spark):
    df = spark.createDataFrame(
        [(1, 5), (None, 5), (2, 0), (3, None)], "stage_id int, num_tasks int"
    )
    rules, seen = TABLE_RULES["silver_stage_events"], Observation("r")
    kept = drop_bad_rows(count_violations(df, rules, seen), rules).collect()
    assert sorted(r["stage_id"] for r in kept) == [1, 2, 3]
    assert seen.get == {"rows": 4, "valid_stage_id": 1, "has_tasks": 2}


def test_rows_without_app_id_are_dropped_only_from_applications(spark):
    tables = tables_of(spark, [app_end(9), job_start(1, 1, [])], app="")
    assert tables["silver_application_events"].count() == 0
    assert tables["silver_job_events"].count() == 1
    assert APP


HUGE = [99_999_999_999_999_999, 2**63 - 1, -(2**63), 10**30]


def test_no_number_fails_a_run(spark):
    """Each extreme value in each place, under ANSI arithmetic, through every table."""
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    events = []
    for n, value in enumerate(HUGE):
        events += [
            app_start(at=value, app=f"application_1_{n}"),
            job_start(n, value, [1]),
            job_end(n, -value),
            stage(n, value, -value, {"executorRunTime": value, "executorCpuTime": value,
                                     "shuffle.read.remoteBytesRead": value,
                                     "shuffle.read.localBytesRead": value}, first=-value),
            stage(n, 1, 2, {"memoryBytesSpilled": value, "diskBytesSpilled": value}, attempt=1),
            task(n, n, value, 5, read=value, disk=value, memory=value, gc=value, cpu=value),
            executor_added(n, value, "h", cores=value, profile=value),
            profile_added(n, value, value, value),
            sql_start(n, value), sql_end(n, -value),
        ]
    tables = tables_of(spark, events)
    for name in TABLES:
        tables[name].write.format("noop").mode("overwrite").save()
    row = tables["silver_stage_events"].where("stage_id = 1 AND attempt_id = 0").first()
    assert (row["duration_ms"], row["submission_ts"], row["shuffle_read_bytes"]) == (None,) * 3


def test_rolled_files_count_by_their_number(spark):
    rows = [
        (json.dumps(environment([["spark.executor.memory", f"{n}g"]])),
         f"file:/logs/{CLUSTER}/eventlog/eventlog_v2_{APP}/events_{n}_{APP}")
        for n in (10, 9, 2)
    ]
    lines = spark.createDataFrame(rows, "value string, source_file string")
    table = build_tables(tag_events(lines, CLUSTER), ["silver_spark_config"])
    assert [r["config_value"] for r in table["silver_spark_config"].collect()] == ["10g"]


def test_ids_of_the_fixture_stay_small(spark):
    from checks.adapter import APPLICATION, JOB_ID, STAGE_ID

    keys = [n for block in (10**7, 10**9, 10**11) for n in range(block, block + 20_000, 7)]
    orders = spark.createDataFrame([(k, k % 15_000) for k in keys], "o_orderkey long, o_custkey long")
    named = orders.selectExpr(f"{APPLICATION} AS k", f"{STAGE_ID} AS stage", "*")
    assert named.select("k", "stage").distinct().count() == len(keys)
    assert named.where("try_cast(stage AS int) IS NULL").count() == 0
    jobs = named.groupBy("k", "o_custkey").agg(F.expr(JOB_ID).alias("job"))
    assert jobs.select("k", "job").distinct().count() == jobs.count()
    assert jobs.where("try_cast(job AS int) IS NULL").count() == 0


def test_metric_lookups_stay_small_enough_to_be_compiled(spark):
    """The JVM does not compile methods of 8,000 bytes or more."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = spark.createDataFrame([("{}", "file")], "value string, source_file string")
        stages = build_tables(tag_events(lines, CLUSTER), ["silver_stage_events"])
        code = stages["silver_stage_events"]._jdf.queryExecution().debug().codegenToSeq()
        sizes = [code.apply(n)._3().maxMethodCodeSize() for n in range(code.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(sizes) < 8_000


def test_lists_of_names_are_looked_up_as_one_by_one(spark):
    entries = "map<string,string>"
    rows = spark.createDataFrame(
        [({"a": "1", "c": "3"},), ({"b": "2", "a": "x"},), ({"b": None},), ({},), (None,)],
        f"m {entries}",
    )
    wanted = [("a",), ("a", "b"), ("c",), ("d", "c")]
    got = rows.select(
        all_found(F.col("m"), wanted).alias("all"),
        F.array(*[first_found(F.col("m"), names) for names in wanted]).alias("each"),
    ).collect()
    assert [row["all"] for row in got] == [row["each"] for row in got]
    assert [row["all"] for row in got] == [
        [1, 1, 3, 3], [None, 2, 0, 0], [0, None, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0],
    ]


def test_stage_metrics_need_no_map_and_one_lambda_for_all_texts(spark):
    lines = spark.createDataFrame([("{}", "file")], "value string, source_file string")
    stages = build_tables(tag_events(lines, CLUSTER), ["silver_stage_events"])
    plan = stages["silver_stage_events"]._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from" not in plan and "map_contains_key" not in plan
    assert "array_position(" in plan
    # Only where the texts become numbers; the lookups beside it are compiled.
    lambdas = {found for found in re.findall(r"lambdafunction\(.*?\)", plan) if "array_position" in found}
    assert not lambdas
