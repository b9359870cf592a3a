"""Shapes of the plans: what is pushed down, shuffled once, and never done."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from emberlog.operators.concurrency import interval_concurrency, open_counts
from emberlog.operators.dedup import latest_by_key
from emberlog.operators.peers import peer_load
from emberlog.plans.lake import BRONZE, TABLES, Lake, build_tables, write_bronze
from emberlog.sources.eventlog import tag_events
from emberlog.sources.quality import TABLE_RULES, drop_bad_rows
from tests.logs import CLUSTER, golden_events, lines_df

SMALLEST = entry.SMALLEST


def plan_of(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    lake = Lake(spark, str(tmp_path_factory.mktemp("plans")))
    write_bronze(lake, lines_df(spark, golden_events()), CLUSTER)
    return lake


@pytest.mark.parametrize("name", [n for n, t in TABLES.items() if t.inputs == (BRONZE,)])
def test_typed_tables_prune_bronze_and_do_not_shuffle(lake, name):
    plan = plan_of(TABLES[name].build(lake.read(BRONZE)))
    filters = re.findall(r"PartitionFilters: \[(.*)\]", plan)
    assert filters and all("event_kind#" in found for found in filters)
    assert "Python" not in plan and "ArrowEval" not in plan
    allowed = {"silver_spark_config": 1}.get(name, 0)  # one row per key and task
    assert len(re.findall(r"^\(\d+\) Exchange", plan, re.M)) <= allowed


def test_one_json_parse_per_stage_and_task(lake):
    for name in ("silver_stage_events", "silver_task_events"):
        assert plan_of(TABLES[name].build(lake.read(BRONZE))).count("from_json(") == 1


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["silver_job_events", "silver_stage_events", "silver_task_events"])
def test_one_json_parse_under_the_rules(spark, lake, name):
    """Rules on parsed columns do not make Spark parse a line again."""
    lazy = build_tables(tag_events(lines_df(spark, golden_events()), CLUSTER), [name])[name]
    written = drop_bad_rows(TABLES[name].build(lake.read(BRONZE)), TABLE_RULES[name])
    assert optimised(written).count("from_json(") == 1
    # Lines with an app id in their path and lines without go through a branch each.
    assert optimised(lazy).count("from_json(") == optimised(lazy).count("Union") + 1 == 2


def test_bronze_reads_only_needed_columns(lake):
    plan = plan_of(TABLES["silver_sql_executions"].build_written(lake.read(BRONZE)))
    assert "source_file" not in plan
    assert "BroadcastHashJoin" in plan  # the end events were counted first


def test_sweep_shuffles_the_times_once(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS s", "id + 5 AS e")
    counted = open_counts(df, ["k"], "s", "e")
    counted.collect()
    assert "ReusedExchange" in counted._jdf.queryExecution().executedPlan().toString()


def test_latest_by_key_passes_on_a_row_per_key_and_task(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS v")
    plan = plan_of(latest_by_key(df, ["k"], ["v"]))
    assert "Window" not in plan and "partial_max_by" in plan


SPLIT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "30000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def small_skew(spark):
    """Settings under which Spark splits partitions of some kilobytes."""
    before = {name: spark.conf.get(name, None) for name in SPLIT}
    for name, value in SPLIT.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("write_norms", [True, False])
def test_a_group_of_most_entities_is_split(spark, small_skew, write_norms):
    df = spark.range(0, 60_000, 1, 8).selectExpr(
        "if(id % 10 < 8, 0, id % 97) AS g", "id AS i", "id % 1013 AS v"
    )
    plan = final_plan(peer_load(df, ["g"], "v", "mean", write_norms=write_norms))
    assert ("SortMergeJoin(skew=true)" in plan) == write_norms


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_python_and_no_cross_joins(spark, name):
    plan = plan_of(entry.queries()[name](spark, SMALLEST))
    # Operators stand in numbered lines; a plan may name others in its literals.
    operators = set(re.findall(r"^\(\d+\) (\w+)", plan, re.M))
    assert operators
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEval",
                 "MapInPandas", "FlatMapGroups"):
        assert not {o for o in operators if o.startswith(word)}


def test_building_starts_no_job(spark):
    tracker, group = spark.sparkContext.statusTracker(), "building"
    tagged = tag_events(lines_df(spark, golden_events()), CLUSTER)
    spark.sparkContext.setJobGroup(group, "no job")
    build_tables(tagged)
    assert not tracker.getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("", "")


def test_concurrency_shuffles_by_id_once(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id % 500 AS n", "id AS s", "id + 5 AS e")
    counted = interval_concurrency(df, ["k"], "n", "s", "e")
    counted.collect()
    # No id is frequent here, so what would count such ids is gone when the plan has run.
    plan = counted._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(set(re.findall(r" Exchange .*plan_id=(\d+)", plan))) <= 9


def test_intervals_are_shuffled_by_id_before_they_are_doubled(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id % 500 AS n", "id AS s", "id + 5 AS e")
    plan = optimised(interval_concurrency(df, ["k"], "n", "s", "e")).split("\n")
    doubled = [n for n, line in enumerate(plan) if "Generate explode" in line and "_starts" in line]
    assert doubled and "RepartitionByExpression [k" in "".join(plan[doubled[0] : doubled[0] + 3])


def test_after_the_counts_rows_are_together_by_id(spark, small_skew):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id % 500 AS n", "id AS s", "id + 5 AS e")
    counted = interval_concurrency(df, ["k"], "n", "s", "e")
    plan = final_plan(counted.groupBy("k", "n", "s").agg(F.sum("concurrent_at_start")))
    exchanges = re.findall(r" Exchange hashpartitioning\((.*?)\)", plan.split("Initial Plan")[0])
    columns = [re.findall(r"(\w+)#", found) for found in exchanges]
    assert ["k", "n"] in columns and ["k", "s"] in columns
    assert ["k", "n", "s"] not in columns
