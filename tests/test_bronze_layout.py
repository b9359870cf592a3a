"""Row groups of written Bronze, as the Parquet footers state them."""

import glob
import gzip
import os
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from checks.adapter import _executors, _orders, event_lines
from checks.fixture_lake import log_folder
from emberlog import schemas as S
from emberlog.operators.distribution import Spread, distribution_profile
from emberlog.plans import lake as lake_module
from emberlog.plans.lake import BRONZE, ROW_GROUP_ROWS, ROW_GROUP_TEXT, Lake, write_bronze
from tests.logs import CLUSTER

# Kind, rows, repeats of a 64-character hash in a line: short lines, long ones, and long
# ones of few different characters.
SHAPES = [
    (S.TASK_END, 110_000, "repeat(sha2(cast(id AS string), 256), 16)"),
    (S.SQL_START, 2_500, "repeat(sha2(cast(id AS string), 256), 700)"),
    (S.STAGE_COMPLETED, 2_500, "repeat(cast(id AS string), 12000)"),
]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    lake = Lake(spark, str(tmp_path_factory.mktemp("layout")))
    parts = [
        spark.range(rows).selectExpr(
            f"""concat('{{"Event":"{event}","x":"', {text}, '"}}') AS value""",
            "'file:/logs/c/eventlog/app-1/log' AS source_file",
        )
        for event, rows, text in SHAPES
    ]
    write_bronze(lake, parts[0].unionByName(parts[1]).unionByName(parts[2]), CLUSTER)
    return lake


@pytest.mark.parametrize("event", [event for event, _, _ in SHAPES])
def test_row_groups_follow_the_text(spark, written, event):
    text = (
        written.read(BRONZE).where(f"event_kind = '{event}'").selectExpr("sum(length(value))")
    ).first()[0]
    assert text > 3 * ROW_GROUP_TEXT
    files = glob.glob(f"{written.path(BRONZE)}/event_kind={event}/*.parquet")
    footers = [pq.ParquetFile(file).metadata for file in files]
    groups = [f.row_group(i) for f in footers for i in range(f.num_row_groups)]
    assert len(groups) >= text // ROW_GROUP_TEXT
    assert max(group.num_rows for group in groups) <= ROW_GROUP_ROWS
    # The writer looks at the size now and then, so a group may be somewhat larger.
    assert max(group.total_byte_size for group in groups) <= 1.25 * ROW_GROUP_TEXT
    # Most of the text lies in whole groups, not in crumbs.
    assert len(groups) <= 3 * (text // ROW_GROUP_TEXT) + len(files)


def test_every_row_is_there(spark, written):
    counts = {r.event_kind: r["count"] for r in written.read(BRONZE).groupBy("event_kind").count().collect()}
    assert counts == {event: rows for event, rows, _ in SHAPES}


def test_lines_are_neither_shuffled_nor_sorted(spark, tmp_path, monkeypatch):
    plans = []
    writer = lake_module._bronze_writer
    monkeypatch.setattr(lake_module, "_bronze_writer", lambda df: plans.append(df) or writer(df))
    lines = spark.range(1000, numPartitions=4).selectExpr(
        """to_json(named_struct('Event', 'SparkListenerTaskEnd', 'x', id)) AS value""",
        "'file:/logs/c/eventlog/app-1/log' AS source_file",
    )
    lake = Lake(spark, str(tmp_path))
    write_bronze(lake, lines, CLUSTER)
    assert len(plans) == 1
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    # The JSON is made once and not again for a filter.
    assert plan.count("StructsToJsonEvaluator") == 1
    assert lake.read(BRONZE).count() == 1000
    for file in glob.glob(f"{lake.path(BRONZE)}/*/*.parquet"):
        assert pq.ParquetFile(file).metadata.row_group(0).column(0).compression == "ZSTD"


def test_crumbs_of_rare_kinds_are_gathered(spark, tmp_path):
    lines = spark.range(2000, numPartitions=40).selectExpr(
        """concat('{"Event":"', if(id % 2 = 0, 'SparkListenerJobStart', 'x'), '"}') AS value""",
        "'file:/logs/c/eventlog/app-1/log' AS source_file",
    )
    lake = Lake(spark, str(tmp_path))
    write_bronze(lake, lines, CLUSTER)
    files = glob.glob(f"{lake.path(BRONZE)}/*/*.parquet")
    assert len(files) <= 4 and lake.read(BRONZE).count() == 2000
    assert {f.split("event_kind=")[1].split("/")[0] for f in files} == {S.JOB_START, S.OTHER_EVENT}


def test_log_files_are_compressed_and_few(spark):
    folder = log_folder(spark, "/root/testdata/sf0.001")
    files = glob.glob(f"{folder.removeprefix('file:')}/**/part-*", recursive=True)
    apps = {file.split("app=")[1].split("/")[0] for file in files}
    assert files and all(file.endswith(".gz") for file in files)
    # Tasks, stages, jobs, executors and the application itself; the texts and SQL
    # executions are dealt to the first five applications in as many files as tasks.
    assert len(files) <= 5 * len(apps) + 5 * 2 * spark.sparkContext.defaultParallelism


def test_lines_of_tasks_and_stages_read_one_shuffle(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = event_lines(spark, "/root/testdata/sf0.001")
        plan = lines._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    reused = [line for line in plan.split("\n") if "ReusedExchange" in line and "l_partkey" in line]
    assert len(reused) == 1


def test_executors_cross_the_join_as_one_row_for_each_order(spark, tmp_path):
    orders = [(1, 5), (2, 6), (3, 5), (10_003, 5), (4, None)]
    items = [
        (1, 1, 7), (1, 1, 7), (1, 7, 3), (1, 3, 19), (1, 2, 39), (2, 1, None), (2, None, 8),
        (3, 1, -3), (3, 2, 20), (10_003, 1, 18), (4, 1, 2), (9, 1, 1), (None, 1, 1),
    ]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").selectExpr(
        "*", "'F' AS o_orderstatus", "timestamp_ntz'1995-01-01 00:00:00' AS o_orderdate"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(
        items, "l_orderkey long, l_linenumber int, l_suppkey long"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    executors = _executors(spark, str(tmp_path), _orders(spark, str(tmp_path)))
    got = {tuple(row) for row in executors.where("k IS NOT NULL").collect()}
    assert got == {(0, 7), (0, 0), (0, 19), (1, None), (1, 8), (0, -3), (5, 18)}
    assert executors.where("k IS NOT NULL").count() == len(got)
    plan = executors._jdf.queryExecution().executedPlan().toString()
    assert "partial_bit_or" in plan and "l_suppkey" not in plan.split("SortMergeJoin")[0]


TEXT_LINES = """to_json(named_struct('Event', 'SparkListenerTaskEnd', 'run', id * 7919 % 100003,
    'cpu', id * 7919 % 100003 * 508000, 'id', id)) AS value"""


def _shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    before = _shuffle_files(spark)
    lines = spark.range(20_000).repartition(5, "id").selectExpr(
        TEXT_LINES, "'file:/logs/c/eventlog/app-1/log' AS source_file"
    )
    lake = Lake(spark, str(tmp_path))
    write_bronze(lake, lines, CLUSTER)
    lake.write("sums", spark.range(1000).groupBy((F.col("id") % 10).alias("g")).count())
    assert lake.read(BRONZE).where("length(value) > 0").collect() and lake.read("sums").collect()
    for _ in range(50):  # files go in the background
        if _shuffle_files(spark) <= before:
            break
        time.sleep(0.2)
    assert _shuffle_files(spark) <= before
    # The rows may be used again, and the session is as it was.
    assert lines.count() == 20_000
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert spark.conf.get(name) == "false"


def test_text_is_stored_smaller_than_at_the_usual_level(spark, tmp_path, monkeypatch):
    lines = spark.range(60_000, numPartitions=2).selectExpr(
        TEXT_LINES, "'file:/logs/c/eventlog/app-1/log' AS source_file"
    )

    def size(name):
        lake = Lake(spark, f"{tmp_path}/{name}")
        write_bronze(lake, lines, CLUSTER)
        files = glob.glob(f"{lake.path(BRONZE)}/*/*.parquet")
        return sum(pq.ParquetFile(f).metadata.row_group(0).column(0).total_compressed_size for f in files)

    now = size("now")
    monkeypatch.setattr(lake_module, "TEXT_LEVEL", 3)
    assert now < size("usual")


def test_tasks_that_write_text_read_small_partitions(spark, tmp_path, monkeypatch):
    name, sizes = "spark.sql.adaptive.advisoryPartitionSizeInBytes", []
    writer = lake_module._bronze_writer
    monkeypatch.setattr(
        lake_module, "_bronze_writer", lambda df: sizes.append(spark.conf.get(name)) or writer(df)
    )
    usual = spark.conf.get(name)
    lines = spark.range(10).selectExpr(TEXT_LINES, "'file:/logs/c/eventlog/app-1/log' AS source_file")
    write_bronze(Lake(spark, str(tmp_path)), lines, CLUSTER)
    assert sizes == [lake_module.SHUFFLED_FOR_TEXT] and spark.conf.get(name) == usual


def test_line_items_are_shuffled_once_for_the_join(spark):
    plan = event_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
    assert "RoundRobinPartitioning" not in plan.toString()


def test_lines_get_no_dictionary(spark, tmp_path):
    lines = spark.range(2000, numPartitions=1).selectExpr(
        TEXT_LINES, "'file:/logs/c/eventlog/app-1/log' AS source_file"
    )
    lake = Lake(spark, str(tmp_path))
    write_bronze(lake, lines, CLUSTER)
    (file,) = glob.glob(f"{lake.path(BRONZE)}/*/*.parquet")
    columns = [pq.ParquetFile(file).metadata.row_group(0).column(n) for n in (0, 1)]
    found = [{e for e in c.encodings if "DICTIONARY" in e} for c in columns]
    assert columns[0].path_in_schema == "value" and not found[0] and found[1]


def test_log_files_are_not_compressed_at_the_usual_level(spark):
    folder = log_folder(spark, "/root/testdata/sf0.001")
    files = glob.glob(f"{folder.removeprefix('file:')}/**/part-*.gz", recursive=True)
    largest = max(files, key=os.path.getsize)
    with open(largest, "rb") as file:
        text = gzip.decompress(file.read())
    assert len(gzip.compress(text, 6)) < os.path.getsize(largest) < len(text) / 2


def test_many_different_numbers_of_a_table_are_stored_as_differences(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.write("numbers", spark.range(0, 300_000, 1, 1).selectExpr("id", "id % 7 AS few"))
    (file,) = glob.glob(f"{tmp_path}/numbers/*.parquet")
    group = pq.ParquetFile(file).metadata.row_group(0)
    assert "DELTA_BINARY_PACKED" in group.column(0).encodings
    assert group.column(0).total_compressed_size < 300_000
    assert lake.read("numbers").agg(F.sum("id"), F.sum("few")).first() == (44_999_850_000, 899_997)


def test_counting_large_groups_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    df = spark.range(1000).selectExpr("id % 10 AS k", "id AS v")
    profile = distribution_profile(df, ["k"], [Spread("v", {"p50": 0.5})], exact=True)
    for _ in range(50):  # files go in the background
        if _shuffle_files(spark) <= before:
            break
        time.sleep(0.2)
    assert _shuffle_files(spark) <= before
    assert profile.count() == 10
