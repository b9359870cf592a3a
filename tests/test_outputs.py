"""Report order, history, streaming ingest, and a log written by Spark itself."""

import datetime
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from emberlog.plans import reports as R
from emberlog.plans.lake import Lake, run
from emberlog.sources.history import append_history, append_history_table, read_history
from emberlog.sources.eventlog import fill_app_ids, read_lines, tag_events
from emberlog.streaming.bronze import append_bronze, read_bronze
from tests.logs import APP, CLUSTER, app_start, job_start, sql_end, sql_start, tables_of, write_log


def test_history_appends(spark, tmp_path):
    path = str(tmp_path / "history")
    now = datetime.datetime(2026, 1, 2, 3, 4, 5)
    entry = dict(
        generated_at=now, model_name="m", schema_name="s", summary_text="a", top3_text="b",
        prompt_tokens=1, total_tokens=2,
    )
    assert append_history(spark, path, [entry]).count() == 1
    append_history(spark, path, [{**entry, "model_name": "n"}, {**entry, "summary_text": None}])
    assert read_history(spark, path).count() == 3
    for rows in (1, 2):
        assert append_history_table(spark, "default.history", [entry]).count() == rows
    assert [f.dataType.simpleString() for f in read_history(spark, path).schema] == [
        "timestamp", "string", "string", "string", "string", "int", "int",
    ]


def test_history_of_a_repeated_run_is_not_doubled(spark, tmp_path):
    path = str(tmp_path / "history")
    entry = dict(
        generated_at=datetime.datetime(2026, 1, 2), model_name="m", schema_name="s",
        summary_text="a", top3_text="b", prompt_tokens=1, total_tokens=2,
    )
    other = {**entry, "summary_text": "c"}
    assert append_history(spark, path, [entry], run_key="2026-01-02/a b").count() == 1
    assert append_history(spark, path, [entry, other], run_key="2026-01-02/a b").count() == 2
    assert append_history(spark, path, [entry, other], run_key="2026-01-02/a b").count() == 2
    assert append_history(spark, path, [entry], run_key="2026-01-03").count() == 3
    assert append_history(spark, path, [entry]).count() == 4
    for key in ("", "..", "."):
        with pytest.raises(ValueError):
            append_history(spark, path, [entry], run_key=key)
    assert read_history(spark, path).columns == list(entry)


class Logs:
    """A log folder read by the batch reader and by the incremental one."""

    def __init__(self, spark, folder):
        self.spark, self.logs, self.lake = spark, str(folder / "logs"), str(folder / "lake")

    def load(self, **options):
        return append_bronze(self.spark, self.logs, CLUSTER, self.lake, **options)

    def rows(self, bronze):
        return sorted(map(str, bronze.drop("ingested_at", "source_file").collect()))

    def equal(self):
        batch = fill_app_ids(tag_events(read_lines(self.spark, self.logs, CLUSTER), CLUSTER))
        both = read_bronze(self.spark, self.logs, CLUSTER, self.lake)
        assert self.rows(both) == self.rows(batch.select(*both.columns))
        return both.count()


def test_incremental_reads_closed_files_once_and_open_ones_each_time(spark, tmp_path):
    logs, root = Logs(spark, tmp_path), tmp_path / "logs"
    write_log(root, [app_start(), "junk", job_start(1, 2, [])])
    write_log(root, [job_start(9, 2, [])], name="run2/eventlog.inprogress")
    assert logs.equal() == 3
    assert (logs.load(), logs.load(), logs.equal()) == (1, 0, 3)
    write_log(root, [job_start(9, 2, []), job_start(10, 3, [])], name="run2/eventlog.inprogress")
    assert (logs.load(), logs.equal()) == (0, 4)
    (root / CLUSTER / "eventlog" / APP / "run2" / "eventlog.inprogress").rename(
        root / CLUSTER / "eventlog" / APP / "run2" / "eventlog"
    )
    assert (logs.load(), logs.equal()) == (1, 4)


def test_incremental_leaves_a_growing_roll_until_a_later_one_or_the_end(spark, tmp_path):
    logs, root, app = Logs(spark, tmp_path), tmp_path / "logs", "eventlog_v2_local-5"
    status = write_log(root, [], app, name="appstatus_local-5.inprogress")
    write_log(root, [app_start(app="local-5")], app, name="events_1_local-5")
    assert (logs.load(), logs.equal()) == (0, 1)
    write_log(root, [app_start(app="local-5"), job_start(1, 2, [])], app, name="events_1_local-5")
    assert logs.equal() == 2
    write_log(root, [job_start(2, 2, [])], app, name="events_2_local-5")
    assert (logs.load(), logs.equal()) == (1, 3)
    write_log(root, [job_start(2, 2, []), job_start(3, 2, [])], app, name="events_2_local-5")
    assert (logs.load(), logs.equal()) == (0, 4)
    status.rename(status.with_name("appstatus_local-5"))
    assert (logs.load(), logs.load(), logs.equal()) == (1, 0, 4)


def jobs(logs):
    both = read_bronze(logs.spark, logs.logs, CLUSTER, logs.lake)
    found = both.where("event_type = 'SparkListenerJobStart'")
    return sorted(r[0] for r in found.selectExpr("from_json(value, '`Job ID` STRING').`Job ID`").collect())


def rolled(root, n, suffix="", job=None):
    name = f"events_{n}_local-6{suffix}"
    events = [app_start(app="local-6")] * (n == 1) + [job_start(n if job is None else job, 2, [])]
    return write_log(root, events, "eventlog_v2_local-6", name=name)


def test_a_compact_file_of_known_rolls_says_nothing_new(spark, tmp_path):
    logs, root = Logs(spark, tmp_path), tmp_path / "logs"
    first, second = rolled(root, 1), rolled(root, 2)
    rolled(root, 3)
    assert logs.load() == 2 and jobs(logs) == ["1", "2", "3"]
    # Compaction keeps some of the events; the others are known from the rolls.
    rolled(root, 2, ".compact")
    assert logs.load() == 0 and jobs(logs) == ["1", "2", "3"]  # before the rolls are deleted
    first.unlink(), second.unlink()
    assert logs.load() == 0 and jobs(logs) == ["1", "2", "3"]
    rolled(root, 4)
    assert logs.load() == 1 and jobs(logs) == ["1", "2", "3", "4"]


def test_a_compact_file_of_an_unknown_roll_replaces_the_known_ones(spark, tmp_path):
    logs, root = Logs(spark, tmp_path), tmp_path / "logs"
    first, second = rolled(root, 1), rolled(root, 2)
    assert logs.load() == 1 and jobs(logs) == ["1", "2"]
    first.unlink(), second.unlink()
    name = "events_2_local-6.compact"
    write_log(root, [app_start(app="local-6"), job_start(1, 2, []), job_start(2, 2, [])],
              "eventlog_v2_local-6", name=name)
    assert jobs(logs) == ["1", "2"]  # read as it is, it replaces them too
    assert logs.load() == 1 and jobs(logs) == ["1", "2"]
    third = rolled(root, 3)
    assert jobs(logs) == ["1", "2", "3"]
    # The next compaction stands for the first one as well.
    (root / CLUSTER / "eventlog" / "eventlog_v2_local-6" / name).unlink(), third.unlink()
    write_log(root, [app_start(app="local-6"), job_start(2, 2, []), job_start(3, 2, [])],
              "eventlog_v2_local-6", name="events_3_local-6.compact")
    rolled(root, 4)
    assert logs.load() == 1 and jobs(logs) == ["2", "3", "4"]
    assert logs.load() == 0


def test_incremental_after_a_run_that_died_and_in_small_steps(spark, tmp_path):
    logs, root = Logs(spark, tmp_path), tmp_path / "logs"
    for n in range(3):
        write_log(root, [app_start(app=f"local-{n}"), job_start(n, 2, [])], None, name=f"local-{n}")
    # Rows without an entry in the ledger, as a run leaves them that dies between.
    stray = tag_events(read_lines(spark, logs.logs, CLUSTER), CLUSTER)
    stray.write.partitionBy("event_kind").parquet(f"{logs.lake}/bronze_closed_events/batch=1")
    assert logs.equal() == 6
    assert [logs.load(max_files=2) for _ in range(3)] == [2, 1, 0]
    assert logs.equal() == 6
    ids = read_bronze(spark, logs.logs, CLUSTER, logs.lake).select("app_id").distinct().collect()
    assert {r["app_id"] for r in ids} == {"local-0", "local-1", "local-2"}


def test_sql_reports(spark):
    plain, fast = "(1) Scan\n(2) Filter", "(1) Scan\n(2) PhotonFilter"
    events = []
    for n in range(40):
        plan = None if n == 5 else fast if n % 2 else plain
        events += [sql_start(n, 0, f"q{n}", plan), sql_end(n, 1000 * (n + 1))]
    events.append(sql_start(99, 0, "running", fast))
    sql = tables_of(spark, events)["gold_sql_photon_analysis"].cache()
    ordered = [r["execution_id"] for r in R.sql_dataset(sql).collect()]
    assert ordered == [*range(39, -1, -1), 99]
    assert R.slowest_5_percent(sql).first()[0] == 25.0  # executions 39 and 38
    assert R.slowest_10_percent(sql).first()[0] == 25.0
    low = [r["description_short"] for r in R.least_accelerated(sql).collect()]
    assert low == ["q5", "q38", "q36", "q34", "q32"]  # unknown share first, then slowest


def test_first_rows(spark):
    df = spark.range(30).selectExpr("id", "cast(1.5 AS decimal(4, 2)) AS d", "NULL AS n")
    assert R.first_rows(df, 2) == [{"id": 0, "d": 1.5, "n": None}, {"id": 1, "d": 1.5, "n": None}]
    assert len(R.first_rows(df)) == 10


def test_charts_are_sorted_where_asked(spark):
    df = spark.createDataFrame([("1", "OK", 1.0), ("2", "OK", None), ("3", "OK", 7.0)],
                               "stage_id_str string, bottleneck_type string, shuffle_read_mb double")
    assert [r["stage_id_str"] for r in R.chart("shuffle_read", df).collect()] == ["3", "1", "2"]


OWN_JOB = """
    from pyspark.sql import SparkSession, functions as F
    spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
        .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", "{folder}")
        .config("spark.sql.shuffle.partitions", "2").appName("own").getOrCreate())
    a = spark.range(20000).withColumn("k", F.col("id") % 7)
    b = spark.range(7).withColumnRenamed("id", "k")
    a.join(b.hint("merge"), "k").groupBy("k").agg(F.sum("id")).collect()
    try:
        spark.range(3).select(F.raise_error(F.lit("boom"))).collect()
    except Exception:
        pass
    spark.stop()
"""


def test_log_written_by_spark(spark, tmp_path):
    folder = tmp_path / "logs" / CLUSTER / "eventlog"
    folder.mkdir(parents=True)
    script = textwrap.dedent(OWN_JOB).format(folder=folder.as_uri())
    subprocess.run([sys.executable, "-c", script], check=True, timeout=180, capture_output=True)
    run(spark, str(tmp_path / "logs"), CLUSTER, str(tmp_path / "lake"))
    lake = Lake(spark, str(tmp_path / "lake"))

    (app,) = lake.read("gold_application_summary").collect()
    assert app["app_id"].startswith("local-") and app["app_name"] == "own"
    assert app["duration_ms"] > 0 and app["spark_user"] and app["failed_jobs"] == 1
    stages = lake.read("gold_stage_performance")
    assert stages.where("status = 'FAILED' AND bottleneck_type = 'STAGE_FAILURE'").count() == 1
    totals = stages.agg(F.sum("executor_run_time_ms"), F.sum("shuffle_read_mb")).first()
    assert totals[0] > 0 and totals[1] > 0
    # Stage metrics agree with the sums over their tasks.
    tasks = lake.read("silver_task_events").where("task_result = 'Success'")
    per_stage = tasks.groupBy("stage_id").agg(F.sum("shuffle_read_bytes").alias("read"))
    both = lake.read("silver_stage_events").where("status = 'COMPLETED'").join(per_stage, "stage_id")
    assert both.count() > 0 and both.where("shuffle_read_bytes != read").count() == 0
    assert lake.read("silver_resource_profiles").count() >= 1
    assert lake.read("gold_executor_analysis").first()["total_cores"] == 2
    sql = lake.read("gold_sql_photon_analysis")
    assert sql.agg(F.sum("smj_count")).first()[0] > 0
    assert lake.read("gold_job_concurrency").where("job_total_tasks > 0").count() > 0
