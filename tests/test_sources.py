"""File layouts, unfinished and compressed logs, lines that are not events."""

import json

import pytest
import zstandard
from pyspark.sql import functions as F

from emberlog.plans.lake import BRONZE, Lake, build_tables, run, write_bronze
from emberlog.sources.eventlog import app_id_from_path, fill_app_ids, read_lines, tag_events
from tests.logs import (
    APP, CLUSTER, T0, app_end, app_start, job_end, job_start, lines_df, write_log,
)


@pytest.mark.parametrize(
    ("path", "expected"),
    [
        ("file:/r/c/eventlog/application_1_2/77/eventlog", "application_1_2"),
        ("file:/r/c/eventlog/my-app/77/eventlog.inprogress", "my-app"),
        ("file:/r/c/eventlog/application_17_0003", "application_17_0003"),
        ("file:/r/c/eventlog/application_17_0003.inprogress", "application_17_0003"),
        ("file:/r/c/eventlog/eventlog_v2_local-5/events_1_local-5.zstd", "local-5"),
        ("file:/r/c/eventlog/local-5", None),
        ("file:/r/c/eventlog/eventlog", None),
    ],
)
def test_app_id_from_path(spark, path, expected):
    row = spark.range(1).select(app_id_from_path(F.lit(path)).alias("a")).first()
    assert row["a"] == expected


def test_all_layouts_are_read(spark, tmp_path):
    write_log(tmp_path, [app_start(app="application_1_1"), job_start(1, 5, [])], "application_1_1")
    write_log(tmp_path, [app_start(app="a2")], "a2", name="run/eventlog.inprogress")
    write_log(tmp_path, [app_start(app="application_3_3"), app_end(9)], None, name="application_3_3")
    write_log(tmp_path, [app_start(app="local-4"), job_start(4, 5, [1])], None, name="local-4")
    rolled = write_log(tmp_path, [], "eventlog_v2_local-5", name="appstatus_local-5")
    text = json.dumps(app_start(app="local-5")) + "\n" + json.dumps(job_start(5, 5, [2])) + "\n"
    compressed = zstandard.ZstdCompressor().compress(text.encode())
    (rolled.parent / "events_1_local-5.zstd").write_bytes(compressed)

    lake = Lake(spark, str(tmp_path / "lake"))
    write_bronze(lake, read_lines(spark, f"{tmp_path}/", CLUSTER), CLUSTER)
    found = lake.read(BRONZE).groupBy("app_id").count().collect()
    assert {r["app_id"]: r["count"] for r in found} == {
        "application_1_1": 2, "a2": 1, "application_3_3": 2, "local-4": 2, "local-5": 2,
    }
    assert {r[0] for r in lake.read(BRONZE).select("cluster_id").distinct().collect()} == {CLUSTER}
    assert lake.read(BRONZE).where("ingested_at IS NULL").count() == 0


def test_no_join_when_paths_carry_ids(spark, tmp_path):
    tagged = tag_events(lines_df(spark, [app_start()]), CLUSTER)
    assert fill_app_ids(tagged, count_files=True) is tagged


LAYOUTS = [
    (APP, "run/eventlog", APP),
    (None, "application_3_3", "application_3_3"),
    (None, "local-4", "local-4"),
    ("eventlog_v2_local-5", "events_1_local-5", "local-5"),
]


@pytest.mark.parametrize(("folder", "name", "app"), LAYOUTS)
def test_every_entry_point_knows_the_application(spark, tmp_path, folder, name, app):
    events = [app_start(app=app), job_start(1, T0, [1]), job_end(1, T0 + 5), app_end(T0 + 9)]
    write_log(tmp_path, events, folder, name=name)
    lines = read_lines(spark, str(tmp_path), CLUSTER)
    table = "silver_application_events"

    def found(df):
        return sorted((r["app_id"], r["timestamp_ms"]) for r in df.collect())

    expected = [(app, T0), (app, T0 + 9)]
    assert found(build_tables(tag_events(lines, CLUSTER), [table])[table]) == expected
    run(spark, str(tmp_path), CLUSTER, str(tmp_path / "lake"))
    lake = Lake(spark, str(tmp_path / "lake"))
    assert found(lake.read(table)) == expected
    lake.register_views("v_")
    assert found(spark.table(f"v_{table}")) == expected
    database = f"db_{abs(hash((folder, name)))}"
    lake.register_tables(database)
    ids = spark.sql(f"SELECT DISTINCT app_id FROM {database}.{BRONZE}").collect()
    assert [r["app_id"] for r in ids] == [app]
    spark.sql(f"DROP DATABASE {database} CASCADE")


def test_no_join_is_run_for_lines_with_ids(spark, tmp_path):
    write_log(tmp_path, [app_start(), job_start(1, 5, [])])
    filled = fill_app_ids(tag_events(read_lines(spark, str(tmp_path), CLUSTER), CLUSTER))
    assert filled.count() == 2 and {r["app_id"] for r in filled.collect()} == {APP}


def test_odd_event_names_share_a_folder(spark, tmp_path):
    odd = ["x" * 300, "a/b", "..", "other", ""]
    lines = lines_df(spark, [app_start(), *[{"Event": name} for name in odd]])
    lake = Lake(spark, str(tmp_path))
    write_bronze(lake, lines, CLUSTER)
    rows = lake.read(BRONZE).collect()
    assert sorted(r["event_type"] for r in rows if r["event_kind"] == "other") == sorted(odd)
    assert len(rows) == 6
    folders = sorted(p.name for p in (tmp_path / BRONZE).iterdir() if "=" in p.name)
    assert folders == ["event_kind=SparkListenerApplicationStart", "event_kind=other"]


def test_bronze_has_few_files_for_many_splits(spark, tmp_path):
    events = [app_start()] + [job_start(n, 5, []) for n in range(400)] + [app_end(9)]
    lake = Lake(spark, str(tmp_path))
    write_bronze(lake, lines_df(spark, events).repartition(40), CLUSTER)
    files = [p for p in (tmp_path / BRONZE).rglob("part-*") if p.suffix == ".parquet"]
    assert len(files) <= 6


def test_stated_ids_are_joined_without_broadcast_beyond_the_bound(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("emberlog.sources.eventlog.BROADCAST_MAX_FILES", 0)
    rows = [(json.dumps(e), f"file:/r/c/eventlog/{a}") for a in ("local-1", "local-2")
            for e in (app_start(app=a), job_start(1, 2, []))]
    lake = Lake(spark, str(tmp_path))
    write_bronze(lake, spark.createDataFrame(rows, "value string, source_file string"), CLUSTER)
    ids = lake.read(BRONZE).groupBy("app_id").count().collect()
    assert {r["app_id"]: r["count"] for r in ids} == {"local-1": 2, "local-2": 2}


def test_junk_is_dropped_and_changes_nothing(spark):
    events = [app_start(), job_start(1, 5, [1, 2])]
    whole = json.dumps(job_start(2, 6, [3]))
    junk = ["", "   ", "not json", "{", whole[:-7], '{"NoEvent": 1}', "[1, 2]", "null"]
    clean = tag_events(lines_df(spark, events), CLUSTER).drop("ingested_at")
    mixed = tag_events(lines_df(spark, [*junk, *events, *junk]), CLUSTER).drop("ingested_at")
    assert sorted(clean.collect()) == sorted(mixed.collect())
