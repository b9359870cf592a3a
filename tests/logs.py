"""Builders of event-log lines, and the golden scenario of six stages."""

from __future__ import annotations

import json
from pathlib import Path

CLUSTER = "c-test"
APP = "application_1700000000_0001"
T0 = 1_700_000_000_000
MIB, GIB = 1024**2, 1024**3
SQL = "org.apache.spark.sql.execution.ui.SparkListenerSQLExecution"


def app_start(at=T0, name="TestSparkApp", app=APP, user_field="Spark User"):
    return {
        "Event": "SparkListenerApplicationStart",
        "App Name": name,
        "App ID": app,
        "Timestamp": at,
        user_field: "tester",
    }


def app_end(at):
    return {"Event": "SparkListenerApplicationEnd", "Timestamp": at}


def environment(properties):
    return {"Event": "SparkListenerEnvironmentUpdate", "Spark Properties": properties}


def executor_added(executor, at, host, cores=4, profile=0):
    info = {"Host": host, "Total Cores": cores, "Resource Profile Id": profile}
    return {
        "Event": "SparkListenerExecutorAdded",
        "Timestamp": at,
        "Executor ID": str(executor),
        "Executor Info": info,
    }


def executor_removed(executor, at, reason="Job finished"):
    return {
        "Event": "SparkListenerExecutorRemoved",
        "Timestamp": at,
        "Executor ID": str(executor),
        "Removed Reason": reason,
    }


def profile_added(number, memory, off_heap, cpus):
    return {
        "Event": "SparkListenerResourceProfileAdded",
        "Resource Profile Id": number,
        "Executor Resource Requests": {
            "memory": {"Amount": memory},
            "offHeap": {"Amount": off_heap},
        },
        "Task Resource Requests": {"cpus": {"Amount": cpus}},
    }


def job_start(job, at, stages):
    return {
        "Event": "SparkListenerJobStart",
        "Job ID": job,
        "Submission Time": at,
        "Stage IDs": stages,
    }


def job_end(job, at, result="JobSucceeded"):
    return {
        "Event": "SparkListenerJobEnd",
        "Job ID": job,
        "Completion Time": at,
        "Job Result": {"Result": result},
    }


def stage(stage_id, start, end, metrics, tasks=1, reason="", attempt=0, name=None, first=None):
    """``metrics``: short accumulator name -> value, or a ready list of entries."""
    if isinstance(metrics, dict):
        metrics = [
            {"ID": n, "Name": f"internal.metrics.{k}", "Value": v}
            for n, (k, v) in enumerate(metrics.items())
        ]
    info = {
        "Stage ID": stage_id,
        "Stage Attempt ID": attempt,
        "Stage Name": name or f"stage {stage_id}",
        "Number of Tasks": tasks,
        "Submission Time": start,
        "Completion Time": end,
        "Failure Reason": reason,
        "Accumulables": metrics,
    }
    if first is not None:
        info["First Task Launched Time"] = first
    return {"Event": "SparkListenerStageCompleted", "Stage Info": info}


def task(
    task_id, stage_id, start, duration, executor=1, host="h1", gc=0, read=0, disk=0, memory=0,
    result="Success", attempt=0, speculative=False, run=None, cpu=None, metrics=True,
):
    run = duration if run is None else run
    event = {
        "Event": "SparkListenerTaskEnd",
        "Stage ID": stage_id,
        "Stage Attempt ID": attempt,
        "Task Type": "ResultTask",
        "Task End Reason": {"Reason": result},
        "Task Info": {
            "Task ID": task_id,
            "Index": task_id,
            "Launch Time": start,
            "Finish Time": start + duration,
            "Executor ID": str(executor),
            "Host": host,
            "Locality": "NODE_LOCAL",
            "Speculative": speculative,
        },
    }
    if metrics:
        event["Task Metrics"] = {
            "Executor Run Time": run,
            "Executor CPU Time": run * 900_000 if cpu is None else cpu,
            "JVM GC Time": gc,
            "Peak Execution Memory": 64 * MIB,
            "Memory Bytes Spilled": memory,
            "Disk Bytes Spilled": disk,
            "Shuffle Read Metrics": {
                "Remote Bytes Read": read * 3 // 10,
                "Local Bytes Read": read - read * 3 // 10,
            },
            "Input Metrics": {"Bytes Read": 10 * MIB, "Records Read": 100},
        }
    return event


def sql_start(number, at, description="q", plan=None):
    event = {"Event": SQL + "Start", "executionId": number, "description": description, "time": at}
    if plan is not None:
        event["physicalPlanDescription"] = plan
    return event


def sql_end(number, at):
    return {"Event": SQL + "End", "executionId": number, "time": at}


def run_metrics(run, gc, disk=0, memory=0, read=100 * MIB, gc_name="jvmGarbageCollectionTime"):
    """Stage metrics of the golden scenario, values as text as in older logs."""
    values = {
        "executorRunTime": run,
        "executorCpuTime": run * 900_000,
        gc_name: gc,
        "memoryBytesSpilled": memory,
        "diskBytesSpilled": disk,
        "input.bytesRead": GIB,
        "shuffle.read.remoteBytesRead": read * 3 // 10,
        "shuffle.read.localBytesRead": read * 7 // 10,
        "shuffle.read.fetchWaitTime": 100,
        "shuffle.write.bytesWritten": read,
        "peakExecutionMemory": 512 * MIB,
    }
    return {name: str(value) for name, value in values.items()}


# The golden scenario, whose results are known.
# Stage -> job, start offset, duration, task duration, spacing, GC share in percent of the
# tasks and of the stage, extra task and stage values.
GOLDEN = {
    0: (0, 1_200, 2_000, 1_000, 20, 4, 5, {}, {}),
    1: (0, 65_000, 51_000, 1_000, 20, 4, 5, {}, {}),
    2: (
        1, 121_000, 5_500, 3_000, 50, 5, 5,
        {"disk": 200 * MIB, "memory": 50 * MIB}, {"disk": 10 * GIB, "memory": 2 * GIB},
    ),
    3: (1, 280_000, 3_500, 2_000, 30, 28, 28, {}, {}),
    4: (2, 401_000, 6_000, 4_000, 40, 5, 5, {"read": 300 * MIB}, {"read": 15 * GIB}),
    5: (2, 605_000, 5_000, None, 0, 0, 5, {}, {}),
}
GOLDEN_JOBS = {
    0: (1_000, 120_000, "JobSucceeded"),
    1: (120_500, 400_000, "JobSucceeded"),
    2: (400_500, 615_000, "JobFailed"),
}
GOLDEN_SETTINGS = [
    ["spark.sql.adaptive.enabled", "false"],
    ["spark.sql.adaptive.skewJoin.enabled", "false"],
    ["spark.executor.memory", "8g"],
    ["spark.executor.cores", "4"],
    ["spark.sql.shuffle.partitions", "200"],
    ["spark.databricks.delta.autoCompact.enabled", "true"],
    ["spark.app.name", "not kept"],
]


def golden_events():
    tasks_per_stage, events = 50, [app_start(), environment(GOLDEN_SETTINGS)]
    events += [executor_added(n, T0 + 500, f"10.0.0.{n}") for n in (1, 2)]
    events += [
        job_start(j, T0 + begin, [s for s, v in GOLDEN.items() if v[0] == j])
        for j, (begin, _, _) in GOLDEN_JOBS.items()
    ]
    for sid, (_, offset, length, duration, gap, gc, stage_gc, extra, whole) in GOLDEN.items():
        start = T0 + offset
        for i in range(tasks_per_stage if duration else 0):
            executor = 1 if sid == 1 else i % 2 + 1
            took = 50_000 if sid == 1 and i == 0 else duration
            events.append(
                task(
                    sid * tasks_per_stage + i, sid, start + i * gap, took, executor,
                    f"10.0.0.{executor}", gc=took * gc // 100, run=took * 9 // 10,
                    **{"read": 5 * MIB, **extra},
                )
            )
        run = 5_000 if duration is None else tasks_per_stage * duration
        reason = "Job aborted due to stage failure" if sid == 5 else ""
        events.append(
            stage(
                sid, start, start + length, run_metrics(run, run * stage_gc // 100, **whole),
                tasks_per_stage, reason, first=start + 200,
            )
        )
    events += [job_end(j, T0 + end, result) for j, (_, end, result) in GOLDEN_JOBS.items()]
    events += [executor_removed(n, T0 + 620_000) for n in (1, 2)]
    return [*events, app_end(T0 + 620_500)]


def write_log(root, events, app=APP, cluster=CLUSTER, name="run/eventlog"):
    path = Path(root) / cluster / "eventlog" / app / name if app else (
        Path(root) / cluster / "eventlog" / name
    )
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(e if isinstance(e, str) else json.dumps(e) for e in events) + "\n")
    return path


def lines_df(spark, events, app=APP):
    """(value, source_file) straight from events, without files."""
    path = f"file:/logs/{CLUSTER}/eventlog/{app}/run/eventlog"
    rows = [(e if isinstance(e, str) else json.dumps(e), path) for e in events]
    return spark.createDataFrame(rows, "value string, source_file string")


class Tables:
    """Tables over the given events, each built when asked for."""

    def __init__(self, bronze):
        self.bronze = bronze

    def __getitem__(self, name):
        from emberlog.plans.lake import build_tables

        return build_tables(self.bronze, [name])[name]


def tables_of(spark, events, app=APP):
    from emberlog.sources.eventlog import tag_events

    return Tables(tag_events(lines_df(spark, events, app), CLUSTER))
