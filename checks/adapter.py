"""Event-log lines made from the TPC-H-like tables, for checking only.

Orders act as stages, line items as tasks, customers as jobs, parts as SQL
executions. Everything is integer arithmetic on table columns, so the SQL side
can compute every diagnostic straight from the tables, without any JSON. Even
applications use the newer spelling of the log format, odd ones the older.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLUSTER = "c-0001"
LOG_ROOT = "file:/logs"
DAY_MS = 86_400_000
MIB = 1024**2
APP_ID = "concat('application_1700000000_', lpad(cast(k AS string), 12, '0'))"
# Applications take blocks of so many order keys, five to a block, and number their
# stages and jobs inside it: ids stay 32-bit numbers and there are more applications
# the more orders there are. A job takes the orders of one customer in a block.
ORDERS_PER_BLOCK = 10_000
APPLICATION = f"5 * (o_orderkey DIV {ORDERS_PER_BLOCK}) + o_custkey % 5"
STAGE_ID = f"o_orderkey % {ORDERS_PER_BLOCK}"
# Of a customer's orders in a block the first one names the job.
JOB_ID = f"min(o_orderkey) % {ORDERS_PER_BLOCK}"
# -19 to 19, or NULL.
EXECUTOR = (
    "CASE WHEN l_linenumber = 7 OR (l_suppkey % 20 = 19 AND l_linenumber > 2)"
    " THEN 0 ELSE l_suppkey % 20 END"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_millis(column: str) -> Column:
    """Epoch milliseconds of a day-granular timestamp, whatever the session zone."""
    return F.unix_date(F.to_date(column)).cast("long") * DAY_MS


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        F.expr(APPLICATION).alias("k"),
        F.expr(STAGE_ID).alias("stage_id"),
        day_millis("o_orderdate").alias("submit"),
    )


def _together(rows: DataFrame) -> DataFrame:
    """Rows of an application in one partition, which Spark does not merge with others."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "k")


def _tasks(spark: SparkSession, sf_dir: str, by_application: bool) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "cast(l_quantity AS bigint) AS qty",
        "cast(round(l_extendedprice) AS bigint) AS dur",
        "cast(round(l_discount * 100) AS bigint) AS discount",
        # Whether the stage is tried twice and whether the task is speculative, as one number:
        # lines of tasks and of stages then need the same columns and read one shuffle.
        "if(l_orderkey % 10 = 3 AND l_linenumber % 2 = 0, 1, 0)"
        " + coalesce(if(l_returnflag = 'R' AND l_tax > 0.07, 2, if("
        "(l_returnflag = 'R' AND l_tax > 0.07) IS NULL, 4, 0)), 0) AS marks",
    )
    # Merged, the tasks of an order are together and their wide sums need no shuffle.
    orders = _orders(spark, sf_dir).hint("merge")
    tasks = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return (_together(tasks) if by_application else tasks).selectExpr(
        "*",
        "marks % 2 AS attempt",
        "if(marks > 3, NULL, marks > 1) AS speculative",
        f"{EXECUTOR} AS e",
        "(l_orderkey + l_linenumber) % 50 = 0 AS failed",
        "dur * (500000 + 8000 * qty) AS cpu",
        "dur * discount * 3 DIV 100 AS gc",
        "l_partkey * 500000 AS remote_bytes",
        "qty * 40000000 AS local_bytes",
        f"CASE WHEN qty > 49 THEN {256 * MIB}L ELSE 0L END AS disk_spill",
        f"CASE WHEN qty > 47 THEN {64 * MIB}L ELSE 0L END AS memory_spill",
    )


def _executors(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """(k, e) of the tasks, once each.

    The executors of an order are the bits of one number, the last one for NULL: a row per
    order crosses the join instead of one per line item.
    """
    of_orders = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.expr(f"bit_or(shiftleft(1L, cast(coalesce({EXECUTOR} + 19, 39) AS int)))").alias("b"))
    )
    joined = of_orders.join(
        orders.select("o_orderkey", "k").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    place = F.explode(F.expr("filter(sequence(0, 39), n -> getbit(b, n) = 1)")).alias("n")
    return (
        joined.groupBy("k")
        .agg(F.bit_or("b").alias("b"))
        .select("k", place)
        .selectExpr("k", "if(n = 39, NULL, n - 19L) AS e")
    )


def _line(**fields: str) -> str:
    """SQL for a JSON object; underscores in the names stand for spaces."""
    parts = ", ".join(f"'{n.replace('_', ' ')}', {e}" for n, e in fields.items())
    return f"named_struct({parts})"


def _task_lines(tasks: DataFrame) -> DataFrame:
    info = _line(
        Task_ID="l_orderkey * 100 + l_linenumber",
        Index="l_linenumber",
        Attempt="0",
        Launch_Time="submit",
        Executor_ID="cast(e AS string)",
        Host="concat('h', e)",
        Locality="'NODE_LOCAL'",
        Speculative="speculative",
        Finish_Time="submit + dur",
    )
    metrics = _line(
        Executor_Deserialize_Time="l_linenumber",
        Executor_Run_Time="dur",
        Executor_CPU_Time="cpu",
        Peak_Execution_Memory="l_partkey * 1000",
        Result_Size="1024 + l_linenumber",
        JVM_GC_Time="gc",
        Result_Serialization_Time="qty",
        Memory_Bytes_Spilled="memory_spill",
        Disk_Bytes_Spilled="disk_spill",
        Shuffle_Read_Metrics=_line(
            Remote_Blocks_Fetched="l_linenumber",
            Local_Blocks_Fetched="qty",
            Fetch_Wait_Time="l_suppkey % 100",
            Remote_Bytes_Read="remote_bytes",
            Local_Bytes_Read="local_bytes",
            Total_Records_Read="qty * 100",
        ),
        Shuffle_Write_Metrics=_line(
            Shuffle_Bytes_Written="l_partkey * 1000",
            Shuffle_Write_Time="dur * 1000",
            Shuffle_Records_Written="qty",
        ),
        Input_Metrics=_line(Bytes_Read="dur * 1024", Records_Read="qty * 10"),
        Output_Metrics=_line(Bytes_Written="dur * 10", Records_Written="qty"),
    )
    event = _line(
        Event="'SparkListenerTaskEnd'",
        Stage_ID="stage_id",
        Stage_Attempt_ID="attempt",
        Task_Type="'ResultTask'",
        Task_End_Reason=_line(Reason="if(failed, 'ExceptionFailure', 'Success')"),
        Task_Info=info,
        Task_Metrics=metrics,
    )
    return tasks.selectExpr("k", f"to_json({event}) AS value")


# Accumulator -> sum over the tasks of the stage. `GC` is replaced
# by the spelling of the log's age.
STAGE_SUMS = {
    "executorRunTime": "sum(dur)",
    "executorCpuTime": "sum(cpu)",
    "GC": "sum(gc)",
    "executorDeserializeTime": "sum(l_linenumber)",
    "resultSerializationTime": "sum(qty)",
    "resultSize": "sum(1024 + l_linenumber)",
    "peakExecutionMemory": "sum(l_partkey * 1000)",
    "memoryBytesSpilled": "sum(memory_spill)",
    "diskBytesSpilled": "sum(disk_spill)",
    "input.bytesRead": "sum(dur * 1024)",
    "input.recordsRead": "sum(qty * 10)",
    "output.bytesWritten": "sum(dur * 10)",
    "output.recordsWritten": "sum(qty)",
    "shuffle.read.remoteBytesRead": "sum(remote_bytes)",
    "shuffle.read.localBytesRead": "sum(local_bytes)",
    "shuffle.read.recordsRead": "sum(qty * 100)",
    "shuffle.read.fetchWaitTime": "sum(l_suppkey % 100)",
    "shuffle.read.remoteBlocksFetched": "sum(l_linenumber)",
    "shuffle.read.localBlocksFetched": "sum(qty)",
    "shuffle.write.bytesWritten": "sum(l_partkey * 1000)",
    "shuffle.write.recordsWritten": "sum(qty)",
    "shuffle.write.writeTime": "sum(dur * 1000)",
}


def _stage_lines(tasks: DataFrame) -> DataFrame:
    sums = {f"a{n}": expr for n, expr in enumerate(STAGE_SUMS.values())}
    stages = tasks.groupBy("k", "stage_id", "attempt", "o_orderkey", "o_orderstatus", "submit").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.max("dur").alias("longest"),
        *[F.expr(expr).alias(name) for name, expr in sums.items()],
    )

    def event(gc_name: str, value: Callable[[str], str]) -> str:
        items = [_line(ID="0", Name="'number of output rows'", Value=value("tasks"))]
        for n, name in enumerate(STAGE_SUMS):
            name = gc_name if name == "GC" else name
            items.append(
                _line(ID=str(n + 1), Name=f"'internal.metrics.{name}'", Value=value(f"a{n}"))
            )
        info = _line(
            Stage_ID="stage_id",
            Stage_Attempt_ID="attempt",
            Stage_Name="concat('stage ', o_orderkey)",
            Number_of_Tasks="tasks",
            Submission_Time="submit",
            First_Task_Launched_Time="submit + o_orderkey % 1000",
            Completion_Time="submit + longest + 1000",
            Failure_Reason="if(o_orderstatus = 'F' AND o_orderkey % 10 = 0, 'aborted', '')",
            Accumulables=f"array({', '.join(items)})",
        )
        return _line(Event="'SparkListenerStageCompleted'", Stage_Info=info)

    newer = event("jvmGCTime", lambda column: column)
    older = event("jvmGarbageCollectionTime", lambda column: f"cast({column} AS string)")
    return stages.selectExpr(
        "k", f"if(k % 2 = 0, to_json({newer}), to_json({older})) AS value"
    )


def _job_lines(orders: DataFrame) -> DataFrame:
    jobs = orders.groupBy("k", "o_custkey").agg(
        F.expr(JOB_ID).alias("job_id"),
        F.min("submit").alias("first"),
        F.count(F.lit(1)).alias("n"),
        F.sort_array(F.collect_list("stage_id")).alias("ids"),
    )
    start = _line(
        Event="'SparkListenerJobStart'",
        Job_ID="job_id",
        Submission_Time="first + o_custkey",
        Stage_IDs="ids",
    )
    end = _line(
        Event="'SparkListenerJobEnd'",
        Job_ID="job_id",
        Completion_Time=f"first + o_custkey + n * 7 * {DAY_MS}L",
        Job_Result=_line(Result="if(o_custkey % 11 = 0, 'JobFailed', 'JobSucceeded')"),
    )
    both = f"array(to_json({start}), if(o_custkey % 7 = 0, NULL, to_json({end})))"
    return jobs.selectExpr("k", f"explode({both}) AS value").where("value IS NOT NULL")


# Settings of every application, as SQL; the last two are not kept. The older spelling
# lists the number of cores twice, and the later entry holds.
SETTINGS = {
    "spark.sql.adaptive.enabled": "'false'",
    "spark.sql.adaptive.skewJoin.enabled": "'false'",
    "spark.executor.memory": "concat(4 + k % 7, 'g')",
    "spark.executor.cores": "'4'",
    "spark.sql.shuffle.partitions": "cast(200 + k AS string)",
    "spark.memory.fraction": "'0.6'",
    "spark.app.name": "'tables'",
    "spark.driver.host": "'localhost'",
}


def _application_lines(orders: DataFrame) -> DataFrame:
    apps = orders.groupBy("k").agg(
        (F.min("submit") - 1000).alias("begin"), (F.max("submit") + 40 * DAY_MS).alias("finish")
    )
    started = dict(
        Event="'SparkListenerApplicationStart'",
        App_Name="concat('app ', k)",
        App_ID=APP_ID,
        Timestamp="begin",
    )
    start_old = _line(**started, Spark_User="concat('user', k)")
    start_new = _line(**started, User="concat('user', k)")
    end = _line(Event="'SparkListenerApplicationEnd'", Timestamp="finish")
    pairs = ", ".join(
        ["array('spark.executor.cores', '2')"]
        + [f"array('{key}', {value})" for key, value in SETTINGS.items()]
    )
    entries = ", ".join(f"'{key}', {value}" for key, value in SETTINGS.items())
    env_old = f"named_struct('Event', 'SparkListenerEnvironmentUpdate', 'Spark Properties', array({pairs}))"
    env_new = f"named_struct('Event', 'SparkListenerEnvironmentUpdate', 'Spark Properties', map({entries}))"

    def profile(number: int) -> str:
        event = _line(
            Event="'SparkListenerResourceProfileAdded'",
            Resource_Profile_Id=str(number),
            Executor_Resource_Requests=_line(
                memory=_line(Amount=str(4096 * (number + 1))),
                offHeap=_line(Amount=str(1024 * number)),
            ),
            Task_Resource_Requests=_line(cpus=_line(Amount="1.0D")),
        )
        return f"to_json({event})"

    lines = ", ".join(
        [
            f"if(k % 2 = 0, to_json({start_new}), to_json({start_old}))",
            f"if(k = 4, NULL, to_json({end}))",
            f"if(k % 2 = 0, to_json({env_new}), to_json({env_old}))",
            profile(0),
            profile(1),
        ]
    )
    return apps.selectExpr("k", f"explode(array({lines})) AS value").where("value IS NOT NULL")


def _executor_lines(executors: DataFrame, orders: DataFrame) -> DataFrame:
    begin = orders.groupBy("k").agg((F.min("submit") - 1000).alias("begin"))
    executors = executors.join(begin, "k")
    added = _line(
        Event="'SparkListenerExecutorAdded'",
        Timestamp="begin + 500 + e",
        Executor_ID="cast(e AS string)",
        Executor_Info=_line(
            Host="concat('h', e)", Total_Cores="4 + e % 3", Resource_Profile_Id="e % 2"
        ),
    )
    removed = _line(
        Event="'SparkListenerExecutorRemoved'",
        Timestamp=f"begin + {DAY_MS}L * (e + 1)",
        Executor_ID="cast(e AS string)",
        Removed_Reason="'idle'",
    )
    both = f"array(to_json({added}), if(e % 5 = 0, to_json({removed}), NULL))"
    return executors.selectExpr("k", f"explode({both}) AS value").where("value IS NOT NULL")


PLAN_SQL = """
    concat('(1) Scan parquet\\n(2) ', fast, 'Filter\\n(3) ',
        CASE p_type WHEN 'ECONOMY' THEN concat(fast, 'BroadcastHashJoin')
                    WHEN 'STANDARD' THEN concat(fast, 'BroadcastHashJoin')
                    WHEN 'MEDIUM' THEN 'SortMergeJoin'
                    WHEN 'LARGE' THEN 'ShuffledHashJoin'
                    ELSE 'CartesianProduct' END)
"""
SQL_PREFIX = "org.apache.spark.sql.execution.ui.SparkListenerSQLExecution"


def _sql_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").selectExpr(
        "*", "p_partkey % 5 AS k", "if(p_size % 2 = 0, 'Photon', '') AS fast"
    )
    start = (
        f"named_struct('Event', '{SQL_PREFIX}Start', 'executionId', p_partkey,"
        " 'description', concat('  run \\n  ', p_name, '  '),"
        f" 'physicalPlanDescription', if(p_size = 49, NULL, {PLAN_SQL}),"
        " 'time', 1700000000000 + p_partkey * 1000)"
    )
    end = (
        f"named_struct('Event', '{SQL_PREFIX}End', 'executionId', p_partkey,"
        " 'time', 1700000000000 + p_partkey * 1000 + p_partkey * 7919 % 100003)"
    )
    both = f"array(to_json({start}), if(p_size = 50, NULL, to_json({end})))"
    return parts.selectExpr("k", f"explode({both}) AS value").where("value IS NOT NULL")


def event_lines(spark: SparkSession, sf_dir: str, by_application: bool = False) -> DataFrame:
    """(value, source_file): the whole log of all applications, junk included.

    ``by_application`` gathers what the lines are made of, which is a tenth of them, so that
    a writer of a folder for each application meets few of them in a task.
    """
    orders, tasks = _orders(spark, sf_dir), _tasks(spark, sf_dir, by_application)
    orders = _together(orders) if by_application else orders
    junk = table(spark, sf_dir, "documents").selectExpr("0L AS k", "text AS value")
    lines = (
        _task_lines(tasks)
        .unionByName(_stage_lines(tasks))
        .unionByName(_job_lines(orders))
        .unionByName(_application_lines(orders))
        .unionByName(_executor_lines(_executors(spark, sf_dir, orders), orders))
        .unionByName(_sql_lines(spark, sf_dir))
        .unionByName(junk)
    )
    path = f"concat('{LOG_ROOT}/{CLUSTER}/eventlog/', {APP_ID}, '/events')"
    return lines.selectExpr("value", f"{path} AS source_file")
