"""Shapes of event-log lines, limited to the fields the engine reads.

Fixed values: event names and JSON field names are Spark's own event-log format.
Fields of small events are read as text and cast later with ``try_cast``, so a
malformed value becomes NULL instead of failing the job.
"""

# --- fixed values: event names -------------------------------------------------
APPLICATION_START = "SparkListenerApplicationStart"
APPLICATION_END = "SparkListenerApplicationEnd"
ENVIRONMENT_UPDATE = "SparkListenerEnvironmentUpdate"
JOB_START = "SparkListenerJobStart"
JOB_END = "SparkListenerJobEnd"
STAGE_COMPLETED = "SparkListenerStageCompleted"
TASK_END = "SparkListenerTaskEnd"
EXECUTOR_ADDED = "SparkListenerExecutorAdded"
EXECUTOR_REMOVED = "SparkListenerExecutorRemoved"
RESOURCE_PROFILE_ADDED = "SparkListenerResourceProfileAdded"
SQL_START = "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart"
SQL_END = "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionEnd"

# The events that tables are made of; a Bronze table has a partition for each.
KNOWN_EVENTS = (
    APPLICATION_START,
    APPLICATION_END,
    ENVIRONMENT_UPDATE,
    JOB_START,
    JOB_END,
    STAGE_COMPLETED,
    TASK_END,
    EXECUTOR_ADDED,
    EXECUTOR_REMOVED,
    RESOURCE_PROFILE_ADDED,
    SQL_START,
    SQL_END,
)
OTHER_EVENT = "other"
# Number of a rolled log file.
ROLLED_FILE_PATTERN = r"/events_(\d+)_[^/]*$"

# --- fixed values: JSON shapes --------------------------------------------------
# Both spellings of the user are read: older logs say `Spark User`, newer `User`.
APPLICATION_EVENT = """
    `App Name` STRING, `App ID` STRING, `Timestamp` STRING,
    `Spark User` STRING, `User` STRING
"""

JOB_EVENT = """
    `Job ID` STRING, `Submission Time` STRING, `Completion Time` STRING,
    `Stage IDs` STRING, `Job Result` STRUCT<`Result`: STRING>
"""

STAGE_EVENT = """
    `Stage Info` STRUCT<
        `Stage ID`: INT, `Stage Attempt ID`: INT, `Stage Name`: STRING,
        `Number of Tasks`: INT, `Submission Time`: BIGINT,
        `First Task Launched Time`: BIGINT, `Completion Time`: BIGINT,
        `Failure Reason`: STRING,
        `Accumulables`: ARRAY<STRUCT<`Name`: STRING, `Value`: STRING>>>
"""

TASK_EVENT = """
    `Stage ID` INT, `Stage Attempt ID` INT, `Task Type` STRING,
    `Task End Reason` STRUCT<`Reason`: STRING>,
    `Task Info` STRUCT<
        `Task ID`: BIGINT, `Index`: INT, `Launch Time`: BIGINT, `Finish Time`: BIGINT,
        `Executor ID`: STRING, `Host`: STRING, `Locality`: STRING, `Speculative`: BOOLEAN>,
    `Task Metrics` STRUCT<
        `Executor Run Time`: BIGINT, `Executor CPU Time`: BIGINT,
        `Executor Deserialize Time`: BIGINT, `Result Serialization Time`: BIGINT,
        `JVM GC Time`: BIGINT, `Result Size`: BIGINT, `Peak Execution Memory`: BIGINT,
        `Memory Bytes Spilled`: BIGINT, `Disk Bytes Spilled`: BIGINT,
        `Shuffle Read Metrics`: STRUCT<
            `Remote Blocks Fetched`: BIGINT, `Local Blocks Fetched`: BIGINT,
            `Fetch Wait Time`: BIGINT, `Remote Bytes Read`: BIGINT,
            `Local Bytes Read`: BIGINT, `Total Records Read`: BIGINT>,
        `Shuffle Write Metrics`: STRUCT<
            `Shuffle Bytes Written`: BIGINT, `Shuffle Write Time`: BIGINT,
            `Shuffle Records Written`: BIGINT>,
        `Input Metrics`: STRUCT<`Bytes Read`: BIGINT, `Records Read`: BIGINT>,
        `Output Metrics`: STRUCT<`Bytes Written`: BIGINT, `Records Written`: BIGINT>>
"""

EXECUTOR_EVENT = """
    `Executor ID` STRING, `Timestamp` STRING, `Removed Reason` STRING,
    `Executor Info` STRUCT<
        `Host`: STRING, `Total Cores`: STRING, `Resource Profile Id`: STRING>
"""

RESOURCE_PROFILE_EVENT = """
    `Resource Profile Id` STRING,
    `Executor Resource Requests` STRUCT<
        `memory`: STRUCT<`Amount`: STRING>, `offHeap`: STRUCT<`Amount`: STRING>>,
    `Task Resource Requests` STRUCT<`cpus`: STRUCT<`Amount`: STRING>>
"""

# The properties come as an array of pairs or as an object; kept as text here.
ENVIRONMENT_EVENT = "`Spark Properties` STRING"

SQL_START_EVENT = """
    `executionId` STRING, `description` STRING,
    `physicalPlanDescription` STRING, `time` STRING
"""

SQL_END_EVENT = "`executionId` STRING, `time` STRING"

# --- fixed values: accumulator names of stage metrics ---------------------------
# Output column -> accumulator names, first hit wins. GC has two spellings.
STAGE_METRICS = {
    "executor_run_time_ms": ("internal.metrics.executorRunTime",),
    "executor_cpu_time_ns": ("internal.metrics.executorCpuTime",),
    "jvm_gc_time_ms": (
        "internal.metrics.jvmGarbageCollectionTime",
        "internal.metrics.jvmGCTime",
    ),
    "deserialize_ms": ("internal.metrics.executorDeserializeTime",),
    "result_serialize_ms": ("internal.metrics.resultSerializationTime",),
    "result_size_bytes": ("internal.metrics.resultSize",),
    "peak_exec_memory_bytes": ("internal.metrics.peakExecutionMemory",),
    "memory_bytes_spilled": ("internal.metrics.memoryBytesSpilled",),
    "disk_bytes_spilled": ("internal.metrics.diskBytesSpilled",),
    "input_bytes": ("internal.metrics.input.bytesRead",),
    "input_records": ("internal.metrics.input.recordsRead",),
    "output_bytes": ("internal.metrics.output.bytesWritten",),
    "output_records": ("internal.metrics.output.recordsWritten",),
    "shuffle_remote_bytes": ("internal.metrics.shuffle.read.remoteBytesRead",),
    "shuffle_local_bytes": ("internal.metrics.shuffle.read.localBytesRead",),
    "shuffle_read_records": ("internal.metrics.shuffle.read.recordsRead",),
    "shuffle_fetch_wait_ms": ("internal.metrics.shuffle.read.fetchWaitTime",),
    "shuffle_remote_blocks": ("internal.metrics.shuffle.read.remoteBlocksFetched",),
    "shuffle_local_blocks": ("internal.metrics.shuffle.read.localBlocksFetched",),
    "shuffle_write_bytes": ("internal.metrics.shuffle.write.bytesWritten",),
    "shuffle_write_records": ("internal.metrics.shuffle.write.recordsWritten",),
    "shuffle_write_time_ns": ("internal.metrics.shuffle.write.writeTime",),
}
ACCUMULATOR_PREFIX = "internal.metrics."

# --- fixed values: which Spark properties matter for performance ----------------
CONFIG_KEEP_PATTERN = (
    r"^spark\.(sql\.adaptive|executor|memory|cores|shuffle"
    r"|sql\.shuffle|sql\.broadcast|databricks\.|sql\.files)"
)
