"""Event-log lines as a DataFrame: read, tag, drop what is not an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog import schemas as S

# --- fixed values: where an application id shows in a path -----------------------
LOG_FOLDER = "eventlog"
APP_FOLDER_PATTERN = r"/eventlog/([^/]+)/"
YARN_APP_PATTERN = r"(application_\d+_\d+)"
ROLLING_FOLDER_PREFIX = r"^eventlog_v2_"

BRONZE_COLUMNS = (
    "value", "source_file", "app_id", "event_type", "cluster_id", "ingested_at", "event_kind",
)

# The fallback id map is broadcast up to this many files (about 300 bytes each).
BROADCAST_MAX_FILES = 200_000


def log_path(log_root: str, cluster_id: str) -> str:
    return f"{log_root.rstrip('/')}/{cluster_id}/{LOG_FOLDER}/"


def read_lines(spark: SparkSession, log_root: str, cluster_id: str) -> DataFrame:
    """(value, source_file) of every log file of a cluster, unfinished ones too."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(log_path(log_root, cluster_id))
        .select("value", F.col("_metadata.file_path").alias("source_file"))
    )


def app_id_from_path(path: Column | str) -> Column:
    """App id by folder below the log folder, else by YARN-style file name."""
    path = F.col(path) if isinstance(path, str) else path

    def first_group(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))

    by_folder = F.regexp_replace(first_group(APP_FOLDER_PATTERN), ROLLING_FOLDER_PREFIX, "")
    return F.coalesce(by_folder, first_group(YARN_APP_PATTERN))


def tag_events(lines: DataFrame, cluster_id: str) -> DataFrame:
    """Bronze rows from (value, source_file). Stateless: works on streams as well.

    ``event_kind`` is the event's name if tables are made of it, else ``other``: free
    text of a log names no folder, and there are as many folders as known events.

    Lines that are no event have an empty list to explode. Spark would push a filter below
    what makes the lines, and make and parse each of them twice.
    """
    events = F.array_compact(F.array(F.get_json_object("value", "$.Event")))
    event = F.col("event_type")
    return lines.select("value", "source_file", F.explode(events).alias("event_type")).select(
        "value",
        "source_file",
        app_id_from_path("source_file").alias("app_id"),
        "event_type",
        F.lit(cluster_id).alias("cluster_id"),
        F.current_timestamp().alias("ingested_at"),
        F.when(event.isin(*S.KNOWN_EVENTS), event)
        .otherwise(F.lit(S.OTHER_EVENT))
        .alias("event_kind"),
    )


def stated_ids(tagged: DataFrame) -> DataFrame:
    """(source_file, stated_id) of the files whose path has no id but whose own
    application start does."""
    return (
        tagged.where(F.col("app_id").isNull() & (F.col("event_kind") == S.APPLICATION_START))
        .select("source_file", F.get_json_object("value", "$['App ID']").alias("stated_id"))
        .where(F.col("stated_id").isNotNull())
        .groupBy("source_file")
        .agg(F.min("stated_id").alias("stated_id"))
    )


def _joined(tagged: DataFrame, stated: DataFrame) -> DataFrame:
    return tagged.join(stated, "source_file", "left").select(
        *[
            F.coalesce("app_id", "stated_id").alias("app_id") if c == "app_id" else F.col(c)
            for c in tagged.columns
        ]
    )


def fill_app_ids(
    tagged: DataFrame, count_files: bool = False, stated: DataFrame | None = None
) -> DataFrame:
    """Give lines of files without an id in their path the id the file itself states.

    Lazy by default: only rows without an id meet the join, and Spark lists no file for
    them when every path carries one. With ``count_files``, for a table that is about to
    be written, the files are counted first: no join is added if there are none, and a
    broadcast up to a bound. ``stated``: the :func:`stated_ids` as already written; they
    are counted as well.
    """
    count_files = count_files or stated is not None
    stated = stated_ids(tagged) if stated is None else stated
    if count_files:
        files = stated.count()
        if files == 0:
            return tagged
        if files <= BROADCAST_MAX_FILES:
            return _joined(tagged, F.broadcast(stated))
    known = tagged.where(F.col("app_id").isNotNull())
    return known.unionByName(_joined(tagged.where(F.col("app_id").isNull()), stated))
