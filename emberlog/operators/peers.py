"""Load of each entity compared with the other entities of its group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.metrics import guarded_ratio
from emberlog.session import written_aside

# Load at which an entity counts as a straggler or as underutilized.
STRAGGLER_LOAD = 1.5
UNDERUTILIZED_LOAD = 0.5


def peer_load(
    entities: DataFrame,
    group_keys: Sequence[str],
    measure: str,
    mean_name: str = "group_mean",
    straggler_load: float = STRAGGLER_LOAD,
    underutilized_load: float = UNDERUTILIZED_LOAD,
    write_norms: bool = True,
) -> DataFrame:
    """Add the group mean, relative load, z-score and the two flags.

    ``entities`` has one row per entity. The group statistics are an aggregate
    joined back rather than a window: the aggregate merges on the map side, while a
    window would bring a group into one task. Reading ``entities`` twice is cheap
    when it is a written table (the lake writes ``work_executor_load``).

    Spark splits a skewed join only where both sides are bare shuffles, and an
    aggregate on top of its own shuffle is not. So the statistics, one row per group,
    are written first, and a group that holds most entities is split over tasks.
    ``write_norms=False`` leaves that out and starts no job.
    """
    norms = entities.groupBy(*group_keys).agg(
        F.avg(measure).alias(mean_name), F.stddev_samp(measure).alias("_spread")
    )
    if write_norms:
        norms = written_aside(norms, "peer-norms")
    load = F.round(guarded_ratio(measure, mean_name), 2)
    z_score = F.round(guarded_ratio(F.col(measure) - F.col(mean_name), "_spread"), 2)
    return (
        entities.join(norms, list(group_keys), "left")
        .withColumns({"load_vs_avg": load, "z_score": z_score})
        .withColumns(
            {
                "is_straggler": F.col("load_vs_avg") > straggler_load,
                "is_underutilized": F.col("load_vs_avg") < underutilized_load,
            }
        )
        .drop("_spread")
    )
