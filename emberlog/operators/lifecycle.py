"""One row per entity from rows of start- and end-like events."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lifecycle_pivot(
    events: DataFrame,
    keys: Sequence[str],
    event_column: str,
    outputs: Mapping[str, tuple[Callable[[Column], Column], str, str]],
) -> DataFrame:
    """``outputs``: column -> (aggregate such as F.min, event value, value column)."""
    return events.groupBy(*keys).agg(
        *[
            aggregate(F.when(F.col(event_column) == event, F.col(value))).alias(name)
            for name, (aggregate, event, value) in outputs.items()
        ]
    )
