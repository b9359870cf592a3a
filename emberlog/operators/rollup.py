"""Small roll-ups for counters and chart series."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGGREGATES = {"SUM": F.sum, "AVG": F.avg, "MAX": F.max, "COUNT": F.count}


def counters(df: DataFrame, measures: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``measures``: output -> (aggregate, column), all in one pass, one row.

    COUNT counts rows, whatever the column holds; in a chart it counts values.
    """
    return df.agg(
        *[
            (F.count(F.lit(1)) if how == "COUNT" else AGGREGATES[how](column)).alias(name)
            for name, (how, column) in measures.items()
        ]
    )


def chart_series(df: DataFrame, x: str, color: str, y: str, how: str) -> DataFrame:
    """(x, color, value): one aggregate of ``y`` per bar segment."""
    return df.groupBy(x, color).agg(AGGREGATES[how](y).alias("value"))
