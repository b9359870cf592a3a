"""Keep one row per key, chosen by a declared order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by_key(
    df: DataFrame, keys: Sequence[str], newness: Sequence[Column | str]
) -> DataFrame:
    """The row of each key that is greatest by the columns of ``newness``, in order of
    weight; NULL is least. Rows equal in all of them are told apart arbitrarily.

    An aggregate, so that each task passes on one row per key: a frequent key neither
    gathers in one task nor has its rows sorted there.
    """
    rest = [c for c in df.columns if c not in keys]
    latest = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*newness))
    return df.groupBy(*keys).agg(latest.alias("_latest")).select(
        *[
            F.col(f"`{c}`") if c in keys else F.col("_latest").getField(c).alias(c)
            for c in df.columns
        ]
    )
