"""Ids listed as JSON text, one row per id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_id_list(
    df: DataFrame, keep: Sequence[str], list_column: str, id_column: str, id_type: str = "int"
) -> DataFrame:
    """(keep, id): empty, NULL or malformed lists give no rows."""
    ids = F.from_json(F.col(list_column), f"array<{id_type}>")
    return df.select(*keep, F.explode(ids).alias(id_column))
