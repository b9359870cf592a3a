"""Operators named in the text of a physical plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.metrics import as_column

# --- fixed values ----------------------------------------------------------------
OPERATOR_PATTERN = r"\((\d+)\)\s+(\w+)"  # "(12) SortMergeJoin": group 2 is the name
ACCELERATED_PREFIX = "Photon"
BROADCAST_HASH_JOIN = "BroadcastHashJoin"
ACCELERATED_BROADCAST_HASH_JOIN = "PhotonBroadcastHashJoin"
SORT_MERGE_JOIN = "SortMergeJoin"
OTHER_JOINS = ("ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct")


def plan_operators(plan: Column | str) -> Column:
    """Names in order of appearance, repeats included; NULL for a NULL plan."""
    return F.regexp_extract_all(as_column(plan), F.lit(OPERATOR_PATTERN), F.lit(2))


def count_accelerated(operators: Column, prefix: str = ACCELERATED_PREFIX) -> Column:
    return F.array_size(F.filter(operators, lambda name: name.startswith(prefix)))


def count_named(operators: Column, *names: str) -> Column:
    return F.array_size(F.filter(operators, lambda name: name.isin(*names)))


def plain_operator_list(operators: Column, prefix: str = ACCELERATED_PREFIX) -> Column:
    """Distinct operators without the prefix, first seen first, joined by ", "."""
    plain = F.filter(operators, lambda name: ~name.startswith(prefix))
    return F.array_join(F.array_distinct(plain), ", ")


def squeeze_spaces(text: Column | str) -> Column:
    return F.regexp_replace(F.trim(as_column(text)), r"\s+", " ")
