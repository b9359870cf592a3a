"""Row-quality rules: drop or only count rows that break a SQL predicate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    predicate: str
    drops: bool


# Rule names and predicates per table.
TABLE_RULES: dict[str, tuple[Rule, ...]] = {
    "silver_application_events": (
        Rule("valid_app_id", "app_id IS NOT NULL AND app_id != ''", drops=True),
    ),
    "silver_job_events": (Rule("valid_job_id", "job_id IS NOT NULL", drops=True),),
    "silver_stage_events": (
        Rule("valid_stage_id", "stage_id IS NOT NULL", drops=True),
        Rule("has_tasks", "num_tasks > 0", drops=False),
    ),
    "silver_task_events": (
        Rule("valid_task_id", "task_id IS NOT NULL", drops=True),
        Rule("has_metrics", "executor_run_time_ms IS NOT NULL", drops=False),
    ),
}


def violation_counts(rules: tuple[Rule, ...]) -> list[Column]:
    """Per rule the number of rows that break it, as aggregates."""
    return [
        F.count_if(~F.coalesce(F.expr(rule.predicate), F.lit(False))).alias(rule.name)
        for rule in rules
    ]


def count_violations(
    df: DataFrame, rules: tuple[Rule, ...], observation: Observation
) -> DataFrame:
    """Count rows and broken rules while ``df`` is being written, at no extra pass.

    Apply before :func:`drop_bad_rows`; read ``observation.get`` after the write.
    """
    return df.observe(observation, F.count(F.lit(1)).alias("rows"), *violation_counts(rules))


def drop_bad_rows(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Keep rows for which every dropping rule is true (NULL counts as broken).

    Spark would push the predicates below the parse and repeat it there, as many times
    as they name columns of it. It pushes nothing below an observation.
    """
    dropping = [rule for rule in rules if rule.drops]
    if not dropping:
        return df
    # The rules' names tell apart the observations of tables that meet in one plan.
    name = "_".join(["broken", *[rule.name for rule in dropping]])
    df = df.observe(name, *violation_counts(tuple(dropping)))
    for rule in dropping:
        df = df.where(rule.predicate)
    return df
