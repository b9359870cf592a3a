"""Ordered bottleneck rules: type, severity and recommendation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.metrics import GIB

# --- fixed values: severity and recommendation texts per type ---------------------
SEVERITY = {
    "STAGE_FAILURE": "HIGH",
    "DISK_SPILL": "HIGH",
    "HIGH_GC": "MEDIUM",
    "DATA_SKEW": "MEDIUM",
    "HEAVY_SHUFFLE": "LOW",
    "MEMORY_SPILL": "LOW",
    "MODERATE_GC": "LOW",
    "OK": "NONE",
}
SEVERITY_ORDER = {"HIGH": 1, "MEDIUM": 2}
OTHER_SEVERITY_ORDER = 3
RECOMMENDATIONS = {
    "ja": {
        "STAGE_FAILURE": "failure_reason を確認。OOM の場合は executor memory を増加。",
        "DISK_SPILL": "executor memory を増加。AQE を有効化: spark.sql.adaptive.enabled=true",
        "HIGH_GC": "UDF・collect の見直し。オブジェクト生成を削減。G1GC チューニングを検討。",
        "DATA_SKEW": "AQE スキュー結合を有効化: spark.sql.adaptive.skewJoin.enabled=true または JOIN キーのサルティング。",
        "HEAVY_SHUFFLE": "Broadcast Join を検討 (spark.sql.autoBroadcastJoinThreshold)。shuffle partitions 数を調整。",
        "MEMORY_SPILL": "spark.memory.fraction を増加。repartition() でパーティションサイズを削減。",
        "MODERATE_GC": "GC 傾向を監視。executor memory の増加を検討。",
        "OK": "ボトルネックなし。",
    },
    "en": {
        "STAGE_FAILURE": "Check failure_reason; increase executor memory for OOM.",
        "DISK_SPILL": "Increase executor memory; enable AQE",
        "HIGH_GC": "Review UDFs; reduce object creation; tune G1GC",
        "DATA_SKEW": "Enable AQE skew join; salt join keys",
        "HEAVY_SHUFFLE": "Use broadcast joins; tune shuffle partitions",
        "MEMORY_SPILL": "Increase spark.memory.fraction; repartition",
        "MODERATE_GC": "Monitor GC trends; consider more executor memory",
        "OK": "No action needed",
    },
}


@dataclass(frozen=True)
class Thresholds:
    """Limits above which (strictly) a rule fires."""

    high_gc_pct: float = 20
    moderate_gc_pct: float = 10
    skew_ratio: float = 5
    heavy_shuffle_bytes: int = 10 * GIB


def bottleneck_rules(limits: Thresholds = Thresholds()) -> list[tuple[str, Column]]:
    """(type, condition) in order of precedence."""
    gc, skew = F.col("gc_overhead_pct"), F.col("task_skew_ratio")
    return [
        ("STAGE_FAILURE", F.col("status") == "FAILED"),
        ("DISK_SPILL", F.col("disk_bytes_spilled") > 0),
        ("HIGH_GC", gc > limits.high_gc_pct),
        ("DATA_SKEW", skew > limits.skew_ratio),
        ("HEAVY_SHUFFLE", F.col("shuffle_read_bytes") > limits.heavy_shuffle_bytes),
        ("MEMORY_SPILL", F.col("memory_bytes_spilled") > 0),
        ("MODERATE_GC", gc > limits.moderate_gc_pct),
    ]


def first_match(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """Name of the first rule that is true; a NULL condition is not."""
    (name, condition), *rest = rules
    chain = reduce(
        lambda c, rule: c.when(rule[1], rule[0]), rest, F.when(condition, F.lit(name))
    )
    return chain.otherwise(F.lit(otherwise))


def lookup(key: Column | str, table: dict[str, str]) -> Column:
    """Value of a small fixed table; NULL for an unknown key."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(pairs, F.col(key) if isinstance(key, str) else key)


def severity_order(severity: Column | str = "severity") -> Column:
    """1 for HIGH, 2 for MEDIUM, 3 for everything else."""
    severity = F.col(severity) if isinstance(severity, str) else severity
    order = F.lit(OTHER_SEVERITY_ORDER)
    for level, number in SEVERITY_ORDER.items():
        order = F.when(severity == level, number).otherwise(order)
    return order


def classify(
    df: DataFrame,
    rules: list[tuple[str, Column]] | None = None,
    severity: dict[str, str] | None = None,
    recommendations: dict[str, str] | None = None,
) -> DataFrame:
    """Add bottleneck_type, severity and recommendation."""
    rules = bottleneck_rules() if rules is None else rules
    severity = SEVERITY if severity is None else severity
    recommendations = RECOMMENDATIONS["ja"] if recommendations is None else recommendations
    return df.withColumn("bottleneck_type", first_match(rules, "OK")).withColumns(
        {
            "severity": lookup("bottleneck_type", severity),
            "recommendation": lookup("bottleneck_type", recommendations),
        }
    )
