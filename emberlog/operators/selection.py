"""Exact quantiles of large groups without sorting or gathering any group."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.session import written_aside

# Bits of a value that one pass decides: a group passes on at most 65,536 counts.
DIGIT_BITS = 16


def rank_of(fraction: float, rows: Column) -> Column:
    """Place, from 1, of the discrete quantile: the least value that a share of at least
    ``fraction`` of the rows do not exceed."""
    return F.greatest(F.ceil(F.lit(float(fraction)) * rows), F.lit(1)).cast("long")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    quantiles: Mapping[str, Sequence[float]],
    groups: DataFrame | None = None,
) -> DataFrame:
    """(keys, measure, fraction, value): discrete quantiles of whole-number columns.

    Radix selection. A pass counts the values of each group by their leading bits; the
    running counts tell in which of these ranges each wanted rank lies, and the next
    pass looks at those ranges only, until a range is one value. Counts merge on the map
    side, so a group of any size costs one row per range and task. The passes number the
    bits of the widest group over DIGIT_BITS: two for milliseconds of a month.

    ``groups`` limits the work to some groups and is broadcast: give it few. NULL values
    are left out; a group without others has no rows here. Group keys may be NULL. Starts
    jobs.
    """
    keys = list(keys)
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("measure"), F.col(name).cast("long").alias("v"))
            for name in quantiles
        ]
    )
    if groups is not None:
        same = [F.col(f"_g_{k}").eqNullSafe(F.col(k)) for k in keys]
        few = F.broadcast(groups.select(*[F.col(k).alias(f"_g_{k}") for k in keys]))
        df = df.join(few, same, "left_semi")
    # One key of the group's columns, so that NULLs join as well.
    values = df.select(F.struct(*keys).alias("g"), F.inline(entries)).where("v IS NOT NULL")
    spans = written_aside(
        values.groupBy("g", "measure").agg(
            F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n")
        ),
        "spans",
    )
    widest = spans.agg(
        F.max(F.col("high").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)"))
    ).first()[0]
    bits = int(widest).bit_length() if widest is not None else 0
    wanted = F.explode(
        F.filter(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("measure"),
                        F.lit(float(fraction)).alias("fraction"),
                        rank_of(fraction, F.col("n")).alias("rank"),
                    )
                    for name, fractions in quantiles.items()
                    for fraction in fractions
                ]
            ),
            lambda w: w["measure"] == F.col("measure"),
        )
    )
    targets = spans.select("g", "measure", "low", wanted.alias("w")).select(
        "g", "measure", "low", F.col("w.fraction").alias("fraction"), F.col("w.rank").alias("rank")
    )
    for step in reversed(range(math.ceil(bits / DIGIT_BITS))):
        targets = written_aside(_narrowed(values, targets, step * DIGIT_BITS), "targets")
    return targets.select(
        *[F.col("g").getField(k).alias(k) for k in keys],
        "measure",
        "fraction",
        F.col("low").alias("value"),
    )


def _narrowed(values: DataFrame, targets: DataFrame, shift: int) -> DataFrame:
    """Targets with the range of 2**shift values that holds their rank; before, they had
    ranges 2**DIGIT_BITS times as wide."""
    ranges = targets.select("g", "measure", "low").distinct()
    # Distances are below 2**63 for all but absurd values, whose difference is NULL.
    place = F.shiftright(F.try_subtract(F.col("v"), F.col("low")), shift)
    counts = (
        values.join(F.broadcast(ranges), ["g", "measure"])
        .withColumn("place", place)
        .where((F.col("v") >= F.col("low")) & (F.col("place") < 1 << DIGIT_BITS))
        .groupBy("g", "measure", "low", "place")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    in_order = Window.partitionBy("g", "measure", "low").orderBy("place")
    running = counts.withColumn("through", F.sum("n").over(in_order))
    found = targets.join(running, ["g", "measure", "low"]).where(
        "rank > through - n AND rank <= through"
    )
    return found.select(
        "g",
        "measure",
        (F.col("low") + F.shiftleft("place", shift)).alias("low"),
        "fraction",
        (F.col("rank") - (F.col("through") - F.col("n"))).alias("rank"),
    )
