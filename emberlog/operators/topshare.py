"""The first of n equal tiles of a table in a given order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.session import reliable_checkpoint

# The sketch of the leading column: a rank is off by one in so many rows at most.
SKETCH_ACCURACY = 10_000


def first_rows(df: DataFrame, order: Sequence[Column], wanted: int) -> DataFrame:
    """The first ``wanted`` rows in order.

    Rows are range-partitioned by the full order, the partitions are counted, whole
    partitions before the cut are kept, and only rows of the partition at the cut are
    numbered. The partition number is only meaningful for one execution, so the
    partitioned rows are checkpointed before they are used twice.
    """
    spread = reliable_checkpoint(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    )
    earlier = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # One row per shuffle partition: small whatever the size of the table.
    parts = (
        spread.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", "_rows", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
        .where(F.col("_before") < wanted)
    )
    kept = spread.join(F.broadcast(parts), "_part")
    whole = F.col("_before") + F.col("_rows") <= wanted
    in_part = Window.partitionBy("_part").orderBy(*order)
    cut = (
        kept.where(~whole)
        .withColumn("_place", F.col("_before") + F.row_number().over(in_part))
        .where(F.col("_place") <= wanted)
    )
    return kept.where(whole).select(*df.columns).unionByName(cut.select(*df.columns))


def top_tile(
    df: DataFrame, order: Sequence[Column], tiles: int, leading: str | None = None
) -> DataFrame:
    """Rows that NTILE(tiles) over ``order`` would put into tile 1.

    Those are the first ceil(N / tiles) rows. An NTILE without partitioning sorts the
    whole table in one task. ``order`` should end in a unique key: it makes the result
    repeatable and lets rows that tie on the leading columns be split.

    ``leading``: the number by which ``order`` begins, descending; it may have no NULL
    and no NaN. One aggregate counts the rows and bounds the value at the cut by a
    sketch. Rows above the bounds are in, those below are out, and only those between
    are put in order, 4 in SKETCH_ACCURACY and those that tie with them. Without it all
    rows are shuffled. Counting starts jobs when the plan is built.
    """
    if leading is None:
        return first_rows(df, order, -(-df.count() // tiles))
    value, margin = F.col(leading), 2 / SKETCH_ACCURACY
    ranks = [min(max(1 - 1 / tiles + m, 0.0), 1.0) for m in (-margin, margin)]
    bounds = F.percentile_approx(value, F.array(*map(F.lit, ranks)), SKETCH_ACCURACY)
    rows, found = df.agg(F.count(F.lit(1)), bounds).first()
    if not rows:
        return df.limit(0)
    wanted, (low, high) = -(-rows // tiles), found
    inside = value.between(low, high)
    above, between = df.agg(F.count_if(value > high), F.count_if(inside)).first()
    if not above <= wanted <= above + between:  # the sketch was off by more than it says
        return first_rows(df, order, wanted)
    return df.where(value > high).unionByName(
        first_rows(df.where(inside), order, wanted - above)
    )


def top_tile_mean(
    df: DataFrame,
    measure: str,
    order: Sequence[Column],
    tiles: int,
    output: str,
    leading: str | None = None,
) -> DataFrame:
    """Mean of ``measure`` over the first tile, as one row."""
    return top_tile(df, order, tiles, leading).agg(F.avg(measure).alias(output))
