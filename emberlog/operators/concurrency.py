"""How many other intervals are open when an interval starts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Time units per bucket. With epoch milliseconds: about 70 minutes, so a bucket
# holds at most 4.2 million distinct times and ten years make 75,000 buckets.
BUCKET_WIDTH = 1 << 22
# Intervals of one id that one task takes in order of time.
MOST_IN_WINDOW = 1_000_000
# Commonest ids looked for, and ids that the sketch behind them holds.
MOST_FREQUENT, SKETCH_ITEMS = 1_000, 20_000


def open_counts(
    intervals: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    bucket_width: int = BUCKET_WIDTH,
) -> DataFrame:
    """(keys, at, open): intervals open at each start time, and at each end time.

    An interval is open from its start to its end, both included; a NULL end is
    never reached, and an interval ending before it starts is never open.

    open(t) = started up to t - ended before t, as prefix sums in two levels:
    within fixed-width time buckets, and over bucket totals. Times are counted
    per distinct value first, so the rows of any one window partition are
    bounded by the bucket width and by the number of buckets, however many
    intervals a key has. The default width is right for milliseconds; with a finer
    unit pass a larger one, or a key's buckets meet in one task without a bound.
    """
    keys = list(keys)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    valid = F.col(end).isNull() | (F.col(end) >= F.col(start))
    edges = (
        intervals.where(F.col(start).isNotNull())
        .select(
            *keys,
            F.inline(
                F.array(
                    F.struct(
                        F.col(start).alias("at"),
                        F.when(valid, one).otherwise(zero).alias("opened"),
                        zero.alias("closed"),
                    ),
                    F.struct(
                        F.when(valid, F.col(end)).alias("at"),
                        zero.alias("opened"),
                        one.alias("closed"),
                    ),
                )
            ),
        )
        .withColumn("bucket", F.floor(F.col("at") / F.lit(bucket_width)))
        .where(F.col("at").isNotNull() & F.col("bucket").isNotNull())
    )
    # Read twice below with the same columns and filters, so Spark shuffles it once.
    per_time = edges.groupBy(*keys, "bucket", "at").agg(
        F.sum("opened").alias("opened"), F.sum("closed").alias("closed")
    )

    earlier_buckets = (
        Window.partitionBy(*keys)
        .orderBy("bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        per_time.groupBy(*keys, "bucket")
        .agg(F.sum(F.col("opened") - F.col("closed")).alias("change"))
        .select(
            *keys,
            "bucket",
            F.coalesce(F.sum("change").over(earlier_buckets), zero).alias("carried"),
        )
    )

    in_bucket = Window.partitionBy(*keys, "bucket").orderBy("at")
    up_to_now = in_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before_now = in_bucket.rowsBetween(Window.unboundedPreceding, -1)
    moved = F.sum("opened").over(up_to_now) - F.coalesce(
        F.sum("closed").over(before_now), zero
    )
    return (
        per_time.select(*keys, "bucket", "at", moved.alias("moved"))
        .join(carried, [*keys, "bucket"])
        .select(*keys, "at", (F.col("carried") + F.col("moved")).alias("open"))
    )


def interval_concurrency(
    intervals: DataFrame,
    keys: Sequence[str],
    id_column: str,
    start: str,
    end: str,
    output: str = "concurrent_at_start",
    bucket_width: int = BUCKET_WIDTH,
    unique_ids: bool = False,
) -> DataFrame:
    """Add the number of intervals of the same keys but another id open at start.

    Ids may repeat: intervals sharing an id never count each other. Where they
    cannot, ``unique_ids`` saves the shuffle by id. Rows with a NULL start
    or a NULL key count nothing.
    """
    keys = list(keys)
    everyone = open_counts(intervals, keys, start, end, bucket_width)
    everyone = everyone.select(*keys, F.col("at").alias(start), F.col("open").alias("_open"))

    def opened(rows: DataFrame) -> DataFrame:
        return rows.join(everyone, [*keys, start], "left").select(*rows.columns, "_open")

    valid = F.col(end).isNull() | (F.col(end) >= F.col(start))
    nothing = F.lit(0).cast("long")
    if unique_ids:
        counted = opened(intervals).withColumn("_own", F.when(valid, 1).otherwise(0))
    else:
        counted = own_counts(
            intervals, [*keys, id_column], start, end, bucket_width, before=opened
        )
    others = F.coalesce(F.col("_open") - F.col("_own"), nothing)
    return counted.select(*intervals.columns, others.alias(output))


def own_counts(
    intervals: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    bucket_width: int = BUCKET_WIDTH,
    most_in_window: int | None = None,
    before: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """``intervals`` with ``_own``: those of the same keys, itself included, that are
    open at its start. ``before`` may add columns to the rows: done first, the rows stay
    together by the keys afterwards, and what follows by them needs no shuffle.

    One shuffle by the keys, rows in order of time. Keys with more than
    ``most_in_window`` intervals would be long windows of one task; their rows go through
    :func:`open_counts` instead, whose windows are bounded by the width of a bucket. A
    sketch of fixed size finds the MOST_FREQUENT commonest keys without a shuffle; any
    other key has less than that share of all rows. Both ways give the same counts.
    """
    most_in_window = MOST_IN_WINDOW if most_in_window is None else most_in_window
    keys = list(keys)
    key = F.xxhash64(*keys)
    commonest = F.expr(f"approx_top_k(_key, {MOST_FREQUENT}, {SKETCH_ITEMS})")
    frequent = (
        intervals.select(key.alias("_key"))
        .agg(commonest.alias("_top"))
        .select(F.inline("_top").alias("_key", "_n"))
        .where(F.col("_n") > most_in_window)
        .select("_key", F.lit(True).alias("_frequent"))
    )
    marked = intervals.withColumn("_key", key).join(F.broadcast(frequent), "_key", "left")
    few = before(marked.where("_frequent IS NULL").select(*intervals.columns))
    many = marked.where("_frequent").select(*intervals.columns)
    opened = open_counts(many, keys, start, end, bucket_width)
    opened = opened.select(*keys, F.col("at").alias(start), F.col("open").alias("_open_own"))
    valid = F.col(end).isNull() | (F.col(end) >= F.col(start))
    # A row that ends before it starts is never open, not even for itself.
    many = before(many)
    counted = many.join(opened, [*keys, start], "left")
    own = F.when(F.col(start).isNotNull(), F.col("_open_own"))
    counted = counted.select(*many.columns, own.alias("_own"))
    return _own_in_windows(few, keys, start, end, valid).unionByName(counted)


def _own_in_windows(
    intervals: DataFrame, keys: Sequence[str], start: str, end: str, valid: Column
) -> DataFrame:
    edges = F.array(
        F.struct(F.col(start).alias("_at"), F.lit(True).alias("_starts")),
        F.struct(F.col(end).alias("_at"), F.lit(False).alias("_starts")),
    )
    # Shuffled before they are doubled: the windows take the rows where they are.
    rows = intervals.repartition(*keys).select("*", F.explode(edges).alias("_edge"))
    rows = rows.select("*", "_edge.*")
    ends = ~F.col("_starts") & F.col("_at").isNotNull() & F.col(start).isNotNull() & valid
    in_time = Window.partitionBy(*keys).orderBy("_at")
    opened = F.count_if(F.col("_starts") & F.col("_at").isNotNull() & valid)
    up_to_now = in_time.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before_now = in_time.rangeBetween(Window.unboundedPreceding, -1)
    own = opened.over(up_to_now) - F.count_if(ends).over(before_now)
    return rows.withColumn("_own", own).where("_starts").select(*intervals.columns, "_own")
