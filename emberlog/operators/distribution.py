"""Value distribution per group from mergeable sketches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.selection import exact_quantiles, rank_of
from emberlog.session import shuffles_dropped, written_aside


@dataclass(frozen=True)
class Spread:
    """What to measure of one column.

    ``quantiles`` maps output names to fractions; ``low``, ``high`` and ``mean``
    name the optional minimum, maximum and mean columns.
    """

    column: str
    quantiles: Mapping[str, float]
    low: str | None = None
    high: str | None = None
    mean: str | None = None


# percentile_approx is exact for groups of up to so many rows.
SKETCH_ROWS = 10_000


def distribution_profile(
    df: DataFrame,
    keys: Sequence[str],
    spreads: Sequence[Spread],
    extra: Sequence[Column] = (),
    exact: bool = False,
) -> DataFrame:
    """One row per group with the spread of each column and ``extra`` aggregates.

    All fractions of a column share one ``percentile_approx`` sketch. Every
    aggregate merges, so a group holding most of the rows is reduced on the map
    side and never gathered in one task. Quantiles are actual values of the
    column, exact for groups of up to 10,000 rows.

    ``exact`` makes them exact for larger groups too, of whole-number columns: groups are
    counted first, and rows of those that are too large for a sketch, at most one group
    for 10,000 rows, are read again (:func:`exact_quantiles`). All others have few values,
    which are put in order as they are: that takes less time and less of a shuffle than
    sketches. It starts jobs.
    """
    if not exact:
        return _profile(df, keys, spreads, extra, ordered=False)
    rows = F.count(F.lit(1)).alias("_rows")
    counted = df.groupBy(*keys).agg(rows).where(F.col("_rows") > SKETCH_ROWS)
    with shuffles_dropped(df.sparkSession):
        large = written_aside(counted.select(*keys), "large")
    if large.isEmpty():
        return _profile(df, keys, spreads, extra, ordered=True)
    same = [F.col(f"_g_{k}").eqNullSafe(F.col(k)) for k in keys]
    groups = F.broadcast(large.select(*[F.col(k).alias(f"_g_{k}") for k in keys]))
    few = _profile(df.join(groups, same, "left_anti"), keys, spreads, extra, ordered=True)
    many = df.join(groups, same, "left_semi")
    profile = _profile(many, keys, spreads, extra, ordered=False)
    return few.unionByName(_with_exact(many, keys, spreads, profile, large))


def _profile(
    df: DataFrame,
    keys: Sequence[str],
    spreads: Sequence[Spread],
    extra: Sequence[Column],
    ordered: bool,
) -> DataFrame:
    """:func:`distribution_profile` by sketches, or with all values of a group in order."""
    aggregates, outputs = [], [F.col(k) for k in keys]
    for number, spread in enumerate(spreads):
        value = F.col(spread.column)
        sketch = f"_sketch{number}"
        values = F.col(sketch)
        if ordered:
            aggregates.append(F.sort_array(F.collect_list(value)).alias(sketch))
        else:
            fractions = F.array(*[F.lit(float(f)) for f in spread.quantiles.values()])
            aggregates.append(F.percentile_approx(value, fractions).alias(sketch))
        for place, (name, fraction) in enumerate(spread.quantiles.items()):
            rank = rank_of(fraction, F.size(values)).cast("int")
            at = rank - 1 if ordered else F.lit(place)
            outputs.append(F.get(values, at).alias(name))
        for name, aggregate, at in (
            (spread.low, F.min, F.lit(0)),
            (spread.high, F.max, F.size(values) - 1),
            (spread.mean, F.avg, None),
        ):
            if name and ordered and at is not None:
                outputs.append(F.get(values, at).alias(name))
            elif name:
                aggregates.append(aggregate(value).alias(name))
                outputs.append(F.col(name))
    grouped = df.groupBy(*keys).agg(*aggregates, *extra)
    measured = {*keys, *(f"_sketch{n}" for n in range(len(spreads)))}
    named = {name for s in spreads for name in (s.low, s.high, s.mean) if name}
    outputs += [F.col(c) for c in grouped.columns if c not in measured | named]
    return grouped.select(*outputs)


def _with_exact(
    df: DataFrame,
    keys: Sequence[str],
    spreads: Sequence[Spread],
    profile: DataFrame,
    large: DataFrame,
) -> DataFrame:
    """``profile`` with exact quantiles of its ``large`` groups."""
    wanted = {s.column: sorted({*map(float, s.quantiles.values())}) for s in spreads}
    found = exact_quantiles(df, keys, wanted, large)
    picked = [
        F.max(
            F.when((F.col("measure") == s.column) & (F.col("fraction") == float(f)), F.col("value"))
        ).alias(f"_exact_{name}")
        for s in spreads
        for name, f in s.quantiles.items()
    ]
    values = found.groupBy(*[F.col(k).alias(f"_g_{k}") for k in keys]).agg(*picked)
    same = [F.col(f"_g_{k}").eqNullSafe(F.col(k)) for k in keys]
    names = {name for s in spreads for name in s.quantiles}
    types = dict(profile.dtypes)
    return profile.join(F.broadcast(values), same, "left").select(
        *[
            F.coalesce(F.col(f"_exact_{c}").cast(types[c]), F.col(c)).alias(c)
            if c in names
            else F.col(c)
            for c in profile.columns
        ]
    )
