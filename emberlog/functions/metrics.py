"""Column helpers shared by the tables: lookups, guarded ratios, units, counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB = 1024
MIB = 1024**2
GIB = 1024**3


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_long(text: Column | str) -> Column:
    return as_column(text).try_cast("long")


def to_int(text: Column | str) -> Column:
    return as_column(text).try_cast("int")


def to_double(text: Column | str) -> Column:
    return as_column(text).try_cast("double")


# The first and last millisecond of the years 1 to 9999.
FIRST_MILLIS, LAST_MILLIS = -62_135_596_800_000, 253_402_300_799_999


def millis_to_ts(ms: Column | str) -> Column:
    """NULL outside the years 1 to 9999: no number in a log may fail a run."""
    ms = as_column(ms)
    return F.when(ms.between(FIRST_MILLIS, LAST_MILLIS), F.timestamp_millis(ms))


def difference(a: Column | str, b: Column | str) -> Column:
    """a - b, NULL if it has no room in the type."""
    return F.try_subtract(as_column(a), as_column(b))


def first_found(metrics: Column, names: Sequence[Column | str]) -> Column:
    """First number of some of these names in a map of name -> value as text.

    0 when none of the names occurs; NULL when they occur without a number.
    """
    names = [F.lit(name) for name in names]
    values = [to_long(F.try_element_at(metrics, name)) for name in names]
    known = [F.coalesce(F.map_contains_key(metrics, name), F.lit(False)) for name in names]
    occurs = reduce(lambda a, b: a | b, known)
    return F.coalesce(*values, F.when(~occurs, F.lit(0).cast("long")))


def all_found(metrics: Column, wanted: Sequence[Sequence[str]]) -> Column:
    """:func:`first_found` of each list of names, as an array in their order."""
    return F.array(*numbers_found(F.map_keys(metrics), F.map_values(metrics), wanted))


def numbers_found(
    names: Column, texts: Column, wanted: Sequence[Sequence[str]]
) -> list[Column]:
    """:func:`first_found` of each list of names, in two arrays of names and of values as
    text; of repeated names the first counts.

    The texts become numbers in one lambda, which all lookups share. Cast one by one, the
    lookups make one generated method too large for the JVM to compile.
    """
    numbers = F.transform(texts, to_long)

    def found(some: Sequence[str]) -> Column:
        places = [F.coalesce(F.array_position(names, name), F.lit(0)) for name in some]
        values = [F.get(numbers, (place - 1).cast("int")) for place in places]
        known = reduce(lambda a, b: a | b, [place > 0 for place in places])
        return F.coalesce(*values, F.when(~known, F.lit(0).cast("long")))

    return [found(some) for some in wanted]


def guarded_ratio(
    numerator: Column | str,
    denominator: Column | str,
    otherwise: Column | float | None = None,
) -> Column:
    """numerator / denominator where the denominator is > 0, else ``otherwise``."""
    numerator, denominator = as_column(numerator), as_column(denominator)
    fallback = otherwise if isinstance(otherwise, Column) else F.lit(otherwise).cast("double")
    return F.when(denominator > 0, numerator / denominator).otherwise(fallback)


def guarded_percent(
    numerator: Column | str, denominator: Column | str, otherwise: float | None = None
) -> Column:
    numerator, denominator = as_column(numerator), as_column(denominator)
    return F.when(denominator > 0, numerator / denominator * 100).otherwise(
        F.lit(otherwise).cast("double")
    )


def gc_percent(gc_ms: Column | str, base_ms: Column | str) -> Column:
    """GC share of a time base, 0.0 when the base is missing or not positive."""
    return guarded_percent(gc_ms, base_ms, 0.0)


def cpu_percent(cpu_ns: Column | str, run_ms: Column | str) -> Column:
    """CPU share of run time, NULL when there is no run time."""
    return guarded_percent(as_column(cpu_ns) / F.lit(1e6), run_ms)


def skew_ratio(largest: Column | str, median: Column | str) -> Column:
    """largest / median, rounded to 2 digits; NULL unless the median is positive."""
    return F.round(guarded_ratio(as_column(largest).cast("double"), median), 2)


def in_mib(size: Column | str, digits: int) -> Column:
    return F.round(as_column(size) / F.lit(MIB), digits)


def in_gib(size: Column | str, digits: int = 3) -> Column:
    return F.round(as_column(size) / F.lit(GIB), digits)


def in_seconds(ms: Column | str, digits: int | None = None) -> Column:
    seconds = as_column(ms) / F.lit(1000.0)
    return seconds if digits is None else F.round(seconds, digits)


def count_where(condition: Column) -> Column:
    """Number of rows for which ``condition`` is true."""
    return F.count(F.when(condition, 1))
