"""Scalar building blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    """P2, P3. a / b, null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def normal_key(c: Column) -> Column:
    r"""P4. As text, without white space (tabs too) at both ends."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"^\s+", ""), r"\s+$", "")


def nan_to_null(c: Column) -> Column:
    """Sources write missing numbers as NaN; here they are null."""
    return F.when(~F.isnan(c), c)


def call_weight(calls: Column, duration: Column) -> Column:
    """P15. log1p(calls) * log1p(duration)."""
    return F.log1p(calls) * F.log1p(duration)


def distinct_scalars(*cols: Column) -> Column:
    """A3. Number of distinct non-null values in a row."""
    return F.size(F.array_distinct(F.array_compact(F.array(*cols))))


def list_sum(c: Column) -> Column:
    """A2."""
    return F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)


#: Right-closed bands, as (upper bound, label); the last has no bound.
DISTANCE_BANDS = [(1, "<=1"), (3, "1-3"), (5, "3-5"), (7, "5-7"), (9, "7-9"), (11, "9-11"), (None, ">11")]
CALL_BANDS = [(1, "1"), (5, "2-5"), (10, "6-10"), (25, "11-25"), (50, "26-50"), (100, "51-100"), (None, ">100")]


def band(c: Column, bands: list[tuple[float | None, str]]) -> Column:
    """The band's number from 0; null for null."""
    out = F.when(c.isNull(), F.lit(None))
    for i, (upper, _) in enumerate(bands):
        out = out.when(c <= upper, F.lit(i)) if upper is not None else out.otherwise(F.lit(i))
    return out.cast("int")
