"""Running results over arrays, and values that are computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, even where `use` reads it for every element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative `join`, in n log n steps: spans of 1, 2, 4, ... elements are joined."""
    spans = F.array(*[F.lit(1 << j) for j in range(31)])

    def joined(acc: Column, s: Column) -> Column:
        return F.when(s < F.size(acc), F.transform(acc, lambda x, i: F.when(i >= s, join(F.get(acc, i - s), x)).otherwise(x))).otherwise(acc)

    return F.aggregate(spans, values, joined)
