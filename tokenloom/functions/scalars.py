"""Column functions: n-grams, entropies, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ngrams(ops: str, n: int, own: Column | None = None) -> Column:
    """The n-grams of an array column, joined by blanks. own: only those that start among the first so many elements."""
    last = F.size(ops) - (n - 1)
    last = F.least(last, own) if own is not None else last
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(ops, i, n), " "))


def entropy(count: str = "count", times: Column | None = None) -> Column:
    """Aggregate: Shannon entropy in bits of a column of counts, 0 for none. times: so many have the count of a row."""
    all = F.col(count) if times is None else F.col(count) * times
    total = F.sum(all).cast("double")
    return F.coalesce(F.when(total > 0, F.log2(total) - F.sum(all * F.log2(F.col(count).cast("double"))) / total), F.lit(0.0))


def r6(x: Column) -> Column:
    return F.round(x, 6)


def ladder(x: Column, steps: list[tuple[float, str]], otherwise: str, above: bool = True) -> Column:
    """The label of the first bound that x passes, strictly."""
    out = None
    for bound, label in steps:
        test = x > bound if above else x < bound
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(otherwise)
