"""Running results in two levels: within chunks of an order, and over the totals of the chunks before.

A window over one long series is one task. Cut into chunks, each chunk has a state that merges with others (a count, a sum, a
least or largest value); the states before a chunk are its carry, and the rows of a chunk need only their own chunk and
the carry. The totals are one row a chunk, so their window is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How the states of parts merge, and the aggregate that makes them.
MERGE = {
    "count": (F.count, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b),
    "sum": (F.sum, F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "product": (F.product, F.product, lambda a, b: F.coalesce(a * b, a, b)),
    "min": (F.min, F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, F.max, lambda a, b: F.greatest(a, b)),
    "all": (F.bool_and, F.bool_and, lambda a, b: F.coalesce(a & b, a, b)),
    "any": (F.bool_or, F.bool_or, lambda a, b: F.coalesce(a | b, a, b)),
}


def running(df: DataFrame, series: Sequence[str], order: Sequence[str], chunk: Column, states: dict[str, tuple[str, Column]], tag: str = "__k") -> DataFrame:
    """The rows of ``df`` with a column for each state (name: (kind in MERGE, argument)) over all rows of the series up to this one.

    ``chunk`` is a number that never falls along ``order``. Rows that are equal in ``order`` follow each other in any order.
    """
    df = df.withColumn(tag, chunk)
    totals = df.groupBy(*series, tag).agg(*[MERGE[kind][0](c).alias(n) for n, (kind, c) in states.items()])
    before = Window.partitionBy(*series).orderBy(tag).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*[F.col(f"`{s}`").alias(f"{tag}_{i}") for i, s in enumerate(series)], F.col(tag).alias(f"{tag}_c"), *[MERGE[kind][1](n).over(before).alias(f"{tag}_{n}") for n, (kind, _) in states.items()])
    own = Window.partitionBy(*series, tag).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select("*", *[MERGE[kind][0](c).over(own).alias(n) for n, (kind, c) in states.items()])
    same = F.col(tag) == F.col(f"{tag}_c")
    for i, s in enumerate(series):
        same = same & F.col(f"`{s}`").eqNullSafe(F.col(f"{tag}_{i}"))
    joined = rows.join(carry, same)
    kept = [F.col(f"`{c}`") for c in df.columns if c != tag]
    return joined.select(*kept, *[MERGE[kind][2](F.col(f"{tag}_{n}"), F.col(n)).alias(n) for n, (kind, _) in states.items()])
