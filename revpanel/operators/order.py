"""Order statistics of windows that slide: the window's values stay sorted while rows enter and leave.

Each row is put into the sorted list once and taken out once, found by bisection, so that the cost of a row hardly depends on the
width of the window, where sorting each window anew costs its whole width. A series is dealt out in chunks that overlap by the reach of
a window, so one long series is worked on by many tasks.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Windows of a chunk at least, and rows of a chunk about.
SPAN, CHUNK = 4, 16_384


def quantile(values: list[float], p: float) -> float:
    """Of a sorted list, between its two nearest values by linear interpolation, as Spark's percentile computes it."""
    at = (len(values) - 1) * p
    low, high = int(np.floor(at)), int(np.ceil(at))
    if low == high or values[low] == values[high]:
        return values[low]
    return (high - at) * values[low] + (at - low) * values[high]


def slide_sorted(at: np.ndarray, x: np.ndarray, wanted: np.ndarray, before: int, after: int, probs: Sequence[float]) -> tuple[list[list[float] | None], list[int]]:
    """Quantiles and number of the values present in [t - before, t + after] for each wanted row; times ascend."""
    held: list[float] = []
    first = np.searchsorted(at, at - before, side="left")
    stop = np.searchsorted(at, at + after, side="right")
    found, counts, low, high = [], [], 0, 0
    known = ~np.isnan(x)
    values = x.tolist()
    for i in np.flatnonzero(wanted):
        if first[i] >= high:
            held, low, high = [], int(first[i]), int(first[i])
        for j in range(high, stop[i]):
            if known[j]:
                insort(held, values[j])
        for j in range(low, first[i]):
            if known[j]:
                del held[bisect_left(held, values[j])]
        low, high = int(first[i]), int(stop[i])
        found.append([quantile(held, p) for p in probs] if held else None)
        counts.append(len(held))
    return found, counts


def sliding_quantiles(df: DataFrame, series: Sequence[str], time: str, columns: Sequence[str], probs: Sequence[float], before: int, after: int, chunk: int = 0) -> DataFrame:
    """The rows with {c}_q (the quantiles ``probs`` of the column, null without values) and {c}_n (the number of values) over a RANGE window.

    ``time`` is a whole number, ``columns`` are doubles; nulls are left out, as are NaN. A chunk is ``chunk`` units of time, or by default some
    windows and thousands of units.
    """
    length = chunk or max(SPAN * (before + after + 1), CHUNK)
    part = lambda t: F.floor(t / length)
    dealt = df.withColumn("__part", F.explode(F.sequence(part(F.col(time) - after), part(F.col(time) + before))))
    names = [f"{c}_{k}" for c in columns for k in ("q", "n")]
    kinds = [T.ArrayType(T.DoubleType()), T.LongType()] * len(columns)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds)]])
    carried = df.columns
    # Only the time and the columns go through Python as numbers; the rest stays as it is, packed.
    slim = dealt.select(*[F.col(f"`{s}`").alias(f"__s{i}") for i, s in enumerate(series)], "__part", F.col(time).alias("__at"), *[F.col(c).alias(f"__y{i}") for i, c in enumerate(columns)])
    keys = [*[f"__s{i}" for i in range(len(series))], "__part"]
    made = T.StructType([*[slim.schema[k] for k in keys[:-1]], T.StructField("__at", T.LongType()), *schema.fields[len(carried) :]])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__at", kind="stable")
        at = pdf["__at"].to_numpy(np.int64)
        # Its own rows, of which those of one time are one.
        own = (at // length == key[-1]) & np.r_[True, at[1:] != at[:-1]]
        out = pd.DataFrame({**{k: pd.Series([v] * int(own.sum()), dtype=object) for k, v in zip(keys, key[:-1])}, "__at": at[own]})
        for i, c in enumerate(columns):
            found, counts = slide_sorted(at, pdf[f"__y{i}"].to_numpy(float), own, before, after, probs)
            out[f"{c}_q"], out[f"{c}_n"] = pd.Series(found, dtype=object), np.array(counts, np.int64)
        return out

    found = slim.groupBy(*keys).applyInPandas(run, made).withColumnRenamed("__at", "__found")
    same = F.col(time) == F.col("__found")
    for i, s in enumerate(series):
        same = same & F.col(f"`{s}`").eqNullSafe(F.col(f"__s{i}"))
    return df.join(found, same).select(*[F.col(f"`{c}`") for c in carried], *names)
