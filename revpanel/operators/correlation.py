"""Correlations of lagged columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revpanel.functions.time import STEP, PanelError, index
from revpanel.operators.scan import running
from revpanel.panel import Panel


def _shifted(c: str, n: int, w) -> Column:
    x = F.col(c).cast("double")
    x = F.nanvl(x, F.lit(None).cast("double"))
    return F.lag(x, -n).over(w) if n < 0 else F.lead(x, n).over(w) if n else x


def _pearson(x: str, y: str) -> Column:
    """Null for fewer than two pairs or a constant side."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


#: Ranges of values at most; rows of a range about, as long as that allows.
RANGES, ROWS = 1024, 65_536


def _range_of(df: DataFrame, c: str, n: int) -> Column:
    """A number that never falls along the values of ``c``, of about equally many rows each.

    Ranges end at quantiles. A value that fills a whole range or more is one of its own, an odd number; what ends before it is even.
    """
    ranges = max(1, min(RANGES, n // ROWS))
    ends = df.stat.approxQuantile(c, [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    if not ends:
        return F.lit(0).cast("long")
    often = [a for a, b in zip(ends, ends[1:]) if a == b]
    ends, x = F.array(*[F.lit(v) for v in sorted(set(ends))]), F.col(c)
    own = x.isin(sorted(set(often))).cast("long") if often else F.lit(0).cast("long")
    return 2 * F.size(F.filter(ends, lambda v: v < x)).cast("long") + own


def _ranks(both: DataFrame, keys: list[str], c: str, n: int) -> DataFrame:
    """(keys, c, rank): the mean rank of each value, from the numbers of rows of each and of those before it."""
    counts = both.groupBy(*keys, c).agg(F.count("*").alias("__n"))
    sums = running(counts, keys, [c], _range_of(both, c, n), {"__upto": ("sum", F.col("__n"))})
    return sums.select(*[F.col(k).alias(f"{k}_r") for k in keys], F.col(c).alias(f"{c}_r"), (F.col("__upto") - (F.col("__n") - 1) / 2).alias(f"{c}_rank"))


def _with_ranks(both: DataFrame, keys: list[str], c: str, n: int) -> DataFrame:
    same = F.col(c) == F.col(f"{c}_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_r"))
    return both.join(_ranks(both, keys, c, n), same).drop(f"{c}_r", *[f"{k}_r" for k in keys])


def _all_shifted(panel: Panel, columns: list[tuple[str, int, str]], keep: list[Column]) -> DataFrame:
    """Columns shifted by rows of the whole panel in one order: rows are numbered in chunks of time and meet by their numbers."""
    order = ["time_value", *panel.meta.series]
    step = STEP.get(panel.meta.time_type, 1)
    at = F.floor(index("time_value", panel.meta.time_type) / (256 * step)) if panel.meta.time_type in STEP else F.lit(0).cast("long")
    numbered = running(panel.df, [], order, at, {"__i": ("count", F.lit(1))})
    out = numbered.select("__i", *keep)
    for c, n, name in columns:
        other = numbered.select((F.col("__i") - n).alias("__i"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(name))
        out = out.join(other, "__i", "left")
    return out.drop("__i")


def correlation(panel: Panel, var1: str, var2: str, dt1: int = 0, dt2: int = 0, shift_by: Sequence[str] | str | None = "geo_value", cor_by: Sequence[str] | str | None = "geo_value", method: str = "pearson") -> DataFrame:
    """Correlation of two columns, each shifted by rows (a negative shift looks back), per group: column ``cor``.

    Shifts count rows in time order inside ``shift_by``; gaps are not respected. Only complete pairs count.
    """
    shift_by = [shift_by] if isinstance(shift_by, str) else list(shift_by or [])
    cor_by = [cor_by] if isinstance(cor_by, str) else list(cor_by or [])
    for c in (var1, var2, *shift_by, *cor_by):
        if c not in panel.df.columns:
            raise PanelError(f"no such column: {c}")
    named = [F.col(c).alias(f"__k{i}") for i, c in enumerate(cor_by)]
    if not shift_by and (dt1 or dt2):
        pairs = _all_shifted(panel, [(var1, dt1, "__x"), (var2, dt2, "__y")], named)
    else:
        # Without a shift no window is made.
        w = Window.partitionBy(*shift_by).orderBy("time_value", *[k for k in panel.meta.series if k not in shift_by])
        pairs = panel.df.select(*named, _shifted(var1, dt1, w).alias("__x"), _shifted(var2, dt2, w).alias("__y"))
    keys = [f"__k{i}" for i in range(len(cor_by))]
    both = pairs.where("__x is not null and __y is not null")
    if method == "pearson":
        out = _pairs_by(pairs, keys, F.when(F.col("__x").isNotNull() & F.col("__y").isNotNull(), F.col("__x")), F.when(F.col("__x").isNotNull() & F.col("__y").isNotNull(), F.col("__y")))
    elif method == "spearman":
        n = both.count()
        ranks = _with_ranks(_with_ranks(both, keys, "__x", n), keys, "__y", n)
        out = _all_groups(pairs, keys, ranks.groupBy(*keys).agg(_pearson("__x_rank", "__y_rank").alias("cor")))
    elif method == "kendall":
        out = _all_groups(pairs, keys, _kendall(both, keys))
    else:
        raise PanelError("method must be pearson, spearman or kendall")
    return out.withColumnsRenamed(dict(zip(keys, cor_by)))


def _pairs_by(pairs: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    rows = pairs.select(*keys, x.alias("__x"), y.alias("__y"))
    return rows.groupBy(*keys).agg(_pearson("__x", "__y").alias("cor"))


def _all_groups(pairs: DataFrame, keys: list[str], found: DataFrame) -> DataFrame:
    """Groups without a complete pair have a null."""
    if not keys:
        return found
    cond = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return pairs.select(*keys).distinct().alias("a").join(found.alias("b"), cond, "left").select(*[f"a.{k}" for k in keys], "b.cor")


def _inversions(y: np.ndarray, w: np.ndarray) -> int:
    """The weight of all pairs of which the first has the larger y, by merging sorted halves."""
    if len(y) < 2:
        return 0
    half = len(y) // 2
    total = _inversions(y[:half], w[:half]) + _inversions(y[half:], w[half:])
    order = np.argsort(y[:half], kind="stable")
    upto = np.r_[0, np.cumsum(w[:half][order])]
    above = upto[-1] - upto[np.searchsorted(y[:half][order], y[half:], "right")]
    return total + int((above * w[half:]).sum())


def _swaps(counted: DataFrame, keys: list[str], by: str, first: str) -> DataFrame:
    """(keys, swaps) of each range ``by``, its rows in the order of ``first`` and then of y. Ranges of one value (odd) have none."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((pdf["__y"], pdf[first]))
        swaps = _inversions(pdf["__y"].to_numpy()[order], pdf["__n"].to_numpy(np.int64)[order])
        return pd.DataFrame({**{k: pd.Series([v], dtype=object) for k, v in zip(keys, key)}, "swaps": [swaps]})

    schema = T.StructType([*[counted.schema[k] for k in keys], T.StructField("swaps", T.LongType())])
    return counted.where(F.col(by) % 2 == 0).groupBy(*keys, by).applyInPandas(run, schema)


def _kendall(both: DataFrame, keys: list[str]) -> DataFrame:
    """tau-b per group: x and y are cut into ranges of equally many rows, so that no task has a whole group.

    A pair is swapped (x rises where y falls) within one range of x, or in one range of y and two of x, or in two ranges
    of both. The first two are counted by merging within ranges, the last from the numbers of rows of the ranges.
    """
    n = both.count()
    counted = both.groupBy(*keys, "__x", "__y").agg(F.count("*").alias("__n")).withColumns({"__bx": _range_of(both, "__x", n), "__by": _range_of(both, "__y", n)})
    parts = [_swaps(counted, keys, "__bx", "__x"), _swaps(counted, keys, "__by", "__bx")]
    cells = counted.groupBy(*keys, "__bx", "__by").agg(F.sum("__n").alias("__n"))

    def crossed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, i = np.unique(pdf["__bx"], return_inverse=True)
        b, j = np.unique(pdf["__by"], return_inverse=True)
        table = np.zeros((len(a), len(b)), np.int64)
        table[i, j] = pdf["__n"]
        # Rows of earlier ranges of x and later ranges of y than each cell.
        before = np.r_[np.zeros((1, len(b)), np.int64), table.cumsum(0)[:-1]]
        above = before[:, ::-1].cumsum(1)[:, ::-1] - before
        return pd.DataFrame({**{k: pd.Series([v], dtype=object) for k, v in zip(keys, key)}, "swaps": [int((table * above).sum())]})

    schema = T.StructType([*[counted.schema[k] for k in keys], T.StructField("swaps", T.LongType())])
    parts.append((cells.groupBy(*keys) if keys else cells.groupBy(F.lit(0).alias("__all"))).applyInPandas(crossed, schema))
    swaps = parts[0].union(parts[1]).union(parts[2]).groupBy(*keys).agg(F.sum("swaps").alias("swaps"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    ties = lambda *c: counted.groupBy(*keys, *c).agg(F.sum("__n").alias("__m")).groupBy(*keys).agg(pairs("__m").alias("__t"))
    out = swaps
    for name, by in (("__all", ()), ("__tx", ("__x",)), ("__ty", ("__y",)), ("__txy", ("__x", "__y"))):
        tied = ties(*by).withColumnsRenamed({"__t": name, **{k: f"{k}_r" for k in keys}})
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}_r"))
        out = out.join(tied, same).drop(*[f"{k}_r" for k in keys]) if keys else out.join(F.broadcast(tied))
    score = F.col("__all") - F.col("__tx") - F.col("__ty") + F.col("__txy") - 2 * F.col("swaps")
    below = F.sqrt((F.col("__all") - F.col("__tx")) * (F.col("__all") - F.col("__ty")))
    return out.select(*keys, F.when(below > 0, score / below).alias("cor"))


def lag_sweep(panel: Panel, var1: str, var2: str, lags: Sequence[int], shift_by: Sequence[str] | str = "geo_value", cor_by: Sequence[str] | str = "geo_value") -> DataFrame:
    """correlation() of var1 at each lag of rows (looking back) with var2, in one job: cor_by, lag, cor."""
    shift_by = [shift_by] if isinstance(shift_by, str) else list(shift_by)
    cor_by = [cor_by] if isinstance(cor_by, str) else list(cor_by)
    w = Window.partitionBy(*shift_by).orderBy("time_value", *[k for k in panel.meta.series if k not in shift_by])
    x = F.col(var1).cast("double")
    shifted = F.array(*[F.struct(F.lit(n).alias("lag"), F.lag(x, n).over(w).alias("__x")) for n in lags])
    rows = panel.df.select(*cor_by, F.col(var2).cast("double").alias("__y"), shifted.alias("__a"))
    rows = rows.select(*cor_by, "__y", F.explode("__a").alias("__s"))
    rows = rows.select(*cor_by, F.col("__s.lag").alias("lag"), "__y", F.col("__s.__x").alias("__x"))
    both = F.col("__x").isNotNull() & F.col("__y").isNotNull()
    return _pairs_by(rows, [*cor_by, "lag"], F.when(both, F.col("__x")), F.when(both, F.col("__y")))
