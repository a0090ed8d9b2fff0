"""Outlier detection and correction."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revpanel.functions import smooth
from revpanel.functions.time import STEP, PanelError, before_after, index
from revpanel.meta import check_unique
from revpanel.operators.order import sliding_quantiles
from revpanel.operators.windows import WIDE, check_arity
from revpanel.panel import Panel

PARTS = ("lower", "upper", "replacement")


@dataclass(frozen=True)
class Method:
    """"rm", "stl", or a function (x, y, **args) -> frame with lower, upper, replacement; ``abbr`` names its columns."""

    method: str | Callable
    abbr: str
    args: dict[str, Any] = field(default_factory=dict)


def _quantiles(df: DataFrame, panel: Panel, c: str, n: int, probs: list[float]) -> DataFrame:
    """The column __q: quantiles of ``c`` over the centred window of n steps; null without values.

    Wide windows keep a sorted list, so that a row costs the same for 21 steps as for 2001.
    """
    before, after = before_after(int(n), "center")
    step = STEP[panel.meta.time_type]
    if n > WIDE:
        return sliding_quantiles(df, panel.meta.series, "__x", [c], probs, int(before) * step, int(after) * step).withColumnRenamed(f"{c}_q", "__q").drop(f"{c}_n")
    w = Window.partitionBy(*panel.meta.series).orderBy("__x").rangeBetween(-int(before) * step, int(after) * step)
    return df.withColumn("__q", F.percentile(c, F.array(*map(F.lit, probs))).over(w))


def _bounds(df: DataFrame, panel: Panel, n: int, detection_multiplier: float, min_radius: float, replacement_multiplier: float, min_lower: float, whole: bool) -> DataFrame:
    """lower, upper and replacement from __fitted, __resid and __v, by the rolling interquartile range of residuals."""
    df = _quantiles(df, panel, "__resid", n, [0.25, 0.75]).withColumn("__iqr", F.col("__q")[1] - F.col("__q")[0])
    radius = F.when(F.col("__iqr").isNotNull(), F.greatest(F.lit(float(min_radius)), detection_multiplier * F.col("__iqr")))
    low = F.col("__fitted") - radius
    df = df.withColumn("__lower", F.when(low.isNotNull(), F.greatest(F.lit(min_lower), low))).withColumn("__upper", F.col("__fitted") + radius)
    down, up = F.col("__fitted") - replacement_multiplier * F.col("__iqr"), F.col("__fitted") + replacement_multiplier * F.col("__iqr")
    if whole:
        down, up = (F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double") for c in (down, up))
    v = F.col("__v")
    return df.withColumn("__replacement", F.when(v < F.col("__lower"), down).when(v > F.col("__upper"), up).otherwise(v))


def _logged(df: DataFrame, panel: Panel, log_transform: bool) -> DataFrame:
    if not log_transform:
        return df
    clamped = F.greatest(F.lit(0.0), F.col("__v"))
    df = df.withColumn("__v", F.when(F.col("__v").isNotNull(), clamped))
    # The offset is one per series.
    offset = F.max(F.when(F.col("__v") == 0, 1.0).otherwise(0.0)).over(Window.partitionBy(*panel.meta.series))
    df = df.withColumn("__offset", offset)
    return df.withColumn("__v", F.log(F.col("__v") + F.col("__offset")))


def _named(df: DataFrame, keep: list[str], abbr: str, log_transform: bool) -> DataFrame:
    back = lambda c: F.exp(c) - F.col("__offset") if log_transform else c
    return df.select(*keep, *[back(F.col(f"__{p}")).alias(f"{abbr}_{p}") for p in PARTS])


def _rm(df: DataFrame, panel: Panel, y: str, abbr: str, n: int = 21, log_transform: bool = False, detect_negatives: bool = False, detection_multiplier: float = 2, min_radius: float = 0, replacement_multiplier: float = 0) -> DataFrame:
    """Rolling median and interquartile range, as two stacked windows."""
    keep, whole = df.columns, isinstance(panel.df.schema[y].dataType, T.IntegralType) and not log_transform
    df = _logged(df.withColumn("__v", F.col(y).cast("double")), panel, log_transform)
    df = _quantiles(df, panel, "__v", n, [0.5]).withColumn("__fitted", F.col("__q")[0]).drop("__q").withColumn("__resid", F.col("__v") - F.col("__fitted"))
    least = 0.0 if detect_negatives and not log_transform else float("-inf")
    return _named(_bounds(df, panel, n, detection_multiplier, min_radius, replacement_multiplier, least, whole), keep, abbr, log_transform)


def _stl(df: DataFrame, panel: Panel, y: str, abbr: str, seasonal_period: int, n_trend: int = 21, n_seasonal: int | str = 21, n_threshold: int = 21, seasonal_as_residual: bool = False, log_transform: bool = False, detect_negatives: bool = False, detection_multiplier: float = 2, min_radius: float = 0, replacement_multiplier: float = 0) -> DataFrame:
    """Residuals of a robust seasonal decomposition; the series must be regular and without nulls.

    ``n_seasonal`` is a window of periods, or "periodic" for a season that is the same in all of them.
    """
    if seasonal_period < 2:
        raise PanelError("seasonal_period is at least 2")
    if isinstance(n_seasonal, str) and n_seasonal != "periodic":
        raise PanelError('n_seasonal is a number or "periodic"')
    keep, whole = df.columns, isinstance(panel.df.schema[y].dataType, T.IntegralType) and not log_transform
    df = _logged(df.withColumn("__v", F.col(y).cast("double")), panel, log_transform)
    schema = T.StructType([*df.schema.fields, T.StructField("__fitted", T.DoubleType()), T.StructField("__resid", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__x").reset_index(drop=True)
        v = pdf["__v"].to_numpy(float)
        if len(v) <= 1:
            raise ValueError("a series of one value is too short for a seasonal decomposition")
        if np.isnan(v).any() or len(set(np.diff(pdf["__x"]))) > 1:
            raise ValueError("a seasonal decomposition needs regular times and no nulls; complete the panel first")
        s, t, r = smooth.stl(v, seasonal_period, n_seasonal, n_trend)
        fitted, resid = (t, s + r) if seasonal_as_residual else (t + s, r)
        return pdf.assign(__fitted=fitted, __resid=resid)

    df = df.groupBy(*panel.meta.series).applyInPandas(run, schema)
    least = 0.0 if detect_negatives and not log_transform else float("-inf")
    return _named(_bounds(df, panel, n_threshold, detection_multiplier, min_radius, replacement_multiplier, least, whole), keep, abbr, log_transform)


def _custom(df: DataFrame, panel: Panel, y: str, abbr: str, f: Callable, args: dict) -> DataFrame:
    check_arity(f, 2, "an outlier method")
    names = [f"{abbr}_{p}" for p in PARTS]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__x").reset_index(drop=True)
        got = f(pdf["time_value"], pdf[y], **args)
        return pdf.assign(**{n: np.asarray(got[p], float) for n, p in zip(names, PARTS)})

    return df.groupBy(*panel.meta.series).applyInPandas(run, schema)


def _middle(columns: list[Column], how: str) -> Column:
    """Row-wise median or mean; a null makes the result null."""
    values = F.array_sort(F.array(*columns))
    m = len(columns)
    got = (values[(m - 1) // 2] + values[m // 2]) / 2 if how == "median" else sum(columns[1:], columns[0]) / m
    known = columns[0].isNotNull()
    for c in columns[1:]:
        known = known & c.isNotNull()
    return F.when(known, got)


def detect_outliers(panel: Panel, y: str, methods: Sequence[Method] = (Method("rm", "rm"),), combiner: str = "median", validate: bool = True) -> Panel:
    """Adds {abbr}_lower, _upper and _replacement of each method, and combined_* unless the combiner is none."""
    if combiner not in ("median", "mean", "none"):
        raise PanelError("combiner must be median, mean or none")
    if len({m.abbr for m in methods}) != len(methods):
        raise PanelError("method abbreviations repeat")
    if validate:
        check_unique(panel.df, panel.meta.keys)
    df = panel.df.withColumn("__x", index("time_value", panel.meta.time_type))
    for m in methods:
        if m.method == "rm":
            df = _rm(df, panel, y, m.abbr, **m.args)
        elif m.method == "stl":
            df = _stl(df, panel, y, m.abbr, **m.args)
        elif callable(m.method):
            df = _custom(df, panel, y, m.abbr, m.method, m.args)
        else:
            raise PanelError(f"no outlier method {m.method!r}")
    if combiner != "none":
        df = df.withColumns({f"combined_{p}": _middle([F.col(f"{m.abbr}_{p}") for m in methods], combiner) for p in PARTS})
    return panel.wrap(df.drop("__x"))
