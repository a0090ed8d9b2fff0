"""Growth rates."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revpanel.functions import smooth
from revpanel.functions.time import PanelError, index
from revpanel.panel import Panel

METHODS = ("rel_change", "linear_reg", "smooth_spline", "trend_filter")


@dataclass(frozen=True)
class GrowthParams:
    """Options of the two global methods."""

    df: float | str | None = None
    lam: float | Sequence[float] | None = None
    cv: bool = False
    spar: float | None = None
    all_knots: bool = True
    df_offset: float = 0
    penalty: float = 1
    k: int = 3
    family: str = "gaussian"
    nlambda: int = 50
    lambda_max: float | None = None
    lambda_min: float | None = None
    lambda_min_ratio: float = 1e-5
    error_measure: str = "deviance"
    nfolds: int = 3

    def __post_init__(self):
        if isinstance(self.df, str) and self.df not in ("min", "1se"):
            raise PanelError("df must be a number, min or 1se")
        if not isinstance(self.df, str) and self.df is not None and self.df < 0:
            raise PanelError("df is not negative")
        if self.family not in ("gaussian", "logistic", "poisson") or self.error_measure not in ("deviance", "mse", "mae"):
            raise PanelError("unknown family or error_measure")
        if self.k < 0 or self.nfolds < 2 or not 0 <= self.lambda_min_ratio <= 1 or self.nlambda < 0:
            raise PanelError("k >= 0, nfolds >= 2, nlambda >= 0 and a lambda_min_ratio from 0 to 1 are needed")
        values = [] if self.lam is None else [self.lam] if np.isscalar(self.lam) else list(self.lam)
        if any(v < 0 or not np.isfinite(v) for v in values):
            raise PanelError("lambda values are finite and not negative")

    def for_trend_filter(self) -> GrowthParams:
        """Whether cross-validation is used; contradictory options are refused."""
        from dataclasses import replace

        one = self.lam is not None and (np.isscalar(self.lam) or len(self.lam) < 2)
        word = self.df is None or isinstance(self.df, str)
        if word and not one:
            return replace(self, cv=True, df=self.df or "min")
        if self.cv:
            raise PanelError("with cv=True, df is None or a word and lam None or several values")
        if one and self.df is not None:
            raise PanelError("df and a single lam contradict each other")
        return self


def _interpolated(g: str, x: str, series: list[str]) -> Column:
    """Linear interpolation over missing and NaN rates, none beyond the ends."""
    knot = F.when(F.col(g).isNotNull() & ~F.isnan(g), F.struct(F.col(x).cast("double").alias("x"), F.col(g).alias("g")))
    w = Window.partitionBy(*series).orderBy(x)
    a = F.last(knot, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(knot, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    part = F.try_divide(F.col(x).cast("double") - a["x"], b["x"] - a["x"])
    return F.when(a["x"] == F.col(x), a["g"]).when(a.isNotNull() & b.isNotNull(), a["g"] + (b["g"] - a["g"]) * part)


def _ratio(a: Column, b: Column) -> Column:
    """a / b with the infinities and NaN of floating point."""
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def growth_rate(panel: Panel, y: str, method: str = "rel_change", h: int = 7, log_scale: bool = False, na_rm: bool = False, params: GrowthParams | None = None, name: str = "growth_rate", validate: bool = True) -> Panel:
    """Adds the growth rate of ``y`` at each row, per series.

    rel_change and linear_reg look at times in (x - h, x + h], in days for dates; smooth_spline and trend_filter fit the
    whole series. y that are null or not finite are left out and their rates interpolated; the first and last y of a
    series must be finite. log_scale works on log(y).
    """
    if method not in METHODS:
        raise PanelError(f"method must be one of {METHODS}")
    if name in panel.df.columns:
        raise PanelError(f"column {name} exists already")
    series = panel.meta.series
    value = F.col(y).cast("double")
    if log_scale:
        value = F.when(F.col(y) > 0, F.log(value)).when(F.col(y) == 0, F.lit(float("-inf"))).when(F.col(y) < 0, F.lit(float("nan")))
    df = panel.df.withColumn("__x", index("time_value", panel.meta.time_type)).withColumn("__y", value)
    finite = F.col("__y").isNotNull() & ~F.isnan("__y") & (F.abs("__y") != float("inf"))
    df = df.withColumn("__y", F.when(finite, F.col("__y")))
    if validate:
        ends = df.groupBy(*series).agg(F.min_by(F.col("__y").isNotNull(), "__x").alias("a"), F.max_by(F.col("__y").isNotNull(), "__x").alias("b"), F.min(y).alias("least"))
        row = ends.agg(F.bool_and(F.col("a") & F.col("b")).alias("ok"), F.min("least").alias("least")).first()
        if row["ok"] is False:
            raise PanelError("the first or last value of a series is not finite")
        if log_scale and row["least"] is not None and row["least"] <= 0:
            warnings.warn("y has values of 0 or less, whose logarithms are left out", stacklevel=2)
    if method in ("rel_change", "linear_reg"):
        base = Window.partitionBy(*series).orderBy("__x")
        if method == "rel_change":
            left, right = base.rangeBetween(-(h - 1), 0), base.rangeBetween(1, h)
            here = F.when(F.col("__y").isNotNull(), F.col("__x"))
            a, b = F.avg("__y").over(left), F.avg("__y").over(right)
            width = F.avg(here).over(right) - F.avg(here).over(left)
            rate = (b - a) / width if log_scale else (_ratio(b, a) - 1) / width
        else:
            w = base.rangeBetween(-(h - 1), h)
            slope, cut = F.regr_slope("__y", F.col("__x").cast("double")).over(w), F.regr_intercept("__y", F.col("__x").cast("double")).over(w)
            rate = slope if log_scale else _ratio(slope, cut + slope * F.col("__x"))
        df = df.withColumn("__g", F.when(F.col("__y").isNotNull(), rate)).withColumn(name, _interpolated("__g", "__x", series))
        return panel.wrap(df.drop("__x", "__y", "__g"))
    if not na_rm and validate and not df.where("__y is null").limit(1).isEmpty():
        warnings.warn(f"{method} leaves out values that are missing or not finite", stacklevel=2)
    options = params or GrowthParams()
    if method == "smooth_spline":
        if options.spar is not None or not options.all_knots:
            raise PanelError("the smoothing spline has its knots at all times and no spar; give df or lam")
        if options.lam is not None and np.size(options.lam) != 1:
            raise PanelError("the smoothing spline takes one lam")
    if method == "trend_filter":
        options = options.for_trend_filter()
        if options.family != "gaussian":
            raise PanelError("the trend filter fits the gaussian family; transform y for others")
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__x").reset_index(drop=True)
        x0 = pdf["__x"].to_numpy(float)
        ok = pdf["__y"].notna().to_numpy()
        x, v = x0[ok], pdf["__y"].to_numpy(float)[ok]
        out = np.full(len(x0), np.nan)
        if method == "smooth_spline" and len(x) >= 4:
            lam = None if options.lam is None else float(np.ravel(options.lam)[0])
            f, d = smooth.smoothing_spline(x, v, x0, None if isinstance(options.df, str) else options.df, lam, options.cv, options.df_offset, options.penalty)
            out = d if log_scale else d / f
        elif method == "trend_filter" and len(x) >= options.k + 3:
            f = smooth.trend_filter(x, v, x0, options)
            d = np.diff(f) / np.diff(x0)
            d = np.r_[d, d[-1]]
            out = d if log_scale else d / f
        return pdf.assign(**{name: out})

    return panel.wrap(df.groupBy(*series).applyInPandas(fit, schema).drop("__x", "__y"))
