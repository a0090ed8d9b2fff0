"""Correlation, growth rates, outliers and smoothers, against numpy."""

import datetime as dt
import warnings

import numpy as np
import pandas as pd
import pytest

from revpanel import Panel, PanelError
from revpanel.functions import smooth
from revpanel.operators.correlation import lag_sweep
from revpanel.operators.growth import GrowthParams
from revpanel.operators.outliers import Method

D = dt.date(2020, 1, 1)


def make(spark, cols, n=None, geo="a"):
    n = n or len(next(iter(cols.values())))
    pdf = pd.DataFrame({"geo_value": geo, "time_value": [D + dt.timedelta(days=i) for i in range(n)], **cols})
    kinds = {k: "long" if np.asarray(v).dtype.kind == "i" else "double" for k, v in cols.items()}
    return Panel.from_df(spark.createDataFrame(list(pdf.itertuples(index=False, name=None)), "geo_value string, time_value date, " + ", ".join(f"{k} {t}" for k, t in kinds.items())))


def test_correlation(spark):
    p = make(spark, {"pos": list(range(1, 11)), "neg": list(range(-1, -11, -1)), "flat": [3] * 10})
    for method in ("pearson", "spearman", "kendall"):
        assert p.cor("pos", "pos", method=method).first()["cor"] == pytest.approx(1)
        assert p.cor("pos", "neg", method=method).first()["cor"] == pytest.approx(-1)
        assert p.cor("pos", "flat", method=method).first()["cor"] is None
    assert p.cor("pos", "neg", cor_by=None, shift_by=None).first()["cor"] == pytest.approx(-1)
    assert p.cor("pos", "neg", cor_by="time_value").where("cor is null").count() == 10
    with pytest.raises(PanelError):
        p.cor("pos", "neg", method="other")
    with pytest.raises(PanelError):
        p.cor("pos", "nothing")


def test_lags(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=60)
    y = np.r_[np.zeros(3), x[:-3]] + 0.01 * rng.normal(size=60)
    p = make(spark, {"x": x.tolist(), "y": y.tolist()})
    want = np.corrcoef(x[:-3], y[3:])[0, 1]
    assert p.cor("x", "y", dt1=-3).first()["cor"] == pytest.approx(want)
    assert p.cor("x", "y", dt2=3).first()["cor"] == pytest.approx(want)
    sweep = {r["lag"]: r["cor"] for r in lag_sweep(p, "x", "y", range(5)).collect()}
    assert max(sweep, key=sweep.get) == 3 and sweep[3] == pytest.approx(want)


def test_kendall_with_ties(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 6, 40), rng.integers(0, 6, 40)
    i, j = np.triu_indices(40, 1)
    s = (np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])).sum()
    want = s / np.sqrt((x[i] != x[j]).sum() * (y[i] != y[j]).sum())
    p = make(spark, {"x": x.tolist(), "y": y.tolist()})
    assert p.cor("x", "y", method="kendall").first()["cor"] == pytest.approx(want)


def brute_growth(x, y, h, method, log):
    ok = np.isfinite(y)
    xs, ys, g = x[ok], y[ok], []
    with np.errstate(all="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for t in xs:
            w = (xs > t - h) & (xs <= t + h)
            xx, yy = xs[w].astype(float), ys[w]
            if method == "rel_change":
                r = xx > t
                a, b, width = np.mean(yy[~r]), np.mean(yy[r]), np.mean(xx[r]) - np.mean(xx[~r])
                g.append((b - a) / width if log else (b / a - 1) / width)
            else:
                b, a = np.polyfit(xx, yy, 1)
                g.append(b if log else b / (a + b * t))
    g = np.array(g)
    known = ~np.isnan(g)
    with np.errstate(all="ignore"):
        return np.interp(x, xs[known], g[known], left=np.nan, right=np.nan)


@pytest.mark.parametrize("method", ["rel_change", "linear_reg"])
@pytest.mark.parametrize("log", [False, True])
def test_growth(spark, method, log):
    rng = np.random.default_rng(3)
    y = rng.integers(1, 50, 40).astype(float)
    y[[7, 20]] = np.nan
    got = make(spark, {"y": y.tolist()}).growth_rate("y", method=method, h=5, log_scale=log).df.orderBy("time_value").toPandas()["growth_rate"].to_numpy(float)
    want = brute_growth(np.arange(40), np.log(y) if log else y, 5, method, log)
    assert np.allclose(got, want, equal_nan=True, atol=1e-8)


def test_growth_from_zero(spark):
    y = [5.0, 0, 0, 0, 0, 0, 0, 4, 5, 6, 7, 8]
    got = make(spark, {"y": y}).growth_rate("y", h=2).df.orderBy("time_value").toPandas()["growth_rate"].to_numpy(float)
    assert got[6] == np.inf and np.isnan(got[-1])
    with pytest.raises(PanelError):
        make(spark, {"y": [float("nan"), 1.0, 2.0]}).growth_rate("y")
    with pytest.warns(UserWarning):
        make(spark, {"y": [1.0, 0.0, 2.0]}).growth_rate("y", log_scale=True)
    with pytest.raises(PanelError):
        make(spark, {"y": [1.0, 2.0, 0.0]}).growth_rate("y", log_scale=True)
    with pytest.raises(PanelError):
        make(spark, {"y": [1.0]}).growth_rate("y", method="other")


def test_smoothed_growth_of_an_exponential(spark):
    t = np.arange(60)
    y = np.exp(0.05 * t) * 100
    p = make(spark, {"y": y.tolist()})
    for method, params in (("smooth_spline", None), ("trend_filter", GrowthParams(nlambda=15))):
        g = p.growth_rate("y", method=method, params=params).df.orderBy("time_value").toPandas()["growth_rate"].to_numpy(float)
        assert len(g) == 60 and np.allclose(g[5:-5], 0.05, atol=0.01)
        g = p.growth_rate("y", method=method, log_scale=True, params=params).df.toPandas()["growth_rate"].to_numpy(float)
        assert np.allclose(g[5:-5], 0.05, atol=0.01)


def test_growth_params():
    assert GrowthParams().for_trend_filter().cv and GrowthParams(df="1se").for_trend_filter().df == "1se"
    assert not GrowthParams(lam=1.0).for_trend_filter().cv and not GrowthParams(df=5).for_trend_filter().cv
    for bad in (dict(df="max"), dict(df=-1), dict(nfolds=1), dict(lam=-1.0), dict(family="x"), dict(k=-1)):
        with pytest.raises(PanelError):
            GrowthParams(**bad)
    for bad in (dict(df=5, lam=1.0), dict(df="min", lam=1.0), dict(cv=True, df=5)):
        with pytest.raises(PanelError):
            GrowthParams(**bad).for_trend_filter()


def test_spline():
    rng = np.random.default_rng(4)
    x = np.sort(rng.uniform(0, 10, 80))
    y = np.sin(x) + rng.normal(scale=0.1, size=80)
    f, d = smooth.smoothing_spline(x, y, x)
    assert np.abs(f - np.sin(x)).mean() < 0.06 and np.abs(d[5:-5] - np.cos(x[5:-5])).mean() < 0.2
    line = smooth.smoothing_spline(x, 2 * x + 1, x, lam=1e6)
    assert np.allclose(line[0], 2 * x + 1, atol=1e-5) and np.allclose(line[1], 2, atol=1e-5)
    stiff = smooth.smoothing_spline(x, y, x, df=2.05)[0]
    assert np.allclose(stiff, np.polyval(np.polyfit(x, y, 1), x), atol=0.05)


def test_decomposition():
    rng = np.random.default_rng(5)
    t = np.arange(140)
    s = 5 * np.sin(2 * np.pi * t / 7)
    y = 0.3 * t + s + rng.normal(scale=0.2, size=140)
    y[60] += 60
    seasonal, trend, rest = smooth.stl(y, 7, 21, 21)
    assert np.allclose(seasonal + trend + rest, y)
    assert abs(rest[60]) > 50 and np.abs(np.delete(rest, 60)).mean() < 0.5
    assert np.abs(trend - 0.3 * t)[7:-7].mean() < 0.5


def brute_rm(y, n=21, multiplier=2.0, least=-np.inf, replace=0.0):
    before, after = n // 2, n - n // 2 - 1
    cut = lambda a, i: a[max(0, i - before) : i + after + 1]
    fitted = np.array([np.nanmedian(cut(y, i)) for i in range(len(y))])
    r = y - fitted
    iqr = np.array([np.subtract(*np.nanpercentile(cut(r, i), [75, 25])) for i in range(len(y))])
    low, up = np.maximum(least, fitted - multiplier * iqr), fitted + multiplier * iqr
    return low, up, np.where(y < low, fitted - replace * iqr, np.where(y > up, fitted + replace * iqr, y))


def test_outliers_by_rolling_median(spark):
    rng = np.random.default_rng(6)
    y = rng.normal(100, 5, 60)
    y[[10, 30, 45, 50]] += [80, -90, 60, 70]
    p = make(spark, {"y": y.tolist()})
    out = p.detect_outliers("y", [Method("rm", "rm", {"detection_multiplier": 2.5, "detect_negatives": True}), Method("rm", "b", {"n": 8})]).df.orderBy("time_value").toPandas()
    for abbr, want in (("rm", brute_rm(y, multiplier=2.5, least=0)), ("b", brute_rm(y, 8))):
        for part, v in zip(("lower", "upper", "replacement"), want):
            assert np.allclose(out[f"{abbr}_{part}"], v)
    assert np.allclose(out["combined_upper"], (out["rm_upper"] + out["b_upper"]) / 2)
    logged = p.detect_outliers("y", [Method("rm", "rm", {"log_transform": True})], combiner="none").df.orderBy("time_value").toPandas()
    want = brute_rm(np.log(np.maximum(y, 0) + (np.maximum(y, 0) == 0).any()))
    assert np.allclose(logged["rm_upper"], np.exp(want[1]) - (np.maximum(y, 0) == 0).any())


def test_outliers_by_decomposition_and_by_function(spark):
    t = np.arange(70)
    y = 50 + 10 * np.sin(2 * np.pi * t / 7) + np.random.default_rng(7).normal(scale=0.5, size=70)
    y[33] += 100
    p = make(spark, {"y": y.tolist()})
    own = lambda x, v: pd.DataFrame({"lower": v * 0, "upper": v * 0 + 80, "replacement": v.clip(upper=80)})
    out = p.detect_outliers("y", [Method("stl", "stl", {"seasonal_period": 7}), Method(own, "own")], combiner="mean").df.orderBy("time_value").toPandas()
    assert out["stl_replacement"][33] < 80 and out["own_replacement"][33] == 80
    with pytest.raises(PanelError):
        p.detect_outliers("y", [Method("stl", "s", {"seasonal_period": 1})])
    with pytest.raises(PanelError):
        p.detect_outliers("y", [Method("rm", "a"), Method("rm", "a")])
    with pytest.raises(PanelError):
        p.detect_outliers("y", combiner="mode")
    with pytest.raises(PanelError):
        p.detect_outliers("y", [Method(lambda x: 1, "a")])


@pytest.mark.parametrize("option", [{"spar": 0.5}, {"all_knots": False}, {"lam": [0.1, 0.2]}])
def test_spline_refuses_options_it_does_not_have(spark, option):
    df = spark.createDataFrame([("a", i, float(i + 1)) for i in range(8)], "geo_value string, time_value int, v double")
    with pytest.raises(PanelError, match="smoothing spline"):
        Panel.from_df(df, as_of=9).growth_rate("v", method="smooth_spline", params=GrowthParams(**option))


def test_spline_weights_by_cross_validation():
    """Against a search by leaving each time out, and a heavier penalty gives a smoother curve."""
    rng = np.random.default_rng(2)
    x = np.arange(25.0)
    y = np.sin(x / 4) + 0.3 * rng.normal(size=25)
    grid = np.exp(np.linspace(-14, 4, 60))

    def left_out(lam):
        return np.mean([(y[i] - smooth.smoothing_spline(np.delete(x, i), np.delete(y, i), x[i : i + 1], lam=lam * (24 / (np.delete(x, i)[-1] - np.delete(x, i)[0])) ** 3)[0][0]) ** 2 for i in range(1, 24)])

    best = grid[int(np.argmin([left_out(g) for g in grid]))]
    by_cv = smooth.smoothing_spline(x, y, x, cv=True)[0]
    assert np.abs(by_cv - smooth.smoothing_spline(x, y, x, lam=best)[0]).max() < 0.15
    rough = lambda f: np.abs(np.diff(f, 2)).sum()
    assert rough(smooth.smoothing_spline(x, y, x, penalty=3)[0]) < rough(smooth.smoothing_spline(x, y, x)[0]) + 1e-9


def plain_loess(y, span, at, degree, weight):
    """One position after the other: the nearest points, tricube weights, a line through them."""
    n, out = len(y), []
    for t in at:
        near = sorted(range(n), key=lambda i: (abs(i - t), i))[: min(span, n)]
        reach = max(abs(i - t) for i in near) + max(span - n, 0) / 2
        w = np.array([max(0.0, (1 - (abs(i - t) / reach) ** 3) ** 3 if abs(i - t) < 0.999 * reach else 0.0) * weight[i] for i in near])
        x, v = np.array(near, float), y[near]
        mean = (w * x).sum() / w.sum()
        var = (w * (x - mean) ** 2).sum()
        out.append((w * v).sum() / w.sum() + ((t - mean) * (w * (x - mean) * v).sum() / var if degree and var > 0 else 0))
    return np.array(out)


def test_local_regression():
    rng = np.random.default_rng(4)
    for n, span, degree in ((40, 7, 1), (40, 7, 0), (12, 31, 1), (25, 25, 1), (9, 91, 0)):
        y, weight, at = rng.normal(size=n), rng.uniform(0.1, 1, n), np.arange(-1, n + 1)
        assert smooth._loess(y, span, at, degree, weight) == pytest.approx(plain_loess(y, span, at, degree, weight))


def test_periodic_season(spark):
    """A season that is the same in all periods: found under noise and an outlier, and constant by phase."""
    rng, n = np.random.default_rng(5), 140
    season = np.tile([5.0, -1, 0, 2, -3, -2, -1], n // 7)
    y = 50 + 0.1 * np.arange(n) + season + rng.normal(0, 0.2, n)
    y[70] += 60
    s, t, r = smooth.stl(y, 7, "periodic", 31)
    assert (s.reshape(-1, 7) == s[:7]).all() and np.abs(s[:7] - season[:7]).max() < 0.2 and r[70] > 55
    assert np.allclose(s + t + r, y)
    days = [dt.date(2020, 1, 1) + dt.timedelta(int(i)) for i in range(n)]
    p = Panel.from_df(spark.createDataFrame([("a", d, float(v)) for d, v in zip(days, y)], "geo_value string, time_value date, y double"), geo_type="custom", time_type="day")
    out = p.detect_outliers("y", [Method("stl", "stl", {"seasonal_period": 7, "n_seasonal": "periodic", "detection_multiplier": 4})]).df.orderBy("time_value").toPandas()
    above = (out["y"] - out["stl_upper"]).to_numpy()
    assert above.argmax() == 70 and above[70] > 50 and (above > 0).sum() <= 4
    with pytest.raises(PanelError):
        p.detect_outliers("y", [Method("stl", "stl", {"seasonal_period": 7, "n_seasonal": "always"})])


def test_long_decompositions_take_linear_time():
    """Four times the series in less than eight times the time, and no table of all points against all."""
    import time

    def seconds(n):
        start = time.process_time()
        smooth.stl(np.sin(np.arange(n) / 9) + np.arange(n) % 7, 7, 21, 21, outer=1)
        return time.process_time() - start

    seconds(500)
    assert seconds(16_000) < 8 * seconds(4_000) + 0.3
