"""Long series: running windows in two levels, and order statistics that slide, against the plain windows and brute force."""

import datetime as dt
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from revpanel import INF, Panel, PanelError
from revpanel.operators.order import quantile, slide_sorted, sliding_quantiles
from revpanel.operators.outliers import Method

D = dt.date(2020, 1, 1)


def panel(spark, seed=1, n=150, gaps=0.1, nulls=0.1):
    rng = random.Random(seed)
    rows = []
    for g in ("a", "b"):
        for i in range(n):
            if rng.random() >= gaps:
                x = None if rng.random() < nulls else rng.randrange(-40, 40)
                rows.append((g, D + dt.timedelta(i), x, None if x is None else x > 0, None if x is None else float(x) / 8))
    df = spark.createDataFrame(rows, "geo_value string, time_value date, x int, up boolean, y double").repartition(3)
    return Panel.from_df(df, geo_type="custom", time_type="day")


def result(p):
    return sorted(map(repr, p.df.collect()))


@pytest.mark.parametrize("f", ["sum", "mean", "min", "max", "prod", "all", "any"])
@pytest.mark.parametrize("skip_nulls", [False, True])
def test_running_windows_split(spark, f, skip_nulls):
    """The same as one task per series, by chunks of any length."""
    for gaps, nulls in ((0.0, 0.0), (0.1, 0.1)):
        p = panel(spark, 2, 90, gaps, nulls)
        columns = ["up"] if f in ("all", "any") else ["x", "up", "y"]
        if f == "prod":
            p, columns = p.mutate(y=F.when(F.col("y") > 0, F.lit(0.5)).otherwise(2.0)), ["y"]
        want = result(p.roll(columns, f, INF, skip_nulls=skip_nulls))
        for split in (1, 7, 400):
            assert result(p.roll(columns, f, INF, skip_nulls=skip_nulls, split=split)) == want


def test_running_windows_split_at_reference_times(spark):
    p = panel(spark, 3, 60, 0, 0)
    times = [D + dt.timedelta(i) for i in (0, 30, 59)]
    for all_rows in (False, True):
        assert result(p.roll_sum("x", INF, ref_times=times, all_rows=all_rows, split=8)) == result(p.roll_sum("x", INF, ref_times=times, all_rows=all_rows))


def test_what_cannot_be_split(spark):
    p = panel(spark, 4, 20)
    with pytest.raises(PanelError):
        p.roll("x", "median", INF, split=5)
    with pytest.raises(PanelError):
        p.slide({"s": F.sum("x")}, INF, split=5)
    with pytest.raises(PanelError):
        p.roll_sum("x", 7, split=0)


def test_one_long_series_runs_in_many_tasks(spark):
    """A running sum over one series of a million rows: no task has more than its chunks."""
    df = spark.range(200_000).select(F.lit("a").alias("geo_value"), F.col("id").cast("int").alias("time_value"), (F.col("id") % 11).alias("x"))
    p = Panel.from_df(df, geo_type="custom", time_type="integer", validate=False)
    out = p.roll_sum("x", INF, split=1000, validate=False).df
    assert out.where("time_value = 199999").first()["x_running_sum"] == sum(i % 11 for i in range(200_000))
    spread = out.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert out._jdf.queryExecution().toString().count("Window") >= 2 and sum(r["count"] for r in spread) == 200_000


def brute_quantile(values, p):
    return float(np.percentile(values, 100 * p)) if values else None


@pytest.mark.parametrize("chunk", [1, 10, 1000])
def test_sliding_quantiles(spark, chunk):
    rng = random.Random(5)
    rows = [(g, t, rng.choice([None, float("nan"), *map(float, range(-5, 5))]), "kept") for g in ("a", None) for t in rng.sample(range(300), 120)]
    df = spark.createDataFrame(rows, "g string, t long, y double, other string")
    got = sliding_quantiles(df, ["g"], "t", ["y"], [0.25, 0.5, 0.9], 12, 5, chunk).collect()
    assert len(got) == len(rows)
    for r in got:
        own = [y for g, t, y, _ in rows if g == r["g"] and r["t"] - 12 <= t <= r["t"] + 5 and y is not None and not math.isnan(y)]
        assert r["y_n"] == len(own) and r["other"] == "kept"
        assert (r["y_q"] or [None] * 3) == pytest.approx([brute_quantile(own, p) for p in (0.25, 0.5, 0.9)])


@pytest.mark.parametrize("size, align", [(65, "right"), (91, "center"), (80, "left"), (70, "right")])
def test_wide_medians_are_those_of_plain_windows(spark, monkeypatch, size, align):
    for gaps in (0.0, 0.2):
        p = panel(spark, 6, 200, gaps, gaps)
        for skip in (False, True):
            got = result(p.roll(["x", "up", "y"], "median", size, align, skip_nulls=skip))
            assert got == result(p.roll(["x", "up", "y"], "median", size, align, skip_nulls=skip, split=40))
            monkeypatch.setattr("revpanel.operators.windows.WIDE", 10**9)
            assert got == result(p.roll(["x", "up", "y"], "median", size, align, skip_nulls=skip))
            monkeypatch.undo()


def test_wide_outliers_are_those_of_plain_windows(spark, monkeypatch):
    p = panel(spark, 7, 220, 0.05, 0.05)
    methods = [Method("rm", "rm", {"n": 91, "detect_negatives": True}), Method("rm", "lg", {"n": 75, "log_transform": True})]
    got = result(p.detect_outliers("x", methods))
    monkeypatch.setattr("revpanel.operators.outliers.WIDE", 10**9)
    assert got == result(p.detect_outliers("x", methods))


def test_a_row_costs_the_same_for_any_width():
    """A hundred times the window takes less than three times the time."""
    n = 60_000
    at, x = np.arange(n), np.random.default_rng(1).normal(size=n)

    def seconds(width):
        best = math.inf
        for _ in range(2):
            start = time.process_time()
            slide_sorted(at, x, np.ones(n, bool), width - 1, 0, [0.25, 0.5, 0.75])
            best = min(best, time.process_time() - start)
        return best

    assert seconds(2001) < 3 * seconds(21) + 0.2


def test_quantile_of_a_sorted_list():
    rng = np.random.default_rng(2)
    for _ in range(100):
        v = np.sort(rng.integers(0, 9, rng.integers(1, 12))).astype(float).tolist()
        p = rng.random()
        assert quantile(v, p) == pytest.approx(np.percentile(v, 100 * p))
