"""Rolling and running windows against a dense grid in plain Python."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from revpanel import INF, Panel, PanelError
from revpanel.functions.time import shift

BASE = {"day": dt.date(2020, 1, 1), "week": dt.date(2020, 1, 1), "yearmonth": dt.date(2022, 1, 1), "integer": 2022}
N = 30


def grid_rows(time_type):
    """Three series of squares with a null and a gap; the third starts later."""
    values = [float(i) for i in range(N)]
    values[19] = None
    out = []
    for geo, start, add in (("a", 0, 0), ("b", 0, 300), ("c", 15, 3000)):
        for i, v in enumerate(values):
            if (geo, i) != ("a", 9):
                out.append((geo, start + i, None if v is None else (add + v) ** 2))
    return out


def make(spark, time_type):
    kind = "int" if time_type == "integer" else "date"
    data = [(g, shift(BASE[time_type], i, time_type), v) for g, i, v in grid_rows(time_type)]
    return Panel.from_df(spark.createDataFrame(data, f"geo_value string, time_value {kind}, value double"), geo_type="custom", time_type=time_type)


def expected(size, align, skip):
    """By hand: (geo, step) -> sum over the dense grid of all steps."""
    have = {(g, i): v for g, i, v in grid_rows("day")}
    out = {}
    for g, i in have:
        if size == INF:
            span = range(0, i + 1)
        else:
            before, after = {"right": (size - 1, 0), "left": (0, size - 1), "center": (size // 2, size - size // 2 - 1)}[align]
            span = range(i - before, i + after + 1)
        got = [have.get((g, k)) for k in span]
        known = [v for v in got if v is not None]
        out[g, i] = sum(known) if skip or len(known) == len(got) else None
    return out


@pytest.mark.parametrize("time_type", ["day", "week", "yearmonth", "integer"])
def test_sums_over_the_dense_grid(spark, time_type):
    p = make(spark, time_type)
    base = BASE[time_type]
    at = {shift(base, i, time_type): i for i in range(60)}
    for size, align, skip in [(7, "right", False), (7, "center", False), (7, "left", True), (INF, "right", False), (6, "center", False)]:
        window = size if size == INF else dt.timedelta(weeks=size) if time_type == "week" else size
        got = p.roll_sum("value", window, align=align, skip_nulls=skip, new_names=["s"], validate=False).df.collect()
        want = expected(size, align, skip)
        assert {(r["geo_value"], at[r["time_value"]]): r["s"] for r in got} == pytest.approx(want)


def test_python_path_equals_native_path(spark):
    p = make(spark, "day")
    native = {(r[0], r[1]): r["s"] for r in p.roll_sum("value", 5, align="center", new_names=["s"]).df.collect()}
    f = lambda w, key, t: None if w["value"].isna().any() else float(w["value"].sum())
    python = {(r[0], r[1]): r["slide_value"] for r in p.slide_python(f, "double", 5, align="center").df.collect()}
    assert python == pytest.approx(native)
    running = lambda w, key, t: float(len(w))
    sizes = {(r[0], r[1]): r["slide_value"] for r in p.slide_python(running, "double", INF).df.collect()}
    assert sizes["c", dt.date(2020, 1, 16)] == 16.0


def test_python_path_struct_and_reference_times(spark):
    p = make(spark, "day")
    f = lambda w, key, t: {"n": len(w), "geo": key[0]}
    out = p.slide_python(f, "struct<n:int,geo:string>", 3, ref_times=[dt.date(2020, 1, 20)]).df.collect()
    assert {(r["geo_value"], r["n"], r["geo"]) for r in out} == {("a", 3, "a"), ("b", 3, "b"), ("c", 3, "c")}
    with pytest.raises(PanelError):
        p.slide_python(lambda w: 1, "int", 3)


@pytest.mark.parametrize("f, value", [("mean", 2.0), ("sum", 6.0), ("prod", 6.0), ("min", 1.0), ("max", 3.0), ("median", 2.0)])
def test_functions(spark, f, value):
    data = [("a", dt.date(2020, 1, i), v) for i, v in enumerate([1.0, 2.0, 3.0, None, 5.0], 1)]
    p = Panel.from_df(spark.createDataFrame(data, "geo_value string, time_value date, value double"))
    got = [r["x"] for r in p.roll("value", f, 3, new_names=["x"]).df.orderBy("time_value").collect()]
    assert got[:2] == [None, None] and got[2] == value and got[3:] == [None, None]


def test_all_missing_with_skip(spark):
    data = [("a", dt.date(2020, 1, 1), None), ("a", dt.date(2020, 1, 2), None)]
    p = Panel.from_df(spark.createDataFrame(data, "geo_value string, time_value date, value double"))
    out = {f: p.roll("value", f, 2, skip_nulls=True, new_names=["x"]).df.first()["x"] for f in ("mean", "sum", "prod", "min", "max")}
    assert np.isnan(out["mean"]) and out["sum"] == 0 and out["prod"] == 1 and out["min"] == np.inf and out["max"] == -np.inf


def test_three_valued_logic(spark):
    data = [("a", dt.date(2020, 1, i), v) for i, v in enumerate([True, None, False, True, True], 1)]
    p = Panel.from_df(spark.createDataFrame(data, "geo_value string, time_value date, b boolean"))
    every = [r["x"] for r in p.roll("b", "all", 2, new_names=["x"]).df.orderBy("time_value").collect()]
    some = [r["x"] for r in p.roll("b", "any", 2, new_names=["x"]).df.orderBy("time_value").collect()]
    assert every == [None, None, False, False, True]
    assert some == [True, True, None, True, True]


def test_names(spark):
    p = make(spark, "day").mutate(b=F.col("value") > 1)
    assert "value_7dav" in p.roll_mean("value", 7).df.columns
    assert "value_14dcmin" in p.roll("value", "min", 14, align="center").df.columns
    assert "value_running_sum" in p.roll_sum("value", INF).df.columns
    assert "b_7dprop" in p.roll_mean("b", 7).df.columns and "b_7dlcount" in p.roll_sum("b", 7, align="left").df.columns
    assert "value_2wprod" in make(spark, "week").roll("value", "prod", dt.timedelta(weeks=2)).df.columns
    assert "x_value" in p.roll_mean("value", 7, prefix="x_").df.columns
    with pytest.raises(PanelError, match="letter"):
        make(spark, "integer").roll_mean("value", 7)
    with pytest.raises(PanelError, match="exist"):
        p.roll_mean("value", 7, new_names=["b"])
    with pytest.raises(PanelError, match="either"):
        p.roll_mean("value", 7, new_names=["z"], prefix="p")
    with pytest.raises(PanelError, match="repeat"):
        p.roll_mean(["value", "b"], 7, new_names=["z", "z"])


def test_reference_times(spark):
    p = make(spark, "day")
    t = dt.date(2020, 1, 20)
    only = p.roll_sum("value", 3, skip_nulls=True, new_names=["s"], ref_times=[t]).df.collect()
    every = p.roll_sum("value", 3, skip_nulls=True, new_names=["s"], ref_times=[t], all_rows=True).df.collect()
    assert len(only) == 3 and len(every) == 89
    assert {(r[0], r["s"]) for r in every if r["time_value"] == t} == {(r[0], r["s"]) for r in only}
    assert all(r["s"] is None for r in every if r["time_value"] != t)
    for bad in ([t, t], [dt.date(1999, 1, 1)]):
        with pytest.raises(PanelError):
            p.roll_sum("value", 3, ref_times=bad)


def test_errors(spark):
    p = make(spark, "day")
    with pytest.raises(PanelError):
        p.group_by("value").roll_mean("value", 3)
    with pytest.raises(PanelError):
        p.filter("value < -1").roll_mean("value", 3)
    with pytest.raises(PanelError):
        p.roll("value", "mode", 3)
    with pytest.raises(PanelError):
        p.slide({"x": None}, 3)
    assert p.filter("value < -1").slide({"x": F.sum("value")}, 3).df.count() == 0


def test_expression_slides(spark):
    p = make(spark, "day")
    out = p.slide({"lo": F.min("value"), "hi": F.max("value")}, 3, pack_as="range").df
    assert out.select("range.hi").columns == ["hi"]
    one = p.slide({"n": F.count("value")}, 3).df.where("geo_value = 'b' and time_value = date'2020-01-20'").first()
    assert one["n"] == 2


def test_other_keys(spark):
    data = [(g, a, dt.date(2020, 1, d), float(d)) for g, a, d in itertools.product((1, 2), (1, 2), range(1, 6))]
    p = Panel.from_df(spark.createDataFrame(pd.DataFrame(data, columns=["geo_value", "age", "time_value", "value"]), "geo_value int, age int, time_value date, value double"), other_keys=["age"])
    got = p.roll_sum("value", 2, new_names=["s"]).df.where("time_value = date'2020-01-05'").collect()
    assert [r["s"] for r in got] == [9.0] * 4


@pytest.mark.parametrize("time_type", ["day", "week", "yearmonth"])
def test_split_series_give_the_same(spark, time_type):
    p = make(spark, time_type)
    size = dt.timedelta(weeks=7) if time_type == "week" else 7
    for align, split in (("right", 4), ("center", 5), ("left", 11)):
        whole = p.roll_sum("value", size, align=align, new_names=["s"], validate=False).df.collect()
        parts = p.roll_sum("value", size, align=align, new_names=["s"], validate=False, split=split).df.collect()
        assert sorted(whole, key=str) == sorted(parts, key=str)
    running = lambda **k: sorted(p.roll_sum("value", INF, new_names=["s"], validate=False, **k).df.collect(), key=str)
    assert running() == running(split=3)
