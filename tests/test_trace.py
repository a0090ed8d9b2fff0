"""Functions of windows traced into expressions: the rows of slide_python, without Python in the plan."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from revpanel import Panel, PanelError

D = dt.date(2020, 1, 1)

TRACED = {
    "sum": (lambda w, k, t: w["x"].sum(), "long"),
    "mean": (lambda w, k, t: w.y.mean(), "double"),
    "ratio": (lambda w, k, t: w["x"].sum() / w["y"].sum(), "double"),
    "by zero": (lambda w, k, t: w["x"].sum() / (w["x"].sum() - w["x"].sum()), "double"),
    "spread": (lambda w, k, t: 2 * (w.x.max() - w.x.min()) + 1, "double"),
    "moments": (lambda w, k, t: w.y.std() / (1 + w.y.var()), "double"),
    "median": (lambda w, k, t: -w.y.median() + w.y.quantile(0.25), "double"),
    "rows": (lambda w, k, t: (w["x"] * w["y"] - 3).sum(), "double"),
    "numpy": (lambda w, k, t: np.log1p(np.abs(w["x"]).sum()) + np.sqrt(np.square(w["y"]).mean()), "double"),
    "flags": (lambda w, k, t: (w["x"] > 2).sum() + w["x"].count(), "long"),
    "any": (lambda w, k, t: (w["y"] <= -1).any(), "boolean"),
    "constant": (lambda w, k, t: 7, "int"),
    "fields": (lambda w, k, t: {"a": w.x.sum(), "b": np.maximum(w.y.max(), 0.5)}, "a long, b double"),
}
NOT_TRACED = {
    "length": (lambda w, k, t: len(w), "long"),
    "branch": (lambda w, k, t: 1 if w["x"].sum() > 3 else 0, "long"),
    "key": (lambda w, k, t: k[0], "string"),
    "time": (lambda w, k, t: t.day + w["x"].sum(), "long"),
    "share of slots": (lambda w, k, t: float((w["x"] > 2).mean()), "double"),
    "beside an aggregate": (lambda w, k, t: (w["y"] - w["y"].mean()).abs().max(), "double"),
    "value": (lambda w, k, t: float(np.nan_to_num(w["x"].iloc[-1])), "double"),
    "other library": (lambda w, k, t: math.floor(w["x"].sum()), "long"),
}


def panel(spark, n=60):
    rng, rows = random.Random(3), []
    for g in "ab":
        for i in range(n):
            if rng.random() < 0.8:
                rows.append((g, D + dt.timedelta(i), rng.choice([None, *range(-4, 9)]), rng.choice([None, float("nan"), *np.linspace(-2, 2, 9).tolist()])))
    return Panel.from_df(spark.createDataFrame(rows, "geo_value string, time_value date, x int, y double"), geo_type="custom", time_type="day")


def plain(r):
    return tuple(None if isinstance(v, float) and v != v else round(v, 8) + 0.0 if isinstance(v, float) else v for v in r)


def rows(p):
    return sorted(map(plain, p.df.collect()), key=repr)


@pytest.mark.parametrize("name", TRACED)
@pytest.mark.parametrize("align", ["right", "center"])
def test_traced_functions(spark, name, align):
    f, schema = TRACED[name]
    p = panel(spark)
    got = p.slide_function(f, schema, 5, align)
    assert "InPandas" not in got.df._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == rows(p.slide_python(f, schema, 5, align))


@pytest.mark.parametrize("name", NOT_TRACED)
def test_what_has_no_expression_runs_in_python(spark, name):
    f, schema = NOT_TRACED[name]
    p = panel(spark, 20)
    got = p.slide_function(f, schema, 5)
    assert "InPandas" in got.df._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == rows(p.slide_python(f, schema, 5))


def test_arguments_are_those_of_slides(spark):
    p = panel(spark, 20)
    times = [D + dt.timedelta(i) for i in (3, 9)]
    times = [t for t in times if p.df.where(f"time_value = date'{t}'").count()]
    f = lambda w, k, t: w["x"].sum()
    for all_rows in (False, True):
        assert rows(p.slide_function(f, "long", 4, ref_times=times, all_rows=all_rows)) == rows(p.slide_python(f, "long", 4, ref_times=times, all_rows=all_rows))
    with pytest.raises(PanelError):
        p.slide_function(lambda w: 1, "long", 4)
    with pytest.raises(PanelError):
        p.slide_function(f, "long", 4, new_name="x")
