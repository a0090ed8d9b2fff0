"""Construction, verbs, inference, completion and aggregation of panels."""

import datetime as dt
import warnings

import pytest
from pyspark.sql import functions as F

from revpanel import Panel, PanelError, guess_period
from revpanel.functions import time as tm
from revpanel.meta import guess_geo_type, guess_time_type, time_column_names
from revpanel.operators.completion import fill_forward, has_gaps
from revpanel.operators.joins import asof_join

D = dt.date(2020, 1, 1)


def day(n):
    return D + dt.timedelta(days=n)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize(
    "values, kind, expected",
    [
        (["ca", "NY"], "string", "state"), (["ca", "us", "uk"], "string", "nation"), (["12345", "67890"], "string", "county"),
        ([1, 2, 3], "int", "hhs"), ([100, 200], "int", "hrr"), ([123456789], "int", "custom"), (["123456789"], "string", "custom"), (["free text"], "string", "custom"),
    ],
)
def test_geo_types(spark, values, kind, expected):
    assert guess_geo_type(frame(spark, [(v,) for v in values], f"geo_value {kind}")) == expected


@pytest.mark.parametrize(
    "days, expected",
    [([0, 1, 2, 3, 4, 5, 6], "day"), ([0, 7, 14], "week"), ([5], "day"), ([1, 2, 3, 4, 5, 6, 8, 9, 11, 15], "day"), ([7 * i for i in (1, 2, 3, 4, 5, 6, 8, 9, 11, 15)], "week")],
)
def test_time_types(spark, days, expected):
    assert guess_time_type(frame(spark, [(day(n),) for n in days], "time_value date")) == expected


def test_other_time_types(spark):
    assert guess_time_type(frame(spark, [(1999,), (2000,)], "time_value int")) == "integer"
    with pytest.raises(PanelError, match="month"):
        guess_time_type(frame(spark, [(D,), (dt.date(2020, 2, 1),), (dt.date(2020, 3, 1),)], "time_value date"))
    with pytest.warns(UserWarning, match="unsupported"):
        assert guess_time_type(frame(spark, [("x",)], "time_value string")) == "custom"


def test_periods():
    assert guess_period([1, 8]) == 7
    assert guess_period([0, 7, 14, 15]) == 1
    assert guess_period([0, 4, 10]) == 2
    assert guess_period([day(0), day(7), day(21)]) == 7
    with pytest.raises(PanelError):
        guess_period([3, 3])


def test_full_sequences():
    assert tm.full_seq([day(0), day(4)], 2) == [day(0), day(2), day(4)]
    assert tm.full_seq([3, 9, 5], 2) == [3, 5, 7, 9]
    with pytest.raises(PanelError):
        tm.full_seq([1, 4], 2)


def test_steps():
    assert tm.to_steps(dt.timedelta(weeks=3), "week") == 3
    with pytest.raises(PanelError):
        tm.to_steps(dt.timedelta(days=3), "week")
    assert tm.ceiling_steps(dt.timedelta(days=31), "yearmonth") == 2
    assert tm.before_after(6, "center") == (3, 2)
    assert tm.before_after(7, "left") == (0, 6)
    assert tm.format_steps(1, "yearmonth") == "1 month"
    assert tm.shift(dt.date(2020, 11, 1), 3, "yearmonth") == dt.date(2021, 2, 1)
    for bad in (7, dt.timedelta(days=3)):
        with pytest.raises(PanelError):
            tm.window_steps(bad, "week")
    for bad in (0, 1.5, -1):
        with pytest.raises(PanelError):
            tm.window_steps(bad, "day")
    with pytest.raises(PanelError):
        tm.before_after(tm.INF, "left")


def test_column_guessing_and_uniqueness(spark):
    df = frame(spark, [("ca", D, 1), ("ny", D, 2)], "State string, Target_Date date, cases int")
    p = Panel.from_df(df, as_of=day(3))
    assert p.df.columns == ["geo_value", "time_value", "cases"]
    assert (p.meta.geo_type, p.meta.time_type, p.meta.as_of) == ("state", "day", day(3))
    with pytest.raises(PanelError, match="could all be"):
        Panel.from_df(df.withColumn("county", F.lit("x")))
    with pytest.raises(PanelError, match="no column"):
        Panel.from_df(df.drop("Target_Date"))
    with pytest.raises(PanelError, match="several rows"):
        Panel.from_df(df.union(df))
    assert "Date_Time" in time_column_names()
    assert Panel.from_df(df.withColumn("issue", F.lit(day(9)))).meta.as_of == day(9)


def test_verbs_keep_or_drop_the_class(spark):
    df = frame(spark, [("ca", 1, D, 5), ("ca", 2, D, 6), ("ny", 1, day(1), 7)], "geo_value string, age int, time_value date, n int")
    p = Panel.from_df(df, other_keys=["age"])
    assert isinstance(p.filter("n > 5"), Panel)
    assert p.drop("age").meta.other_keys == ()
    assert not isinstance(p.select("geo_value", "n"), Panel)
    assert p.rename({"age": "group"}).meta.other_keys == ("group",)
    assert p.key_columns(exclude=["time_value"]) == ["geo_value", "age"]
    with pytest.raises(PanelError):
        p.mean()
    assert p.group_by("geo_value").group_by("age", add=True).groups == ("geo_value", "age")
    packed = p.mutate(x=F.array(F.struct(F.lit(1).alias("a")), F.struct(F.lit(2).alias("a"))))
    assert packed.unnest("x").df.count() == 6
    got = p.group_by("geo_value").group_modify(lambda pdf: pdf.head(1), p.df.schema)
    assert got.df.count() == 2
    assert p.describe().first()["rows_per_time"] == 1


COMPLETE = [(1, day(1), 1.0), (1, day(3), 3.0), (2, day(2), 2.0), (2, day(3), 3.0)]


def completed(spark, data, **kw):
    group = kw.pop("group", False)
    p = Panel.from_df(frame(spark, data, "geo_value int, time_value date, value double"), time_type=kw.pop("time_type", None))
    p = p.group_by("geo_value") if group else p
    return rows(p.complete(**kw).df, "geo_value", "time_value", "value")


def test_complete_all(spark):
    assert completed(spark, COMPLETE) == sorted([(1, day(1), 1.0), (1, day(2), None), (1, day(3), 3.0), (2, day(1), None), (2, day(2), 2.0), (2, day(3), 3.0)], key=str)


def test_complete_groups(spark):
    assert completed(spark, COMPLETE, group=True) == sorted([(1, day(1), 1.0), (1, day(2), None), (1, day(3), 3.0), (2, day(2), 2.0), (2, day(3), 3.0)], key=str)


def test_complete_fill(spark):
    data = [*COMPLETE, (1, day(2), None)]
    assert completed(spark, data, fill={"value": 0.0}, explicit=False) == sorted([(1, day(1), 1.0), (1, day(2), None), (1, day(3), 3.0), (2, day(1), 0.0), (2, day(2), 2.0), (2, day(3), 3.0)], key=str)
    assert (1, day(2), 0.0) in completed(spark, data, fill={"value": 0.0})


def test_complete_weeks(spark):
    data = [(1, day(1), 1.0), (1, day(15), 3.0), (2, day(8), 2.0), (2, day(15), 3.0)]
    full = [(1, day(1), 1.0), (1, day(8), 0.0), (1, day(15), 3.0), (2, day(1), 0.0), (2, day(8), 2.0), (2, day(15), 3.0)]
    assert completed(spark, data, fill={"value": 0.0}) == sorted(full, key=str)
    assert completed(spark, data, fill={"value": 0.0}, group=True) == sorted([r for r in full if r != (2, day(1), 0.0)], key=str)


def test_gaps_and_fill_forward(spark):
    p = Panel.from_df(frame(spark, [(1, day(1), 1.0), (1, day(4), None), (2, day(1), 2.0)], "geo_value int, time_value date, value double"))
    assert rows(p.gaps(), "geo_value", "from_time", "to_time", "n_missing") == [(1, day(2), day(3), 2)]
    assert rows(has_gaps(p), "geo_value", "has_gaps") == [(1, True), (2, False)]
    assert (1, day(4), 1.0) in rows(fill_forward(p, "value").df, "geo_value", "time_value", "value")


def test_sum_groups(spark):
    df = frame(spark, [("a", 1, D, 1), ("a", 2, D, 2), ("b", 1, D, None)], "geo_value string, age int, time_value date, n int")
    p = Panel.from_df(df, other_keys=["age"])
    assert rows(p.sum_groups("n").df, "geo_value", "n") == [("total", None)]
    assert rows(p.sum_groups("n", ["geo_value"]).df, "geo_value", "time_value", "n") == sorted([("a", D, 3), ("b", D, None)], key=str)
    with pytest.raises(PanelError):
        p.sum_groups("n", ["n"])


def test_asof_join(spark):
    left = frame(spark, [("a", 1, 10), ("a", 5, 50), ("b", 1, 11)], "k string, t int, x int")
    right = frame(spark, [("a", 2, "p"), ("a", 5, "q"), ("c", 0, "r")], "k string, t int, y string")
    assert rows(asof_join(left, right, ["k"], "t"), "k", "t", "x", "y") == sorted([("a", 1, 10, None), ("a", 5, 50, "q"), ("b", 1, 11, None)], key=str)
    assert asof_join(left, right, ["k"], "t", "drop").count() == 1
    with pytest.raises(Exception, match="no match"):
        asof_join(left, right, ["k"], "t", "error").collect()


def test_custom_time_refuses_slides(spark):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        p = Panel.from_df(frame(spark, [("a", "x", 1)], "geo_value string, time_value string, n int"))
    with pytest.raises(PanelError):
        p.roll_mean("n", 3)
