"""Revision logs: snapshots, compaction, bounds, merging, replay and revision analysis."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from revpanel import PanelError, RevisionLog
from revpanel.log import locf_flags
from revpanel.operators.plotting import log_plot_data, panel_plot_data
from revpanel.operators.replay import snapshots
from revpanel.sources.tables import read_log, read_panel, write_log, write_panel
from revpanel.streaming.ingest import append_changes, stream_into_log

D = dt.date(2020, 1, 1)


def day(n):
    return D + dt.timedelta(days=n)


def log(spark, rows, columns="value int", geo="geo_value string", **kw):
    df = spark.createDataFrame(rows, f"{geo}, time_value date, version date, {columns}")
    return RevisionLog.from_df(df, time_type="day", **kw)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=str)


J = dt.date(2020, 6, 1)
CASES = [("ca", J + dt.timedelta(t), J + dt.timedelta(v), n) for t, v, n in [(0, 0, 1), (0, 1, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 1), (3, 3, 4)]]


def test_snapshots(spark):
    x = log(spark, CASES, "cases int")
    assert [r[1] for r in rows(x.as_of(J + dt.timedelta(2)).df, "time_value", "cases")] == [2, 1, 1]
    assert x.as_of(J + dt.timedelta(2)).meta.as_of == J + dt.timedelta(2)
    assert x.as_of_current().df.count() == 4
    assert x.as_of(J + dt.timedelta(2), min_time=J + dt.timedelta(1)).df.count() == 2
    assert x.as_of(J - dt.timedelta(2)).df.count() == 0
    cut = x.truncate_versions_after(J + dt.timedelta(1))
    assert cut.df.count() == 3 and cut.meta.versions_end == J + dt.timedelta(1)
    assert x.as_of(J + dt.timedelta(1), all_versions=True).df.count() == 3
    with pytest.raises(PanelError):
        x.as_of(J + dt.timedelta(9))
    with pytest.raises(PanelError):
        x.as_of("2020-06-02")


def test_bounds(spark):
    with pytest.raises(PanelError, match="before the version"):
        log(spark, CASES, "cases int", versions_end=J)
    with pytest.raises(PanelError, match="after versions_end"):
        log(spark, CASES, "cases int", clobberable_start=J + dt.timedelta(9))
    x = log(spark, CASES, "cases int", clobberable_start=J + dt.timedelta(2))
    with pytest.warns(UserWarning, match="overwritten"):
        x.as_of(J + dt.timedelta(3))
    assert x.truncate_versions_after(J + dt.timedelta(1)).meta.clobberable_start is None
    with pytest.raises(PanelError, match="several rows"):
        log(spark, CASES + CASES[:1], "cases int")
    with pytest.raises(PanelError, match="null"):
        log(spark, [("ca", J, None, 1)], "cases int")
    assert x.with_versions_end(J + dt.timedelta(30)).meta.versions_end == J + dt.timedelta(30)


def test_filter(spark):
    x = log(spark, CASES, "cases int")
    assert x.filter("time_value > date'2020-06-02'").df.count() == 2
    assert x.filter(F.col("geo_value") == "ny").df.count() == 0
    for bad in ("version < date'2020-06-02'", "cases > 1"):
        with pytest.raises(PanelError):
            x.filter(bad)
    with pytest.raises(PanelError):
        x.filter(x.df["version"] < J)
    kept = x.filter("cases > 1", format_aware=True)
    assert kept.df.count() == 3 and kept.meta.versions_end == x.meta.versions_end


def test_compaction(spark):
    drift = [(1, D, day(10 + i), 1000 + i) for i in range(1, 6)]
    x = log(spark, drift, geo="geo_value int", abs_tol=3)
    assert rows(x.df, "version") == [(day(11),)] and x.meta.versions_end == day(15)
    keys = [(1, day(i), day(10 + i), 1000 + i) for i in range(1, 6)]
    assert log(spark, keys, geo="geo_value int", abs_tol=3).df.count() == 5
    lagged = [(*r, str(i)) for i, r in enumerate(drift)]
    assert log(spark, lagged, "value int, lag string", geo="geo_value int", abs_tol=3).df.count() == 5
    with pytest.warns(UserWarning, match="dropped 1 of 2"):
        log(spark, [("a", D, day(1), 1), ("a", D, day(2), 1)], compact="message")


def test_compact_log_has_the_same_snapshots(spark):
    data = [("a", day(t), day(v), (t * v) // 3) for t in range(4) for v in range(t, 9)]
    loose, tight = log(spark, data, compact=False), log(spark, data)
    assert tight.df.count() < loose.df.count()
    assert loose.redundant().count() == loose.df.count() - tight.df.count()
    for v in range(9):
        assert rows(loose.as_of(day(v)).df) == rows(tight.as_of(day(v)).df)


def test_locf_flags(spark):
    values = [1.0, 1.0, 1e-10, 1.1e-10, None, None, float("nan"), float("nan")]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, version int, v double")
    got = [r["f"] for r in df.withColumn("f", locf_flags(df, ["k"], ["v"], 1.5e-8)).orderBy("version").collect()]
    assert got == [False, True, False, True, False, True, True, True]


def test_fill_through_version(spark):
    x = log(spark, [("ak", D, day(i), i) for i in range(1, 6)] + [("ak", day(1), day(2), 6)])
    na = x.fill_through_version(day(10), "na")
    assert rows(na.as_of(day(6)).df, "time_value", "value") == sorted([(D, None), (day(1), None)], key=str)
    locf = x.fill_through_version(day(10), "locf")
    assert rows(locf.as_of(day(9)).df) == rows(x.as_of(day(5)).df)
    assert x.fill_through_version(day(2)) is x
    with pytest.raises(PanelError):
        x.fill_through_version(day(10), "zero")


A = dt.date(2024, 8, 1)


def aug(n):
    return dt.date(2024, 8, n)


def test_merge_carries_forward(spark):
    x = log(spark, [("ak", aug(1), aug(1), "XA"), ("ak", aug(1), aug(2), "XB"), ("ak", aug(2), aug(2), "XC")], "x string")
    y = log(spark, [("ak", aug(1), aug(3), "YA"), ("ak", aug(2), aug(3), "YB")], "y string")
    got = rows(x.merge(y, sync="locf").df, "time_value", "version", "x", "y")
    assert got == sorted([(aug(1), aug(1), "XA", None), (aug(1), aug(2), "XB", None), (aug(1), aug(3), "XB", "YA"), (aug(2), aug(2), "XC", None), (aug(2), aug(3), "XC", "YB")], key=str)


def test_merge_carries_nulls(spark):
    x = log(spark, [("ak", day(6), day(1), "E1"), ("ak", day(6), day(3), None), ("ak", day(6), day(5), "E5")], "x string")
    y = log(spark, [("ak", day(6), day(i), f"Y{i}") for i in range(1, 6)], "y string")
    assert [r[1] for r in rows(x.merge(y).df, "version", "x")] == ["E1", "E1", None, None, "E5"]


@pytest.mark.parametrize(
    "sync, expected, end",
    [("na", [(1, 10, None), (4, None, None), (5, None, 20)], 5), ("locf", [(1, 10, None), (5, 10, 20)], 5), ("truncate", [(1, 10, None)], 3)],
)
def test_merge_sync(spark, sync, expected, end):
    x = log(spark, [("ak", D, day(1), 10)], "x int", versions_end=day(3))
    y = log(spark, [("ak", D, day(5), 20)], "y int")
    out = x.merge(y, sync=sync)
    assert sorted((((r["version"] - D).days, r["x"], r["y"]) for r in out.df.collect()), key=str) == sorted(expected, key=str)
    assert out.meta.versions_end == day(end)
    with pytest.raises(PanelError, match="observed"):
        x.merge(y)
    with pytest.raises(PanelError, match="both"):
        x.merge(x)


BINARY = {4: {1: 2, 2: 4, 3: 8}, 5: {1: 16, 2: 32, 4: 64}, 6: {1: 128, 2: 256, 4: 512, 5: 1024}, 7: {2: 2048, 3: 4096, 4: 8192, 5: 16384, 6: 32768}}


def binary_log(spark):
    return log(spark, [("ak", day(t), day(v), float(n)) for v, cells in BINARY.items() for t, n in cells.items()], "binary double")


def test_replay(spark):
    x = binary_log(spark).group_by("geo_value")
    want = [("ak", day(4), 12.0), ("ak", day(5), 72.0), ("ak", day(6), 1536.0), ("ak", day(7), 49152.0)]
    assert rows(x.slide({"s": F.sum("binary")}, before=2)) == want
    f = lambda data, key, v: pd.DataFrame({"s": [float(data["binary"].sum())]})
    assert rows(x.slide_python(f, "s double", before=2)) == want
    # against one snapshot after the other
    for v in (4, 5, 6, 7):
        snap = x.as_of(day(v)).df.where(F.col("time_value") >= day(v - 2)).agg(F.sum("binary")).first()[0]
        assert ("ak", day(v), snap) in want


def test_replay_of_histories(spark):
    x = binary_log(spark).group_by("geo_value")
    f = lambda past, key, v: pd.DataFrame({"n": [len(past.frame)], "first": [float(past.as_of(day(4))["binary"].sum())]})
    got = rows(x.slide_python(f, "n long, first double", versions=[day(5), day(7)], all_versions=True))
    assert got == [("ak", day(5), 6, 14.0), ("ak", day(7), 15, 14.0)]
    nested = lambda past, key, v: past.slide(lambda d, k, w: float(len(d)), [day(4), v])[["slide_value"]].rename(columns={"slide_value": "n"})
    assert len(rows(x.slide_python(nested, "n double", versions=[day(6)], all_versions=True))) == 2


def test_replay_edges(spark):
    x = binary_log(spark).group_by("geo_value")
    # no rows yet: one computation of nothing, with a null group
    assert rows(x.slide({"n": F.count("binary")}, versions=[day(1), day(4)])) == sorted([(None, day(1), 0), ("ak", day(4), 3)], key=str)
    none = lambda data, key, v: pd.DataFrame({"n": pd.Series(dtype=float)})
    assert rows(x.slide_python(none, "n double")) == []
    assert rows(x.slide({"n": F.count("*")}, versions=[day(4)], new_name="p").select("p.n")) == [(3,)]
    with pytest.raises(PanelError):
        x.slide({"n": F.count("*")}, versions=[])
    with pytest.raises(PanelError):
        x.slide({"n": F.count("*")}, versions=[day(99)])
    assert x.default_versions() == [day(4), day(5), day(6), day(7)]
    assert snapshots(x, [day(7)]).count() == 6


def test_unused_levels(spark):
    base = dt.date(2000, 1, 1)
    at = lambda n: base + dt.timedelta(days=n - 1)
    df = spark.createDataFrame([("us", "adult", at(1), at(2), 121.0), ("us", "pediatric", at(2), at(3), 5.0), ("us", "adult", at(1), at(3), 125.0), ("us", "adult", at(2), at(3), 130.0)], "geo_value string, age_group string, time_value date, version date, value double")
    x = RevisionLog.from_df(df, other_keys=["age_group"], time_type="day")
    total = {"s": F.coalesce(F.sum("value"), F.lit(0.0))}
    levels = {"age_group": ["pediatric", "adult"]}
    got = rows(x.group_by("geo_value", "age_group", drop=False, levels=levels).slide(total, before=10))
    assert got == sorted([("us", "pediatric", at(2), 0.0), ("us", "adult", at(2), 121.0), ("us", "pediatric", at(3), 5.0), ("us", "adult", at(3), 255.0)], key=str)
    got = rows(x.group_by("age_group", "geo_value", drop=False, levels=levels).slide(total, before=10))
    assert got == sorted([("pediatric", None, at(2), 0.0), ("adult", "us", at(2), 121.0), ("pediatric", "us", at(3), 5.0), ("adult", "us", at(3), 255.0)], key=str)
    assert x.group_by("geo_value", "age_group").ungroup("geo_value").groups == ("age_group",)
    with pytest.raises(PanelError):
        x.group_by("version")
    with pytest.raises(PanelError):
        x.group_by(geo_value=F.lit(1))


REVISED = {
    ("ak", 1): {3: 1, 5: None, 6: 1, 7: 5, 8: 6, 9: 7, 20: 102}, ("ak", 2): {6: 100, 7: 91}, ("ak", 3): {6: 0, 7: 0},
    ("al", 1): {1: 1, 10: 1, 20: 100}, ("al", 2): {2: 1}, ("al", 3): {4: 1, 5: 4}, ("al", 4): {4: None, 5: 9},
}


def revised(spark):
    jan = lambda n: dt.date(2020, 1, n)
    data = [(g, jan(t), jan(v), None if x is None else float(x)) for (g, t), cells in REVISED.items() for v, x in cells.items()]
    return log(spark, data, "value double", compact=False, versions_end=dt.date(2022, 1, 1))


def test_revision_analysis(spark):
    table = revised(spark).revision_analysis("value", only_table=True)
    got = {(r["geo_value"], r["time_value"].day): tuple(r)[2:] for r in table.collect()}
    want = {
        ("ak", 1): (4, 2, 19, 19, 101, 101 / 102, 1, 102, 6), ("ak", 2): (1, 4, 5, 4, 9, 0.09, 91, 100, 95.5), ("ak", 3): (0, 3, 3, 3, 0, math.nan, 0, 0, 0),
        ("al", 1): (1, 0, 19, 19, 99, 0.99, 1, 100, 50.5), ("al", 2): (0, 0, 0, 0, 0, 0, 1, 1, 1), ("al", 3): (1, 1, 2, 2, 3, 0.75, 1, 4, 2.5), ("al", 4): (0, 1, 1, 1, 0, 0, 9, 9, 9),
    }
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, nan_ok=True), k


def test_revision_analysis_with_nulls(spark):
    got = {(r["geo_value"], r["time_value"].day): r for r in revised(spark).revision_analysis("value", drop_nulls=False, only_table=True).collect()}
    assert got["ak", 1]["n_revisions"] == 6 and got["ak", 1]["median_value"] == 5.5
    assert got["al", 4]["n_revisions"] == 1 and got["al", 4]["min_lag"] == 0


def test_revision_summary(spark):
    out = revised(spark).revision_analysis()
    row = out.summary().first()
    assert (row["n_cells"], row["n_unrevised"], row["n_revised"], row["n_few"]) == (7, 3, 4, 6)
    assert "out of 7" in out.show()
    assert out.totals()["total_null"] == 2


def test_waiting_period(spark):
    x = log(spark, [("a", day(0), day(1), 1), ("a", day(30), day(31), 1)], versions_end=day(60))
    assert x.revision_analysis("value", only_table=True).count() == 1
    assert x.revision_analysis("value", min_waiting_period=None, only_table=True).count() == 2


def test_files_round_trip(spark, tmp_path):
    x = binary_log(spark)
    write_log(x, str(tmp_path / "log"), bucket=2)
    back = read_log(spark, str(tmp_path / "log"))
    assert rows(back.df, *x.df.columns) == rows(x.df) and back.meta == x.meta
    # The width of a bucket is the store's to know.
    assert read_log(spark, str(tmp_path / "log"), through=day(5)).df.count() == 6
    p = x.as_of_current()
    write_panel(p, str(tmp_path / "panel"))
    assert rows(read_panel(spark, str(tmp_path / "panel")).df, *p.df.columns) == rows(p.df)


def test_appending_changes(spark, tmp_path):
    cell = ["geo_value", "time_value"]
    first = spark.createDataFrame([("a", D, day(1), 1), ("a", D, day(2), 1)], "geo_value string, time_value date, version date, value int")
    assert append_changes(first, None, cell).count() == 1
    later = spark.createDataFrame([("a", D, day(3), 1), ("a", D, day(4), 2)], first.schema)
    assert rows(append_changes(later, first, cell), "version") == [(day(4),)]
    source, out = str(tmp_path / "in"), str(tmp_path / "log")
    for k, part in enumerate((first, later)):
        part.coalesce(1).write.mode("append").parquet(source)
        updates = spark.readStream.schema(first.schema).parquet(source)
        stream_into_log(updates, out, cell, str(tmp_path / "cp")).awaitTermination(60)
    assert rows(spark.read.parquet(out), "version", "value") == [(day(1), 1), (day(4), 2)]


def test_plot_data(spark):
    x = binary_log(spark)
    assert log_plot_data(x, "binary", [day(5)]).groupBy("version").count().count() == 2
    with pytest.warns(UserWarning):
        assert panel_plot_data(x.as_of_current()).count() == 6
    with pytest.raises(PanelError):
        panel_plot_data(x.as_of_current(), ["geo_value"])
