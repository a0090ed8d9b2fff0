"""Storage by base and delta, versions as a table, replay of histories in chunks, and running results in two levels."""

import datetime as dt
import os
import random
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from revpanel import INF, PanelError, RevisionLog
from revpanel.operators import replay
from revpanel.operators.replay import Versions, snapshots
from revpanel.operators.scan import running
from revpanel.operators.versions import grid, ranked
from revpanel.sources import store
from revpanel.sources.store import append_log, read_log, read_snapshot, write_log

D = dt.date(2020, 1, 1)


def day(n):
    return D + dt.timedelta(days=n)


def make_rows(seed=1, n=400, last=120):
    rng, rows = random.Random(seed), {}
    for _ in range(n):
        t = rng.randrange(last - 10)
        rows[rng.choice("abc"), day(t), day(t + rng.randrange(10))] = rng.choice([None, *range(50)])
    return [(*k, v) for k, v in sorted(rows.items())]


def make_log(spark, rows, **kw):
    df = spark.createDataFrame(rows, "geo_value string, time_value date, version date, x int").repartition(3)
    return RevisionLog.from_df(df, geo_type="custom", time_type="day", compact=False, **kw)


def brute_as_of(rows, v):
    found = {}
    for g, t, ver, x in sorted(rows, key=lambda r: r[2]):
        if ver <= v:
            found[g, t] = x
    return found


def got_panel(p):
    return {(r["geo_value"], r["time_value"]): r["x"] for r in p.df.collect()}


def files_read(df):
    """The files that a scan opens after pruning, and their bytes."""
    names = [r[0].removeprefix("file://") for r in df.select(F.input_file_name()).distinct().collect()]
    return len(names), sum(os.path.getsize(n) for n in names)


# Storage


@pytest.mark.parametrize("bucket, every", [(9, 2), (32, 8), (40, 1)])
def test_snapshots_from_base_and_delta(spark, tmp_path, bucket, every):
    rows, path = make_rows(), str(tmp_path / "log")
    log = make_log(spark, rows)
    write_log(log, path, bucket=bucket, base_every=every)
    for v in (0, 40, 77, 118):
        if day(v) <= log.meta.versions_end:
            assert got_panel(read_snapshot(spark, path, day(v))) == brute_as_of(rows, day(v))
            # A reader of a part of the history needs no width of a bucket.
            assert read_log(spark, path, through=day(v)).df.count() == sum(r[2] <= day(v) for r in rows)
    assert got_panel(read_snapshot(spark, path)) == brute_as_of(rows, log.meta.versions_end)
    back = read_log(spark, path)
    assert back.meta == log.meta and sorted(map(repr, back.df.collect())) == sorted(map(repr, log.df.collect()))
    with pytest.raises(PanelError):
        read_snapshot(spark, path, day(4000))
    with pytest.raises(PanelError):
        write_log(log, path)
    write_log(log, path, mode="overwrite")


def test_appended_changes(spark, tmp_path):
    """A log that grows by appends is the log written at once; what bases cover is refused."""
    rows, path = sorted(make_rows(2), key=lambda r: r[2]), str(tmp_path / "log")
    parts = [[r for r in rows if lo <= r[2] < hi] for lo, hi in ((day(0), day(30)), (day(30), day(31)), (day(31), day(90)), (day(90), day(999)))]
    write_log(make_log(spark, parts[0]), path, bucket=10, base_every=2)
    for part in parts[1:]:
        append_log(spark.createDataFrame(part, "geo_value string, time_value date, version date, x int"), path)
    for v in (20, 61, 100):
        assert got_panel(read_snapshot(spark, path, day(v))) == brute_as_of(rows, day(v))
    assert read_log(spark, path).df.count() == len(rows)
    with pytest.raises(PanelError):
        append_log(spark.createDataFrame(rows[:1], "geo_value string, time_value date, version date, x int"), path)
    append_log(spark.createDataFrame([], "geo_value string, time_value date, version date, x int"), path, versions_end=day(500))
    assert read_log(spark, path).meta.versions_end == day(500)


def test_what_is_read_does_not_grow_with_history(spark, tmp_path):
    """Eight times the history, about the same bytes for the last snapshot; all changes grow."""
    read = {}
    for n in (40, 320):
        df = spark.range(n).select(F.explode(F.sequence(F.lit(0), F.lit(199))).alias("g"), F.col("id").alias("v"))
        df = df.select(F.col("g").cast("string").alias("geo_value"), F.lit(1).alias("time_value"), F.col("v").cast("int").alias("version"), F.xxhash64("g", "v").alias("x"))
        path = str(tmp_path / f"log{n}")
        write_log(RevisionLog.from_df(df, geo_type="custom", time_type="integer", compact=False, versions_end=n - 1, validate=False), path, bucket=4, base_every=5)
        m = store._manifest(spark, path)
        bucket = store._bucket_of(m, n - 1)
        base, above = store._based(spark, path, m, bucket)
        read[n] = files_read(base)[1] + files_read(store._changes(spark, path, m, above, bucket))[1], files_read(store._changes(spark, path, m))[1]
        assert got_panel(read_snapshot(spark, path)).keys() == {(str(g), 1) for g in range(200)}
    assert read[320][0] < 1.5 * read[40][0] and read[320][1] > 5 * read[40][1] and read[320][0] < read[320][1] / 4


def test_a_write_that_fails_leaves_the_state_before(spark, tmp_path, monkeypatch):
    rows, path = make_rows(3), str(tmp_path / "log")
    write_log(make_log(spark, rows), path, bucket=4, base_every=2)
    before = got_panel(read_snapshot(spark, path))

    def fails(*args):
        raise OSError("lost")

    monkeypatch.setattr(store, "_commit", fails)
    with pytest.raises(OSError):
        append_log(spark.createDataFrame([("z", day(1), day(400), 1)], "geo_value string, time_value date, version date, x int"), path)
    assert got_panel(read_snapshot(spark, path)) == before


def test_store_of_a_log_without_rows_and_hot_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FILE_ROWS", 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    empty = make_log(spark, [], versions_end=day(3))
    write_log(empty, str(tmp_path / "e"))
    assert read_snapshot(spark, str(tmp_path / "e")).df.count() == 0 and read_log(spark, str(tmp_path / "e")).df.schema == spark.createDataFrame([], empty.df.schema).schema
    rows = [(f"g{i}", D, D, i) for i in range(200)]
    write_log(make_log(spark, rows), str(tmp_path / "h"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files_read(read_log(spark, str(tmp_path / "h")).df)[0] >= 3


# Versions as a table


def test_grid_of_versions(spark):
    log = make_log(spark, [("a", day(0), day(v), 1) for v in (3, 9, 15, 30)], versions_end=day(36))
    assert [r[0] for r in grid(log).orderBy("__v").collect()] == [day(v) for v in range(3, 37, 3)] == log.default_versions()
    with pytest.raises(PanelError):
        grid(make_log(spark, [("a", day(0), day(3), 1)]))


def test_ranks_among_versions(spark, monkeypatch):
    monkeypatch.setattr("revpanel.operators.versions.WIDTH", 7)
    rng = random.Random(4)
    versions, values = sorted(rng.sample(range(300), 60)), [rng.randrange(-20, 340) for _ in range(100)]
    numbered, ranks = ranked(spark.createDataFrame([(v,) for v in versions], "__v int"), spark.createDataFrame([(v,) for v in values] + [(None,)], "x int"))
    assert sorted((r["__v"], r["__i"]) for r in numbered.collect()) == [(v, i) for i, v in enumerate(versions)]
    assert {r["__at"]: r["__rank"] for r in ranks.collect()} == {x: sum(v < x for v in versions) for x in values}
    words = spark.createDataFrame([("b",), ("d",)], "__v string")
    assert {r["__at"]: r["__rank"] for r in ranked(words, words)[1].collect()} == {"b": 0, "d": 1}


@pytest.mark.parametrize("before", [INF, 7])
def test_snapshots_by_table_and_by_list(spark, before):
    rows = make_rows(5)
    log = make_log(spark, rows)
    listed = [day(v) for v in range(0, 118, 3)]
    table = spark.createDataFrame([(v,) for v in listed], "at date")
    want = sorted(map(repr, snapshots(log, listed, before).collect()))
    assert sorted(map(repr, snapshots(log, table, before).collect())) == want
    expected = sum(before == INF or t >= v - dt.timedelta(7) for v in listed for _, t in brute_as_of(rows, v))
    assert len(want) == expected
    for bad in (table.union(table), table.select(F.lit(None).cast("date")), table.select(F.lit(day(9999))), table.limit(0), table.select(F.lit(1))):
        with pytest.raises(PanelError):
            snapshots(log, bad)


def test_a_hundred_thousand_versions(spark):
    """As many versions as a log may have: one row for each, from a log that changes at a few."""
    df = spark.createDataFrame([("a", 0, v, v) for v in (0, 10, 99_990, 100_000)], "geo_value string, time_value int, version int, x int")
    log = RevisionLog.from_df(df, geo_type="custom", time_type="integer", compact=False)
    table = spark.range(100_001).select(F.col("id").cast("int").alias("v"))
    got = log.slide({"x": F.max("x")}, versions=table).groupBy("x").count().collect()
    assert {r["x"]: r["count"] for r in got} == {0: 10, 10: 99_980, 99_990: 10, 100_000: 1}


# Replay of histories


def brute_histories(rows, versions, by_group, before):
    """{(group, version): (rows known, sum of the snapshot, sum of the one at the version before the last change)}."""
    out = {}
    for v in versions:
        known = [r for r in rows if r[2] <= v and (before == INF or r[1] >= v - dt.timedelta(before))]
        groups = defaultdict(list)
        for r in known:
            groups[r[0] if by_group else None].append(r)
        for g, own in groups.items():
            now = brute_as_of(own, v)
            out[g, v] = (len(own), sum(x or 0 for x in now.values()), sum(x or 0 for x in brute_as_of(own, v - dt.timedelta(2)).values()))
        if not known:
            out[None, v] = (0, 0, 0)
    return out


@pytest.mark.parametrize("by_group, before, chunks", [(True, INF, 8), (False, INF, 3), (True, 4, 5), (False, 3, 200), (True, INF, 1)])
def test_histories(spark, by_group, before, chunks):
    rows = make_rows(6, 250)
    log = make_log(spark, rows)
    versions = [day(v) for v in [*range(-3, 60, 2), *range(100, 118, 5)]]

    def f(history, key, version):
        assert set(history.frame["version"]) <= {x for x in history.frame["version"] if x <= version}
        now, then = history.as_of(version), history.as_of(version - dt.timedelta(2))
        return pd.DataFrame({"n": [len(history.frame)], "now": [float(now["x"].fillna(0).sum())], "then": [float(then["x"].fillna(0).sum())]})

    grouped = log.group_by("geo_value") if by_group else log
    table = spark.createDataFrame([(v,) for v in versions], "v date")
    for chosen in (versions, table):
        got = grouped.slide_python(f, "n long, now double, then double", before=before, versions=chosen, all_versions=True, chunks=chunks).collect()
        found = {(r["geo_value"] if by_group else None, r["version"]): (r["n"], r["now"], r["then"]) for r in got}
        assert len(got) == len(found) and found == brute_histories(rows, versions, by_group, before)


def test_rows_of_histories_do_not_grow_with_versions(spark):
    """Ten times the versions, the same number of rows that go to the tasks, and no nested loop."""
    log, dealt = make_log(spark, make_rows(7, 300)).group_by("geo_value"), {}
    for n in (11, 110):
        versions = [day(i * 110 // n) for i in range(n)]
        rows, calls, _ = replay._dealt(log, INF, Versions.of(log, versions), 4)
        dealt[n] = rows.count(), calls.count()
        plan = log.slide_python(lambda h, k, v: 1, "int", versions=versions, all_versions=True)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert dealt[110][0] <= 1.3 * dealt[11][0] <= 1.3 * 4 * log.df.count() and dealt[110][1] > 5 * dealt[11][1]


# Running results in two levels


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_running_states(spark, width):
    rng = random.Random(8)
    rows = [(g, t, rng.choice([None, *range(-9, 9)])) for g in ("a", None) for t in rng.sample(range(200), 90)]
    df = spark.createDataFrame(rows, "g string, t int, x int")
    kinds = {"n": ("count", F.col("x")), "s": ("sum", F.col("x")), "lo": ("min", F.col("x")), "hi": ("max", F.col("x")), "e": ("all", F.col("x") > -8), "o": ("any", F.col("x") > 7)}
    got = {(r["g"], r["t"]): tuple(r[k] for k in kinds) for r in running(df, ["g"], ["t"], F.floor(F.col("t") / width), kinds).collect()}
    for g in ("a", None):
        so_far = []
        for _, t, x in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            so_far += [] if x is None else [x]
            want = (len(so_far), sum(so_far), min(so_far), max(so_far), min(so_far) > -8, max(so_far) > 7) if so_far else (0, None, None, None, None, None)
            assert got[g, t] == want
