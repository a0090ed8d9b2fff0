"""Rank correlations in ranges of values, against brute force: with and without keys, with hot values and ties."""

import datetime as dt
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from revpanel import Panel
from revpanel.operators import correlation

D = dt.date(2020, 1, 1)


def mean_ranks(v):
    v = np.asarray(v)
    return [(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v]


def tau_b(x, y):
    n, score, tx, ty = len(x), 0, 0, 0
    for i in range(n):
        for j in range(i):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            score, tx, ty = score + a * b, tx + (a == 0), ty + (b == 0)
    below = math.sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty))
    return score / below if below else None


def brute(pairs, method):
    pairs = [(x, y) for x, y in pairs if x is not None and y is not None]
    if len(pairs) < 2:
        return None
    x, y = zip(*pairs)
    if method == "kendall":
        return tau_b(x, y)
    a, b = mean_ranks(x), mean_ranks(y)
    return float(np.corrcoef(a, b)[0, 1]) if len(set(a)) > 1 and len(set(b)) > 1 else None


def made(seed, hot):
    rng, rows = random.Random(seed), []
    for g in ("a", "b", "c"):
        for i in range(70 if g != "c" else 1):
            x = 3.0 if rng.random() < hot else rng.choice([None, *map(float, range(12))])
            rows.append((g, D + dt.timedelta(i), x, None if rng.random() < 0.05 else float(rng.randrange(9)) + (x or 0) / 3))
    return rows


@pytest.mark.parametrize("method", ["spearman", "kendall"])
@pytest.mark.parametrize("rows, hot", [(65_536, 0.3), (6, 0.0), (6, 0.4), (20, 0.9)])
def test_rank_correlation_in_ranges(spark, monkeypatch, method, rows, hot):
    monkeypatch.setattr(correlation, "ROWS", rows)
    data = made(3, hot)
    p = Panel.from_df(spark.createDataFrame(data, "geo_value string, time_value date, x double, y double").repartition(3), geo_type="custom", time_type="day")
    groups = defaultdict(list)
    for g, _, x, y in data:
        groups[g].append((x, y))
    got = {r["geo_value"]: r["cor"] for r in p.cor("x", "y", method=method).collect()}
    assert got == {g: brute(v, method) if brute(v, method) is None else pytest.approx(brute(v, method)) for g, v in groups.items()}
    (whole,) = p.cor("x", "y", cor_by=None, method=method).collect()
    assert whole["cor"] == pytest.approx(brute([(x, y) for *_, x, y in data], method))


@pytest.mark.parametrize("dt1, dt2", [(0, 0), (-3, 0), (2, -1)])
def test_shifts_over_the_whole_panel(spark, dt1, dt2):
    data = sorted(made(4, 0.1), key=lambda r: (r[1], r[0]))
    p = Panel.from_df(spark.createDataFrame(data, "geo_value string, time_value date, x double, y double").repartition(3), geo_type="custom", time_type="day")
    at = lambda v, i: v[i] if 0 <= i < len(v) else None
    x, y = [r[2] for r in data], [r[3] for r in data]
    pairs = [(at(x, i + dt1), at(y, i + dt2)) for i in range(len(data))]
    for method in ("spearman", "kendall"):
        (got,) = p.cor("x", "y", dt1, dt2, shift_by=None, cor_by=None, method=method).collect()
        assert got["cor"] == pytest.approx(brute(pairs, method))


def test_no_task_has_all_rows(spark, monkeypatch):
    """Ranges are of about equally many rows, a hot value is one of its own, and none of these is merged."""
    monkeypatch.setattr(correlation, "ROWS", 500)
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(10_000)).cast("double")).alias("__x"))
    sizes = {r["b"]: r["count"] for r in df.groupBy(correlation._range_of(df, "__x", 20_000).alias("b")).count().collect()}
    assert max(n for b, n in sizes.items() if b % 2 == 0) < 2000 and any(n > 6000 for b, n in sizes.items() if b % 2)
    assert df.stat.approxQuantile("__x", [0.1], 0.01)[0] == 7.0 or min(sizes) >= 0
