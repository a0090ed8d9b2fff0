"""Updates that come late, repeatedly and differently for one version, against the log of all updates at once."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from revpanel.log import compactify
from revpanel.streaming.ingest import changes_of_cell, read_changes, stream_late_updates

D = dt.date(2020, 1, 1)
BIG = (1 << 60) + 1
SCHEMA = "geo_value string, grp long, time_value date, version date, x long, y double, note string"


def updates(seed=1, n=120):
    rng, rows = random.Random(seed), []
    for _ in range(n):
        grp, x = rng.choice([None, BIG, BIG + 2]), rng.choice([None, BIG, BIG + 1])
        rows.append((rng.choice("ab"), grp, D + dt.timedelta(rng.randrange(3)), D + dt.timedelta(rng.randrange(9)), x, rng.choice([None, 0.5, float("nan")]), rng.choice([None, "é", "z"])))
    return rows


def order(row):
    nan = lambda v: isinstance(v, float) and v != v
    return tuple((v is not None, isinstance(v, str) or nan(v), "NaN" if nan(v) else v or 0) for v in row[4:])


def whole(spark, rows):
    """The log of all updates: the largest of each version, without those that repeat the version before."""
    best = {}
    for r in rows:
        k = r[:4]
        if k not in best or order(r) > order(best[k]):
            best[k] = r
    df = spark.createDataFrame(list(best.values()), SCHEMA)
    return sorted(map(repr, compactify(df, ["geo_value", "grp", "time_value"], ["x", "y", "note"]).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_late_repeated_and_tied_updates(spark, tmp_path, seed):
    """In order or not, in one batch or in several, and with a batch that comes twice."""
    rows = updates(seed)
    want = whole(spark, rows)
    rng = random.Random(seed)
    for k in range(2):
        dealt = rows if k == 0 else rng.sample(rows, len(rows))
        source, out, checkpoint = (str(tmp_path / f"{n}{k}") for n in ("in", "log", "cp"))
        for i in range(3 if k else 1):
            part = dealt[i::3] if k else dealt
            for part in (part, part[:7]):
                spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
                stream = spark.readStream.schema(SCHEMA).parquet(source)
                stream_late_updates(stream, out, ["geo_value", "grp", "time_value"], checkpoint).awaitTermination(120)
        got = read_changes(spark, out, ["geo_value", "grp", "time_value"])
        assert sorted(map(repr, got.select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect())) == want
    assert got.where(F.col("grp") == BIG).count() and got.where(F.col("x") == BIG + 1).count()


def test_changes_of_a_cell_do_not_depend_on_the_order():
    cases = [("1", '{"x":1}'), ("3", '{"x":1}'), ("2", '{"x":5}'), ("2", '{"x":4}'), ("12", '{"x":null}'), ("10", '{"x":1}')]
    for dealt in itertools.permutations(cases):
        known, log = {}, {}
        for update in dealt:
            for v, x, put in changes_of_cell(known, [update]):
                log[v] = x
                if not put:
                    del log[v]
        assert log == {"1": '{"x":1}', "2": '{"x":5}', "3": '{"x":1}', "12": '{"x":null}'}


def test_a_late_update_brings_back_what_it_made_a_change():
    """A value that repeated the one before is a change again when another comes between."""
    known = {}
    assert changes_of_cell(known, [("1", '{"x":1.0}'), ("5", '{"x":1.05}')], 0.1) == [("1", '{"x":1.0}', True)]
    assert changes_of_cell(known, [("3", '{"x":2.0}')], 0.1) == [("3", '{"x":2.0}', True), ("5", '{"x":1.05}', True)]
    assert changes_of_cell(known, [("3", '{"x":2.0}')], 0.1) == []
