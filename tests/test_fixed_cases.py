"""Operators on small fixed tables with known results, against the SQL that states them."""

import datetime as dt
import math
import warnings
from collections.abc import Callable

import duckdb
import pytest
from pyspark.sql import functions as F
from test_entry import FOLDER, plain

from revpanel.functions import time as steps
from revpanel.log import RevisionLog
from revpanel.meta import LogMeta, guess_geo_type, guess_time_type
from revpanel.operators.growth import GrowthParams
from revpanel.operators.windows import check_arity
from revpanel.panel import Panel
from revpanel.plans.coverage import _weekly_curve
from revpanel.sources.tables import log_ship, panel_events, panel_region

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


D = dt.date(2020, 1, 1)


def _day(n: int) -> dt.date:
    return D + dt.timedelta(days=n)


def _values(rows: list[tuple], names: str, *casts: str) -> str:
    """SELECT of fixed rows; None is NULL, dates and booleans are literals."""
    def lit(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return f"DATE '{v}'" if isinstance(v, dt.date) else f"'{v}'" if isinstance(v, str) else repr(v)

    columns = ", ".join(f"CAST({n.strip()} AS {c}) AS {n.strip()}" for n, c in zip(names.split(","), casts))
    return f"SELECT {columns} FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({names})"


def _refused(f: Callable) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            f()
    except (steps.PanelError, AttributeError):
        return True
    return False


def _cases(spark, cases: dict[str, Callable]):
    return spark.createDataFrame([(k, _refused(f)) for k, f in cases.items()], "case_name string, refused boolean")


def _cases_sql(refused: str, allowed: str) -> str:
    rows = [(c, True) for c in refused.split()] + [(c, False) for c in allowed.split()]
    return _values(rows, "case_name, refused", "VARCHAR", "BOOLEAN")


_GRID = [(1, _day(1), 1.0), (1, _day(3), 3.0), (2, _day(2), 2.0), (2, _day(3), 3.0)]


def _grid(spark, rows: list[tuple] = _GRID, time_type: str = "day") -> Panel:
    return Panel.from_df(spark.createDataFrame(rows, "geo_value int, time_value date, value double"), geo_type="hhs", time_type=time_type)


_GRID_TYPES = ("geo_value, time_value, value", "INTEGER", "DATE", "DOUBLE")


def _aged(spark) -> RevisionLog:
    day = lambda n: dt.date(2000, 1, n)
    rows = [("us", "adult", day(1), day(2), 121.0), ("us", "pediatric", day(2), day(3), 5.0), ("us", "adult", day(1), day(3), 125.0), ("us", "adult", day(2), day(3), 130.0)]
    return RevisionLog.from_df(spark.createDataFrame(rows, "geo_value string, age_group string, time_value date, version date, value double"), other_keys=["age_group"], geo_type="nation", time_type="day")


_LEVELS = [("us", "pediatric", dt.date(2000, 1, 2), 0.0), ("us", "adult", dt.date(2000, 1, 2), 121.0), ("us", "pediatric", dt.date(2000, 1, 3), 5.0), ("us", "adult", dt.date(2000, 1, 3), 255.0)]


_GEO = [("ca ny", "state"), ("ca us uk", "nation"), ("12345 67890", "county"), ("1 2 3", "hhs"), ("100 200", "hrr"), ("123456789", "custom"), ("somewhere else", "custom")]


@query(_values([("keys and values", True), ("keys only", True), ("no geo_value", False), ("no time_value", False), ("summarized", False)], "what, is_panel", "VARCHAR", "BOOLEAN"))
def panel_decay(spark, d):
    p = panel_region(spark, d)
    made = {"keys and values": p.drop("rev"), "keys only": p.select("geo_value", "time_value"), "no geo_value": p.drop("geo_value"), "no time_value": p.select("geo_value", "n"), "summarized": p.group_by("geo_value").summarize(n=F.sum("n"))}
    return spark.createDataFrame([(k, isinstance(v, Panel)) for k, v in made.items()], "what string, is_panel boolean")


@query(_cases_sql("null_version repeated_key versions_end_too_early clobberable_after_end other_type null_end", "sound later_end"))
def log_validation(spark, d):
    def check(rows: list[tuple], end: object = 3, clobberable: object = None) -> Callable:
        df = spark.createDataFrame(rows, "geo_value string, time_value int, version int, v double")
        return lambda: RevisionLog(df, LogMeta("custom", "integer", (), end, clobberable)).validate()

    good = [("ak", 1, 2, 1.0), ("ak", 1, 3, 2.0)]
    return _cases(spark, {
        "null_version": check([*good, ("ak", 2, None, 1.0)]), "repeated_key": check([*good, good[0]]), "versions_end_too_early": check(good, 2), "clobberable_after_end": check(good, 3, 4),
        "other_type": check(good, "3"), "null_end": check(good, None), "sound": check(good), "later_end": check(good, 9, 9),
    })


@query(_cases_sql("text null boolean date", "number null_allowed"))
def log_version_bounds(spark, d):
    log = log_ship(spark, d)
    bound = lambda v, null_ok=False: lambda: log.check_bound(v, "v", null_ok)
    return _cases(spark, {"text": bound("24000"), "null": bound(None), "boolean": bound(True), "date": bound(D), "number": bound(24000), "null_allowed": bound(None, True)})


@query(_values([("panel", 1, "geo_value"), ("panel", 2, "grp"), ("panel", 3, "time_value"), ("series", 1, "geo_value"), ("series", 2, "grp"), ("log", 1, "geo_value"), ("log", 2, "time_value"), ("log", 3, "version"), ("cell", 1, "geo_value"), ("cell", 2, "time_value")], "of, place, name", "VARCHAR", "INTEGER", "VARCHAR"))
def key_columns(spark, d):
    p, log = panel_events(spark, d), log_ship(spark, d)
    lists = {"panel": p.key_columns(), "series": p.key_columns(["time_value"]), "log": log.key_columns(), "cell": log.key_columns(["version"])}
    return spark.createDataFrame([(k, i, n) for k, names in lists.items() for i, n in enumerate(names, 1)], "of string, place int, name string")


@query(_cases_sql("sum mean prod min max all any range", "summarize"))
def forbidden_summaries(spark, d):
    p = panel_region(spark, d)
    return _cases(spark, {n: lambda n=n: getattr(p, n)() for n in "sum mean prod min max all any range".split()} | {"summarize": lambda: p.group_by("geo_value").summarize(n=F.sum("n"))})


@query(_values([(1, _day(1), 1.0), (1, _day(2), None), (1, _day(3), 3.0), (2, _day(1), None), (2, _day(2), 2.0), (2, _day(3), 3.0)], *_GRID_TYPES))
def complete_small(spark, d):
    return _grid(spark).complete().df


@query(_values([(1, _day(1), 1.0), (1, _day(2), None), (1, _day(3), 3.0), (2, _day(2), 2.0), (2, _day(3), 3.0)], *_GRID_TYPES))
def complete_small_grouped(spark, d):
    return _grid(spark).group_by("geo_value").complete().df


@query(_values([(1, _day(1), 1.0), (1, _day(2), None), (1, _day(3), 3.0), (2, _day(1), 0.0), (2, _day(2), 2.0), (2, _day(3), 3.0)], *_GRID_TYPES))
def complete_small_explicit(spark, d):
    return _grid(spark, [*_GRID, (1, _day(2), None)]).complete(fill={"value": 0.0}, explicit=False).df


@query(_values([(1, _day(1), 1.0), (1, _day(8), 0.0), (1, _day(15), 3.0), (2, _day(1), 0.0), (2, _day(8), 2.0), (2, _day(15), 3.0)], *_GRID_TYPES))
def complete_small_weekly(spark, d):
    return _grid(spark, [(1, _day(1), 1.0), (1, _day(15), 3.0), (2, _day(8), 2.0), (2, _day(15), 3.0)], "week").complete(fill={"value": 0.0}).df


@query(_values(_LEVELS, "geo_value, age_group, version, s", "VARCHAR", "VARCHAR", "DATE", "DOUBLE"))
def replay_levels(spark, d):
    log = _aged(spark).group_by("geo_value", "age_group", drop=False, levels={"age_group": ["pediatric", "adult"]})
    return log.slide({"s": F.coalesce(F.sum("value"), F.lit(0.0))}, before=10)


@query(_values([r for r in _LEVELS if r[3] > 0], "geo_value, age_group, version, s", "VARCHAR", "VARCHAR", "DATE", "DOUBLE"))
def replay_levels_dropped(spark, d):
    return _aged(spark).group_by("geo_value", "age_group").slide({"s": F.sum("value")}, before=10)


@query(_values([("ak", _day(4), 12.0), ("ak", _day(5), 72.0), ("ak", _day(6), 1536.0), ("ak", _day(7), 49152.0)], "geo_value, version, s", "VARCHAR", "DATE", "DOUBLE"))
def replay_small(spark, d):
    seen = {4: {1: 2, 2: 4, 3: 8}, 5: {1: 16, 2: 32, 4: 64}, 6: {1: 128, 2: 256, 4: 512, 5: 1024}, 7: {2: 2048, 3: 4096, 4: 8192, 5: 16384, 6: 32768}}
    rows = [("ak", _day(t), _day(v), float(x)) for v, cells in seen.items() for t, x in cells.items()]
    log = RevisionLog.from_df(spark.createDataFrame(rows, "geo_value string, time_value date, version date, binary double"), geo_type="state", time_type="day")
    return log.group_by("geo_value").slide({"s": F.sum("binary")}, before=2)


@query(_values([(_day(0), _day(1), 10, None), (_day(0), _day(4), None, None), (_day(0), _day(5), None, 20)], "time_value, version, x_value, y_value", "DATE", "DATE", "INTEGER", "INTEGER"))
def merge_small(spark, d):
    def log(rows: list[tuple], name: str, end: dt.date) -> RevisionLog:
        return RevisionLog.from_df(spark.createDataFrame(rows, f"geo_value string, time_value date, version date, {name} int"), geo_type="state", time_type="day", versions_end=end)

    x, y = log([("ak", _day(0), _day(1), 10)], "x_value", _day(3)), log([("ak", _day(0), _day(5), 20)], "y_value", _day(5))
    return x.merge(y, sync="na").df.select("time_value", "version", "x_value", "y_value")


@query(_values([(n, a, *{"right": (n - 1, 0), "center": (n // 2, n - n // 2 - 1), "left": (0, n - 1)}[a]) for n in range(1, 7) for a in ("right", "center", "left")], "n, align, before, after", "INTEGER", "VARCHAR", "INTEGER", "INTEGER"))
def window_sides(spark, d):
    rows = [(n, a, *map(int, steps.before_after(steps.window_steps(n, "day"), a))) for n in range(1, 7) for a in ("right", "center", "left")]
    return spark.createDataFrame(rows, "n int, align string, before int, after int")


@query(_cases_sql("zero half_step days_for_weeks number_for_weeks duration_for_months left_unbounded", "number duration weeks unbounded whole_float"))
def window_sizes(spark, d):
    size = lambda v, kind: lambda: steps.window_steps(v, kind)
    return _cases(spark, {
        "zero": size(0, "day"), "half_step": size(2.5, "day"), "days_for_weeks": size(dt.timedelta(days=3), "week"), "number_for_weeks": size(2, "week"), "duration_for_months": size(dt.timedelta(days=30), "yearmonth"),
        "left_unbounded": lambda: steps.before_after(math.inf, "left"), "number": size(7, "day"), "duration": size(dt.timedelta(days=7), "day"), "weeks": size(dt.timedelta(weeks=2), "week"), "unbounded": size(math.inf, "yearmonth"), "whole_float": size(3.0, "integer"),
    })


@query(_values([("day", 1, "d", "3 days", 3.0, 3), ("week", 7, "w", "3 weeks", 21.0, 1), ("yearmonth", 1, "m", "3 months", 90.0, 1)], "time_type, unit, letter, shown, days, steps_of_3_days", "VARCHAR", "INTEGER", "VARCHAR", "VARCHAR", "DOUBLE", "INTEGER"))
def time_units(spark, d):
    three = dt.timedelta(days=3)
    rows = [(t, steps.STEP[t], steps.unit_letter(t), steps.format_steps(3, t), steps.approximate_duration(3, t) / dt.timedelta(days=1), steps.ceiling_steps(three, t)) for t in ("day", "week", "yearmonth")]
    return spark.createDataFrame(rows, "time_type string, unit int, letter string, shown string, days double, steps_of_3_days int")


@query(_cases_sql("part_of_week duration_for_integer duration_of_integer letter_of_integer boolean custom", "weeks round_trip whole_float"))
def time_durations(spark, d):
    def back() -> None:
        if steps.to_steps(steps.from_steps(5, "week"), "week") != 5:
            raise steps.PanelError("steps change on the way")

    return _cases(spark, {
        "part_of_week": lambda: steps.to_steps(dt.timedelta(days=10), "week"), "duration_for_integer": lambda: steps.to_steps(dt.timedelta(days=1), "integer"), "duration_of_integer": lambda: steps.ceiling_steps(dt.timedelta(days=3), "integer"),
        "letter_of_integer": lambda: steps.unit_letter("integer"), "boolean": lambda: steps.to_steps(True, "day"), "custom": lambda: steps.to_steps(1, "custom"), "weeks": lambda: steps.to_steps(dt.timedelta(days=14), "week"), "round_trip": back, "whole_float": lambda: steps.to_steps(2.0, "day"),
    })


@query(_values(_GEO, "geos, geo_type", "VARCHAR", "VARCHAR"))
def geo_types(spark, d):
    numbers = {"1 2 3", "100 200"}
    frame = lambda g: spark.createDataFrame([(int(x),) if g in numbers else (x,) for x in g.split()], f"geo_value {'int' if g in numbers else 'string'}")
    return spark.createDataFrame([(g, guess_geo_type(frame(g))) for g, _ in _GEO], "geos string, geo_type string")


@query(_values([("days", "day"), ("weeks", "week"), ("gaps", "day"), ("weeks with gaps", "week"), ("years", "integer")], "times, time_type", "VARCHAR", "VARCHAR"))
def time_types(spark, d):
    gaps = [1, 2, 3, 4, 5, 6, 8, 9, 11, 15]
    cases = {"days": [_day(i) for i in range(7)], "weeks": [_day(7 * i) for i in range(7)], "gaps": [_day(i) for i in gaps], "weeks with gaps": [_day(7 * i) for i in gaps], "years": [1999, 2000]}
    frame = lambda v: spark.createDataFrame([(x,) for x in v], f"time_value {'int' if isinstance(v[0], int) else 'date'}")
    return spark.createDataFrame([(k, guess_time_type(frame(v))) for k, v in cases.items()], "times string, time_type string")


@query(_cases_sql("none two", "three any default"))
def slide_arity(spark, d):
    forms = {"none": lambda: 0, "two": lambda a, b: 0, "three": lambda a, b, c: 0, "any": lambda *a: 0, "default": lambda a, b, c, e=1: 0}
    return _cases(spark, {k: lambda f=f: check_arity(f, 3, "f") for k, f in forms.items()})


@query(_cases_sql("df_word df_negative family measure folds ratio spar some_knots several_lam poisson", "default cv offset one_lam"))
def growth_options(spark, d):
    p = _weekly_curve(spark, d, lambda i: 10 + 2 * i)
    make = lambda **o: lambda: GrowthParams(**o)
    run = lambda method="smooth_spline", **o: lambda: p.growth_rate("v", method=method, params=GrowthParams(**o), validate=False)
    return _cases(spark, {
        "df_word": make(df="best"), "df_negative": make(df=-1), "family": make(family="gamma"), "measure": make(error_measure="rank"), "folds": make(nfolds=1), "ratio": make(lambda_min_ratio=2), "spar": run(spar=0.5), "some_knots": run(all_knots=False), "several_lam": run(lam=[0.1, 0.2]),
        "poisson": run("trend_filter", family="poisson"), "default": run(), "cv": run(cv=True), "offset": run(df_offset=1, penalty=1.4), "one_lam": run(lam=0.5),
    })


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_known_result(spark, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*cols).collect()), key=str)
    want = duckdb.sql(ORACLE[name])
    assert sorted(want.columns) == cols
    assert got == sorted((tuple(plain(x) for x in r) for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall()), key=str)
