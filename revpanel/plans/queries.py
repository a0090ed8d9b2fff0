"""One registered query per operator, with the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revpanel.functions.time import INF
from revpanel.log import RevisionLog
from revpanel.operators import aggregate, completion, joins, plotting
from revpanel.operators.correlation import lag_sweep
from revpanel.operators.outliers import Method
from revpanel.panel import Panel
from revpanel.sources.tables import log_ship, panel_events, panel_nation_month, panel_region, panel_week

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PLACES = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
DAYS = f"""days AS (SELECT lower(r_name) AS geo_value, CAST(o_orderdate AS DATE) AS time_value, count(*) AS n,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) / 100.0 AS rev, max(o_totalprice) > 400000 AS big FROM {PLACES} GROUP BY 1, 2)"""
MONTHS = f"months AS (SELECT lower(n_name) AS geo_value, CAST(date_trunc('month', o_orderdate) AS DATE) AS time_value, count(*) AS n FROM {PLACES} GROUP BY 1, 2)"
WEEKS = f"weeks AS (SELECT lower(n_name) AS geo_value, CAST(date_trunc('week', o_orderdate) AS DATE) AS time_value, count(*) AS n FROM {PLACES} GROUP BY 1, 2)"
EVENTS = "ev AS (SELECT event_type AS geo_value, user_id % 3 AS grp, CAST(ts AS DATE) AS time_value, count(*) AS n FROM events GROUP BY 1, 2, 3)"


def _ship(name: str, value: str, column: str, last: int | None = None) -> str:
    where = f" WHERE version <= {last}" if last else ""
    return f"""{name}_step AS (SELECT lower(r_name) AS geo_value, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS time_value,
      CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS version, {value} AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3),
    {name} AS (SELECT * FROM (SELECT geo_value, time_value, version, CAST(sum(v) OVER (PARTITION BY geo_value, time_value ORDER BY version) AS DOUBLE) AS {column}
      FROM {name}_step WHERE version >= time_value){where})"""


SHIP = _ship("ship", "sum(l_quantity)", "qty")
#: The second log was observed for half a year less.
LAST2 = 2001 * 12 + 6
LINES = _ship("lines", "count(*)", "lines", LAST2)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def _out(panel: Panel, *columns: str, digits: int = 6) -> DataFrame:
    return _rounded(panel.df, *columns, digits=digits)


# -- windows ----------------------------------------------------------------------------------------------------------


def _days_sql(cols: str, frame: str, extra: str = "") -> str:
    return f"WITH {DAYS} SELECT geo_value, time_value, {cols} FROM days WINDOW w AS (PARTITION BY geo_value ORDER BY time_value RANGE BETWEEN {frame}) {extra}"


_RIGHT = "INTERVAL 6 DAYS PRECEDING AND CURRENT ROW"


@query(_days_sql("n, CASE WHEN count(n) OVER w = 7 THEN round(avg(n) OVER w, 6) END AS n_7dav", _RIGHT))
def roll_mean_right(spark, d):
    return _out(panel_region(spark, d).roll_mean("n", 7), "n_7dav").drop("rev", "big")


@query(_days_sql("n, CASE WHEN count(n) OVER w = 7 THEN round(avg(n) OVER w, 6) END AS n_7dcav", "INTERVAL 3 DAYS PRECEDING AND INTERVAL 3 DAYS FOLLOWING"))
def roll_mean_center(spark, d):
    return _out(panel_region(spark, d).roll_mean("n", 7, align="center"), "n_7dcav").drop("rev", "big")


@query(_days_sql("n, CASE WHEN count(n) OVER w = 7 THEN round(avg(n) OVER w, 6) END AS n_7dlav", "CURRENT ROW AND INTERVAL 6 DAYS FOLLOWING"))
def roll_mean_left(spark, d):
    return _out(panel_region(spark, d).roll_mean("n", dt.timedelta(days=7), align="left"), "n_7dlav").drop("rev", "big")


@query(_days_sql("n, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS total", _RIGHT))
def roll_sum_skipna(spark, d):
    return panel_region(spark, d).roll_sum("n", 7, skip_nulls=True, new_names=["total"]).df.drop("rev", "big")


@query(_days_sql("n, rev, CASE WHEN count(n) OVER w = 4 THEN CAST(sum(n) OVER w AS BIGINT) END AS s_n, CASE WHEN count(rev) OVER w = 4 THEN round(sum(rev) OVER w, 2) END AS s_rev", "INTERVAL 3 DAYS PRECEDING AND CURRENT ROW"))
def roll_sum_columns(spark, d):
    return _out(panel_region(spark, d).roll_sum(["n", "rev"], 4, prefix="s_"), "s_rev", digits=2).drop("big")


@query(_days_sql("n, CASE WHEN count(n) OVER w = 3 THEN round(product(n) OVER w, 3) END AS n_3dprod", "INTERVAL 2 DAYS PRECEDING AND CURRENT ROW"))
def roll_prod(spark, d):
    return _out(panel_region(spark, d).roll("n", "prod", 3), "n_3dprod", digits=3).drop("rev", "big")


@query(_days_sql("n, CASE WHEN count(n) OVER w = 5 THEN min(n) OVER w END AS n_5dmin", "INTERVAL 4 DAYS PRECEDING AND CURRENT ROW"))
def roll_min(spark, d):
    return panel_region(spark, d).roll("n", "min", 5).df.drop("rev", "big")


@query(_days_sql("n, CASE WHEN count(n) OVER w = 5 THEN max(n) OVER w END AS n_5dlmax", "CURRENT ROW AND INTERVAL 4 DAYS FOLLOWING"))
def roll_max(spark, d):
    return panel_region(spark, d).roll("n", "max", 5, align="left").df.drop("rev", "big")


@query(_days_sql("CASE WHEN NOT bool_and(big) OVER w THEN false WHEN count(big) OVER w = 3 THEN true END AS big_3dall", "INTERVAL 2 DAYS PRECEDING AND CURRENT ROW"))
def roll_all(spark, d):
    return panel_region(spark, d).roll("big", "all", 3).df.drop("n", "rev", "big")


@query(_days_sql("CASE WHEN bool_or(big) OVER w THEN true WHEN count(big) OVER w = 3 THEN false END AS big_3dany", "INTERVAL 2 DAYS PRECEDING AND CURRENT ROW"))
def roll_any(spark, d):
    return panel_region(spark, d).roll("big", "any", 3).df.drop("n", "rev", "big")


@query(_days_sql("CASE WHEN count(big) OVER w = 3 THEN round(avg(big::INT) OVER w, 6) END AS big_3dprop", "INTERVAL 2 DAYS PRECEDING AND CURRENT ROW"))
def roll_prop(spark, d):
    return _out(panel_region(spark, d).roll_mean("big", 3), "big_3dprop").drop("n", "rev", "big")


@query(_days_sql("CASE WHEN count(n) OVER w = 5 THEN quantile_cont(n, 0.5) OVER w END AS med", "INTERVAL 2 DAYS PRECEDING AND INTERVAL 2 DAYS FOLLOWING"))
def roll_median(spark, d):
    return panel_region(spark, d).roll("n", "median", 5, align="center", new_names=["med"]).df.drop("n", "rev", "big")


@query(f"WITH {WEEKS} SELECT *, CASE WHEN count(n) OVER w = 4 THEN CAST(sum(n) OVER w AS BIGINT) END AS n_4wsum FROM weeks WINDOW w AS (PARTITION BY geo_value ORDER BY time_value RANGE BETWEEN INTERVAL 21 DAYS PRECEDING AND CURRENT ROW)")
def roll_weekly(spark, d):
    return panel_week(spark, d).roll_sum("n", dt.timedelta(weeks=4)).df


@query(f"WITH {MONTHS} SELECT *, CASE WHEN count(n) OVER w = 3 THEN round(avg(n) OVER w, 6) END AS n_3mav FROM months WINDOW w AS (PARTITION BY geo_value ORDER BY time_value RANGE BETWEEN INTERVAL 2 MONTHS PRECEDING AND CURRENT ROW)")
def roll_monthly(spark, d):
    return _out(panel_nation_month(spark, d).roll_mean("n", 3), "n_3mav")


@query(f"WITH {EVENTS} SELECT *, CASE WHEN count(n) OVER w = 7 THEN round(avg(n) OVER w, 6) END AS n_7dav FROM ev WINDOW w AS (PARTITION BY geo_value, grp ORDER BY time_value RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)")
def roll_other_keys(spark, d):
    return _out(panel_events(spark, d).roll_mean("n", 7), "n_7dav")


@query(f"WITH {DAYS} SELECT geo_value, time_value, n, CASE WHEN count(n) OVER w = date_diff('day', (SELECT min(time_value) FROM days), time_value) + 1 THEN CAST(sum(n) OVER w AS BIGINT) END AS n_running_sum FROM days WINDOW w AS (PARTITION BY geo_value ORDER BY time_value)")
def running_sum(spark, d):
    return panel_region(spark, d).roll_sum("n", INF).df.drop("rev", "big")


@query(f"WITH {EVENTS} SELECT *, CASE WHEN count(n) OVER w = date_diff('day', (SELECT min(time_value) FROM ev), time_value) + 1 THEN round(avg(n) OVER w, 6) END AS n_running_av FROM ev WINDOW w AS (PARTITION BY geo_value, grp ORDER BY time_value)")
def running_mean(spark, d):
    return _out(panel_events(spark, d).roll_mean("n", INF), "n_running_av")


_REFS = [dt.date(1996, 3, 1), dt.date(1997, 7, 14), dt.date(1999, 1, 2)]
_REFS_SQL = "(" + ", ".join(f"DATE '{t}'" for t in _REFS) + ")"


@query(f"SELECT * FROM ({_days_sql('n, CAST(sum(n) OVER w AS BIGINT) AS total', _RIGHT)}) WHERE time_value IN {_REFS_SQL}")
def slide_ref_times(spark, d):
    return panel_region(spark, d).roll_sum("n", 7, skip_nulls=True, new_names=["total"], ref_times=_REFS, validate=False).df.drop("rev", "big")


@query(f"SELECT geo_value, time_value, n, CASE WHEN time_value IN {_REFS_SQL} THEN total END AS total FROM ({_days_sql('n, CAST(sum(n) OVER w AS BIGINT) AS total', _RIGHT)})")
def slide_all_rows(spark, d):
    return panel_region(spark, d).roll_sum("n", 7, skip_nulls=True, new_names=["total"], ref_times=_REFS, all_rows=True, validate=False).df.drop("rev", "big")


@query(_days_sql("round(max(rev) OVER w - min(rev) OVER w, 2) AS span, count(n) OVER w AS present, round(stddev_samp(n) OVER w, 6) AS sd", _RIGHT))
def slide_expressions(spark, d):
    out = panel_region(spark, d).slide({"hi": F.max("rev"), "lo": F.min("rev"), "present": F.count("n"), "sd": F.stddev_samp("n")}, 7)
    return out.df.select("geo_value", "time_value", F.round(F.col("hi") - F.col("lo"), 2).alias("span"), "present", F.round("sd", 6).alias("sd"))


def _last_over_first(window: pd.DataFrame, key: tuple, t) -> float | None:
    n = window["n"].dropna()
    return float(n.iloc[-1] / n.iloc[0]) if len(n) else None


@query(_days_sql("round(arg_max(n, time_value) OVER w / arg_min(n, time_value) OVER w, 6) AS ratio", _RIGHT))
def slide_python(spark, d):
    return _out(panel_region(spark, d).slide_python(_last_over_first, "double", 7, new_name="ratio"), "ratio").drop("n", "rev", "big")


@query(f"WITH {DAYS} SELECT geo_value, time_value, n - lag(n, 1, 0) OVER w AS change, CAST(sum(n) OVER w AS BIGINT) AS total, lead(n) OVER w AS next FROM days WINDOW w AS (PARTITION BY geo_value ORDER BY time_value)")
def grouped_mutate(spark, d):
    w = Window.partitionBy("geo_value").orderBy("time_value")
    out = panel_region(spark, d).group_by_series().mutate(change=F.col("n") - F.lag("n", 1, 0).over(w), total=F.sum("n").over(w), next=F.lead("n").over(w))
    return out.df.select("geo_value", "time_value", "change", "total", "next")


# -- completion, aggregation, joins -----------------------------------------------------------------------------------


@query(f"WITH {DAYS}, grid AS (SELECT DISTINCT geo_value, CAST(t AS DATE) AS time_value FROM (SELECT DISTINCT geo_value FROM days), generate_series((SELECT min(time_value) FROM days), (SELECT max(time_value) FROM days), INTERVAL 1 DAY) AS g(t)) SELECT geo_value, time_value, n, rev FROM grid LEFT JOIN days USING (geo_value, time_value)")
def complete_grid(spark, d):
    return completion.complete(panel_region(spark, d)).df.drop("big")


@query(f"WITH {DAYS}, ends AS (SELECT geo_value, min(time_value) AS a, max(time_value) AS b FROM days GROUP BY 1), grid AS (SELECT geo_value, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS time_value FROM ends) SELECT geo_value, time_value, n FROM grid LEFT JOIN days USING (geo_value, time_value)")
def complete_grouped(spark, d):
    return panel_region(spark, d).group_by("geo_value").complete().df.drop("rev", "big")


@query(f"WITH {WEEKS}, grid AS (SELECT geo_value, CAST(t AS DATE) AS time_value FROM (SELECT DISTINCT geo_value FROM weeks), generate_series((SELECT min(time_value) FROM weeks), (SELECT max(time_value) FROM weeks), INTERVAL 7 DAYS) AS g(t)) SELECT geo_value, time_value, coalesce(n, 0) AS n FROM grid LEFT JOIN weeks USING (geo_value, time_value)")
def fill_zero(spark, d):
    return panel_week(spark, d).complete(fill={"n": 0}, explicit=False).df


@query(f"WITH {DAYS} SELECT geo_value, CAST(time_value + INTERVAL 1 DAY AS DATE) AS from_time, CAST(nxt - INTERVAL 1 DAY AS DATE) AS to_time, date_diff('day', time_value, nxt) - 1 AS n_missing FROM (SELECT *, lead(time_value) OVER (PARTITION BY geo_value ORDER BY time_value) AS nxt FROM days) WHERE date_diff('day', time_value, nxt) > 1")
def gaps(spark, d):
    return panel_region(spark, d).gaps()


@query(f"WITH {DAYS}, e AS (SELECT geo_value, date_diff('day', min(time_value), max(time_value)) + 1 > count(*) AS has_gaps FROM days GROUP BY 1) SELECT * FROM e")
def has_gaps(spark, d):
    return completion.has_gaps(panel_region(spark, d))


@query(f"WITH {DAYS} SELECT 'total' AS geo_value, time_value, CAST(sum(n) AS BIGINT) AS n, round(sum(rev), 2) AS rev FROM days GROUP BY 2")
def sum_groups_total(spark, d):
    return _out(panel_region(spark, d).sum_groups(["n", "rev"]), "rev", digits=2)


@query(f"WITH {EVENTS} SELECT geo_value, time_value, CAST(sum(n) AS BIGINT) AS n FROM ev GROUP BY 1, 2")
def sum_groups_geo(spark, d):
    return panel_events(spark, d).sum_groups("n", ["geo_value", "time_value"]).df


@query(f"WITH {EVENTS} SELECT geo_value, grp, time_value, n, round(n / sum(n) OVER (PARTITION BY geo_value, time_value), 6) AS part FROM ev")
def share_of_total(spark, d):
    return _out(aggregate.share_of_total(panel_events(spark, d), "n", ["geo_value", "time_value"], "part"), "part")


@query(f"WITH {DAYS} SELECT geo_value, count(*) AS days, round(avg(n), 6) AS mean_n, quantile_cont(n, 0.5) AS median_n, round(stddev_samp(n), 6) AS sd_n FROM days GROUP BY 1")
def summarize(spark, d):
    out = panel_region(spark, d).group_by("geo_value").summarize(days=F.count("*"), mean_n=F.avg("n"), median_n=F.percentile("n", F.lit(0.5)), sd_n=F.stddev_samp("n"))
    return _rounded(out, "mean_n", "sd_n")


@query(f"WITH {DAYS}, {MONTHS}, m AS (SELECT lower(r_name) AS geo_value, CAST(date_trunc('month', o_orderdate) AS DATE) AS time_value, count(*) AS month_n FROM {PLACES} GROUP BY 1, 2) SELECT days.geo_value, days.time_value, days.n, m.month_n FROM days ASOF LEFT JOIN m ON days.geo_value = m.geo_value AND days.time_value >= m.time_value")
def asof_join_pop(spark, d):
    panel = panel_region(spark, d)
    months = panel.df.groupBy("geo_value", F.to_date(F.date_trunc("month", "time_value")).alias("time_value")).agg(F.sum("n").alias("month_n"))
    return joins.asof_join(panel.df.select("geo_value", "time_value", "n"), months, ["geo_value"], "time_value")


@query(f"WITH {DAYS}, {MONTHS} SELECT a.geo_value, a.time_value, a.n, b.n AS other FROM days a JOIN days b USING (geo_value, time_value) WHERE a.n > 2")
def inner_join(spark, d):
    panel = panel_region(spark, d).select("geo_value", "time_value", "n").filter("n > 2")
    return panel.inner_join(panel_region(spark, d).df.select("geo_value", "time_value", F.col("n").alias("other")), ["geo_value", "time_value"]).df


@query(f"WITH {DAYS} SELECT 'custom' AS geo_type, 'day' AS time_type, CAST(NULL AS VARCHAR) AS as_of, CAST(sum(c) AS BIGINT) AS n_rows, min(time_value) AS min_time, max(time_value) AS max_time, CAST(floor(avg(c)) AS BIGINT) AS rows_per_time FROM (SELECT time_value, count(*) AS c FROM days GROUP BY 1)")
def panel_describe(spark, d):
    return panel_region(spark, d).describe()


@query(f"WITH {DAYS} SELECT geo_value, time_value, n FROM (SELECT *, row_number() OVER (PARTITION BY geo_value ORDER BY time_value) AS i FROM days) WHERE i IN (1, 4)")
def slice_rows(spark, d):
    return panel_region(spark, d).group_by("geo_value").slice([0, 3]).df.drop("rev", "big")


@query(f"WITH {DAYS} SELECT geo_value, time_value, name, round(value, 2) AS value FROM (SELECT geo_value, time_value, CAST(n AS DOUBLE) AS n, CAST(rev AS DOUBLE) AS rev FROM days) UNPIVOT (value FOR name IN (n, rev))")
def pivot_longer(spark, d):
    p = panel_region(spark, d).mutate(n=F.col("n").cast("double")).drop("big")
    return _rounded(p.pivot_longer(["n", "rev"]), "value", digits=2)


# -- statistics -------------------------------------------------------------------------------------------------------

_CORR = "CASE WHEN count(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 1 END) >= 2 AND regr_sxx(y, x) > 0 AND regr_syy(y, x) > 0 THEN round(corr(x, y), 6) END AS cor"


@query(f"WITH {DAYS} SELECT geo_value, {_CORR} FROM (SELECT geo_value, n AS x, rev AS y FROM days) GROUP BY 1")
def cor_geo(spark, d):
    return _rounded(panel_region(spark, d).cor("n", "rev"), "cor")


@query(f"WITH {DAYS} SELECT time_value, {_CORR} FROM (SELECT time_value, n AS x, rev AS y FROM days) GROUP BY 1")
def cor_time(spark, d):
    return _rounded(panel_region(spark, d).cor("n", "rev", cor_by="time_value"), "cor")


@query(f"WITH {DAYS} SELECT geo_value, {_CORR} FROM (SELECT geo_value, lag(n, 5) OVER (PARTITION BY geo_value ORDER BY time_value) AS x, rev AS y FROM days) GROUP BY 1")
def cor_lagged(spark, d):
    return _rounded(panel_region(spark, d).cor("n", "rev", dt1=-5), "cor")


_RANKS = "SELECT geo_value, rank() OVER (PARTITION BY geo_value ORDER BY n) + (count(*) OVER (PARTITION BY geo_value, n) - 1) / 2 AS x, rank() OVER (PARTITION BY geo_value ORDER BY rev) + (count(*) OVER (PARTITION BY geo_value, rev) - 1) / 2 AS y FROM days"


@query(f"WITH {DAYS} SELECT geo_value, {_CORR} FROM ({_RANKS}) GROUP BY 1")
def cor_spearman(spark, d):
    return _rounded(panel_region(spark, d).cor("n", "rev", method="spearman"), "cor")


@query(f"WITH {EVENTS}, p AS (SELECT geo_value, n AS x, lead(n) OVER (PARTITION BY geo_value, grp ORDER BY time_value) AS y, row_number() OVER (PARTITION BY geo_value ORDER BY grp, time_value) AS i FROM ev), q AS (SELECT a.geo_value, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, sum(CASE WHEN a.x <> b.x THEN 1 ELSE 0 END) AS nx, sum(CASE WHEN a.y <> b.y THEN 1 ELSE 0 END) AS ny FROM p a JOIN p b ON a.geo_value = b.geo_value AND a.i < b.i WHERE a.y IS NOT NULL AND b.y IS NOT NULL GROUP BY 1) SELECT geo_value, round(s / (sqrt(nx::DOUBLE) * sqrt(ny::DOUBLE)), 6) AS cor FROM q")
def cor_kendall(spark, d):
    return _rounded(panel_events(spark, d).cor("n", "n", dt2=1, shift_by=["geo_value", "grp"], method="kendall"), "cor")


@query(f"WITH {DAYS}, s AS (SELECT geo_value, CAST(l AS INTEGER) AS lag, a.x, y FROM (SELECT *, row_number() OVER (PARTITION BY geo_value ORDER BY time_value) AS i, rev AS y FROM days) b CROSS JOIN range(0, 8) AS r(l) LEFT JOIN (SELECT geo_value AS g, n AS x, row_number() OVER (PARTITION BY geo_value ORDER BY time_value) AS i FROM days) a ON a.g = b.geo_value AND a.i = b.i - l) SELECT geo_value, lag, {_CORR} FROM s GROUP BY 1, 2")
def cor_lag_sweep(spark, d):
    return _rounded(lag_sweep(panel_region(spark, d), "n", "rev", range(8)), "cor")


_KNOTS = """, k AS (SELECT *, last_value(CASE WHEN g IS NOT NULL AND NOT isnan(g) THEN x END IGNORE NULLS) OVER (PARTITION BY geo_value ORDER BY x) AS xa,
  last_value(CASE WHEN g IS NOT NULL AND NOT isnan(g) THEN g END IGNORE NULLS) OVER (PARTITION BY geo_value ORDER BY x) AS ga,
  first_value(CASE WHEN g IS NOT NULL AND NOT isnan(g) THEN x END IGNORE NULLS) OVER (PARTITION BY geo_value ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS xb,
  first_value(CASE WHEN g IS NOT NULL AND NOT isnan(g) THEN g END IGNORE NULLS) OVER (PARTITION BY geo_value ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS gb FROM r)
  SELECT geo_value, time_value, n, round(CASE WHEN xa = x THEN ga ELSE ga + (gb - ga) * (x - xa) / (xb - xa) END, 6) AS growth_rate FROM k"""
_X = "x AS (SELECT geo_value, time_value, n, date_diff('day', DATE '1970-01-01', time_value) AS x, {y} AS y FROM days)"
_HALVES = "WINDOW a AS (PARTITION BY geo_value ORDER BY x RANGE BETWEEN 6 PRECEDING AND CURRENT ROW), b AS (PARTITION BY geo_value ORDER BY x RANGE BETWEEN 1 FOLLOWING AND 7 FOLLOWING)"


@query(f"WITH {DAYS}, {_X.format(y='CAST(n AS DOUBLE)')}, r AS (SELECT *, (avg(y) OVER b / avg(y) OVER a - 1) / (avg(x) OVER b - avg(x) OVER a) AS g FROM x {_HALVES}){_KNOTS}")
def growth_rel_change(spark, d):
    return _out(panel_region(spark, d).growth_rate("n"), "growth_rate").drop("rev", "big")


@query(f"WITH {DAYS}, {_X.format(y='ln(n)')}, r AS (SELECT *, (avg(y) OVER b - avg(y) OVER a) / (avg(x) OVER b - avg(x) OVER a) AS g FROM x {_HALVES}){_KNOTS}")
def growth_log(spark, d):
    return _out(panel_region(spark, d).growth_rate("n", log_scale=True), "growth_rate").drop("rev", "big")


@query(f"WITH {DAYS}, {_X.format(y='CAST(n AS DOUBLE)')}, r AS (SELECT *, CASE WHEN count(*) OVER w > 1 THEN regr_slope(y, x) OVER w / (regr_intercept(y, x) OVER w + regr_slope(y, x) OVER w * x) END AS g FROM x WINDOW w AS (PARTITION BY geo_value ORDER BY x RANGE BETWEEN 6 PRECEDING AND 7 FOLLOWING)){_KNOTS.replace(', 6) AS', ' + 1e-9, 6) AS')}")
def growth_linear_reg(spark, d):
    # Many rates are sums of powers of two, which end in ties of rounding; a shift on both sides settles them.
    out = panel_region(spark, d).growth_rate("n", method="linear_reg").df
    return out.withColumn("growth_rate", F.round(F.col("growth_rate") + 1e-9, 6)).drop("rev", "big")


@query()
def growth_spline(spark, d):
    return panel_nation_month(spark, d).growth_rate("n", method="smooth_spline").df


@query()
def growth_trend_filter(spark, d):
    return panel_nation_month(spark, d).growth_rate("n", method="trend_filter").df


_RM = """, f AS (SELECT *, quantile_cont(rev, 0.5) OVER (PARTITION BY geo_value ORDER BY time_value RANGE BETWEEN INTERVAL 10 DAYS PRECEDING AND INTERVAL 10 DAYS FOLLOWING) AS fitted FROM days),
  q AS (SELECT *, quantile_cont(rev - fitted, 0.75) OVER w - quantile_cont(rev - fitted, 0.25) OVER w AS iqr FROM f WINDOW w AS (PARTITION BY geo_value ORDER BY time_value RANGE BETWEEN INTERVAL 10 DAYS PRECEDING AND INTERVAL 10 DAYS FOLLOWING)),
  o AS (SELECT geo_value, time_value, rev, fitted, iqr, greatest(0, fitted - 2.5 * iqr) AS lower, fitted + 2.5 * iqr AS upper FROM q)"""


@query(f"WITH {DAYS}{_RM} SELECT geo_value, time_value, round(lower, 6) AS rm_lower, round(upper, 6) AS rm_upper, round(CASE WHEN rev < lower OR rev > upper THEN fitted ELSE rev END, 6) AS rm_replacement FROM o")
def outlier_rm(spark, d):
    out = panel_region(spark, d).detect_outliers("rev", [Method("rm", "rm", {"detection_multiplier": 2.5, "detect_negatives": True})], combiner="none")
    return _out(out, "rm_lower", "rm_upper", "rm_replacement").drop("n", "rev", "big")


@query(f"WITH {DAYS}{_RM}, c AS (SELECT *, CASE WHEN rev < lower OR rev > upper THEN fitted ELSE rev END AS rep, greatest(0, fitted - 4 * iqr) AS l2, fitted + 4 * iqr AS u2 FROM o), e AS (SELECT *, CASE WHEN rev < l2 OR rev > u2 THEN fitted ELSE rev END AS r2 FROM c) SELECT geo_value, time_value, round((lower + l2) / 2, 8) AS combined_lower, round((upper + u2) / 2, 8) AS combined_upper, round((rep + r2) / 2, 8) AS combined_replacement FROM e")
def outlier_combined(spark, d):
    methods = [Method("rm", "a", {"detection_multiplier": 2.5, "detect_negatives": True}), Method("rm", "b", {"detection_multiplier": 4, "detect_negatives": True})]
    names = ["combined_lower", "combined_upper", "combined_replacement"]
    return _out(panel_region(spark, d).detect_outliers("rev", methods), *names, digits=8).select("geo_value", "time_value", *names)


@query()
def outlier_stl(spark, d):
    full = panel_region(spark, d).drop("rev", "big").complete(fill={"n": 0})
    return full.detect_outliers("n", [Method("stl", "stl", {"seasonal_period": 7})]).df


# -- revision logs ----------------------------------------------------------------------------------------------------

_AT = 2000 * 12 + 3


def _coarse(log: RevisionLog) -> RevisionLog:
    """The same log with values in thousands, so that many versions repeat the one before."""
    return RevisionLog(log.df.withColumn("qty", F.floor(F.col("qty") / 1000).cast("double")), log.meta)


_THOUSANDS = "th AS (SELECT geo_value, time_value, version, CAST(floor(qty / 1000) AS DOUBLE) AS qty FROM ship)"
_PREVIOUS = "lag(qty) OVER (PARTITION BY geo_value, time_value ORDER BY version)"


@query(f"WITH {SHIP}, {_THOUSANDS} SELECT geo_value, time_value, version, qty FROM (SELECT *, {_PREVIOUS} AS p FROM th) WHERE p IS DISTINCT FROM qty")
def compact(spark, d):
    return _coarse(log_ship(spark, d)).compact().df


@query(f"WITH {SHIP} SELECT geo_value, time_value, version, qty FROM (SELECT *, {_PREVIOUS} AS p FROM ship) WHERE p IS NULL OR abs(qty - p) > 150")
def compact_tol(spark, d):
    return log_ship(spark, d).compact(150.0).df


@query(f"WITH {SHIP}, {_THOUSANDS} SELECT geo_value, time_value, version, qty FROM (SELECT *, {_PREVIOUS} AS p FROM th) WHERE p = qty")
def compact_removed(spark, d):
    return _coarse(log_ship(spark, d)).redundant()


_LATEST = "QUALIFY row_number() OVER (PARTITION BY geo_value, time_value ORDER BY version DESC) = 1"


@query(f"WITH {SHIP} SELECT geo_value, time_value, qty FROM ship WHERE version <= {_AT} {_LATEST}")
def as_of(spark, d):
    return log_ship(spark, d).as_of(_AT).df


@query(f"WITH {SHIP} SELECT geo_value, time_value, qty FROM ship WHERE version <= {_AT} AND time_value >= {_AT - 12} {_LATEST}")
def as_of_min_time(spark, d):
    return log_ship(spark, d).as_of(_AT, min_time=_AT - 12).df


@query(f"WITH {SHIP} SELECT geo_value, time_value, qty FROM ship {_LATEST}")
def as_of_current(spark, d):
    return log_ship(spark, d).as_of_current().df


@query(f"WITH {SHIP} SELECT geo_value, time_value, version, qty FROM ship WHERE version <= {_AT}")
def as_of_all_versions(spark, d):
    return log_ship(spark, d).as_of(_AT, all_versions=True).df


@query(f"WITH {SHIP} SELECT geo_value, time_value, version, qty FROM ship WHERE version <= {_AT - 7}")
def truncate(spark, d):
    return log_ship(spark, d).truncate_versions_after(_AT - 7).df


@query(f"WITH {LINES} SELECT geo_value, time_value, version, lines FROM lines UNION ALL SELECT DISTINCT geo_value, time_value, CAST({LAST2 + 1} AS INTEGER), CAST(NULL AS DOUBLE) FROM lines")
def fill_na(spark, d):
    return log_ship(spark, d, count=True, last=LAST2).fill_through_version(LAST2 + 5, "na").df


@query(f"WITH {LINES} SELECT geo_value, time_value, lines FROM lines {_LATEST}")
def fill_locf(spark, d):
    return log_ship(spark, d, count=True, last=LAST2).fill_through_version(LAST2 + 5, "locf").as_of(LAST2 + 5).df


def _merge_sql(x: str, y: str) -> str:
    return f""", a AS ({x}), b AS ({y}), k AS (SELECT geo_value, time_value, version FROM a UNION SELECT geo_value, time_value, version FROM b),
    m AS (SELECT k.geo_value, k.time_value, k.version, a.qty, b.lines FROM k
      ASOF LEFT JOIN a ON k.geo_value = a.geo_value AND k.time_value = a.time_value AND k.version >= a.version
      ASOF LEFT JOIN b ON k.geo_value = b.geo_value AND k.time_value = b.time_value AND k.version >= b.version)
    SELECT geo_value, time_value, version, qty, lines FROM (SELECT *, lag(qty) OVER w AS pq, lag(lines) OVER w AS pl, row_number() OVER w AS i FROM m WINDOW w AS (PARTITION BY geo_value, time_value ORDER BY version))
    WHERE i = 1 OR qty IS DISTINCT FROM pq OR lines IS DISTINCT FROM pl"""


@query(f"WITH {SHIP}, {LINES}{_merge_sql('FROM ship', 'FROM lines')}")
def merge_locf(spark, d):
    return log_ship(spark, d).merge(log_ship(spark, d, count=True, last=LAST2), sync="locf").df


@query(f"WITH {SHIP}, {LINES}{_merge_sql('FROM ship', f'FROM lines UNION ALL SELECT DISTINCT geo_value, time_value, CAST({LAST2 + 1} AS INTEGER), CAST(NULL AS DOUBLE) FROM lines')}")
def merge_na(spark, d):
    return log_ship(spark, d).merge(log_ship(spark, d, count=True, last=LAST2), sync="na").df


@query(f"WITH {SHIP}, {LINES}{_merge_sql(f'FROM ship WHERE version <= {LAST2}', 'FROM lines')}")
def merge_truncate(spark, d):
    return log_ship(spark, d).merge(log_ship(spark, d, count=True, last=LAST2), sync="truncate").df


@query(f"WITH {SHIP}, {_ship('lines', 'count(*)', 'lines')}{_merge_sql('FROM ship', 'FROM lines')}")
def merge_forbid(spark, d):
    return log_ship(spark, d).merge(log_ship(spark, d, count=True)).df


_VERSIONS = [1997 * 12 + 1, 1998 * 12 + 6, 1998 * 12 + 7, 2000 * 12 + 12]
_VALUES = "(VALUES " + ", ".join(f"({v})" for v in _VERSIONS) + ") AS vs(v)"
_SNAP = f"snap AS (SELECT * FROM ship JOIN {_VALUES} ON version <= v QUALIFY row_number() OVER (PARTITION BY v, geo_value, time_value ORDER BY version DESC) = 1)"


@query(f"WITH {SHIP}, {_SNAP} SELECT CAST(v AS INTEGER) AS version, CAST(sum(qty) AS DOUBLE) AS total, count(*) AS cells FROM snap GROUP BY 1")
def replay_sum(spark, d):
    return log_ship(spark, d).slide({"total": F.sum("qty"), "cells": F.count("*")}, versions=_VERSIONS)


@query(f"WITH {SHIP}, {_SNAP} SELECT geo_value, CAST(v AS INTEGER) AS version, CAST(sum(qty) AS DOUBLE) AS total FROM snap WHERE time_value >= v - 6 GROUP BY 1, 2")
def replay_before(spark, d):
    return log_ship(spark, d).group_by("geo_value").slide({"total": F.sum("qty")}, before=6, versions=_VERSIONS)


@query(f"WITH {SHIP}, vs AS (SELECT CAST(v AS INTEGER) AS v FROM range((SELECT min(version) FROM ship), (SELECT max(version) + 1 FROM ship)) AS r(v)), snap AS (SELECT * FROM ship JOIN vs ON version <= v QUALIFY row_number() OVER (PARTITION BY v, geo_value, time_value ORDER BY version DESC) = 1) SELECT geo_value, v AS version, quantile_cont(qty, 0.5) AS med FROM snap WHERE time_value >= v - 7 GROUP BY 1, 2")
def replay_grouped(spark, d):
    return log_ship(spark, d).group_by("geo_value").slide({"med": F.percentile("qty", F.lit(0.5))}, before=7)


@query(f"WITH {SHIP}, {_SNAP} SELECT geo_value, CAST(v AS INTEGER) AS version, CAST(arg_max(qty, time_value) AS DOUBLE) AS last_qty, CAST(max(time_value) AS INTEGER) AS last_time FROM snap GROUP BY 1, 2")
def replay_lag(spark, d):
    return log_ship(spark, d).group_by("geo_value").slide({"last_qty": F.max_by("qty", "time_value"), "last_time": F.max("time_value")}, versions=_VERSIONS)


def _top(data: pd.DataFrame, key: dict, version) -> pd.DataFrame:
    return data.nlargest(2, ["qty", "time_value"])[["time_value", "qty"]]


@query(f"WITH {SHIP}, {_SNAP} SELECT geo_value, CAST(v AS INTEGER) AS version, time_value, qty FROM snap QUALIFY row_number() OVER (PARTITION BY geo_value, v ORDER BY qty DESC, time_value DESC) <= 2")
def replay_python(spark, d):
    return log_ship(spark, d).group_by("geo_value").slide_python(_top, "time_value int, qty double", versions=_VERSIONS)


def _history(log, key: dict, version) -> pd.DataFrame:
    now, then = log.as_of(version), log.as_of(version - 3)
    return pd.DataFrame({"now": [float(now["qty"].sum())], "then": [float(then["qty"].sum())], "updates": [len(log.frame)]})


@query(f"WITH {SHIP}, {_SNAP}, past AS (SELECT * FROM ship JOIN {_VALUES} ON version <= v - 3 QUALIFY row_number() OVER (PARTITION BY v, geo_value, time_value ORDER BY version DESC) = 1), c AS (SELECT geo_value, v, count(*) AS updates FROM ship JOIN {_VALUES} ON version <= v GROUP BY 1, 2), s AS (SELECT geo_value, v, CAST(sum(qty) AS DOUBLE) AS a FROM snap GROUP BY 1, 2), p AS (SELECT geo_value, v, CAST(sum(qty) AS DOUBLE) AS b FROM past GROUP BY 1, 2) SELECT geo_value, CAST(v AS INTEGER) AS version, a AS now, coalesce(b, 0) AS \"then\", updates FROM s JOIN c USING (geo_value, v) LEFT JOIN p USING (geo_value, v)")
def replay_history(spark, d):
    return log_ship(spark, d).group_by("geo_value").slide_python(_history, "now double, then double, updates long", versions=_VERSIONS, all_versions=True)


_REVISIONS = """c AS (SELECT *, version - time_value AS lag FROM (SELECT *, lag(qty) OVER (PARTITION BY geo_value, time_value ORDER BY version) AS p FROM ship) WHERE p IS DISTINCT FROM qty AND time_value <= (SELECT max(version) FROM ship) - 2),
  l AS (SELECT *, abs(qty - last_value(qty) OVER z) < 0.2 * last_value(qty) OVER z AS near FROM c WINDOW z AS (PARTITION BY geo_value, time_value ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  s AS (SELECT *, CASE WHEN near IS DISTINCT FROM lag(near) OVER (PARTITION BY geo_value, time_value ORDER BY version) THEN version END AS start FROM l),
  t AS (SELECT time_value, geo_value, count(*) - 1 AS n_revisions, CAST(min(lag) AS BIGINT) AS min_lag, CAST(max(lag) AS BIGINT) AS max_lag, CAST(max(start) - time_value AS BIGINT) AS lag_near_latest, max(qty) - min(qty) AS spread,
    (max(qty) - min(qty)) / max(qty) AS rel_spread, min(qty) AS min_value, max(qty) AS max_value, quantile_cont(qty, 0.5) AS median_value FROM s GROUP BY 1, 2)"""


@query(f"WITH {SHIP}, {_REVISIONS} SELECT time_value, geo_value, n_revisions, min_lag, max_lag, lag_near_latest, spread, round(rel_spread, 6) AS rel_spread, min_value, max_value, median_value FROM t")
def revision_table(spark, d):
    return _rounded(log_ship(spark, d).revision_analysis("qty", min_waiting_period=2, only_table=True), "rel_spread")


@query(f"WITH {SHIP}, {_REVISIONS} SELECT count(*) AS n_cells, count_if(n_revisions = 0) AS n_unrevised, count_if(max_lag <= 3) AS n_quick, count_if(n_revisions <= 3) AS n_few, count_if(n_revisions > 0) AS n_revised, count_if(n_revisions > 0 AND (rel_spread < 0.1)) AS n_small_rel_spread, count_if(n_revisions > 0 AND spread > 0.05 * (SELECT max(qty) FROM ship)) AS n_large_spread, CAST(min(lag_near_latest) AS DOUBLE) AS min_lag_near, quantile_cont(CAST(lag_near_latest AS DOUBLE), 0.5) AS median_lag_near, round(avg(lag_near_latest), 1) AS mean_lag_near, CAST(max(lag_near_latest) AS DOUBLE) AS max_lag_near FROM t".replace("count_if(", "CAST(count_if(").replace(") AS n_unrevised", ") AS BIGINT) AS n_unrevised").replace(") AS n_quick", ") AS BIGINT) AS n_quick").replace(") AS n_few", ") AS BIGINT) AS n_few").replace(") AS n_revised", ") AS BIGINT) AS n_revised").replace(") AS n_small_rel_spread", ") AS BIGINT) AS n_small_rel_spread").replace(") AS n_large_spread", ") AS BIGINT) AS n_large_spread"))
def revision_summary(spark, d):
    return log_ship(spark, d).revision_analysis("qty", min_waiting_period=2).summary()


@query(f"WITH {SHIP} SELECT geo_value, time_value, version, qty FROM ship WHERE geo_value IN ('asia', 'europe') AND time_value >= {_AT - 24}")
def filter_log(spark, d):
    return log_ship(spark, d).filter(F.col("geo_value").isin("asia", "europe") & (F.col("time_value") >= _AT - 24)).df


@query(f"WITH {SHIP} SELECT 'custom' AS geo_type, 'integer' AS time_type, max(version) AS versions_end, CAST(NULL AS INTEGER) AS clobberable_start, count(*) AS n_rows, min(time_value) AS min_time, max(time_value) AS max_time, min(version) AS first_version, max(version) AS last_version FROM ship")
def log_describe(spark, d):
    out = log_ship(spark, d).describe()
    return out.withColumn("clobberable_start", F.col("clobberable_start").cast("int"))


@query(f"WITH {SHIP}, vs AS (SELECT CAST({_AT} AS INTEGER) AS v UNION ALL SELECT max(version) FROM ship), snap AS (SELECT * FROM ship JOIN vs ON version <= v QUALIFY row_number() OVER (PARTITION BY v, geo_value, time_value ORDER BY version DESC) = 1) SELECT geo_value, time_value, v AS version, qty AS value, v = (SELECT max(version) FROM ship) AS is_latest FROM snap")
def plot_log(spark, d):
    return plotting.log_plot_data(log_ship(spark, d), "qty", [_AT])


@query(f"WITH {EVENTS} SELECT geo_value, grp, time_value, 'n' AS response_name, CAST(n AS DOUBLE) AS value, geo_value || ' / ' || grp AS color, geo_value AS facet FROM ev")
def plot_panel(spark, d):
    return plotting.panel_plot_data(panel_events(spark, d), ["n"], facet_by="geo_value")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-day trailing mean of orders by region."""
    return roll_mean_right(spark, sf_dir)


