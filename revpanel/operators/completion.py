"""Completion of missing keys, and gaps."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revpanel.functions.time import STEP, from_index, index, to_steps
from revpanel.panel import Panel


def complete(panel: Panel, period=1, fill: dict[str, Any] | None = None, explicit: bool = True) -> Panel:
    """Add a row for each missing time: ungrouped, of every series on the common range; grouped, on each group's own range.

    ``period`` is in steps. ``fill`` replaces the nulls of added rows, and with ``explicit`` those that were there.
    """
    tt, series = panel.meta.time_type, panel.meta.series
    by = to_steps(period, tt) * STEP[tt]
    at = panel.df.withColumn("__t", index("time_value", tt))
    ends = [F.min("__t").alias("lo"), F.max("__t").alias("hi")]
    keys = at.select(*series).distinct()
    if panel.groups:
        groups = [g for g in panel.groups if g in series]
        keys = keys.join(at.groupBy(*groups).agg(*ends), groups) if groups else keys.crossJoin(at.agg(*ends))
    else:
        # one row of bounds
        keys = keys.crossJoin(F.broadcast(at.agg(*ends)))
    grid = keys.select(*series, F.explode(F.sequence("lo", "hi", F.lit(by))).alias("__t"))
    joined = grid.join(at.withColumn("__here", F.lit(True)).drop("time_value"), [*series, "__t"], "full")
    joined = joined.withColumn("time_value", from_index(F.col("__t"), tt).cast(panel.df.schema["time_value"].dataType))
    new = F.col("__here").isNull()
    for c, v in (fill or {}).items():
        old = F.coalesce(F.col(c), F.lit(v)) if explicit else F.when(new, F.coalesce(F.col(c), F.lit(v))).otherwise(F.col(c))
        joined = joined.withColumn(c, old)
    return panel.wrap(joined.select(*panel.df.columns)).canonical_columns()


def gaps(panel: Panel) -> DataFrame:
    """Runs of missing times inside each series: first and last missing time, and how many."""
    tt, series = panel.meta.time_type, panel.meta.series
    step = STEP[tt]
    w = Window.partitionBy(*series).orderBy("__t")
    rows = panel.df.select(*series, index("time_value", tt).alias("__t")).withColumn("__n", F.lead("__t").over(w))
    rows = rows.where(F.col("__n") - F.col("__t") > step)
    kind = panel.df.schema["time_value"].dataType
    day = lambda c: from_index(c, tt).cast(kind)
    return rows.select(*series, day(F.col("__t") + step).alias("from_time"), day(F.col("__n") - step).alias("to_time"), ((F.col("__n") - F.col("__t")) / step - 1).cast("long").alias("n_missing"))


def has_gaps(panel: Panel) -> DataFrame:
    """One row per series: whether times are missing inside it."""
    found = gaps(panel).groupBy(*panel.meta.series).agg(F.sum("n_missing").alias("n"))
    keys = panel.df.select(*panel.meta.series).distinct()
    return keys.join(found, panel.meta.series, "left").select(*panel.meta.series, F.col("n").isNotNull().alias("has_gaps"))


def fill_forward(panel: Panel, *columns: str) -> Panel:
    """Nulls become the last earlier value of the series."""
    w = Window.partitionBy(*panel.meta.series).orderBy("time_value").rowsBetween(Window.unboundedPreceding, 0)
    return panel.wrap(panel.df.withColumns({c: F.last(c, True).over(w) for c in columns}))
