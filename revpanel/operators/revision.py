"""How values were revised: lags, spreads, and when they came near their latest value."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revpanel.functions.time import PanelError, ceiling_steps, format_steps, shift, steps_between, to_steps
from revpanel.log import RevisionLog, compactify

_DEFAULT = dt.timedelta(days=60)


@dataclass(frozen=True)
class RevisionAnalysis:
    """The table of one row per key and time, with what is needed to summarise it."""

    table: DataFrame
    log: RevisionLog
    column: str
    within_latest: float
    drop_nulls: bool

    def totals(self) -> dict[str, Any]:
        c = F.col(self.column)
        row = self.log.df.agg(F.min("time_value").alias("first_time"), F.max("time_value").alias("last_time"), F.count_if(c.isNull()).alias("total_null"), F.max(c).alias("max_value"), F.count("*").alias("n_rows")).first()
        return row.asDict()

    def summary(self, quick_revision: Any = None, few_revisions: int = 3, abs_spread_threshold: float | None = None, rel_spread_threshold: float = 0.1) -> DataFrame:
        """One row: how many cells are unrevised, quickly settled, little revised, and of small or large spread.

        quick_revision (steps or a duration) defaults to 3 days, abs_spread_threshold to 5 % of the largest value. A missing
        relative spread counts as small.
        """
        tt = self.log.meta.time_type
        if quick_revision is None:
            quick_revision = 3 if tt == "integer" else ceiling_steps(dt.timedelta(days=3), tt)
        quick = to_steps(quick_revision, tt)
        if abs_spread_threshold is None:
            most = self.totals()["max_value"]
            abs_spread_threshold = 0.05 * float(most if most is not None else 0)
        revised = F.col("n_revisions") > 0
        rel = F.col("rel_spread")
        lag = F.col("lag_near_latest").cast("double")
        return self.table.agg(
            F.count("*").alias("n_cells"),
            F.count_if(F.col("n_revisions") == 0).alias("n_unrevised"),
            F.count_if(F.col("max_lag") <= quick).alias("n_quick"),
            F.count_if(F.col("n_revisions") <= few_revisions).alias("n_few"),
            F.count_if(revised).alias("n_revised"),
            F.count_if(revised & (rel.isNull() | F.isnan(rel) | (rel < rel_spread_threshold))).alias("n_small_rel_spread"),
            F.count_if(revised & (F.col("spread") > abs_spread_threshold)).alias("n_large_spread"),
            F.min(lag).alias("min_lag_near"),
            F.percentile(lag, F.lit(0.5)).alias("median_lag_near"),
            F.round(F.avg(lag), 1).alias("mean_lag_near"),
            F.max(lag).alias("max_lag_near"),
        )

    def show(self, **kw) -> str:
        row, tt = self.summary(**kw).first(), self.log.meta.time_type
        part = lambda a, b: f"{a:,} out of {b:,} ({round(100 * a / b, 2) if b else float('nan')}%)"
        lines = [
            f"Cells without revisions: {part(row['n_unrevised'], row['n_cells'])}",
            f"Settled quickly: {part(row['n_quick'], row['n_cells'])}",
            f"Few revisions: {part(row['n_few'], row['n_cells'])}",
            f"Revised, with a small relative spread: {part(row['n_small_rel_spread'], row['n_revised'])}",
            f"Revised, with a large spread: {part(row['n_large_spread'], row['n_revised'])}",
        ]
        if row["max_lag_near"] is not None:
            lines.append(f"Within {100 * self.within_latest:g}% of the latest value after {format_steps(int(row['min_lag_near']), tt)} to {format_steps(int(row['max_lag_near']), tt)}")
        return "\n".join(lines)


def revision_analysis(log: RevisionLog, column: str | None = None, drop_nulls: bool = True, min_waiting_period: Any = _DEFAULT, within_latest: float = 0.2, compact: bool = True, abs_tol: float = 0.0, only_table: bool = False) -> RevisionAnalysis | DataFrame:
    """Per key and time: revisions, lags in steps, spread and values over the versions of ``column``.

    Times within ``min_waiting_period`` (steps or a duration; None for none) of versions_end are left out. With
    drop_nulls=False the whole log is looked at, without that filter. lag_near_latest is the lag from which on the value stays
    within ``within_latest`` of its latest.
    """
    if column is None:
        if len(log.values) != 1:
            raise PanelError(f"choose one of the columns {log.values}")
        column = log.values[0]
    if column not in log.values:
        raise PanelError(f"no such measurement: {column}")
    tt, cell = log.meta.time_type, log.meta.cell
    if drop_nulls:
        df = log.df.select(*log.meta.keys, column)
        if min_waiting_period is not None:
            if isinstance(min_waiting_period, dt.timedelta):
                if tt == "integer":
                    raise PanelError("state min_waiting_period in steps for integer times")
                min_waiting_period = ceiling_steps(min_waiting_period, tt)
            df = df.where(F.col("time_value") <= F.lit(shift(log.meta.versions_end, -to_steps(min_waiting_period, tt), tt)))
        df = df.where(F.col(column).isNotNull())
    else:
        df = log.df
    if compact:
        df = compactify(df, cell, [c for c in df.columns if c not in log.meta.keys], abs_tol)
    v, w = F.col(column).cast("double"), Window.partitionBy(*cell).orderBy("version")
    df = df.select(*cell, "version", v.alias("__v"), steps_between(F.col("version"), F.col("time_value"), tt).alias("__lag"))
    latest = F.last("__v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    df = df.withColumn("__near", F.abs(F.col("__v") - latest) < within_latest * latest)
    before = F.lag("__near").over(w)
    # A run starts at the first row, where the flag turns, and at a missing flag; the last start is what counts.
    starts = (F.row_number().over(w) == 1) | F.col("__near").isNull() | before.isNull() | (F.col("__near") != before)
    df = df.withColumn("__start", starts)
    inf = F.lit(float("inf"))
    most = F.coalesce(F.max("__v"), inf)
    least = F.coalesce(F.min("__v"), inf)
    table = df.groupBy(*cell).agg(
        (F.count("*") - 1).alias("n_revisions"),
        F.min("__lag").alias("min_lag"),
        F.max("__lag").alias("max_lag"),
        F.max_by("__lag", F.when(F.col("__start"), F.col("version"))).alias("lag_near_latest"),
        least.alias("min_value"),
        most.alias("max_value"),
        F.coalesce(F.percentile("__v", F.lit(0.5)), inf).alias("median_value"),
    )
    nan = F.lit(float("nan"))
    spread = F.when(F.col("max_value") == float("inf"), nan).otherwise(F.col("max_value") - F.col("min_value"))
    zero = F.when(F.col("spread") == 0, nan).when(F.col("spread") > 0, inf).otherwise(-inf)
    table = table.withColumn("spread", spread).withColumn("rel_spread", F.when(F.col("max_value") == 0, zero).otherwise(F.col("spread") / F.col("max_value")))
    table = table.select("time_value", "geo_value", *log.meta.other_keys, "n_revisions", "min_lag", "max_lag", "lag_near_latest", "spread", "rel_spread", "min_value", "max_value", "median_value")
    return table if only_table else RevisionAnalysis(table, log, column, within_latest, drop_nulls)
