"""Aggregation over keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import functions as F

from revpanel.functions.time import PanelError
from revpanel.panel import Panel


def sum_groups(panel: Panel, columns: str | Sequence[str], by: str | Sequence[str] = "time_value") -> Panel:
    """Sum columns over the keys that are not in ``by`` (time_value always is); a null makes its sum null.

    Without geo_value in ``by`` the location is "total".
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    by = [by] if isinstance(by, str) else list(by)
    if strange := [c for c in by if c not in panel.meta.keys]:
        raise PanelError(f"not key columns: {strange}")
    if strange := [c for c in columns if c not in panel.values]:
        raise PanelError(f"not measurement columns: {strange}")
    group = list(dict.fromkeys([*by, "time_value"]))
    df = panel.df.groupBy(*group).agg(*[F.when(F.count(c) == F.count("*"), F.sum(c)).alias(c) for c in columns])
    if "geo_value" not in group:
        df = df.withColumn("geo_value", F.lit("total"))
    meta = replace(panel.meta, other_keys=tuple(k for k in panel.meta.other_keys if k in group))
    return Panel(df, meta).canonical_columns()


def share_of_total(panel: Panel, column: str, by: Sequence[str], name: str) -> Panel:
    """Adds ``column`` divided by its total within ``by``."""
    from pyspark.sql import Window

    total = F.sum(column).over(Window.partitionBy(*by))
    return panel.wrap(panel.df.withColumn(name, F.try_divide(F.col(column).cast("double"), total)))
