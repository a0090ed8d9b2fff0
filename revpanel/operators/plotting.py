"""Data behind plots; drawing is left to the caller."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revpanel.functions.time import PanelError
from revpanel.log import RevisionLog
from revpanel.operators.replay import snapshots
from revpanel.operators.versions import grid
from revpanel.panel import Panel


def _measurements(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> list[str]:
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keys]
    if not columns:
        if not numeric:
            raise PanelError("there is no numeric measurement to plot")
        warnings.warn(f"plotting {numeric[0]}", stacklevel=3)
        return numeric[:1]
    good = [c for c in columns if c in numeric]
    if not good:
        raise PanelError(f"none of {list(columns)} is a numeric measurement")
    if len(good) < len(columns):
        warnings.warn(f"left out: {[c for c in columns if c not in good]}", stacklevel=3)
    return good


def _label(parts: Sequence[str]):
    return F.concat_ws(" / ", *[F.col(p).cast("string") for p in parts]) if parts else F.lit(None).cast("string")


def panel_plot_data(panel: Panel, columns: Sequence[str] = (), color_by: str = "all_keys", facet_by: str = "none", facet_filter=None) -> DataFrame:
    """Long rows: keys, response_name, value, and labels color and facet (all_keys, geo_value, other_keys, response, all or none)."""
    columns = _measurements(panel.df, panel.meta.keys, columns)
    long = panel.df.select(*panel.meta.keys, *[F.col(c).cast("double").alias(c) for c in columns])
    long = long.unpivot(panel.meta.keys, columns, "response_name", "value")
    other = list(panel.meta.other_keys)
    names = {"all_keys": panel.meta.series, "geo_value": ["geo_value"], "other_keys": other, "response": ["response_name"], "all": [*panel.meta.series, "response_name"], "none": []}
    for what in (color_by, facet_by):
        if what not in names:
            raise PanelError(f"labels are one of {sorted(names)}")
    out = long.withColumns({"color": _label(names[color_by]), "facet": _label(names[facet_by])})
    return out.where(facet_filter) if facet_filter is not None else out


def log_plot_data(log: RevisionLog, column: str | None = None, versions: Sequence | None = None, facet_filter=None) -> DataFrame:
    """Snapshots at ``versions`` (all but the last, by default) and the latest one, stacked: keys, version, value, is_latest."""
    column = _measurements(log.df, log.meta.keys, [column] if column else [])[0]
    end = log.meta.versions_end
    if versions is None:
        known = grid(log).where(F.col("__v") < F.lit(end))
        rows = snapshots(log, known.union(known.sparkSession.range(1).select(F.lit(end).cast(known.schema["__v"].dataType))))
    else:
        rows = snapshots(log, [*[v for v in versions if v < end], end])
    out = rows.select(*log.meta.cell, F.col("__v").alias("version"), F.col(column).cast("double").alias("value"))
    out = out.withColumn("is_latest", F.col("version") == F.lit(log.meta.versions_end))
    return out.where(facet_filter) if facet_filter is not None else out
