"""Merging two logs, each carried forward along versions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from revpanel.functions.time import PanelError
from revpanel.log import RevisionLog


def merge(x: RevisionLog, y: RevisionLog, sync: str = "forbid", compact: bool = True, abs_tol: float = 0.0) -> RevisionLog:
    """All keys and versions of both logs, with the values that each side had at that version.

    A value that is explicitly null is carried forward too. ``sync`` settles different ends of observation: forbid refuses,
    na and locf extend the shorter log, truncate shortens the longer one. The two logs are stacked and go through one
    shuffle and one sort by key, time and version, in which windows carry both sides forward and compaction follows.
    """
    if sync not in ("forbid", "na", "locf", "truncate"):
        raise PanelError("sync must be forbid, na, locf or truncate")
    for what in ("geo_type", "time_type"):
        if getattr(x.meta, what) != getattr(y.meta, what):
            raise PanelError(f"the logs differ in {what}")
    if set(x.meta.keys) != set(y.meta.keys):
        raise PanelError("the logs have different keys")
    if clash := set(x.values) & set(y.values):
        raise PanelError(f"both logs have the columns {sorted(clash)}")
    starts = [v for v in (x.meta.clobberable_start, y.meta.clobberable_start) if v is not None]
    start = min(starts, default=None)
    ends = x.meta.versions_end, y.meta.versions_end
    if sync == "forbid" and ends[0] != ends[1]:
        raise PanelError(f"the logs are observed through {ends[0]} and {ends[1]}; choose a sync")
    end = min(ends) if sync == "truncate" else max(ends)
    if sync in ("na", "locf"):
        x, y = x.fill_through_version(end, sync), y.fill_through_version(end, sync)
    left, right = x.df, y.df
    if sync == "truncate":
        left, right = (d.where(F.col("version") <= F.lit(end)) for d in (left, right))
    keys, cell = x.meta.keys, x.meta.cell
    one = F.lit(1).alias("__row")
    a = left.select(*keys, F.struct(*x.values, one).alias("__x"))
    b = right.select(*keys, F.struct(*y.values, one).alias("__y"))
    order = Window.partitionBy(*cell).orderBy("version")
    # The RANGE frame reaches over both rows of one version, of which the last is kept.
    upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True)
    both = both.select(*keys, F.last("__x", True).over(upto).alias("__x"), F.last("__y", True).over(upto).alias("__y"), F.lead("version").over(order).eqNullSafe(F.col("version")).alias("__twice"))
    both = both.where("not __twice")
    df = both.select("geo_value", "time_value", *x.meta.other_keys, "version", *[F.col(f"__x.`{c}`").alias(c) for c in x.values], *[F.col(f"__y.`{c}`").alias(c) for c in y.values])
    if start is not None and start > end:
        raise PanelError("clobberable_start is after versions_end")
    out = RevisionLog(df, x.meta.with_(versions_end=end, clobberable_start=start))
    return out.compact(abs_tol) if compact else out
