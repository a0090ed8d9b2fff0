"""RevisionLog: the version history of a panel, as a log of changes."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revpanel.functions.time import PanelError, plus_steps, shift
from revpanel.meta import LogMeta, PanelMeta, duplicated, geo_column_names, guess_column, guess_geo_type, guess_time_type, time_column_names, version_column_names
from revpanel.panel import Panel


def locf_flags(df: DataFrame, cell: Sequence[str], values: Sequence[str], abs_tol: float = 0.0) -> Column:
    """Whether a row's values repeat those of the version before: numbers within ``abs_tol`` of the row just before.

    Null and NaN are one missing value. A plain lag: a slow drift within the tolerance counts as no change.
    """
    w = Window.partitionBy(*cell).orderBy("version")
    same = F.row_number().over(w) > 1
    for c in values:
        x = F.col(c)
        if isinstance(df.schema[c].dataType, T.NumericType):
            if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
                x = F.nanvl(x, F.lit(None))
            p = F.lag(x).over(w)
            near = F.abs(x.cast("double") - p.cast("double")) <= abs_tol if abs_tol else x == p
            same = same & F.when(x.isNotNull() & p.isNotNull(), near).otherwise(x.isNull() & p.isNull())
        else:
            same = same & x.eqNullSafe(F.lag(x).over(w))
    return same


def compactify(df: DataFrame, cell: Sequence[str], values: Sequence[str], abs_tol: float = 0.0) -> DataFrame:
    return df.withColumn("__locf", locf_flags(df, cell, values, abs_tol)).where("not __locf").drop("__locf")


@dataclass(frozen=True)
class RevisionLog:
    df: DataFrame
    meta: LogMeta
    groups: tuple[str, ...] = ()
    #: Levels of group columns whose unused ones are kept, by column.
    levels: tuple[tuple[str, tuple], ...] = ()

    # -- construction ---------------------------------------------------------------------------------------------
    @classmethod
    def from_df(cls, df: DataFrame, other_keys: Sequence[str] = (), compact: bool | str = True, abs_tol: float = 0.0, versions_end: Any = None, clobberable_start: Any = None, rename: dict[str, str] | None = None, geo_type: str | None = None, time_type: str | None = None, validate: bool = True) -> RevisionLog:
        """Rename or guess the key columns, check the log's rules, and drop rows that repeat the version before.

        ``compact="message"`` also says how many rows were dropped. ``versions_end`` defaults to the largest version of
        the input, before compaction.
        """
        df = df.withColumnsRenamed(rename or {})
        for name, aliases in (("time_value", time_column_names()), ("geo_value", geo_column_names()), ("version", version_column_names())):
            df = guess_column(df, name, aliases)
        if missing := [k for k in other_keys if k not in df.columns]:
            raise PanelError(f"other_keys are not columns: {missing}")
        if df.schema["time_value"].dataType != df.schema["version"].dataType:
            raise PanelError("time_value and version must be of one type")
        meta = LogMeta(geo_type or guess_geo_type(df), time_type or guess_time_type(df), tuple(other_keys))
        values = [c for c in df.columns if c not in meta.keys]
        df = df.select("geo_value", "time_value", *other_keys, "version", *values)
        if versions_end is None:
            versions_end = max_version(df)
        log = cls(df, meta.with_(versions_end=versions_end, clobberable_start=clobberable_start))
        if validate:
            log.validate()
        if compact:
            before = df.count() if compact == "message" else None
            log = log.compact(abs_tol)
            if before is not None and (dropped := before - log.df.count()):
                warnings.warn(f"compaction dropped {dropped} of {before} rows; compact=False keeps them", stacklevel=2)
        return log

    def validate(self) -> None:
        row = self.df.agg(F.max("version").alias("most"), F.count_if(F.col("version").isNull()).alias("nulls")).first()
        if row["nulls"]:
            raise PanelError("version is null in some rows")
        self.check_bound(self.meta.versions_end, "versions_end", False)
        self.check_bound(self.meta.clobberable_start, "clobberable_start", True)
        if row["most"] is not None and self.meta.versions_end < row["most"]:
            raise PanelError(f"versions_end {self.meta.versions_end} is before the version {row['most']}")
        start = self.meta.clobberable_start
        if start is not None and start > self.meta.versions_end:
            raise PanelError("clobberable_start is after versions_end")
        if rows := duplicated(self.df, self.meta.keys):
            raise PanelError(f"several rows for one key {self.meta.keys}: {[tuple(r)[:-1] for r in rows]}")

    def check_bound(self, value: Any, what: str, null_ok: bool) -> None:
        if value is None:
            if not null_ok:
                raise PanelError(f"{what} must not be null")
            return
        kind = self.df.schema["version"].dataType
        ok = {T.DateType: "date", T.TimestampType: "datetime", T.StringType: "str"}.get(type(kind))
        good = type(value).__name__ == ok if ok else isinstance(value, (int, float)) and not isinstance(value, bool)
        if not good:
            raise PanelError(f"{what} must be of the type of version, {kind.simpleString()}")

    @property
    def values(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.meta.keys]

    def key_columns(self, exclude: Sequence[str] = ()) -> list[str]:
        return [k for k in self.meta.keys if k not in exclude]

    def clone(self) -> RevisionLog:
        return self

    def with_versions_end(self, v: Any) -> RevisionLog:
        """Moves the observed bound without a check against the data."""
        self.check_bound(v, "versions_end", False)
        return replace(self, meta=self.meta.with_(versions_end=v))

    def compact(self, abs_tol: float = 0.0) -> RevisionLog:
        return replace(self, df=compactify(self.df, self.meta.cell, self.values, abs_tol))

    def redundant(self, abs_tol: float = 0.0) -> DataFrame:
        """The rows that compaction drops."""
        return self.df.withColumn("__locf", locf_flags(self.df, self.meta.cell, self.values, abs_tol)).where("__locf").drop("__locf")

    def describe(self) -> DataFrame:
        m = self.meta
        rows = self.df.agg(F.count("*").alias("n_rows"), F.min("time_value").alias("min_time"), F.max("time_value").alias("max_time"), F.min("version").alias("first_version"), F.max("version").alias("last_version"))
        fixed = [F.lit(m.geo_type).alias("geo_type"), F.lit(m.time_type).alias("time_type"), F.lit(m.versions_end).alias("versions_end"), F.lit(m.clobberable_start).alias("clobberable_start")]
        return rows.select(*fixed, "*")

    # -- snapshots ------------------------------------------------------------------------------------------------
    def _check_version(self, v: Any) -> None:
        self.check_bound(v, "version", False)
        if v > self.meta.versions_end:
            raise PanelError(f"version {v} is after versions_end {self.meta.versions_end}")
        if self.meta.clobberable_start is not None and v >= self.meta.clobberable_start:
            warnings.warn(f"version {v} may still be overwritten", stacklevel=3)

    def as_of(self, version: Any, min_time: Any = None, all_versions: bool = False) -> Panel | RevisionLog:
        """The panel as known at ``version``: per key and time the last row not after it. ``all_versions`` gives a log."""
        self._check_version(version)
        df = self.df.where(F.col("version") <= F.lit(version))
        if min_time is not None and not (isinstance(min_time, float) and math.isinf(min_time)):
            df = df.where(F.col("time_value") >= F.lit(min_time))
        if all_versions:
            return replace(self, df=df, groups=(), levels=()).truncated_meta(version)
        m = self.meta
        fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)
        if not self.values:
            df = df.select(*m.cell).distinct()
        elif all(isinstance(self.df.schema[c].dataType, fixed) for c in self.values):
            # Fixed-width buffers stay in the hash aggregate; a struct would sort.
            df = df.groupBy(*m.cell).agg(*[F.max_by(c, "version").alias(c) for c in self.values])
        else:
            last = df.groupBy(*m.cell).agg(F.max_by(F.struct(*self.values), "version").alias("__s"))
            df = last.select(*m.cell, *[F.col(f"__s.`{c}`").alias(c) for c in self.values])
        return Panel(df, PanelMeta(m.geo_type, m.time_type, version, m.other_keys))

    def as_of_current(self, **kw) -> Panel | RevisionLog:
        return self.as_of(self.meta.versions_end, **kw)

    def truncated_meta(self, v: Any) -> RevisionLog:
        start = self.meta.clobberable_start
        return replace(self, meta=self.meta.with_(versions_end=v, clobberable_start=None if start is not None and start > v else start))

    def truncate_versions_after(self, v: Any) -> RevisionLog:
        self.check_bound(v, "version", False)
        if v > self.meta.versions_end:
            raise PanelError(f"version {v} is after versions_end {self.meta.versions_end}")
        return replace(self, df=self.df.where(F.col("version") <= F.lit(v))).truncated_meta(v)

    def fill_through_version(self, v: Any, how: str = "na") -> RevisionLog:
        """Extend the observed bound to ``v``: "locf" says nothing changed, "na" that nothing is known from the next version on."""
        if how not in ("na", "locf"):
            raise PanelError("how must be na or locf")
        self.check_bound(v, "version", False)
        if v <= self.meta.versions_end:
            return self
        df = self.df
        if how == "na":
            after = shift(self.meta.versions_end, 1, "day" if self.meta.time_type == "week" else self.meta.time_type)
            kind = df.schema["version"].dataType
            blank = df.select(*self.meta.cell).distinct().withColumn("version", F.lit(after).cast(kind))
            df = df.unionByName(blank.select(*self.meta.keys), allowMissingColumns=True)
        return replace(self, df=df, meta=self.meta.with_(versions_end=v))

    # -- rows -----------------------------------------------------------------------------------------------------
    def filter(self, cond: Column | str, format_aware: bool = False, by: Sequence[str] = ()) -> RevisionLog:
        """Rows by a condition on the key columns other than version; the bounds stay.

        A condition that looks at version or a measurement would change what the log says was known, and is refused
        unless ``format_aware``. ``by`` makes aggregates in the condition windows over these columns, as {name: Column}
        conditions cannot; give Window expressions for that.
        """
        cond = F.expr(cond) if isinstance(cond, str) else cond
        if not format_aware:
            keys = [f for f in self.df.schema.fields if f.name in self.meta.cell]
            empty = self.df.sparkSession.createDataFrame([], T.StructType(keys))
            try:
                _ = empty.where(cond).schema
            except Exception as e:
                raise PanelError("a log is filtered by its keys without version; format_aware=True allows others") from e
        if by:
            w = Window.partitionBy(*by)
            df = self.df.withColumn("__ok", F.coalesce(F.bool_and(cond).over(w), F.lit(False))).where("__ok").drop("__ok")
        else:
            df = self.df.where(cond)
        time_type = self.meta.time_type
        if time_type == "day":
            time_type = guess_time_type(df)
        return replace(self, df=df, meta=self.meta.with_(time_type=time_type))

    def group_by(self, *cols: str, add: bool = False, drop: bool = True, levels: dict[str, Sequence] | None = None, **new: Column) -> RevisionLog:
        """Group by columns, or by new ones computed here; version is no group, and keys are not replaced.

        ``drop=False`` with ``levels`` keeps groups of levels that do not occur.
        """
        if "version" in (*cols, *new):
            raise PanelError("version cannot be a group")
        if clash := set(new) & set(self.meta.keys):
            raise PanelError(f"key columns are not replaced: {sorted(clash)}")
        df = self.df.withColumns(new) if new else self.df
        names = tuple(dict.fromkeys([*(self.groups if add else ()), *cols, *new]))
        if missing := [c for c in names if c not in df.columns]:
            raise PanelError(f"no such columns: {missing}")
        if not drop and not levels:
            warnings.warn("drop=False has an effect only for columns with levels", stacklevel=2)
        kept = tuple((c, tuple(v)) for c, v in (levels or {}).items() if c in names) if not drop else ()
        return replace(self, df=df, groups=names, levels=kept)

    def ungroup(self, *cols: str) -> RevisionLog:
        groups = tuple(g for g in self.groups if cols and g not in cols)
        return replace(self, groups=groups, levels=tuple(x for x in self.levels if x[0] in groups))

    def default_versions(self) -> list:
        """All versions from the first to versions_end, in steps of the period of those that occur; ``versions.grid`` is their table."""
        from revpanel.operators.versions import default_list

        return default_list(self)

    # -- operators ------------------------------------------------------------------------------------------------
    def merge(self, other: RevisionLog, **kw) -> RevisionLog:
        from revpanel.operators.merge import merge

        return merge(self, other, **kw)

    def snapshots(self, *args, **kw) -> DataFrame:
        from revpanel.operators.replay import snapshots

        return snapshots(self, *args, **kw)

    def slide(self, *args, **kw) -> DataFrame:
        from revpanel.operators.replay import slide

        return slide(self, *args, **kw)

    def slide_python(self, *args, **kw) -> DataFrame:
        from revpanel.operators.replay import slide_python

        return slide_python(self, *args, **kw)

    def revision_analysis(self, *args, **kw):
        from revpanel.operators.revision import revision_analysis

        return revision_analysis(self, *args, **kw)


def max_version(df: DataFrame) -> Any:
    """The largest version; no rows or a null version are an error."""
    row = df.agg(F.max("version").alias("v"), F.count_if(F.col("version").isNull()).alias("nulls")).first()
    if row["nulls"] or row["v"] is None:
        raise PanelError("a log without rows or with null versions needs versions_end to be stated")
    return row["v"]


__all__ = ["RevisionLog", "compactify", "locf_flags", "max_version", "plus_steps"]
