"""Panel: a snapshot with one row per location, other keys and time."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revpanel.functions.time import PanelError, index
from revpanel.meta import PanelMeta, check_unique, geo_column_names, guess_column, guess_geo_type, guess_time_type, time_column_names


@dataclass(frozen=True)
class Panel:
    """A DataFrame with its metadata and grouping. Every verb returns a new Panel, or a DataFrame once keys are gone."""

    df: DataFrame
    meta: PanelMeta
    groups: tuple[str, ...] = ()

    # -- construction ---------------------------------------------------------------------------------------------
    @classmethod
    def from_df(cls, df: DataFrame | Panel, as_of: Any = None, other_keys: Sequence[str] = (), rename: dict[str, str] | None = None, geo_type: str | None = None, time_type: str | None = None, validate: bool = True) -> Panel:
        """Rename or guess the key columns, infer the types unless stated, and check that keys are unique.

        ``rename`` maps old names to new ones. ``as_of`` defaults to the largest as_of, issue or version in the data.
        """
        if isinstance(df, Panel):
            return df if as_of is None else replace(df, meta=replace(df.meta, as_of=as_of))
        df = df.withColumnsRenamed(rename or {})
        df = guess_column(guess_column(df, "time_value", time_column_names()), "geo_value", geo_column_names())
        missing = [k for k in other_keys if k not in df.columns]
        if missing:
            raise PanelError(f"other_keys are not columns: {missing}")
        if len(set(df.columns)) != len(df.columns):
            raise PanelError("column names repeat")
        geo_type = geo_type or guess_geo_type(df)
        time_type = time_type or guess_time_type(df)
        if as_of is None:
            source = next((c for c in ("as_of", "issue", "version") if c in df.columns), None)
            if source:
                as_of = df.agg(F.max(source)).first()[0]
        panel = cls(df, PanelMeta(geo_type, time_type, as_of, tuple(other_keys))).canonical_columns()
        if validate:
            check_unique(panel.df, panel.meta.keys)
        return panel

    def wrap(self, df: DataFrame) -> Panel | DataFrame:
        """``df`` as a Panel of the same metadata; a DataFrame if geo_value or time_value is gone."""
        if not {"geo_value", "time_value"} <= set(df.columns):
            return df
        if len(set(df.columns)) != len(df.columns):
            raise PanelError("column names repeat")
        meta = replace(self.meta, other_keys=tuple(k for k in self.meta.other_keys if k in df.columns))
        return Panel(df, meta, tuple(g for g in self.groups if g in df.columns))

    # -- metadata -------------------------------------------------------------------------------------------------
    def key_columns(self, exclude: Sequence[str] = ()) -> list[str]:
        return [k for k in self.meta.keys if k not in exclude]

    @property
    def values(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.meta.keys]

    def to_df(self) -> DataFrame:
        return self.df

    def to_pandas(self):
        return self.df.toPandas()

    def interval(self) -> int:
        """The largest period (days, months or units) that divides all gaps within series; two times of one series are needed."""
        w = Window.partitionBy(*self.meta.series).orderBy("__t")
        gaps = self.df.select(*self.meta.series, self.index().alias("__t")).select((F.col("__t") - F.lag("__t").over(w)).alias("gap"))
        found = [r["gap"] for r in gaps.where("gap > 0").distinct().toLocalIterator()]
        if not found:
            raise PanelError("an interval needs two distinct times in a series")
        return math.gcd(*found)

    def to_regular(self) -> tuple[DataFrame, int]:
        """The rows in canonical order, with unique keys, and their interval: what a regular time series table is."""
        check_unique(self.df, self.meta.keys)
        return self.arrange_canonical().df, self.interval()

    def describe(self) -> DataFrame:
        """One row: types, as_of, rows, first and last time, and average rows per time (whole)."""
        by = self.df.groupBy("time_value").agg(F.count("*").alias("n"))
        m = self.meta
        fixed = [F.lit(m.geo_type).alias("geo_type"), F.lit(m.time_type).alias("time_type"), F.lit(None if m.as_of is None else str(m.as_of)).cast("string").alias("as_of")]
        rows = by.agg(F.sum("n").alias("n_rows"), F.min("time_value").alias("min_time"), F.max("time_value").alias("max_time"), F.floor(F.avg("n")).cast("long").alias("rows_per_time"))
        return rows.select(*fixed, "*")

    # -- verbs ----------------------------------------------------------------------------------------------------
    def filter(self, cond: Column | str) -> Panel:
        return self.wrap(self.df.where(cond))

    where = filter

    def head(self, n: int = 6) -> Panel:
        return self.wrap(self.df.limit(n))

    def arrange(self, *cols) -> Panel:
        return self.wrap(self.df.orderBy(*cols))

    def slice(self, positions: Sequence[int]) -> Panel:
        """Rows at 0-based positions of the canonical row order (per group, if grouped)."""
        # Ungrouped, only the rows up to the last position come together.
        df = self.df if self.groups else self.df.orderBy(*self.meta.keys).limit(max(positions, default=-1) + 1)
        w = Window.partitionBy(*self.groups) if self.groups else Window.partitionBy(F.lit(0))
        rows = df.withColumn("__i", F.row_number().over(w.orderBy(*self.meta.keys)) - 1)
        return self.wrap(rows.where(F.col("__i").isin(list(positions))).drop("__i"))

    def mutate(self, **cols: Column) -> Panel:
        return self.wrap(self.df.withColumns(cols))

    def select(self, *cols) -> Panel | DataFrame:
        return self.wrap(self.df.select(*cols))

    def drop(self, *cols: str) -> Panel | DataFrame:
        return self.wrap(self.df.drop(*cols))

    def rename(self, names: dict[str, str]) -> Panel | DataFrame:
        """Rename columns {old: new}; renamed keys stay keys."""
        meta = replace(self.meta, other_keys=tuple(names.get(k, k) for k in self.meta.other_keys))
        moved = Panel(self.df, meta, tuple(names.get(g, g) for g in self.groups))
        return moved.wrap(self.df.withColumnsRenamed(names))

    def relocate(self, *first: str) -> Panel:
        return self.wrap(self.df.select(*first, *[c for c in self.df.columns if c not in first]))

    def group_by(self, *cols: str, add: bool = False) -> Panel:
        missing = [c for c in cols if c not in self.df.columns]
        if missing:
            raise PanelError(f"no such columns: {missing}")
        return replace(self, groups=tuple(dict.fromkeys([*(self.groups if add else ()), *cols])))

    def group_by_series(self) -> Panel:
        """Group by location and other keys."""
        return self.group_by(*self.meta.series)

    def ungroup(self) -> Panel:
        return replace(self, groups=())

    def group_modify(self, f: Callable, schema: T.StructType | str) -> Panel | DataFrame:
        """f(key, pandas frame) -> pandas frame, for each group."""
        if not self.groups:
            raise PanelError("group_modify needs a grouped panel")
        return self.wrap(self.df.groupBy(*self.groups).applyInPandas(f, schema))

    def summarize(self, **aggs: Column) -> Panel | DataFrame:
        return self.wrap(self.df.groupBy(*self.groups).agg(*[c.alias(n) for n, c in aggs.items()]))

    def unnest(self, column: str) -> Panel:
        """Explode an array column; unpack a struct column (or the structs of the array)."""
        df, kind = self.df, self.df.schema[column].dataType
        if isinstance(kind, T.ArrayType):
            df = df.withColumn(column, F.explode(column))
            kind = kind.elementType
        if isinstance(kind, T.StructType):
            df = df.select(*[c for c in df.columns if c != column], f"{column}.*")
        return self.wrap(df)

    def inner_join(self, other: DataFrame | Panel, on: Sequence[str]) -> Panel:
        return self.wrap(self.df.join(other.df if isinstance(other, Panel) else other, list(on), "inner"))

    def left_join(self, other: DataFrame | Panel, on: Sequence[str]) -> Panel:
        return self.wrap(self.df.join(other.df if isinstance(other, Panel) else other, list(on), "left"))

    # -- canonical order ------------------------------------------------------------------------------------------
    def canonical_columns(self) -> Panel:
        """Keys first."""
        return self.wrap(self.df.select(*self.meta.keys, *self.values))

    def canonical_rows(self) -> Panel:
        return self.wrap(self.df.orderBy(*self.meta.keys))

    def arrange_canonical(self) -> Panel:
        return self.canonical_columns().canonical_rows()

    def index(self) -> Column:
        return index("time_value", self.meta.time_type)

    def pivot_longer(self, columns: Sequence[str], names_to: str = "name", values_to: str = "value") -> DataFrame:
        ids = [c for c in self.df.columns if c not in columns]
        return self.df.unpivot(ids, list(columns), names_to, values_to)

    def __getattr__(self, name: str):
        if name in ("sum", "mean", "prod", "min", "max", "all", "any", "range"):
            raise PanelError(f"{name}() of a whole panel mixes keys and values; aggregate columns with summarize() or sum_groups()")
        raise AttributeError(name)

    # -- operators ------------------------------------------------------------------------------------------------
    def roll(self, *args, **kw) -> Panel:
        from revpanel.operators.windows import roll

        return roll(self, *args, **kw)

    def roll_mean(self, columns, size=None, **kw) -> Panel:
        return self.roll(columns, "mean", size, **kw)

    def roll_sum(self, columns, size=None, **kw) -> Panel:
        return self.roll(columns, "sum", size, **kw)

    def slide(self, *args, **kw) -> Panel:
        from revpanel.operators.windows import slide

        return slide(self, *args, **kw)

    def slide_function(self, *args, **kw) -> Panel:
        from revpanel.operators.windows import slide_function

        return slide_function(self, *args, **kw)

    def slide_python(self, *args, **kw) -> Panel:
        from revpanel.operators.windows import slide_python

        return slide_python(self, *args, **kw)

    def complete(self, *args, **kw) -> Panel:
        from revpanel.operators.completion import complete

        return complete(self, *args, **kw)

    def gaps(self) -> DataFrame:
        from revpanel.operators.completion import gaps

        return gaps(self)

    def sum_groups(self, *args, **kw) -> Panel:
        from revpanel.operators.aggregate import sum_groups

        return sum_groups(self, *args, **kw)

    def cor(self, *args, **kw) -> DataFrame:
        from revpanel.operators.correlation import correlation

        return correlation(self, *args, **kw)

    def growth_rate(self, *args, **kw) -> Panel:
        from revpanel.operators.growth import growth_rate

        return growth_rate(self, *args, **kw)

    def detect_outliers(self, *args, **kw) -> Panel:
        from revpanel.operators.outliers import detect_outliers

        return detect_outliers(self, *args, **kw)
