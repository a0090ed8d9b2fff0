"""Metadata of panels and logs: key columns, inferred types, column aliases."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revpanel.functions.time import PanelError

# Names taken for a key column when the column itself is missing.
TIME_NAMES = (
    "time_value", "date", "time", "datetime", "dateTime", "date_time", "target_date", "week", "epiweek", "month",
    "mon", "year", "yearmon", "yearmonth", "yearMon", "yearMonth", "dates", "time_values", "target_dates", "time_Value",
)
GEO_NAMES = (
    "geo_value", "geo_values", "geo_id", "geos", "location", "jurisdiction", "fips", "zip", "county", "hrr", "msa",
    "state", "province", "nation", "states", "provinces", "counties", "geo_Value",
)
VERSION_NAMES = ("version", "issue", "release")
STATES = (
    "al", "ak", "az", "ar", "ca", "co", "ct", "de", "fl", "ga", "hi", "id", "il", "in", "ia", "ks", "ky", "la", "me",
    "md", "ma", "mi", "mn", "ms", "mo", "mt", "ne", "nv", "nh", "nj", "nm", "ny", "nc", "nd", "oh", "ok", "or", "pa",
    "ri", "sc", "sd", "tn", "tx", "ut", "vt", "va", "wa", "wv", "wi", "wy", "as", "dc", "gu", "mp", "pr", "vi",
)


def with_capitals(names: tuple[str, ...]) -> tuple[str, ...]:
    """The names and the same with each word between underscores capitalised."""
    return tuple(dict.fromkeys([*names, *("_".join(p[:1].upper() + p[1:] for p in n.split("_")) for n in names)]))


def time_column_names() -> tuple[str, ...]:
    return with_capitals(TIME_NAMES)


def geo_column_names() -> tuple[str, ...]:
    return with_capitals(GEO_NAMES)


def version_column_names() -> tuple[str, ...]:
    return with_capitals(VERSION_NAMES)


@dataclass(frozen=True)
class PanelMeta:
    geo_type: str
    time_type: str
    as_of: Any = None
    other_keys: tuple[str, ...] = ()

    @property
    def keys(self) -> list[str]:
        return ["geo_value", *self.other_keys, "time_value"]

    @property
    def series(self) -> list[str]:
        return ["geo_value", *self.other_keys]


@dataclass(frozen=True)
class LogMeta:
    geo_type: str
    time_type: str
    other_keys: tuple[str, ...] = ()
    versions_end: Any = None
    clobberable_start: Any = None

    @property
    def keys(self) -> list[str]:
        return ["geo_value", *self.other_keys, "time_value", "version"]

    @property
    def cell(self) -> list[str]:
        return ["geo_value", *self.other_keys, "time_value"]

    @property
    def series(self) -> list[str]:
        return ["geo_value", *self.other_keys]

    def with_(self, **kw) -> LogMeta:
        return replace(self, **kw)


def guess_column(df: DataFrame, name: str, aliases: tuple[str, ...]) -> DataFrame:
    """Rename the one alias that is present; none or several are an error."""
    if name in df.columns:
        return df
    found = [c for c in df.columns if c in aliases]
    if not found:
        raise PanelError(f"there is no column {name} or of a similar name")
    if len(found) > 1:
        raise PanelError(f"{found} could all be {name}; rename or drop some")
    return df.withColumnRenamed(found[0], name)


def guess_geo_type(df: DataFrame) -> str:
    """state, nation, county, hhs, hrr or custom, from one aggregate."""
    kind = df.schema["geo_value"].dataType
    g = F.col("geo_value")
    if isinstance(kind, T.StringType):
        low = F.lower(g)
        tests = {
            "state": low.isin(*STATES),
            "nation": low.rlike("[a-z]{2}") & ~low.rlike("[a-z]{3}"),
            "county": low.rlike("[0-9]{5}") & ~low.rlike("[0-9]{6}"),
        }
        row = df.agg(*[F.bool_and(t).alias(k) for k, t in tests.items()]).first()
        return next((k for k in tests if row[k] or row[k] is None and k == "state"), "custom")
    if isinstance(kind, T.NumericType):
        most = df.agg(F.max(F.floor(g)).alias("m")).first()["m"]
        return "custom" if most is None else "hhs" if most <= 10 else "hrr" if most <= 457 else "custom"
    return "custom"


def guess_time_type(df: DataFrame, column: str = "time_value") -> str:
    """day, week or integer (yearmonth is stated by the caller); anything else is custom, with a warning."""
    kind, t = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.DateType):
        gaps = df.select(t.alias("t")).distinct().select(F.datediff("t", F.lag("t").over(Window.orderBy("t"))).alias("gap"))
        row = gaps.where("gap is not null").agg(F.count("*").alias("n"), F.bool_and(F.col("gap") % 7 == 0).alias("weekly"), F.min("gap").alias("least")).first()
        if row["n"] and row["weekly"]:
            return "week"
        if row["n"] and row["least"] >= 28:
            raise PanelError("the times are a month or more apart: state time_type='yearmonth', or use integers for years")
        return "day"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)) and df.where(t != F.floor(t)).limit(1).isEmpty():
        return "integer"
    warnings.warn(f"unsupported time type {kind.simpleString()} in {column}", stacklevel=3)
    return "custom"


def duplicated(df: DataFrame, keys: list[str], show: int = 5) -> list:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(show).collect()


def check_unique(df: DataFrame, keys: list[str]) -> None:
    if rows := duplicated(df, keys):
        raise PanelError(f"several rows for one key {keys}: {[tuple(r)[:-1] for r in rows]}")
