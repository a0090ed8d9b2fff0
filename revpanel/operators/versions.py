"""Versions as a table: the grid of versions of a log, and ranks of values among versions without a list on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revpanel.functions.time import PanelError, from_index, index, py_index
from revpanel.operators.scan import running

#: Steps of a chunk of versions that are ranked together.
WIDTH = 4096


def _unit(time_type: str) -> str:
    return "day" if time_type == "week" else time_type


def grid(log) -> DataFrame:
    """(__v): all versions from the first to versions_end, in steps of the period of those that occur.

    The period is the largest number that divides all gaps. Each task finds that of its own versions, so what comes back is
    one number a task.
    """
    unit, kind = _unit(log.meta.time_type), log.df.schema["version"].dataType
    at = log.df.select(index("version", unit).alias("i")).distinct()
    low = at.agg(F.min("i")).first()[0]
    if low is None:
        raise PanelError("a log without rows has no versions")
    high = py_index(log.meta.versions_end, unit)

    def divisor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = 0
        for batch in batches:
            d = math.gcd(d, int(np.gcd.reduce(batch.column(0).to_numpy(zero_copy_only=False) - low, initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64())], ["d"])

    step = 1
    if log.meta.time_type != "yearmonth":
        step = math.gcd(high - low, *(r["d"] for r in at.mapInArrow(divisor, "d long").collect()))
        if not step:
            raise PanelError("a period needs two distinct times")
    ids = log.df.sparkSession.range((high - low) // step + 1)
    return ids.select(from_index(F.lit(low) + F.col("id") * step, unit).cast(kind).alias("__v"))


def stated(log, versions: Sequence | DataFrame) -> DataFrame:
    """(__v): the caller's versions, checked: of the log's type, none twice, null or after versions_end."""
    kind = log.df.schema["version"].dataType
    if not isinstance(versions, DataFrame):
        for v in versions:
            log.check_bound(v, "version", False)
        versions = log.df.sparkSession.createDataFrame([(v,) for v in versions], T.StructType([T.StructField("__v", kind)]))
    elif len(versions.columns) != 1 or versions.schema.fields[0].dataType != kind:
        raise PanelError(f"a table of versions has one column, of type {kind.simpleString()}")
    out = versions.toDF("__v")
    late = F.count_if(F.col("__v") > F.lit(log.meta.versions_end))
    row = out.agg(F.count("*").alias("n"), F.countDistinct("__v").alias("different"), F.count("__v").alias("known"), late.alias("late")).first()
    if not row["n"]:
        raise PanelError("versions must not be empty")
    if row["known"] < row["n"]:
        raise PanelError("version must not be null")
    if row["different"] < row["n"]:
        raise PanelError("versions repeat")
    if row["late"]:
        raise PanelError(f"{row['late']} versions are after versions_end {log.meta.versions_end}")
    return out


def _chunk(c: str, kind: T.DataType) -> Column:
    """A number that does not fall along the values, with some thousand steps to each."""
    if isinstance(kind, T.DateType):
        at = F.unix_date(c)
    elif isinstance(kind, T.TimestampType):
        at = F.unix_seconds(c)
    elif isinstance(kind, T.NumericType):
        at = F.col(c)
    else:
        return F.lit(0).cast("long")
    return F.floor(at / WIDTH).cast("long")


def ranked(versions: DataFrame, *values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(__v, __i): the versions, numbered from 0 in their order; (__at, __rank): how many versions are before each value.

    Values (tables of one column) and versions are stacked and counted in one order, in chunks, so that no task has all of them.
    """
    kind = versions.schema["__v"].dataType
    stacked = versions.select(F.col("__v").alias("__at"), F.lit(1).alias("__one"))
    for table in values:
        stacked = stacked.union(table.toDF("__at").where("__at is not null").distinct().select("__at", F.lit(0)))
    # A value stands before an equal version, which is thus not counted.
    counted = running(stacked, [], ["__at", "__one"], _chunk("__at", kind), {"__n": ("count", F.when(F.col("__one") == 1, 1))})
    numbered = counted.where("__one = 1").select(F.col("__at").alias("__v"), (F.col("__n") - 1).alias("__i"))
    return numbered, counted.where("__one = 0").select("__at", F.col("__n").alias("__rank")).distinct()


def default_list(log) -> list[Any]:
    return [r[0] for r in grid(log).orderBy("__v").collect()]
