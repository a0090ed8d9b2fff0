"""Replay of history: a computation for each of many versions, on the data as they were known then.

A row of a log is live from its version to the next of the same key and time. With that interval, all snapshots are one
range join of the log with the versions: each live row comes out exactly once per version, and no de-duplication follows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revpanel.functions.time import INF, PanelError, minus_steps, plus_steps, shift, to_steps
from revpanel.log import RevisionLog
from revpanel.operators.scan import running
from revpanel.operators.versions import WIDTH, grid, ranked, stated
from revpanel.operators.windows import check_arity


#: Up to so many listed versions are ranked row by row.
FEW = 64


def _listed(log: RevisionLog, versions: Sequence) -> list:
    out = list(versions)
    if not out:
        raise PanelError("versions must not be empty")
    if len(set(out)) != len(out):
        raise PanelError("versions repeat")
    for v in out:
        log.check_bound(v, "version", False)
        if v > log.meta.versions_end:
            raise PanelError(f"version {v} is after versions_end {log.meta.versions_end}")
    return sorted(out)


@dataclass
class Versions:
    """The versions of a replay: a table (__v), and the list where the caller gave a short one."""

    table: DataFrame
    few: list | None

    @classmethod
    def of(cls, log: RevisionLog, versions: Sequence | DataFrame | None) -> Versions:
        if versions is None:
            return cls(grid(log), None)
        if isinstance(versions, DataFrame):
            return cls(stated(log, versions), None)
        listed = _listed(log, versions)
        kind = log.df.schema["version"].dataType
        table = log.df.sparkSession.createDataFrame([(v,) for v in listed], T.StructType([T.StructField("__v", kind)]))
        return cls(table, listed if len(listed) <= FEW else None)


def snapshots(log: RevisionLog, versions: Sequence | DataFrame | Versions | None = None, before: Any = INF) -> DataFrame:
    """Rows live at each version, with its value in column ``__v``; ``before`` bounds how far times reach back.

    Versions are a list, a table of one column, or by default all of the log's period. Rows find their versions by their ranks among
    them: those of a short list are counted row by row; otherwise each version that occurs is ranked once, by a count over
    versions and values stacked in one order, and rows without a version vanish before they meet any.
    """
    chosen = versions if isinstance(versions, Versions) else Versions.of(log, versions)
    w = Window.partitionBy(*log.meta.cell).orderBy("version")
    df = log.df.withColumn("__end", F.lead("version").over(w))
    # Live at versions i in [first, last]: those from version on and before the end.
    if chosen.few is not None:
        kind = log.df.schema["version"].dataType
        array = F.array(*[F.lit(v).cast(kind) for v in chosen.few])
        before_it = lambda c: F.size(F.filter(array, lambda v: v < c))
        df = df.withColumn("__first", before_it(F.col("version"))).withColumn("__stop", before_it(F.col("__end")))
        df = df.withColumn("__last", F.when(F.col("__end").isNull(), len(chosen.few)).otherwise(F.col("__stop")) - 1)
        df = df.where("__first <= __last").withColumn("__i", F.explode(F.sequence("__first", "__last")))
        df = df.withColumn("__v", F.element_at(array, F.col("__i") + 1))
    else:
        numbered, ranks = ranked(chosen.table, log.df.select("version"))
        ends = ranks.select(F.col("__at").alias("__end"), F.col("__rank").alias("__stop"))
        df = df.join(ranks.select(F.col("__at").alias("version"), F.col("__rank").alias("__first")), "version").join(ends, "__end", "left")
        df = df.withColumn("__last", F.when(F.col("__end").isNull(), F.lit(chosen.table.count())).otherwise(F.col("__stop")) - 1)
        df = df.where("__first <= __last").withColumn("__i", F.explode(F.sequence("__first", "__last"))).join(numbered, "__i")
    return _reach(df.select(*log.df.columns, "__v"), log, before)


def _reach(df: DataFrame, log: RevisionLog, before: Any) -> DataFrame:
    n = to_steps(before, log.meta.time_type)
    return df if n == INF else df.where(F.col("time_value") >= minus_steps(F.col("__v"), int(n), log.meta.time_type))


def slide(log: RevisionLog, aggs: dict[str, Column], before: Any = INF, versions: Sequence | DataFrame | None = None, new_name: str | None = None) -> DataFrame:
    """Aggregate expressions over each snapshot (and group), labelled with the groups and ``version``.

    Unused levels of group_by(drop=False, levels=...) get the aggregate of no rows. A version whose snapshot is empty
    gives one row of that aggregate with null groups. With ``new_name`` the results are one struct column.
    """
    chosen = Versions.of(log, versions)
    groups = list(log.groups)
    live = snapshots(log, chosen, before)
    out = live.groupBy("__v", *groups).agg(*[c.alias(n) for n, c in aggs.items()])
    # The aggregate of no rows, once.
    nothing = live.where(F.lit(False)).agg(*[c.alias(n) for n, c in aggs.items()])
    if log.levels:
        out = _with_levels(log, live, out, nothing)
    # Versions without rows come back with the aggregate of nothing; the snapshots are computed once.
    zero = nothing.select(*[F.col(n).alias(f"__0_{n}") for n in aggs])
    out = chosen.table.join(out.select("__v", *groups, *aggs, F.lit(True).alias("__hit")), "__v", "left").join(F.broadcast(zero))
    out = out.withColumns({n: F.when(F.col("__hit"), F.col(n)).otherwise(F.col(f"__0_{n}")) for n in aggs})
    values = [F.struct(*aggs).alias(new_name)] if new_name else list(aggs)
    return out.select(*groups, F.col("__v").alias("version"), *values)


def _with_levels(log: RevisionLog, live: DataFrame, out: DataFrame, nothing: DataFrame) -> DataFrame:
    """Adds the combinations of levels that have no rows; groups after a level without rows are null."""
    groups, levels = list(log.groups), dict(log.levels)
    spark = log.df.sparkSession
    extra, upto = None, []
    for i, g in enumerate(groups):
        if g not in levels:
            upto.append(g)
            continue
        kind = log.df.schema[g].dataType
        known = spark.createDataFrame([(v,) for v in levels[g]], T.StructType([T.StructField(g, kind)]))
        base = live.select("__v", *upto).distinct() if extra is None else live.select("__v", *upto).distinct().unionByName(extra.select("__v", *upto).distinct()).distinct()
        cells = base.join(F.broadcast(known))
        cond = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("__v", *upto, g)]
        unused = cells.alias("a").join(live.select("__v", *upto, g).distinct().alias("b"), cond, "left_anti")
        more = unused.select("__v", *upto, g, *[F.lit(None).cast(log.df.schema[c].dataType).alias(c) for c in groups[i + 1 :] if c not in levels])
        for c in groups[i + 1 :]:
            if c in levels:
                later = spark.createDataFrame([(v,) for v in levels[c]], T.StructType([T.StructField(c, log.df.schema[c].dataType)]))
                more = more.join(F.broadcast(later))
        more = more.select("__v", *groups)
        extra = more if extra is None else extra.unionByName(more).distinct()
        upto.append(g)
    if extra is None:
        return out
    return out.unionByName(extra.join(F.broadcast(nothing)).select(*out.columns))


@dataclass
class PandasLog:
    """A small log inside a Python computation, with snapshots and replays of its own.

    ``latest`` are the places of the rows of its last snapshot, where the replay keeps them.
    """

    frame: pd.DataFrame
    keys: list[str]
    versions_end: Any
    latest: np.ndarray | None = None

    def as_of(self, version: Any, min_time: Any = None) -> pd.DataFrame:
        if version > self.versions_end:
            raise PanelError(f"version {version} is after versions_end {self.versions_end}")
        if self.latest is not None and version == self.versions_end:
            rows = self.frame.iloc[self.latest].sort_values(self.keys)
        else:
            rows = self.frame[self.frame["version"] <= version]
            rows = rows.sort_values([*self.keys, "version"]).drop_duplicates(self.keys, keep="last")
        if min_time is not None:
            rows = rows[rows["time_value"] >= min_time]
        return rows.drop(columns="version").reset_index(drop=True)

    def truncate_versions_after(self, version: Any) -> PandasLog:
        return PandasLog(self.frame[self.frame["version"] <= version].reset_index(drop=True), self.keys, version)

    def slide(self, f: Callable, versions: Sequence, by: Sequence[str] = ()) -> pd.DataFrame:
        """f(snapshot, key, version) -> frame, for each version and group."""
        parts = []
        for v in versions:
            snap = self.as_of(v)
            groups = snap.groupby(list(by), sort=True) if by else [((), snap)]
            for key, rows in groups:
                got = f(rows.reset_index(drop=True), key, v)
                got = got if isinstance(got, pd.DataFrame) else pd.DataFrame({"slide_value": [got]})
                parts.append(got.assign(version=v, **dict(zip(by, key if isinstance(key, tuple) else (key,)))))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()


class _Results:
    """What a computation gives for a group and a version, as rows of the result."""

    def __init__(self, log: RevisionLog, f: Callable, schema: str):
        self.f, self.groups = f, list(log.groups)
        kind = T._parse_datatype_string(schema)
        value = kind if isinstance(kind, T.StructType) else T.StructType([T.StructField("slide_value", kind)])
        label = [T.StructField(g, log.df.schema[g].dataType) for g in self.groups]
        self.schema = T.StructType([*label, T.StructField("version", log.df.schema["version"].dataType), *value.fields])
        self.names = [x.name for x in value.fields]

    def __call__(self, data: Any, labels: tuple, v: Any) -> pd.DataFrame:
        got = self.f(data, dict(zip(self.groups, labels)), v)
        if not isinstance(got, pd.DataFrame):
            got = pd.DataFrame({self.names[0]: [got]})
        out = got[self.names].reset_index(drop=True)
        for g, x in zip(self.groups, labels):
            out[g] = x
        out["version"] = v
        return out[[*self.groups, "version", *self.names]]


def slide_python(log: RevisionLog, f: Callable, schema: str, before: Any = INF, versions: Sequence | DataFrame | None = None, all_versions: bool = False, chunks: int = 8) -> DataFrame:
    """f(data, key, version) -> frame of any number of rows (or a scalar, as slide_value), per version and group.

    ``data`` is the snapshot as a pandas frame, or with ``all_versions`` a PandasLog of the history up to the version. A version
    without rows is computed once, on no rows and with null groups. Results carry the groups and ``version``.

    Histories are replayed in ``chunks`` of versions: a task gets a group's rows up to the last version of its chunk once and
    goes through the versions with a pointer into them, so a row is shuffled ``chunks`` times at most, however many versions follow it.
    """
    check_arity(f, 3, "the version function")
    chosen, groups, result = Versions.of(log, versions), list(log.groups), _Results(log, f, schema)
    if all_versions:
        return _histories(log, result, before, chosen, chunks)
    columns = [c for c in log.df.columns if c != "version"]
    # Versions without rows still have their computation.
    live = chosen.table.join(snapshots(log, chosen, before).withColumn("__here", F.lit(True)), "__v", "left")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return result(pdf.loc[pdf["__here"].notna(), columns].reset_index(drop=True), key[1:], key[0])

    return live.groupBy("__v", *groups).applyInPandas(run, result.schema)


def _dealt(log: RevisionLog, before: Any, chosen: Versions, chunks: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows and calls by group and chunk of versions, and the versions in which no row is seen.

    A row goes to the chunks of versions in which it is seen: from the first version that is not before its own, until
    ``before`` steps after its time. A call (__v) is made for the versions between the first and the last in which the group is seen.
    """
    groups = [F.col(g).alias(f"__g{i}") for i, g in enumerate(log.groups)]
    steps, tt = to_steps(before, log.meta.time_type), log.meta.time_type
    until = plus_steps(F.col("time_value"), int(steps), tt) if steps != INF else None
    numbered, ranks = ranked(chosen.table, log.df.select("version"), *([log.df.select(until)] if until is not None else []))
    total = chosen.table.count()
    per = max(1, -(-total // max(1, chunks)))
    rows, last = log.df.join(ranks.select(F.col("__at").alias("version"), F.col("__rank").alias("__first")), "version"), F.lit(total - 1)
    if until is not None:
        # Versions up to and including that time: those before it, and one more if it is a version itself.
        stops = ranks.join(numbered, F.col("__at") == F.col("__v"), "left").select(F.col("__at").alias("__until"), (F.col("__rank") + F.col("__v").isNotNull().cast("int") - 1).alias("__stop"))
        rows, last = rows.withColumn("__until", until).join(stops, "__until"), F.col("__stop")
    rows = rows.withColumn("__last", last.cast("long")).where("__first <= __last")
    chunk = lambda c: F.floor(F.col(c) / per)
    dealt = rows.select(*log.df.columns, *groups, F.explode(F.sequence(chunk("__first"), chunk("__last"))).alias("__c"))
    seen = rows.groupBy(*log.groups).agg(F.min("__first").alias("__lo"), F.max("__last").alias("__hi"))
    calls = seen.withColumn("__i", F.explode(F.sequence("__lo", "__hi"))).join(numbered, "__i").select("__v", *groups, chunk("__i").alias("__c"))
    # A version is empty that no row's first and last version enclose.
    spans = rows.groupBy(F.col("__first").alias("__i")).agg(F.max("__last").alias("__last"))
    far = running(numbered.join(spans, "__i", "left"), [], ["__i"], F.floor(F.col("__i") / WIDTH), {"__far": ("max", F.col("__last"))})
    return dealt, calls, far.where("__far is null or __far < __i").select("__v")


def _histories(log: RevisionLog, result: _Results, before: Any, chosen: Versions, chunks: int) -> DataFrame:
    """The results of a function of the history up to each version: rows meet the versions of a group chunk by chunk."""
    groups, columns, cell = list(log.groups), log.df.columns, log.meta.cell
    steps, tt, spark = to_steps(before, log.meta.time_type), log.meta.time_type, log.df.sparkSession
    dealt, calls, empty = _dealt(log, before, chosen, chunks)

    def run(key: tuple, history: pd.DataFrame, versions: pd.DataFrame) -> pd.DataFrame:
        history = history.sort_values(["version", *cell], kind="stable")[columns].reset_index(drop=True)
        at, times = history["version"].to_numpy(), history["time_value"].to_numpy()
        code = history.groupby(cell, sort=False, dropna=False).ngroup().to_numpy() if len(history) else np.empty(0, np.int64)
        state, known, parts = np.full(code.max(initial=-1) + 1, -1), 0, []
        for v in sorted(versions["__v"]):
            now = int(np.searchsorted(at, v, side="right"))
            # The changes since the version before; of several of one cell the last one stays.
            state[code[known:now]] = np.arange(known, now)
            known, frame, latest = now, history.iloc[:now], np.sort(state[state >= 0])
            if steps != INF:
                kept = times[:now] >= shift(v, -int(steps), tt)
                place = np.cumsum(kept) - 1
                frame, latest = frame[kept].reset_index(drop=True), place[latest[kept[latest]]]
            if len(frame):
                parts.append(result(PandasLog(frame, cell, v, latest), key[: len(groups)], v))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=result.schema.names)

    by = [*[f"__g{i}" for i in range(len(groups))], "__c"]
    out = dealt.groupBy(*by).cogroup(calls.groupBy(*by)).applyInPandas(run, result.schema)
    nothing = spark.createDataFrame([], log.df.schema).toPandas()

    def alone(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return result(PandasLog(nothing.copy(), cell, key[0]), (None,) * len(groups), key[0])

    return out.unionByName(empty.groupBy("__v").applyInPandas(alone, result.schema))
