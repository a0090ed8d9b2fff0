"""A log on disk: changes by buckets of versions, full snapshots (bases) every so many buckets, and a manifest.

A snapshot is read from the last base before it and the buckets after that base, so that what is read does not grow with the
history. The width of a bucket is part of the manifest, not the reader's to know. Every state of the store is a file of its
own in the manifest's folder, written last: what it does not name does not count, so a write that fails leaves the state before it.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import asdict, dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revpanel.functions.time import PanelError, index, py_index
from revpanel.log import RevisionLog
from revpanel.meta import LogMeta, PanelMeta
from revpanel.panel import Panel

#: Rows of a file, about; a bucket with more is written by several tasks.
FILE_ROWS = 4_000_000


@dataclass(frozen=True)
class Manifest:
    """Where the parts of a log are: folders of changes and bases by bucket, the bucket's width in steps, and the log's metadata."""

    epoch: int
    bucket: int
    base_every: int
    schema: str
    meta: dict[str, Any]
    changes: list[tuple[str, int, int]]
    bases: list[tuple[str, int]]


def _unit(time_type: str) -> str:
    return "day" if time_type == "week" else time_type


def _plain(v: Any) -> Any:
    return {"date": v.isoformat()} if isinstance(v, dt.date) else v


def _value(v: Any) -> Any:
    return dt.date.fromisoformat(v["date"]) if isinstance(v, dict) else v


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _manifest(spark: SparkSession, path: str) -> Manifest:
    """The last state of the store."""
    files, where = _files(spark, f"{path}/manifest")
    if not files.exists(where):
        raise PanelError(f"no log at {path}")
    epochs = [int(f.getPath().getName()) for f in files.listStatus(where) if f.getPath().getName().isdigit()]
    found = json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest/{max(epochs)}").collect()))
    return Manifest(**{**found, "changes": [tuple(x) for x in found["changes"]], "bases": [tuple(x) for x in found["bases"]]})


def _commit(spark: SparkSession, path: str, m: Manifest) -> None:
    """Write the state under its number; another writer that came first makes this an error."""
    spark.createDataFrame([(json.dumps(asdict(m)),)], "value string").coalesce(1).write.mode("error").text(f"{path}/manifest/{m.epoch}")


def _log_meta(m: Manifest) -> LogMeta:
    x = m.meta
    return LogMeta(x["geo_type"], x["time_type"], tuple(x["other_keys"]), _value(x["versions_end"]), _value(x["clobberable_start"]))


def _meta(meta: LogMeta) -> dict[str, Any]:
    return {"geo_type": meta.geo_type, "time_type": meta.time_type, "other_keys": list(meta.other_keys), "versions_end": _plain(meta.versions_end), "clobberable_start": _plain(meta.clobberable_start)}


def _bucket(m: Manifest) -> Column:
    return F.floor(index("version", _unit(m.meta["time_type"])) / m.bucket).cast("int")


def _bucket_of(m: Manifest, version: Any) -> int:
    return py_index(version, _unit(m.meta["time_type"])) // m.bucket


def _write_changes(df: DataFrame, path: str, m: Manifest) -> tuple[str, int, int] | None:
    """A folder of changes by bucket; a large bucket is dealt over files by its keys. None if there are no rows."""
    folder, cell = f"changes/{uuid.uuid4().hex}", LogMeta(**{**m.meta, "other_keys": tuple(m.meta["other_keys"])}).cell
    dated = df.withColumn("version_bucket", _bucket(m))
    sizes = dated.groupBy("version_bucket").agg(F.count("*").alias("n"))
    low, high = sizes.agg(F.min("version_bucket"), F.max("version_bucket")).first()
    if low is None:
        return None
    files = sizes.select("version_bucket", F.ceil(F.col("n") / FILE_ROWS).alias("__files"))
    rows = dated.join(files, "version_bucket").withColumn("__file", F.pmod(F.xxhash64(*cell), F.col("__files")))
    rows.repartition("version_bucket", "__file").drop("__files", "__file").write.partitionBy("version_bucket").parquet(f"{path}/{folder}")
    return folder, low, high


def _changes(spark: SparkSession, path: str, m: Manifest, above: int | None = None, through: int | None = None) -> DataFrame:
    """The changes of the buckets in (above, through]; folders without any are not opened."""
    out = None
    for folder, low, high in m.changes:
        if (above is not None and high <= above) or (through is not None and low > through):
            continue
        part = spark.read.parquet(f"{path}/{folder}")
        if above is not None:
            part = part.where(F.col("version_bucket") > above)
        if through is not None:
            part = part.where(F.col("version_bucket") <= through)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], T.StructType.fromJson(json.loads(m.schema)))
    return out.drop("version_bucket").to(T.StructType.fromJson(json.loads(m.schema)))


def _last(df: DataFrame, log: LogMeta) -> DataFrame:
    """The last row of each key and time, with its version."""
    values = [c for c in df.columns if c not in log.keys]
    last = df.groupBy(*log.cell).agg(F.max_by(F.struct("version", *values), "version").alias("__s"))
    return last.select([F.col(f"__s.`{c}`").alias(c) if c not in log.cell else c for c in df.columns])


def _based(spark: SparkSession, path: str, m: Manifest, bucket: int) -> tuple[DataFrame | None, int | None]:
    """The newest base whose bucket ends before ``bucket``, and its bucket."""
    known = [(b, folder) for folder, b in m.bases if b < bucket]
    if not known:
        return None, None
    b, folder = max(known)
    return spark.read.parquet(f"{path}/{folder}"), b


def _add_bases(spark: SparkSession, path: str, m: Manifest) -> Manifest:
    """Bases for all complete spans of ``base_every`` buckets that lack one, each from the base before it.

    The last bucket may still get changes, so a base never covers it.
    """
    high = max(h for _, _, h in m.changes)
    done = max((b for _, b in m.bases), default=min(low for _, low, _ in m.changes) - 1)
    bases, log = list(m.bases), _log_meta(m)
    while done + m.base_every < high:
        now = done + m.base_every
        base, above = _based(spark, path, replace(m, bases=bases), now + 1)
        rows = _changes(spark, path, m, above, now)
        folder = f"bases/{uuid.uuid4().hex}"
        _last(rows if base is None else base.unionByName(rows), log).write.parquet(f"{path}/{folder}")
        bases.append((folder, now))
        done = now
    return replace(m, bases=bases)


def write_log(log: RevisionLog, path: str, mode: str = "errorifexists", bucket: int = 32, base_every: int = 8) -> None:
    """Store a log: changes in buckets of ``bucket`` steps of versions, and a base every ``base_every`` buckets."""
    spark = log.df.sparkSession
    files, where = _files(spark, path)
    if files.exists(where) and files.listStatus(where):
        if mode != "overwrite":
            raise PanelError(f"there is something at {path} already")
        files.delete(where, True)
    # Files do not know which columns have no nulls.
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in log.df.schema])
    m = Manifest(0, bucket, base_every, json.dumps(schema.jsonValue()), _meta(log.meta), [], [])
    part = _write_changes(log.df, path, m)
    if part is not None:
        m = _add_bases(spark, path, replace(m, changes=[part]))
    _commit(spark, path, m)


def append_log(changes: DataFrame, path: str, versions_end: Any = None) -> None:
    """Add changes with later versions than any base covers; bases that have become complete are made.

    The columns are those of the log. A change in a bucket that a base covers would be lost to its readers and is refused.
    """
    spark = changes.sparkSession
    m = _manifest(spark, path)
    changes = changes.to(T.StructType.fromJson(json.loads(m.schema)))
    covered = max((b for _, b in m.bases), default=None)
    row = changes.agg(F.min(_bucket(m)).alias("low"), F.max("version").alias("last")).first()
    if row["low"] is not None and covered is not None and row["low"] <= covered:
        raise PanelError("changes to versions that a base covers")
    meta = _log_meta(m)
    end = max(v for v in (meta.versions_end, row["last"], versions_end) if v is not None)
    m = replace(m, epoch=m.epoch + 1, meta=_meta(meta.with_(versions_end=end)))
    part = _write_changes(changes, path, m)
    if part is not None:
        m = _add_bases(spark, path, replace(m, changes=[*m.changes, part]))
    _commit(spark, path, m)


def read_log(spark: SparkSession, path: str, through: Any = None) -> RevisionLog:
    """The log at ``path``; with ``through`` only buckets that hold versions up to it are read."""
    m = _manifest(spark, path)
    df = _changes(spark, path, m, through=None if through is None else _bucket_of(m, through))
    return RevisionLog(df if through is None else df.where(F.col("version") <= F.lit(through)), _log_meta(m))


def read_snapshot(spark: SparkSession, path: str, version: Any = None) -> Panel:
    """The panel as known at ``version`` (by default the last one), from one base and the changes after it."""
    m = _manifest(spark, path)
    log = _log_meta(m)
    version = log.versions_end if version is None else version
    if version > log.versions_end:
        raise PanelError(f"version {version} is after versions_end {log.versions_end}")
    bucket = _bucket_of(m, version)
    base, above = _based(spark, path, m, bucket)
    rows = _changes(spark, path, m, above, bucket).where(F.col("version") <= F.lit(version))
    last = _last(rows if base is None else base.unionByName(rows), log)
    return Panel(last.drop("version"), PanelMeta(log.geo_type, log.time_type, version, log.other_keys))
