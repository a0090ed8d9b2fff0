"""Structured Streaming into a log: updates become versions.

``stream_into_log`` takes updates in the order of their versions and compares each micro-batch with what is stored. With
``stream_late_updates`` they may come in any order, more than once, and differ for one version: a state keyed by cell (key
columns and time) knows the versions of that cell, so that a batch reads its own cells only, and what comes out are the changes of the
log: rows to put and rows to drop. The log is the same in whatever order the updates came.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from revpanel.log import compactify


def append_changes(batch: DataFrame, stored: DataFrame | None, cell: Sequence[str], abs_tol: float = 0.0) -> DataFrame:
    """The rows of a batch of updates that change something, against the last stored row of each key and time."""
    values = [c for c in batch.columns if c not in (*cell, "version")]
    if stored is None:
        return compactify(batch, cell, values, abs_tol)
    touched = stored.join(batch.select(*cell).distinct(), list(cell), "left_semi")
    last = touched.groupBy(*cell).agg(F.max_by(F.struct("version", *values), "version").alias("s")).select(*cell, "s.*")
    both = last.withColumn("__new", F.lit(False)).unionByName(batch.select(*cell, "version", *values).withColumn("__new", F.lit(True)))
    return compactify(both, cell, values, abs_tol).where("__new").drop("__new")


def stream_into_log(updates: DataFrame, path: str, cell: Sequence[str], checkpoint: str, abs_tol: float = 0.0, trigger: dict | None = None, observer: Callable[[DataFrame, int], None] | None = None):
    """Start a query that appends each micro-batch's changes to the Parquet log at ``path``.

    ``updates`` has the key columns, version and the measurements. A batch that is repeated after a failure overwrites
    its own folder, so each update is stored once.
    """
    spark = updates.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        # Of several updates of one version the largest counts, so that a repeated batch gives the same rows.
        values = [c for c in batch.columns if c not in (*cell, "version")]
        columns = batch.columns
        batch = batch.groupBy(*cell, "version").agg(F.max(F.struct(*values)).alias("__s")).select(*cell, "version", "__s.*").select(*columns)
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        exists = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)
        stored = spark.read.parquet(path).where(F.col("batch") < batch_id).drop("batch") if exists else None
        new = append_changes(batch, stored, cell, abs_tol)
        new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if observer is not None:
            observer(new, batch_id)

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _same(a: list, b: list, abs_tol: float) -> bool:
    """Whether values repeat those before: numbers within ``abs_tol``, null and NaN alike."""
    for x, y in zip(a, b):
        x, y = (None if v == "NaN" else v for v in (x, y))
        if isinstance(x, (int, Decimal)) and isinstance(y, (int, Decimal)) and not isinstance(x, bool) and not isinstance(y, bool):
            if abs(x - y) > abs_tol:
                return False
        elif x != y:
            return False
    return True


def _order(values: list) -> tuple:
    """An order of the values of one version, nulls first."""
    return tuple((v is not None, isinstance(v, str), v if isinstance(v, str) else str(v) if isinstance(v, (list, dict)) else v or 0) for v in values)


def _parsed(text: str) -> list:
    return list(json.loads(text, parse_float=Decimal).values())


def _kept(known: dict[str, str], abs_tol: float) -> dict[str, str]:
    """The versions of a cell whose values are not those of the version before."""
    out, last = {}, None
    for v in sorted(known, key=json.loads):
        now = _parsed(known[v])
        if last is None or not _same(now, last, abs_tol):
            out[v] = known[v]
        last = now
    return out


def changes_of_cell(known: dict[str, str], updates: list[tuple[str, str]], abs_tol: float = 0.0) -> list[tuple[str, str, bool]]:
    """Take updates (version, values), both as JSON, into what is known of a cell; (version, values, put or drop) of the log's rows that change.

    Of several values of one version the largest counts, whenever they come.
    """
    before = _kept(known, abs_tol)
    for v, values in updates:
        if v not in known or _order(_parsed(values)) > _order(_parsed(known[v])):
            known[v] = values
    after = _kept(known, abs_tol)
    put = [(v, x, True) for v, x in after.items() if before.get(v) != x]
    return put + [(v, x, False) for v, x in before.items() if v not in after]


def stream_late_updates(updates: DataFrame, path: str, cell: Sequence[str], checkpoint: str, abs_tol: float = 0.0, trigger: dict | None = None):
    """Start a query that writes the changes of a log to Parquet at ``path``, from updates in any order; ``read_changes`` reads the log.

    ``updates`` has the key columns ``cell``, version and the measurements. Keys and values go through Python as JSON, so that
    whole numbers beside nulls keep their digits. The state of a cell is its versions with their values.
    """
    values = [c for c in updates.columns if c not in (*cell, "version")]
    kept = {"ignoreNullFields": "false"}
    packed = updates.select(F.to_json(F.struct(*cell), kept).alias("cell"), F.to_json(F.struct("version"), kept).alias("v"), F.to_json(F.struct(*values), kept).alias("x"))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else {}
        rows = [(json.dumps(json.loads(v)["version"]), x) for pdf in frames for v, x in zip(pdf["v"], pdf["x"])]
        seq = (state.get[1] if state.exists else 0) + 1
        out = changes_of_cell(known, rows, abs_tol)
        state.update((json.dumps(known), seq))
        yield pd.DataFrame([(key[0], f'{{"version":{v}}}', x, put, seq) for v, x, put in out], columns=["cell", "v", "x", "put", "seq"])

    changed = packed.groupBy("cell").applyInPandasWithState(run, "cell string, v string, x string, put boolean, seq long", "known string, seq long", "append", GroupStateTimeout.NoTimeout)
    part = lambda names: T.StructType([updates.schema[c] for c in names])
    columns = [F.from_json("cell", part(cell)).alias("c"), F.from_json("v", part(["version"])).alias("v"), F.from_json("x", part(values)).alias("x"), "put", "seq"]
    rows = changed.select(*columns).select("c.*", "v.*", "x.*", "put", "seq")
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def read_changes(spark: SparkSession, path: str, cell: Sequence[str]) -> DataFrame:
    """The log whose changes are at ``path``: of each cell and version the last change, where that is a row."""
    df = spark.read.parquet(path)
    names: list[Any] = [c for c in df.columns if c not in (*cell, "version", "put", "seq")]
    last = df.groupBy(*cell, "version").agg(F.max_by(F.struct("put", *names), "seq").alias("s"))
    return last.where("s.put").select(*cell, "version", *[F.col(f"s.`{c}`").alias(c) for c in names])
