"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where none is set, a session on one machine gets a temporary one; on a cluster, whose executors would not share
    it, that is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.match(r"local(\[[^\]]*\])?$", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
            _delete_at_exit(spark, folder)
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def _hadoop_path(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    files, where = _hadoop_path(spark, path)
    files.deleteOnExit(where)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the driver ends."""
    path = f"{checkpoint_dir(spark)}/{name}/{uuid.uuid4().hex}"
    files, where = _hadoop_path(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared checkpoint folder and read them from there.

    The lineage ends here, so a lost executor costs a re-read and not a recomputation. The table goes with ``forget`` or when
    the driver ends.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "tables")
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` on which nothing that is still to run depends."""
    for df in tables:
        if path := getattr(df, "_cut_at", None):
            files, where = _hadoop_path(df.sparkSession, path)
            files.delete(where, True)
