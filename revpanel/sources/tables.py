"""Reading and writing panels and logs, and the panels and logs derived from the order tables."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revpanel.log import RevisionLog
from revpanel.meta import PanelMeta
from revpanel.panel import Panel
from revpanel.sources.shared import cut
from revpanel.sources.store import append_log, read_log, read_snapshot, write_log


def read_table(spark: SparkSession, path: str, format: str = "parquet", **options: Any) -> DataFrame:
    """Any source that Spark reads."""
    return spark.read.format(format).options(**options).load(path)


def _text(meta: PanelMeta) -> str:
    return json.dumps({k: list(v) if isinstance(v, tuple) else None if v is None else v if isinstance(v, (int, float, str)) else str(v) for k, v in meta.__dict__.items()})


def write_panel(panel: Panel, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    """Parquet files; the metadata travel in a column comment of geo_value."""
    df = panel.df.withMetadata("geo_value", {"panel": _text(panel.meta)})
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def read_panel(spark: SparkSession, path: str) -> Panel:
    df = spark.read.parquet(path)
    meta = json.loads(df.schema["geo_value"].metadata["panel"])
    return Panel(df, PanelMeta(meta["geo_type"], meta["time_type"], meta["as_of"], tuple(meta["other_keys"])))


__all__ = ["append_log", "log_ship", "panel_events", "panel_nation_month", "panel_region", "panel_week", "read_log", "read_panel", "read_snapshot", "read_table", "write_log", "write_panel"]

# -- derived from the order tables ------------------------------------------------------------------------------------


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_custkey -> nation and region, lower case."""
    nation = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = nation.select("n_nationkey", F.lower("n_name").alias("nation"), F.lower("r_name").alias("region"))
    return _t(spark, sf_dir, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "nation", "region")


def panel_region(spark: SparkSession, sf_dir: str) -> Panel:
    """Region by day: n orders, rev (sum of prices in cents / 100) and big (any order over 400000)."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    rows = _t(spark, sf_dir, "orders").join(_places(spark, sf_dir), "o_custkey")
    df = rows.groupBy(F.col("region").alias("geo_value"), F.to_date("o_orderdate").alias("time_value")).agg(F.count("*").alias("n"), (F.sum(cents) / 100.0).alias("rev"), (F.max("o_totalprice") > 400000).alias("big"))
    return Panel.from_df(df, geo_type="custom", time_type="day", validate=False)


def panel_nation_month(spark: SparkSession, sf_dir: str) -> Panel:
    rows = _t(spark, sf_dir, "orders").join(_places(spark, sf_dir), "o_custkey")
    df = rows.groupBy(F.col("nation").alias("geo_value"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("time_value")).agg(F.count("*").alias("n"))
    return Panel.from_df(df, geo_type="custom", time_type="yearmonth", validate=False)


def panel_week(spark: SparkSession, sf_dir: str) -> Panel:
    """Nation by week (Mondays)."""
    rows = _t(spark, sf_dir, "orders").join(_places(spark, sf_dir), "o_custkey")
    df = rows.groupBy(F.col("nation").alias("geo_value"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("time_value")).agg(F.count("*").alias("n"))
    return Panel.from_df(df, geo_type="custom", time_type="week", validate=False)


def panel_events(spark: SparkSession, sf_dir: str) -> Panel:
    """Event type by day, with the other key grp = user_id % 3."""
    df = _t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("geo_value"), (F.col("user_id") % 3).alias("grp"), F.to_date("ts").alias("time_value")).agg(F.count("*").alias("n"))
    return Panel.from_df(df, other_keys=["grp"], geo_type="custom", time_type="day", validate=False)


def log_ship(spark: SparkSession, sf_dir: str, count: bool = False, last: int | None = None) -> RevisionLog:
    """Region by order month, revised each ship month: quantity (or number) shipped by then, a running sum.

    The sums of each ship month are written as a table: orders and items are read and joined once, however often the log is.
    """
    from pyspark.sql import Window

    month = lambda c: (F.year(c) * 12 + F.month(c)).cast("int")
    places = _places(spark, sf_dir).select("o_custkey", "region")
    orders = _t(spark, sf_dir, "orders").join(places, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "region", month("o_orderdate").alias("time_value"))
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", month("l_shipdate").alias("version")).join(orders, "l_orderkey").where("version >= time_value")
    value = F.count("*").cast("double") if count else F.sum("l_quantity").cast("double")
    step = cut(rows.groupBy(F.col("region").alias("geo_value"), "time_value", "version").agg(value.alias("__n")))
    w = Window.partitionBy("geo_value", "time_value").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    df = step.select("geo_value", "time_value", "version", F.sum("__n").over(w).alias("lines" if count else "qty"))
    if last is not None:
        df = df.where(F.col("version") <= last)
    return RevisionLog.from_df(df, geo_type="custom", time_type="integer", compact=False, validate=False, versions_end=last)
