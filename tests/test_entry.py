"""The registered queries against their SQL, at the smallest size."""

import datetime as dt
import math

import duckdb
import pytest

from revpanel.plans.coverage import ORACLE, QUERIES
from revpanel.sources.tables import log_ship

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v.isoformat()[:10] if isinstance(v, (dt.date, dt.datetime)) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*cols).collect()), key=str)
    want = sql.sql(ORACLE[name])
    assert sorted(want.columns) == cols
    assert got == sorted((tuple(plain(x) for x in r) for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(5).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_geo_types_of_large_keys(spark, sql, tmp_path):
    """Keys of six and more digits are as many texts as keys."""
    for t in ("region", "nation"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    keys = [0, 1, 99999, 100000, 100001, 900000, 900001, 10**10, 10**15 + 1, 2**63 - 1]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["geos"]: (r["geo_type"], r["n"]) for r in QUERIES["geo_types"](spark, str(tmp_path)).collect()}
    assert got["five digits"] == ("county", len(keys))


@pytest.mark.parametrize("count, last", [(False, None), (True, 2001 * 12)])
def test_log_reads_its_tables_once(spark, count, last):
    """What is done with the log reads a table of sums, not orders and items again."""
    files = log_ship(spark, FOLDER, count, last).df.inputFiles()
    assert files and not [f for f in files if "lineitem" in f or "orders" in f]
