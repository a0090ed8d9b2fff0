"""How many rows and jobs the linking of near copies takes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from revpanel.llm import graph, simhash


@pytest.mark.parametrize("n", [150, 600])
def test_members_of_a_large_bucket_are_joined_twice(spark, monkeypatch, n):
    """A bucket whose members are hardly linked: each is written when buckets are sized, labelled, and dealt over tiles, and no more."""
    monkeypatch.setattr(simhash, "TILE", 4)
    cut, buckets, written, looked = simhash.cut, simhash._in_buckets, [], []

    def counted(df):
        out = cut(df)
        if {"key", "id"} <= set(df.columns):
            written.append(out.count())
        return out

    def looks(rows, *args):
        looked.append(rows.count())
        return buckets(rows, *args)

    monkeypatch.setattr(simhash, "cut", counted)
    monkeypatch.setattr(simhash, "_in_buckets", looks)
    fps = np.random.default_rng(5).integers(0, 1 << 64, (n, 8), dtype=np.uint64)
    fps[n - 20 :] = fps[:20] ^ np.uint64(1)
    items = spark.createDataFrame([(i, fps[i].tobytes()) for i in range(n)], "id long, fp binary")
    got = {r["node"]: r["comp"] for r in simhash.linked(items.select(F.lit(7).cast("long").alias("key"), "id"), items, 122).collect()}
    assert got == {j: i for i in range(20) for j in (i, n - 20 + i)}
    assert sum(written) <= 3 * n and looked[1] == 0


@pytest.mark.parametrize("edges", [20_000, 7])
def test_edges_of_one_task_are_joined_up_at_once(spark, monkeypatch, edges):
    """Two tables for edges that are one task's; in several tasks the rounds join what these have."""
    monkeypatch.setattr(graph, "EDGES", edges)
    cut, written = graph.cut, []

    def counted(df):
        written.append(df.columns)
        return cut(df)

    monkeypatch.setattr(graph, "cut", counted)
    rng = np.random.default_rng(6)
    pairs = [*rng.integers(-40, 40, (45, 2)).tolist(), *[[i, i + 1] for i in range(100, 140)], [200, 200]]
    nodes = sorted({x for p in pairs for x in p if p[0] != p[1]})
    least = {x: x for x in nodes}
    for _ in nodes:
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = [tuple(r) for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()]
    assert sorted(got) == sorted(least.items())
    assert len(written) == 2 if edges > 100 else len(written) > 2
