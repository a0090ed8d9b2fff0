"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revpanel.llm.common import cut, forget


#: Edges of a task, where there are fewer than for all partitions.
EDGES = 20_000


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member reachable from each of n members over the links (i, j)."""
    lab = np.arange(n)
    while True:
        new = lab.copy()
        np.minimum.at(new, i, lab[j])
        np.minimum.at(new, j, new[i])
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _joined_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges (a, b) of one task as stars around the least nodes that these connect."""
    parts = [pdf[["a", "b"]].to_numpy(np.int64) for pdf in batches]
    nodes, at = np.unique(np.concatenate([np.empty((0, 2), np.int64), *parts]), return_inverse=True)
    at = at.reshape(-1, 2)
    root = least_reached(len(nodes), at[:, 0], at[:, 1])
    far = np.flatnonzero(root != np.arange(len(nodes)))
    yield pd.DataFrame({"a": nodes[root[far]], "b": nodes[far]})


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a long, b long) -> (node long, comp long): comp is the smallest node of the component.

    First each task joins up its own edges, EDGES or so; where they are one task's, that is all. Then each round sends a node's larger neighbours, then its smaller ones, to its least neighbour.
    Minima are partial aggregates and are written out first, so that the joins that follow are
    between plain tables and a node with very many edges can be split over tasks.
    Few edges are written by few tasks. Nodes without an edge are not in the result; an empty edge table gives an empty result.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    now = cut(edges.where("a != b").select(lo.alias("a"), hi.alias("b")).distinct())
    tasks = now.count() // EDGES + 1
    old, now = now, cut(now.coalesce(tasks).mapInPandas(_joined_up, "a long, b long"))
    forget(old)
    before = _digest(now) if tasks > 1 else (0, None)
    for _ in range(rounds):
        if not before[0]:
            break
        few = lambda df, n=before[0] // EDGES + 1: cut(df.coalesce(n))
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = few(both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct())
        lower = few(large.groupBy("b").agg(F.min("a").alias("m")))
        joined = large.join(lower, "b")
        small = joined.where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(lower.select(F.col("m").alias("a"), "b"))
        old, now = now, few(small.distinct())
        forget(old, least, large, lower)
        after = _digest(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("comp")).union(now.select("a", "a").distinct())
