"""Exact top-k inner products with a pivot table.

The distances of every vector to a number of pivot vectors are computed once and stored. For a query the largest difference
between its distances and a candidate's bounds their distance from below, and with the norms that bounds the inner
product from above: <q, x> <= (|q|^2 + |x|^2 - bound^2) / 2. Candidates that lie together, by their nearest pivot and the distance
to it, form cells, whose intervals of distances give one bound for all of them; cells are evaluated in the order of
that bound until the next one is under the k-th best score, so the result is exact. The k-th best is carried through
all of a task's candidates and starts at the one among a fixed number of rows.

Vectors of different lengths never meet; for the pivots they count as filled up with zeros, which changes no distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revpanel.llm.common import cut, forget

#: Queries that go out at once; candidates that a task holds at once; candidates of a cell; rows that the k-th best starts from.
QUERY_BLOCK, HELD, CELL, FIRST = 2048, 32_768, 64, 1024
LOWEST = -(1 << 62)


def _integers(v: np.ndarray, scale: float) -> list[int]:
    """floor(scale * x), also where the product has no double."""
    products = [scale * float(x) for x in v]
    return [math.floor(p) if math.isfinite(p) else int(x) * int(scale) for p, x in zip(products, v)]


def _dots(x: list[list[int]], q: list[int]) -> list[int]:
    return [sum(a * b for a, b in zip(row, q)) for row in x]


class Vectors:
    """Rows of one length: row keys, ids, raw values, scaled values, pivot distances, and which are too large for exact floats."""

    def __init__(self, rid: np.ndarray, ids: np.ndarray, raw: np.ndarray, table: np.ndarray, scale: float):
        self.rid, self.ids, self.raw, self.table, self.scale = rid, ids, raw, table, scale
        with np.errstate(over="ignore"):
            x = np.floor(scale * raw)
        most = np.abs(x).max(1, initial=0)
        self.large = ~(most * most * max(1, raw.shape[1]) < 2**52)
        self.x = np.where(self.large[:, None], 0, x)
        self.norms = (self.x * self.x).sum(1)

    def __getitem__(self, at: np.ndarray) -> Vectors:
        return Vectors(self.rid[at], self.ids[at], self.raw[at], self.table[at], self.scale)


def _by_length(pdf: pd.DataFrame, scale: float, pivots: int) -> dict[int, Vectors]:
    """Rows (rid, id, v, t), v being doubles as bytes, by the length of v."""
    sizes, out = pdf["v"].str.len().to_numpy() // 8 if len(pdf) else np.empty(0, np.int64), {}
    for n in np.unique(sizes):
        part = pdf[sizes == n]
        raw = np.frombuffer(b"".join(part["v"]), np.float64).reshape(len(part), n)
        table = np.frombuffer(b"".join(part["t"]), np.float64).reshape(len(part), pivots)
        out[int(n)] = Vectors(part["rid"].to_numpy(), part["id"].to_numpy(), raw, table, scale)
    return out


class Search:
    """The k best candidates so far of each query of one length."""

    def __init__(self, queries: Vectors, first: Vectors | None, k: int):
        self.q, self.k, n = queries, k, len(queries.rid)
        self.score = np.full((n, k), LOWEST, np.int64)
        self.ids = np.full((n, k), np.iinfo(np.int64).max, np.int64)
        self.floor = np.full(n, LOWEST, np.int64)
        self.evaluated = 0
        self.exact: list[tuple[int, int, int]] = []
        if first is not None and len(first.rid) > k:
            s = self._scores(first)
            s[:, first.large] = LOWEST
            self.floor = np.where(queries.large, LOWEST, np.partition(s, -k, axis=1)[:, -k])

    def _scores(self, c: Vectors, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        s = (self.q.x[at] @ c.x.T).astype(np.int64)
        s[self.q.rid[at][:, None] == c.rid[None, :]] = LOWEST
        return s

    def add(self, c: Vectors) -> None:
        """Look at more candidates."""
        if not len(c.rid):
            return
        self._add_large(c)
        c = c[~c.large]
        near = c.table.argmin(1) if c.table.shape[1] else np.zeros(len(c.rid), np.int64)
        order = np.lexsort((c.table[np.arange(len(near)), near] if c.table.shape[1] else near, near))
        c = c[order]
        starts = np.arange(0, len(order), CELL)
        if not len(starts):
            return
        low, high = np.minimum.reduceat(c.table, starts), np.maximum.reduceat(c.table, starts)
        norm = np.maximum.reduceat(c.norms, starts)
        usual = np.flatnonzero(~self.q.large)
        bound = np.zeros((len(usual), len(starts)))
        for p in range(c.table.shape[1]):
            t = self.q.table[usual, p][:, None]
            np.maximum(bound, np.maximum(t - high[None, :, p], low[None, :, p] - t), out=bound)
        both = self.q.norms[usual][:, None] + norm[None, :]
        # A relative slack covers the rounding of the distances.
        above = (both - bound * bound) / 2 + 1e-9 * both + 1e-6
        for cell in np.argsort(-above.max(0), kind="stable"):
            least = np.maximum(self.floor[usual], self.score[usual, -1])
            on = usual[above[:, cell] >= least]
            if not len(on):
                continue
            part = c[np.arange(starts[cell], min(starts[cell] + CELL, len(order)))]
            self.evaluated += len(on) * len(part.rid)
            s = self._scores(part, on)
            better = s.max(1) >= np.maximum(self.score[on, -1], LOWEST + 1)
            self._keep(on[better], s[better], part.ids)

    def _keep(self, on: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        score = np.concatenate([self.score[on], s], 1)
        every = np.concatenate([self.ids[on], np.broadcast_to(ids, s.shape)], 1)
        top = np.lexsort((every, -score), axis=1)[:, : self.k]
        self.score[on], self.ids[on] = np.take_along_axis(score, top, 1), np.take_along_axis(every, top, 1)

    def _add_large(self, c: Vectors) -> None:
        """Pairs with a vector whose products exceed exact floats: all of them, in integers of any size."""
        q = self.q
        pairs = [(np.flatnonzero(q.large), np.arange(len(c.rid))), (np.flatnonzero(~q.large), np.flatnonzero(c.large))]
        for some, against in pairs:
            if len(some) and len(against):
                x = [_integers(v, c.scale) for v in c.raw[against]]
                for i in some:
                    s = _dots(x, _integers(q.raw[i], c.scale))
                    found = [(v, int(c.ids[j])) for v, j in zip(s, against) if c.rid[j] != q.rid[i]]
                    self.exact += [(int(i), v, j) for v, j in sorted(found, key=lambda f: (-f[0], f[1]))[: self.k]]
                    self.evaluated += len(found)

    def rows(self) -> Iterator[tuple[int, int, int, int]]:
        """(row key of the query, its id, id, score), k per query at most."""
        exact: dict[int, list[tuple[int, int]]] = {}
        for i, v, j in self.exact:
            exact.setdefault(i, []).append((v, j))
        for i in range(len(self.q.rid)):
            found = [(int(s), int(j)) for s, j in zip(self.score[i], self.ids[i]) if s > LOWEST] + exact.get(i, [])
            for v, j in sorted(found, key=lambda f: (-f[0], f[1]))[: self.k]:
                if v >= self.floor[i]:
                    yield int(self.q.rid[i]), int(self.q.ids[i]), j, v


def exact_top_k(vectors: DataFrame, is_query: F.Column, k: int = 5, scale: float = 256.0, pivots: int = 32, vec: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of floor(scale * x), ties to smaller ids.

    Queries are the rows for which ``is_query`` holds; candidates are all rows but the query's own, also rows that repeat its
    id, and a row that repeats a query is a query of its own. Fewer candidates give fewer rows. Vectors that are null or hold
    null or non-finite components, and rows with a null id, take no part; vectors meet only vectors of the same length, of
    any number of lengths. Products are compared as whole numbers of any size; a score beyond 64 bits is shown as
    the nearest 64-bit number. Empty tables give an empty result; other columns are not read. Queries are a stated set:
    they go to all rows in blocks of QUERY_BLOCK.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vec}`").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    sound = plain.where("id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    rows = cut(sound.withColumn("rid", F.monotonically_increasing_id()))
    chosen = rows.orderBy(F.xxhash64("rid"), "rid").limit(FIRST).select("rid", "id", "v").collect()
    # Pivots are of usual size, so that distances to them are sound numbers.
    some = [r["v"] for r in chosen if max(map(abs, r["v"]), default=0) < 1e6][:pivots]
    width = max(map(len, some), default=0)
    refs = np.zeros((len(some), width))
    for i, v in enumerate(some):
        refs[i, : len(v)] = np.floor(scale * np.array(v))

    def table_of(v: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(scale * np.asarray(v, np.float64))
            head, rest = x[:width], x[width:]
            d = np.sqrt(((refs[:, : len(head)] - head) ** 2).sum(1) + (refs[:, len(head) :] ** 2).sum(1) + (rest**2).sum())
        return np.nan_to_num(d, nan=0.0, posinf=0.0)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes, tables = pdf["v"].str.len().to_numpy() if len(pdf) else np.empty(0), np.zeros((len(pdf), len(refs)))
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                if 0 < n == width:
                    with np.errstate(over="ignore", invalid="ignore"):
                        x = np.floor(scale * np.stack(pdf["v"].iloc[at].to_numpy()).astype(np.float64))
                        d = np.sqrt(np.stack([((x - r) ** 2).sum(1) for r in refs], 1))
                    tables[at] = np.nan_to_num(d, nan=0.0, posinf=0.0)
                else:
                    for i in at:
                        tables[i] = table_of(pdf["v"].iloc[i])
            v = [np.asarray(a, np.float64).tobytes() for a in pdf["v"]]
            yield pdf[["rid", "id", "query"]].assign(v=v, t=[t.tobytes() for t in tables])

    indexed = cut(rows.mapInPandas(index, "rid long, id long, query boolean, v binary, t binary"))
    first = pd.DataFrame([(r["rid"], r["id"], np.array(r["v"]).tobytes(), table_of(np.array(r["v"])).tobytes()) for r in chosen], columns=["rid", "id", "v", "t"])
    n_blocks, out = max(1, -(-indexed.where("query").count() // QUERY_BLOCK)), None
    for b in range(n_blocks):
        picked = indexed.where("query").where(F.pmod(F.xxhash64("rid"), F.lit(n_blocks)) == b).select("rid", "id", "v", "t")
        block = spark.sparkContext.broadcast((pd.DataFrame([tuple(r) for r in picked.toLocalIterator()], columns=["rid", "id", "v", "t"]), first))

        def search(batches: Iterator[pd.DataFrame], block=block, m=len(refs)) -> Iterator[pd.DataFrame]:
            queries, start = (_by_length(x, scale, m) for x in block.value)
            found = {n: Search(q, start.get(n), k) for n, q in queries.items()}
            held: list[pd.DataFrame] = []
            for pdf in (*batches, None):
                if pdf is not None and len(pdf):
                    held.append(pdf)
                if held and (pdf is None or sum(map(len, held)) >= HELD):
                    for n, c in _by_length(pd.concat(held, ignore_index=True), scale, m).items():
                        if n in found:
                            found[n].add(c)
                    held = []
            clip = lambda v: min(max(v, -(1 << 63)), (1 << 63) - 1)
            rows = [(i, q, j, clip(v), str(v) if clip(v) != v else None) for s in found.values() for i, q, j, v in s.rows()]
            yield pd.DataFrame(rows, columns=["qrid", "query_id", "vec_id", "score", "beyond"])

        part = cut(indexed.select("rid", "id", "v", "t").mapInPandas(search, "qrid long, query_id long, vec_id long, score long, beyond string"))
        block.destroy()
        out = part if out is None else out.union(part)
    # Of scores beyond 64 bits the longer number is the larger one (the smaller one below zero).
    sign, beyond = F.when(F.col("score") > 0, 1).otherwise(-1), F.col("beyond")
    further = F.when(beyond.isNull(), 0).otherwise(sign * F.length("beyond"))
    digits = F.when(sign > 0, beyond).otherwise(F.translate("beyond", "0123456789", "9876543210"))
    order = [F.desc("score"), F.desc(further), F.desc(digits), "vec_id"]
    rank = F.row_number().over(Window.partitionBy("qrid").orderBy(*order))
    result = out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    forget(rows, indexed)
    return result
