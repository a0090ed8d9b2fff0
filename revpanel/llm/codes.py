"""Vector codes: product quantisation in whole numbers, with exponion search of the nearest codebook entry.

Vectors are cut into parts, and each part position has a codebook of up to 256 entries, fitted by Lloyd's rounds. The
nearest entry of a part is looked for from the entry it had in the round before: with u the distance to that entry, no
entry further than 2u from it can be as near as it is (triangle inequality), so only the beginning of its list of
neighbours, sorted by distance, is scanned. All distances are squared and whole, so the search is exact, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revpanel.llm.common import cursors, cut, forget, mapped

#: Components of vectors end here, so that squared distances of parts of up to 1024 components fit into 64 bits.
BOUND = 1 << 24


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """int64[n, m]: squared distances of whole numbers, through doubles only where these are exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 1 << 52:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], 1)


class Exponion:
    """The nearest of a codebook's entries, ties to the lower index."""

    def __init__(self, book: np.ndarray):
        self.book = book
        between = squared(book, book)
        self.neighbours = np.argsort(between, axis=1, kind="stable")
        self.far = np.take_along_axis(between, self.neighbours, 1)
        self.scanned = 0

    def __call__(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of ``x`` and its squared distance, looked for from the entries ``start``."""
        own = ((x - self.book[start]) ** 2).sum(1)
        found, best = start.astype(np.int64), own.copy()
        order = np.argsort(start, kind="stable")
        for s, e in zip(*cursors(start[order])):
            rows = order[s:e]
            a = start[rows[0]]
                # At a distance of 2u or less: 4 u^2, which fits into 64 bits as components end at BOUND.
            reach = np.searchsorted(self.far[a], 4 * own[rows], side="right")
            # Rows of like reach are scanned together.
            level = np.ceil(np.log2(reach)).astype(np.int64)
            for k in np.unique(level):
                some = rows[level == k]
                near = np.sort(self.neighbours[a, : reach[level == k].max()])
                d = squared(x[some], self.book[near])
                self.scanned += d.size
                j = d.argmin(1)
                found[some], best[some] = near[j], d[np.arange(len(some)), j]
        return found, best


class Codebooks:
    """The entries of each part position, int64[parts, entries, components]."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries

    def sha256(self) -> str:
        """Of all components in decimals, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decoded(self, code: bytes) -> np.ndarray:
        """The vector that a code stands for, in the whole numbers of the codebooks."""
        return np.concatenate([self.entries[p, c] for p, c in enumerate(code)])


def _parts(x: pa.ListArray, parts: int, width: int) -> np.ndarray:
    return x.flatten().to_numpy().astype(np.int64).reshape(len(x), parts, width // parts)


def _assigned(rows: DataFrame, books: np.ndarray, final: bool = False) -> DataFrame:
    """The rows with the code of ``x`` under the codebooks, found from the code that they have (null: from the first entries).

    With ``final`` the error takes the place of ``x``.
    """
    parts, width = books.shape[0], books.shape[0] * books.shape[2]

    def start():
        search = [Exponion(b) for b in books]

        def assign(x: pa.ListArray, code: pa.BinaryArray) -> list:
            values, n = _parts(x, parts, width), len(x)
            before = np.frombuffer(b"".join(c or bytes(parts) for c in code.to_pylist()), np.uint8).reshape(n, parts)
            codes, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
            for p in range(parts) if n else ():
                codes[:, p], d = search[p](values[:, p], before[:, p])
                error += d
            return [error if final else x, [c.tobytes() for c in codes]]

        return assign

    return mapped(rows, ["x", "code"], "error long, code binary" if final else "x array<int>, code binary", start, 16_384)


def _updated(coded: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floor of the mean of its parts; entries without any stay.

    One row for each part, entry and position comes back, whatever the number of vectors.
    """
    parts, entries, d = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts * entries, d), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            values = _parts(batch.column(0), parts, parts * d)
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(values), parts)
            for p in range(parts):
                slot = p * entries + codes[:, p].astype(np.int64)
                np.add.at(total, slot, values[:, p])
                n += np.bincount(slot, minlength=len(n))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used], pa.int64()), pa.array(list(total[used]), pa.list_(pa.int64()))], ["slot", "n", "sums"])

    partial = coded.select("x", "code").mapInArrow(sums, "slot int, n long, sums array<long>")
    counted = partial.select("slot", "n", F.posexplode_outer("sums").alias("at", "v")).groupBy("slot", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    out = books.reshape(parts * entries, d).copy()
    for r in counted.collect() if d else ():
        out[r["slot"], r["at"]] = r["v"] // r["n"]
    return out.reshape(books.shape)


def compress_vectors(vectors: DataFrame, keep: list[str] | None = None, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0, vec: str = "embedding", vec_id: str = "vec_id") -> tuple[DataFrame, Codebooks]:
    """(the columns ``keep`` (by default the id), code binary, error long) of every vector, and the codebooks.

    A component x is the whole number floor(scale * x), at most BOUND in size. The codebook of each of ``parts`` equal
    consecutive parts begins with that part of the vectors with the ``entries`` smallest ids, ascending. In each round every part
    goes to its nearest entry (squared distance, ties to the lower index), then every entry becomes the floor of the mean of its
    parts, and one without any stays. Last, all parts are assigned again: a code has one byte a part, an error is the sum
    of its squared distances.

    Vectors that are null or hold null, NaN or infinite components are left out. A null id counts as the largest; rows that
    repeat an id or a vector are all kept and in the order of their components; fewer vectors than ``entries`` make as many
    entries. Vectors of other lengths, and lengths that ``parts`` does not divide, are filled up with zeros to the longest. An empty table
    gives no rows and empty codebooks. Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part, so a codebook has 1 to 256 entries")
    keep = [vec_id] if keep is None else keep
    sound = vectors.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col(f"`{vec_id}`").alias("id"), F.col(f"`{vec}`").cast("array<double>").alias("v"))
    sound = sound.where("v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    longest = sound.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts) * parts
    if width // parts > 1024:
        raise ValueError("parts of over 1024 components have no exact distances")
    whole = F.transform("v", lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x * scale, F.lit(2.0 * BOUND)), F.lit(-2.0 * BOUND))), F.lit(BOUND)), F.lit(-BOUND)).cast("int"))
    filled = F.concat(whole, F.array_repeat(F.lit(0), F.lit(width) - F.size("v"))).alias("x")
    kept = [f"k{i}" for i in range(len(keep))]
    rows = cut(sound.select(*kept, "id", filled, F.lit(None).cast("binary").alias("code")))
    first = [r["x"] for r in rows.orderBy(F.asc_nulls_last("id"), "x").limit(entries).select("x").collect()]
    books = np.array(first, np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    for _ in range(rounds if first else 0):
        before, rows = rows, cut(_assigned(rows, books))
        forget(before)
        books = _updated(rows, books)
    out = _assigned(rows.drop("id"), books, final=True)
    return out.select(*(F.col(k).alias(c) for k, c in zip(kept, keep)), "code", "error"), Codebooks(books)
