"""Shared pieces of the text operators: word rules, cut points, and packed rows."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from revpanel.sources.shared import checkpoint_dir, cut, forget, shared_folder  # noqa: F401  used from here

#: A-Z to a-z, all other bytes unchanged.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _word_table() -> bytes:
    """Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space."""
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalnum() else 32
    return bytes(table)


ALNUM = _word_table()


def plain_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 (bytes.split() cuts at exactly these six characters)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """``plain_words`` after lower-casing A-Z."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and all characters from U+0080 on."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


class WordHasher:
    """64-bit hash of each word, with a cache that is emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 100_000):
        self.limit, self.cache = limit, _Hashes()

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.cache) > self.limit:
            self.cache.clear()
        return np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Two odd bases of rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    if len(_POWERS.get((base, 1), ())) < n:
        size = max(n, 1 << 15)
        for sign in (1, -1):
            p = np.full(size, pow(base, sign, 1 << 64), np.uint64)
            p[0] = 1
            _POWERS[base, sign] = np.multiply.accumulate(p)
    return _POWERS[base, 1][:n], _POWERS[base, -1][:n]


def rolling(hashes: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """Rabin-Karp hashes of all windows of ``width`` word hashes (modulo 2**64, then mixed)."""
    n = len(hashes)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = _powers(n + 1, base)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * down[:n], out=sums[1:])
    return mix64((sums[width:] - sums[:-width]) * up[: n - width + 1] ^ np.uint64(width))


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of n words joined by a space; fewer words make one run."""
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([digest(joined, 42)], np.uint64)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return np.fromiter((digest(joined[s : e - 1], 42) for s, e in zip(starts, ends[n - 1 :])), np.uint64, len(words) - n + 1)


def mapped(df: DataFrame, read: list[str], made: str, start: Callable[[], Callable[..., list]], rows: int = 512) -> DataFrame:
    """The columns of ``df`` but those of ``read``, and the columns ``made`` (a schema as DDL) that a function makes of these.

    ``start`` is called once in a task and gives the function, which gets the columns of ``read`` of a batch as Arrow arrays
    and returns the values of each column made, for ``rows`` rows at a time, so that what it makes of them on the way takes little
    memory beside the batch. All other columns stay in Arrow, so that ids of any type keep their values:
    in pandas a long beside a null would become a double and lose its last digits.
    """
    new = StructType.fromDDL(made)
    kept, at = [c for c in df.columns if c not in read], [df.columns.index(c) for c in read]
    places, types = [df.columns.index(c) for c in kept], [to_arrow_type(f.dataType) for f in new]
    names = kept + new.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in batches:
            for s in range(0, len(batch), rows):
                part = batch.slice(s, rows)
                made = [pa.array(v, t) for v, t in zip(make(*[part.column(i) for i in at]), types)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in places] + made, names)

    return df.mapInArrow(run, StructType([df.schema[c] for c in kept] + new.fields))


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the bytes of a plan: file sizes for a scan, so no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def power_of_two(x: float, least: int, most: int) -> int:
    n = least
    while n < x and n < most:
        n *= 2
    return n


def cursors(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal keys."""
    if not len(sorted_keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return starts, np.r_[starts[1:], len(sorted_keys)]


def grouped_batches(batches: Iterator, keys: list[str]) -> Iterator:
    """Cut a stream of pandas frames that is sorted by ``keys`` so that no group spans two frames."""
    import pandas as pd

    kept = None
    for pdf in batches:
        if not len(pdf):
            continue
        if kept is not None:
            pdf = pd.concat([kept, pdf], ignore_index=True)
        last = np.ones(len(pdf), bool)
        for k in keys:
            last &= (pdf[k] == pdf[k].iloc[-1]).to_numpy()
        at = len(pdf) - int(last[::-1].cumprod().sum())
        kept = pdf.iloc[at:]
        if at:
            yield pdf.iloc[:at].reset_index(drop=True)
    if kept is not None and len(kept):
        yield kept.reset_index(drop=True)

