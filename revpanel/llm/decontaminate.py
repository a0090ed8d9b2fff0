"""Benchmark decontamination by winnowing.

Of every benchmark item the least hash of K words among each SPAN neighbouring positions is kept; the same is done
to the documents. K + SPAN - 1 = 13, so any 13 shared words contain a fingerprint kept on both sides. An item of fewer
than 13 words has one fingerprint, the hash of all its words, which is looked up at every position. A document's fingerprint that
a filter of the benchmark's lets through is extended to the windows of 13 words around it, and these are joined with the
items' windows in Spark. So a run of 8 words that very many documents and items share brings none of them together unless
13 are shared, and a hit is never more than a hash: the shared spans are the unions of the windows that meet.

What happens to a text depends on the text alone, so results are kept by 128 bits of it and equal texts are matched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revpanel.llm.common import WordHasher, alnum_words, cut, forget, mapped, mix64, rolling
from revpanel.llm.repeats import minimisers
from revpanel.llm.simhash import text_key

WINDOW, K = 13, 8
SPAN = WINDOW - K + 1
#: Bits of the filter of benchmark fingerprints that goes to all tasks, whatever the size of the benchmark.
FILTER_BITS, CHUNK = 1 << 26, 1 << 16


def _at_all(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, different from those of other sizes."""
    return mix64(rolling(words, size) ^ np.uint64(size * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def fingerprints(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of an item's fingerprints."""
    if len(words) < WINDOW:
        return (_at_all(words, len(words)), np.zeros(1, np.int64)) if len(words) else (np.empty(0, np.uint64), np.empty(0, np.int64))
    h = _at_all(words, K)
    p = minimisers(h, SPAN)
    return h[p], p


def candidates(words: np.ndarray, sizes: list[int], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of a document that may be the benchmark's, and where: WINDOW + 1 times their start, plus their size."""
    hs, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    if len(words) >= WINDOW:
        h, p = fingerprints(words)
        around = (p[_passes(h, bits)][:, None] - np.arange(SPAN)).ravel()
        starts = np.unique(around[(around >= 0) & (around <= len(words) - WINDOW)])
        if len(starts):
            hs.append(_at_all(words, WINDOW)[starts])
            at.append(starts * (WINDOW + 1) + WINDOW)
    for size in sizes:
        h = _at_all(words, size)
        starts = np.flatnonzero(_passes(h, bits))
        hs.append(h[starts])
        at.append(starts * (WINDOW + 1) + size)
    return np.concatenate(hs), np.concatenate(at)


def _passes(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    on = _slot(h, bits)
    return (bits[on >> 3] >> (on & 7).astype(np.uint8)) & 1 > 0


def _slot(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (h & np.uint64(8 * len(bits) - 1)).astype(np.int64)


def _edges(hit: np.ndarray) -> tuple[list, list]:
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return edge[::2].tolist(), edge[1::2].tolist()


def _items(benchmark: DataFrame, text: str, item_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(iid, n, item_ids array<string>): a row for each different sequence of words; (h): its fingerprints; (w, iid): its windows."""

    def start():
        hasher = WordHasher()
        return lambda texts: [[hasher(alnum_words(t.as_py())).tobytes() for t in texts]]

    plain = mapped(benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item_id"), F.col(f"`{text}`").alias("text")), ["text"], "words binary", start)
    same = plain.where("octet_length(words) > 0").groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    items = cut(same.withColumn("iid", F.monotonically_increasing_id()))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, w in zip(pdf["iid"], pdf["words"]):
                words = np.frombuffer(w, np.uint64)
                own = np.unique(_at_all(words, min(WINDOW, len(words))))
                yield pd.DataFrame({"kind": False, "h": own.view(np.int64), "iid": i})
                yield pd.DataFrame({"kind": True, "h": np.unique(fingerprints(words)[0]).view(np.int64), "iid": i})

    both = cut(items.select("iid", "words").mapInPandas(hashed, "kind boolean, h long, iid long"))
    return items, both.where("kind").select("h"), both.where("not kind").select(F.col("h").alias("w"), "iid")


def _filter(prints: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, 1 where a fingerprint may be: gathered in chunks, so that its size does not depend on the benchmark's."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for pdf in batches:
            on = _slot(pdf["h"].to_numpy().view(np.uint64), bits)
            np.bitwise_or.at(bits, on >> 3, (1 << (on & 7)).astype(np.uint8))
        for at in range(0, len(bits), CHUNK):
            if bits[at : at + CHUNK].any():
                yield pd.DataFrame({"at": [at], "bits": [bits[at : at + CHUNK].tobytes()]})

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": pdf["at"].iloc[:1], "bits": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]]).tobytes()]})

    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in prints.select("h").mapInPandas(partial, "at long, bits binary").groupBy("at").applyInPandas(merged, "at long, bits binary").toLocalIterator():
        bits[r["at"] : r["at"] + CHUNK] = np.frombuffer(r["bits"], np.uint8)
    return bits


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(doc_id, h1, h2, n_words, w, at), a row per document; (h1, h2, n_hit, items, starts, ends), a row per different text with hits."""
    items, prints, windows = _items(benchmark, text, item_id)
    # At most WINDOW - 1 lengths of items shorter than a window.
    sizes = [int(r["n"]) for r in items.select((F.octet_length("words") / 8).cast("int").alias("n")).where(f"n < {WINDOW}").distinct().collect()]
    shared = docs.sparkSession.sparkContext.broadcast((sorted(sizes), _filter(prints)))
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), *text_key(text), F.col(f"`{text}`").alias("text"))

    def start():
        hasher, (short, bits) = WordHasher(), shared.value

        def looked_up(texts: pa.Array) -> list:
            words = [hasher(alnum_words(t.as_py())) for t in texts]
            found = [candidates(w, short, bits) for w in words]
            return [list(map(len, words)), [w.view(np.int64) for w, _ in found], [at for _, at in found]]

        return looked_up

    every = cut(mapped(plain, ["text"], "n_words long, w array<long>, at array<long>", start))
    # Copies of a text give its windows once.
    ones = every.where("size(w) > 0").select("h1", "h2", F.explode(F.arrays_zip("w", "at")).alias("x")).select("h1", "h2", F.col("x.w").alias("w"), F.col("x.at").alias("at"))
    ones = cut(ones.distinct().join(windows.select("w").distinct(), "w", "left_semi"))
    spans = ones.groupBy("h1", "h2").agg(F.collect_list("at").alias("at"))
    pairs = ones.select("h1", "h2", "w").distinct().join(windows, "w").select("h1", "h2", "iid").distinct()
    named = pairs.join(items.select("iid", F.explode("item_ids").alias("item")), "iid")
    names = named.groupBy("h1", "h2").agg(F.array_sort(F.collect_set("item")).alias("items"))

    def merged(at: pa.Array) -> list:
        rows = []
        for x in at:
            x = np.array(x.as_py(), np.int64)
            s, size = x // (WINDOW + 1), x % (WINDOW + 1)
            steps = np.zeros(int((s + size).max()) + 1, np.int64)
            np.add.at(steps, s, 1)
            np.add.at(steps, s + size, -1)
            hit = np.cumsum(steps[:-1]) > 0
            rows.append((int(hit.sum()), *_edges(hit)))
        return list(zip(*rows)) or [[], [], []]

    found = mapped(spans, ["at"], "n_hit long, starts array<long>, ends array<long>", lambda: merged).join(names, ["h1", "h2"], "left")
    found = cut(found.select("h1", "h2", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), "starts", "ends"))
    forget(items, ones)
    return every, found


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = 20, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted ids), contaminated, starts, ends (hit intervals in words).

    A document word inside any occurrence of an item's window (13 words in a row, or the whole of a shorter item) is hit;
    contaminated: n_hit > 0 and share * n_hit >= n_words. Whole texts of any length; null or empty texts and items have no
    words. Items with a null id hit words but are not listed. Rows that repeat a document are each returned, as are null
    ids; items that repeat count once. Empty tables give no rows or no hits; other columns are not read. The benchmark is
    joined by its fingerprints at every size; only a filter of FILTER_BITS bits goes to all tasks.
    """
    every, found = hits(docs, benchmark, text, doc_id, item_id)
    every = every.select("doc_id", "h1", "h2", "n_words")
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(f"array<{kind}>")).alias(c)
    out = every.join(found, ["h1", "h2"], "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0)))
    contaminated = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return out.select("doc_id", "n_words", "n_hit", none("items", "string"), contaminated.alias("contaminated"), none("starts", "long"), none("ends", "long"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """The documents without any benchmark window, with all their columns.

    A passage of a benchmark spoils a long document as it does a short one, so one hit is enough. Documents without words
    (null or empty) stay, as do rows that repeat and null ids; an empty benchmark drops nothing, an empty table stays empty.
    """
    every, found = hits(docs, benchmark, text, doc_id, item_id)
    forget(every)
    names = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.select(F.struct(*names).alias("row"), *text_key(text))
    return marked.join(found.select("h1", "h2"), ["h1", "h2"], "left_anti").select("row.*")
