"""Removal of passages that occur earlier: by all windows (Rabin-Karp) or by sparse suffix arrays.

A document is a doc_id and a text: rows that repeat both are one document, rows that repeat a doc_id with other texts are
several, in the order of a hash of their texts. Positions are (doc_id, hash of the text, word).

Windows are counted in two rounds. The first finds candidates by 24 bits of a hash beside its bucket, which loses none (and
adds a few in a hundred); positions travel as packed arrays, one row per task batch and bucket, so that a shuffle carries
about seven bytes a window. The second decides on the candidates alone by two independent hashes, 96 bits together: n different
windows among the candidates meet by chance with a probability under n**2 / 2**97. (Words themselves are told apart by 64
bits.) Each batch keeps back all but its first occurrence of a window, so a passage that stands in a third of all documents
sends one position per batch and no task ever gathers its occurrences.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from revpanel.llm.common import BASES, WordHasher, cursors, cut, forget, grouped_batches, input_bytes, mix64, plain_words, power_of_two, rolling

#: Words that a task hashes at once; windows a bucket should hold; bytes of text of a group of documents.
BATCH_WORDS, BUCKET_WINDOWS, GROUP_BYTES = 500_000, 1 << 19, 3 << 20
NO_ID = -(1 << 63)
#: A document: (doc_id or NO_ID, hash of the text), its doc_id and its words.
Doc = tuple[int, int, list[bytes]]
_EMPTY = np.empty(0, np.int64)


def _planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight beside each other, which packs better."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def _unplanes(b: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, n).T).view(kind).ravel()


def salt(doc: np.ndarray, text: np.ndarray) -> np.ndarray:
    """What tells the texts of one doc_id apart in the first round: all of the hash where there is no doc_id, else four bits."""
    return np.where(doc == NO_ID, text, text & 15)


class Marks:
    """Positions (doc, text, start), sorted, with hashes of some width for each (uint8[n, width])."""

    def __init__(self, doc: np.ndarray, text: np.ndarray, start: np.ndarray, tail: np.ndarray | None = None):
        self.doc, self.text, self.start = doc, text, start
        self.tail = np.empty((len(doc), 0), np.uint8) if tail is None else tail

    def __len__(self) -> int:
        return len(self.doc)

    def __getitem__(self, at: np.ndarray) -> Marks:
        return Marks(self.doc[at], self.text[at], self.start[at], self.tail[at])

    @classmethod
    def joined(cls, parts: list[Marks]) -> Marks:
        return cls(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("doc", "text", "start", "tail")))

    def pack(self) -> bytes:
        new = np.flatnonzero(np.r_[True, (self.doc[1:] != self.doc[:-1]) | (self.text[1:] != self.text[:-1])][: len(self)])
        counts = np.diff(np.r_[new, len(self)]).astype(np.uint32)
        body = _planes(self.doc[new]) + _planes(self.text[new]) + _planes(counts) + _planes(self.start.astype(np.uint32))
        body = zstandard.ZstdCompressor(level=1).compress(body)
        return np.array([len(self), len(new), len(body), self.tail.shape[1]], np.uint32).tobytes() + body + self.tail.tobytes()

    @classmethod
    def unpack(cls, blob: bytes) -> Marks:
        n, docs, size, width = map(int, np.frombuffer(blob, np.uint32, 4))
        body = zstandard.ZstdDecompressor().decompress(blob[16 : 16 + size])
        counts = _unplanes(body[16 * docs : 20 * docs], "<u4", docs)
        doc, text = (_unplanes(body[8 * k * docs : 8 * (k + 1) * docs], "<i8", docs) for k in (0, 1))
        tail = np.frombuffer(blob, np.uint8, n * width, 16 + size).reshape(n, width)
        return cls(np.repeat(doc, counts), np.repeat(text, counts), _unplanes(body[20 * docs :], "<u4", n).astype(np.int64), tail)

    def by_group(self, groups: int) -> Iterator[tuple[int, bytes]]:
        """One packed row for each group of documents."""
        g = np.mod(self.doc ^ salt(self.doc, self.text), groups)
        order = np.lexsort((self.start, self.text, self.doc, g))
        g = g[order]
        for s, e in zip(*cursors(g)):
            at = order[s:e]
            yield int(g[s]), self[at].pack()


def _equal(h: tuple[np.ndarray, ...], marks: Marks, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In an order by the hashes: the index of each one's first equal; which ones lie elsewhere than that."""
    new = np.zeros(len(order), bool)
    for x in h:
        x = x[order]
        new[1:] |= x[1:] != x[:-1]
    new[:1] = True
    starts = np.flatnonzero(new)
    first = np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    back = order[first]
    return first, (marks.doc[order] != marks.doc[back]) | (marks.text[order] != marks.text[back]) | (marks.start[order] != marks.start[back])


class _Sizes:
    """Buckets of hashes of each round and groups of documents. From 100 TB on a bucket grows beyond BUCKET_WINDOWS, to some hundred MB."""

    def __init__(self, docs: DataFrame):
        data = input_bytes(docs)
        self.buckets = power_of_two(data / 3 / BUCKET_WINDOWS, 64, 1 << 20)
        self.fewer = max(64, self.buckets // 8)
        self.groups = power_of_two(2 * data / GROUP_BYTES, 16, 1 << 24) + 1


#: Windows of a batch: one or two hashes for each, and their positions.
Hashed = tuple[tuple[np.ndarray, ...], Marks]


def _meet(hashed: Iterator[Hashed], sizes: _Sizes) -> Iterator[pd.DataFrame]:
    """Rows (bucket, blob) of a batch's windows, given in the order of their positions; what is known from the batch alone goes straight on as bucket -1 - group.

    With one hash, that are all windows that have an equal one, and 24 bits travel, with the salt for the text; with two,
    those that start later than an equal one, and 96 bits travel.
    """
    for h, marks in hashed:
        if not len(marks):
            continue
        # Stable, so that equal windows stay in the order of their positions.
        order = np.argsort(h[0], kind="stable") if len(h) == 1 else np.lexsort(h[::-1])
        first, known = _equal(h, marks, order)
        own = first == np.arange(len(order))
        low = (sizes.buckets if len(h) == 1 else sizes.fewer).bit_length() - 1
        if len(h) == 1:
            known = ~own
            known[first[~own]] = True
            marks.text = salt(marks.doc, marks.text)
        rows = [(-1 - g, b) for g, b in _bare([marks[np.sort(order[known])]]).by_group(sizes.groups)] if known.any() else []
        own = np.sort(order[own])
        bucket = (h[0][own] >> np.uint64(64 - low)).astype(np.uint16 if low <= 16 else np.int64)
        own = own[np.argsort(bucket, kind="stable")]
        h, marks = tuple(x[own] for x in h), marks[own]
        bucket = (h[0] >> np.uint64(64 - low)).astype(np.int64)
        if len(h) == 1:
            marks.tail = (h[0] << np.uint64(low)).view(np.uint8).reshape(-1, 8)[:, 5:]
        else:
            marks.tail = np.concatenate([h[0].view(np.uint8).reshape(-1, 8), h[1].view(np.uint8).reshape(-1, 8)[:, :4]], 1)
        rows += [(int(bucket[s]), marks[slice(s, e)].pack()) for s, e in zip(*cursors(bucket))]
        yield pd.DataFrame(rows, columns=["bucket", "blob"])


def _tail_numbers(tail: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash bytes as numbers: one for 3 bytes, two for 12."""
    wide = np.zeros((len(tail), 16), np.uint8)
    wide[:, : tail.shape[1]] = tail
    h = wide.view(np.uint64)
    return (h[:, 0],) if tail.shape[1] == 3 else (h[:, 0], h[:, 1])


def _repeated(met: DataFrame, sizes: _Sizes) -> DataFrame:
    """(bucket, blob) -> (g, blob): windows that have an equal one (24 bits), or start later than an equal one (96 bits).

    In the first round two rows of one document count as equal windows too; the second tells them apart.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[Marks] = []
        for pdf in grouped_batches(batches, ["bucket"]):
            key = pdf["bucket"].to_numpy()
            on = pdf[key < 0]
            if len(on):
                yield pd.DataFrame({"g": -1 - on["bucket"], "blob": on["blob"]})
            for s, e in zip(*cursors(key)):
                if key[s] < 0:
                    continue
                marks = Marks.joined([Marks.unpack(b) for b in pdf["blob"].iloc[s:e]])
                h = _tail_numbers(marks.tail)
                # The first round takes all of a run, in any order; the second needs the least position first.
                order = np.argsort(h[0]) if len(h) == 1 else np.lexsort((marks.start, marks.text, marks.doc, *h))
                first, later = _equal(h, marks, order)
                if len(h) == 1:
                    later = first != np.arange(len(order))
                    later[first[later]] = True
                held.append(marks[order[later]])
            if sum(map(len, held)) > 1_000_000:
                yield pd.DataFrame(list(_bare(held).by_group(sizes.groups)), columns=["g", "blob"])
                held = []
        if held:
            yield pd.DataFrame(list(_bare(held).by_group(sizes.groups)), columns=["g", "blob"])

    n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(n, "bucket").sortWithinPartitions("bucket").mapInPandas(run, "g int, blob binary")


def _bare(parts: list[Marks]) -> Marks:
    return Marks.joined([Marks(p.doc, p.text, p.start) for p in parts])


def _salt(doc: int, text: int) -> int:
    return text if doc == NO_ID else text & 15


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[list[Doc]]:
    """Different documents in lists of about BATCH_WORDS words, in order; a long document is a list of its own."""
    held: dict[tuple[int, int], list[bytes]] = {}
    words = 0
    for pdf in frames:
        for d, h, t in zip(pdf["doc_id"], pdf["th"], pdf["text"]):
            if (key := (int(d), int(h))) not in held:
                held[key] = plain_words(t)
                words += len(held[key])
            if words > BATCH_WORDS:
                yield [(*k, held[k]) for k in sorted(held)]
                held, words = {}, 0
    if held:
        yield [(*k, held[k]) for k in sorted(held)]


def _marks_of(docs: list[tuple[int, int, np.ndarray]]) -> Marks:
    """Positions of documents, given as (doc, text, starts)."""
    sizes = [len(p) for _, _, p in docs]
    return Marks(np.repeat(np.array([d for d, _, _ in docs], np.int64), sizes), np.repeat(np.array([t for _, t, _ in docs], np.int64), sizes), np.concatenate([_EMPTY, *(p for _, _, p in docs)]))


def _windows(frames: Iterator[pd.DataFrame], width: int) -> Iterator[Hashed]:
    hasher = WordHasher(200_000)
    for docs in _batches(frames):
        long = [(d, t, rolling(hasher(w), width)) for d, t, w in docs if len(w) >= width]
        if long:
            yield (np.concatenate([h for _, _, h in long]),), _marks_of([(d, t, np.arange(len(h))) for d, t, h in long])


def _grouped(docs: DataFrame, groups: int) -> DataFrame:
    """With the group of each document: doc_id xor salt, so that neither one text nor one doc_id is a group."""
    salt = F.when(F.col("doc_id") == NO_ID, F.col("th")).otherwise(F.col("th").bitwiseAND(F.lit(15)))
    g = F.pmod(F.col("doc_id").bitwiseXOR(salt), F.lit(groups)).cast("int")
    return docs.select(g.alias("g"), "doc_id", "none", "th", "text")


def _look_up(blobs: pd.Series) -> Callable[[int, int], np.ndarray]:
    """Positions of each document of a group; a byte beside a position says how many follow it."""
    if not len(blobs):
        return lambda d, t: _EMPTY
    marks = Marks.joined([Marks.unpack(b) for b in blobs])
    if marks.tail.shape[1] == 1:
        size = marks.tail[:, 0].astype(np.int64) + 1
        ahead = np.arange(int(size.sum())) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)
        marks = Marks(np.repeat(marks.doc, size), np.repeat(marks.text, size), np.repeat(marks.start, size) + ahead)
    order = np.lexsort((marks.text, marks.doc))
    marks = marks[order]
    starts = np.flatnonzero(np.r_[True, (marks.doc[1:] != marks.doc[:-1]) | (marks.text[1:] != marks.text[:-1])])
    ends = np.r_[starts[1:], len(marks)]
    at = {(int(marks.doc[s]), int(marks.text[s])): (s, e) for s, e in zip(starts, ends)}
    return lambda d, t: marks.start[slice(*at.get((d, t), (0, 0)))]


def _decided(grouped: DataFrame, candidates: DataFrame, sizes: _Sizes, width: int) -> DataFrame:
    """(g, blob) of the windows, among the candidates (by salt), that start later than an equal one by 96 bits."""

    def exact(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        at, hasher, seen = _look_up(right["blob"]), WordHasher(), set()
        docs, hashes = [], ([np.empty(0, np.uint64)], [np.empty(0, np.uint64)])
        for *key, text in sorted(zip(left["doc_id"], left["th"], left["text"]), key=lambda x: x[:2]):
            key = (int(key[0]), int(key[1]))
            marked = at(key[0], _salt(*key))
            if len(marked) and key not in seen:
                seen.add(key)
                h = hasher(plain_words(text))
                starts = np.unique(marked)
                starts = starts[(starts >= 0) & (starts <= len(h) - width)]
                docs.append((*key, starts))
                for k, base in enumerate(BASES):
                    hashes[k].append(rolling(h, width, base)[starts])
        frames = _meet(iter([(tuple(map(np.concatenate, hashes)), _marks_of(docs))]), sizes)
        return next(frames, pd.DataFrame({"bucket": pd.Series(dtype=np.int32), "blob": pd.Series(dtype=object)}))

    return _repeated(grouped.groupBy("g").cogroup(candidates.groupBy("g")).applyInPandas(exact, "bucket int, blob binary"), sizes)


def _stripped(docs: DataFrame, marks: DataFrame, width: int) -> DataFrame:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        at, rows = _look_up(right["blob"]), []
        for d, none, th, t in zip(left["doc_id"], left["none"], left["th"], left["text"]):
            words = plain_words(t)
            n, starts = len(words), at(int(d), int(th))
            steps = np.zeros(n + 1, np.int64)
            np.add.at(steps, starts, 1)
            np.add.at(steps, starts + width, -1)
            gone = np.cumsum(steps[:n]) > 0
            edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            kept = b" ".join(itertools.compress(words, ~gone)) if len(edge) else b" ".join(words)
            rows.append((d, none, n, int(gone.sum()), kept.decode("utf-8", "replace"), edge[::2].tolist(), edge[1::2].tolist()))
        return pd.DataFrame(rows, columns=["doc_id", "none", "n_words", "n_removed", "kept", "starts", "ends"])

    schema = "doc_id long, none boolean, n_words long, n_removed long, kept string, starts array<long>, ends array<long>"
    out = docs.groupBy("g").cogroup(marks.groupBy("g")).applyInPandas(run, schema)
    return out.withColumn("doc_id", F.when(~F.col("none"), F.col("doc_id"))).drop("none")


def _documents(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, none, th, text): a null id is NO_ID, as a long beside a null would lose its last digits on the way through pandas."""
    if not isinstance(docs.schema[doc_id].dataType, IntegralType):
        raise TypeError(f"{doc_id} has to be a whole number, by which documents are ordered")
    body, key = F.col(f"`{text}`"), F.col(f"`{doc_id}`").cast("long")
    return docs.select(F.coalesce(key, F.lit(NO_ID)).alias("doc_id"), key.isNull().alias("none"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("th"), body.alias("text"))


def strip_repeated_windows(docs: DataFrame, width: int = 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Remove each word covered by a window of ``width`` words that also starts earlier in the corpus.

    Earlier means a smaller doc_id, or the same document and an earlier start; windows are judged on the input.
    Returns doc_id, n_words, n_removed, kept (the other words joined by one space) and the maximal removed
    intervals [starts[i], ends[i]) in words. All windows of all whole texts are hashed (Rabin-Karp modulo 2**64) and
    counted. Null or empty texts have no words and keep the empty text; texts shorter than a window stay
    whole. Rows that repeat a doc_id and its text are one document, each returned, none of them the earlier one; of rows
    that repeat a doc_id with other texts, the one with the lower xxhash64 of its text is the earlier; a null
    doc_id counts as the smallest. Ids are whole numbers; another type is a TypeError. An empty table gives an empty result; other columns
    are not read.
    """
    sizes, plain = _Sizes(docs), _documents(docs, text, doc_id)
    met = plain.mapInPandas(lambda it: _meet(_windows(it, width), sizes), "bucket int, blob binary")
    grouped = _grouped(plain, sizes.groups)
    return _stripped(grouped, _decided(grouped, _repeated(met, sizes), sizes, width), width)


def minimisers(h: np.ndarray, span: int) -> np.ndarray:
    """Positions of the least value (the leftmost, if several) of every ``span`` neighbouring values."""
    if len(h) < span:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, span)
    return np.unique(np.arange(len(view)) + view.argmin(1))


def _suffixes(frames: Iterator[pd.DataFrame], width: int, prefix: int) -> Iterator[Hashed]:
    """Suffixes at minimiser positions, by the hash of their first ``prefix`` words."""
    hasher = WordHasher(200_000)
    for docs in _batches(frames):
        found = []
        for d, t, w in docs:
            if len(w) >= width:
                h = rolling(hasher(w), prefix)
                p = minimisers(mix64(h), width - prefix + 1)
                found.append((d, t, p, h[p]))
        if found:
            yield (np.concatenate([h for *_, h in found]),), _marks_of([(d, t, p) for d, t, p, _ in found])


#: Word codes: the order of their bytes is that of the numbers.
CODE = ">u2"


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading words rows of a and b (codes[n, words]) have in common; 0 stands for no word."""
    same = (a == b) & (a != 0)
    return np.where(same.all(1), a.shape[1], same.argmin(1))


def _neighbours(sorted_rows: DataFrame, side: str, words: int) -> DataFrame:
    """(doc, th, start, side binary), sorted by ``side`` in each partition -> (doc, th, start, n): the words in common with a neighbour.

    The first and the last row of a partition have neighbours elsewhere; they count as agreeing in all words.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, kept = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.frombuffer(b"".join(pdf[side]), CODE).reshape(len(pdf), words)
            out = pdf[["doc", "th", "start"]].assign(n=np.int32(0))
            n = np.zeros(len(pdf), np.int32)
            inside = _agreeing(x[1:], x[:-1])
            n[1:] = inside
            n[:-1] = np.maximum(n[:-1], inside)
            over = words if before is None else int(_agreeing(x[:1], before)[0])
            n[0] = max(n[0], over)
            if kept is not None:
                kept.loc[kept.index[-1], "n"] = max(int(kept["n"].iloc[-1]), over)
                yield kept
            kept, before = out.assign(n=n), x[-1:]
        if kept is not None:
            kept.loc[kept.index[-1], "n"] = words
            yield kept

    return sorted_rows.mapInPandas(run, "doc long, th long, start int, n int")


def strip_repeated_passages(docs: DataFrame, min_words: int = 50, prefix: int = 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Remove passages of ``min_words`` words or more that also start earlier, found by sparse suffix arrays.

    1. Of every whole text only the suffixes at minimiser positions are retained: the least hash of ``prefix``
       words among every min_words - prefix + 1 neighbouring positions, so that each passage of min_words words
       retains a suffix, the same one wherever it stands. Suffixes whose first ``prefix`` words begin no other go.
    2. The others are sorted in Spark by their words (as 15-bit codes, which order words like any other rule),
       dealt by ranges, and compared with their neighbours: the largest number of words that one has in
       common with any other, to the right, is that with a neighbour. The same is done to the left, with the words before
       the suffixes in reverse. Suffixes that agree in fewer than min_words words to both sides together go.
    3. The rest is extended left and right as far as it agrees; what starts earlier is decided by 96 bits of each
       stretch of min_words words in these extents.

    The result is that of removing every word covered by a window of min_words words that starts earlier. Codes that
    agree by chance and neighbours in another partition only keep more for step 3. Columns and the treatment of nulls, empty
    texts and repeated rows are those of ``strip_repeated_windows``.
    """
    sizes, plain = _Sizes(docs), _documents(docs, text, doc_id)
    if min_words - prefix > 255:
        raise ValueError("a passage is at most 255 words longer than the beginnings by which suffixes are sorted")
    retained = plain.mapInPandas(lambda it: _meet(_suffixes(it, min_words, prefix), sizes), "bucket int, blob binary")
    grouped, back = _grouped(plain, sizes.groups), min_words - prefix

    def sides(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        at, hasher, out, seen = _look_up(right["blob"]), WordHasher(), [], set()
        for d, t, text in zip(left["doc_id"], left["th"], left["text"]):
            key = (int(d), int(t))
            words = hasher(plain_words(text))
            p = np.unique(at(key[0], _salt(*key)))
            p = p[p + prefix <= len(words)]
            if not len(p) or key in seen:
                continue
            seen.add(key)
            codes = np.r_[np.zeros(back, np.uint64), words >> np.uint64(48) | np.uint64(1), np.zeros(min_words, np.uint64)].astype(CODE)
            ahead, behind = codes[p[:, None] + back + np.arange(min_words)], codes[p[:, None] + back - 1 - np.arange(back)]
            out.append(pd.DataFrame({"doc": key[0], "th": key[1], "start": p, "ahead": [x.tobytes() for x in ahead], "behind": [x.tobytes() for x in behind]}))
        empty = {"doc": _EMPTY, "th": _EMPTY, "start": _EMPTY, "ahead": [], "behind": []}
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(empty)

    anchors = _repeated(retained, sizes)
    suffixes = cut(grouped.groupBy("g").cogroup(anchors.groupBy("g")).applyInPandas(sides, "doc long, th long, start int, ahead binary, behind binary"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    agreed = {}
    for side, words in (("ahead", min_words), ("behind", back)):
        # The position breaks ties, so that a passage in very many documents is dealt over several ranges.
        order = [side, "th", "doc", "start"]
        ranked = suffixes.select("doc", "th", "start", side).repartitionByRange(n, *order).sortWithinPartitions(*order)
        agreed[side] = _neighbours(ranked, side, words).withColumnRenamed("n", side)
    both = agreed["ahead"].join(agreed["behind"], ["doc", "th", "start"]).where(F.col("ahead") + F.col("behind") >= min_words)
    kept = cut(both)

    def extents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """First starts of the stretches of min_words words that hold a kept suffix and lie in its extent, and how many follow."""
        held: list[Marks] = []
        for pdf in (*batches, None):
            if pdf is not None:
                doc, th, p, ahead, behind = (pdf[c].to_numpy(np.int64) for c in ("doc", "th", "start", "ahead", "behind"))
                first, last = np.maximum(p - np.minimum(behind, back), 0), np.minimum(p + ahead - min_words, p)
                ok = last >= first
                held.append(Marks(doc[ok], salt(doc, th)[ok], first[ok], (last - first)[ok].astype(np.uint8).reshape(-1, 1)))
            if held and (pdf is None or sum(map(len, held)) > 2_000_000):
                yield pd.DataFrame(list(Marks.joined(held).by_group(sizes.groups)), columns=["g", "blob"])
                held = []

    stretches = kept.select("doc", "th", "start", "ahead", "behind").mapInPandas(extents, "g int, blob binary")
    forget(suffixes)
    # One job, so that the texts are shuffled once for both.
    return _stripped(grouped, _decided(grouped, stretches, sizes, min_words), min_words)
