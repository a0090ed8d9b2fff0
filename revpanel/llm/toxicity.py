"""Toxicity by a factorization machine over hashed terms.

Terms are words and their beginnings of 4 to 7 characters, each at three levels (present, at least twice, at least
four times), hashed to 3 * 2**18 slots. The machine learns a weight for each kept slot and, through factor vectors, one for
each pair of slots, so that two terms that are harmless alone can count together. Slots are kept for what they say about the
label alone or in a pair with another one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revpanel.llm.common import alnum_words, mapped

SLOTS, LEVELS, PREFIXES = 1 << 18, (1, 2, 4), (4, 5, 6, 7)
#: Most frequent slots whose pairs are looked at, pairs whose slots are kept, and the chi-square that they need: a chance of
#: one in a billion for each of 130,000 pairs.
PAIRED, PAIRS, PAIR_LEAST = 512, 128, 37.0


def _slots(word: bytes) -> list[int]:
    text = word.decode("utf-8", "replace")
    terms = [b"w" + word, *(b"p%d" % k + text[:k].encode("utf-8", "replace") for k in PREFIXES if len(text) >= k)]
    return [xxhash.xxh64_intdigest(t) % SLOTS for t in terms]


class _Terms:
    """Slots of a text; with ``kept``, only those slots, and words without any cost one look-up."""

    def __init__(self, kept: set[int] | None = None, limit: int = 100_000):
        self.kept, self.limit, self.cache = kept, limit, {}

    def sums(self, text: str | None) -> Counter[int]:
        """How often each hashed term occurs."""
        if len(self.cache) > self.limit:
            self.cache.clear()
        sums: Counter[int] = Counter()
        for w, n in Counter(alnum_words(text.lower() if text else None)).items():
            got = self.cache.get(w)
            if got is None:
                got = self.cache[w] = tuple(s for s in _slots(w) if self.kept is None or s in self.kept)
            for s in got:
                sums[s] += n
        return sums

    def __call__(self, text: str | None) -> np.ndarray:
        return np.array([s * len(LEVELS) + i for s, n in self.sums(text).items() for i, least in enumerate(LEVELS) if n >= least], np.int32)


def _chi_square(seen: np.ndarray, hit: np.ndarray, positives: float, negatives: float) -> np.ndarray:
    share, rest = (hit + 0.5) / (positives + 1), (seen - hit + 0.5) / (negatives + 1)
    pooled = (seen + 1) / (positives + negatives + 2)
    return (share - rest) ** 2 / np.maximum(pooled * (1 - pooled), 1e-12) * positives * negatives / (positives + negatives)


def _paired(rows: list[np.ndarray], labels: np.ndarray, seen: np.ndarray, positives: float, negatives: float) -> np.ndarray:
    """Slots of the pairs whose presence together says most about the label, of the PAIRED most frequent slots.

    Slots that nearly all texts have say nothing, and rare ones have no pairs to count.
    """
    n = len(rows)
    frequent = np.flatnonzero((seen >= max(20, n // 200)) & (seen <= 0.7 * n))
    frequent = np.sort(frequent[np.argsort(-seen[frequent], kind="stable")[:PAIRED]])
    if len(frequent) < 2:
        return np.empty(0, np.int64)
    x = np.zeros((n, len(frequent)), np.float32)
    for i, r in enumerate(rows):
        x[i] = np.isin(frequent, r)
    y = labels > 0
    both, hit = x.T @ x, x[y].T @ x[y]
    chi = _chi_square(both, hit, positives, negatives)
    # A pair that says no more than one of its slots alone needs no pair, and levels or beginnings of one word are none.
    alone = np.diag(chi)
    single = np.maximum(alone[:, None], alone[None, :])
    spread = np.minimum(np.diag(both)[:, None], np.diag(both)[None, :])
    chi = np.where((both >= 10) & (both < 0.8 * spread) & (chi > 2 * single), chi, 0)
    i, j = np.triu_indices(len(frequent), 1)
    best = np.argsort(-chi[i, j], kind="stable")[:PAIRS]
    best = best[chi[i, j][best] > PAIR_LEAST]
    return frequent[np.union1d(i[best], j[best])]


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum w_i + sum_{i<j} <v_i, v_j>) over the slots present in a text."""

    slots: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    @classmethod
    def fit(cls, rows: list[np.ndarray], labels: np.ndarray, keep: int = 1024, least: float = 10.8, factors: int = 8, epochs: int = 300, rate: float = 0.03, decay: float = 2e-4, seed: int = 5) -> FactorizationMachine:
        """Adam on the logistic loss, over the ``keep`` slots most associated with the label and those of ``_paired``.

        Slots whose chi-square with the label is under ``least`` (10.8: one in a thousand by chance) are left out. Without
        ``factors`` the machine is a linear model.
        """
        n, size = len(rows), SLOTS * len(LEVELS)
        seen, hit = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for r, y in zip(rows, labels):
            seen[r] += 1
            if y:
                hit[r] += 1
        positives = max(float(labels.sum()), 1.0)
        negatives = max(n - positives, 1.0)
        score = _chi_square(seen, hit, positives, negatives) * (seen >= 3)
        slots = np.argsort(-score, kind="stable")[:keep]
        slots = np.union1d(slots[score[slots] > least], _paired(rows, labels, seen, positives, negatives))
        x = np.zeros((n, len(slots)), np.float32)
        for i, r in enumerate(rows):
            x[i] = np.isin(slots, r)
        rng = np.random.default_rng(seed)
        base = np.log(positives / negatives)
        p = [np.array([base], np.float32), np.zeros(len(slots), np.float32), rng.normal(0, 0.02, (len(slots), factors)).astype(np.float32)]
        first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for t in range(1, epochs + 1 if n else 1):
            s = x @ p[2]
            z = p[0][0] + x @ p[1] + 0.5 * ((s**2).sum(1) - x @ (p[2] ** 2).sum(1))
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels).astype(np.float32) / n
            g = [np.array([d.sum()], np.float32), x.T @ d + decay / 10 * p[1], x.T @ (d[:, None] * s) - (x.T @ d)[:, None] * p[2] + decay * p[2]]
            for k in range(3):
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        return cls(slots, float(p[0][0]), p[1].astype(np.float64), p[2].astype(np.float64))

    def score(self, slots: np.ndarray) -> float:
        at = np.searchsorted(self.slots, slots)
        at = at[at < len(self.slots)]
        at = at[np.isin(self.slots[at], slots)]
        at = np.unique(at)
        v = self.factors[at]
        z = self.bias + self.weights[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


class Scorer:
    """Scores of texts, a batch at a time; a text's score does not depend on its batch."""

    def __init__(self, model: FactorizationMachine):
        self.model, self.index = model, {int(s): i for i, s in enumerate(model.slots)}
        self.terms = _Terms({s // len(LEVELS) for s in self.index})

    def __call__(self, texts: Iterable[str | None]) -> np.ndarray:
        texts = list(texts)
        # In small parts, so that the factors of all terms of a part take little memory.
        return np.concatenate([np.empty(0), *(self._part(texts[i : i + 256]) for i in range(0, len(texts), 256))])

    def _part(self, texts: list[str | None]) -> np.ndarray:
        fm, at, ends = self.model, [], []
        for t in texts:
            own = (self.index.get(s * len(LEVELS) + i) for s, n in self.terms.sums(t).items() for i, least in enumerate(LEVELS) if n >= least)
            at += sorted(i for i in own if i is not None)
            ends.append(len(at))
        at, ends = np.array(at, np.int64), np.array(ends, np.int64)
        starts, v = np.r_[0, ends[:-1]], fm.factors[at]
        some, k = ends > starts, v.shape[1]
        z, pairs = np.full(len(ends), fm.bias), np.zeros((len(ends), 2 * k))
        if some.any():
            z[some] += np.add.reduceat(fm.weights[at], starts[some])
            pairs[some] = np.add.reduceat(np.concatenate([v, v * v], 1), starts[some])
        z += 0.5 * ((pairs[:, :k] ** 2).sum(1) - pairs[:, k:].sum(1))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether the labels of a document are never read; those of a null doc_id are not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", factors: int = 8) -> FactorizationMachine:
    """Fit on about ``max_rows`` labelled documents at most, taken by a hash of their id; held-out ids are never read.

    The bound keeps what reaches the driver the same at every input size. Null labels are left out; of
    several labels of one document the largest counts, of several texts of one id the one with the least xxhash64.
    """
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    n = known.count()
    share = min(1.0, 0.95 * max_rows / max(n, 1))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # A row for each id, however often the documents repeat it.
    known = plain.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = _Terms()
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"y": pdf["y"] > 0, "x": [np.sort(terms(t)).tobytes() for t in pdf["text"]]})

    # sample has at most about max_rows rows; texts become slots where they are
    rows = known.select("y", "text").mapInPandas(slots, "y boolean, x binary").toArrow()
    pairs = sorted(zip(rows["y"].to_pylist(), rows["x"].to_pylist()))
    return FactorizationMachine.fit([np.frombuffer(x, np.int32) for _, x in pairs], np.array([y for y, _ in pairs], np.float64), factors=factors)


def toxicity_scores(docs: DataFrame, model: FactorizationMachine, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score double): the score of every whole text; null and empty texts have no terms and get the bias's."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = Scorer(shared.value)
        return lambda texts: [scorer(texts.to_pylist())]

    return mapped(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t")), ["t"], "score double", start)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose score is under the threshold, with all their columns; null and empty texts are scored like any other."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, text=text))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for s in range(0, len(batch), 512):
                part = batch.slice(s, 512)
                yield part.filter(pa.array(scorer(part.column(at).to_pylist()) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
