"""Best-fit packing of documents into sequences by a configuration linear program.

A configuration is a set of lengths that fits into one sequence. Pieces of documents matter only by their lengths, of which
there are no more than a sequence has tokens, so the program is over their histogram, whatever the number of documents: use as few
configurations as cover all pieces. It is solved by multiplicative weights: each length has a price, which falls as
configurations cover it; a knapsack dynamic program finds the configurations of the highest prices, which are then used more.
The fractional numbers are rounded down, and what remains is packed by best fit, the longest first.

Which piece of a length goes where is decided by its number among those of its length, so that neither the pieces nor
their texts ever come together in one place.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from revpanel.llm.common import cut, mapped

#: How a byte-level tokenizer's pre-tokenizer cuts text, and runs that it might leave in one piece of that many characters.
_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONG = re.compile(r"\S{2000}|\s{2000}")
#: Texts of a batch.
TEXTS = 256


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin ones as they are, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class TokenIds:
    """Ids of whole texts as little-endian 32-bit numbers, those of the byte-level tokenizer of a file.

    Where the file's merges stand in the order of their ids and it cuts text in the usual way, its vocabulary is read as ranks, by
    which a text takes a fourth of the time; all other files, and texts with very long runs without a cut, go through the tokenizer
    itself. The ids are the same. Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.ranks = self._ranks(path)

    @staticmethod
    def _ranks(path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, cuts = file["model"], file.get("pre_tokenizer") or {}
        usual = cuts.get("type") == "ByteLevel" and not cuts.get("add_prefix_space") and cuts.get("use_regex", True) and file.get("normalizer") is None and file.get("post_processor") is None
        odd = model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges")
        if not usual or odd or model.get("type") != "BPE":
            return None
        special, alphabet = {t["content"] for t in file.get("added_tokens", [])}, _byte_alphabet()
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ids = [model["vocab"][m] for m in merges]
        tokens = {t: i for t, i in model["vocab"].items() if t not in special}
        if ids != sorted(set(ids)) or not set(tokens) <= {*alphabet, *merges} or max((tokens[c] for c in alphabet if c in tokens), default=0) > ids[0]:
            return None
        ranks = {bytes(alphabet[c] for c in t): i for t, i in tokens.items()}
        return tiktoken.Encoding("file", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        for t in texts:
            if not t:
                yield b""
            elif self.ranks is None or _LONG.search(t):
                yield np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                yield np.array(self.ranks.encode_ordinary(t), "<u4").tobytes()


@dataclass
class Program:
    """Configurations {length: how often} with fractional numbers of use, and a lower bound of the number of sequences."""

    configurations: list[dict[int, int]]
    use: np.ndarray
    bound: float


def _knapsack(prices: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: the highest sum of prices of lengths (repeats allowed) that sum to c or less; the length taken last, 0 for none."""
    best, last = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    for c in range(1, size + 1):
        through = prices[1 : c + 1] + best[c - 1 :: -1]
        i = int(through.argmax())
        best[c], last[c] = best[c - 1], 0
        if through[i] > best[c]:
            best[c], last[c] = through[i], i + 1
    return best, last


def _configuration(first: int, last: np.ndarray, size: int) -> dict[int, int]:
    """The best configuration with one ``first``."""
    own, room = Counter([first]), size - first
    while room > 0:
        if last[room]:
            own[int(last[room])] += 1
        room -= max(1, int(last[room]))
    return dict(own)


def configuration_program(counts: np.ndarray, size: int, rounds: int = 250, rate: float = 0.03, slack: float = 0.03) -> Program:
    """Cover ``counts[l]`` pieces of each length l by configurations of ``size``, as few as can be.

    Multiplicative weights: the price of a length is its share of a sequence, times exp(-``rate``) for each time that its pieces
    are covered more often than those of all lengths on average. In a round one dynamic program prices all configurations; of each length
    the best one through it is used if it is within ``slack`` of the best of all, by as much as covers no length more than
    once in the round. Numbers of use are those of one cover of the average length. Prices over the best configuration's are a
    solution of the dual program and give the bound.
    """
    lengths = np.flatnonzero(counts)
    base, n = np.arange(len(counts)) / size, np.maximum(counts, 1).astype(np.float64)
    bound, cover = float((counts * base).sum()), np.zeros(len(counts))
    known: dict[tuple, int] = {}
    configurations: list[dict[int, int]] = []
    use: list[float] = []
    for _ in range(rounds if len(lengths) else 0):
        ahead = cover - cover[lengths].mean()
        prices = np.where(counts > 0, base * np.exp(-rate * np.clip(ahead, -60 / rate, 60 / rate)), 0.0)
        best, last = _knapsack(prices, size)
        bound = max(bound, float((counts * prices).sum() / best[size]))
        worth = prices[lengths] + best[size - lengths]
        near, moved = worth >= (1 - slack) * best[size], np.zeros(len(counts))
        for length in lengths[near][np.argsort(-worth[near], kind="stable")]:
            if moved[length] >= 1:
                continue
            own = _configuration(int(length), last, size)
            step = min((1 - moved[x]) * n[x] / a for x, a in own.items())
            if step <= 1e-9:
                continue
            at = known.setdefault(tuple(sorted(own.items())), len(configurations))
            if at == len(configurations):
                configurations.append(own)
                use.append(0.0)
            use[at] += step
            for x, a in own.items():
                moved[x] += step * a / n[x]
        cover += moved
    return Program(configurations, np.array(use) / max(cover[lengths].mean(), 1e-9) if use else np.zeros(0), bound)


def best_fit(counts: np.ndarray, size: int) -> list[tuple[dict[int, int], int]]:
    """(configuration, number of sequences): pieces go, the longest first, to the sequence with the least room that holds them.

    Sequences of equal content are handled together, so that the work depends on the different lengths.
    """
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    for length in range(size, 0, -1):
        left = int(counts[length])
        while left:
            room = min((r for r, groups in open_.items() if r >= length and groups), default=size)
            own, n = open_[room].pop() if open_.get(room) else ({}, left)
            per = min(room // length, left)
            now = min(n, left // per)
            if own and n > now:
                open_[room].append((own, n - now))
            open_.setdefault(room - per * length, []).append(({**own, length: per}, now))
            left -= per * now
    return [g for groups in open_.values() for g in groups]


def _rounded(counts: np.ndarray, program: Program, share: float, size: int) -> list[tuple[dict[int, int], int]]:
    """``share`` of the program's numbers rounded down, as far as there are pieces; the rest by best fit."""
    left, out = counts.copy(), []
    for i in np.argsort(-program.use, kind="stable"):
        own = program.configurations[i]
        n = min(int(program.use[i] * share + 1e-9), *(int(left[x]) // a for x, a in own.items()))
        if n > 0:
            out.append((own, n))
            for x, a in own.items():
                left[x] -= n * a
    return out + best_fit(left, size)


@dataclass
class Plan:
    """Where the pieces of each length go: those from number ``low`` on fill sequences from ``sequence`` on, ``per`` in each, from ``offset`` on."""

    length: np.ndarray
    low: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    per: np.ndarray
    sequences: int
    bound: float

    @classmethod
    def of(cls, counts: np.ndarray, size: int) -> Plan:
        """By the best of several roundings of the configuration program; the last one rounds everything down to nothing."""
        whole, rest = int(counts[size]), counts.copy()
        rest[size] = 0
        program = configuration_program(rest, size)
        found = min((_rounded(rest, program, share, size) for share in (1.0, 0.97, 0.9, 0.75, 0.5, 0.0)), key=lambda x: sum(n for _, n in x))
        rows, at, used = [], 0, np.zeros(size + 1, np.int64)
        for own, n in [({size: 1}, whole)] * (whole > 0) + found:
            offset = 0
            for length in sorted(own, reverse=True):
                rows.append((length, int(used[length]), at, offset, own[length]))
                used[length] += n * own[length]
                offset += own[length] * length
            at += n
        rows.sort()
        columns = np.array(rows, np.int64).reshape(len(rows), 5).T
        return cls(*columns, at, whole + program.bound)

    def __call__(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence and the offset of the pieces with these numbers among those of their lengths."""
        at = np.searchsorted((self.length << 48) + self.low, (length << 48) + number, side="right") - 1
        i = number - self.low[at]
        return self.sequence[at] + i // self.per[at], self.offset[at] + i % self.per[at] * length


def cut_pieces(docs: DataFrame, tokenizer: str, size: int = 1024, end: int = 2, ids: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, ids (binary, with ``ids``), and task and number, by which pieces of a length differ."""
    last = np.array([end], "<u4").tobytes()
    made = StructType.fromDDL("piece int, start long, length int, ids_crc32 long, task int, number long" + (", ids binary" if ids else ""))
    schema = StructType([*docs.select(F.col(f"`{doc_id}`").alias("doc_id")).schema, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, used = TokenIds(tokenizer), TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part, rows, of = batch.slice(at, TEXTS), [], []
                for i, b in enumerate(encode(part.column(1).to_pylist())):
                    b += last
                    n = len(b) // 4
                    first = n if n <= size else n % size or size
                    for k, e in enumerate(range(first, n + 1, size)):
                        s = max(0, e - size) if k else 0
                        own = b[4 * s : 4 * e]
                        rows.append((k, s, e - s, zlib.crc32(own), task, used[e - s], own))
                        of.append(i)
                        used[e - s] += 1
                columns = list(zip(*rows))[: len(made)]
                arrays = [part.column(0).take(pa.array(of, pa.int64()))]
                types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(c, t) for c, t in zip(columns, types)], schema.names)

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 1024, end: int = 2, ids: bool = False, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, Plan]:
    """doc_id, piece (from 0), start, length, ids_crc32, sequence_id, offset, and with ``ids`` the piece's token ids; and the plan.

    A document is the ids of its whole text by the tokenizer at the path ``tokenizer``, and ``end``; a null or empty text is
    ``end`` alone. Documents of over ``size`` tokens are cut into pieces of ``size``, of which the first may be shorter; no
    other is cut. Sequences hold at most ``size`` tokens and are gapless from offset 0; ``plan.bound`` is a lower bound of
    their number. Rows that repeat an id or a text are packed each by itself, as are null ids; an empty table gives no rows and no
    sequences. Other columns are not read. ``ids`` are little-endian 32-bit numbers.

    The histogram of lengths is all that comes to the driver, and what goes out is a row for each length of each
    configuration, both bounded by ``size`` and the program's rounds.
    """
    pieces = cut(cut_pieces(docs, tokenizer, size, end, ids, text, doc_id))
    groups = cut(pieces.groupBy("length", "task").agg(F.count("*").alias("n")))
    counts = np.zeros(size + 1, np.int64)
    for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    plan = Plan.of(counts, size)
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    # Each task numbered its own pieces of a length; those of the tasks before it come first.
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = groups.select("length", "task", F.coalesce(before, F.lit(0)).alias("base"))
    numbered = pieces.join(bases, ["length", "task"]).withColumn("number", F.col("number") + F.col("base")).drop("task", "base")

    def start():
        plan = shared.value
        return lambda length, number: [length, *plan(length.to_numpy().astype(np.int64), number.to_numpy())]

    placed = mapped(numbered, ["length", "number"], "length int, sequence_id long, offset long", start, 16_384)
    columns = ["doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"]
    return placed.select(*columns, *(["ids"] if ids else [])), plan


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids array<int>, doc_ids array, starts array<int>): the packed sequences themselves, from rows with ``ids``.

    A sequence is one group of at most ``size`` tokens; ``starts`` are the offsets of its pieces, in the order of ``doc_ids``.
    """
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("pieces")
    rows = packed.groupBy("sequence_id").agg(own)
    joined = rows.select("sequence_id", F.aggregate("pieces.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("joined"), F.col("pieces.doc_id").alias("doc_ids"), F.col("pieces.offset").cast("array<int>").alias("starts"))
    return mapped(joined, ["joined"], "ids array<int>", lambda: lambda x: [[np.frombuffer(b, "<i4") for b in x.to_pylist()]]).select("sequence_id", "ids", "doc_ids", "starts")
