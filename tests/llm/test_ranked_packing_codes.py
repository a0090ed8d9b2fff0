"""Ranked search, packing and vector codes against brute force, with the awkward cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_llm import corpus, lower, table
from tokenizers import Tokenizer

from revpanel.llm import codes, packing, queries, ranked

BIG = (1 << 60) + 1
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# Ranked search


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))


def brute_ranked(docs, items, k):
    """[(item_id, rank, doc_id, score)] by the definition, in Python's whole numbers."""
    own = [(d, terms(t)) for d, t in docs]
    own = [(d, w) for d, w in own if w]
    n_docs, total = len(own), sum(len(w) for _, w in own)
    df = Counter(t for _, w in own for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for d, w in own:
            tf, m = Counter(w), 25 + 75 * len(w) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms(text) if tf[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def items_table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "item_id long, text string, doc_id string, rid int, rank int")


@pytest.mark.parametrize("block, held, query_bytes", [(4096, 64, 4 << 20), (16, 3, 300)])
def test_ranked_search(spark, monkeypatch, block, held, query_bytes):
    """All scores and ties, over blocks that are cut anywhere, with ids beyond 2**53 beside a null."""
    monkeypatch.setattr(ranked, "BLOCK", block)
    monkeypatch.setattr(ranked, "HELD", held)
    monkeypatch.setattr(ranked, "QUERY_BYTES", query_bytes)
    rows = [(None if d is None else d + BIG, t) for d, t in corpus(4)]
    texts = [t for _, t in rows if t]
    items = [(BIG, texts[0]), (BIG + 2, "w1 w2 W3 w1 w1 nowhere"), (None, texts[3][:200]), (5, None), (6, ""), (7, "--"), (8, "ha"), (9, "nowhere"), (10, "ünï w7 " * 70), (10, "w5")]
    got = ranked.ranked_search(table(spark, rows), items_table(spark, items), 4)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_ranked(rows, items, 4)


def test_ranked_search_of_empty_tables(spark):
    docs, items = table(spark, corpus()).limit(0), items_table(spark, [(1, "w1 w2")])
    assert ranked.ranked_search(docs, items).collect() == []
    assert ranked.ranked_search(table(spark, corpus()), items.limit(0)).collect() == []
    assert ranked.ranked_search(table(spark, [(1, None), (2, "")]), items).collect() == []


def test_ranked_search_by_text_ids(spark):
    docs = spark.createDataFrame([("b", "w1"), ("a", "w1"), (None, "w1"), ("c", "w2")], "doc_id string, text string")
    got = ranked.ranked_search(docs, items_table(spark, [(1, "w1")]), 2).collect()
    assert [(r["rank"], r["doc_id"]) for r in got] == [(1, "a"), (2, "b")]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.lists(st.lists(st.integers(0, 2**20), min_size=1, max_size=150), min_size=1, max_size=5), st.integers(1, 12))
def test_slices_add_and_find_the_highest(seed, numbers, k):
    """Carry arithmetic over slices is addition, and the descent finds what sorting finds."""
    width, n = 3, 150
    own = np.zeros((len(numbers), n), np.int64)
    for i, row in enumerate(numbers):
        own[i, : len(row)] = row

    def sliced(x):
        padded = np.zeros((len(x), 64 * width), np.int64)
        padded[:, :n] = x
        return [np.packbits((padded >> s & 1).astype(bool), axis=1, bitorder="little").view(np.uint64) for s in range(20 + 1)]

    sums, total = ranked.Slices(30, len(numbers), width), np.zeros_like(own)
    rng = np.random.default_rng(seed)
    for shift in (0, 3, 0, 1):
        part = own[:, rng.permutation(n)]
        sums.add(sliced(part), shift)
        total += part << shift
    row, at, score = sums.top(k)
    for i in range(len(numbers)):
        best = sorted(((-v, p) for p, v in enumerate(total[i].tolist()) if v), key=lambda x: x)[:k]
        assert sorted((-s, p) for p, s in zip(at[row == i].tolist(), score[row == i].tolist())) == best


# Packing


@pytest.fixture(scope="module")
def encode():
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def check_packed(rows, docs, encode, size):
    """Every piece of every document once, in place, without a gap, with its ids."""
    pieces = defaultdict(list)
    for d, t in docs:
        ids = encode(t)
        first = len(ids) if len(ids) <= size else len(ids) % size or size
        for k, e in enumerate([first, *range(first + size, len(ids) + 1, size)]):
            s = 0 if k == 0 else e - size
            pieces[d].append((k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())))
    got, places = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in pieces.items()}
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(places)


@pytest.mark.parametrize("size", [7, 64, 1024])
def test_packing(spark, encode, size):
    docs = [(None if d is None else d + BIG, t) for d, t in corpus(5)]
    docs += [(BIG + 999, "<|endoftext|> a\n\n  b \x1c  c　d  "), (BIG + 1000, "don't  stop\t\tit's 12345\xa0x")]
    packed, plan = packing.pack_documents(table(spark, docs), TOKENIZER, size)
    rows = packed.collect()
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    n = check_packed(rows, docs, encode, size)
    assert n == plan.sequences and plan.bound - 1e-6 <= n <= 1.03 * plan.bound + 3


def test_packed_sequences_hold_the_ids(spark, encode):
    docs = corpus(6)
    packed, plan = packing.pack_documents(table(spark, docs), TOKENIZER, 256, ids=True)
    found = packing.sequences(packed).collect()
    assert len(found) == plan.sequences
    got = Counter()
    for r in found:
        cuts = [*r["starts"], len(r["ids"])]
        got.update((d, tuple(r["ids"][s:e])) for d, s, e in zip(r["doc_ids"], cuts, cuts[1:]))
    want = Counter()
    for d, t in docs:
        ids = encode(t)
        first = len(ids) if len(ids) <= 256 else len(ids) % 256 or 256
        want.update((d, tuple(ids[s:e])) for s, e in zip([0, *range(first, len(ids), 256)], [first, *range(first + 256, len(ids) + 1, 256)]))
    # A null doc_id is not collected among ids, so ids are compared beside their pieces where there is one.
    assert sum(got.values()) == sum(want.values()) and got == want


def test_packing_of_an_empty_table(spark):
    packed, plan = packing.pack_documents(table(spark, corpus()).limit(0), TOKENIZER)
    assert packed.collect() == [] and plan.sequences == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x0b\x1c\x85\xa0 　​'sdt.,!<|>é中1"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=6))
def test_ids_by_runs_are_those_of_the_tokenizer(texts):
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    got = [np.frombuffer(b, "<u4").tolist() for b in packing.TokenIds(TOKENIZER)(texts)]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def exact_bins(items, size):
    """The fewest sequences, by trying all placements."""
    best = len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= items[i]:
                left = list(rooms)
                left.remove(r)
                place(i + 1, [*left, r - items[i]])
        place(i + 1, [*rooms, size - items[i]])

    place(0, [])
    return best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_plan_is_near_the_fewest_sequences(items):
    items = sorted(items, reverse=True)
    plan = packing.Plan.of(np.bincount(items, minlength=21), 20)
    fewest = exact_bins(items, 20)
    assert plan.bound <= fewest + 1e-6 and fewest <= plan.sequences <= fewest + 1


def test_program_beats_best_fit_alone():
    """Sizes that best fit packs badly: by configurations of three and two it takes a seventh more."""
    counts = np.zeros(1025, np.int64)
    counts[[511 - 170, 171, 512 + 1]] = 0
    counts[[170, 340, 514]] = [30_000, 30_000, 30_000]
    plan = packing.Plan.of(counts, 1024)
    assert plan.sequences <= 30_001 and plan.sequences >= plan.bound - 1e-6
    counts = np.zeros(1025, np.int64)
    counts[[251, 252, 258, 260, 520, 512]] = [40_000, 20_000, 10_000, 10_000, 10_000, 10_000]
    plain = sum(n for _, n in packing.best_fit(counts, 1024))
    plan = packing.Plan.of(counts, 1024)
    assert plan.sequences < plain and plan.sequences <= 1.01 * plan.bound


def test_program_of_many_lengths():
    """Within a thousandth of the dual bound, for a histogram with all lengths."""
    rng = np.random.default_rng(3)
    counts = np.bincount(np.minimum(rng.gamma(1.5, 300, 60_000).astype(int) + 1, 1024), minlength=1025)
    plan = packing.Plan.of(counts, 1024)
    assert plan.bound - 1e-6 <= plan.sequences <= 1.001 * plan.bound + 2


def test_knapsack_prices():
    """The dynamic program against all configurations of a small size."""
    rng = np.random.default_rng(1)
    for _ in range(20):
        prices = np.r_[0, rng.random(12)] * (rng.random(13) < 0.7)
        best, last = packing._knapsack(prices, 12)

        def brute(room):
            return max([0, *(prices[x] + brute(room - x) for x in range(1, room + 1) if prices[x])])

        assert np.isclose(best[12], brute(12))
        for first in range(1, 13):
            own = packing._configuration(first, last, 12)
            assert sum(x * a for x, a in own.items()) <= 12 and own[first] >= 1
            assert np.isclose(sum(prices[x] * a for x, a in own.items()), prices[first] + best[12 - first])


# Vector codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """{row: (code, error)} and the entries, every part against every entry, in Python's whole numbers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v in kept), default=0) // parts) * parts
    kept = [(i, v + [0] * (width - len(v))) for i, v in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = width // parts
    cut = [[v[p * d : (p + 1) * d] for p in range(parts)] for _, v in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[nearest(c[p], books[p])[1]].append(c[p])
            for k, own in groups.items():
                books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    out = Counter((i, bytes(k for _, k in f), sum(e for e, _ in f)) for (i, _), f in zip(kept, found))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def vectors(spark, rows):
    full = [(i, v, n % 3, b"", 1, [1]) for n, (i, v) in enumerate(rows)]
    return spark.createDataFrame(full, "vec_id long, embedding array<double>, label int, code binary, error int, x array<int>").repartition(3)


@pytest.mark.parametrize("n, entries", [(400, 256), (150, 16), (40, 256)])
def test_vector_codes(spark, n, entries):
    """Equal to all distances, with ties, repeated rows and ids, large ids beside a null, and vectors that take no part."""
    rng = np.random.default_rng(n)
    rows = [(int(i) * 3 + BIG, (np.round(rng.normal(0, 0.3, 12), 2) * (1 + 9 * (i % 7 == 0))).tolist()) for i in range(n)]
    rows += [rows[0], rows[5], (BIG, rows[9][1]), (None, rows[3][1]), (None, (rng.normal(0, 1, 12)).tolist())]
    rows += [(1, None), (2, [0.1] * 11 + [None]), (3, [float("nan")] * 12), (4, [float("inf")] + [0.0] * 11), (5, [0.0] * 12), (6, [-0.0] * 12), (7, [0.5] * 5), (8, [])]
    coded, books = codes.compress_vectors(vectors(spark, rows), entries=entries)
    got = Counter((r["vec_id"], bytes(r["code"]), r["error"]) for r in coded.collect())
    want, digest = brute_codes(rows, entries=entries)
    assert got == want and books.sha256() == digest
    assert books.decoded(bytes(4)).shape == (12,)


def test_vector_codes_of_few_or_no_vectors(spark):
    coded, books = codes.compress_vectors(vectors(spark, [(1, None)]))
    assert coded.collect() == [] and books.sha256() == hashlib.sha256(b"").hexdigest()
    coded, _ = codes.compress_vectors(vectors(spark, [(1, []), (2, [])]))
    assert [(r["code"], r["error"]) for r in coded.collect()] == [(bytearray(4), 0)] * 2
    # Beyond BOUND all components are alike.
    coded, _ = codes.compress_vectors(vectors(spark, [(1, [1e300] * 4), (2, [-1e300] * 4), (3, [2e300] * 4)]))
    assert [r["error"] for r in coded.orderBy("vec_id").collect()] == [0, 0, 0]


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.sampled_from([3, 200, 1 << 24]))
def test_exponion_finds_the_nearest(seed, m, spread):
    rng = np.random.default_rng(seed)
    book, x = rng.integers(-spread, spread + 1, (m, 5)), rng.integers(-spread, spread + 1, (60, 5))
    start = rng.integers(0, m, 60)
    found, d = codes.Exponion(book)(x, start)
    every = ((x[:, None, :] - book[None]) ** 2).sum(2)
    assert (found == every.argmin(1)).all() and (d == every.min(1)).all()


def test_exponion_spares_distances():
    """From the entry of the round before, most entries are out of reach."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-10_000, 10_000, (256, 8))
    x = centres[rng.integers(0, 256, 4000)] + rng.integers(-300, 300, (4000, 8))
    search = codes.Exponion(centres)
    near, _ = search(x, np.zeros(4000, np.int64))
    first, search.scanned = search.scanned, 0
    again, _ = search(x, near)
    assert (near == again).all() and search.scanned < first / 20


def test_queries_of_small_tables(spark, tmp_path):
    """The contract's columns, and errors summed over labels with nulls together."""
    rows = [(i + BIG, [float(i % 5), 0.25 * i, -1.0, 0.125], None if i % 4 == 0 else i % 3) for i in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.op13_codes(spark, str(tmp_path)).collect()
    sums = Counter()
    label = {i: x for i, _, x in rows}
    for r in found:
        sums[label[r["vec_id"]]] += r["error"]
    assert len(found) == 30 and all(r["label_error"] == sums[label[r["vec_id"]]] and re.fullmatch("[0-9a-f]{8}", r["code"]) for r in found)
