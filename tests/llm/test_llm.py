"""The text operators against brute force, on small tables with the awkward cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revpanel.llm import common, decontaminate, graph, html, mixing, pages, pii, queries, repeats, sharding, simhash, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, g int, h long, k int, bucket int"
VOCABULARY = [f"w{i}" for i in range(400)]


def words(rng, n):
    return " ".join(rng.choices(VOCABULARY, k=n))


def corpus(seed=1):
    """Copies, near copies, shared passages, short, empty, null and very long texts, a null id, repeated rows."""
    rng = random.Random(seed)
    base = [words(rng, rng.choice([3, 12, 25, 60, 120, 200])) for _ in range(30)]
    passage = words(rng, 70)
    texts = list(base)
    for t in base[:8]:
        w = t.split()
        w[len(w) // 2] = "changed"
        texts += [t, t, " ".join(w)]
    texts += [words(rng, 30) + " " + passage + "\n" + words(rng, 20) for _ in range(6)]
    texts += [None, "", "", " \t\n", "one", "Zwei Wörter", "ha " * 90, words(rng, 6000), "ünï çödé " * 40, "A b c d\x0be"]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[0], rows[0], (None, base[0])]


def table(spark, rows):
    """With columns whose names the operators use inside."""
    full = [(i, t, "en", None if n % 7 == 0 else f"s{n % 4}", None, "key", 1, 2, 3, 4) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


class Union:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, i, j):
        a, b = self.find(i), self.find(j)
        self.up[max(a, b)] = min(a, b)


def brute_print(t):
    w = split(lower(t))
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_classes(spark):
    rows = corpus()
    got = Counter(tuple(r) for r in simhash.simhash_classes(table(spark, rows)).collect())
    prints = [brute_print(t) for _, t in rows]
    u = Union(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                u.join(i, j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[u.find(i)].append(d)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = Counter((d, signed(prints[i]), min(least[u.find(i)])) for i, (d, _) in enumerate(rows))
    assert got == want


@pytest.mark.parametrize("clusters", [1, 3])
def test_simhash_large_bucket(spark, monkeypatch, clusters):
    """Hundreds of fingerprints around one, and around several that share buckets: tiles, leads, and no lost link."""
    monkeypatch.setattr(simhash, "TILE", 32)
    rng = np.random.default_rng(4)
    centre, values = int(rng.integers(0, 1 << 63)), set()
    while len(values) < 700:
        x = centre ^ (0xFFFF << 4 * (len(values) % clusters) if len(values) % clusters else 0)
        for b in rng.integers(0, 64, int(rng.integers(1, 7))):
            x ^= 1 << int(b)
        values.add(x)
    ids = np.array(sorted(values), np.uint64)
    plan = simhash.PivotPlan.exact(len(ids))
    items = spark.createDataFrame([(int(v.view(np.int64)), v.tobytes()) for v in ids], "id long, fp binary")
    keys = simhash.block_keys(items.select(F.col("id").alias("fp")), plan)
    got = defaultdict(set)
    for r in simhash.linked(keys, items, 3, plan.references()).collect():
        got[r["comp"]].add(r["node"])
    u = Union(len(ids))
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(ids[:i] ^ ids[i]) <= 3):
            u.join(i, int(j))
    want = defaultdict(set)
    for i, v in enumerate(ids):
        want[u.find(i)].add(int(v.view(np.int64)))
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_pivot_bound_discards_and_is_a_bound():
    plan, rng = simhash.PivotPlan.exact(1000), np.random.default_rng(0)
    fps = rng.integers(0, 1 << 64, (2000, 1), dtype=np.uint64)
    fps[1000:] = np.where(np.arange(1000)[:, None] < 50, fps[:1000] ^ np.uint64(1 << 17), fps[1000:])
    table = simhash.distances(fps, plan.references())
    i = np.arange(1000)
    bound, far = np.abs(table[:1000] - table[1000:]).max(1), np.bitwise_count(fps[:1000] ^ fps[1000:])[:, 0]
    assert (bound <= far).all() and (bound > 3).sum() > 940
    assert (simhash.linked_pairs(fps, table, i, i + 1000, 3) == (far <= 3)).all()
    # the table of the blocks adds up to that of the whole
    values, tables = plan.split(fps), plan.tables()
    assert (sum(t[values[:, b]].astype(int) for b, t in enumerate(tables)) == table).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 300)] + [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(90)]
    u = Union(600)
    for a, b in edges:
        u.join(a, b)
    got = {r["node"]: r["comp"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: u.find(x) for e in edges for x in e if e[0] != e[1]} | {x: u.find(x) for x in got}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_groups(rows):
    """Components of all pairs of different texts whose fingerprints of five-word runs are within the limit of 0.8."""
    hasher, texts = common.WordHasher(), sorted({t or "" for _, t in rows})
    fps = np.stack([simhash.fingerprint(simhash._runs(common.alnum_words(t), hasher, 5), simhash.NEAR_BITS) for t in texts])
    some = np.array([bool(common.alnum_words(t)) for t in texts])
    limit, u, at = simhash.near_limit(0.8), Union(len(texts)), {t: i for i, t in enumerate(texts)}
    for i in range(len(texts)):
        for j in np.flatnonzero((np.bitwise_count(fps[:i] ^ fps[i]).sum(1) <= limit) & some[:i] & some[i]):
            u.join(i, int(j))
    least = defaultdict(lambda: None)
    for d, t in rows:
        c = u.find(at[t or ""])
        if d is not None and (least[c] is None or d < least[c]):
            least[c] = d
    return [(d, t, least[u.find(at[t or ""])], u.find(at[t or ""])) for d, t in rows]


def jaccard(a, b):
    grams = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (split(lower(a)), split(lower(b)))]
    return len(grams[0] & grams[1]) / max(1, len(grams[0] | grams[1]))


def edited(rng, i):
    """A text and a near copy at a Jaccard similarity from 0.80 to 0.87: words swapped, a block replaced, or words appended."""
    w = words(rng, (200, 600)[i % 2]).split()
    n, copy = len(w), list(w)
    if i % 4 == 0:
        k, at = int(0.08 * n), rng.randrange(int(0.9 * n))
        copy[at : at + k] = [f"new{i}x{j}" for j in range(k)]
    elif i % 4 == 1:
        for at in rng.sample(range(n), int(0.019 * n)):
            copy[at] = f"swap{at}"
    else:
        copy += [f"more{i}x{j}" for j in range(int((0.2, 0.23)[i % 4 - 2] * n))]
    return " ".join(w), " ".join(copy)


@pytest.mark.parametrize("tile", [256, 4])
def test_near_duplicate_groups(spark, monkeypatch, tile):
    """The groups of brute force; among them pairs at Jaccard 0.80 to 0.87, also where a shared passage fills their least runs."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng, rows = random.Random(12), corpus()
    licence, base = words(rng, 30), words(rng, 150).split()
    for i in range(120):
        a, b = edited(rng, i)
        if i % 3 == 2:
            a, b = licence + " " + a, licence + " " + b
        assert 0.8 <= jaccard(a, b) <= 0.9
        rows += [(10_000 + 10 * i, a), (10_000 + 10 * i + 1, b), (10_000 + 10 * i + 5, words(rng, 150) + " " + licence)]
    for i in range(60):
        copy = list(base)
        copy[rng.randrange(150)] = copy[rng.randrange(150)] = f"own{i}"
        rows.append((20_000 + i, " ".join(copy)))
    # copies but for case and punctuation; one doc_id with two texts; null ids
    text = words(rng, 80)
    rows += [(30_000, text), (30_001, ", ".join(text.upper().split(" "))), (30_002, words(rng, 50)), (30_002, text), (None, words(rng, 60)), (None, "!!"), (None, "??")]
    got = Counter(tuple(r) for r in simhash.near_duplicate_groups(table(spark, rows)).select("doc_id", "group_id").collect())
    want = brute_groups(rows)
    assert got == Counter((d, g) for d, _, g, _ in want)
    group = {d: g for d, _, g, _ in want}
    pairs = [group[10_000 + 10 * i] == group[10_000 + 10 * i + 1] for i in range(120)]
    assert sum(pairs) >= 0.97 * len(pairs) and len({group[20_000 + i] for i in range(60)}) == 1
    assert all(group[10_000 + 10 * i + 5] == 10_000 + 10 * i + 5 for i in range(120)) and group[30_001] == group[30_002] == 30_000


@pytest.mark.parametrize("tile", [256, 4])
def test_near_duplicate_links_under_the_similarity(spark, monkeypatch, tile):
    """Links at a cosine near 0.72, where a passage that all share is the smaller part of the longer texts."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(21)
    base = words(rng, 60)
    rows = [(i, base + " " + words(rng, (2, 48)[i % 2])) for i in range(60)]
    want = brute_groups(rows)
    group = {d: g for d, _, g, _ in want}
    assert sum(group[i] == group[0] for i in range(1, 60, 2)) >= 20
    got = simhash.near_duplicate_groups(table(spark, rows)).select("doc_id", "group_id").collect()
    assert {r["doc_id"]: r["group_id"] for r in got} == group


@pytest.mark.parametrize("tile", [256, 16])
def test_near_copies_link_once(spark, monkeypatch, tile):
    """Links of a group of near copies grow with its texts, not with the runs that these share or the tiles of a bucket."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng, buckets, made = random.Random(31), simhash._in_buckets, []

    def counted(*args):
        out = common.cut(buckets(*args))
        made[-1] += out.count()
        return out

    monkeypatch.setattr(simhash, "_in_buckets", counted)
    base = words(rng, 150).split()
    for n in (100, 400):
        rows, _ = [(n + i, words(rng, 40)) for i in range(20)], made.append(0)
        for i in range(n):
            copy = list(base)
            for at in rng.sample(range(150), 3):
                copy[at] = f"own{i}x{at}"
            rows.append((i, " ".join(copy)))
        got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicate_groups(table(spark, rows)).collect()}
        assert got == {d: g for d, _, g, _ in brute_groups(rows)} and len({got[i] for i in range(n)}) == 1
        assert n - 1 <= made[-1] <= 5 * n


def test_rows_of_a_large_bucket(spark, monkeypatch):
    """A bucket whose members are hardly linked is dealt over rows in proportion to its members, and all links are found."""
    monkeypatch.setattr(simhash, "TILE", 4)
    rng, buckets, made = np.random.default_rng(3), simhash._in_buckets, []

    def counted(rows, *args):
        made.append(rows.count())
        return buckets(rows, *args)

    monkeypatch.setattr(simhash, "_in_buckets", counted)
    n = 1200
    fps = rng.integers(0, 1 << 64, (n, 8), dtype=np.uint64)
    fps[n - 20 :] = fps[:20] ^ np.uint64(1)
    items = spark.createDataFrame([(i, fps[i].tobytes()) for i in range(n)], "id long, fp binary")
    got = {r["node"]: r["comp"] for r in simhash.linked(items.select(F.lit(7).cast("long").alias("key"), "id"), items, 122).collect()}
    assert got == {j: i for i in range(20) for j in (i, n - 20 + i)}
    assert len(made) == 3 and made[-1] <= 2 * 16 * n


def test_few_edges_take_few_tasks(spark, monkeypatch):
    """Tables of the rounds are as many files as their edges need, however many partitions a shuffle has."""
    written, cut = [], graph.cut

    def counted(df):
        written.append(df.rdd.getNumPartitions())
        return cut(df)

    monkeypatch.setattr(graph, "cut", counted)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
        assert {r["comp"] for r in graph.components(edges).collect()} == {0}
        assert set(written[1:]) == {1}
        written.clear()
        monkeypatch.setattr(graph, "EDGES", 4)
        assert {r["comp"] for r in graph.components(edges).collect()} == {0}
        assert max(written[1:]) == 3
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_common_runs_of_all_rows(spark, monkeypatch):
    """Runs are counted over all rows, also where those that share one are none of a sample by hash of 16,000 rows and more."""
    rng = random.Random(8)
    passage = words(rng, 8)
    texts = spark.createDataFrame([(i, words(rng, 56) + " " + passage) for i in range(1300)], "doc_id long, text string")
    texts = texts.where(F.pmod(simhash.text_key("text")[1], F.lit(2)) == 1)
    docs = texts.union(spark.range(16_000).select(F.col("id") + 10_000, F.concat(F.lit("word "), "id"))).repartition(3)
    linked, most = simhash.linked, []

    def look(keys, items, bits):
        most.append(keys.groupBy("key").count().agg(F.max("count")).first()[0])
        return linked(keys, items, bits)

    monkeypatch.setattr(simhash, "linked", look)
    assert simhash.near_duplicate_groups(docs).where("keep").count() == docs.count() and most[0] <= simhash.TILE
    hasher, counts, least = common.WordHasher(), Counter(), []
    for r in docs.collect():
        least.append([int(h) >> 1 for h in simhash._runs(common.alnum_words(r["text"]), hasher, 5)[: simhash.COUNTED_RUNS]])
        counts.update(least[-1])
    items = spark.createDataFrame([(x,) for x in least], "runs array<long>")
    assert simhash.common_runs(items).tolist() == sorted(h for h, n in counts.items() if n > simhash.TILE) != []


def test_look_up_of_common_runs():
    """At most twice LEAST_RUNS for any text; common runs only where they are more than two sevenths."""
    runs = np.arange(64) * 3
    assert simhash._look_up(runs, np.array([], np.int64)).tolist() == runs[:32].tolist()
    assert simhash._look_up(runs, runs[:18]).tolist() == runs[18:50].tolist()
    assert simhash._look_up(runs, runs[:19]).tolist() == [*runs[19:51], *runs[:19]]
    assert simhash._look_up(runs, np.arange(400)).tolist() == runs[:32].tolist()
    assert simhash._look_up(runs[:0], runs).tolist() == []


def test_keep_one(spark):
    """One row of each group, whatever repeats."""
    rng = random.Random(3)
    rows = corpus() + [(5, words(rng, 90)), (5, words(rng, 90)), (None, words(rng, 60)), (None, words(rng, 61))]
    rows += [(6, rows[-1][1]), (7, rows[-2][1]), (7, rows[-2][1])]
    docs = table(spark, rows)
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    kept = Counter((r["doc_id"], r["text"]) for r in got.collect())
    least, by = {}, {}
    for d, t, _, c in brute_groups(rows):
        least[c] = min(least.get(c, (2,)), (d is None, d or 0))
        by[t or ""] = c
    assert len(kept) == sum(kept.values()) == len(least) and set(kept) <= set(rows)
    assert all((d is None, d or 0) == least[by[t or ""]] for d, t in kept)
    assert simhash.keep_one(docs.limit(0)).count() == 0


def brute_windows(rows, width):
    """Documents in the order of doc_id (null first) and, for one doc_id, of the signed hash of their texts."""
    def place(d, t):
        h = xxhash.xxh64_intdigest((t or "").encode(), 42)
        return (repeats.NO_ID if d is None else d, h - (1 << 64) if h >> 63 else h)

    order, first = sorted(((place(d, t), d, t) for d, t in rows), key=lambda x: x[0]), {}
    for key, _, t in order:
        w = split(t)
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), (key, k))
    out = []
    for key, d, t in order:
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] != (key, k):
                gone[k : k + width] = [True] * width
        out.append((d, len(w), sum(gone), " ".join(x for x, y in zip(w, gone) if not y)))
    return Counter(out)


@pytest.mark.parametrize("width", [20, 50])
def test_repeated_windows(spark, width):
    """Also one doc_id with several texts, several null ids, and runs of one word."""
    rng, rows = random.Random(31), corpus()
    shared = words(rng, 64)
    rows += [(0, words(rng, 70)), (1, words(rng, 60)), (1, words(rng, 80)), (1, shared), (1, words(rng, 9) + " " + shared), (None, shared), (None, words(rng, 90)), (None, words(rng, 60))]
    rows += [(3, "la " * 140), (3, "la " * 55 + "le " + "la " * 70), (400, words(rng, 25) + " " + shared + " " + words(rng, 12))]
    f = repeats.strip_repeated_windows if width == 20 else repeats.strip_repeated_passages
    got = f(table(spark, rows), width)
    assert Counter(tuple(r)[:4] for r in got.collect()) == brute_windows(rows, width)
    for r in got.where("n_removed > 0").collect():
        assert sum(e - s for s, e in zip(r["starts"], r["ends"])) == r["n_removed"]
    assert f(table(spark, rows).limit(0), width).count() == 0


def test_packing_round_trip():
    doc, text, start = np.array([-5, 3, 3, 1 << 40]), np.array([9, 1, 2, -8]), np.array([0, 7, 9, 1])
    tail = np.arange(16, dtype=np.uint8).reshape(4, 4)
    back = repeats.Marks.unpack(repeats.Marks(doc, text, start, tail).pack())
    assert all((getattr(back, c) == x).all() for c, x in (("doc", doc), ("text", text), ("start", start), ("tail", tail)))
    assert repeats.Marks.unpack(repeats.Marks(doc, text, start).pack()).tail.shape == (4, 0)


def test_neighbours_in_order(spark):
    """What a suffix has in common with any other it has in common with a neighbour."""
    rng = np.random.default_rng(3)
    codes = rng.integers(1, 3, (300, 6))
    rows = [(i, 0, 0, x.astype(repeats.CODE).tobytes()) for i, x in enumerate(codes)]
    df = spark.createDataFrame(rows, "doc long, th long, start int, side binary").repartition(1).sortWithinPartitions("side", "doc")
    got = {r["doc"]: r["n"] for r in repeats._neighbours(df, "side", 6).collect()}
    agree = lambda a, b: next((k for k in range(6) if a[k] != b[k]), 6)
    want = {i: max(agree(codes[i], codes[j]) for j in range(300) if j != i) for i in range(300)}
    assert all(got[i] >= want[i] for i in want) and sum(got[i] != want[i] for i in want) <= 2


def test_rolling_hashes():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 5, 5000).astype(np.uint64)
    r = common.rolling(h, 4)
    seen = {}
    for i, x in enumerate(r):
        assert seen.setdefault(tuple(h[i : i + 4]), x) == x
    assert len(set(seen.values())) == len(seen)


def brute_contamination(rows, items):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = defaultdict(set)
    for i, t in items:
        w = pattern.findall(lower(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].update([] if i is None else [str(i)])
    out = []
    for d, t in rows:
        w = pattern.findall(lower(t))
        hit, names = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[k : k + n]))) is not None:
                    names |= got
                    hit[k : k + n] = [True] * n
        out.append((d, len(w), sum(hit), tuple(sorted(names)), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return Counter(out)


@pytest.mark.parametrize("bits", [1 << 26, 8 * (1 << 16)])
def test_contamination(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
    rng, rows = random.Random(2), corpus()
    long = [t for _, t in rows if t and len(split(t)) > 100]
    items = [(i, " ".join(split(t)[40 : 40 + 13 + i])) for i, t in enumerate(long[:8])]
    items += [(50, "w3 w9"), (51, "W7"), (52, None), (53, ""), (None, items[0][1]), (54, words(rng, 40)), (55, items[1][1]), (55, items[1][1]), (56, "--- !!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(table(spark, rows), bench)
    want = brute_contamination(rows, items)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got.collect()) == want
    clean = decontaminate.clean_documents(table(spark, rows), bench)
    assert clean.columns == table(spark, rows).columns
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(k[0] for k in want.elements() if not k[2])
    assert decontaminate.clean_documents(table(spark, rows).limit(0), bench).count() == 0
    assert decontaminate.clean_documents(table(spark, rows), bench.limit(0)).count() == len(rows)
    none = decontaminate.contamination(table(spark, rows), bench.limit(0))
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(rows)


def test_toxicity_learns_words_and_pairs(spark):
    """Insults; and two groups of words that are harmless apart."""
    rng, rows, labels = random.Random(5), [], []
    for i in range(900):
        w, kind = words(rng, 60).split(), i % 6
        if kind == 0:
            w[rng.randrange(60)] = "dimwit"
        if kind in (1, 2):
            w[3] = "those"
        if kind in (1, 3):
            w[40] = "vermin"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(kind in (0, 1))))
    docs, marks = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, marks)
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, model).collect()}
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(scores[i] >= 0.5) == y for i, y in held]) > 0.97
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(s < 0.5 for s in scores.values())
    odd = table(spark, [(1, None), (2, ""), (None, "dimwit"), (3, "x " * 5000)])
    assert all(0 <= r["score"] <= 1 for r in toxicity.toxicity_scores(odd, model).collect())
    nothing = toxicity.fit_toxicity(docs, marks.limit(0))
    assert 0 <= nothing.score(np.array([1, 2])) <= 1


def test_pairs_of_terms_that_say_nothing_alone(spark):
    """Toxic is what has exactly one of two words: the machine learns it, the same model without factors can not."""
    rng, rows, labels = random.Random(15), [], []
    for i in range(1500):
        w, a, b = words(rng, 40).split(), rng.random() < 0.5, rng.random() < 0.5
        if a:
            w[rng.randrange(20)] = "those"
        if b:
            w[20 + rng.randrange(20)] = "vermin"
        rows.append((i, " ".join(w)))
        labels.append((i, int(a != b)))
    docs, marks = table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]

    def right(model):
        scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, model).collect()}
        return np.mean([(scores[i] >= 0.5) == y for i, y in held])

    assert right(toxicity.fit_toxicity(docs, marks)) > 0.95 and right(toxicity.fit_toxicity(docs, marks, factors=0)) < 0.8
    odd = table(spark, [(None, "those"), (1, "x")]).select(toxicity.held_out().alias("h")).collect()
    assert all(r["h"] is not None for r in odd)


def test_held_out_labels_are_never_read(spark):
    rows = [(i, f"text number {i} " + words(random.Random(i), 20)) for i in range(200)]
    good = [(i, i % 2) for i in range(200)]
    bad = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, y in good]
    a, b = (toxicity.fit_toxicity(table(spark, rows), spark.createDataFrame(x, "doc_id long, toxic int")) for x in (good, bad))
    assert a.bias == b.bias and (a.slots == b.slots).all() and np.array_equal(a.factors, b.factors)


def brute_top(rows, k):
    """Every row is a candidate, and every row whose id is divisible by 10 a query."""
    exact = lambda x: math.floor(256 * x) if math.isfinite(256 * x) else int(x) * 256
    ok = [(i, [exact(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, clip = Counter(), lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    for at, (i, v) in enumerate(ok):
        if i % 10 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, x)), j) for n, (j, x) in enumerate(ok) if n != at and len(x) == len(v))
            out.update((i, r, j, clip(-s)) for r, (s, j) in enumerate(scores[:k], 1))
    return out


@pytest.mark.parametrize("block", [2048, 7])
def test_top_k(spark, monkeypatch, block):
    """Ties, repeated ids with other vectors, many lengths, and components up to the largest double."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk, "FIRST", 40)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + rng.normal(scale=0.05, size=8)).tolist()) for i in range(300 if block == 2048 else 90)]
    rows += [(701 + i, rows[3][1]) for i in range(9)] + [(800, None), (801, [1.0, None] + [0.0] * 6), (802, [float("nan")] * 8), (803, [float("inf")] * 8), (None, rows[0][1])]
    rows += [(810, [1.0, 2.0]), (811, [0.5, 0.5]), (820, []), (830, []), (20, rows[31][1]), (20, rows[31][1]), (840, [3e6] * 8), (850, [1e308] * 8), (851, [-1e308] + [1e300] * 7), (860, [-1e150] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, query int").repartition(3)
    got = topk.exact_top_k(df, F.col("vec_id") % 10 == 0)
    assert Counter(tuple(r) for r in got.collect()) == brute_top(rows, 5)
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_top_k_of_any_number_of_lengths(spark):
    rows = [(i, [float(i % 7 - 3)] * (i // 3)) for i in range(3 * 1001)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.exact_top_k(df, F.col("vec_id") % 10 == 0)
    assert Counter(tuple(r) for r in got.collect()) == brute_top(rows, 5)


def test_pivots_spare_work():
    """Of clustered vectors a small part is evaluated."""
    rng = np.random.default_rng(7)
    x = 200 * rng.normal(size=(40, 4))[np.arange(8000) % 40] + rng.normal(size=(8000, 4))
    refs = np.floor(256 * x[:32])
    tab = np.sqrt(((np.floor(256 * x)[:, None] - refs[None]) ** 2).sum(2))
    every = topk.Vectors(np.arange(8000), np.arange(8000), x, tab, 256.0)
    search = topk.Search(every[np.arange(0, 8000, 50)], every[np.arange(500)], 5)
    search.add(every)
    s = np.floor(256 * x) @ np.floor(256 * x[150])
    s[150] = -np.inf
    assert [j for i, q, j, v in search.rows() if q == 150] == list(np.lexsort((np.arange(8000), -s))[:5])
    assert search.evaluated < 0.25 * 160 * 8000


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">menu</a></li></ul></nav><header><h1>Site</h1></header><div class="cookie-notice"><p>We use cookies, please accept them all now.</p></div>
<article><h1>The &amp; title</h1><p><b>First  part<br>second &eacute;&#233;<p>Next, with a <a href="/x">link</a> in it.</p>
<div class="ad">Buy this wonderful thing today, you will not regret it.</div><p>Ok.</p><form><label>Mail</label><input><button>Go</button></form>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I think that this article is very good indeed, thanks.</p></div></section></article>
<aside><p>A related story that is rather long and could be mistaken for text.</p></aside><footer>&copy; me &middot; all rights</footer></body></html>"""


def test_main_text():
    model = html.trained_model()
    got = html.main_texts(model, [PAGE, None, "", "no tags but a sentence of text that stands alone in the page", "<p>", "<" * 50, PAGE[: PAGE.index("Ok.")]])
    assert got[0] == "The & title\nFirst part second éé\nNext, with a link in it.\nOk."
    assert got[1] == got[2] == got[4] == ""
    assert got[6].startswith("The & title\nFirst part")


#: Pages written by hand, each with its main text.
BY_HAND = [
    ("""<html><head><title>Bread - My Kitchen</title></head><body class="home"><div id="top"><a href="/">My Kitchen</a> | <a href="/r">Recipes</a> | <a href="/s">Shop</a></div>
     <div class="post"><h2>How I bake bread at home</h2><p>Flour, water and salt are all you need, and some patience on a cold day.</p><p>Mix the <em>dough</em> in the evening and let it rest until the next morning; then fold it twice.</p><ul><li>500 g of flour from a mill nearby</li><li>10 g of salt</li></ul></div>
     <div class="sidebar"><h3>About me</h3><p>I am a baker who writes about bread and other good things to eat.</p></div><div class="footer">All rights reserved 2024</div></body></html>""",
     "How I bake bread at home\nFlour, water and salt are all you need, and some patience on a cold day.\nMix the dough in the evening and let it rest until the next morning; then fold it twice.\n500 g of flour from a mill nearby\n10 g of salt"),
    ("""<!doctype html><body><header><nav><a href=/>Home</a><a href=/news>News</a></nav></header><main><article><h1>Bridge opens after three years of work</h1><p>The new bridge over the river was opened on Monday by the mayor, who crossed it on foot.
     <p>It cost &euro;12 million, which is twice as much as was planned when work began.<aside class="related"><h4>Read also</h4><a href=/b>Another bridge</a></aside><p>Buses will use it from next week on.</article></main><footer><p>&copy; Local Paper &middot; <a href=/c>Contact</a></p></footer></body>""",
     "Bridge opens after three years of work\nThe new bridge over the river was opened on Monday by the mayor, who crossed it on foot.\nIt cost €12 million, which is twice as much as was planned when work began.\nBuses will use it from next week on."),
    ("""<body><div id="cookie-banner"><p>This site uses cookies to make your visit better, do you agree to that?</p><button>Yes</button></div><div id="content"><h1>Garden notes</h1><blockquote><p>Plant in the autumn, harvest in the summer, as my mother used to say.</p></blockquote><p>Roses want sun and some water every day.</p></div>
     <div id="comments"><h3>2 comments</h3><div class="comment"><p>What a lovely garden you have there, thank you for sharing it with us.</p></div></div><form><input name=q><button>Search</button></form><script>track("page");</script></body>""",
     "Garden notes\nPlant in the autumn, harvest in the summer, as my mother used to say.\nRoses want sun and some water every day."),
]


def test_main_text_of_pages_written_by_hand():
    """Block by block: nearly all is found, and next to nothing else."""
    got, hit, found, wanted = html.main_texts(html.trained_model(), [p for p, _ in BY_HAND]), 0, 0, 0
    for text, (_, want) in zip(got, BY_HAND):
        a, b = Counter(text.split("\n")), Counter(want.split("\n"))
        hit, found, wanted = hit + sum((a & b).values()), found + sum(a.values()), wanted + sum(b.values())
    assert hit / wanted >= 0.9 and hit / found >= 0.9, (hit, found, wanted, got)


def test_deep_long_and_hostile_pages():
    """In time that grows with the page: deep nesting, stray end tags, unclosed quotes, very long texts, and no crash."""
    import time

    def seconds(n):
        began = time.process_time()
        html.main_texts(model, ["<div>" * n + "text</div></p></i></x>" * n, "<b>" * n + "</i>" * n, "<p class=\"" * n, "<p>" + "a word and another one. " * n, "<!--" * n, "&#1;&bogus;&#x110000;" * n])
        return time.process_time() - began

    model = html.trained_model()
    seconds(100)
    assert seconds(4000) < 12 * max(seconds(1000), 0.05)


def test_main_text_on_held_out_pages():
    model, right, total = html.trained_model(), 0, 0
    forest = html.Forest()
    for p in pages.labelled_pages(120, seed=99):
        forest.add(p)
    p, y = model.marginals(forest), np.array(forest.label)
    texts = np.array([i for i, t in forest.text.items() if t.strip()])
    right, total = int(((p[texts] > 0.5) == y[texts]).sum()), len(texts)
    assert right / total > 0.97


def test_messages_give_exact_marginals():
    """Against the sum over all labellings of a small tree."""
    import itertools

    model, forest = html.trained_model(), html.Forest()
    forest.add("<div><p>a b c</p><ul><li>d</li></ul></div>")
    f, parent = forest.features()
    kind, n, total = html.edge_kinds(f, parent), len(parent), np.zeros((len(parent), 2))
    for y in itertools.product((0, 1), repeat=n):
        s = model.root[y[0]] + sum(e[f[i, j], y[i]] for j, e in enumerate(model.emission) for i in range(n))
        s += sum(model.pair[kind[i], y[parent[i]], y[i]] for i in range(1, n))
        for i in range(n):
            total[i, y[i]] += math.exp(s)
    assert np.allclose(model.marginals(forest), total[:, 1] / total.sum(1))


def test_pages_query(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = html.extract_main_text(df).collect()
    assert Counter(r["page_id"] for r in got) == {1: 2, 2: 1} and {r["text"] for r in got if r["page_id"] == 2} == {""}
    assert html.extract_main_text(df.limit(0)).count() == 0


def brute_targets(sizes, weights):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w, out, left, free = {n: weights[i % 3] for i, n in enumerate(names)}, {}, 1.5 * sum(sizes.values()), set(names)
    while free:
        level = left / sum(w[n] for n in free)
        over = [n for n in free if level * w[n] > 2 * sizes[n]]
        if not over:
            out |= {n: level * w[n] for n in free}
            break
        for n in over:
            out[n] = 2 * sizes[n]
            left -= out[n]
            free.discard(n)
    return out


def test_mixing(spark):
    rng = random.Random(9)
    rows = corpus() + [(1000 + i, words(rng, rng.randint(1, 60))) for i in range(600)]
    docs = table(spark, rows)
    got = mixing.mix_documents(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    out = mixing.mix_documents(docs)
    every = out.collect()
    assert len(every) == len(rows)
    assert Counter((r["doc_id"], r["size"]) for r in every) == Counter((d, len(split(t))) for d, t in rows)
    assert all(r["taken"] <= 2 * r["size"] for r in every)
    full = docs.select("source", F.regexp_count("text", F.lit(mixing.WORDS)).alias("n")).groupBy("source").agg(F.sum("n").alias("n"))
    targets = brute_targets({r["source"]: r["n"] or 0 for r in full.collect()}, (5, 2, 1))
    assert sorted(round(t, 6) for t in targets.values()) == sorted({round(r["target"], 6) for r in every})
    by = defaultdict(int)
    for r in every:
        by[r["target"]] += r["taken"]
    assert all(abs(n - t) <= 0.02 * t for t, n in by.items())
    assert Counter(tuple(r) for r in mixing.mix_documents(docs.repartition(5)).collect()) == Counter(tuple(r) for r in every)
    repeated = mixing.repeat_rows(docs)
    assert repeated.columns == docs.columns and repeated.count() == sum(r["copies"] for r in every)
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    assert got


def test_targets_of_many_sources(spark):
    """Hundreds of sources over several ranges, null and equal ratios among them."""
    rng = random.Random(17)
    sizes = {f"src{rng.randrange(10**6)}": rng.choice([10, 10, 500, 4000, 0]) for _ in range(400)} | {None: 70, "ä": 5, "Z": 5}
    df = spark.createDataFrame([(str(k), k, n) for k, n in sizes.items()], "k string, source string, source_size long").repartition(5)
    got = {r["k"]: r["target"] for r in mixing.source_targets(df, 1.5, (5, 2, 1), 2.0).collect()}
    want = brute_targets(sizes, (5, 2, 1))
    assert len(got) == len(want) and all(abs(got[str(k)] - t) < 1e-6 * max(1, t) for k, t in want.items())


def test_sharding(spark):
    rng = random.Random(10)
    rows = corpus() + [(5000 + i, "the same text") for i in range(90)] + [(7000 + i, words(rng, 4)) for i in range(60)] + [(8000 + i, f"pair {i // 3}") for i in range(60)]
    docs = table(spark, rows)
    got = sharding.shard_documents(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert len(by) == 16 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    shards = defaultdict(list)
    for r in got:
        if r["gid"] is not None:
            shards[r["gid"]].append(r["shard"])
    small = [s for s in shards.values() if 1 < len(s) <= 8]
    assert np.mean([len(set(s)) == 1 for s in small]) > 0.9
    large = max(shards.values(), key=len)
    assert len(set(large)) <= math.ceil(len(large) / (len(rows) // 16)) + 1
    edges = sharding.edges_cut(sharding.shard_documents(docs)).first()
    assert edges["edges"] == sum(len(s) * (len(s) - 1) // 2 for s in shards.values())
    assert edges["cut"] == sum(len(s) * (len(s) - 1) // 2 - sum(n * (n - 1) // 2 for n in Counter(s).values()) for s in shards.values())
    by_hash = sum(len(s) * (len(s) - 1) / 2 * 15 / 16 for s in shards.values() if len(s) > 1)
    # what no placement avoids: the large group fills whole shards
    room, pairs = -(-len(rows) // 16), lambda n: n * (n - 1) // 2
    least = pairs(len(large)) - len(large) // room * pairs(room) - pairs(len(large) % room)
    assert least <= edges["cut"] <= least + 0.4 * (by_hash - least)
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    assert sharding.shard_documents(table(spark, rows[:5])).count() == 5
    whole = sharding.shard_rows(docs.withColumn("slot", F.lit("x")))
    assert whole.columns == [*docs.columns, "size", "text_crc32", "shard", "slot"]
    assert Counter((r["doc_id"], r["text"]) for r in whole.collect()) == Counter(rows)
    assert sorted(r["slot"] for r in whole.where("shard = 3").collect()) == list(range(whole.where("shard = 3").count()))
    assert sharding.shard_rows(docs.limit(0)).count() == 0


ENTITIES = [
    "anna.smith@mail.example.com", "+1 (415) 555-0134", "97.51.17.173", "4539 1488 0343 6467", "4539148803436467", "123-45-6789", "DE89 3704 0044 0532 0130 00",
    "04dbebab91ab85687d33eeaaf9ac699e1188f962", "Anna Schmidt", "John O", "Иван Петров", "Μαρία Παππά", "+14155550134",
]


def test_surrogates(spark):
    rng = random.Random(11)
    rows = [(i, words(rng, 20) + f" {e} and " + words(rng, 5) + f", {e}.") for i, e in enumerate(ENTITIES)]
    rows += [(100 + i, words(rng, 5) + f" mail{i}@a{i % 7}.example.org " + f"10.0.{i % 9}.{i}") for i in range(300)]
    rows += [(900, None), (901, ""), (902, "nothing here 12 and 3.4"), (None, "4539148803436467"), (0, rows[0][1])]
    got = pii.replace_personal_data(table(spark, rows), "k").collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[900]["text"] is None and by[901]["text"] == "" and by[902]["text"] == rows[-3][1]
    for i, e in enumerate(ENTITIES):
        if e != "John O":
            assert e not in by[i]["text"] and by[i]["n_mentions"] == 2, e
    shape = lambda s: re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", re.sub(r"\d", "0", s))
    card = re.search(r"\d{16}", by[4]["text"])[0]
    assert sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(card)) % 10 == 0
    # one entity in two spellings, and in the row with a null id, has one surrogate
    assert re.search(r"\d{4} \d{4} \d{4} \d{4}", by[3]["text"])[0].replace(" ", "") == card == by[None]["text"]
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", by[1]["text"])
    assert re.search("[А-Я][а-я]+ [А-Я][а-я]+", by[10]["text"])[0].split()[0] in pii.GIVEN["cyrillic_m"]
    assert re.search("[A-Z][a-z]+ [A-Z][a-z]+", by[8]["text"])[0].split()[0] in pii.GIVEN["latin_f"]
    assert shape(by[7]["text"]).count("a") and re.search(r"[0-9a-f]{40}", by[7]["text"])
    mails = [re.search(r"\S+@\S+", by[100 + i]["text"])[0] for i in range(300)]
    addresses = {re.search(r"\d+\.\d+\.\d+\.\d+", by[100 + i]["text"])[0] for i in range(300)}
    assert len(set(mails)) == 300 and len(addresses) == len({f"10.0.{i % 9}.{i}" for i in range(300)})
    again = {r["doc_id"]: r["text"] for r in pii.replace_personal_data(table(spark, rows), "k").collect()}
    assert again == {k: r["text"] for k, r in by.items()}
    assert pii.replace_personal_data(table(spark, rows).limit(0), "k").count() == 0


def test_secrets_of_either_case(spark):
    """An upper-cased token is the entity of its original, also one that begins like an IBAN; no spelling stays."""
    tokens = ["9233a8ecf7c5b09fe5949719b6b82bc439e9329b", "de89370400440532013000aabbccddee"]
    rows = [(10 * k + i, f'TOKEN = "{f}" and {f}.') for k, t in enumerate(tokens) for i, f in enumerate((t, t.upper(), t[:20].upper() + t[20:]))]
    by = {r["doc_id"]: r for r in pii.replace_personal_data(table(spark, rows), "k").collect()}
    for k, t in enumerate(tokens):
        low, up, mixed = (re.search(r"[0-9A-Fa-f]{32,}", by[10 * k + i]["text"])[0] for i in range(3))
        assert all(by[10 * k + i]["n_mentions"] == 2 and t not in by[10 * k + i]["text"].lower() for i in range(3))
        assert low == low.lower() and up == low.upper() and mixed.lower() == low and len(low) == len(t)


def test_surrogates_that_meet_are_hashed_again(spark):
    names = [("family", chr(97 + i)) for i in range(18) if chr(97 + i) not in "aeiou"]
    df = spark.createDataFrame(names, "kind string, norm string")
    got = [r["surrogate"] for r in pii.distinct_surrogates(df, "k").collect()]
    assert len(got) == len(set(got)) == len(names) and not set(got) & {n for _, n in names}


def test_names_and_numbers(spark):
    """Names by list, title and cue, their parts alone, and what is no name and no card."""
    rows = [
        (1, "Joseph Miller and Nancy Drew came. Later Joseph left; Miller's hat stayed with Drew."), (2, "Anna Schmidt met us. Later Anna left."), (3, "Yesterday Anna O'Brien-Smith met Dr. Quincy."),
        (4, "My name is Xaver Huber. Xaver likes the General Public License and New Zealand."), (5, "Anna alone is no mention, nor is order 9807915762804490."), (6, "Card 4539148803436467, order 9807915762804490."),
        (7, "Dr. Quincy called. Quincy again."), (8, "Schmidt Anna Schmidt"),
    ]
    by = {r["doc_id"]: r for r in pii.replace_personal_data(table(spark, rows), "k").collect()}
    given, text = pii.given_names("k"), {i: r["text"] for i, r in by.items()}
    assert all(a != b for a, b in given.items()) and sorted(given) == sorted(given.values())
    m = re.fullmatch(r"(\w+) (\w+) and (\w+) (\w+) came\. Later (\w+) left; (\w+)'s hat stayed with (\w+)\.", text[1])
    assert m and m[1] == m[5] == given["Joseph"] and m[2] == m[6] != "Miller" and m[3] == given["Nancy"] and m[4] == m[7] != "Drew" and by[1]["n_mentions"] == 5
    schmidt = re.fullmatch(rf"{given['Anna']} (\w+) met us\. Later {given['Anna']} left\.", text[2])[1]
    assert schmidt != "Schmidt" and text[8] == f"{schmidt} {given['Anna']} {schmidt}"
    quincy = re.fullmatch(r"Dr\. (\w+) called\. (\w+) again\.", text[7])
    assert quincy and quincy[1] == quincy[2] != "Quincy"
    assert re.fullmatch(rf"Yesterday {given['Anna']} \w'\w+-\w+ met Dr\. {quincy[1]}\.", text[3]) and "Brien" not in text[3]
    m = re.fullmatch(r"My name is (\w+) (\w+)\. (\w+) likes the General Public License and New Zealand\.", text[4])
    assert m and m[1] == m[3] != "Xaver" and m[2] != "Huber"
    assert text[5] == rows[4][1] and by[5]["n_mentions"] == 0
    assert text[6].endswith(", order 9807915762804490.") and "4539148803436467" not in text[6] and by[6]["n_mentions"] == 1


def test_surrogates_against_brute_force(spark):
    """Everything but the mentions of a plainly written detector stays, and what replaces them is a one-to-one map."""
    find = re.compile(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+|(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)|(?<!\w)\+1 \(\d{3}\) \d{3}-\d{4}(?!\d)|(?<![\w])[0-9a-f]{40}(?!\w)")
    rng, rows = random.Random(41), []
    kinds = [lambda i: f"u.{i % 30}@host{i % 7}.example.com", lambda i: f"10.{i % 9}.{i % 30}.7", lambda i: f"+1 (415) 555-{1000 + i % 40}", lambda i: hashlib.sha1(str(i % 25).encode()).hexdigest()]
    for i in range(400):
        w = words(rng, 30).split()
        for k in rng.sample(range(30), rng.randint(0, 3)):
            w[k] = rng.choice(kinds)(rng.randrange(1000)) + rng.choice(["", ",", "."])
        rows.append((i, " ".join(w)))
    got, pairs = {r["doc_id"]: r for r in pii.replace_personal_data(table(spark, rows), "k").collect()}, {}
    for i, t in rows:
        old, new = find.findall(t), find.findall(got[i]["text"])
        assert len(old) == len(new) == got[i]["n_mentions"] and find.split(t) == find.split(got[i]["text"])
        for a, b in zip(old, new):
            assert pairs.setdefault(a, b) == b and a != b
    assert len(set(pairs.values())) == len(pairs) and not set(pairs) & set(pairs.values())


#: Columns, in their order and with their types, that the contracts fix.
CONTRACTS = {
    "op1_simhash": "doc_id bigint, fingerprint string, component_id bigint", "op2_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean", "op4_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op5_html": "page_id bigint, url string, text string, n_chars bigint", "op6_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op9_windows": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string", "op10_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
}


def test_registered_queries(spark, tmp_path):
    """Columns and values of the contracts, through the queries."""
    assert list(queries.QUERIES) == [next(q for q in queries.QUERIES if q.startswith(f"op{n}_")) for n in range(1, 14)]
    rows, folder = corpus(), str(tmp_path)
    docs = table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{folder}/documents.parquet")
    items = [(1, " ".join(split(rows[3][1] or "a b")[:20])), (2, "w3 w9")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(d, 1, d % 2) for d, _ in rows[:40] if d is not None], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, [float(i % 7), 0.5, float(i % 3)]) for i in range(120)], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(i, f"u{i}", p) for i, (p, _) in enumerate(BY_HAND)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    got = {}
    for name, want in CONTRACTS.items():
        out = queries.QUERIES[name](spark, folder)
        assert [", ".join(f"{c} {t}" for c, t in out.dtypes)] == [want], name
        got[name] = [r.asDict() for r in out.collect()]
    ids = Counter(d for d, _ in rows)
    assert all(Counter(r["doc_id"] for r in got[n]) == ids for n in CONTRACTS if "doc_id" in CONTRACTS[n])
    prints = defaultdict(set)
    for d, t in rows:
        prints[d].add(f"{brute_print(t):016x}")
    assert all(r["fingerprint"] in prints[r["doc_id"]] for r in got["op1_simhash"])
    assert all(r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got["op2_toxicity"])
    want = Counter((d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), c) for (d, n, h, i, c), k in brute_contamination(rows, items).items() for _ in range(k))
    assert Counter(tuple(r.values()) for r in got["op3_decontaminate"]) == want
    assert Counter(r["query_id"] for r in got["op4_topk"]) == {0: 5, 50: 5, 100: 5}
    assert all(r["n_chars"] == len(r["text"]) for r in got["op5_html"]) and len(got["op5_html"]) == len(BY_HAND)
    assert all(r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < 16 for r in got["op10_sharding"])
    kept = Counter((d, n, g, hashlib.sha256(k.encode()).hexdigest()) for (d, n, g, k), c in brute_windows(rows, 20).items() for _ in range(c))
    assert Counter(tuple(r.values()) for r in got["op9_windows"]) == kept
    assert queries.QUERIES["op7_suffixes"](spark, folder).columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"]
    assert queries.QUERIES["op8_pii"](spark, folder).columns == ["doc_id", "text", "n_mentions"]


def test_pipeline_stages_on_awkward_tables(spark, tmp_path):
    """Each stage of the pipeline on nulls, repeats, very long texts and clashing columns against brute force, and on an empty table."""
    import corpus_pipeline

    rng, rows = random.Random(21), corpus(4)
    rude = [(2000 + i, words(rng, 30) + " dimwit " + words(rng, 10)) for i in range(150)]
    plain = [(3000 + i, words(rng, 40)) for i in range(600)]
    items = [(i, words(rng, 16)) for i in range(5)] + [(9, None)]
    leaks = [(4000 + i, words(rng, 20 + 900 * (i % 2)) + " " + items[i % 5][1] + " " + words(rng, 8)) for i in range(20)]
    rows += rude + plain + leaks + [(None, None), (None, leaks[0][1])]
    docs, folder = table(spark, rows), str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 1, int(2000 <= d < 3000)) for d, _ in rude + plain], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/out/{name}")
        docs = got[name] = spark.read.parquet(f"{folder}/out/{name}")
        assert docs.columns[: len(got[""].columns)] == got[""].columns
    ids = {name: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()] for name, df in got.items()}
    assert Counter(ids["toxicity"]) == Counter(ids[""]) - Counter(r for r in ids[""] if "dimwit" in (r[1] or ""))
    best = {}
    for d, t, _, c in brute_groups(ids["toxicity"]):
        best.setdefault(c, []).append((d is None, d or 0))
    kept = {t or "": (d is None, d or 0) for d, t in ids["near_duplicates"]}
    assert len(kept) == len(ids["near_duplicates"]) == len(best) and Counter(kept.values()) == Counter(min(v) for v in best.values())
    bad = {k[0] for k in brute_contamination(ids["near_duplicates"], items) if k[2]}
    assert Counter(ids["decontamination"]) == Counter(r for r in ids["near_duplicates"] if r[0] not in bad) and len(bad) >= 19
    plan = {(r["doc_id"], r["size"]): r["copies"] for r in mixing.mix_documents(got["decontamination"]).collect()}
    assert Counter(ids["mixing"]) == Counter({(d, t): plan[d, len(split(t))] for d, t in ids["decontamination"] if plan[d, len(split(t))]})
    assert Counter(ids["sharding"]) == Counter(ids["mixing"])
    sizes = [r["count"] for r in got["sharding"].groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "text", "lang", "source", "size", "text_crc32", "shard", "slot"} <= set(out.columns)
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and [n for n, _ in corpus_pipeline.STAGES][1] == "near_duplicates"
