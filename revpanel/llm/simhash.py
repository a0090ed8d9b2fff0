"""SimHash near-duplicates found with pivot distance tables.

The table of a fingerprint holds its Hamming distances to a number of reference fingerprints (the pivots). By the triangle
inequality the largest difference between two fingerprints' coordinates is a lower bound of the bits in which they
differ: pairs over the limit are discarded by it, and the survivors are verified on the fingerprints themselves.

Pairs are looked at only within buckets. For links of d bits or fewer (``simhash_classes``) the references are cut into the
blocks of the fingerprints: two fingerprints within d bits have the same distances to all references in all but d
blocks, so rows meet that agree in the coordinates of ``agree`` blocks. For a similarity of 0.8 (``near_duplicate_groups``),
where a fifth of the bits may differ, texts meet that share one of their least five-word runs, and the references of a
bucket are members of it. No bucket emits all its pairs, only links that span what is connected in it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revpanel.llm.common import WordHasher, alnum_words, cursors, cut, forget, grouped_batches, lower_words, mapped, mix64, plain_words, rolling, shingle_hashes
from revpanel.llm.graph import components, least_reached

#: Members of one bucket tile; larger buckets are dealt out over tiles.
TILE = 256
#: Tiles that are set against each other, at most: no member is there more often, however large its bucket is.
AGAINST = 16
#: References of a bucket, where these are members of it.
REFERENCES = 4
#: Keys by which ids meet before all others.
FIRST = 3
_CHUNK = 255 * 64


#: For each byte, its eight bits as the bytes of one number, the highest bit first: sums of up to 255 rows count bits side by side.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def fingerprint(hashes: np.ndarray, bits: int = 64) -> np.ndarray:
    """uint64[bits // 64], first word first: a bit is 1 if set in over half of the hashes.

    Words after the first use remixed hashes. No hashes give zeros.
    """
    words = bits // 64
    if not len(hashes):
        return np.zeros(words, np.uint64)
    counts = np.zeros(bits, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        rows = np.stack([part, *(mix64(part ^ np.uint64(0xA24BAED4963EE407 * k & (1 << 64) - 1)) for k in range(1, words))], 1)
        lanes = _LANES[rows.byteswap().view(np.uint8)]
        for i in range(0, len(part), 255):
            counts += lanes[i : i + 255].sum(0).view(np.uint8)
    return np.packbits(counts * 2 > len(hashes)).view(">u8").astype(np.uint64)


def with_fingerprints(docs: DataFrame, shingle: int = 3, lower: bool = True, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp long): 64-bit SimHash of every whole text. Null and empty texts have fingerprint 0."""
    split = lower_words if lower else plain_words

    def prints(texts: pa.Array) -> list:
        fps = (fingerprint(shingle_hashes(split(t.as_py()), shingle))[0] for t in texts)
        return [np.fromiter(fps, np.uint64, len(texts)).view(np.int64)]

    return mapped(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t")), ["t"], "fp long", lambda: prints)


@dataclass(frozen=True)
class PivotPlan:
    """Reference fingerprints, the blocks into which they and all others are cut, and how many blocks must agree."""

    bits: int = 64
    blocks: int = 5
    agree: int = 2
    pivots: int = 32
    seed: int = 11
    widths: tuple[int, ...] = field(init=False)
    combos: tuple[tuple[int, ...], ...] = field(init=False)

    def __post_init__(self):
        w = [self.bits // self.blocks + (b < self.bits % self.blocks) for b in range(self.blocks)]
        if max(w) > 16:
            raise ValueError("blocks of over 16 bits have no table")
        object.__setattr__(self, "widths", tuple(w))
        object.__setattr__(self, "combos", tuple(itertools.combinations(range(self.blocks), self.agree)))

    @classmethod
    def exact(cls, n: int, max_bits: int = 3, bits: int = 64) -> PivotPlan:
        """Lossless plan for n fingerprints: more blocks as n grows, so that chance meetings stay rare."""
        blocks = max_bits + 2
        while blocks < max_bits + 6 and (blocks - max_bits) * bits / blocks < np.log2(max(n, 2)) + 2:
            blocks += 1
        return cls(bits=bits, blocks=blocks, agree=blocks - max_bits)

    def references(self) -> np.ndarray:
        """uint64[pivots, bits // 64]: random fingerprints."""
        return np.random.default_rng(self.seed).integers(0, 1 << 64, (self.pivots, self.bits // 64), dtype=np.uint64)

    def tables(self) -> list[np.ndarray]:
        """Per block: int8[2**width, pivots], the distance of every block value to that block of every reference."""
        refs = self.split(self.references())
        return [np.bitwise_count(np.arange(1 << w, dtype=np.uint32)[:, None] ^ refs[None, :, b]).astype(np.int8) for b, w in enumerate(self.widths)]

    def split(self, fps: np.ndarray) -> np.ndarray:
        """uint64[n, words] -> block values uint32[n, blocks]."""
        bits = np.unpackbits(np.ascontiguousarray(fps).byteswap().view(np.uint8).reshape(len(fps), -1), axis=1)[:, : self.bits]
        out, at = np.zeros((len(fps), self.blocks), np.uint32), 0
        for b, w in enumerate(self.widths):
            for j in range(w):
                out[:, b] = (out[:, b] << np.uint32(1)) | bits[:, at + j]
            at += w
        return out

    def keys(self, fps: np.ndarray) -> np.ndarray:
        """int64[n, combos]: a digest of the combination and of the coordinates of its blocks."""
        digests = []
        for table in self.tables():
            d = np.full(len(table), 0x1F83D9ABFB41BD6B, np.uint64)
            for j in range(table.shape[1]):
                d = mix64(d * np.uint64(31) + table[:, j].astype(np.uint64))
            digests.append(d)
        values = self.split(fps)
        out = np.empty((len(fps), len(self.combos)), np.uint64)
        for c, combo in enumerate(self.combos):
            k = np.full(len(fps), c + 1, np.uint64)
            for b in combo:
                k = mix64(k * np.uint64(0x9E3779B97F4A7C15) + digests[b][values[:, b]])
            out[:, c] = k
        return out.view(np.int64)


def distances(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """int16[n, pivots]: the pivot table."""
    return np.stack([np.bitwise_count(fps ^ r).sum(1, dtype=np.int16) for r in refs], 1)


def linked_pairs(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, max_bits: int) -> np.ndarray:
    """Which of the pairs (i, j) are links: first by the pivot table, then by the fingerprints."""
    near = np.arange(len(i))
    for p in range(0, table.shape[1], 8):
        a, b = table[i[near], p : p + 8], table[j[near], p : p + 8]
        near = near[np.abs(a - b).max(1, initial=0) <= max_bits]
    far = np.bitwise_count(fps[i[near]] ^ fps[j[near]]).sum(1, dtype=np.int64)
    out = np.zeros(len(i), bool)
    out[near[far <= max_bits]] = True
    return out


def _words(blobs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint64).reshape(len(blobs), -1)


def _in_buckets(rows: DataFrame, max_bits: int, refs: np.ndarray | None) -> DataFrame:
    """(key, t1, t2, id, comp, fp) -> (a, b): comps that are linked, spanning what is connected in each bucket (key, t1, t2).

    Pairs of one comp are not looked at. A bucket has at most one row for each of its comps but one, however many members are
    linked. Without ``refs``, members of each bucket are its references.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in grouped_batches(batches, ["key", "t1", "t2"]):
            comp, fps = pdf["comp"].to_numpy(np.int64), _words(pdf["fp"])
            group = (pdf[["key", "t1", "t2"]].ne(pdf[["key", "t1", "t2"]].shift())).any(axis=1).to_numpy().cumsum()
            starts, ends = cursors(group)
            size = ends - starts
            # The members of one comp in a bucket are one node, the least comp first.
            order = np.lexsort((comp, group))
            fresh = np.r_[True, (group[order][1:] != group[order][:-1]) | (comp[order][1:] != comp[order][:-1])]
            node, names = np.empty(len(comp), np.int64), comp[order][fresh]
            node[order] = fresh.cumsum() - 1
            if refs is not None:
                table = distances(fps, refs)
            else:
                first, last = np.repeat(starts, size), np.repeat(ends - 1, size)
                table = np.stack([np.bitwise_count(fps ^ fps[np.minimum(first + r, last)]).sum(1, dtype=np.int16) for r in range(REFERENCES)], 1)
            left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

            def look(i: np.ndarray, j: np.ndarray) -> None:
                open_ = node[i] != node[j]
                i, j = i[open_], j[open_]
                ok = linked_pairs(fps, table, i, j, max_bits)
                left.append(node[i[ok]])
                right.append(node[j[ok]])

            # Buckets of up to 8: all pairs at once, one distance in the order after the other.
            small = np.repeat(size <= 8, size)
            for step in range(1, min(8, len(group))):
                i = np.flatnonzero(small[:-step] & (group[:-step] == group[step:]))
                look(i, i + step)
            for s, e in zip(starts[size > 8], ends[size > 8]):
                # In slabs, so that the pairs of a bucket of any size take bounded memory.
                for at in range(s, e, TILE):
                    for to in range(at, e, 2 * TILE):
                        i, j = np.meshgrid(np.arange(at, min(at + TILE, e)), np.arange(to, min(to + 2 * TILE, e)), indexing="ij")
                        look(i[i < j], j[i < j])
            # One row for each node that is not the least of its component, however many links it has.
            root = least_reached(len(names), np.concatenate(left), np.concatenate(right))
            at = np.flatnonzero(root != np.arange(len(names)))
            if len(at):
                yield pd.DataFrame({"a": names[root[at]], "b": names[at]}).drop_duplicates()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "t1", "t2").sortWithinPartitions("key", "t1", "t2", "id").mapInPandas(run, "a long, b long")


def _labelled(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows with the comp of their id, which is the id itself where it has no links."""
    return rows.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def linked(keys: DataFrame, items: DataFrame, max_bits: int, refs: np.ndarray | None = None) -> DataFrame:
    """keys (key long, id long), items (id long, fp binary), ids distinct -> (node long, comp long): components of links.

    Ids that share a key and whose fingerprints differ in ``max_bits`` or fewer bits are linked. Ids alike share many keys, so
    they meet first by the FIRST keys of the least hashes of each; a bucket of over TILE members is then dealt over tiles, with one
    member as the lead in all of them. After that a bucket is looked at, once, where its members are not all connected: whole, if it
    has up to TILE members. In a larger one those connected with the lead are set against the others, and the others
    against each other, in tiles whose number is the root of that of whole tiles, AGAINST at most: a bucket's rows are 2 * AGAINST
    times its members at most, its pairs are looked at in the tasks. What is connected already is one node for the links that
    are found then. Nodes without links are not in the result.
    """
    tiles = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    few = lambda n: F.greatest(F.lit(1), F.least(F.ceil(F.sqrt(F.col(n) / TILE)), F.lit(AGAINST))).cast("int")
    own = lambda c: F.pmod(F.xxhash64("key", "id"), F.col(c)).cast("int")
    prints = items.select("id", "fp")
    columns = ["key", "t1", "t2", "id", "comp", "fp"]
    look = lambda rows: _in_buckets(rows.select(*columns), max_bits, refs)
    # Partial counts, so a hot bucket is one row per task.
    lead = F.min_by("id", F.xxhash64("key", "id")).alias("lead")
    # Buckets of the same members (128 bits of them) are one: runs of one passage, say, bring the same texts together.
    same = [F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"s{k}") for k in (1, 2)]
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), lead, *same).where("n > 1")
    sizes = sizes.groupBy("n", "s1", "s2").agg(F.min("key").alias("key"), F.min_by("lead", "key").alias("lead"))
    sizes = cut(sizes.select("key", "lead", tiles("n").alias("c")))
    members = cut(keys.join(sizes, "key").select("key", "id", "c", (F.col("id") == F.col("lead")).alias("leads"), own("c").alias("t")))
    # The first keys, each id by itself.
    drawn = F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("key").alias("h"), "key", "t"))), 1, FIRST)
    drawn = members.groupBy("id").agg(F.explode(drawn).alias("k")).select("k.key", "id", "k.t")
    leads = sizes.where("c > 1").select("key", F.col("lead").alias("id"), F.explode(F.expr("sequence(0, c - 1)")).alias("t"))
    met = drawn.union(leads).join(prints, "id")
    comp = components(look(met.select("key", F.col("t").alias("t1"), F.lit(0).alias("t2"), "id", F.col("id").alias("comp"), "fp")))
    # All keys: buckets whose members are not all connected, and of these the pairs of different components.
    placed = cut(_labelled(members.select("key", "id", "c", "leads"), comp))
    parts = placed.groupBy("key", "comp").agg(F.count("*").alias("n"), F.max("leads").alias("main"), F.max("c").alias("c"))
    of = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0))
    mixed = parts.groupBy("key").agg(F.max(F.when(F.col("main"), F.col("comp"))).alias("major"), of(F.col("main")).alias("n1"), of(~F.col("main")).alias("n2")).where("n2 > 0")
    mixed = mixed.select("key", "major", few("n1").alias("c1"), few("n2").alias("c2"))
    rows = cut(placed.join(mixed, "key").join(prints, "id").select("key", "id", "comp", "fp", "c", "c1", "c2", (F.col("comp") == F.col("major")).alias("main")))
    forget(sizes, members, placed)
    found = look(rows.where("c = 1").withColumns({"t1": F.lit(0), "t2": F.lit(0)}))
    large = rows.where("c > 1")
    if not large.isEmpty():
        ones = large.where("main").withColumns({"t1": own("c1"), "t2": F.explode(F.expr("sequence(0, c2 - 1)"))})
        others = large.where("not main").withColumn("t", own("c2"))
        against = others.withColumns({"t1": F.explode(F.expr("sequence(0, c1 - 1)")), "t2": F.col("t")})
        between = others.withColumn("u", F.explode(F.expr("sequence(0, c2 - 1)"))).where("t != u")
        between = between.withColumns({"t1": -1 - F.least("t", "u"), "t2": F.greatest("t", "u")})
        found = found.union(look(ones.select(*columns).union(against.select(*columns)).union(between.select(*columns))))
    more = components(found)
    forget(rows)
    # A component of the first links and what it is now part of; nodes that had none.
    joined = more.select(F.col("node").alias("comp"), F.col("comp").alias("into"))
    out = comp.join(joined, "comp", "left").select("node", F.coalesce("into", "comp").alias("comp"))
    return out.union(more.join(comp.select("node"), "node", "left_anti"))


def simhash_classes(docs: DataFrame, shingle: int = 3, max_bits: int = 3, lower: bool = True, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp long, component_id): near-duplicate classes of whole texts, one row per document.

    Texts link at ``max_bits`` or fewer differing bits; component_id is the smallest doc_id reachable. Every
    link is found. Null or empty texts have fingerprint 0 and link like any other; rows that repeat a doc_id
    or a text are kept, each with its class; a null doc_id is never the smallest unless the class has no
    other. An empty table gives an empty result; columns other than the two are not read.
    """
    prints = cut(with_fingerprints(docs, shingle, lower, text, doc_id))
    # Exact copies fall together here, before any pair is looked at.
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    plan = PivotPlan.exact(distinct.count(), max_bits)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["fp"], "fp": [x.tobytes() for x in pdf["fp"].to_numpy()]})

    found = linked(block_keys(distinct.select("fp"), plan), distinct.select("fp").mapInPandas(packed, "id long, fp binary"), max_bits, plan.references())
    tagged = cut(distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp")))
    roots = cut(tagged.groupBy("comp").agg(F.min("least").alias("component_id")))
    labels = cut(tagged.join(roots, "comp").select("fp", "component_id"))
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def block_keys(prints: DataFrame, plan: PivotPlan) -> DataFrame:
    """(fp long) -> (key long, id long): a row for each combination of blocks, id being the fingerprint."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                ids = pdf["fp"].to_numpy()[at : at + 4096]
                k = plan.keys(ids.view(np.uint64).reshape(-1, 1))
                yield pd.DataFrame({"key": k.ravel(), "id": np.repeat(ids, k.shape[1])})

    return prints.mapInPandas(keyed, "key long, id long")


#: Bits of the fingerprints of near_duplicate_groups; the runs by which a text is looked up, of each kind; its least runs that are counted.
NEAR_BITS, LEAST_RUNS, COUNTED_RUNS = 512, 32, 64
#: Runs counted in over one of so many texts, and in more than a tile holds, are common.
COMMON = 4096


def near_limit(similarity: float) -> int:
    """The bits by which two fingerprints of a cosine of ``similarity`` differ, and two standard deviations of that more.

    Without the margin half of the pairs just at ``similarity`` would be lost; with it 2 in 100 are.
    """
    share = np.arccos(similarity) / np.pi
    return int(NEAR_BITS * share + 2 * np.sqrt(NEAR_BITS * share * (1 - share)))


def _runs(words: list[bytes], hasher: WordHasher, shingle: int) -> np.ndarray:
    """Hashes of the different runs of a text, ascending; fewer words are one run."""
    return np.unique(rolling(hasher(words), min(shingle, len(words)))) if words else np.empty(0, np.uint64)


def common_runs(items: DataFrame) -> np.ndarray:
    """int64, ascending: the runs that are among the least of more than TILE texts and of over one of COMMON.

    ``items`` has the COUNTED_RUNS least runs of each different text (``runs``). The result is at most COMMON * COUNTED_RUNS
    numbers, whatever the number of texts.
    """
    limit = max(TILE, items.count() // COMMON)
    counted = items.select(F.explode("runs").alias("run")).groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return np.sort(np.array([r["run"] for r in counted.select("run").collect()], np.int64))


def _look_up(runs: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The runs of a text by which it is looked up, of its least ones (ascending): LEAST_RUNS that are not common, and as many common ones if these are over two sevenths.

    Runs are in random order. Of the union of two texts' runs at least 0.64 are shared at a cosine of 0.8, so that their LEAST_RUNS
    least share none with a probability under 0.36**32 = 7e-15; texts with many common runs are looked up by all of these. As for the
    others: where at least 0.35 of the runs of the union that are not common are shared, the probability is under 0.65**32 = 1e-6.
    Where they are fewer, common ones are at least 0.446 of the union and of each of the two texts (0.64 - 0.35 r is at most
    1 - r for a share r of others), more than two sevenths by the error of an estimate from COUNTED_RUNS.
    """
    often = common[np.minimum(np.searchsorted(common, runs), len(common) - 1)] == runs if len(common) else np.zeros(len(runs), bool)
    out = runs[~often][:LEAST_RUNS]
    return np.concatenate([out, runs[often][:LEAST_RUNS]]) if 7 * often.sum() > 2 * len(runs) else out


def near_duplicate_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, h1 long, h2 long, group_id, keep boolean): groups of documents alike by 0.8 or more, one row per document.

    Alike are texts whose 512-bit SimHash fingerprints of their different five-word runs may have a cosine of ``similarity`` or more: they
    differ in ``near_limit`` bits at most (122 for 0.8). Words are lower-cased runs of ASCII letters, digits and all other characters from U+0080 on, so
    that case and punctuation hide no copy; fewer words make one run. Candidates share one of the runs of
    ``_look_up``, 2 * LEAST_RUNS at most for a text of any length; which runs are common is counted over all different texts.

    Exact copies meet first, by 128 bits of their text, and are alike whatever they hold; a null text is an empty one. Texts
    without words are like their copies only. group_id is the smallest doc_id of the group, null if it has no
    other. ``keep`` marks the rows of one doc_id and text of each group: the smallest doc_id, nulls last. Rows that repeat a
    doc_id are grouped by their texts. An empty table gives an empty result; columns other than the two are not read.
    """
    limit = near_limit(similarity)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("t"), *text_key(text))

    def start():
        hasher = WordHasher()

        def prints(texts: pa.Array) -> list:
            fps, least = [], []
            for t in texts:
                runs = _runs(alnum_words(t.as_py()), hasher, shingle)
                fps.append(fingerprint(runs, NEAR_BITS).tobytes())
                least.append((runs[:COUNTED_RUNS] >> np.uint64(1)).view(np.int64))
            return [fps, least]

        return prints

    every = mapped(texts, ["t"], "fp binary, runs array<long>", start)
    first = every.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("runs").alias("runs"))
    items = cut(first.withColumn("id", F.monotonically_increasing_id()))
    shared = docs.sparkSession.sparkContext.broadcast(common_runs(items))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = [_look_up(r, shared.value) for r in pdf["runs"]]
            yield pd.DataFrame({"key": np.concatenate([np.empty(0, np.int64), *keys]), "id": np.repeat(pdf["id"].to_numpy(), list(map(len, keys)))})

    found = linked(items.select("id", "runs").mapInPandas(keyed, "key long, id long"), items, limit)
    tagged = cut(items.select("id", "h1", "h2", "least").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id")))
    best = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("group_id"), F.col("id").alias("best"))).alias("b")
    roots = cut(tagged.groupBy("comp").agg(best).select("comp", "b.group_id", "b.best"))
    labels = cut(tagged.join(roots, "comp").select("h1", "h2", "group_id", (F.col("id") == F.col("best")).alias("best")))
    forget(items, tagged, roots)
    out = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), *text_key(text)).join(labels, ["h1", "h2"])
    return out.select("doc_id", "h1", "h2", "group_id", (F.col("best") & F.col("doc_id").eqNullSafe(F.col("group_id"))).alias("keep"))


def text_key(text: str) -> list[Column]:
    """Two independent hashes of a text (null as empty), 128 bits together."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return [F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2")]


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each near-duplicate group of ``near_duplicate_groups``, with all its columns.

    The row of the smallest doc_id stays; a null doc_id only where its group has no other. Of rows that repeat doc_id and
    text one stays; rows that repeat a doc_id with other texts belong to the groups of their texts. An empty table stays empty.
    """
    kept = near_duplicate_groups(docs, text=text, doc_id=doc_id).where("keep")
    stay = cut(kept.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.first("doc_id").alias("d")))
    names = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.select(F.struct(*names).alias("row"), F.col(f"`{doc_id}`").alias("d"), *text_key(text))
    same = (marked["h1"] == stay["h1"]) & (marked["h2"] == stay["h2"]) & marked["d"].eqNullSafe(stay["d"])
    one, twice = stay.where("n = 1").hint("shuffle_hash"), stay.where("n > 1")
    out = marked.join(one, same, "left_semi")
    if not twice.isEmpty():
        out = out.union(marked.join(twice, same, "left_semi").dropDuplicates(["h1", "h2"]))
    return out.select("row.*")
