"""Sharding by balanced label propagation (DataFrame functions only).

Documents with equal texts are linked. Each starts in the shard of its hash; then, in rounds, the documents of a group move
towards the shard in which most of their neighbours are, as far as the quota of that shard admits. Documents of
one group and shard are alike, so the rounds move counts of them, one row per group and shard. At the end
unlinked documents fill the shards to exactly equal numbers of rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revpanel.llm.common import cut, power_of_two


def numbered(rows: DataFrame, by: list[str], h: Column, ties: list[str], subs: int, name: str) -> DataFrame:
    """Gapless numbers from 0 within ``by``, in two levels: offsets of hash buckets, then a rank within a bucket."""
    rows = rows.withColumn("__sub", F.pmod(h, F.lit(subs)).cast("int"))
    counts = rows.groupBy(*by, "__sub").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counts.withColumn("__at", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"))
    rank = F.row_number().over(Window.partitionBy(*by, "__sub").orderBy(*ties)) - 1
    ranked = rows.withColumn("__rank", rank)
    return ranked.join(offsets, [*by, "__sub"]).withColumn(name, F.col("__at") + F.col("__rank")).drop("__sub", "__at", "__rank")


def _running(rows: DataFrame, amount: str, order: Column, subs: int) -> DataFrame:
    """Running sum of ``amount`` before each row within ``to``, in two levels."""
    rows = rows.withColumn("__sub", F.pmod(order, F.lit(subs)).cast("int"))
    sums = rows.groupBy("to", "__sub").agg(F.sum(amount).alias("__n"))
    w = Window.partitionBy("to").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(sums.withColumn("__at", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n"))
    inner = Window.partitionBy("to", "__sub").orderBy("gid", "shard").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    return rows.join(offsets, ["to", "__sub"]).withColumn("before", F.col("__at") + F.col("__in")).drop("__sub", "__at", "__in")


def propagate(cells: DataFrame, quota: Column, n_shards: int, rounds: int, subs: int) -> DataFrame:
    """(gid, shard, n) -> the same after ``rounds`` rounds of moves under the quotas."""
    spark = cells.sparkSession
    shards = spark.range(n_shards).select(F.col("id").cast("int").alias("shard"))
    for _ in range(rounds):
        # A document moves to a shard with more neighbours than its own, if that shard has room.
        used = shards.join(cells.groupBy("shard").agg(F.sum("n").alias("used")), "shard", "left").na.fill(0, ["used"])
        room = cut(used.withColumn("room", quota - F.col("used")))
        best = Window.partitionBy("gid")
        rank = F.struct("n", F.xxhash64("gid", "shard").alias("x"))
        open_ = cells.join(room, "shard")
        target = F.max(F.when(F.col("room") > 0, F.struct(rank["n"].alias("n"), rank["x"].alias("x"), F.col("shard").alias("shard")))).over(best)
        wish = open_.withColumn("t", target).select("gid", "shard", "n", F.col("t.shard").alias("to"), F.col("t.n").alias("tn"), F.col("t.x").alias("tx"))
        moves = wish.where((F.col("to") != F.col("shard")) & (F.struct("tn", "tx") > F.struct(F.col("n"), F.xxhash64("gid", "shard"))))
        moves = _running(cut(moves.select("gid", "shard", "to", "n")), "n", F.xxhash64("gid"), subs)
        admitted = F.greatest(F.lit(0), F.least(F.col("n"), F.col("room") - F.col("before")))
        moves = cut(moves.join(room.select(F.col("shard").alias("to"), "room"), "to").select("gid", "shard", "to", admitted.alias("m")).where("m > 0"))
        if moves.isEmpty():
            break
        delta = moves.select("gid", "shard", (-F.col("m")).alias("n")).union(moves.select("gid", "to", "m"))
        cells = cut(cells.union(delta).groupBy("gid", "shard").agg(F.sum("n").alias("n")).where("n > 0"))
    return cells


def shard_documents(docs: DataFrame, n_shards: int = 16, rounds: int = 10, text: str = "text", doc_id: str = "doc_id", row_id: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, gid (and ``row_id``): shards whose numbers of rows are at most one apart.

    Documents with equal texts stay together as far as a shard holds them; a group larger than a shard fills as few
    as it can. size is the UTF-8 bytes of the text plus 1. A null text has no bytes and is linked to nothing; empty
    texts are equal texts; rows that repeat are each placed; fewer rows than shards leave shards empty. slot counts
    from 0 in each shard without gaps. An empty table gives an empty result; other columns are not read.
    """
    body = F.col(f"`{text}`")
    blank = F.coalesce(body, F.lit(""))
    crc, size = F.crc32(blank.cast("binary")), (F.octet_length(blank) + 1).cast("long")
    gid = F.when(body.isNotNull(), F.xxhash64(body, crc, size))
    extra = [F.col(f"`{row_id}`").alias("rid")] if row_id else []
    base = cut(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), gid.alias("gid"), F.xxhash64(F.col(f"`{doc_id}`"), body, *extra).alias("h"), *extra))
    total = base.count()
    subs = power_of_two(total / 50_000, 16, 1 << 16)
    groups = cut(base.where("gid is not null").groupBy("gid").agg(F.count("*").alias("members")).where("members > 1"))
    # The same join at every size; AQE splits a group with very many members.
    joined = cut(base.join(groups.hint("shuffle_hash"), "gid", "left"))
    linked, single = joined.where("members is not null"), joined.where("members is null")
    quota = F.lit(total // n_shards) + (F.col("shard") < total % n_shards).cast("long")
    cells = cut(linked.groupBy("gid", F.pmod("h", F.lit(n_shards)).cast("int").alias("shard")).agg(F.count("*").alias("n")))
    cells = propagate(cells, quota, n_shards, rounds, subs)
    # Members of a group, numbered, fill the group's counts one shard after the other.
    upto = F.sum("n").over(Window.partitionBy("gid").orderBy(F.desc("n"), "shard"))
    ends = cut(cells.withColumn("upto", upto).groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("ends")))
    order = ["h", "doc_id", "size", *(["rid"] if row_id else [])]
    placed = numbered(linked, ["gid"], F.col("h"), order, 64, "i").join(ends.hint("shuffle_hash"), "gid")
    placed = cut(placed.withColumn("shard", F.expr("filter(ends, e -> i < e.upto)[0].shard")).drop("ends", "i"))
    # What a shard holds beyond its quota goes back, a group at a time, to the documents that may stand anywhere.
    # (A large group is dealt over many buckets.)
    # Each numbering has a hash of its own: what one has put in order is no longer spread by the same hash.
    again = lambda k: F.xxhash64("h", F.lit(k))
    bucket = F.when(F.col("members") > 256, again(1)).otherwise(F.xxhash64("gid"))
    placed = cut(numbered(placed, ["shard"], bucket, ["gid", *order], subs, "i").withColumn("over", F.col("i") >= quota).drop("members"))
    stay = placed.where("not over").drop("over", "i")
    free = single.drop("members").unionByName(placed.where("over").drop("over", "i", "shard"))
    held = {r["shard"]: r["held"] for r in stay.groupBy("shard").agg(F.count("*").alias("held")).collect()}
    # One number per shard: where in the numbering of the free rows its room ends.
    rooms = itertools.accumulate(total // n_shards + (s < total % n_shards) - held.get(s, 0) for s in range(n_shards))
    at = sum([(F.col("i") >= end).cast("int") for end in rooms], F.lit(0))
    rest = numbered(free.withColumn("all", F.lit(0)), ["all"], again(2), order, subs, "i").withColumn("shard", at).drop("i", "all")
    every = cut(stay.unionByName(rest))
    out = numbered(every, ["shard"], again(3), order, subs, "slot")
    names = ["doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), "gid"]
    return out.select(*names, *([F.col("rid").alias(row_id)] if row_id else []))


def edges_cut(placed: DataFrame) -> DataFrame:
    """One row for the result of ``shard_documents``: edges (pairs of equal texts) and how many of them lie between shards."""
    cells = placed.where("gid is not null").groupBy("gid", "shard").agg(F.count("*").alias("n"))
    of = cells.groupBy("gid").agg(F.sum("n").alias("all"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("inside"))
    edges = F.sum(F.col("all") * (F.col("all") - 1) / 2)
    return of.agg(F.coalesce(edges, F.lit(0.0)).alias("edges"), F.coalesce(edges - F.sum("inside"), F.lit(0.0)).alias("cut"))


def shard_rows(docs: DataFrame, n_shards: int = 16, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with all their columns, and size, text_crc32, shard and slot of ``shard_documents``.

    Columns of ``docs`` that have one of these names give way. Nulls, repeated rows and empty tables are as in ``shard_documents``.
    """
    new = ["size", "text_crc32", "shard", "slot"]
    names = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    rows = cut(docs.select(F.struct(*names).alias("row"), F.col(f"`{doc_id}`").alias("d"), F.monotonically_increasing_id().alias("rid")))
    short = rows.select("rid", "d", F.col(f"row.`{text}`").alias("t"))
    placed = shard_documents(short, n_shards, text="t", doc_id="d", row_id="rid").select("rid", *new)
    return rows.join(placed.hint("shuffle_hash"), "rid").select("row.*", *new)
