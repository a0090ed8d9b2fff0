"""Mixing sources to target weights, with hash-threshold histograms (DataFrame functions only).

Words are summed by source and bucket of a hash of the document. The running sum over the buckets finds, per source,
the bucket in which the budget ends; only that bucket is summed again by finer buckets, and only the last of these
by the hashes themselves. What comes out is one threshold per source, and documents are taken by comparing their
hash with it; no rows are sorted. Budgets are nested: what the first threshold leaves over is filled from
documents that are no larger than the rest, with a threshold of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revpanel.llm.common import cut, forget

WORDS = r"[^\x20\x09-\x0D]+"
_BITS, _STEP = 62, 10


def ordered_sums(rows: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """With __row, the number of each row in the order (from 0), and __before_{name}, the sum of a column over the rows before it.

    Rows are dealt by ranges and numbered within their range; only one row per range is summed in one task.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("__range").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__sum_{c}") for c in sums])
    starts = totals.select("__range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_at") for c in ("__n", *(f"__sum_{c}" for c in sums))])
    within = Window.partitionBy("__range").orderBy(*order)
    inside = within.rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("__row", F.row_number().over(within) - 1).withColumns({f"__before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    out = out.join(starts, "__range")
    return out.select(*rows.columns, (F.col("__row") + F.col("__n_at")).alias("__row"), *[(F.col(f"__before_{c}") + F.col(f"__sum_{c}_at")).alias(f"__before_{c}") for c in sums])


def source_targets(sizes: DataFrame, share: float, weights: tuple[int, ...], most: float) -> DataFrame:
    """(k, source, source_size) -> with target: shares by weight, none above ``most`` times its source's size.

    With caps ordered by cap / weight, the level at which the rest divides evenly is found from running sums.
    """
    code_points = [F.col("source").isNull(), F.col("source")]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__row") % len(weights) + 1).cast("int"))
    rows = ordered_sums(sizes, code_points, []).withColumn("w", weight).drop("__row")
    rows = cut(rows.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w")))
    all_ = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()
    runs = ordered_sums(rows, [F.col("ratio"), *code_points], ["cap", "w"])
    level = (share * all_["n"] - F.col("__before_cap")) / (all_["w"] - F.col("__before_w"))
    first = runs.withColumn("level", level).where("level <= ratio").agg(F.min_by("level", "__row").alias("level")).first()["level"]
    return rows.select("k", "source_size", F.least("cap", F.coalesce(F.col("w") * F.lit(first).cast("double"), F.col("cap"))).alias("target"))


def _per_source(*tables: DataFrame) -> DataFrame:
    """Tables of at most one row per source beside each other: one aggregate of their union instead of joins."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t, allowMissingColumns=True)
    return every.groupBy("k").agg(*[F.max(c).alias(c) for c in every.columns if c != "k"])


def _boundary(hist: DataFrame, budget: DataFrame, bucket: str) -> DataFrame:
    """First bucket per source in which the running sum passes the budget, and what is left before it."""
    both = hist.unionByName(budget, allowMissingColumns=True)
    run = both.withColumn("upto", F.sum("n").over(Window.partitionBy("k").orderBy(bucket))).withColumn("budget", F.max("budget").over(Window.partitionBy("k")))
    run = run.where(f"upto > budget and {bucket} is not null")
    return run.groupBy("k").agg(F.min(bucket).alias(bucket), F.min_by(F.col("budget") - F.col("upto") + F.col("n"), bucket).alias("left"))


def threshold(rows: DataFrame, budget: DataFrame) -> DataFrame:
    """rows (k, h, size), budget (k, budget) -> (k, h_end, left): taking h < h_end comes closest to the budget from below.

    h_end is null where all rows fit.
    """
    first, second = F.shiftright("h", _BITS - _STEP), F.shiftright("h", _BITS - 2 * _STEP)
    hist = rows.groupBy("k", first.alias("b")).agg(F.sum("size").alias("n"))
    one = cut(_boundary(hist, budget, "b"))
    inside = rows.join(one.select("k", "b"), "k").where(first == F.col("b"))
    two = cut(_boundary(inside.groupBy("k", second.alias("c")).agg(F.sum("size").alias("n")), one.select("k", F.col("left").alias("budget")), "c"))
    inside = rows.join(two.select("k", "c"), "k").where(second == F.col("c"))
    three = _boundary(inside.groupBy("k", "h").agg(F.sum("size").alias("n")), two.select("k", F.col("left").alias("budget")), "h")
    sums = rows.groupBy("k").agg(F.sum("size").alias("all"))
    ends = _per_source(budget, three.withColumnRenamed("h", "h_end"), sums).where("budget is not null")
    out = cut(ends.select("k", "h_end", F.coalesce("left", F.col("budget") - F.coalesce("all", F.lit(0))).alias("left")))
    forget(one, two)
    return out


def mix_documents(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: float = 2.0, rounds: int = 4, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """How often each document is taken: doc_id, text_hash, size, source_size, target, copies, taken.

    Sources in code-point order (null last) weigh ``weights`` in turn and share ``share`` times all words; a target stops
    at ``most`` times its source's words and the excess is shared again by weight. Every document is taken
    floor(target / source_size) times, and once more if its hash is under its source's thresholds, so none is taken more
    than ceil(most) times and reruns agree. Null and empty texts have size 0 and take nothing; a null source is a source;
    rows that repeat a document share its hash and are taken together; an empty table gives an empty result.
    """
    body = F.col(f"`{text}`")
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`")), F.lit(""))
    h = F.shiftrightunsigned(F.xxhash64(F.col(f"`{doc_id}`"), body), 64 - _BITS)
    size = F.coalesce(F.regexp_count(body, F.lit(WORDS)), F.lit(0)).cast("long")
    rows = cut(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), key.alias("k"), h.alias("h"), size.alias("size")))
    sizes = rows.groupBy("k", "source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = cut(source_targets(sizes, share, weights, most).withColumn("whole", whole.cast("int")))
    budget = targets.select("k", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    ends, taken = [], F.lit(False)
    left = rows.select("k", "h", "size").where("size > 0")
    for _ in range(rounds):
        end = threshold(left, budget)
        ends.append(end)
        budget = end.select("k", F.col("left").alias("budget"))
        near = left.join(end, "k")
        left = cut(near.where((F.col("h") >= F.col("h_end")) & (F.col("size") <= F.col("left"))).select("k", "h", "size"))
    # One more document where it comes nearer than none.
    named = [end.select("k", F.coalesce("h_end", F.lit((1 << 63) - 1)).alias(f"e{i}"), F.col("left").alias(f"l{i}")) for i, end in enumerate(ends)]
    marks = _per_source(targets.select("k", "source_size", "target", "whole"), *named)
    for i in range(rounds):
        fits = F.col("size") <= F.col(f"l{i - 1}") if i else F.lit(True)
        taken = taken | (fits & (F.col("h") < F.col(f"e{i}")))
    marks = cut(marks)
    gap = F.col(f"l{rounds - 1}")
    rest = rows.join(marks, "k").where((F.col("size") > 0) & ~taken).groupBy("k", "h").agg(F.sum("size").alias("n"), F.first(gap).alias("gap"))
    last = cut(rest.where("n < 2 * gap").groupBy("k").agg(F.min(F.struct("n", "h"))["h"].alias("e_last")))
    out = rows.join(_per_source(marks, last), "k")
    copies = F.when(F.col("size") > 0, F.col("whole") + (taken | F.coalesce(F.col("h") == F.col("e_last"), F.lit(False))).cast("int")).otherwise(0)
    return out.withColumn("copies", copies).select("doc_id", "h", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The mixed corpus: each row as often as it is taken, with its own columns."""
    mixed = mix_documents(docs, text=text, doc_id=doc_id)
    plan = cut(mixed.groupBy("h").agg(F.max("copies").alias("copies")).where("copies > 0"))
    h: Column = F.shiftrightunsigned(F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), 64 - _BITS)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), h.alias("h"))
    return rows.join(plan.hint("shuffle_hash"), "h").select("row", F.explode(F.expr("sequence(1, copies)"))).select("row.*")
