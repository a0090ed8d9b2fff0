"""As-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revpanel.functions.time import PanelError


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, unmatched: str = "keep") -> DataFrame:
    """Each left row with the right row of the same ``by`` whose ``on`` is the largest not above its own.

    Both sides go through one shuffle and one sort, as a union over which the last right row is carried forward; there is
    no nested loop. Rows without a match have nulls; ``unmatched="drop"`` removes them and "error" refuses them.
    """
    if unmatched not in ("keep", "drop", "error"):
        raise PanelError("unmatched must be keep, drop or error")
    extra = [c for c in right.columns if c not in (*by, on)]
    if clash := set(extra) & set(left.columns):
        raise PanelError(f"columns on both sides: {sorted(clash)}")
    mine = [c for c in left.columns if c not in (*by, on)]
    l = left.select(*by, on, F.struct(*[F.col(c) for c in mine], F.lit(1).alias("__x")).alias("__l"), F.lit(1).alias("__side"))  # noqa: E741
    r = right.select(*by, on, F.struct(*[F.col(c) for c in extra], F.lit(1).alias("__x")).alias("__r"), F.lit(0).alias("__side"))
    w = Window.partitionBy(*by).orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("__r", F.last("__r", True).over(w)).where("__side = 1")
    if unmatched == "drop":
        both = both.where("__r is not null")
    elif unmatched == "error":
        both = both.withColumn("__r", F.when(F.col("__r").isNull(), F.raise_error(F.lit("a row has no match"))).otherwise(F.col("__r")))
    values = {c: F.col(f"__l.{c}") for c in mine}
    return both.select(*[values.get(c, F.col(c)).alias(c) for c in left.columns], *[F.col(f"__r.{c}").alias(c) for c in extra])
