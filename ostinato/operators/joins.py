"""Joins that a plain equality can't state, planned without nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, other: str, tolerance: float) -> DataFrame:
    """Pairs with equal keys and |left.at - right.other| <= tolerance; columns of right are prefixed with ``r_``.

    Both sides get a bucket floor(x / width); the right side stands in three buckets, so the join is one on equality and a
    crowded key spreads over its buckets.
    """
    width = tolerance * 4
    held = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    low, high = (F.floor((F.col(f"r_{other}") + d) / width) for d in (-tolerance, tolerance))
    spread = held.withColumn("_bucket", F.explode(F.when(low == high, F.array(low)).otherwise(F.array(low, high))))
    probe = left.withColumn("_bucket", F.floor(F.col(at) / width))
    same = [F.col(k) == F.col(f"r_{k}") for k in keys]
    joined = probe.join(spread.withColumnRenamed("_bucket", "_near"), [*same, F.col("_bucket") == F.col("_near")])
    return joined.where(F.abs(F.col(at) - F.col(f"r_{other}")) <= tolerance).drop("_bucket", "_near")


def merged(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on equality that is planned as a merge at every size. Generators make many rows of few, which the planner's estimates
    don't count: it would broadcast frames by the size of the notes they come from."""
    return left.join(right.hint("merge"), keys, how)


def interval_frames(intervals: DataFrame, first: Column, last: Column) -> DataFrame:
    """One row per interval and whole number in [first, last]: a range join with a frame clock, as a generator."""
    return intervals.withColumn("frame", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str, columns: list[str]) -> DataFrame:
    """Each left row with the columns of the last right row that starts at or before it: one sort of both sides together."""
    from pyspark.sql import Window as W

    payload = F.struct(*[F.col(c) for c in columns])
    marks = right.select(*keys, F.col(start).alias("_t"), F.lit(0).alias("_k"), payload.alias("_p"), F.lit(None).alias("_row"))
    rows = left.select(
        *keys, F.col(at).alias("_t"), F.lit(1).alias("_k"), F.lit(None).alias("_p"), F.struct(*left.columns).alias("_row")
    )
    order = W.partitionBy(*keys).orderBy("_t", "_k").rowsBetween(W.unboundedPreceding, 0)
    both = marks.unionAll(rows).withColumn("_last", F.last("_p", ignorenulls=True).over(order)).where("_k = 1")
    return both.select("_row.*", *[F.col("_last")[c].alias(c) for c in columns])
