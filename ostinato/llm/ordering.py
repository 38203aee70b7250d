"""Positions and running totals inside groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ostinato.runtime import partitions, persist_table


def dealt_in_order(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df sorted by group and order over many partitions, written down, with ``_part`` and ``_at`` (place in the part).

    Range partitioning cuts a large group into several parts. The table is written, so places stay as they are even if
    tasks run again later.
    """
    n = partitions(df.sparkSession)
    keys = [*group, *order]
    placed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    return persist_table(placed, name).select(
        "*", F.shiftright("_id", 33).cast("int").alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_at")
    ).drop("_id")


def part_offsets(placed: DataFrame, group: list[str], total: F.Column, name: str) -> DataFrame:
    """Per part and group: the total of the group's rows in earlier parts. One row for each (part, group) that occurs."""
    sums = placed.groupBy("_part", *group).agg(total.alias("_sum"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return sums.select("_part", *group, F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("long").alias(name))
