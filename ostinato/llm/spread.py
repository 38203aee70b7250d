"""Joins in which one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.runtime import partitions


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], own: list[str], counts: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, keys of many left rows spread over several tasks.

    ``counts`` has one row per key with ``n``, about the number of left rows of the key. A key of more than a quarter of an even
    share of a task is hot: with P partitions there are at most 4 P of them, and only these, with their number of salts, are
    broadcast. A hot key's left rows are dealt to the salts by a hash of the ``own`` columns, its right rows are repeated for each
    salt; there are at most 8 P repeats of a key's right rows in all. Null keys meet nothing.
    """
    found = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    least = float(max(1.0, found["total"] / (4 * partitions(left.sparkSession))))
    if found["most"] <= least:  # no key is hot
        return left.join(right.hint("merge"), keys, how)
    names = [f"_hot{k}" for k in range(len(keys))]
    hot = F.broadcast(
        counts.where(F.col("n") > least).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.ceil(F.col("n") / least).cast("int").alias("_salts"))
    )

    def marked(df: DataFrame) -> DataFrame:
        on = [F.col(k) == F.col(n) for k, n in zip(keys, names, strict=True)]
        return df.join(hot, on, "left").drop(*names)

    one = marked(left).withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*own), F.col("_salts"))).cast("int"))
    every = F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0)))
    two = marked(right).withColumn("_salt", F.explode(every))
    # a merge join at every size: what a side may be broadcast for at one size grows with the data
    return one.drop("_salts").join(two.drop("_salts").hint("merge"), [*keys, "_salt"], how).drop("_salt")
