"""Connected components of links, as iterated joins with lineage cut in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.runtime import persist_table


def _distinct_links(a: str, b: str, df: DataFrame) -> DataFrame:
    return df.where(f"{a} <> {b}").select(F.col(a).alias("u"), F.col(b).alias("v")).distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of a link; the component is its smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): in a large-star step each node links its larger
    neighbours to its smallest one, in a small-star step its smaller neighbours. Links never grow in number, groups are
    partial aggregates, and each step's links are written to the shared folder. Rounds grow with the logarithm of the
    longest path. A node linked only with itself is not returned.
    """
    state = persist_table(_distinct_links(a, b, links), "links")
    last = None
    while True:
        both = state.select("u", "v").unionAll(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select("v", "m")
        step = _distinct_links("v", "m", large)
        pairs = step.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        hung = pairs.join(least, "u")
        small = hung.select(F.col("v").alias("x"), "m").unionAll(least.select(F.col("u").alias("x"), "m"))
        state = persist_table(_distinct_links("x", "m", small), "links")
        # every link is (node, its component) once nothing changes
        seen = [F.coalesce(F.bit_xor(F.xxhash64("u", "v", F.lit(seed))), F.lit(0)) for seed in (1, 2)]
        now = state.agg(F.count("*"), *seen).first()
        if now == last:
            break
        last = now
    stars = state.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
