"""Balanced label propagation: linked rows move to their neighbours' shards under quotas, then sizes are evened out.

Every row starts in the shard that a hash of its key gives. Rows with equal texts are linked. In each round a join with
the per-group label counts tells every linked row the shard with room where most of its neighbours are; a move is granted
while the target has room. Grants are decided on totals per (target, gain class), so no task sees all moves of a target: classes
with more gain are granted whole, the class at the border by a hash of the row, in proportion to the room left. After the
rounds, rows beyond a shard's exact quota (unlinked rows first) fill the shards below theirs. Everything is a
DataFrame operation.

Law ``rows``: counts of any two shards differ by one at most. ``slot`` numbers a shard's rows from 0 without gaps, rows of
one group next to each other.

Defined results: a null text has size 1 and the CRC of nothing, and belongs to the group of empty texts; repeated rows are
rows of their own; extra columns are ignored, whatever their names; an empty table gives an empty result; a group larger than a
shard fills whole shards as far as the quota lets it; null and repeated keys are rows like any other; only hashes and sizes of texts
are moved, so a text of any length costs one reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ostinato.llm.ordering import dealt_in_order, part_offsets
from ostinato.llm.spread import salted_join
from ostinato.runtime import persist_table

ROUNDS = 4
#: Classes of gain that grants are decided on.
CLASSES = 32


def _fraction(*columns: str) -> F.Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 20)) / float(1 << 20)


def propagate(linked: DataFrame, n_shards: int, quota: int) -> DataFrame:
    """One round over linked rows (uid, grp, shard): the same rows with new shards.

    Unlinked rows take what room is left later, so only linked rows count against the quota here.
    """
    counts = persist_table(linked.groupBy("grp", "shard").agg(F.count("*").alias("n")), "shard-counts")
    loads = counts.groupBy("shard").agg(F.sum("n").alias("load"))
    shards = linked.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"))
    room = shards.join(loads, "shard", "left").select("shard", (F.lit(quota) - F.coalesce("load", F.lit(0))).alias("room"))
    # n_shards rows
    open_to = counts.join(F.broadcast(room), "shard").where("room > 0")
    best = open_to.groupBy("grp").agg(F.max(F.struct("n", F.xxhash64("grp", "shard").alias("tie"), "shard")).alias("b"))
    wish = (
        counts.join(best, "grp")
        .select("grp", "shard", F.col("n").alias("here"), F.col("b.shard").alias("target"), F.col("b.n").alias("there"))
        .where("target <> shard and there >= here")
        .withColumn("gain", F.col("there") - F.col("here") + 1)
    )
    wish = wish.withColumn("class", F.least(F.lit(CLASSES - 1), F.floor(F.log2("gain") * 2).cast("int")))
    asked = wish.groupBy("target", "class").agg(F.sum("here").alias("asked"))
    more = W.partitionBy("target").orderBy(F.desc("class")).rowsBetween(W.unboundedPreceding, -1)
    share = F.greatest(F.lit(0.0), (F.col("room") - F.col("before")) / F.col("asked"))
    grants = (
        asked.withColumn("before", F.coalesce(F.sum("asked").over(more), F.lit(0)))
        .join(F.broadcast(room.withColumnRenamed("shard", "target")), "target")
        .select("target", "class", share.alias("share"))
    )
    # at most n_shards x CLASSES rows
    moves = wish.join(F.broadcast(grants), ["target", "class"]).select("grp", "shard", "target", "share")
    granted = F.coalesce(_fraction("uid") < F.col("share"), F.lit(False))
    # one group may be a third of all rows
    return salted_join(linked, moves, ["grp", "shard"], ["uid"], counts, "left").select(
        "uid", "grp", F.when(granted, F.col("target")).otherwise(F.col("shard")).alias("shard")
    )


def even_out(nodes: DataFrame, n_shards: int, total: int) -> DataFrame:
    """Exact quotas: rows beyond a shard's quota go to the places left below other shards' quotas.

    A shard keeps its linked rows first, so unlinked rows move. Returns nodes with final ``shard``.
    """
    spark = nodes.sparkSession
    quota = lambda shard: F.lit(total // n_shards) + F.when(shard < total % n_shards, 1).otherwise(0)
    placed = dealt_in_order(nodes.withColumn("_single", ~F.col("linked")), ["shard"], ["_single", "grp", "uid"], "shard-order")
    starts = part_offsets(placed, ["shard"], F.count("*"), "_before")
    lows = placed.groupBy("_part", "shard").agg(F.min("_at").alias("_low"))
    # one row for each part and shard that occurs in it: parts + shards at most
    place = F.broadcast(starts.join(lows, ["_part", "shard"]))
    ranked = placed.join(place, ["_part", "shard"]).withColumn("rank", F.col("_at") - F.col("_low") + F.col("_before"))
    over = ranked.where(F.col("rank") >= quota(F.col("shard")))
    kept = ranked.where(F.col("rank") < quota(F.col("shard"))).select(*nodes.columns)
    loads = nodes.groupBy("shard").agg(F.count("*").alias("load"))
    gaps = (
        spark.range(n_shards)
        .select(F.col("id").cast("int").alias("shard"))
        .join(loads, "shard", "left")
        .withColumn("load", F.coalesce("load", F.lit(0)))
        .withColumn("room", F.greatest(F.lit(0), quota(F.col("shard")) - F.col("load")))
        .withColumn("spill", F.greatest(F.lit(0), F.col("load") - quota(F.col("shard"))))
    )
    upto = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # over n_shards rows
    gaps = gaps.withColumns(
        {"first": F.coalesce(F.sum("room").over(upto), F.lit(0)), "spilled": F.coalesce(F.sum("spill").over(upto), F.lit(0))}
    )
    table = gaps.agg(
        F.array_sort(F.collect_list(F.struct("shard", "first", "room", "load", "spilled"))).alias("gaps")
    )
    moved = over.crossJoin(F.broadcast(table))  # the table is one row of n_shards entries
    number = F.col("rank") - quota(F.col("shard")) + F.element_at("gaps", F.col("shard") + 1)["spilled"]
    target = F.filter("gaps", lambda g: (F.col("number") >= g["first"]) & (F.col("number") < g["first"] + g["room"]))[0]["shard"]
    moved = moved.withColumn("number", number).withColumn("shard", target).select(*nodes.columns)
    return kept.unionAll(moved)


def balanced_shards(
    rows: DataFrame, key: str, text: str, n_shards: int = 16, rounds: int = ROUNDS
) -> DataFrame:
    """Per row: key, size, text_crc32, shard and slot, under the law ``rows``."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    nodes = persist_table(
        rows.select(
            F.col(key).alias("key"),
            (F.octet_length(body).cast("long") + 1).alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.xxhash64(body).alias("_hash"),
        ).withColumn("uid", F.monotonically_increasing_id()),
        "shard-nodes",
    )
    # equal texts have equal hash, CRC and size
    keys = ["_hash", "text_crc32", "size"]
    groups = persist_table(nodes.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "shard-groups")
    marks = groups.drop("n").withColumn("grp", F.xxhash64(*keys))
    start = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(n_shards)).cast("int").alias("shard")
    labelled = persist_table(salted_join(nodes, marks, keys, ["uid"], groups, "left").select("uid", "grp", start), "shard-labels")
    total = nodes.count()
    linked = labelled.where("grp is not null")
    even = -(-total // n_shards)
    for left in reversed(range(rounds)):
        # quotas start loose, or nothing could move where all rows are linked, and are even in the end
        linked = persist_table(propagate(linked, n_shards, even + even * left // max(1, rounds - 1)), "shard-labels")
    alone = labelled.where("grp is null").select("uid", F.lit(0).cast("long").alias("grp"), "shard", F.lit(False).alias("linked"))
    state = alone.unionAll(linked.select("uid", "grp", "shard", F.lit(True).alias("linked")))
    final = persist_table(even_out(state, n_shards, total), "shard-final")
    placed = dealt_in_order(final.join(nodes.drop("_hash"), "uid"), ["shard"], ["grp", "uid"], "shard-slots")
    starts = part_offsets(placed, ["shard"], F.count("*"), "_before")
    lows = placed.groupBy("_part", "shard").agg(F.min("_at").alias("_low"))
    place = F.broadcast(starts.join(lows, ["_part", "shard"]))  # parts + shards rows at most
    return placed.join(place, ["_part", "shard"]).select(
        F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("_at") - F.col("_low") + F.col("_before")).alias("slot")
    )
