"""Where keys are, and which keys a span of pixels covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.functions.music import HIGHEST, LOWEST, is_black, white_ordinal

BLACK_WIDTH, COVERED = 0.62, 0.6


def keys(spark: SparkSession, x0: float = 0.0, width: float = 1040.0, taper: float = 0.0, first: int = LOWEST, last: int = HIGHEST) -> DataFrame:
    """(pitch, black, left, right, center) of a keyboard whose ends are white keys; a row per key."""
    pitch = F.col("pitch")
    rows = spark.range(first, last + 1).select(F.col("id").cast("int").alias("pitch"))
    base = spark.range(1).select(white_ordinal(F.lit(first)).alias("w0"), white_ordinal(F.lit(last)).alias("w1"))
    placed = rows.crossJoin(F.broadcast(base)).withColumns(  # one row
        {"i": white_ordinal(pitch) - F.col("w0"), "count": F.col("w1") - F.col("w0") + 1, "black": is_black(pitch)}
    )
    edge = lambda n: F.lit(x0) + width * ((u := n / F.col("count")) + taper * u * (u - 1))
    half = F.lit(width * BLACK_WIDTH / 2) / F.col("count")
    middle = edge(F.col("i") + 1)
    left = F.when(F.col("black"), middle - half).otherwise(edge(F.col("i")))
    right = F.when(F.col("black"), middle + half).otherwise(edge(F.col("i") + 1))
    return placed.select("pitch", "black", left.alias("left"), right.alias("right")).withColumn("center", (F.col("left") + F.col("right")) / 2)


def covered(blobs: DataFrame, board: DataFrame) -> DataFrame:
    """Keys that blobs (blob_id, x0, x1) cover: white ones by 60% of their width; black ones likewise, unless a white neighbour is
    covered by the same blob."""
    share = (F.least("x1", "right") - F.greatest("x0", "left")) / (F.col("right") - F.col("left"))
    # the board has 88 rows at most; keys as an array per blob keep the join out of the plan
    listed = board.agg(F.array_sort(F.collect_list(F.struct("pitch", "black", "left", "right"))).alias("board"))
    rows = blobs.crossJoin(F.broadcast(listed)).select("blob_id", "x0", "x1", F.inline("board"))
    hits = rows.where(share >= COVERED).select("blob_id", "pitch", "black")
    whites = hits.where("not black")
    around = whites.select("blob_id", F.explode(F.array(F.col("pitch") - 1, F.col("pitch") + 1)).alias("pitch")).distinct()
    blacks = hits.where("black").join(around, ["blob_id", "pitch"], "left_anti")
    return whites.unionAll(blacks.select("blob_id", "pitch", "black"))


def nearest(points: DataFrame, board: DataFrame) -> DataFrame:
    """The key that a point (point_id, x) lies on, black ones first, else null; and the white key nearest by its middle."""
    listed = board.agg(F.array_sort(F.collect_list(F.struct("pitch", "black", "left", "right", "center"))).alias("board"))
    rows = points.crossJoin(F.broadcast(listed))  # one row
    on = F.filter("board", lambda k: (F.col("x") >= k["left"]) & (F.col("x") < k["right"]))
    best = F.array_min(F.transform(on, lambda k: F.struct((~k["black"]).alias("o"), F.abs(k["center"] - F.col("x")).alias("d"), k["pitch"].alias("p"))))
    whites = F.filter("board", lambda k: ~k["black"])
    white = F.array_min(F.transform(whites, lambda k: F.struct(F.abs(k["center"] - F.col("x")).alias("d"), k["pitch"].alias("p"))))
    return rows.select("point_id", "x", best["p"].alias("pitch"), white["p"].alias("white"))
