"""Pitch-class weights and key finding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ostinato.functions.music import MAJOR_KEYS, MAJOR_PROFILE, MAJOR_SCALE, MINOR_KEYS, MINOR_PROFILE, MINOR_SCALE

UNFOUNDED, OUTWEIGHED, OUT_OF_SCALE = 0.2, 0.1, 0.3


def pitch_class_weights(notes: DataFrame) -> DataFrame:
    """(clip_id, pc, w) for all twelve pitch classes: seconds sounded."""
    sums = [F.sum(F.when(F.pmod("pitch", F.lit(12)) == pc, F.col("duration")).otherwise(0.0)).alias(f"w{pc}") for pc in range(12)]
    wide = notes.groupBy("clip_id").agg(*sums)
    pairs = ", ".join(f"{pc}, w{pc}" for pc in range(12))
    return wide.select("clip_id", F.expr(f"stack(12, {pairs}) as (pc, w)"))


def key_table(spark: SparkSession) -> DataFrame:
    """One row per key and degree: what the profile, the scale and the signature say of it. 288 rows, whatever the input."""
    rows = []
    for mode, names, profile, scale in (("major", MAJOR_KEYS, MAJOR_PROFILE, MAJOR_SCALE), ("minor", MINOR_KEYS, MINOR_PROFILE, MINOR_SCALE)):
        mean = sum(profile) / 12
        for tonic in range(12):
            home = tonic if mode == "major" else (tonic + 3) % 12
            down = 1 if home * 7 % 12 <= 6 else -1
            for degree in range(12):
                pc = (degree + tonic) % 12
                signed = degree in scale and pc not in MAJOR_SCALE
                rows.append((f"{names[tonic]} {mode}", mode, pc, profile[degree] - mean, degree in scale, signed, (pc - down) % 12))
    return spark.createDataFrame(
        rows, "key string, mode string, pc int, centred double, in_scale boolean, signed boolean, natural int"
    )


def key_scores(weights: DataFrame) -> DataFrame:
    """Per clip and key: correlation with the profile, less penalties for weight outside the scale and for accidentals of
    the signature that are never heard or (major) outweighed by their naturals."""
    spark = weights.sparkSession
    keys = F.broadcast(key_table(spark))
    arrays = weights.groupBy("clip_id").agg(
        F.map_from_entries(F.collect_list(F.struct("pc", "w"))).alias("all"), F.sum("w").alias("total")
    )
    rows = weights.join(keys, "pc").join(arrays, "clip_id")
    w, mean = F.col("w"), F.col("total") / 12
    signed = F.col("signed")
    sums = rows.groupBy("clip_id", "key", "mode").agg(
        F.sum((w - mean) * F.col("centred")).alias("sxy"),
        F.sum((w - mean) * (w - mean)).alias("sxx"),
        F.sum(F.col("centred") * F.col("centred")).alias("syy"),
        F.sum(F.when(F.col("in_scale"), w).otherwise(0.0)).alias("inside"),
        F.max("total").alias("total"),
        F.count_if(signed).alias("signed"),
        F.count_if(signed & (w == 0)).alias("unheard"),
        F.count_if(signed & (w < F.col("all")[F.col("natural")])).alias("outweighed"),
    )
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("signed")), F.lit(0.0))
    corr = F.coalesce(F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy"))), F.lit(-1.0))
    outside = F.lit(1.0) - F.coalesce(F.try_divide(F.col("inside"), F.col("total")), F.lit(0.0))
    contested = F.when(F.col("mode") == "major", share("outweighed")).otherwise(0.0)
    score = corr - OUT_OF_SCALE * outside - UNFOUNDED * share("unheard") - OUTWEIGHED * contested
    return sums.select("clip_id", "key", score.alias("score"))


def find_key(scores: DataFrame) -> DataFrame:
    """The best key per clip, ties to the larger name, and how clearly it leads."""
    order = W.partitionBy("clip_id").orderBy(F.desc(F.round("score", 12)), F.desc("key"))
    ranked = scores.withColumn("_n", F.row_number().over(order))
    best = ranked.groupBy("clip_id").agg(
        F.max(F.when(F.col("_n") == 1, F.col("key"))).alias("key"),
        F.max(F.when(F.col("_n") == 1, F.col("score"))).alias("best"),
        F.max(F.when(F.col("_n") == 2, F.col("score"))).alias("second"),
    )
    lead = (F.col("best") - F.col("second")) / F.greatest(F.abs("best"), F.lit(1e-6))
    return best.select("clip_id", "key", "best", F.least(F.lit(1.0), F.greatest(F.lit(0.0), lead)).alias("confidence"))
