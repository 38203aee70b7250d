"""Falling tiles of notes, frame by frame: a range join of notes with a frame clock, made by a generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.operators.joins import interval_frames

FPS, STRIKE, LEAD = 5, 300.0, 3.0
SPEED = STRIKE / LEAD


def frame_range() -> tuple[Column, Column]:
    """First and last frame that may show a note."""
    first = F.greatest(F.lit(0), F.ceil((F.col("onset") - LEAD) * FPS)).cast("long")
    return first, F.floor((F.col("onset") + F.col("duration")) * FPS).cast("long")


def tiles(notes: DataFrame) -> DataFrame:
    """(clip_id, note_id, pitch, hand, frame, time, top, bottom): the part of each note's tile that a frame shows."""
    rows = interval_frames(notes, *frame_range()).withColumn("time", F.col("frame") / FPS)
    bottom = F.lit(STRIKE) + (F.col("time") - F.col("onset")) * SPEED
    top = bottom - F.col("duration") * SPEED
    placed = rows.withColumns({"bottom": F.least(bottom, F.lit(STRIKE)), "top": F.greatest(top, F.lit(0.0))})
    visible = (F.col("bottom") > 0) & (F.col("top") < STRIKE) & (F.col("bottom") - F.col("top") >= 1)
    return placed.where(visible).select("clip_id", "note_id", "pitch", "hand", "frame", "time", "top", "bottom")


def frame_clock(notes: DataFrame) -> DataFrame:
    """(clip_id, frame, time) without pixels, to the end of the clip's last note."""
    last = notes.groupBy("clip_id").agg(F.floor(F.max(F.col("onset") + F.col("duration")) * FPS).cast("long").alias("last"))
    return last.select("clip_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("frame")).withColumn("time", F.col("frame") / FPS)


SQL = """placed AS (SELECT clip_id, note_id, pitch, hand, frame, frame / 5::double AS time,
   300::double + (frame / 5::double - onset) * 100::double AS yb, duration FROM (
   SELECT *, unnest(range(greatest(0, CAST(ceil((onset - 3) * 5) AS BIGINT)), CAST(floor((onset + duration) * 5) AS BIGINT) + 1)) AS frame FROM notes)),
 tiles AS (SELECT clip_id, note_id, pitch, hand, frame, time, greatest(yb - duration * 100::double, 0) AS top, least(yb, 300) AS bottom FROM placed
   WHERE least(yb, 300) > 0 AND greatest(yb - duration * 100::double, 0) < 300 AND least(yb, 300) - greatest(yb - duration * 100::double, 0) >= 1)"""
CLOCK = """clock AS (SELECT clip_id, frame, frame / 5::double AS time FROM (SELECT clip_id, unnest(range(0, CAST(floor(max(onset + duration) * 5) AS BIGINT) + 1)) AS frame FROM notes GROUP BY 1))"""
