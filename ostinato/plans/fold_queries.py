"""Queries by folds; SQL can't state them, so tests hold them against other forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ostinato.operators import folds, matching, rhythm, tempo
from ostinato.plans.catalog import query
from ostinato.runtime import persist_table
from ostinato.sources.views import estimate, notes


@query()
def merge_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.merge_overlaps(notes(spark, sf_dir))


@query()
def quantize_keep_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rhythm.grid_snap(notes(spark, sf_dir), 0.125, 0.1).withColumn("snapped", F.coalesce("snapped", "onset"))
    return folds.keep_repeats(rows.select("clip_id", "note_id", "pitch", "onset", "snapped"), 0.125)


@query()
def track_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    accented = rhythm.accents(notes(spark, sf_dir), 0.5)
    phases = rhythm.beat_phase(accented, 0.5, 0.125).withColumn("phase", F.col("line") * 0.125)
    return folds.track_beats(accented, 0.5, phases)


@query()
def lcs_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = notes(spark, sf_dir)
    return folds.ordered_alignment(truth, estimate(truth))


@query()
def estimated_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tatum, beat and tempo of each clip."""
    return tempo.estimate_beats(notes(spark, sf_dir))


@query()
def postprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hands, beat and grid of all notes."""
    return tempo.postprocessed(notes(spark, sf_dir))


@query()
def section_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beat of each half of each clip, and the key of the whole."""
    rows = notes(spark, sf_dir)
    span = rows.groupBy("clip_id").agg(F.min("onset").alias("lo"), F.max("onset").alias("hi"))
    halves = F.posexplode(F.array(F.col("lo"), (F.col("lo") + F.col("hi")) / 2)).alias("section_no", "start")
    return tempo.analysed_sections(rows, span.select("clip_id", halves))


@query()
def chord_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of chords that an alignment in order leaves out, from each clip's notes and their copy with other onsets."""
    rows = notes(spark, sf_dir)
    numbered = lambda d, name: d.withColumn(name, F.row_number().over(W.partitionBy("clip_id").orderBy("onset", "pitch", "note_id")) - 1)
    page = numbered(rows.withColumn("beat", F.rint(F.col("onset") * 2) / 2), "page_no").select("clip_id", "page_no", "pitch", "beat", "note_id")
    played = numbered(estimate(rows), "played_no").select("clip_id", "played_no", "pitch", "note_id")
    aligned = persist_table(folds.ordered_alignment(rows, estimate(rows)), "alignment")
    pairs = aligned.join(page.select("clip_id", "page_no", F.col("note_id").alias("page_id")), ["clip_id", "page_id"])
    pairs = pairs.join(played.select("clip_id", "played_no", F.col("note_id").alias("played_id")), ["clip_id", "played_id"])
    return matching.settled_chords(page.drop("note_id"), played.drop("note_id"), pairs.select("clip_id", "page_no", "played_no"))
