"""Queries on written values and printed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.operators import written as w
from ostinato.plans.catalog import query
from ostinato.runtime import table
from ostinato.sources.views import notes, with_views

_WRITTEN = (
    with_views("notes")
    + """, dense AS (SELECT *, lead(onset) OVER (PARTITION BY clip_id, hand ORDER BY onset) - onset AS gap FROM (SELECT DISTINCT clip_id, hand, onset FROM notes)),
 pulses AS (SELECT clip_id, hand, g[len(g) // 2 + 1] AS pulse FROM (SELECT clip_id, hand, list_sort(list(gap)) AS g FROM dense WHERE gap > 0 GROUP BY 1, 2)),
 wr AS (SELECT n.clip_id, n.note_id, n.hand, n.onset, n.pitch, greatest(0.125::double, round_even(duration / 0.125::double, 0) * 0.125::double) AS own, duration, gap, pulse
   FROM notes n JOIN dense USING (clip_id, hand, onset) LEFT JOIN pulses USING (clip_id, hand)),
 written AS (SELECT *, CASE WHEN gap IS NULL THEN own WHEN duration >= gap * 0.6::double OR (gap <= pulse * 1.25::double AND duration >= gap / 2) THEN gap ELSE least(own, gap) END AS written FROM wr)"""
)


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.written_durations(notes(spark, sf_dir).select("clip_id", "note_id", "hand", "onset", "duration"), 0.125)


@query(_WRITTEN + " SELECT clip_id, note_id, round(written, 6) AS written FROM written")
def notate_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir).select("clip_id", "note_id", F.round("written", 6).alias("written"))


@query()
def printed_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page made of the truth's snapped values, against what was heard."""
    truth = notes(spark, sf_dir)
    page = truth.select("clip_id", "note_id", "pitch", "onset", (F.rint(F.col("duration") / 0.25) * 0.25).alias("length"), F.col("hand").alias("staff"))
    heard = truth.select("note_id", "pitch").join(_written(spark, sf_dir), "note_id").withColumn("staff", F.col("hand"))
    moved = heard.where("note_id % 9 <> 0").withColumn("onset", F.col("onset") + (F.col("note_id") % 5 - 2) * 0.02)
    return w.printed_score(page, moved.select("clip_id", "note_id", "pitch", "onset", "written", "staff"), 2.0)


@query(
    """WITH clips AS (SELECT DISTINCT user_id AS clip_id FROM events),
 pages AS (SELECT clip_id, CASE WHEN clip_id % 7 <> 0 THEN 60 + clip_id % 60 END AS tempo, 3 + clip_id % 2 AS beats, (60 + clip_id % 60) * [1.0, 1.02, 1.06, 0.5][clip_id % 4 + 1]::double AS found_tempo,
   3 + clip_id % 3 % 2 AS found_beats, ['C major', 'A minor', 'F major'][clip_id % 3 + 1] AS found_key FROM clips)
SELECT 'clip_' || clip_id AS name, abs(found_tempo / tempo - 1) <= 0.03 AS tempo_right, abs((found_beats * 60 / found_tempo) / (beats * 60 / tempo::double) - 1) <= 0.05 AS meter_right,
 CASE WHEN clip_id % 5 <> 0 THEN found_key IN ('C major', 'A minor') END AS key_right FROM pages"""
)
def printed_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each clip's tempo, bar and key against its page; every seventh page says no tempo, every fifth no key."""
    clip = F.col("user_id")
    one_of = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (clip % n + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(clip).distinct().select(
        F.concat(F.lit("clip_"), clip.cast("string")).alias("name"), F.when(clip % 7 != 0, 60 + clip % 60).alias("tempo"), (3 + clip % 2).alias("beats"),
        ((60 + clip % 60) * one_of([1.0, 1.02, 1.06, 0.5], 4)).alias("found_tempo"), (3 + clip % 3 % 2).alias("found_beats"),
        one_of(["C major", "A minor", "F major"], 3).alias("found_key"),
        F.when(clip % 5 != 0, F.array(F.lit("C major"), F.lit("A minor"))).otherwise(F.array().cast("array<string>")).alias("keys"),
    )
    return w.judgements(rows)


@query(
    with_views("notes")
    + """, m AS (SELECT hand AS name, avg(duration) AS duration, avg(velocity) AS velocity, avg(pitch) AS pitch FROM notes GROUP BY 1),
 l AS (SELECT name, unnest(['duration', 'velocity', 'pitch']) AS metric, unnest([duration, velocity, pitch]) AS was, unnest([duration * 0.9::double, velocity + 1, pitch * 0.5::double]) AS now FROM m)
SELECT name, metric, round(was, 6) AS was, round(now, 6) AS now FROM l WHERE now < was - 1e-9"""
)
def metric_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which metrics of which group fell, however little."""
    means = [F.avg(c).alias(c) for c in ("duration", "velocity", "pitch")]
    before = notes(spark, sf_dir).groupBy(F.col("hand").alias("name")).agg(*means)
    after = before.select("name", (F.col("duration") * 0.9).alias("duration"), (F.col("velocity") + 1).alias("velocity"), (F.col("pitch") * 0.5).alias("pitch"))
    fell = w.worded_regressions(before, after, ["duration", "velocity", "pitch"])
    return fell.select("name", "metric", F.round("was", 6).alias("was"), F.round("now", 6).alias("now"))
