"""Queries on tiles and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.operators import tracks as t
from ostinato.operators.joins import merged
from ostinato.plans.catalog import query
from ostinato.runtime import persist_table
from ostinato.sources import tiles as src
from ostinato.sources.views import notes, with_views

_T = with_views("notes") + ", " + src.SQL
_C = with_views("notes") + ", " + src.CLOCK


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.tiles(notes(spark, sf_dir))


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.select([F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


@query(_T + " SELECT clip_id, note_id, frame, round(top, 9) AS top, round(bottom, 9) AS bottom FROM tiles")
def frame_interval_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir).select("clip_id", "note_id", "frame", F.round("top", 9).alias("top"), F.round("bottom", 9).alias("bottom"))


@query(_C + " SELECT clip_id, frame FROM clock WHERE frame >= 10 AND frame < 300 AND (frame - 10) % 7 = 0")
def frame_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames from 10 to 300 in steps of 7."""
    clock = src.frame_clock(notes(spark, sf_dir))
    return clock.where("frame >= 10 and frame < 300 and (frame - 10) % 7 = 0").select("clip_id", "frame")


@query(
    _C
    + """, span AS (SELECT clip_id, CASE WHEN n < 20 THEN 0 ELSE CAST(n * 0.05::double AS INTEGER) END AS lo, CASE WHEN n < 20 THEN n ELSE n - CAST(n * 0.05::double AS INTEGER) END AS hi FROM (SELECT clip_id, count(*) AS n FROM clock GROUP BY 1)),
 picks AS (SELECT DISTINCT clip_id, lo + CAST(floor(i * (hi - 1 - lo) / 11::double) AS BIGINT) AS frame FROM span, (SELECT unnest(range(12)) AS i))
SELECT clip_id, frame, time FROM clock SEMI JOIN picks USING (clip_id, frame)"""
)
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve evenly spaced frames of each clip, without its first and last twentieth."""
    clock = src.frame_clock(notes(spark, sf_dir))
    size = clock.groupBy("clip_id").agg(F.count("*").alias("n"))
    margin = F.when(F.col("n") < 20, 0).otherwise(F.rint(F.col("n") * 0.05)).cast("long")
    span = size.select("clip_id", margin.alias("lo"), (F.col("n") - margin).alias("hi"))
    place = lambda i: F.col("lo") + F.floor(i * (F.col("hi") - 1 - F.col("lo")) / F.lit(11.0)).cast("long")
    picks = span.select("clip_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(11)), place))).alias("frame"))
    return clock.join(picks, ["clip_id", "frame"], "left_semi").select("clip_id", "frame", "time")


@query(_C + ", d AS (SELECT clip_id, time - lag(time) OVER (PARTITION BY clip_id ORDER BY frame) AS d FROM clock) SELECT clip_id, round(median(d), 6) AS step FROM d GROUP BY 1")
def frame_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    order = W.partitionBy("clip_id").orderBy("frame")
    rows = src.frame_clock(notes(spark, sf_dir)).withColumn("d", F.col("time") - F.lag("time").over(order))
    return rows.groupBy("clip_id").agg(F.round(F.median("d"), 6).alias("step"))


@query(_T + " SELECT clip_id, note_id, round(median(time + (300 - bottom) / 100::double), 6) AS onset, count(*) AS n FROM tiles WHERE bottom < 298 GROUP BY 1, 2")
def edge_cross_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(t.cross_times(_tiles(spark, sf_dir)), "onset")


@query(
    _T
    + """, rates AS (SELECT clip_id, note_id, nullif(regr_slope(CASE WHEN bottom < 298 THEN bottom END, time), 'nan'::double) AS low_rate, count_if(bottom < 298) AS low_n,
  nullif(regr_slope(CASE WHEN top > 2 THEN top END, time), 'nan'::double) AS high_rate, count_if(top > 2) AS high_n FROM tiles GROUP BY 1, 2)
SELECT clip_id, note_id, round(low_rate, 3) AS low_rate, CAST(low_n AS BIGINT) AS low_n, round(high_rate, 3) AS high_rate, CAST(high_n AS BIGINT) AS high_n,
 coalesce(low_n < 4 OR (low_rate >= -5 AND abs(low_rate / 100 - 1) <= 0.6), true) OR coalesce(high_n < 4 OR (high_rate >= -5 AND abs(high_rate / 100 - 1) <= 0.6), true) AS falls FROM rates"""
)
def fall_rate_regr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = t.fall_rates(_tiles(spark, sf_dir))
    return rates.select("clip_id", "note_id", F.round("low_rate", 3).alias("low_rate"), "low_n", F.round("high_rate", 3).alias("high_rate"), "high_n", "falls")


@query(_T + " SELECT clip_id, note_id, round(nullif(regr_slope(bottom - top, time), 'nan'::double), 3) + 0::double AS grows, round(median(top), 6) AS top, count(*) AS n FROM tiles WHERE bottom < 298 GROUP BY 1, 2")
def grows_as_it_falls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.growth(_tiles(spark, sf_dir))
    return rows.select("clip_id", "note_id", (F.round("grows", 3) + 0.0).alias("grows"), F.round("top", 6).alias("top"), "n")


@query(_T + " SELECT clip_id, note_id, count(*) AS n, round(max(bottom) - min(bottom), 6) AS fell, count(*) >= 3 AND count_if(bottom < 298) > 0 AND max(bottom) - min(bottom) >= 6 AS plausible FROM tiles GROUP BY 1, 2")
def track_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(t.plausible(_tiles(spark, sf_dir), 0.2).select("clip_id", "note_id", "n", "fell", "plausible"), "fell")


_STEPS = _T + """, steps AS (SELECT * FROM (SELECT clip_id, note_id, frame, time, lead(bottom) OVER w - bottom AS px, lead(time) OVER w - time AS seconds FROM tiles WHERE bottom < 298
  WINDOW w AS (PARTITION BY clip_id, note_id ORDER BY frame)) WHERE px IS NOT NULL)"""


@query(_STEPS + " SELECT clip_id, note_id, frame, round(px, 6) AS px, round(seconds, 6) AS seconds FROM steps")
def edge_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(t.edge_steps(_tiles(spark, sf_dir)).select("clip_id", "note_id", "frame", "px", "seconds"), "px", "seconds")


@query(_STEPS + " SELECT clip_id, CAST(floor(time / 1) AS BIGINT) AS bucket, count(*) AS n, round(sum(px) / sum(seconds), 6) AS rate FROM steps GROUP BY 1, 2 HAVING count(*) >= 10")
def clock_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(t.clock_buckets(t.edge_steps(_tiles(spark, sf_dir)), 1.0, 10).select("clip_id", "bucket", "n", "rate"), "rate")


@query(
    with_views("notes")
    + """, m AS (SELECT clip_id, hand, median(duration) AS m FROM notes GROUP BY 1, 2)
SELECT clip_id, hand, round(avg(duration), 9) AS mean, count(*) AS n FROM notes JOIN m USING (clip_id, hand) WHERE duration BETWEEN m / 2 AND m * 2 GROUP BY 1, 2"""
)
def robust_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.robust_mean(notes(spark, sf_dir), ["clip_id", "hand"], "duration")
    return rows.select("clip_id", "hand", F.round("mean", 9).alias("mean"), "n")


@query(
    with_views("notes")
    + """, m AS (SELECT clip_id, median(duration) AS m FROM notes GROUP BY 1)
SELECT clip_id, round(any_value(m), 6) AS middle, round(median(abs(duration - m)), 6) AS spread FROM notes JOIN m USING (clip_id) GROUP BY 1"""
)
def mad_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(t.median_spread(notes(spark, sf_dir), ["clip_id"], "duration"), "middle", "spread")


#: Frames 20 to 26 of every 60 show what frame 20 shows.
_FROZEN = _T + """, frozen AS (SELECT c.clip_id, c.frame, c.frame / 5::double AS time, x.pitch, x.hand, x.top, x.bottom, x.note_id FROM (
   SELECT DISTINCT clip_id, frame, CASE WHEN frame % 60 BETWEEN 20 AND 26 THEN frame - frame % 60 + 20 ELSE frame END AS shown FROM tiles) c
   JOIN tiles x ON x.clip_id = c.clip_id AND x.frame = c.shown),
 pics AS (SELECT clip_id, frame, time, list_sort(list({'p': pitch, 'h': hand, 't': round(top, 1), 'b': round(bottom, 1)})) AS pic, max(CASE WHEN bottom < 298 OR top > 2 THEN 1 ELSE 0 END) AS movable FROM frozen GROUP BY 1, 2, 3),
 flags AS (SELECT *, CASE WHEN coalesce(lag(pic) OVER w = pic AND lag(frame) OVER w = frame - 1 AND movable = 1, false) THEN 0 ELSE 1 END AS new FROM pics WINDOW w AS (PARTITION BY clip_id ORDER BY frame)),
 runs AS (SELECT clip_id, frame, time, sum(new) OVER (PARTITION BY clip_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM flags),
 stops AS (SELECT clip_id, min(frame) AS first, max(frame) AS last FROM runs GROUP BY clip_id, run HAVING max(time) - min(time) >= 0.2::double)"""


def _frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tiles(spark, sf_dir)
    phase = F.col("frame") % 60
    shown = F.when(phase.between(20, 26), F.col("frame") - phase + 20).otherwise(F.col("frame"))
    frames = rows.select("clip_id", "frame").distinct().select("clip_id", F.col("frame").alias("at"), shown.alias("frame"))
    return merged(frames, rows.drop("time"), ["clip_id", "frame"]).select("clip_id", F.col("at").alias("frame"), (F.col("at") / src.FPS).alias("time"), "pitch", "hand", "top", "bottom", "note_id")


@query(_FROZEN + " SELECT * FROM stops")
def pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.pauses(_frozen(spark, sf_dir), 0.2)


@query(
    _FROZEN
    + ", "
    + src.CLOCK
    + """, steps2 AS (SELECT clip_id, frame, CASE WHEN EXISTS (SELECT 1 FROM stops s WHERE s.clip_id = clock.clip_id AND frame > first AND frame <= last) THEN 0 ELSE time - coalesce(lag(time) OVER (PARTITION BY clip_id ORDER BY frame), time) END AS step FROM clock)
SELECT clip_id, frame, round(sum(step) OVER (PARTITION BY clip_id ORDER BY frame ROWS UNBOUNDED PRECEDING), 6) AS moved FROM steps2"""
)
def scroll_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = src.frame_clock(notes(spark, sf_dir))
    return _r(t.scroll_clock(clock, t.pauses(_frozen(spark, sf_dir), 0.2)).select("clip_id", "frame", "moved"), "moved")


@query()
def build_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = notes(spark, sf_dir)
    return t.build_tracks(t.with_previous_frame(src.tiles(truth), src.frame_clock(truth)))


@query()
def tracks_to_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes to tiles to tracks and back."""
    return t.tracks_to_notes(persist_table(build_tracks(spark, sf_dir), "tracks"), 1 / src.FPS)


_SAMPLES = (
    _T
    + """, edged AS (SELECT *, max(bottom) OVER k - 10::double AS low_limit, min(top) OVER k + 10::double AS roof FROM tiles WINDOW k AS (PARTITION BY clip_id, note_id)),
 cutted AS (SELECT *, count(*) FILTER (top <= roof) OVER (PARTITION BY clip_id, note_id) >= 2 AND top <= roof AS cut FROM edged),
 parted AS (SELECT *, count(*) FILTER (cut) OVER (PARTITION BY clip_id, note_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS part,
   max(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, note_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS cut_later FROM cutted),
 climbing AS (SELECT *, coalesce(NOT cut AND cut_later = 0 AND top < max(top) OVER (PARTITION BY clip_id, note_id, part ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 20::double, false) AS climbs FROM parted),
 sampled AS (SELECT *, bottom < 298 AND bottom < low_limit AS low, top > 2 AND NOT cut AND NOT (max(climbs::int) OVER (PARTITION BY clip_id, note_id ORDER BY frame ROWS UNBOUNDED PRECEDING) = 1) AS high FROM climbing)"""
)


@query(_SAMPLES + " SELECT clip_id, note_id, frame, low, high FROM sampled")
def plateau_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which frames of a track time its onset and its end: neither edge where it has stopped, nor the next tile's top."""
    return t.timing_samples(src.tiles(notes(spark, sf_dir)), t.TRACK, 1 / src.FPS).select("clip_id", "note_id", "frame", "low", "high")


@query(
    _SAMPLES
    + """, stats AS (SELECT clip_id, note_id, count(*) AS n, median(CASE WHEN low THEN time + (300 - bottom) / 100::double END) AS onset,
   median(CASE WHEN high THEN time + (300 - top) / 100::double END) AS ends, max(bottom - top) AS tall, count(*) FILTER (low) AS low_n, count(*) FILTER (high) AS high_n,
   arg_max(bottom, frame) FILTER (low) - arg_min(bottom, frame) FILTER (low) AS low_fell, arg_max(top, frame) FILTER (high) - arg_min(top, frame) FILTER (high) AS high_fell,
   regr_slope(bottom, time) FILTER (low) AS low_rate, regr_slope(top, time) FILTER (high) AS high_rate FROM sampled GROUP BY 1, 2),
 good AS (SELECT *, coalesce(ends - onset, tall / 100::double) AS length FROM stats WHERE low_n > 0
   AND greatest(low_fell, CASE WHEN high_n >= 5 AND abs(high_rate / 100 - 1) <= 0.15::double THEN high_fell ELSE 0 END) >= 0.06::double * 100
   AND (coalesce(low_n < 4 OR (low_rate >= -5 AND abs(low_rate / 100 - 1) <= 0.6::double), true) OR coalesce(high_n < 4 OR (high_rate >= -5 AND abs(high_rate / 100 - 1) <= 0.6::double), true)))
SELECT clip_id, note_id, round(greatest(onset, 0), 6) AS onset, round(greatest(length, 0.02::double), 6) AS duration, n FROM good WHERE length > 0"""
)
def timed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes from tracks whose tiles are known."""
    found = t.notes_of(src.tiles(notes(spark, sf_dir)), t.TRACK, 1 / src.FPS)
    return _r(found, "onset", "duration")


def _line(source: str) -> str:
    return f"""SELECT clip_id, (w * xy - x * y) / (w * xx - x * x) AS slope, (y - (w * xy - x * y) / (w * xx - x * x) * x) / w AS level, n
  FROM (SELECT clip_id, sum(duration) AS w, sum(duration * onset) AS x, sum(duration * pitch) AS y, sum(duration * onset * onset) AS xx, sum(duration * onset * pitch) AS xy, count(*) AS n FROM {source} GROUP BY 1)
  WHERE w * xx - x * x > 1e-9"""


@query(
    with_views("notes")
    + f""", first AS ({_line('notes')}), apart AS (SELECT n.clip_id, onset, pitch, duration, abs(pitch - slope * onset - level) AS off FROM notes n JOIN first USING (clip_id)),
 near AS (SELECT a.* FROM apart a JOIN (SELECT clip_id, median(off) AS middle FROM apart GROUP BY 1) USING (clip_id) WHERE off <= 1.2::double * middle + 1e-6)
SELECT clip_id, round(slope, 6) AS slope, round(level, 6) AS level, n FROM ({_line('near')})"""
)
def trimmed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each clip's pitches drift: a line weighted by length through the notes near the line through all of them."""
    return _r(t.trimmed_line(notes(spark, sf_dir), ["clip_id"], "onset", "pitch", "duration", 1.2), "slope", "level")
