"""Queries on notes as they are: projections, filters, summaries, orders and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ostinato.functions.music import is_black, pitch_name, valid_note, white_ordinal
from ostinato.plans.catalog import query
from ostinato.runtime import table
from ostinato.sources.views import estimate, notes, with_views

_NAMES = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"


@query(
    with_views("notes")
    + f"""
SELECT clip_id, note_id, round(onset, 6) AS onset, round(onset + duration, 6) AS note_end, pitch,
  ({_NAMES})[pitch % 12 + 1] || CAST(pitch // 12 - 1 AS VARCHAR) AS name FROM notes"""
)
def note_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select(
        "clip_id", "note_id", F.round("onset", 6).alias("onset"), F.round(F.col("onset") + F.col("duration"), 6).alias("note_end"),
        "pitch", pitch_name(F.col("pitch")).alias("name"),
    )


@query(with_views("notes") + "SELECT clip_id, note_id, pitch FROM notes WHERE hand = 'L'")
def hand_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).where(F.col("hand") == "L").select("clip_id", "note_id", "pitch")


@query(with_views("notes") + "SELECT clip_id, note_id FROM notes WHERE onset < 12 AND onset + duration > 10")
def sounding_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that sound in [10 s, 12 s)."""
    held = notes(spark, sf_dir)
    return held.where((F.col("onset") < 12) & (F.col("onset") + F.col("duration") > 10)).select("clip_id", "note_id")


@query(
    with_views("notes", "est")
    + """SELECT clip_id, (pitch BETWEEN 21 AND 108 AND onset >= 0 AND duration > 0) AS valid, count(*) AS n FROM est GROUP BY 1, 2"""
)
def domain_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = valid_note(F.col("pitch"), F.col("onset"), F.col("duration"))
    return estimate(notes(spark, sf_dir)).groupBy("clip_id", valid.alias("valid")).agg(F.count("*").alias("n"))


@query(
    with_views("notes")
    + """SELECT DISTINCT pitch, pitch % 12 IN (1, 3, 6, 8, 10) AS black,
  CAST(pitch // 12 * 7 + list_count(list_filter([2, 4, 5, 7, 9, 11], lambda x: x <= pitch % 12)) AS BIGINT) AS white FROM notes"""
)
def key_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    pitch = F.col("pitch")
    return notes(spark, sf_dir).select("pitch").distinct().select(
        "pitch", is_black(pitch).alias("black"), white_ordinal(pitch).cast("long").alias("white")
    )


@query(
    with_views("notes")
    + """SELECT clip_id, count(*) AS n, round(max(onset + duration), 6) AS length, min(pitch) AS low, max(pitch) AS high,
  count(DISTINCT pitch) AS pitches, count(DISTINCT round(onset, 4)) AS onsets FROM notes GROUP BY 1"""
)
def clip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).groupBy("clip_id").agg(
        F.count("*").alias("n"), F.round(F.max(F.col("onset") + F.col("duration")), 6).alias("length"),
        F.min("pitch").alias("low"), F.max("pitch").alias("high"), F.countDistinct("pitch").alias("pitches"),
        F.countDistinct(F.round("onset", 4)).alias("onsets"),
    )


@query(
    with_views("notes")
    + """SELECT clip_id, note_id, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY onset, pitch, duration, hand, velocity, note_id) AS INTEGER) AS place
FROM notes"""
)
def note_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total order of a clip's notes."""
    order = W.partitionBy("clip_id").orderBy("onset", "pitch", "duration", "hand", "velocity", "note_id")
    return notes(spark, sf_dir).select("clip_id", "note_id", F.row_number().over(order).alias("place"))


@query(
    with_views("notes")
    + """SELECT clip_id, arg_max(note_id, (duration, -note_id)) AS longest, arg_min(note_id, (onset, note_id)) AS opening
FROM notes GROUP BY 1"""
)
def first_wins_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Argmax and argmin whose ties go to the first note."""
    return notes(spark, sf_dir).groupBy("clip_id").agg(
        F.max_by("note_id", F.struct(F.col("duration"), -F.col("note_id"))).alias("longest"),
        F.min_by("note_id", F.struct("onset", "note_id")).alias("opening"),
    )


@query(
    with_views("notes")
    + """SELECT clip_id, steps, n FROM (SELECT clip_id, CAST(round_even(duration / 0.25, 0) AS BIGINT) AS steps, count(*) AS n, min(note_id) AS seen
  FROM notes GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY n DESC, seen) = 1"""
)
def duration_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most common duration in grid steps; ties go to the one seen first."""
    counted = notes(spark, sf_dir).groupBy("clip_id", F.rint(F.col("duration") / 0.25).cast("long").alias("steps")).agg(
        F.count("*").alias("n"), F.min("note_id").alias("seen")
    )
    best = F.max_by(F.struct("steps", "n"), F.struct(F.col("n"), -F.col("seen"))).alias("b")
    return counted.groupBy("clip_id").agg(best).select("clip_id", "b.steps", "b.n")


@query(
    with_views("notes", "est")
    + """SELECT clip_id, pitch, 'lost' AS side FROM (SELECT clip_id, pitch FROM notes EXCEPT SELECT clip_id, pitch FROM est WHERE note_id % 3 = 0)
UNION ALL SELECT clip_id, pitch, 'both' FROM (SELECT clip_id, pitch FROM notes INTERSECT SELECT clip_id, pitch FROM est WHERE note_id % 3 = 0)"""
)
def pitch_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitches of a clip that a thinned estimate has lost, and those both have."""
    truth = notes(spark, sf_dir)
    thin = estimate(truth).where("note_id % 3 = 0").select("clip_id", "pitch")
    mine = truth.select("clip_id", "pitch")
    return mine.subtract(thin).withColumn("side", F.lit("lost")).unionAll(mine.intersect(thin).withColumn("side", F.lit("both")))


@query(
    with_views("notes")
    + """SELECT clip_id, pitch, CAST(dense_rank() OVER (PARTITION BY clip_id ORDER BY first_at, pitch) AS INTEGER) AS number
FROM (SELECT clip_id, pitch, min(onset) AS first_at FROM notes GROUP BY 1, 2)"""
)
def numbered_by_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = notes(spark, sf_dir).groupBy("clip_id", "pitch").agg(F.min("onset").alias("first_at"))
    order = W.partitionBy("clip_id").orderBy("first_at", "pitch")
    return first.select("clip_id", "pitch", F.dense_rank().over(order).alias("number"))


@query(
    """WITH u AS (SELECT page_id, CASE page_id % 7
  WHEN 0 THEN 'https://www.youtube.com/watch?v=' || id || '&t=3' WHEN 1 THEN 'youtu.be/' || id || '?x=1'
  WHEN 2 THEN 'https://m.youtube.com/shorts/' || id WHEN 3 THEN 'https://www.youtube-nocookie.com/embed/' || id || '/'
  WHEN 4 THEN id WHEN 5 THEN 'https://www.youtube.com/live/' || id ELSE url END AS link
 FROM (SELECT page_id, url, substr(md5(url), 1, 11) AS id FROM pages))
SELECT page_id, CASE WHEN regexp_matches(link, '^[\\w-]{11}$') THEN link
  WHEN NOT regexp_matches(link, '^(https?://)?((www|m)\\.)?(youtube\\.com|youtube-nocookie\\.com|music\\.youtube\\.com|youtu\\.be)/') THEN NULL
  WHEN regexp_matches(link, '^(https?://)?((www|m)\\.)?youtu\\.be/') THEN nullif(regexp_extract(link, 'youtu\\.be/([\\w-]{11})(?:[/?#]|$)', 1), '')
  ELSE coalesce(nullif(regexp_extract(link, '[?&]v=([\\w-]{11})(?:[&#]|$)', 1), ''), nullif(regexp_extract(link, '/(?:shorts|embed|v|live)/([\\w-]{11})', 1), '')) END AS video_id
FROM u"""
)
def video_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 11-character id of a video link in any of six shapes; null for other pages."""
    from ostinato.sources.links import video_id

    own = F.substring(F.md5(F.col("url").cast("binary")), 1, 11)
    shapes = [
        F.concat(F.lit("https://www.youtube.com/watch?v="), own, F.lit("&t=3")),
        F.concat(F.lit("youtu.be/"), own, F.lit("?x=1")),
        F.concat(F.lit("https://m.youtube.com/shorts/"), own),
        F.concat(F.lit("https://www.youtube-nocookie.com/embed/"), own, F.lit("/")),
        own,
        F.concat(F.lit("https://www.youtube.com/live/"), own),
        F.col("url"),
    ]
    link = F.element_at(F.array(*shapes), (F.col("page_id") % 7).cast("int") + 1)
    return table(spark, sf_dir, "pages").select("page_id", video_id(link).alias("video_id"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def event_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    with_views("notes")
    + """SELECT clip_id, note_id, regexp_replace(trim(hand || ' take: ' || CAST(velocity AS VARCHAR) || '/' || CAST(pitch AS VARCHAR)), '[^\\w.-]+', '_', 'g') AS label FROM notes"""
)
def safe_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels fit for file names: runs of other characters become one underscore."""
    raw = F.concat("hand", F.lit(" take: "), F.col("velocity").cast("string"), F.lit("/"), F.col("pitch").cast("string"))
    return notes(spark, sf_dir).select("clip_id", "note_id", F.regexp_replace(F.trim(raw), r"[^\w.-]+", "_").alias("label"))


@query(
    with_views("notes")
    + """SELECT a.clip_id, a.note_id, round(a.onset, 6) AS onset, a.pitch, round(a.duration, 6) AS duration, a.hand, a.velocity FROM notes a"""
)
def note_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips as JSON documents with sorted note arrays, read back with a fixed schema."""
    from ostinato.sources.note_json import read_clips, write_clips

    rows = read_clips(write_clips(notes(spark, sf_dir)))
    return rows.select(
        "clip_id", "note_id", F.round("onset", 6).alias("onset"), "pitch", F.round("duration", 6).alias("duration"), "hand", "velocity"
    )
