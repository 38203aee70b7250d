"""Queries on keyboards, sections, beats as positions, and small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ostinato.operators import keyboard as kb
from ostinato.operators.joins import as_of
from ostinato.plans.catalog import query
from ostinato.sources.views import notes, with_views

_N = with_views("notes")
_BOARD = """base AS (SELECT unnest(range(21, 109)) AS pitch), ord AS (SELECT pitch, pitch % 12 IN (1, 3, 6, 8, 10) AS black,
  pitch // 12 * 7 + list_count(list_filter([2, 4, 5, 7, 9, 11], lambda x: x <= pitch % 12)) - 12 AS i FROM base),
 board AS (SELECT pitch, black, CASE WHEN black THEN 1040::double * (i + 1) / 52 - 6.2::double ELSE 1040::double * i / 52 END AS left_x,
   CASE WHEN black THEN 1040::double * (i + 1) / 52 + 6.2::double ELSE 1040::double * (i + 1) / 52 END AS right_x FROM ord)"""


@query(f"WITH {_BOARD} SELECT CAST(pitch AS INTEGER) AS pitch, black, round(left_x, 6) AS left_x, round(right_x, 6) AS right_x FROM board")
def key_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.keys(spark).select("pitch", "black", F.round("left", 6).alias("left_x"), F.round("right", 6).alias("right_x"))


@query(
    _N
    + f""", {_BOARD}, blobs AS (SELECT note_id AS blob_id, (note_id * 37 % 1000)::double AS x0, (note_id * 37 % 1000)::double + 11 + note_id % 23 AS x1 FROM notes),
 hits AS (SELECT blob_id, pitch, black FROM blobs JOIN board ON (least(x1, right_x) - greatest(x0, left_x)) / (right_x - left_x) >= 0.6::double)
SELECT blob_id, CAST(pitch AS INTEGER) AS pitch, black FROM hits h WHERE NOT black OR NOT EXISTS (SELECT 1 FROM hits w WHERE w.blob_id = h.blob_id AND NOT w.black AND abs(w.pitch - h.pitch) = 1)"""
)
def key_coverage_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = (F.col("note_id") * 37 % 1000).cast("double")
    blobs = notes(spark, sf_dir).select(F.col("note_id").alias("blob_id"), left.alias("x0"), (left + 11 + F.col("note_id") % 23).alias("x1"))
    return kb.covered(blobs, kb.keys(spark))


@query(
    _N
    + f""", {_BOARD}, points AS (SELECT note_id AS point_id, (note_id * 7919 % 10391) / 10::double AS x FROM notes)
SELECT point_id, (SELECT arg_min(CAST(pitch AS INTEGER), (NOT black, abs((left_x + right_x) / 2 - x), pitch)) FROM board WHERE x >= left_x AND x < right_x) AS pitch,
 (SELECT arg_min(CAST(pitch AS INTEGER), (abs((left_x + right_x) / 2 - x), pitch)) FROM board WHERE NOT black) AS white FROM points"""
)
def nearest_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = notes(spark, sf_dir).select(F.col("note_id").alias("point_id"), (F.col("note_id") * 7919 % 10391 / 10.0).alias("x"))
    return kb.nearest(points, kb.keys(spark)).select("point_id", "pitch", "white")


_SECTIONS = "sections AS (SELECT clip_id, s AS section_no, s * (15 + clip_id % 7)::double AS start, 90 + s * 10 AS tempo FROM (SELECT DISTINCT clip_id FROM notes), (SELECT unnest(range(3)) AS s))"


def _sections(truth: DataFrame) -> DataFrame:
    rows = truth.select("clip_id").distinct().withColumn("section_no", F.explode(F.array(*map(F.lit, range(3)))))
    return rows.select("clip_id", "section_no", (F.col("section_no") * (15 + F.col("clip_id") % 7)).cast("double").alias("start"), (F.lit(90) + F.col("section_no") * 10).alias("tempo"))


@query(
    _N
    + f""", {_SECTIONS} SELECT n.clip_id, note_id, CAST(section_no AS INTEGER) AS section_no, CAST(tempo AS INTEGER) AS tempo FROM notes n ASOF JOIN sections s ON n.clip_id = s.clip_id AND n.onset + 1e-9 >= s.start"""
)
def as_of_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = notes(spark, sf_dir)
    rows = truth.withColumn("at", F.col("onset") + 1e-9)
    found = as_of(rows, _sections(truth), ["clip_id"], "at", "start", ["section_no", "tempo"])
    return found.select("clip_id", "note_id", "section_no", "tempo")


@query(
    _N
    + f""", {_SECTIONS}, beats AS (SELECT clip_id, section_no, (coalesce(lead(start) OVER (PARTITION BY clip_id ORDER BY section_no), 90) - start) / (60 / tempo::double) AS n FROM sections)
SELECT clip_id, CAST(section_no AS INTEGER) AS section_no, round(coalesce(sum(n) OVER (PARTITION BY clip_id ORDER BY section_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS before FROM beats"""
)
def section_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats before each section of a clip."""
    order = W.partitionBy("clip_id").orderBy("section_no")
    length = (F.coalesce(F.lead("start").over(order), F.lit(90.0)) - F.col("start")) / (F.lit(60.0) / F.col("tempo"))
    rows = _sections(notes(spark, sf_dir)).withColumn("n", length)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return rows.select("clip_id", "section_no", F.round(before, 6).alias("before"))


@query(
    _N
    + """, beats AS (SELECT unnest(range(200)) AS b), times AS (SELECT b, b * 0.5::double + (b % 3) * 0.02::double AS t, lead(b * 0.5::double + (b % 3) * 0.02::double) OVER (ORDER BY b) AS t2 FROM beats)
SELECT clip_id, note_id, round(b + (onset - t) / (t2 - t), 6) AS position FROM notes ASOF JOIN times ON onset >= t"""
)
def beat_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds to beats along a map of beat times: the beat at or before, and the share of the way to the next one.

    A beat map is a short array, so its last beat at or before a note is found in the array and not by a join.
    """
    times = F.transform(F.sequence(F.lit(0), F.lit(199)), lambda b: b * 0.5 + (b % 3) * 0.02)
    rows = notes(spark, sf_dir).withColumn("times", times)
    at = F.size(F.filter("times", lambda t: t <= F.col("onset")))
    rows = rows.withColumn("at", at).withColumns({"t": F.element_at("times", F.col("at")), "t2": F.element_at("times", F.col("at") + 1)})
    return rows.select("clip_id", "note_id", F.round(F.col("at") - 1 + (F.col("onset") - F.col("t")) / (F.col("t2") - F.col("t")), 6).alias("position"))


@query(
    _N
    + """, bins AS (SELECT clip_id, CAST(floor(onset) AS BIGINT) AS b, count(*) AS n FROM notes GROUP BY 1, 2),
 above AS (SELECT clip_id, b, b - row_number() OVER (PARTITION BY clip_id ORDER BY b) AS grp FROM bins WHERE n >= 1)
SELECT clip_id, min(b) AS first, max(b) AS last FROM above GROUP BY clip_id, grp HAVING count(*) >= 3"""
)
def islands_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least three seconds in a row in which something starts."""
    bins = notes(spark, sf_dir).groupBy("clip_id", F.floor("onset").alias("b")).agg(F.count("*").alias("n"))
    order = W.partitionBy("clip_id").orderBy("b")
    runs = bins.where("n >= 1").withColumn("grp", F.col("b") - F.row_number().over(order))
    found = runs.groupBy("clip_id", "grp").agg(F.min("b").alias("first"), F.max("b").alias("last"), F.count("*").alias("n"))
    return found.where("n >= 3").select("clip_id", "first", "last")


@query(
    _N
    + """ SELECT clip_id, note_id FROM notes a WHERE NOT (duration < 0.2::double AND EXISTS (SELECT 1 FROM notes b WHERE b.clip_id = a.clip_id AND b.pitch = a.pitch AND b.note_id <> a.note_id
   AND b.onset >= a.onset AND b.onset <= a.onset + 1.5::double AND b.duration > a.duration))"""
)
def leading_sparks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes without short ones that a longer one of the same pitch follows at once."""
    from ostinato.operators.joins import band_join

    rows = notes(spark, sf_dir)
    short = rows.where("duration < 0.2")
    led = band_join(short, rows, ["clip_id", "pitch"], "onset", "onset", 1.5)
    gone = led.where("r_note_id <> note_id and r_onset >= onset and r_duration > duration").select("clip_id", "note_id").distinct()
    return rows.join(gone, ["clip_id", "note_id"], "left_anti").select("clip_id", "note_id")


@query(
    with_views("notes", "est")
    + """ SELECT n.clip_id, n.note_id FROM notes n JOIN (SELECT clip_id, pitch, onset - 2 - note_id % 3 * 0.8::double AS seen FROM est) e
  ON e.clip_id = n.clip_id AND e.pitch = n.pitch AND e.seen <= n.onset AND e.seen > n.onset - 3 GROUP BY 1, 2 HAVING min(e.seen) <= n.onset - 1.2::double OR any_value(n.onset) < 3""".replace("n.onset - 1.2", "any_value(n.onset) - 1.2")
)
def seen_falling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes whose piece was in sight at least 40% of a fall before it landed, or that start within the first fall."""
    from ostinato.operators.joins import band_join
    from ostinato.sources.views import estimate

    truth = notes(spark, sf_dir)
    pieces = estimate(truth).select("clip_id", "pitch", (F.col("onset") - 2 - F.col("note_id") % 3 * F.lit(0.8)).alias("seen"))
    near = band_join(truth, pieces, ["clip_id", "pitch"], "onset", "seen", 3.0).where("r_seen <= onset and r_seen > onset - 3")
    first = near.groupBy("clip_id", "note_id").agg(F.min("r_seen").alias("seen"), F.first("onset").alias("onset"))
    return first.where("seen <= onset - 1.2 or onset < 3").select("clip_id", "note_id")


@query(
    _N
    + """ SELECT clip_id, note_id, i AS spark, round(onset + i * 0.05::double, 6) AS born, round(onset + i * 0.05::double + 0.3::double, 6) AS dies FROM notes, (SELECT unnest(range(1, 4)) AS i)
WHERE onset + i * 0.05::double < 12 AND onset + i * 0.05::double + 0.3::double > 10"""
)
def spark_emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three particles per note, those alive in [10 s, 12 s)."""
    rows = notes(spark, sf_dir).withColumn("spark", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))))
    born = F.col("onset") + F.col("spark") * F.lit(0.05)
    alive = rows.where((born < 12) & (born + 0.3 > 10))
    return alive.select("clip_id", "note_id", "spark", F.round(born, 6).alias("born"), F.round(born + 0.3, 6).alias("dies"))


@query(
    _N
    + """, secs AS (SELECT s.clip_id, s.b, p FROM (SELECT clip_id, unnest(range(0, CAST(floor(max(onset)) AS BIGINT) + 1)) AS b FROM notes GROUP BY 1) s
   LEFT JOIN (SELECT clip_id, CAST(floor(onset) AS BIGINT) AS b, avg(pitch) AS p FROM notes WHERE hand = 'L' GROUP BY 1, 2) USING (clip_id, b)),
 filled AS (SELECT clip_id, b, last_value(p IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY b ROWS UNBOUNDED PRECEDING) AS x FROM secs)
SELECT clip_id, b, round(avg(x) OVER (PARTITION BY clip_id ORDER BY b ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS x FROM filled"""
)
def hand_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the left hand is, second by second: its last mean pitch, smoothed over five seconds."""
    truth = notes(spark, sf_dir)
    span = truth.groupBy("clip_id").agg(F.floor(F.max("onset")).alias("hi"))
    every = span.select("clip_id", F.explode(F.sequence(F.lit(0).cast("long"), "hi")).alias("b"))
    means = truth.where("hand = 'L'").groupBy("clip_id", F.floor("onset").alias("b")).agg(F.avg("pitch").alias("p"))
    order = W.partitionBy("clip_id").orderBy("b")
    filled = every.join(means, ["clip_id", "b"], "left").withColumn("x", F.last("p", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return filled.select("clip_id", "b", F.round(F.avg("x").over(order.rowsBetween(-2, 2)), 6).alias("x"))


@query(
    _N
    + """, origin AS (SELECT clip_id, floor((min(onset) - 0.1::double) / 2) * 2 + 0.1::double AS origin FROM notes GROUP BY 1)
SELECT clip_id, note_id, round(onset - origin, 6) AS onset FROM notes JOIN origin USING (clip_id)"""
)
def from_the_downbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets from the bar line at or before the first note."""
    rows = notes(spark, sf_dir)
    origin = rows.groupBy("clip_id").agg((F.floor((F.min("onset") - 0.1) / 2) * 2 + 0.1).alias("origin"))
    return rows.join(origin, "clip_id").select("clip_id", "note_id", F.round(F.col("onset") - F.col("origin"), 6).alias("onset"))


@query(
    """WITH clips AS (SELECT DISTINCT user_id AS clip_id FROM events),
 told AS (SELECT clip_id, 60 + clip_id % 90 AS tempo, [4, 3, 6, 9, 12, 2][clip_id % 6 + 1] AS beats, [4, 4, 8, 8, 8, 4][clip_id % 6 + 1] AS unit FROM clips)
SELECT clip_id, beats, unit, CASE WHEN unit = 8 AND beats IN (6, 9, 12) THEN 'dotted quarter' ELSE 'quarter' END AS mark,
 CAST(CASE WHEN unit = 8 AND beats IN (6, 9, 12) THEN round_even(tempo * 2 / 3::double, 0) ELSE tempo END AS INTEGER) AS per_minute FROM told"""
)
def tempo_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tempo mark of each clip; clips go through the metres by turns."""
    from ostinato.runtime import table

    clip = F.col("clip_id")
    one_of = lambda values: F.element_at(F.array(*map(F.lit, values)), (clip % len(values) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id")).distinct()
    rows = rows.select("clip_id", (60 + clip % 90).alias("tempo"), one_of([4, 3, 6, 9, 12, 2]).alias("beats"), one_of([4, 4, 8, 8, 8, 4]).alias("unit"))
    compound = (F.col("unit") == 8) & F.col("beats").isin(6, 9, 12)
    return rows.select(
        "clip_id", "beats", "unit", F.when(compound, "dotted quarter").otherwise("quarter").alias("mark"),
        F.when(compound, F.rint(F.col("tempo") * 2 / F.lit(3.0))).otherwise(F.col("tempo")).cast("int").alias("per_minute"),
    )


@query(
    _N
    + """ SELECT clip_id, note_id, abs(duration / 0.25::double - round_even(duration / 0.25::double, 0)) < 0.1::double AND round_even(duration / 0.25::double, 0) >= 1 AS whole FROM notes"""
)
def near_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.col("duration") / 0.25
    return notes(spark, sf_dir).select("clip_id", "note_id", ((F.abs(steps - F.rint(steps)) < 0.1) & (F.rint(steps) >= 1)).alias("whole"))


_RUNS = """runs AS (SELECT event_id AS run, user_id % 9 AS client, CASE event_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'queued' ELSE 'done' END AS state, ts AS moment FROM events)"""


@query(
    f"""WITH {_RUNS} SELECT client, count_if(state <> 'done') AS active, count(*) AS runs,
 arg_min(run, (moment, run)) FILTER (state = 'done') AS evict FROM runs GROUP BY 1"""
)
def run_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active runs by client, and the finished one that would go first."""
    from ostinato.runtime import table

    state = F.when(F.col("event_id") % 4 == 0, "running").when(F.col("event_id") % 4 == 1, "queued").otherwise("done")
    runs = table(spark, sf_dir, "events").select(F.col("event_id").alias("run"), (F.col("user_id") % 9).alias("client"), state.alias("state"), F.col("ts").alias("at"))
    done = F.struct("at", "run")
    return runs.groupBy("client").agg(
        F.count_if(F.col("state") != "done").alias("active"), F.count("*").alias("runs"),
        F.min_by("run", F.when(F.col("state") == "done", done)).alias("evict"),
    )


_THEMES = ["aurora", "capture", "classic", "flush", "minimal", "neon", "paper", "sparks", "synthesia"]
_RECIPE_KEYS = ["G major", "D minor", "A minor", "C major", "F major", "E minor"]


@query(
    f"""WITH clips AS (SELECT DISTINCT user_id AS c FROM events),
 recipe AS (SELECT c, {_THEMES}[c % 9 + 1] AS theme, {_RECIPE_KEYS}[c % 6 + 1] AS key, [96, 60, 80, 126, 144][c % 5 + 1] AS tempo, c % 4 = 0 AS sustained FROM clips)
SELECT c AS clip_id, theme || '_88key_seed0' || CASE WHEN sustained THEN '_sustained' ELSE '' END || CASE WHEN key = 'G major' THEN '' ELSE '_' || replace(key, ' ', '') END
 || CASE WHEN tempo = 96 THEN '' ELSE '_' || CAST(tempo AS VARCHAR) || 'bpm' END AS name, tempo, key FROM recipe"""
)
def corpus_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of corpus clips, one for each clip: what is usual goes unsaid."""
    from ostinato.runtime import table

    clip = F.col("clip_id")
    one_of = lambda values: F.element_at(F.array(*map(F.lit, values)), (clip % len(values) + 1).cast("int"))
    clips = table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id")).distinct()
    rows = clips.select("clip_id", one_of(_THEMES).alias("theme"), one_of(_RECIPE_KEYS).alias("key"), one_of([96, 60, 80, 126, 144]).alias("tempo"), (clip % 4 == 0).alias("sustained"))
    part = lambda usual, text: F.when(usual, "").otherwise(text)
    name = F.concat(
        "theme", F.lit("_88key_seed0"), part(~F.col("sustained"), "_sustained"),
        part(F.col("key") == "G major", F.concat(F.lit("_"), F.replace("key", F.lit(" "), F.lit("")))),
        part(F.col("tempo") == 96, F.concat(F.lit("_"), F.col("tempo").cast("string"), F.lit("bpm"))),
    )
    return rows.select("clip_id", name.alias("name"), "tempo", "key")
