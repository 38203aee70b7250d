"""Queries on spelling, openings, bars, scoring windows, made-up pieces, truth files and colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.functions import colour, sql
from ostinato.functions.music import MAJOR_KEYS, MAJOR_SCALE, MINOR_KEYS, MINOR_SCALE
from ostinato.operators import scores as s
from ostinato.plans.catalog import query
from ostinato.runtime import shared_path, table
from ostinato.sources import corpus
from ostinato.sources import tiles as src
from ostinato.sources.views import notes, with_views

_N = with_views("notes")
_RN = _N.replace("WITH ", "WITH RECURSIVE ", 1)
_KEYS = [f"{k} major" for k in MAJOR_KEYS] + [f"{k} minor" for k in MINOR_KEYS]


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.select([F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


_SPELLED = f"""keys AS (SELECT unnest({_KEYS}) AS key), pitches AS (SELECT DISTINCT pitch FROM notes),
 parts AS (SELECT pitch, key, split_part(key, ' ', 1) AS tonic, key LIKE '% minor' AS minor FROM pitches CROSS JOIN keys),
 placed AS (SELECT *, instr('CDEFGAB', tonic[1]) AS letter, len(tonic) - len(replace(tonic, '#', '')) - (len(tonic) - len(replace(tonic, 'b', ''))) AS raised FROM parts),
 degreed AS (SELECT *, ((pitch - {MAJOR_SCALE}[letter] - raised) % 12 + 12) % 12 AS above FROM placed),
 stepped AS (SELECT *, (letter - 1 + CASE WHEN minor THEN {s.MINOR_DEGREES}[above + 1] ELSE {s.MAJOR_DEGREES}[above + 1] END) % 7 AS step FROM degreed),
 turned AS (SELECT *, ((pitch - {MAJOR_SCALE}[step + 1]) % 12 + 12) % 12 AS turn FROM stepped),
 spelt AS (SELECT pitch, key, 'CDEFGAB'[step + 1] AS step, CASE WHEN turn > 6 THEN turn - 12 ELSE turn END AS alter, instr('FCGDAEB', tonic[1]) - 2 + 7 * raised - CASE WHEN minor THEN 3 ELSE 0 END AS signature FROM turned)"""


@query(
    _N
    + ", "
    + _SPELLED
    + """ SELECT pitch, key, CAST(signature AS BIGINT) AS signature, CASE WHEN abs(alter) <= 1 THEN step END AS step, CASE WHEN abs(alter) <= 1 THEN CAST(alter AS INTEGER) END AS alter,
  CASE WHEN abs(alter) <= 1 THEN CAST(floor((pitch - alter) / 12) - 1 AS INTEGER) END AS octave FROM spelt"""
)
def spelled_pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pitch as each key writes it."""
    rows = notes(spark, sf_dir).select("pitch").distinct().select("pitch", F.explode(F.array(*map(F.lit, _KEYS))).alias("key"))
    rows = rows.withColumn("w", s.spelled(F.col("pitch"), F.col("key")))
    return rows.select("pitch", "key", s.signature(F.col("key")).cast("long").alias("signature"), "w.step", "w.alter", "w.octave")


@query(
    _RN
    + """, placed AS (SELECT *, row_number() OVER (PARTITION BY clip_id, pitch ORDER BY onset, note_id) AS i FROM notes),
 walk AS (SELECT clip_id, pitch, i, note_id, onset + duration AS past, true AS kept FROM placed WHERE i = 1 UNION ALL
   SELECT p.clip_id, p.pitch, p.i, p.note_id, CASE WHEN p.onset >= w.past THEN p.onset + p.duration ELSE w.past END, p.onset >= w.past FROM walk w JOIN placed p ON p.clip_id = w.clip_id AND p.pitch = w.pitch AND p.i = w.i + 1)
SELECT clip_id, note_id, pitch FROM walk WHERE kept"""
)
def restrikes_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.without_restrikes(notes(spark, sf_dir)).select("clip_id", "note_id", "pitch")


_WINDOWS = "windows AS (SELECT clip_id, min(onset) + 5 AS lo, max(onset) - 5 AS hi, 50 AS lowest, 68 AS highest FROM notes GROUP BY 1)"


@query(
    _N + f", {_WINDOWS} SELECT n.clip_id, note_id FROM notes n JOIN windows USING (clip_id) WHERE onset >= lo - 0.05::double AND onset <= hi + 0.05::double AND pitch BETWEEN lowest AND highest"
)
def scoring_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir)
    windows = rows.groupBy("clip_id").agg((F.min("onset") + 5).alias("lo"), (F.max("onset") - 5).alias("hi"), F.lit(50).alias("lowest"), F.lit(68).alias("highest"))
    return s.scored(rows, windows, 0.05).select("clip_id", "note_id")


@query(
    _N
    + """, written AS (SELECT clip_id, pitch, onset + 0.0000001::double AS onset, round_even(duration / 0.125::double, 0) AS value, note_id AS written_id FROM notes WHERE note_id % 2 = 0)
SELECT n.clip_id, note_id, written_id, round(value, 6) AS value FROM notes n JOIN written w ON n.clip_id = w.clip_id AND n.pitch = w.pitch AND round(n.onset, 6) = round(w.onset, 6)"""
)
def written_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written values found by pitch and onset, not by number."""
    rows = notes(spark, sf_dir)
    written = rows.where("note_id % 2 = 0").select(
        "clip_id", "pitch", (F.col("onset") + 0.0000001).alias("onset"), F.rint(F.col("duration") / 0.125).alias("value"), F.col("note_id").alias("written_id")
    )
    return _r(s.by_written_place(rows, written).select("clip_id", "note_id", "written_id", "value"), "value")


@query(
    _N
    + f""", firsts AS (SELECT clip_id, min(onset) AS first FROM notes GROUP BY 1), early AS (SELECT n.*, first FROM notes n JOIN firsts USING (clip_id) WHERE onset < first + 4::double),
 accented AS (SELECT clip_id, onset, first, least(duration / 0.5::double, 4) * CASE WHEN pitch <= bass THEN 3 ELSE 1 END AS accent, n FROM early
   JOIN (SELECT clip_id, quantile_cont(pitch, 0.35) AS bass, count(*) AS n FROM early GROUP BY 1) USING (clip_id)),
 scales AS (SELECT unnest(range({len(s.SCALES)})) AS rank, unnest([{", ".join(f"{x}::double" for x in s.SCALES)}]) AS scale),
 tries AS (SELECT rank, 0.5::double * scale AS local, unnest(range(CAST(ceil(0.5::double * scale / 0.01::double) AS BIGINT))) AS k FROM scales),
 placed AS (SELECT clip_id, first, rank, k, n, accent, (onset - first - k * 0.01::double) / local AS place FROM accented CROSS JOIN tries),
 summed AS (SELECT clip_id, first, rank, k, n, sum(CASE WHEN abs(place - round_even(place, 0)) < 0.2::double THEN accent ELSE 0 END) AS weight FROM placed GROUP BY 1, 2, 3, 4, 5),
 best AS (SELECT clip_id, any_value(n) AS n, arg_max(first + k * 0.01::double, (round(weight, 9), -rank, -k)) AS chosen FROM summed GROUP BY 1)
SELECT clip_id, round(CASE WHEN n >= 8 THEN chosen ELSE 0.1::double END, 6) AS phase FROM best"""
)
def opening_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(s.opening_phase(notes(spark, sf_dir), 0.5, 0.1), "phase")


@query(
    _N
    + """, low AS (SELECT clip_id, (onset - 0.1::double) / 0.25::double AS place FROM notes JOIN (SELECT clip_id, quantile_cont(pitch, 0.35) AS bass FROM notes GROUP BY 1) USING (clip_id) WHERE pitch <= bass),
 told AS (SELECT clip_id, CAST(round_even(place, 0) AS BIGINT) AS b, abs(place - round_even(place, 0)) < 0.25::double AS near FROM low),
 span AS (SELECT clip_id, min(b) AS lo, max(b) AS hi FROM told GROUP BY 1 HAVING count(*) >= 8),
 series AS (SELECT clip_id, b, coalesce(x, 0) AS x FROM (SELECT clip_id, unnest(range(lo, hi + 1)) AS b FROM span) LEFT JOIN (SELECT clip_id, b, count(*) AS x FROM told WHERE near GROUP BY 1, 2) USING (clip_id, b)),
 centred AS (SELECT clip_id, b, x - avg(x) OVER (PARTITION BY clip_id) AS c, count(*) OVER (PARTITION BY clip_id) AS n FROM series),
 lags AS (SELECT unnest([6, 9, 12]) AS lag),
 power AS (SELECT clip_id, max(n) AS n, sum(c * c) AS power FROM centred GROUP BY 1),
 sums AS (SELECT a.clip_id, lag, sum(a.c * b.c) AS s FROM centred a CROSS JOIN lags JOIN centred b ON a.clip_id = b.clip_id AND b.b = a.b + lag GROUP BY 1, 2),
 matched AS (SELECT p.clip_id, l.lag, coalesce(coalesce(s, 0) / nullif(power, 0), 0) AS match FROM power p CROSS JOIN lags l LEFT JOIN sums q ON q.clip_id = p.clip_id AND q.lag = l.lag WHERE l.lag < n),
 best AS (SELECT clip_id, arg_max(lag, (round(match, 9), -lag)) AS eighths FROM matched GROUP BY 1)
SELECT clip_id, CAST(coalesce(eighths, 6) AS INTEGER) AS eighths FROM (SELECT DISTINCT clip_id FROM notes) LEFT JOIN best USING (clip_id)"""
)
def eighths_in_a_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bar of a compound metre, from the bass alone."""
    return s.eighths_in_a_bar(notes(spark, sf_dir), 0.25, 0.1)


_C = _N + ", " + src.CLOCK


@query(_C + " SELECT clip_id, frame, round(time, 6) AS time FROM clock WHERE frame = 17")
def frame_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame of each clip."""
    return _r(src.frame_clock(notes(spark, sf_dir)).where("frame = 17").select("clip_id", "frame", "time"), "time")


@query(
    _C
    + """, total AS (SELECT clip_id, count(*) AS n FROM clock GROUP BY 1), bounds AS (SELECT clip_id, CASE WHEN floor(n * 0.9::double) - floor(n * 0.1::double) >= 12 THEN floor(n * 0.1::double) ELSE 0 END AS lo,
   CASE WHEN floor(n * 0.9::double) - floor(n * 0.1::double) >= 12 THEN floor(n * 0.9::double) ELSE n END AS hi FROM total),
 wanted AS (SELECT DISTINCT clip_id, CAST(floor(lo + (hi - 1 - lo) * k / 11) AS BIGINT) AS frame FROM bounds, (SELECT unnest(range(12)) AS k))
SELECT clip_id, frame FROM clock SEMI JOIN wanted USING (clip_id, frame)"""
)
def two_pass_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve frames of each clip, spread over its middle; how many frames there are is counted first."""
    return s.spread_sample(src.frame_clock(notes(spark, sf_dir)), 12, 0.1).select("clip_id", "frame")


def _draw(bar: str, step: str, voice: int, of: int) -> str:
    return f"((clip_id * 7919 + {bar} * 104729 + {step} * 1299709 + {voice * 15_485_863} + 12345) * 48271 % 2147483647 % {of})"


def _degree(degree: str) -> str:
    return f"(CASE WHEN minor THEN {MINOR_SCALE}[({degree}) % 7 + 1] ELSE {MAJOR_SCALE}[({degree}) % 7 + 1] END + 12 * (({degree}) // 7))"


@query(
    f"""WITH pieces AS (SELECT custkey AS clip_id, 60 + custkey % 90 AS tempo, custkey % 12 AS tonic, custkey % 2 = 1 AS minor FROM (SELECT c_custkey::bigint AS custkey FROM customer)),
 steps AS (SELECT *, 60 / tempo::double AS beat, bar, step FROM pieces, (SELECT unnest(range(8)) AS bar), (SELECT unnest(range(8)) AS step)),
 made AS (SELECT clip_id, (bar * 4 + step / 2::double) * beat AS onset, 36 + tonic + {_degree(f"[0, 3, 4][{_draw('bar', '0', 0, 3)} + 1]")} + 12 * (step // 2 % 2) AS pitch, beat * 0.9::double AS duration, 'L' AS hand FROM steps WHERE step % 2 = 0
   UNION ALL SELECT clip_id, (bar * 4 + step / 2::double) * beat, 60 + tonic + {_degree(_draw('bar', 'step', 2, 10))}, beat * 0.45::double, 'R' FROM steps WHERE {_draw('bar', 'step', 1, 5)} > 0)
SELECT clip_id, round(onset, 6) AS onset, CAST(pitch AS BIGINT) AS pitch, round(duration, 6) AS duration, hand FROM made"""
)
def generated_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up piece of eight bars for each customer."""
    key = F.col("c_custkey").cast("long")
    pieces = table(spark, sf_dir, "customer").select(
        key.alias("clip_id"), (F.lit(60) + key % 90).alias("tempo"), (key % 12).alias("tonic"), (key % 2 == 1).alias("minor")
    )
    return _r(s.generated(pieces, 8), "onset", "duration")


@query(_N + " SELECT clip_id, 120::double AS tempo, note_id, pitch, round(onset, 6) AS onset, round(duration, 6) AS duration, hand, velocity FROM notes")
def truth_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes written as truth files and read back."""
    folder = shared_path(spark, "truth")
    corpus.write_truth(notes(spark, sf_dir), folder)
    found, bad = corpus.load_truth(spark, folder)
    if not bad.isEmpty():
        raise ValueError(f"a truth file has no sequence: {bad.first()['value'][:200]}")
    return _r(found, "onset", "duration")


_LIST = """files AS (SELECT DISTINCT 'corpus/clip_' || user_id || '.truth.json' AS path FROM events UNION SELECT 'corpus/clip_' || user_id || '.mp4' FROM events WHERE user_id % 3 <> 0
  UNION SELECT 'corpus/clip_' || user_id || '.mkv' FROM events WHERE user_id % 2 = 0 UNION SELECT 'corpus/other_' || user_id || '.avi' FROM events WHERE user_id % 7 = 0)"""


@query(
    f"""WITH {_LIST}, truths AS (SELECT path[:-12] AS stem, path AS truth FROM files WHERE path LIKE '%.truth.json'),
 videos AS (SELECT path[:-5] AS stem, path, CASE path[-3:] WHEN 'mp4' THEN 1 WHEN 'avi' THEN 2 ELSE 3 END AS rank FROM files WHERE path[-4:] IN ('.mp4', '.avi', '.mkv'))
SELECT stem, truth, video FROM truths LEFT JOIN (SELECT stem, arg_min(path, rank) AS video FROM videos GROUP BY 1) USING (stem)"""
)
def paired_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth files with their videos, from a listing made of the clips' numbers."""
    clips = table(spark, sf_dir, "events").select(F.col("user_id").alias("u")).distinct()
    named = lambda start, end: F.concat(F.lit(start), F.col("u").cast("string"), F.lit(end)).alias("path")
    files = clips.select(named("corpus/clip_", ".truth.json"))
    for keep, start, end in (("u % 3 <> 0", "corpus/clip_", ".mp4"), ("u % 2 = 0", "corpus/clip_", ".mkv"), ("u % 7 = 0", "corpus/other_", ".avi")):
        files = files.unionAll(clips.where(keep).select(named(start, end)))
    return corpus.paired_clips(files)


@query(
    _N
    + """ SELECT note_id, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][pitch % 12 + 1] || CAST(pitch // 12 - 1 AS VARCHAR) AS name, pitch % 12 IN (1, 3, 6, 8, 10) AS black,
 round(440 * pow(2::double, (pitch - 69) / 12::double), 6) AS hz, round(round_even((onset - 0.1::double) / 0.125::double, 0) * 0.125::double + 0.1::double, 6) AS snapped, round(onset - floor(onset / 0.5::double) * 0.5::double, 6) AS place,
 round(2 * 0.8::double * velocity / (0.8::double + velocity), 6) AS f1 FROM notes"""
)
def registered_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar functions called from SQL."""
    sql.register(spark)
    return notes(spark, sf_dir).selectExpr(
        "note_id", "pitch_name(pitch) AS name", "is_black_key(pitch) AS black", "round(pitch_hz(pitch), 6) AS hz",
        "round(snap_to_grid(onset, 0.125D, 0.1D), 6) AS snapped", "round(floor_mod(onset, 0.5D), 6) AS place", "round(f1_score(0.8D, velocity), 6) AS f1",
    )


def _lab(b: str, g: str, r: str) -> str:
    """A query's columns L, a, b of a colour; both colours of a pair are made this way."""
    line = lambda c: f"CASE WHEN {c} / 255 <= 0.04045::double THEN {c} / 255 / 12.92::double ELSE pow(({c} / 255 + 0.055::double) / 1.055::double, 2.4::double) END"
    return f"{line(r)} AS lr, {line(g)} AS lg, {line(b)} AS lb"


_COLOURS = f"""cols AS (SELECT event_id, (event_id * 37 % 256)::double AS b, (event_id * 101 % 256)::double AS g, (event_id * 211 % 256)::double AS r FROM events),
 lin AS (SELECT event_id, {_lab('b', 'g', 'r')} FROM cols),
 xyz AS (SELECT event_id, (lr * 0.412453::double + lg * 0.357580::double + lb * 0.180423::double) / 0.950456::double AS x, (lr * 0.212671::double + lg * 0.715160::double + lb * 0.072169::double) / 1.0::double AS y,
   (lr * 0.019334::double + lg * 0.119193::double + lb * 0.950227::double) / 1.088754::double AS z FROM lin),
 roots AS (SELECT event_id, y, CASE WHEN x > 0.008856::double THEN pow(x, 1 / 3::double) ELSE x * 7.787::double + 16 / 116::double END AS fx, CASE WHEN y > 0.008856::double THEN pow(y, 1 / 3::double) ELSE y * 7.787::double + 16 / 116::double END AS fy,
   CASE WHEN z > 0.008856::double THEN pow(z, 1 / 3::double) ELSE z * 7.787::double + 16 / 116::double END AS fz FROM xyz),
 labs AS (SELECT event_id, CASE WHEN y > 0.008856::double THEN fy * 116 - 16 ELSE y * 903.3::double END * 2.55::double AS L, (fx - fy) * 500 + 128 AS a, (fy - fz) * 200 + 128 AS b FROM roots)"""


def _colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: (F.col("event_id") * k % 256).cast("double")
    return table(spark, sf_dir, "events").select("event_id", colour.lab(part(37), part(101), part(211)).alias("lab"))


@query(f"WITH {_COLOURS} SELECT event_id, round(L, 5) AS l, round(a, 5) AS a, round(b, 5) AS b FROM labs")
def lab_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _colours(spark, sf_dir).select("event_id", F.round("lab.L", 5).alias("l"), F.round("lab.a", 5).alias("a"), F.round("lab.b", 5).alias("b"))


@query(
    f"""WITH {_COLOURS}, pairs AS (SELECT p.event_id, p.L AS l1, p.a - 128 AS a1, p.b - 128 AS b1, q.L AS l2, q.a - 128 AS a2, q.b - 128 AS b2, z.L AS l0, z.a - 128 AS a0, z.b - 128 AS b0
   FROM labs p JOIN labs q ON q.event_id = p.event_id + 1 CROSS JOIN (SELECT * FROM labs WHERE event_id = 0) z),
 told AS (SELECT *, degrees(atan2(b1, a1)) - degrees(atan2(b2, a2)) + 180 AS turn, sqrt(pow((l1 - l0) * 0.35::double, 2) + pow(a1 - a0, 2) + pow(b1 - b0, 2)) AS mine,
   sqrt(pow((l2 - l0) * 0.35::double, 2) + pow(a2 - a0, 2) + pow(b2 - b0, 2)) AS theirs FROM pairs)
SELECT event_id, sqrt(a1 * a1 + b1 * b1) >= 12 AND sqrt(a2 * a2 + b2 * b2) >= 12 AND abs(turn - floor(turn / 360) * 360 - 180) < 20 AS same_hue,
  CASE WHEN abs(mine - theirs) > greatest(mine, theirs) * 0.05::double THEN mine > theirs ELSE abs(l1 - l0) > abs(l2 - l0) END AS farther FROM told"""
)
def colour_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each colour against the next: the same hue, and farther from the background (the first colour)."""
    rows = _colours(spark, sf_dir)
    later = rows.select((F.col("event_id") - 1).alias("event_id"), F.col("lab").alias("next"))
    background = rows.where("event_id = 0").select(F.col("lab").alias("ground"))  # one row
    both = rows.join(later, "event_id").crossJoin(F.broadcast(background))
    one, two, ground = F.col("lab"), F.col("next"), F.col("ground")
    return both.select("event_id", colour.same_hue(one, two, 20.0).alias("same_hue"), colour.farther_from(one, two, ground, 0.35, 0.05).alias("farther"))
