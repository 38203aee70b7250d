"""Spelling of pitches, openings, compound bars, restrikes, scoring windows and generated pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.functions.music import LOWEST, MAJOR_SCALE, MINOR_SCALE, nearest_unit
from ostinato.operators import rhythm

# The letters of the naturals in MAJOR_SCALE, and the degree that each semitone above the tonic is written on.
LETTERS = "CDEFGAB"
MAJOR_DEGREES = [0, 0, 1, 2, 2, 3, 3, 4, 5, 5, 6, 6]
MINOR_DEGREES = [0, 1, 1, 2, 2, 3, 3, 4, 5, 5, 6, 6]
# The opening's length in beats, the step of its search in seconds, its tolerance in beats; scales nearest to 1 first.
OPENING, OFFSET_STEP, ANCHOR = 8, 0.01, 0.2
SCALES = [1.0, 0.98, 1.02, 0.96, 1.04, 0.94, 1.06, 0.92, 1.08]


def _nth(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), at.cast("int") + 1)


def spelled(pitch: Column, key: Column) -> Column:
    """struct(step, alter, octave) of a pitch by its scale degree in a key such as 'Eb minor'; null for an unknown key or where that
    needs a double accidental."""
    name, mode = F.split(key, " ")[0], F.lower(F.split(key, " ")[1])
    letter = F.instr(F.lit(LETTERS), F.substring(key, 1, 1)) - 1
    raised = F.length(name) - F.length(F.replace(name, F.lit("#"))) - (F.length(name) - F.length(F.replace(name, F.lit("b"))))
    above = F.pmod(pitch - _nth(MAJOR_SCALE, letter) - raised, F.lit(12))
    degree = F.when(F.coalesce(mode.startswith("min"), F.lit(False)), _nth(MINOR_DEGREES, above)).otherwise(_nth(MAJOR_DEGREES, above))
    step = F.pmod(letter + degree, F.lit(7))
    turn = F.pmod(pitch - _nth(MAJOR_SCALE, step), F.lit(12))
    alter = F.when(turn > 6, turn - 12).otherwise(turn).cast("int")
    written = F.struct(
        F.substring(F.lit(LETTERS), (step + 1).cast("int"), F.lit(1)).alias("step"), alter.alias("alter"), (F.floor((pitch - alter) / 12) - 1).cast("int").alias("octave")
    )
    return F.when(letter >= 0, F.when(F.abs(alter) <= 1, written))


def signature(key: Column) -> Column:
    """Sharps (positive) or flats of a key, counted along the circle of fifths from F C G D A E B."""
    name, mode = F.split(key, " ")[0], F.lower(F.split(key, " ")[1])
    raised = F.length(name) - F.length(F.replace(name, F.lit("#"))) - (F.length(name) - F.length(F.replace(name, F.lit("b"))))
    place = F.instr(F.lit("FCGDAEB"), F.substring(key, 1, 1))
    return F.when(place > 0, place - 2 + 7 * raised - F.when(mode.startswith("min"), 3).otherwise(0))


def without_restrikes(notes: DataFrame) -> DataFrame:
    """Notes without those that strike a key that still sounds; only notes that stay make it sound. Columns: clip_id, note_id, pitch,
    onset, duration."""
    rows = notes.groupBy("clip_id", "pitch").agg(F.array_sort(F.collect_list(F.struct("onset", "note_id", "duration"))).alias("notes"))
    start = F.struct(F.lit(-1.0).alias("past"), F.array().cast("array<struct<onset:double,note_id:bigint,duration:double>>").alias("kept"))

    def step(state: Column, note: Column) -> Column:
        struck = note["onset"] >= state["past"]
        past = F.when(struck, note["onset"] + note["duration"]).otherwise(state["past"])
        return F.struct(past.alias("past"), F.when(struck, F.array_append(state["kept"], note)).otherwise(state["kept"]).alias("kept"))

    kept = F.aggregate("notes", start, step)["kept"]
    return rows.select("clip_id", "pitch", F.inline(kept)).select("clip_id", "note_id", "pitch", "onset", "duration")


def scored(notes: DataFrame, windows: DataFrame, tolerance: float) -> DataFrame:
    """Notes within their clip's window (clip_id, lo, hi, lowest, highest), tolerance included, and within its range of keys."""
    rows = notes.join(windows, "clip_id")
    inside = F.col("onset").between(F.col("lo") - tolerance, F.col("hi") + tolerance) & F.col("pitch").between(F.col("lowest"), F.col("highest"))
    return rows.where(inside).drop("lo", "hi", "lowest", "highest")


def by_written_place(notes: DataFrame, written: DataFrame) -> DataFrame:
    """Notes with the written values of their clip that have their pitch and, to a millionth of a second, their onset."""
    named = written.withColumn("_at", nearest_unit(F.col("onset"), 6)).drop("onset")
    return notes.withColumn("_at", nearest_unit(F.col("onset"), 6)).join(named, ["clip_id", "pitch", "_at"]).drop("_at")


def opening_phase(notes: DataFrame, beat: float, phase: float) -> DataFrame:
    """(clip_id, phase): where the beat lies in the first beats: of all offsets at paces near the beat's the one that most accent falls
    on; pace nearest to the beat's and the smallest offset first. A clip with too few early notes keeps ``phase``."""
    first = notes.groupBy("clip_id").agg(F.min("onset").alias("first"))
    early = notes.join(first, "clip_id").where(F.col("onset") < F.col("first") + OPENING * beat)
    accented = rhythm.accents(early, beat)
    scale = F.posexplode(F.array(*map(F.lit, SCALES))).alias("rank", "scale")
    rows = accented.select("clip_id", "onset", "first", "accent", scale).withColumn("local", F.lit(beat) * F.col("scale"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("local") / OFFSET_STEP) - 1).cast("int"))))
    place = (F.col("onset") - F.col("first") - F.col("k") * OFFSET_STEP) / F.col("local")
    near = F.when(F.abs(place - F.rint(place)) < ANCHOR, F.col("accent")).otherwise(0.0)
    sums = rows.groupBy("clip_id", "first", "rank", "k").agg(F.sum(near).alias("weight"), F.count("*").alias("n"))
    best = F.max_by(F.struct("first", "k"), F.struct(F.round("weight", 9), -F.col("rank"), -F.col("k"))).alias("best")
    found = sums.groupBy("clip_id").agg(best, F.max("n").alias("n"))
    chosen = F.when(F.col("n") >= rhythm.MIN_ONSETS, F.col("best.first") + F.col("best.k") * OFFSET_STEP).otherwise(F.lit(phase))
    return found.select("clip_id", chosen.alias("phase"))


def eighths_in_a_bar(notes: DataFrame, eighth: float, phase: float) -> DataFrame:
    """(clip_id, eighths): 6, 9 or 12, how far apart the bass comes round; 6 where too little tells."""
    bass = notes.groupBy("clip_id").agg(F.percentile("pitch", F.lit(rhythm.BASS_SHARE)).alias("bass"))
    place = (F.col("onset") - phase) / eighth
    low = notes.join(bass, "clip_id").where("pitch <= bass").select("clip_id", F.rint(place).cast("long").alias("b"), (F.abs(place - F.rint(place)) < 0.25).alias("near"))
    span = low.groupBy("clip_id").agg(F.min("b").alias("lo"), F.max("b").alias("hi"), F.count("*").alias("n")).where(F.col("n") >= rhythm.MIN_ONSETS)
    hit = low.where("near").groupBy("clip_id", "b").agg(F.count("*").cast("double").alias("x"))
    every = span.select("clip_id", F.explode(F.sequence("lo", "hi")).alias("b")).join(hit, ["clip_id", "b"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    matches = rhythm.autocorrelation(every, [6, 9, 12])
    best = matches.groupBy("clip_id").agg(F.max_by("lag", F.struct(F.round("match", 9), -F.col("lag"))).alias("eighths"))
    return notes.select("clip_id").distinct().join(best, "clip_id", "left").select("clip_id", F.coalesce("eighths", F.lit(6)).cast("int").alias("eighths"))


def spread_sample(clock: DataFrame, count: int, margin: float) -> DataFrame:
    """``count`` frames of each clip, evenly spread over what lies inside the margins, or over the whole clip if that is too short;
    the number of frames is counted first."""
    total = clock.groupBy("clip_id").agg(F.count("*").alias("n"))
    lo, hi = F.floor(F.col("n") * margin), F.floor(F.col("n") * (1 - margin))
    roomy = hi - lo >= count
    bounds = total.select("clip_id", F.when(roomy, lo).otherwise(0).alias("lo"), F.when(roomy, hi).otherwise(F.col("n")).alias("hi"))
    at = F.floor(F.col("lo") + (F.col("hi") - 1 - F.col("lo")) * F.col("k") / (count - 1)).cast("long")
    wanted = bounds.select("clip_id", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("k")).select("clip_id", at.alias("frame")).distinct()
    return clock.join(wanted, ["clip_id", "frame"], "left_semi")


def _drawn(clip: Column, bar: Column, step: Column, voice: int, of: int) -> Column:
    """A number below ``of`` that seed, bar, step and voice decide."""
    return (clip * 7919 + bar * 104_729 + step * 1_299_709 + voice * 15_485_863 + 12_345) * 48_271 % 2_147_483_647 % of


def generated(clips: DataFrame, bars: int, beats: int = 4) -> DataFrame:
    """Notes of made-up pieces: clips (clip_id, tempo, tonic, minor). The left hand strikes the tonic, fourth or fifth of each bar on
    every beat an octave apart by turns, the right hand steps about the scale in half beats and rests now and then."""
    rows = clips.select("*", (60 / F.col("tempo")).alias("beat"), F.explode(F.sequence(F.lit(0), F.lit(bars - 1))).alias("bar"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(2 * beats - 1))).alias("step"))
    scale = lambda degree: F.when(F.col("minor"), _nth(MINOR_SCALE, F.pmod(degree, F.lit(7)))).otherwise(_nth(MAJOR_SCALE, F.pmod(degree, F.lit(7)))) + 12 * F.floor(degree / 7)
    clip, bar, step = F.col("clip_id"), F.col("bar"), F.col("step")
    onset = (F.col("bar") * beats + F.col("step") / 2) * F.col("beat")
    root = _nth([0, 3, 4], _drawn(clip, bar, F.lit(0), 0, 3))
    left = rows.where("step % 2 = 0").select(
        "clip_id", onset.alias("onset"), (F.lit(LOWEST + 15) + F.col("tonic") + scale(root) + 12 * (step / 2 % 2)).cast("long").alias("pitch"),
        (F.col("beat") * 0.9).alias("duration"), F.lit("L").alias("hand"),
    )
    right = rows.where(_drawn(clip, bar, step, 1, 5) > 0).select(
        "clip_id", onset.alias("onset"), (F.lit(LOWEST + 39) + F.col("tonic") + scale(_drawn(clip, bar, step, 2, 10))).cast("long").alias("pitch"),
        (F.col("beat") * 0.45).alias("duration"), F.lit("R").alias("hand"),
    )
    return left.unionAll(right)
