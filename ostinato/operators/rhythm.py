"""Beat, phase, metre and grids of note onsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ostinato.functions.music import floor_mod

BASS_SHARE, MAX_SHIFT, MIN_ONSETS, TATUM_TOLERANCE = 0.35, 0.35, 8, 0.92
#: Onsets that are laid on all circles at once.
CHUNK = 256


def distinct_onsets(notes: DataFrame) -> DataFrame:
    return notes.select("clip_id", F.round("onset", 4).alias("onset")).distinct()


def period_grid(low: float, high: float, count: int) -> list[float]:
    return [low + k * (high - low) / (count - 1) for k in range(count)]


def coherence(onsets: DataFrame, periods: list[float]) -> DataFrame:
    """Per clip and period: length of the mean unit vector of onsets on a circle of that period (clip_id, k, period, n, score).

    Onsets stream by clip; all periods are summed at once for up to CHUNK of them, so nothing is multiplied by the number of periods
    but the sums of a clip.
    """
    grid = np.array(periods)
    names = ["clip_id", "n", "scores"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, total = None, 0, np.zeros(len(grid), dtype=complex)
        out: list[tuple] = []

        def close() -> None:
            if now is not None:
                out.append((now, n, np.abs(total / n)))

        for batch in batches:
            clips, times = (batch.column(k).to_numpy() for k in range(2))
            edges = [0, *(np.flatnonzero(clips[1:] != clips[:-1]) + 1).tolist(), len(clips)]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if low == high:
                    continue
                if clips[low] != now:
                    close()
                    now, n, total = int(clips[low]), 0, np.zeros(len(grid), dtype=complex)
                for k in range(low, high, CHUNK):
                    turn = times[k : min(k + CHUNK, high), None] * (2 * np.pi) / grid
                    total += np.cos(turn).sum(axis=0) + 1j * np.sin(turn).sum(axis=0)
                n += high - low
            if out:
                yield _scored(out)
                out.clear()
        close()
        yield _scored(out)

    def _scored(rows: list[tuple]) -> pa.RecordBatch:
        scores = pa.array([r[2] for r in rows], pa.list_(pa.float64()))
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), scores], names=names)

    dealt = onsets.select(F.col("clip_id").cast("long").alias("clip_id"), "onset").repartition("clip_id").sortWithinPartitions("clip_id")
    found = dealt.mapInArrow(run, "clip_id long, n long, scores array<double>")
    listed = F.posexplode(F.arrays_zip("scores", F.array(*map(F.lit, periods)).alias("periods"))).alias("k", "x")
    return found.select("clip_id", "n", listed).select("clip_id", "k", F.col("x.periods").alias("period"), "n", F.col("x.scores").alias("score"))


def tatum(scores: DataFrame) -> DataFrame:
    """The largest period whose coherence is at least 92% of the best one's; clips of fewer than eight onsets have none."""
    best = scores.groupBy("clip_id").agg(F.max("score").alias("best"), F.max("n").alias("n")).where(F.col("n") >= MIN_ONSETS)
    good = scores.join(best.drop("n"), "clip_id").where(F.col("score") >= F.col("best") * TATUM_TOLERANCE)
    return good.groupBy("clip_id").agg(F.max("period").alias("tatum"), F.max("best").alias("best"))


def accents(notes: DataFrame, beat: float) -> DataFrame:
    """Notes with the weight of their accent: length in beats up to four, threefold in the bass."""
    bass = notes.groupBy("clip_id").agg(F.percentile("pitch", F.lit(BASS_SHARE)).alias("bass"))
    weight = F.least(F.col("duration") / beat, F.lit(4.0)) * F.when(F.col("pitch") <= F.col("bass"), 3.0).otherwise(1.0)
    return notes.join(bass, "clip_id").withColumn("accent", weight)


def beat_phase(accented: DataFrame, beat: float, tatum: float) -> DataFrame:
    """The tatum line whose notes carry most accent; the first of equal ones."""
    lines = max(1, round(beat / tatum))
    rows = accented.select("clip_id", "onset", "accent", F.explode(F.array(*map(F.lit, range(lines)))).alias("line"))
    phase = floor_mod(F.col("line") * tatum, F.lit(beat))
    place = (F.col("onset") - phase) / beat
    near = F.abs(place - F.rint(place)) * beat < tatum / 2
    sums = rows.groupBy("clip_id", "line").agg(F.sum(F.when(near, F.col("accent")).otherwise(0.0)).alias("weight"))
    best = F.max_by("line", F.struct(F.round("weight", 9), -F.col("line")))
    return sums.groupBy("clip_id").agg(best.alias("line"), F.max("weight").alias("weight"))


def downbeat(notes: DataFrame, beat: float, phase: float, bar: int) -> DataFrame:
    """The beat of the bar that low notes vote for: each note weighs 2 ** ((60 - pitch) / 12)."""
    index = F.pmod(F.rint((F.col("onset") - phase) / beat).cast("long"), F.lit(bar))
    votes = notes.groupBy("clip_id", index.alias("beat")).agg(F.sum(F.pow(F.lit(2.0), (F.lit(60) - F.col("pitch")) / 12)).alias("votes"))
    best = F.max_by("beat", F.struct(F.round("votes", 9), -F.col("beat")))
    return votes.groupBy("clip_id").agg(best.alias("downbeat"), F.max("votes").alias("votes"))


def beat_series(accented: DataFrame, beat: float, phase: float) -> DataFrame:
    """Accent per beat number, beats without notes included."""
    place = (F.col("onset") - phase) / beat
    hit = accented.where(F.abs(place - F.rint(place)) < 0.2).groupBy("clip_id", F.rint(place).cast("long").alias("b")).agg(F.sum("accent").alias("x"))
    span = hit.groupBy("clip_id").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    every = span.select("clip_id", F.explode(F.sequence("lo", "hi")).alias("b"))
    return every.join(hit, ["clip_id", "b"], "left").select("clip_id", "b", F.coalesce("x", F.lit(0.0)).alias("x"))


def autocorrelation(series: DataFrame, lags: list[int]) -> DataFrame:
    """Per clip and lag shorter than the series: sum of c[i] c[i + lag] over sum of c[i] squared, c without its mean."""
    whole = W.partitionBy("clip_id")
    centred = series.withColumn("c", F.col("x") - F.avg("x").over(whole)).withColumn("n", F.count("*").over(whole))
    order = whole.orderBy("b")
    sums = [F.sum(F.col("c") * F.col(f"c{k}")).alias(f"s{k}") for k in lags]
    rows = centred.withColumns({f"c{k}": F.lead("c", k).over(order) for k in lags})
    agg = rows.groupBy("clip_id").agg(*sums, F.sum(F.col("c") * F.col("c")).alias("power"), F.max("n").alias("n"))
    pairs = ", ".join(f"{k}, s{k}" for k in lags)
    long = agg.select("clip_id", "n", "power", F.expr(f"stack({len(lags)}, {pairs}) as (lag, s)"))
    return long.where("lag < n").select("clip_id", "lag", "n", F.coalesce(F.try_divide("s", "power"), F.lit(0.0)).alias("match"))


def metre(matches: DataFrame, beat: float) -> DataFrame:
    """Beats in the bar: 6 for quick beats that repeat at six, 3 where three beats four, else 4."""
    of = lambda lag: F.coalesce(F.max(F.when(F.col("lag") == lag, F.col("match"))), F.lit(-1.0)).alias(f"m{lag}")
    wide = matches.groupBy("clip_id").agg(F.max("n").alias("n"), *[of(k) for k in (2, 3, 4, 6)])
    six = F.lit(beat <= 0.55) & (F.col("n") > 12) & (F.col("m6") >= F.greatest("m3", "m4", F.lit(0.0)) + 0.2)
    three = (F.col("m3") > F.col("m4")) & ((F.col("n") < 24) | (F.col("m3") > F.col("m2")))
    return wide.select("clip_id", F.when(F.col("n") < 12, 4).when(six, 6).when(three, 3).otherwise(4).alias("beats_per_bar"))


def repeats_at(onsets: DataFrame, lag: float, tolerance: float) -> DataFrame:
    """Share of a clip's onsets that have another one ``lag`` later, within the tolerance (a semi join on a band).

    Only onsets with room for a partner before the clip's last onset count; a clip without any has a share of 0.
    """
    from ostinato.operators.joins import band_join

    last = onsets.groupBy("clip_id").agg(F.max("onset").alias("last"))
    due = onsets.join(last, "clip_id").withColumns({"due": F.col("onset") + lag, "room": F.col("onset") + lag <= F.col("last") + tolerance})
    partner = band_join(due.where("room"), onsets, ["clip_id"], "due", "onset", tolerance).select("clip_id", "onset").distinct().withColumn("hit", F.lit(1.0))
    joined = due.join(partner, ["clip_id", "onset"], "left")
    share = F.avg(F.when(F.col("room"), F.coalesce("hit", F.lit(0.0))))
    return joined.groupBy("clip_id").agg(F.coalesce(share, F.lit(0.0)).alias("share"))


def pitch_returns(notes: DataFrame, step: float, lag: int) -> DataFrame:
    """Share of grid slots of which some pitch sounds again ``lag`` slots later."""
    slots = notes.groupBy("clip_id", F.rint(F.col("onset") / step).cast("long").alias("slot")).agg(F.collect_set("pitch").alias("here"))
    later = slots.select("clip_id", (F.col("slot") - lag).alias("slot"), F.col("here").alias("there"))
    both = slots.join(later, ["clip_id", "slot"])
    return both.groupBy("clip_id").agg(F.avg(F.arrays_overlap("here", "there").cast("double")).alias("share"), F.count("*").alias("slots"))


def tempo_windows(onsets: DataFrame, width: float, hop: float) -> DataFrame:
    """Onsets in half-overlapping windows that start at the clip's first onset."""
    first = onsets.groupBy("clip_id").agg(F.min("onset").alias("t0"), F.max("onset").alias("t1"))
    since = F.col("onset") - F.col("t0")
    top = F.floor(since / hop)
    low = F.greatest(F.lit(0), F.floor((since - width) / hop) + 1)
    rows = onsets.join(first, "clip_id").withColumn("k", F.explode(F.sequence(low, top)))
    rows = rows.where(F.col("t0") + F.col("k") * hop < F.col("t1") - width / 2)
    return rows.groupBy("clip_id", "k").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_ONSETS)


def grid_snap(notes: DataFrame, step: float, phase: float) -> DataFrame:
    from ostinato.functions.music import snapped

    length = snapped(F.col("duration"), F.lit(step), F.lit(0.0), MAX_SHIFT)
    kept = F.when(length.isNull() | (length < step / 2), F.greatest("duration", F.lit(0.03))).otherwise(length)
    return notes.withColumns({"snapped": snapped(F.col("onset"), F.lit(step), F.lit(phase), MAX_SHIFT), "length": kept})


def local_lateness(notes: DataFrame, step: float, phase: float, radius: float) -> DataFrame:
    """Median distance from the grid of the notes within ``radius``, those of the same onset left out; null for fewer than three."""
    from ostinato.operators.joins import band_join

    residual = F.col("onset") - (F.rint((F.col("onset") - phase) / step) * step + phase)
    rows = notes.select("clip_id", "note_id", "onset").withColumn("residual", residual)
    near = band_join(rows, rows, ["clip_id"], "onset", "onset", radius).where("onset <> r_onset")
    found = near.groupBy("clip_id", "note_id").agg(F.median("r_residual").alias("late"), F.count("*").alias("n"))
    return rows.join(found.where("n >= 3").drop("n"), ["clip_id", "note_id"], "left").select("clip_id", "note_id", "residual", "late")


def merge_overlaps_simple(notes: DataFrame, min_repeat: float) -> DataFrame:
    """Runs of notes of one pitch that overlap or come within ``min_repeat`` of the end so far, as one note each."""
    lane = W.partitionBy("clip_id", "pitch").orderBy("onset", "note_id")
    end = F.max(F.col("onset") + F.col("duration")).over(lane.rowsBetween(W.unboundedPreceding, -1))
    starts = notes.withColumn("new", F.coalesce((F.col("onset") - end >= min_repeat).cast("int"), F.lit(1)))
    run = starts.withColumn("run", F.sum("new").over(lane.rowsBetween(W.unboundedPreceding, 0)))
    return run.groupBy("clip_id", "pitch", "run").agg(
        F.min("onset").alias("onset"), F.max(F.col("onset") + F.col("duration")).alias("note_end"), F.count("*").alias("n")
    )
