import itertools
import random

import numpy as np
import pandas as pd
import pytest

from ostinato.operators import folds, tempo
from ostinato.plans import registry
from ostinato.sources.views import notes


def test_simple_merges_agree_with_islands(spark, data):
    """Where no rule but overlap applies, the fold is gaps and islands."""
    rows = [(0.0, 1.0, "R", None, True), (0.9, 1.5, "R", None, True), (3.0, 4.0, "R", None, True), (3.9, 3.95, "R", None, True)]
    assert folds.merge_lane(rows[:1]) == [(0.0, 1.0, "R", 1)]
    # the second begins far inside the first and ends elsewhere: a new strike trims the first
    assert folds.merge_lane(rows) == [(0.0, 0.9, "R", 1), (0.9, 1.5, "R", 1), (3.0, 4.0, "R", 2)]
    assert folds.merge_lane([]) == []


@pytest.mark.parametrize(
    ("rows", "n"),
    [
        ([(0.0, 1.0, "L", None, True), (0.15, 1.2, "L", None, True)], 1),  # within reach
        ([(0.0, 1.0, "L", None, True), (0.6, 1.03, "L", None, True)], 1),  # one end
        ([(0.0, 1.0, "L", 0.0, True), (1.2, 1.6, "L", 1.0, False)], 1),  # a tail
        ([(0.0, 1.0, "L", 0.0, True), (1.2, 1.6, "L", 1.0, True)], 2),  # its end was measured
        ([(0.0, 0.05, "L", None, True), (0.06, 0.5, "L", None, True)], 1),  # a fragment close by
    ],
)
def test_merge_rules(rows, n):
    assert len(folds.merge_lane(rows)) == n


def test_merging_keeps_the_sum_of_parts(spark, data):
    rows = notes(spark, data)
    assert folds.merge_overlaps(rows).agg({"parts": "sum"}).first()[0] == rows.count()


def test_kept_repeats_never_share_a_point(spark, data):
    got = registry.queries()["quantize_keep_repeats"](spark, data).toPandas()
    assert not got.assign(at=got["snapped"].round(6)).duplicated(["clip_id", "pitch", "at"]).any()


@pytest.mark.parametrize("bpm", [60, 96, 144])
def test_beats_of_a_steady_clip(bpm):
    beat = 60 / bpm
    rng = np.random.default_rng(bpm)
    onsets = np.sort(np.arange(40) * beat + rng.normal(0, 0.01, 40).clip(-0.03, 0.03) + 0.1)
    path = folds.beat_times(onsets, np.ones(40), beat, 0.1)
    assert np.abs(np.diff(path) - beat).max() < 0.12 and abs(len(path) - 40) <= 2


def test_chains_start_on_the_steady_grid():
    onsets = np.concatenate([[0.25], 0.5 + np.arange(30) * 0.5])
    path = folds.beat_times(onsets, np.ones(31), 0.5, 0.0)
    assert abs(path[0] - 0.5) < 0.02 and len(folds.beat_times(onsets[:7], np.ones(7), 0.5, 0.0)) == 0
    assert len(folds.beat_times(np.zeros(0), np.zeros(0), 0.5, 0.0)) == 0


def test_best_chain_equals_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(60):
        strength = rng.random(rng.integers(4, 22)) * (rng.random() < 0.9)
        period = float(rng.uniform(2, 6))
        short, long = max(2, int(period / 2)), int(period * 2)

        def price(step, period=period):
            return folds.INERTIA * np.log(step / period) ** 2

        def best(k, strength=strength, short=short, long=long, price=price, known=None):
            """The greatest total of a chain that ends at k."""
            before = [best(k - d) - price(d) for d in range(short, long + 1) if k - d >= 0]
            return strength[k] + max([0.0, *before])

        got = folds.best_chain(strength, period)
        if not strength.any():
            assert len(got) == 0
            continue
        tops = {k: best(k) for k in range(max(0, len(strength) - int(period * 2)), len(strength))}
        if len(got) < 2:
            assert max(tops.values()) == pytest.approx(strength[max(tops, key=tops.get)])
            continue
        total = strength[got].sum() - sum(price(d) for d in np.diff(got))
        assert total == pytest.approx(max(tops.values())) and got[-1] in tops


def test_alignment_scores_equal_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        page = [rng.randint(0, 3) for _ in range(rng.randint(0, 5))]
        played = [rng.randint(0, 3) for _ in range(rng.randint(0, 6))]
        best = 0.0
        for k in range(1, min(len(page), len(played)) + 1):
            for a in itertools.combinations(range(len(page)), k):
                for b in itertools.combinations(range(len(played)), k):
                    if all(page[i] == played[j] for i, j in zip(a, b, strict=True)):
                        best = max(best, k - folds.SKIP * (b[-1] - b[0] + 1 - k))
        total, pairs = folds.align(page, played)
        assert total == pytest.approx(best)
        assert all(page[i] == played[j] for i, j in pairs) and pairs == sorted(pairs)


def test_streamed_tracks_equal_batch_tracks(spark, data):
    names = ["clip_id", "pitch", "hand", "frame", "bottom", "track_id"]
    streamed = registry.queries()["stateful_tracks"](spark, data).select(names).toPandas().sort_values(names).reset_index(drop=True)
    batch = registry.queries()["build_tracks"](spark, data).select(names).toPandas().sort_values(names).reset_index(drop=True)
    pd.testing.assert_frame_equal(streamed, batch)


def test_streamed_tracks_are_those_of_all_clips(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").where("event_id % 4 = 0")
    events.withColumn("user_id", (events.user_id + 15).cast(events.schema["user_id"].dataType)).write.parquet(f"{tmp_path}/events.parquet")
    names = ["clip_id", "pitch", "hand", "frame", "bottom", "track_id"]
    streamed, batch = (
        registry.queries()[q](spark, str(tmp_path)).select(names).toPandas().sort_values(names).reset_index(drop=True)
        for q in ("stateful_tracks", "build_tracks")
    )
    assert streamed["clip_id"].max() >= 20
    pd.testing.assert_frame_equal(streamed, batch)


def test_stream_keeps_one_state_per_clip_over_several_batches(spark, data, tmp_path):
    """A state for each lane costs more than the lane's few tiles. Late tiles are dropped, whichever batch brings them."""
    from ostinato.operators.tracks import build_tracks, with_previous_frame
    from ostinato.sources import tiles as src
    from ostinato.sources.views import notes
    from ostinato.streaming import tracking

    truth = notes(spark, data).where("clip_id < 6")
    rows = with_previous_frame(src.tiles(truth), src.frame_clock(truth)).cache()
    batch = build_tracks(rows).toPandas()
    going_on = rows.where("frame >= 200").select("clip_id", "pitch", "hand").distinct()
    late = rows.where("frame < 100").join(going_on, ["clip_id", "pitch", "hand"]).select(rows.columns).limit(5)
    assert late.count()
    parts = (rows.where("frame < 120"), rows.where("frame >= 120 and frame < 200"), rows.where("frame >= 200"), late)
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = tracking.stateful_tracks(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
        run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        query = run.outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        if k == 2:
            assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == rows.select("clip_id").distinct().count()
            assert rows.select("clip_id", "pitch", "hand").distinct().count() > 2 * rows.select("clip_id").distinct().count()
    names = ["clip_id", "pitch", "hand", "frame", "bottom", "top", "time", "track_id"]
    streamed = spark.read.parquet(f"{tmp_path}/out").select(names).toPandas()
    ordered = [x[names].sort_values(names).reset_index(drop=True) for x in (streamed, batch)]
    pd.testing.assert_frame_equal(*ordered)


def steady(bpm, bars=6, seed=0, loose=0.0):
    """Quarters in the bass, eighths above with some sixteenths, at a tempo."""
    rng = np.random.default_rng(seed)
    beat = 60 / bpm
    rows = []
    for k in range(bars * 4):
        rows.append((k * beat, beat * 0.6))
        rows += [(k * beat + x * beat, 0.5 * beat * 0.6) for x in (0, 0.5)]
        if rng.random() < 0.4:
            rows.append((k * beat + 0.75 * beat, 0.25 * beat * 0.6))
    rows = np.array(sorted(rows))
    rows[:, 0] += rng.normal(0, loose, len(rows)).clip(-3 * loose, 3 * loose)
    return rows[rows[:, 0].argsort()]


@pytest.mark.parametrize("bpm", [72, 84, 96, 110, 126, 144])
def test_tempo_of_steady_playing(bpm):
    for loose in (0.0, 0.004):
        rows = steady(bpm, seed=bpm, loose=loose)
        different = np.unique(np.round(rows[:, 0], 4))
        tatum, phase, score, drifts = tempo.fine_grid(different)
        beat = tempo.chosen_multiple(tatum, rows[:, 0], rows[:, 1], drifts)
        assert abs(60 / beat / bpm - 1) < 0.02 and not drifts
        off = (different - phase) / tatum
        assert np.abs(off - np.rint(off)).mean() < 0.1


def test_beats_of_all_clips(spark, data):
    got = registry.queries()["estimated_beats"](spark, data).toPandas()
    counts = notes(spark, data).selectExpr("clip_id", "round(onset, 4) as o").distinct().groupBy("clip_id").count().where("count >= 8").count()
    ratio = (got["beat"] / got["tatum"]).round(6)
    assert len(got) == counts and ratio.isin(tempo.MULTIPLES).all() and got["confidence"].between(0, 1).all()
    few = notes(spark, data).limit(5)
    assert tempo.estimate_beats(few).count() == 0


def test_repeats_equal_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        onsets = np.array(sorted({round(rng.uniform(0, 4), 2) for _ in range(rng.randint(0, 12))}))
        able = [x for x in onsets if x + 0.5 <= onsets[-1] + 0.063]
        want = np.mean([any(abs(y - x - 0.5) <= 0.063 for y in onsets) for x in able]) if able else 0.0
        assert tempo.repeats(onsets, 0.5, 0.063) == pytest.approx(want)


def test_notes_near_the_grid_are_put_on_it(spark, data):
    rows = [(k, 1, float(t), 60 + k % 5, float(d), "L", 80) for k, (t, d) in enumerate(steady(96, loose=0.003))]
    made = spark.createDataFrame(rows, "note_id long, clip_id long, onset double, pitch long, duration double, hand string, velocity long")
    beat = tempo.estimate_beats(made).first()
    got = tempo.postprocessed(made).toPandas()
    off = (got["onset"] - beat["tatum_phase"]) / beat["tatum"]
    assert (np.abs(off - np.rint(off)) < 1e-6).mean() > 0.95 and abs(beat["tempo"] / 96 - 1) < 0.02
    assert tempo.postprocessed(made, 0).select("note_id", "onset").orderBy("note_id").collect() == made.select("note_id", "onset").orderBy("note_id").collect()
    whole = registry.queries()["postprocess"](spark, data)
    assert whole.count() == notes(spark, data).count() and set(r["hand"] for r in whole.select("hand").distinct().collect()) <= {"L", "R"}


def test_sections_are_analysed_by_their_own_notes(spark):
    one, two = steady(72, 4, 1), steady(126, 6, 2)
    two[:, 0] += 100
    rows = [(k, 1, float(t), 60 + k % 5, float(d), "L", 80) for k, (t, d) in enumerate([*one, *two])]
    made = spark.createDataFrame(rows, "note_id long, clip_id long, onset double, pitch long, duration double, hand string, velocity long")
    sections = spark.createDataFrame([(1, 0, -1.0), (1, 1, 99.0), (1, 2, 999.0)], "clip_id long, section_no int, start double")
    got = {r["section_no"]: r["tempo"] for r in tempo.analysed_sections(made, sections).collect()}
    assert set(got) == {0, 1} and abs(got[0] / 72 - 1) < 0.02 and abs(got[1] / 126 - 1) < 0.02
