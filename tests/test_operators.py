import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ostinato.operators import matching, notation, tracks
from ostinato.operators.joins import as_of, band_join
from ostinato.sources import tiles as src
from ostinato.sources.links import video_id
from ostinato.sources.views import notes, rough_estimate

NOTE = "note_id long, clip_id long, onset double, pitch long, duration double, hand string, velocity long"


def made(spark, rows):
    return spark.createDataFrame(rows, NOTE)


def test_band_join_equals_all_pairs(spark):
    rng = random.Random(1)
    left = [(k, k % 3, rng.uniform(-5, 5)) for k in range(80)]
    right = [(k, k % 3, rng.uniform(-5, 5)) for k in range(80)]
    a = spark.createDataFrame(left, "i long, g long, x double")
    b = spark.createDataFrame(right, "j long, g long, y double")
    got = {(r["i"], r["r_j"]) for r in band_join(a, b, ["g"], "x", "y", 0.7).collect()}
    assert got == {(i, j) for i, g, x in left for j, h, y in right if g == h and abs(x - y) <= 0.7}


def test_as_of_takes_the_last_start(spark):
    left = spark.createDataFrame([(1, 0.5), (1, 2.0), (1, 9.0), (2, 1.0)], "g long, t double")
    right = spark.createDataFrame([(1, 1.0, "a"), (1, 2.0, "b")], "g long, s double, v string")
    got = {(r["g"], r["t"]): r["v"] for r in as_of(left, right, ["g"], "t", "s", ["v"]).collect()}
    assert got == {(1, 0.5): None, (1, 2.0): "b", (1, 9.0): "b", (2, 1.0): None}


def test_maximum_matching_is_maximal(spark, data):
    truth = notes(spark, data)
    pairs = matching.candidates(truth, rough_estimate(truth), 0.5)
    got = matching.maximum_matching(pairs).toPandas()
    assert got["ref_id"].is_unique and got["est_id"].is_unique
    # on a line with windows of one width, taking candidates in order is maximal, too
    total = 0
    for _, own in pairs.toPandas().groupby(["clip_id", "pitch"]):
        taken = set()
        for _, ref in own.sort_values(["ref_onset", "ref_id"]).groupby(["ref_onset", "ref_id"]):
            free = ref[~ref["est_id"].isin(taken)].sort_values(["est_onset", "est_id"])
            if len(free):
                taken.add(free["est_id"].iloc[0])
                total += 1
    assert len(got) == total


def test_matching_prefers_the_nearest_and_is_maximal():
    rng = random.Random(4)
    for _ in range(300):
        wants = {r: rng.sample(range(6), rng.randint(0, 4)) for r in range(rng.randint(0, 6))}
        got = matching.largest_matching(wants)
        assert len(set(got.values())) == len(got) and all(e in wants[r] for e, r in got.items())

        def most(left, free, wants=wants):
            if not left:
                return 0
            return max([most(left[1:], free), *(1 + most(left[1:], free - {e}) for e in wants[left[0]] if e in free)])

        assert len(got) == most(list(wants), frozenset(range(6)))
        # the textbook's search by recursion
        held = {}

        def move(r, seen, wants=wants, held=held):
            for e in wants[r]:
                if e not in seen:
                    seen.add(e)
                    if e not in held or move(held[e], seen):
                        held[e] = r
                        return True
            return False

        for r in wants:
            move(r, set())
        assert got == held
    chain = {k: [k, k + 1] if k else [0] for k in range(4999, -1, -1)}
    assert len(matching.largest_matching(chain)) == 5000


def test_metrics_of_empty_and_identical_estimates(spark):
    truth = made(spark, [(1, 1, 0.0, 60, 1.0, "R", 80), (2, 1, 1.0, 62, 1.0, "L", 80), (3, 2, 0.0, 60, 1.0, "R", 80)])
    found = truth.where("clip_id = 1")
    pairs = matching.with_details(matching.maximum_matching(matching.candidates(truth, found)), truth, found)
    got = {r["clip_id"]: r for r in matching.clip_metrics(truth, found, pairs).collect()}
    assert got[1]["f1"] == 1.0 and got[1]["onset_mae"] == 0.0
    assert (got[2]["f1"], got[2]["precision"], got[2]["matched"]) == (0.0, 0.0, 0)
    whole = [r for r in matching.pooled(matching.clip_metrics(truth, found, pairs)).collect() if r["clip_id"] is None][0]
    assert whole["recall"] == pytest.approx(2 / 3)


def test_notes_survive_tiles_and_tracks(spark):
    truth = made(spark, [(k, k % 2, 3.0 + 1.3 * k, 60 + k % 5, 0.6, "LR"[k % 2], 80) for k in range(20)])
    tiles = tracks.with_previous_frame(src.tiles(truth), src.frame_clock(truth))
    back = tracks.tracks_to_notes(tracks.build_tracks(tiles), 1 / src.FPS).toPandas()
    assert len(back) == 20
    want = truth.toPandas()
    got = back.sort_values(["clip_id", "onset"])["onset"].round(6).tolist()
    assert got == want.sort_values(["clip_id", "onset"])["onset"].round(6).tolist()


def test_tracking_does_not_depend_on_partitions(spark, data):
    truth = notes(spark, data)
    tiles = tracks.with_previous_frame(src.tiles(truth), src.frame_clock(truth))
    one, many = (
        tracks.build_tracks(tiles.repartition(n)).select(F.count("*"), F.sum(F.xxhash64("clip_id", "pitch", "hand", "track_id", "frame").cast("decimal(38,0)"))).first()
        for n in (1, 7)
    )
    assert one == many


def test_midi_files_read_back(spark):
    rows = made(spark, [(1, 7, 0.0, 60, 1.0, "R", 200), (2, 7, 0.5, 60, 1.0, "R", 0), (3, 7, 0.25, 40, 0.1, "L", 64)])
    events = notation.midi_events(notation.releases(notation.ticked(rows, 0.5)))
    raw = bytes(notation.midi_files(events, 0.5).first()["midi"])
    assert raw[:14] == b"MThd" + bytes([0, 0, 0, 6, 0, 1, 0, 3, 1, 224])

    def notes_of(track):
        at, now, out = 0, 0, []
        while at < len(track):
            delta = 0
            while True:
                byte = track[at]
                at += 1
                delta = delta << 7 | byte & 127
                if byte < 128:
                    break
            now += delta
            if track[at] == 0xFF:
                at += 3 + track[at + 2]
            else:
                out.append((now, *track[at : at + 3]))
                at += 3
        return out

    tracks_, at = [], 14
    while at < len(raw):
        size = int.from_bytes(raw[at + 4 : at + 8], "big")
        tracks_.append(notes_of(raw[at + 8 : at + 8 + size]))
        at += 8 + size
    assert tracks_[1] == [(0, 0x90, 60, 127), (480, 0x80, 60, 0), (480, 0x90, 60, 1), (1440, 0x80, 60, 0)]
    assert tracks_[2] == [(240, 0x91, 40, 64), (336, 0x81, 40, 0)]


def test_voices_never_overlap(spark):
    rng = random.Random(3)
    rows = [(1, "R", s := rng.randint(0, 200), s + rng.randint(1, 60), rng.randint(50, 70)) for _ in range(120)]
    got = notation.voices(spark.createDataFrame(rows, "clip_id long, side string, start long, stop long, pitch long")).toPandas()
    for _, own in got.groupby("voice"):
        own = own.sort_values("start")
        assert (own["stop"].iloc[:-1].to_numpy() <= own["start"].iloc[1:].to_numpy()).all()


def test_written_parts_add_up(spark):
    rows = spark.range(1, 400).select(F.col("id"), notation.written_parts(F.col("id")).alias("p")).collect()
    assert all(sum(r["p"]) == r["id"] and set(r["p"]) <= set(notation.WRITABLE) for r in rows)


@pytest.mark.parametrize(
    ("link", "want"),
    [
        ("dQw4w9WgXcQ", "dQw4w9WgXcQ"), ("https://youtu.be/dQw4w9WgXcQ?t=1", "dQw4w9WgXcQ"), ("youtube.com/watch?v=dQw4w9WgXcQ", "dQw4w9WgXcQ"),
        ("https://www.youtube.com/embed/dQw4w9WgXcQ", "dQw4w9WgXcQ"), ("https://example.com/watch?v=dQw4w9WgXcQ", None), ("", None), (None, None),
    ],
)
def test_video_ids(spark, link, want):
    df = spark.createDataFrame([(link,)], "link string")
    assert df.select(video_id(F.col("link")).alias("v")).first()["v"] == want


def test_vlq():
    assert [notation.vlq(n) for n in (0, 127, 128, 16383, 16384)] == [b"\0", b"\x7f", b"\x81\0", b"\xff\x7f", b"\x81\x80\0"]


def test_empty_tables(spark):
    empty = made(spark, [])
    assert matching.maximum_matching(matching.candidates(empty, empty)).count() == 0
    assert tracks.tracks_to_notes(tracks.build_tracks(tracks.with_previous_frame(src.tiles(empty), src.frame_clock(empty))), 1 / src.FPS).count() == 0
    assert isinstance(notation.voices(spark.createDataFrame([], "clip_id long, side string, start long, stop long, pitch long")).toPandas(), pd.DataFrame)


def test_neighbours_are_the_nearest_however_many_share_an_onset(spark):
    from ostinato.operators import hands

    rng = random.Random(5)
    rows = [(k, 1, rng.choice([0.0, 1.0, 1.0, 1.0, 2.5, 2.75]), rng.randint(30, 90), 0.5, "L", 80) for k in range(150)]
    got = {r["idx"]: r for r in hands.neighbours(hands.positioned(made(spark, rows)), 8).collect()}
    own = sorted(rows, key=lambda r: (r[2], r[3], r[4], r[5], r[6], r[0]))
    for i, r in enumerate(own):
        near = sorted(range(len(own)), key=lambda j: (abs(own[j][2] - r[2]), j))[:8]
        pitches = sorted(own[j][3] for j in near)
        assert (got[i]["low"], got[i]["high"], got[i]["middle"], got[i]["n"]) == (pitches[0], pitches[-1], (pitches[3] + pitches[4]) / 2, 8)


def test_chords_are_settled_as_by_hand(spark):
    rng = random.Random(8)
    page, played, pairs, want = [], [], [], []
    for clip in range(40):
        own = sorted((rng.randint(0, 3) * 1.0, rng.randint(60, 63)) for _ in range(8))
        heard = [rng.randint(60, 63) for _ in range(9)]
        page += [(clip, k, p, b) for k, (b, p) in enumerate(own)]
        played += [(clip, k, p) for k, p in enumerate(heard)]
        at, mine = -1, {}
        for k, (_, p) in enumerate(own):  # some increasing pairs
            there = next((j for j in range(at + 1, 9) if heard[j] == p), None)
            if there is not None and rng.random() < 0.6:
                mine[k] = at = there
        pairs += [(clip, k, j) for k, j in mine.items()]
        used = set(mine.values())
        for k, (b, p) in enumerate(own):
            mates = [i for i, (c, _) in enumerate(own) if c == b]
            places = [mine[i] for i in mates if i in mine]
            if k in mine or len(mates) < 2 or not places:
                continue
            near = [j for j in range(9) if j not in used and heard[j] == p and min(places) - len(mates) <= j <= max(places) + len(mates)]
            if near:
                used.add(near[0])
                want.append((clip, k, near[0]))
    made = [
        spark.createDataFrame(page, "clip_id long, page_no long, pitch long, beat double"), spark.createDataFrame(played, "clip_id long, played_no long, pitch long"),
        spark.createDataFrame(pairs, "clip_id long, page_no long, played_no long"),
    ]
    assert sorted(tuple(r) for r in matching.settled_chords(*made).collect()) == sorted(want) and len(want) > 10
