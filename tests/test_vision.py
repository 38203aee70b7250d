import numpy as np

from ostinato.functions.music import BLACK
from ostinato.operators import vision as v
from ostinato.plans import registry
from ostinato.sources import tiles as src
from ostinato.sources.views import notes


def test_tiles_are_found_again(spark, data):
    rows = src.tiles(notes(spark, data)).where("frame % 5 = 0")
    drawn = rows.toPandas()
    drawn = drawn[(drawn["bottom"] - drawn["top"]) * v.SCALE >= 3]
    found = {(r.clip_id, r.frame, r.pitch, r.hand): (r.top, r.bottom) for r in v.detect(v.render(rows)).toPandas().itertuples()}
    hits = 0
    for r in drawn.itertuples():
        at = found.get((r.clip_id, r.frame, r.pitch, r.hand))
        hits += at is not None and abs(at[0] - r.top * v.SCALE) <= 1 and abs(at[1] - r.bottom * v.SCALE) <= 1
    assert hits >= 0.9 * len(drawn) > 0


def test_shift_of_a_moved_picture():
    rng = np.random.default_rng(1)
    picture = np.zeros((100, 60))
    for _ in range(12):
        y, x = rng.integers(5, 60), rng.integers(0, 55)
        picture[y : y + rng.integers(4, 15), x : x + 5] = 1
    for rows in (1, 4, 9):
        assert abs(v.row_shift(picture, np.roll(picture, rows, axis=0)) - rows) < 0.3


def test_speed_of_the_scroll(spark, data):
    got = registry.queries()["scroll_speeds"](spark, data).toPandas()
    assert (got["speed"] - 100 * v.SCALE).abs().median() < 2


def test_period_of_a_keyboard():
    x = np.arange(520)
    profile = (np.abs((x % 9.6) - 4.8) > 4.2).astype(float)
    assert abs(v.period(profile, 5, 30) - 9.6) < 0.05


def test_anchor_names_the_first_gap():
    for start in range(7):
        scale = [0, 2, 4, 5, 7, 9, 11]
        gaps = [(scale[(start + k) % 7] + 1) % 12 in BLACK for k in range(20)]
        assert v.anchor(gaps) == start


def test_palette_finds_the_colours(spark, data):
    got = registry.queries()["colour_palette"](spark, data).toPandas()[["b", "g", "r"]].to_numpy()
    for colour in (v.BACKGROUND, *v.COLOURS.values()):
        assert np.abs(got - np.array(colour)).max(axis=1).min() <= 6


def test_pictures_are_those_of_all_frames(spark, data):
    frames = {(r.clip_id, r.frame) for r in src.tiles(notes(spark, data)).select("clip_id", "frame").distinct().collect()}
    seen = {(r.clip_id, r.frame) for r in registry.queries()["detected_tiles"](spark, data).select("clip_id", "frame").distinct().collect()}
    assert seen <= frames and len({f % 5 for _, f in seen}) == 5 and len(seen) >= 0.9 * len(frames)
    pixels = registry.queries()["colour_palette"](spark, data).agg({"pixels": "sum"}).first()[0]
    assert pixels == len(frames) * v.HEIGHT * v.WIDTH


def test_speeds_are_medians_of_all_pairs(spark, data):
    made = v.render(src.tiles(notes(spark, data).where("clip_id < 3"))).toPandas().sort_values(["clip_id", "frame"])
    got = {r["clip_id"]: r for r in v.scroll_speeds(spark.createDataFrame(made, v.FRAME)).collect()}
    for clip, own in made.groupby("clip_id"):
        lit = [(r.time, (v.picture(r.image, r.height, r.width).astype(int).sum(axis=2) > 150).astype(float)) for r in own.itertuples()]
        speeds = [v.row_shift(a, b) / (t1 - t0) for (t0, a), (t1, b) in zip(lit[:-1], lit[1:], strict=True) if t1 - t0 < 0.3 and a.any() and b.any()]
        good = np.array([s for s in speeds if 1 < s < 200])
        assert got[clip]["samples"] == len(good) > 0
        assert np.isclose(got[clip]["speed"], np.median(good)) and np.isclose(got[clip]["spread"], np.median(np.abs(good - np.median(good))))


def test_runs_of_rows_give_what_all_rows_give():
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (6, 9, 3), np.uint8)[[0, 0, 1, 2, 2, 2, 0, 3, 4, 5, 5]]
    starts, at = v.row_runs(image)
    assert starts.tolist() == [0, 2, 3, 6, 7, 8, 9] and (image[starts][at] == image).all()
    for n in (1, 2, 5, 8):
        stack = rng.integers(0, 256, (n, 40), np.uint8)
        assert (v._middle(stack) == np.median(stack, axis=0).astype(np.uint8)).all()
    assert v.row_shift(np.ones((20, 5)), np.ones((20, 5))) == 0.0
