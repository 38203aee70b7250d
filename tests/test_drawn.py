import numpy as np
import pyarrow as pa
import pytest

from ostinato.operators import drawn as d
from ostinato.operators import vision as v
from ostinato.plans import registry
from ostinato.runtime import ship_package
from ostinato.sources import tiles as src


@pytest.fixture(scope="module")
def crowd(spark):
    """Notes on all keys, of both hands, that cover each other, are there twice and last for many blocks of frames."""
    ship_package(spark)
    rng = np.random.default_rng(7)
    rows = []
    for clip in (1, 2, 5):
        for _ in range(150):
            pitch = int(rng.choice([60, 61, 62, rng.integers(21, 109)]))
            rows.append((clip, float(rng.integers(-2000, 30000)) / 1000, pitch, float(rng.choice([0.02, 0.4, 2.0, 25.0])) * float(rng.uniform(0.8, 1.2)), "LR"[rng.integers(2)]))
    rows += rows[:40] + [(c, t, p, long, "R" if h == "L" else "L") for c, t, p, long, h in rows[40:60]]
    rows += [(9, 3.0 + k / 2, 64, 0.4, "L") for k in range(0, 120, 7)]
    numbered = [(k, *r) for k, r in enumerate(rows)]
    return spark.createDataFrame(numbered, "note_id long, clip_id long, onset double, pitch int, duration double, hand string").cache()


def rendered(notes):
    return v.render(src.tiles(notes))


@pytest.mark.parametrize("name", ["colour_palette", "detected_tiles", "median_pictures", "scroll_speeds"])
def test_no_picture_leaves_where_it_is_drawn(spark, data, name, monkeypatch):
    def sent(tiles):
        raise AssertionError("pictures of 62,400 bytes each are sent from operator to operator")

    monkeypatch.setattr(v, "render", sent)
    assert registry.queries()[name](spark, data).count() > 0


def test_runs_are_the_rows_of_all_pictures(crowd, monkeypatch):
    batches = d.dealt(crowd, ["clip_id"]).toArrow().combine_chunks().sort_by([("clip_id", "ascending"), ("block", "ascending")]).to_batches()
    want = {(r.clip_id, r.frame): r.image for r in rendered(crowd).toPandas().itertuples()}
    for tiles, size in ((1 << 15, 10_000), (100, 37)):  # blocks that are cut, and batches that cut blocks
        monkeypatch.setattr(d, "TILES", tiles)
        got = {}
        for p in d.pictures(pa.Table.from_batches(batches).to_batches(max_chunksize=size)):
            for k in range(len(p.clip)):
                own = p.picture == k
                assert (int(p.clip[k]), int(p.frame[k])) not in got
                got[int(p.clip[k]), int(p.frame[k])] = np.repeat(p.rows[p.row[own]], (p.past - p.top)[own], axis=0).tobytes()
        assert got == want


def test_palette_of_notes_is_that_of_their_pictures(crowd):
    colours = ["pixels", "b", "g", "r"]
    assert sorted(d.palette(crowd).select(colours).collect()) == sorted(v.palette(rendered(crowd)).select(colours).collect())


def test_tiles_found_are_those_of_the_pictures(crowd):
    got, want = (sorted(tuple(r) for r in found.collect()) for found in (d.detect(crowd), v.detect(rendered(crowd))))
    assert got == want and {p % 12 in d.BLACK for _, _, _, p, *_ in got} == {True, False}


def test_medians_are_those_of_the_pictures(crowd):
    got, want = (sorted(tuple(r) for r in medians.collect()) for medians in (d.median_picture(crowd), v.median_picture(rendered(crowd))))
    assert got == want and len({bytes(grey) for *_, grey in got}) > 4


def test_speeds_are_those_of_the_pictures(crowd):
    got, want = (sorted(tuple(r) for r in speeds.collect()) for speeds in (d.scroll_speeds(crowd), v.scroll_speeds(rendered(crowd))))
    assert [(r[0], r[3]) for r in got] == [(r[0], r[3]) for r in want] and len(got) > 2
    assert np.allclose(np.array(got), np.array(want), rtol=0, atol=1e-9)
