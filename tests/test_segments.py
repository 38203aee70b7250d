import numpy as np

from ostinato.operators.segments import change_points
from ostinato.plans import registry


def test_change_points_of_a_stepped_rate():
    rng = np.random.default_rng(1)
    steps = np.concatenate([np.full(10, 100.0), np.full(8, 150.0), np.full(9, 200.0)]) + rng.normal(0, 1, 27)
    assert change_points(steps) == [0, 10, 18]
    assert change_points(np.full(20, 100.0)) == [0] and change_points(np.array([1.0])) == [0]


def test_scroll_of_drawn_tiles_is_one_stretch(spark, data):
    got = registry.queries()["clock_stretches"](spark, data).toPandas()
    assert got["clip_id"].is_unique and (got["rate"] - 100).abs().max() < 1e-6


def test_analysis_has_a_row_per_clip_of_eight_onsets(spark, data):
    got = registry.queries()["whole_analysis"](spark, data).toPandas()
    assert got["clip_id"].is_unique and got["tempo"].between(40, 208).all() and got["key"].str.match("^[A-G][b#]? (major|minor)$").all()
