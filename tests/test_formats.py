import json

import pytest
from pyspark.sql import functions as F

from ostinato.runtime import shared_path
from ostinato.sources import corpus, formats
from ostinato.sources.views import notes


def test_every_format_is_written_and_one_that_fails_stops_no_other(spark, data, monkeypatch):
    rows = notes(spark, data).where("clip_id < 3")
    folder = shared_path(spark, "formats")

    def broken(_):
        raise RuntimeError("no such thing")

    monkeypatch.setitem(formats.FORMATS, "broken", (".x", broken))
    got = {r["format"]: r for r in formats.write_formats(rows, folder, ["midi", "broken", "json", "musicxml", "none"]).collect()}
    assert got["broken"]["path"] is None and "no such thing" in got["broken"]["error"] and "unknown format" in got["none"]["error"]
    start = {"midi": b"MThd", "json": b"{", "musicxml": b"<"}
    n = rows.select("clip_id").distinct().count()
    for name, head in start.items():
        files = spark.read.parquet(got[name]["path"]).collect()
        assert got[name]["error"] is None and len(files) == n and all(bytes(r["content"]).startswith(head) for r in files)
        assert all(r["name"].endswith(formats.extension(name)) for r in files)
    with pytest.raises(ValueError):
        formats.extension("wav")


def test_options_refuse_what_is_wrong():
    assert formats.Options().steps_per_beat == 4 and formats.Options(quantize="0").steps_per_beat == 0
    assert formats.Options(formats=("midi",)).formats == ("json", "midi") and formats.Options(formats=()).formats == ("json", "midi", "musicxml")
    assert formats.Options(key="F# minor", fixed_tempo=96.0).key == "F# minor"
    for wrong in ({"key": "H major"}, {"quantize": "12"}, {"hands": "feet"}, {"fixed_tempo": 500.0}, {"formats": ("wav",)}):
        with pytest.raises(ValueError):
            formats.Options(**wrong)


def test_reports_are_held_against_the_last_run(spark):
    path = shared_path(spark, "last-run")
    made = lambda rows: spark.createDataFrame(rows, "clip_id long, f1 double")
    assert formats.since_last_run(spark, made([(1, 0.9), (2, 0.8), (3, 1.0)]), path).count() == 0
    got = formats.since_last_run(spark, made([(1, 0.89), (2, 0.5)]), path).collect()
    assert [(r["clip_id"], r["after"]) for r in got] == [(3, 0.0), (2, 0.5)]
    assert formats.since_last_run(spark, made([(1, 0.89), (2, 0.5)]), path).count() == 0


def test_truth_without_a_sequence_is_told(spark, tmp_path):
    good = {"clip_id": 1, "sequence": {"tempo": 96.0, "notes": [{"note_id": 1, "pitch": 60, "onset": 0.5, "duration": 1.0, "hand": "L", "velocity": 80}]}}
    (tmp_path / "a.truth.json").write_text(json.dumps(good) + "\n" + json.dumps({"clip_id": 2}) + "\n")
    found, bad = corpus.load_truth(spark, str(tmp_path))
    assert found.count() == 1 and found.first()["tempo"] == 96.0 and bad.count() == 1
    (tmp_path / "a.mkv").write_bytes(b"x")
    (tmp_path / "a.mp4").write_bytes(b"x")
    pairs = corpus.paired_clips(corpus.listing(spark, str(tmp_path))).collect()
    assert len(pairs) == 1 and pairs[0]["video"].endswith("a.mp4")
    lone = corpus.paired_clips(spark.createDataFrame([("x/b.truth.json",)], "path string")).select(F.col("video")).first()
    assert lone["video"] is None


def test_printed_pieces_are_read(spark, tmp_path):
    full = {"title": "A piece", "video": "a.mp4", "first_beat": 1.5, "beat": 0.5, "window": [0, 32], "tempo": 96, "beats_per_bar": 3, "keys": ["C major"], "notes": [[60, 0, 1, "R"], [48, 0.5, 0.25, "L"]],
            "lowest": 40, "highest": 80, "end": 31.5, "beat_times": [[4, 2.5], [0, 0.5]], "sections": [9.0, 3.0], "scored_by": "order"}
    (tmp_path / "a.printed.json").write_text(json.dumps(full, indent=2))
    (tmp_path / "b.printed.json").write_text(json.dumps({"video": "b.mp4", "window": [1, 2], "notes": [], "tempo": 0}))
    (tmp_path / "c.json").write_text("{}")
    pieces, written = corpus.load_pieces(spark, str(tmp_path))
    got = {r["name"]: r for r in pieces.collect()}
    assert set(got) == {"a", "b"} and got["a"]["title"] == "A piece" and got["a"]["window"]["hi"] == 32.0 and got["a"]["sections"] == [3.0, 9.0]
    assert [tuple(x) for x in got["a"]["beat_times"]] == [(0.0, 0.5), (4.0, 2.5)]
    b = got["b"]
    assert (b["title"], b["tempo"], b["beats_per_bar"], b["keys"], b["first_beat"], b["scored_by"], b["lowest"]) == ("b", None, None, [], 0.0, "beat", None)
    assert sorted(tuple(r) for r in written.collect()) == [("a", 0, 60, 0.0, 1.0, "R"), ("a", 1, 48, 0.5, 0.25, "L")]
