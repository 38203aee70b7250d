import random
from xml.etree import ElementTree as ET

from ostinato.operators import musicxml
from ostinato.plans import registry


def measures_are_full(xml, bar):
    sounded = {}
    for number, measure in enumerate(ET.fromstring(xml).iter("measure")):
        at, end = 0, 0
        for item in measure:
            if item.tag == "backup":
                assert at == bar
                at = 0
            elif item.tag == "note":
                length = int(item.find("duration").text)
                if item.find("chord") is not None:
                    at -= length
                if item.find("rest") is None:
                    tie = {t.get("type") for t in item.findall("tie")}
                    p = item.find("pitch")
                    sounded.setdefault("stop" in tie, []).append((number, at, p.find("step").text))
                at += length
                end = max(end, at)
        assert at == bar == end
    return sounded


def test_bars_are_full_and_every_note_starts_once():
    rng = random.Random(4)
    for bar in (72, 96):
        chords, at = [], {k: 0 for k in ((1, 1), (1, 2), (2, 1))}
        for _ in range(60):
            lane = rng.choice(list(at))
            start = at[lane] + rng.randint(0, 30)
            stop = start + rng.randint(1, 130)
            at[lane] = stop
            chords.append((*lane, start, stop, rng.sample(range(40, 80), rng.randint(1, 3))))
        sounded = measures_are_full(musicxml.score(chords, bar), bar)
        assert len(sounded[False]) == sum(len(c[4]) for c in chords)


def test_spelling():
    assert [musicxml.spell(61, f) for f in (0, 3, -2)] == [("C", 1, 4), ("C", 1, 4), ("D", -1, 4)]
    assert musicxml.spell(60, -5) == ("C", 0, 4) and musicxml.spell(71, 2) == ("B", 0, 4)


def test_scores_of_all_clips(spark, data):
    for row in registry.queries()["musicxml_scores"](spark, data).collect():
        measures_are_full(row["xml"], 96)
