"""Writing note sequences in the formats that are known, the options of a run, and reports that are held against the last run's."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.operators import hands, matching, musicxml, notation
from ostinato.runtime import persist_table
from ostinato.sources.note_json import write_clips

QUARTER = 0.5
#: Divisions of a quarter that MusicXML counts in.
DIVISIONS = 24


def _json(notes: DataFrame) -> DataFrame:
    return write_clips(notes).select("clip_id", F.encode("document", "UTF-8").alias("content"))


def _midi(notes: DataFrame) -> DataFrame:
    events = notation.midi_events(notation.releases(notation.ticked(notes, QUARTER)))
    return notation.midi_files(events, QUARTER).select("clip_id", F.col("midi").alias("content"))


def _musicxml(notes: DataFrame) -> DataFrame:
    start = F.rint(F.col("onset") / QUARTER * DIVISIONS).cast("long")
    length = F.greatest(F.lit(1), F.rint(F.col("duration") / QUARTER * DIVISIONS).cast("long"))
    placed = hands.split_by_neighbours(notes).withColumn("start", start).withColumn("stop", F.col("start") + length)
    written = musicxml.scores(notation.voices(placed.select("clip_id", "side", "start", "stop", "pitch")))
    return written.select("clip_id", F.encode(written.columns[-1], "UTF-8").alias("content"))


#: Format: file ending, and a function from notes to (clip_id, content).
FORMATS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {"json": (".json", _json), "midi": (".mid", _midi), "musicxml": (".musicxml", _musicxml)}


def extension(name: str) -> str:
    return _known(name)[0]


def _known(name: str) -> tuple[str, Callable[[DataFrame], DataFrame]]:
    if name not in FORMATS:
        raise ValueError(f"unknown format {name!r}; known are {', '.join(sorted(FORMATS))}")
    return FORMATS[name]


def written(notes: DataFrame, name: str) -> DataFrame:
    """(name, content): a file per clip in a format."""
    ending, make = _known(name)
    return make(notes).select(F.concat(F.lit("clip_"), F.col("clip_id").cast("string"), F.lit(ending)).alias("name"), "content")


def write_formats(notes: DataFrame, folder: str, names: list[str]) -> DataFrame:
    """Writes each format as a table of files under folder/format; a format that fails is reported and doesn't stop the others.

    (format, path, error), one row per format asked for.
    """
    rows = []
    for name in names:
        path = f"{folder}/{name}"
        try:
            written(notes, name).write.mode("overwrite").parquet(path)
            rows.append((name, path, None))
        except Exception as error:  # the row names it
            rows.append((name, None, f"{type(error).__name__}: {error}"[:500]))
    return notes.sparkSession.createDataFrame(rows, "format string, path string, error string")


# Note values that a run may quantise to, and steps of a beat for each; 0 leaves notes as they are.
STEPS = {"8": 2, "16": 4, "32": 8, "0": 0}
HANDS = ["color", "split", "pitch", "none"]


@dataclass(frozen=True)
class Options:
    """What a user may choose for a run; a wrong choice is refused."""

    hands: str = "color"
    quantize: str = "16"
    fixed_tempo: float | None = None
    key: str = "auto"
    formats: tuple[str, ...] = field(default=("json", "midi", "musicxml"))

    def __post_init__(self) -> None:
        if self.hands not in HANDS:
            raise ValueError(f"hands must be one of {', '.join(HANDS)}")
        if self.quantize not in STEPS:
            raise ValueError(f"quantize must be one of {', '.join(STEPS)}")
        if self.fixed_tempo is not None and not 20 < self.fixed_tempo < 400:
            raise ValueError("a tempo lies between 20 and 400")
        if self.key != "auto" and not re.fullmatch(r"[A-G][#b]? (major|minor)", self.key):
            raise ValueError("a key is 'auto' or like 'F major'")
        unknown = [f for f in self.formats if f not in FORMATS]
        if unknown:
            raise ValueError(f"unknown formats: {', '.join(unknown)}")
        # JSON is always written
        object.__setattr__(self, "formats", tuple(sorted({*self.formats, "json"})) if self.formats else ("json", "midi", "musicxml"))

    @property
    def steps_per_beat(self) -> int:
        return STEPS[self.quantize]


def save_report(metrics: DataFrame, path: str) -> None:
    """Metrics per clip as the report of a run."""
    metrics.write.mode("overwrite").parquet(path)


def since_last_run(spark: SparkSession, metrics: DataFrame, path: str) -> DataFrame:
    """Clips that fell since the report at ``path``, most first; then this run's report takes its place. None at the first run.

    What fell is settled and written before the old report goes.
    """
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    now = persist_table(metrics, "report")
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    before = spark.read.parquet(path) if there else now.where("false")
    fallen = persist_table(matching.regressions(before, now), "fallen")
    save_report(now, path)
    return fallen.orderBy("delta")
