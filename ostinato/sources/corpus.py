"""Clips on disk: truth files beside videos, and their notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The endings of a truth file and of the videos that it can belong to, the preferred one first.
TRUTH, VIDEOS = ".truth.json", ["mp4", "avi", "mkv"]
NOTE = "struct<note_id:bigint,pitch:bigint,onset:double,duration:double,hand:string,velocity:bigint>"
SCHEMA = f"clip_id long, theme string, geometry struct<strike_y:double,speed_px_per_s:double>, sequence struct<tempo:double,key:string,notes:array<{NOTE}>>"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of all files under a folder; no file is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")


def paired_clips(files: DataFrame) -> DataFrame:
    """(stem, truth, video) for each truth file among the paths; video is null, and to be reported, where none has its stem."""
    ending = r"\.(" + "|".join(VIDEOS) + ")$"
    truths = files.where(F.col("path").endswith(TRUTH)).select(F.expr(f"left(path, length(path) - {len(TRUTH)})").alias("stem"), F.col("path").alias("truth"))
    rank = F.array_position(F.array(*map(F.lit, VIDEOS)), F.regexp_extract("path", ending, 1))
    videos = files.where(F.col("path").rlike(ending)).select(F.regexp_replace("path", ending, "").alias("stem"), "path", rank.alias("rank"))
    best = videos.groupBy("stem").agg(F.min_by("path", "rank").alias("video"))
    return truths.join(best, "stem", "left")


def write_truth(notes: DataFrame, folder: str, tempo: float = 120.0, key: str = "C major") -> None:
    """One JSON line per clip."""
    listed = F.array_sort(F.collect_list(F.struct("note_id", "pitch", "onset", "duration", "hand", "velocity"))).alias("notes")
    rows = notes.groupBy("clip_id").agg(listed)
    geometry = F.struct(F.lit(300.0).alias("strike_y"), F.lit(100.0).alias("speed_px_per_s"))
    sequence = F.struct(F.lit(tempo).alias("tempo"), F.lit(key).alias("key"), "notes")
    rows.select("clip_id", F.lit("plain").alias("theme"), geometry.alias("geometry"), sequence.alias("sequence")).write.json(folder)


def load_truth(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(notes, lines without a sequence): the second is to be empty, and says what is wrong where it isn't."""
    raw = spark.read.text(folder).select(F.from_json("value", SCHEMA).alias("truth"), "value")
    bad = raw.where("truth.sequence.notes is null").select("value")
    good = raw.where("truth.sequence.notes is not null")
    notes = good.select(F.col("truth.clip_id").alias("clip_id"), F.col("truth.sequence.tempo").alias("tempo"), F.inline("truth.sequence.notes"))
    return notes, bad


# The ending of a printed piece's file, and its fields; a note is an array of pitch, beat, length and staff.
PIECE = ".printed.json"
PIECE_SCHEMA = (
    "title string, video string, first_beat double, beat double, window array<double>, tempo double, beats_per_bar int, keys array<string>, "
    "notes array<array<string>>, lowest int, highest int, end double, beat_times array<array<double>>, sections array<double>, scored_by string"
)


def load_pieces(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(pieces, their notes) of the printed pieces in a folder, one file each; what a file leaves out is null or its usual value."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter=f"*{PIECE}").select(F.col("_metadata.file_name").alias("file"), "value")
    read = raw.select(F.expr(f"left(file, length(file) - {len(PIECE)})").alias("name"), F.from_json("value", PIECE_SCHEMA, {"mode": "FAILFAST"}).alias("p")).select("name", "p.*")
    point = lambda x: F.struct(x[0].alias("beat"), x[1].alias("t"))
    usual = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    pieces = read.select(
        "name", F.coalesce("title", "name").alias("title"), "video", usual("first_beat", 0.0), usual("beat", 0.0),
        F.struct(F.col("window")[0].alias("lo"), F.col("window")[1].alias("hi")).alias("window"), F.nullif("tempo", F.lit(0.0)).alias("tempo"),
        F.nullif("beats_per_bar", F.lit(0)).alias("beats_per_bar"), F.coalesce("keys", F.array().cast("array<string>")).alias("keys"), "lowest", "highest", "end",
        F.array_sort(F.transform(F.coalesce("beat_times", F.array().cast("array<array<double>>")), point)).alias("beat_times"),
        F.array_sort(F.coalesce("sections", F.array().cast("array<double>"))).alias("sections"), usual("scored_by", "beat"),
    )
    each = read.select("name", F.posexplode("notes").alias("note_no", "n"))
    notes = each.select(
        "name", "note_no", F.col("n")[0].cast("int").alias("pitch"), F.col("n")[1].cast("double").alias("beat"), F.col("n")[2].cast("double").alias("length"), F.col("n")[3].alias("staff")
    )
    return pieces, notes
