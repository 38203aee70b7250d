"""The tables of interval events, derived from the event table, and fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.runtime import table

#: One second of music is ten hours of event time; a clip is one user.
_ONSET = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 3.6e10D"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """notes(note_id, clip_id, onset, pitch, duration, hand, velocity): what was played."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("note_id"),
        F.col("user_id").alias("clip_id"),
        F.expr(_ONSET).alias("onset"),
        (F.lit(48) + (F.col("event_id") * 5 + F.col("user_id")) % 24).alias("pitch"),
        F.greatest(F.lit(0.02), F.col("value") / 100).alias("duration"),
        F.when(F.col("event_type").isin("click", "view"), "L").otherwise("R").alias("hand"),
        (F.lit(40) + F.col("event_id") % 80).alias("velocity"),
    )


def _perturbed(truth: DataFrame, shift: F.Column) -> DataFrame:
    swapped = F.when(F.col("hand") == "L", "R").otherwise("L")
    return truth.where(F.col("note_id") % 17 != 0).select(
        "note_id",
        "clip_id",
        (F.col("onset") + shift).alias("onset"),
        "pitch",
        (F.col("duration") * 0.9).alias("duration"),
        F.when(F.col("note_id") % 11 == 0, swapped).otherwise(F.col("hand")).alias("hand"),
        "velocity",
    )


def estimate(truth: DataFrame) -> DataFrame:
    """A perturbed copy whose onsets are off by multiples of 12 ms."""
    return _perturbed(truth, (F.col("note_id") % 13 - 6) * F.lit(0.012))


def rough_estimate(truth: DataFrame) -> DataFrame:
    """A perturbed copy whose onsets are off by up to 0.6 s, so that matches compete."""
    return _perturbed(truth, (F.col("note_id") * 7919 % 1000 - 500) * F.lit(0.0012))


#: The same tables as SQL, for the oracle.
SQL = {
    "notes": """notes AS (SELECT event_id AS note_id, user_id AS clip_id,
  date_diff('microsecond', timestamp '2024-01-01', ts) / 3.6e10::double AS onset,
  48 + (event_id * 5 + user_id) % 24 AS pitch, greatest(0.02::double, value / 100) AS duration,
  CASE WHEN event_type IN ('click', 'view') THEN 'L' ELSE 'R' END AS hand, 40 + event_id % 80 AS velocity FROM events)""",
    "est": """est AS (SELECT note_id, clip_id, onset + (note_id % 13 - 6) * 0.012::double AS onset, pitch,
  duration * 0.9::double AS duration,
  CASE WHEN note_id % 11 = 0 THEN (CASE hand WHEN 'L' THEN 'R' ELSE 'L' END) ELSE hand END AS hand, velocity
  FROM notes WHERE note_id % 17 <> 0)""",
    "est2": """est2 AS (SELECT note_id, clip_id, onset + (note_id * 7919 % 1000 - 500) * 0.0012::double AS onset, pitch,
  duration * 0.9::double AS duration,
  CASE WHEN note_id % 11 = 0 THEN (CASE hand WHEN 'L' THEN 'R' ELSE 'L' END) ELSE hand END AS hand, velocity
  FROM notes WHERE note_id % 17 <> 0)""",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
