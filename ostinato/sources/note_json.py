"""Note sequences as JSON documents, one per clip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOTE = "struct<onset:double,pitch:bigint,duration:double,hand:string,velocity:bigint,note_id:bigint>"
DOCUMENT = f"struct<tempo:double,key:string,source:string,notes:array<{NOTE}>>"


def write_clips(notes: DataFrame) -> DataFrame:
    """(clip_id, document): the clip's notes in their total order."""
    note = F.struct("onset", "pitch", "duration", "hand", "velocity", "note_id")
    grouped = notes.groupBy("clip_id").agg(F.sort_array(F.collect_list(note)).alias("notes"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("tempo", "double"), ("key", "string"), ("source", "string"))]
    return grouped.select("clip_id", F.to_json(F.struct(*none, "notes")).alias("document"))


def read_clips(documents: DataFrame) -> DataFrame:
    """Notes of documents; a document that doesn't fit the schema fails the read."""
    parsed = F.from_json("document", DOCUMENT, {"mode": "FAILFAST"})
    return documents.select("clip_id", F.inline(parsed["notes"]))
