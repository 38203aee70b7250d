"""Queries on hands and staves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.operators import hands as h
from ostinato.plans.catalog import query
from ostinato.sources.views import notes, with_views

_N = with_views("notes")
_NEAR = (
    _N
    + """, idx AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY onset, pitch, duration, hand, velocity, note_id) AS i FROM notes),
 near AS (SELECT a.clip_id, a.note_id, a.pitch, b.pitch AS p, row_number() OVER (PARTITION BY a.clip_id, a.note_id ORDER BY abs(a.onset - b.onset), b.i) AS n
   FROM idx a JOIN idx b ON a.clip_id = b.clip_id),
 win AS (SELECT clip_id, note_id, any_value(pitch) AS pitch, min(p) AS low, max(p) AS high, count(*) AS n FROM near WHERE n <= {k} GROUP BY 1, 2),
 mid AS (SELECT clip_id, (min(pitch) + max(pitch)) / 2 AS mid FROM notes GROUP BY 1),
 split AS (SELECT clip_id, note_id, pitch, {clamp} AS split FROM (SELECT *, CASE WHEN n >= 4 THEN (low + high) / 2 ELSE mid END AS raw FROM win JOIN mid USING (clip_id)))
SELECT clip_id, note_id, split, CASE WHEN pitch > split OR (pitch = split AND pitch >= 60) THEN 'R' ELSE 'L' END AS side FROM split"""
)


@query(_NEAR.format(k=8, clamp="raw"))
def knn_hand_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.split_by_neighbours(notes(spark, sf_dir)).select("clip_id", "note_id", "split", "side")


@query(_NEAR.format(k=17, clamp="least(greatest(raw, 56), 66)"))
def staff_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.staves(notes(spark, sf_dir)).select("clip_id", "note_id", F.col("split").cast("double").alias("split"), "side")


@query(
    _N
    + """, medians AS (SELECT clip_id, hand, median(pitch) AS middle FROM notes GROUP BY 1, 2)
SELECT clip_id, hand, middle, CASE WHEN row_number() OVER (PARTITION BY clip_id ORDER BY middle, hand) = 1 AND count(*) OVER (PARTITION BY clip_id) > 1 THEN 'L' ELSE 'R' END AS side FROM medians"""
)
def hands_by_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.registers(notes(spark, sf_dir))


@query(
    _N
    + """, cuts AS (SELECT DISTINCT clip_id, pitch AS cut FROM notes),
 tried AS (SELECT n.clip_id, cut, count_if((n.pitch <= cut) = (hand = 'L')) AS good, count(*) AS total, count_if(hand = 'L') AS l FROM notes n JOIN cuts c ON n.clip_id = c.clip_id GROUP BY 1, 2),
 best AS (SELECT clip_id, max(greatest(good, total - good) / total) AS accuracy, max(greatest(l, total - l) / total) AS chance FROM tried WHERE total >= 8 GROUP BY 1)
SELECT clip_id, round(accuracy, 9) AS accuracy, round(chance, 9) AS chance, accuracy - chance >= 0.35::double * (1 - chance) AS look_like_hands FROM best"""
)
def lookalike_hands_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = h.hand_gain(notes(spark, sf_dir))
    return found.select("clip_id", F.round("accuracy", 9).alias("accuracy"), F.round("chance", 9).alias("chance"), "look_like_hands")


@query(
    _N
    + """, mid AS (SELECT clip_id, (min(pitch) + max(pitch)) / 2 AS mid FROM notes GROUP BY 1),
 rows AS (SELECT n.*, mid, onset + duration AS e FROM notes n JOIN mid USING (clip_id))
SELECT DISTINCT a.clip_id, a.note_id FROM rows a JOIN rows b ON a.clip_id = b.clip_id AND a.pitch > a.mid AND b.pitch <= b.mid AND least(a.e, b.e) - greatest(a.onset, b.onset) > 0.055::double"""
)
def sounds_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.sounds_across(notes(spark, sf_dir))


@query()
def chord_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.chord_ceiling(notes(spark, sf_dir))
