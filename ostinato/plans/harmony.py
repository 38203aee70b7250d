"""Queries on pitch-class weights and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.functions.music import MAJOR_KEYS, MAJOR_PROFILE, MAJOR_SCALE, MINOR_KEYS, MINOR_PROFILE, MINOR_SCALE
from ostinato.operators import tonality
from ostinato.plans.catalog import query
from ostinato.sources.views import notes, with_views

_WEIGHTS = (
    with_views("notes")
    + """, weights AS (SELECT c.clip_id, p.pc, coalesce(w, 0) AS w FROM (SELECT DISTINCT clip_id FROM notes) c
  CROSS JOIN (SELECT unnest(range(12)) AS pc) p
  LEFT JOIN (SELECT clip_id, pitch % 12 AS pc, sum(duration) AS w FROM notes GROUP BY 1, 2) USING (clip_id, pc))"""
)
_KEYS = (
    _WEIGHTS
    + f""", tonics AS (SELECT unnest(range(12)) AS tonic), degrees AS (SELECT unnest(range(12)) AS degree),
 modes AS (SELECT 'major' AS mode, {MAJOR_KEYS} AS names, {MAJOR_PROFILE}::double[] AS profile, {MAJOR_SCALE} AS scale, 0 AS up
   UNION ALL SELECT 'minor', {MINOR_KEYS}, {MINOR_PROFILE}::double[], {MINOR_SCALE}, 3),
 keyed AS (SELECT clip_id, mode, names[tonic + 1] || ' ' || mode AS key, profile[degree + 1] AS p, list_contains(scale, degree) AS inside,
   list_contains(scale, degree) AND NOT list_contains({MAJOR_SCALE}, (degree + tonic) % 12) AS signed, a.w, n.w AS rival
   FROM tonics, degrees, modes JOIN weights a ON a.pc = (degree + tonic) % 12
   JOIN weights n USING (clip_id) WHERE n.pc = ((degree + tonic) % 12 - CASE WHEN (tonic + up) % 12 * 7 % 12 <= 6 THEN 1 ELSE -1 END + 12) % 12),
 scored AS (SELECT clip_id, key, coalesce(CASE WHEN isnan(corr(w, p)) THEN -1 ELSE corr(w, p) END, -1)
   - 0.3 * (1 - coalesce(sum(CASE WHEN inside THEN w ELSE 0 END) / nullif(sum(w), 0), 0))
   - 0.2 * coalesce(count_if(signed AND w = 0)::double / nullif(count_if(signed), 0), 0)
   - CASE WHEN any_value(mode) = 'major' THEN 0.1 * coalesce(count_if(signed AND w < rival)::double / nullif(count_if(signed), 0), 0) ELSE 0 END AS score
   FROM keyed GROUP BY clip_id, key)"""
)


@query(_WEIGHTS + " SELECT clip_id, CAST(pc AS INTEGER) AS pc, round(w, 6) AS w FROM weights")
def pitch_class_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tonality.pitch_class_weights(notes(spark, sf_dir)).select("clip_id", "pc", F.round("w", 6).alias("w"))


@query(_KEYS + " SELECT clip_id, key, round(score, 6) AS score FROM scored")
def key_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = tonality.pitch_class_weights(notes(spark, sf_dir))
    return tonality.key_scores(weights).select("clip_id", "key", F.round("score", 6).alias("score"))


@query(
    _KEYS
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY round(score, 12) DESC, key DESC) AS n FROM scored)
SELECT a.clip_id, a.key, round(a.score, 6) AS best, round(least(1, greatest(0, (a.score - b.score) / greatest(abs(a.score), 1e-6))), 6) AS confidence
FROM ranked a JOIN ranked b ON a.clip_id = b.clip_id AND a.n = 1 AND b.n = 2"""
)
def key_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = tonality.pitch_class_weights(notes(spark, sf_dir))
    found = tonality.find_key(tonality.key_scores(weights))
    return found.select("clip_id", "key", F.round("best", 6).alias("best"), F.round("confidence", 6).alias("confidence"))
