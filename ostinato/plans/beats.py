"""Queries on rhythm. Beat, tatum and phase are fixed where a query needs them given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ostinato.operators import rhythm as r
from ostinato.plans.catalog import query
from ostinato.sources.views import notes, with_views

BEAT, TATUM, PHASE = 0.5, 0.125, 0.1
_N = with_views("notes")
_ONSETS = _N + ", onsets AS (SELECT DISTINCT clip_id, round(onset, 4) AS onset FROM notes)"
_GRID = ", grid AS (SELECT k, 0.06::double + k * (1.0::double - 0.06::double) / 1199 AS period FROM (SELECT unnest(range(1200)) AS k))"
_SCORES = (
    _ONSETS
    + _GRID
    + """, scored AS (SELECT clip_id, k, period, count(*) AS n, sqrt(avg(cos(2 * pi() * onset / period)) ** 2 + avg(sin(2 * pi() * onset / period)) ** 2) AS score
  FROM onsets CROSS JOIN grid GROUP BY 1, 2, 3)"""
)
_ACCENTS = (
    _N
    + """, accented AS (SELECT n.*, least(duration / 0.5::double, 4) * CASE WHEN pitch <= bass THEN 3 ELSE 1 END AS accent FROM notes n
  JOIN (SELECT clip_id, quantile_cont(pitch, 0.35) AS bass FROM notes GROUP BY 1) USING (clip_id))"""
)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.coherence(r.distinct_onsets(notes(spark, sf_dir)), r.period_grid(0.06, 1.0, 1200))


@query(_SCORES + " SELECT clip_id, CAST(k AS INTEGER) AS k, round(score, 6) AS score FROM scored")
def circular_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("clip_id", "k", F.round("score", 6).alias("score"))


@query(
    _SCORES
    + """ SELECT clip_id, round(max(period), 9) AS tatum, round(any_value(best), 6) AS best FROM scored JOIN (
  SELECT clip_id, max(score) AS best FROM scored GROUP BY 1 HAVING max(n) >= 8) USING (clip_id) WHERE score >= best * 0.92::double GROUP BY 1"""
)
def tatum_coarse_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.tatum(_scores(spark, sf_dir)).select("clip_id", F.round("tatum", 9).alias("tatum"), F.round("best", 6).alias("best"))


def _accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.accents(notes(spark, sf_dir), BEAT)


@query(_ACCENTS + " SELECT clip_id, note_id, round(accent, 6) AS accent FROM accented")
def accent_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accents(spark, sf_dir).select("clip_id", "note_id", F.round("accent", 6).alias("accent"))


@query(
    _ACCENTS
    + """, lines AS (SELECT unnest(range(4)) AS line), placed AS (SELECT clip_id, line, accent, (onset - line * 0.125::double) / 0.5::double AS place FROM accented, lines),
 summed AS (SELECT clip_id, line, sum(CASE WHEN abs(place - round_even(place, 0)) * 0.5::double < 0.0625::double THEN accent ELSE 0 END) AS weight FROM placed GROUP BY 1, 2)
SELECT clip_id, CAST(arg_max(line, (round(weight, 9), -line)) AS INTEGER) AS line, round(max(weight), 6) AS weight FROM summed GROUP BY 1"""
)
def beat_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.beat_phase(_accents(spark, sf_dir), BEAT, TATUM).select("clip_id", "line", F.round("weight", 6).alias("weight"))


@query(
    _N
    + """, votes AS (SELECT clip_id, ((CAST(round_even((onset - 0.1::double) / 0.5::double, 0) AS BIGINT) % 4) + 4) % 4 AS beat, sum(pow(2::double, (60 - pitch) / 12::double)) AS votes FROM notes GROUP BY 1, 2)
SELECT clip_id, arg_max(beat, (round(votes, 9), -beat)) AS downbeat, round(max(votes), 6) AS votes FROM votes GROUP BY 1"""
)
def downbeat_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.downbeat(notes(spark, sf_dir), BEAT, PHASE, 4).select("clip_id", "downbeat", F.round("votes", 6).alias("votes"))


_AUTO = (
    _ACCENTS
    + """, hit AS (SELECT clip_id, CAST(round_even(place, 0) AS BIGINT) AS b, sum(accent) AS x FROM (SELECT *, (onset - 0.1::double) / 0.5::double AS place FROM accented)
   WHERE abs(place - round_even(place, 0)) < 0.2::double GROUP BY 1, 2),
 series AS (SELECT s.clip_id, s.b, coalesce(x, 0) AS x FROM (SELECT clip_id, unnest(range(min(b), max(b) + 1)) AS b FROM hit GROUP BY clip_id) s LEFT JOIN hit USING (clip_id, b)),
 centred AS (SELECT clip_id, b, x - avg(x) OVER (PARTITION BY clip_id) AS c, count(*) OVER (PARTITION BY clip_id) AS n FROM series),
 lags AS (SELECT unnest([2, 3, 4, 6]) AS lag),
 matched AS (SELECT p.clip_id, p.lag, p.n, coalesce(coalesce(s, 0) / nullif(power, 0), 0) AS match FROM
   (SELECT clip_id, lag, max(n) AS n, sum(c * c) AS power FROM centred, lags GROUP BY 1, 2 HAVING max(n) > lag) p
   LEFT JOIN (SELECT a.clip_id, lag, sum(a.c * b.c) AS s FROM centred a, lags, centred b WHERE a.clip_id = b.clip_id AND b.b = a.b + lag GROUP BY 1, 2) q USING (clip_id, lag))"""
)


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.autocorrelation(r.beat_series(_accents(spark, sf_dir), BEAT, PHASE), [2, 3, 4, 6])


@query(_AUTO + " SELECT clip_id, CAST(lag AS INTEGER) AS lag, n, round(match, 6) AS match FROM matched")
def meter_autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("clip_id", "lag", "n", F.round("match", 6).alias("match"))


@query(
    _AUTO
    + """, wide AS (SELECT clip_id, max(n) AS n, coalesce(max(match) FILTER (lag = 2), -1) AS m2, coalesce(max(match) FILTER (lag = 3), -1) AS m3,
  coalesce(max(match) FILTER (lag = 4), -1) AS m4, coalesce(max(match) FILTER (lag = 6), -1) AS m6 FROM matched GROUP BY 1)
SELECT clip_id, CASE WHEN n < 12 THEN 4 WHEN n > 12 AND m6 >= greatest(m3, m4, 0) + 0.2::double THEN 6 WHEN m3 > m4 AND (n < 24 OR m3 > m2) THEN 3 ELSE 4 END AS beats_per_bar FROM wide"""
)
def metre_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.metre(_matches(spark, sf_dir), BEAT)


@query(
    _ONSETS
    + """, due AS (SELECT clip_id, onset, onset + 0.5::double AS due, onset + 0.5::double <= max(onset) OVER (PARTITION BY clip_id) + 0.03125::double AS room FROM onsets),
 told AS (SELECT a.clip_id, CASE WHEN EXISTS (SELECT 1 FROM onsets b WHERE b.clip_id = a.clip_id AND abs(a.due - b.onset) <= 0.03125::double) THEN 1::double ELSE 0::double END AS hit, room FROM due a)
SELECT clip_id, round(coalesce(avg(hit) FILTER (room), 0), 9) AS share FROM told GROUP BY 1"""
)
def repeats_at_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = r.repeats_at(r.distinct_onsets(notes(spark, sf_dir)), 0.5, 0.03125)
    return found.select("clip_id", F.round("share", 9).alias("share"))


@query(
    _N
    + """, slots AS (SELECT clip_id, CAST(round_even(onset / 0.5::double, 0) AS BIGINT) AS slot, list(DISTINCT pitch) AS here FROM notes GROUP BY 1, 2)
SELECT a.clip_id, round(avg(CASE WHEN list_has_any(a.here, b.here) THEN 1::double ELSE 0::double END), 9) AS share, count(*) AS slots
FROM slots a JOIN slots b ON a.clip_id = b.clip_id AND b.slot = a.slot + 4 GROUP BY 1"""
)
def pitch_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = r.pitch_returns(notes(spark, sf_dir), 0.5, 4)
    return found.select("clip_id", F.round("share", 9).alias("share"), "slots")


@query(
    _ONSETS
    + """, span AS (SELECT clip_id, min(onset) AS t0, max(onset) AS t1 FROM onsets GROUP BY 1),
 starts AS (SELECT clip_id, t0, t1, unnest(range(0, 40)) AS k FROM span)
SELECT o.clip_id, k, count(*) AS n FROM onsets o JOIN starts s ON o.clip_id = s.clip_id AND (o.onset - t0) / 3 >= k AND k > (o.onset - t0 - 6) / 3
WHERE t0 + k * 3 < t1 - 3 GROUP BY 1, 2 HAVING count(*) >= 8"""
)
def sliding_tempo_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.tempo_windows(r.distinct_onsets(notes(spark, sf_dir)), 6.0, 3.0)


_SNAP = "round_even((onset - 0.1::double) / 0.125::double, 0) * 0.125::double + 0.1::double"
_LEN = "round_even(duration / 0.125::double, 0) * 0.125::double"


@query(
    _N
    + f""" SELECT clip_id, note_id, round(CASE WHEN abs({_SNAP} - onset) <= 0.125::double * 0.35::double THEN {_SNAP} END, 6) AS snapped,
 round(CASE WHEN abs({_LEN} - duration) <= 0.125::double * 0.35::double AND {_LEN} >= 0.0625::double THEN {_LEN} ELSE greatest(duration, 0.03::double) END, 6) AS length FROM notes"""
)
def grid_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.grid_snap(notes(spark, sf_dir), TATUM, PHASE)
    return rows.select("clip_id", "note_id", F.round("snapped", 6).alias("snapped"), F.round("length", 6).alias("length"))


@query(
    _N
    + f""", res AS (SELECT clip_id, note_id, onset, onset - ({_SNAP}) AS residual FROM notes),
 late AS (SELECT a.clip_id, a.note_id, median(b.residual) AS late FROM res a JOIN res b ON a.clip_id = b.clip_id AND abs(a.onset - b.onset) <= 1 AND a.onset <> b.onset
   GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT clip_id, note_id, round(residual, 6) AS residual, round(late, 6) AS late FROM res LEFT JOIN late USING (clip_id, note_id)"""
)
def local_lateness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.local_lateness(notes(spark, sf_dir), TATUM, PHASE, 1.0)
    return rows.select("clip_id", "note_id", F.round("residual", 6).alias("residual"), F.round("late", 6).alias("late"))


@query(
    _N
    + """, marked AS (SELECT *, coalesce(onset - max(onset + duration) OVER (PARTITION BY clip_id, pitch ORDER BY onset, note_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 0.07::double, true) AS new FROM notes),
 run AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, pitch ORDER BY onset, note_id ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT clip_id, pitch, round(min(onset), 6) AS onset, round(max(onset + duration), 6) AS note_end, count(*) AS n FROM run GROUP BY clip_id, pitch, run"""
)
def merged_overlaps_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.merge_overlaps_simple(notes(spark, sf_dir), 0.07)
    return rows.select("clip_id", "pitch", F.round("onset", 6).alias("onset"), F.round("note_end", 6).alias("note_end"), "n")


@query(
    _N
    + """, dense AS (SELECT DISTINCT clip_id, hand, onset FROM notes), led AS (SELECT *, lead(onset, 1) OVER w AS next, lead(onset, 2) OVER w AS after FROM dense WINDOW w AS (PARTITION BY clip_id, hand ORDER BY onset))
SELECT clip_id, hand, round(onset, 6) AS onset, round(next - onset, 6) AS gap, round(after - onset, 6) AS gap2 FROM led"""
)
def next_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each different onset of a hand: how far the next one and the one after are."""
    order = W.partitionBy("clip_id", "hand").orderBy("onset")
    rows = notes(spark, sf_dir).select("clip_id", "hand", "onset").distinct()
    led = rows.withColumns({"n": F.lead("onset", 1).over(order), "a": F.lead("onset", 2).over(order)})
    return led.select(
        "clip_id", "hand", F.round("onset", 6).alias("onset"),
        F.round(F.col("n") - F.col("onset"), 6).alias("gap"), F.round(F.col("a") - F.col("onset"), 6).alias("gap2"),
    )


@query(
    _N
    + """, gaps AS (SELECT clip_id, hand, lead(onset) OVER (PARTITION BY clip_id, hand ORDER BY onset, note_id) - onset AS gap FROM notes),
 sorted AS (SELECT clip_id, hand, list_sort(list(gap)) AS g FROM gaps WHERE gap > 0 GROUP BY 1, 2)
SELECT clip_id, hand, round(g[len(g) // 2 + 1], 6) AS pulse FROM sorted"""
)
def hand_pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median of a hand's spacings."""
    order = W.partitionBy("clip_id", "hand").orderBy("onset", "note_id")
    gaps = notes(spark, sf_dir).withColumn("gap", F.lead("onset").over(order) - F.col("onset")).where("gap > 0")
    listed = gaps.groupBy("clip_id", "hand").agg(F.array_sort(F.collect_list("gap")).alias("g"))
    return listed.select("clip_id", "hand", F.round(F.element_at("g", F.expr("cast(size(g) div 2 + 1 as int)")), 6).alias("pulse"))
