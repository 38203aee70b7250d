"""Matching estimated notes with true ones, and the metrics of a match."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ostinato.operators.joins import band_join

TOLERANCE, FALL = 0.05, 0.02


def candidates(truth: DataFrame, found: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Pairs of one clip and pitch whose onsets are within the tolerance."""
    pairs = band_join(truth, found, ["clip_id", "pitch"], "onset", "onset", tolerance)
    return pairs.select(
        "clip_id", "pitch", F.col("note_id").alias("ref_id"), F.col("r_note_id").alias("est_id"),
        F.abs(F.col("onset") - F.col("r_onset")).alias("error"),
        F.abs(F.col("duration") - F.col("r_duration")).alias("duration_error"),
        (F.col("hand") == F.col("r_hand")).alias("same_hand"),
        F.col("onset").alias("ref_onset"), F.col("r_onset").alias("est_onset"),
    )


def mutual_nearest(pairs: DataFrame) -> DataFrame:
    """Pairs in which each is the other's nearest; ties go to the smaller id."""
    for_ref = W.partitionBy("clip_id", "ref_id").orderBy("error", "est_id")
    for_est = W.partitionBy("clip_id", "est_id").orderBy("error", "ref_id")
    ranked = pairs.withColumns({"_r": F.row_number().over(for_ref), "_e": F.row_number().over(for_est)})
    return ranked.where("_r = 1 and _e = 1").drop("_r", "_e")


_MATCH = "clip_id long, pitch long, ref_id long, est_id long, error double"


_LANE = ["clip_id", "pitch", "ref_onset", "ref_id", "error", "est_id"]


def _by_lane(pairs: DataFrame, solve: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """Runs ``solve`` on each clip and pitch's candidates (ref_onset, ref_id, error, est_id), sorted; it returns those it takes.

    Sorted partitions stream by; one lane at a time is held.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.select(_LANE).repartition(n, "clip_id", "pitch").sortWithinPartitions(_LANE)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
    names = ["clip_id", "pitch", "ref_id", "est_id", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple] = []
        for lane, part in groupby(rows, key=lambda r: r[:2]):
            out += [(*lane, x[1], x[3], x[2]) for x in solve([r[2:] for r in part])]
            if len(out) > 8192:
                yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=names)
                out = []
        yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=names)

    return dealt.mapInArrow(run, _MATCH)


def largest_matching(wants: dict[int, list[int]]) -> dict[int, int]:
    """Who holds each thing, as many as can be: each one in turn takes what it wants first; if that is held, its holder moves on to
    what else it wants, if it can, before the next want is tried. The search is kept in a list, so long chains need no recursion."""
    holder: dict[int, int] = {}
    for one in wants:
        tried: set[int] = set()
        path = [(one, iter(wants[one]), -1)]  # who moves, what is left to try, and what it is to take
        while path:
            who, left, _ = path[-1]
            thing = next((x for x in left if x not in tried), None)
            if thing is None:
                path.pop()
                continue
            tried.add(thing)
            path[-1] = (who, left, thing)
            if thing not in holder:
                holder.update((taken, by) for by, _, taken in path)
                break
            path.append((holder[thing], iter(wants[holder[thing]]), -1))
    return holder


def maximum_matching(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs, as many as there can be, true notes in order of onset, candidates nearest first.

    Decomposes by clip and pitch. Returns clip_id, pitch, ref_id, est_id, error.
    """

    def solve(rows: list[tuple]) -> list[tuple]:
        wants: dict[int, list[int]] = {}
        for _, ref, _, est in rows:
            wants.setdefault(ref, []).append(est)
        holder = largest_matching(wants)
        return [x for x in rows if holder.get(x[3]) == x[1]]

    return _by_lane(pairs, solve)


def with_details(matched: DataFrame, truth: DataFrame, found: DataFrame) -> DataFrame:
    """A matching's pairs with duration_error and same_hand."""
    mine = truth.select(F.col("note_id").alias("ref_id"), F.col("duration").alias("_d"), F.col("hand").alias("_h"))
    other = found.select(F.col("note_id").alias("est_id"), F.col("duration").alias("_e"), F.col("hand").alias("_g"))
    both = matched.join(mine, "ref_id").join(other, "est_id")
    return both.withColumns({"duration_error": F.abs(F.col("_d") - F.col("_e")), "same_hand": F.col("_h") == F.col("_g")}).drop("_d", "_e", "_h", "_g")


def greedy_in_order(truth: DataFrame, found: DataFrame, tolerance: float) -> DataFrame:
    """For true notes in order, the nearest estimate of that pitch not taken yet; a taken one is gone."""

    def solve(rows: list[tuple]) -> list[tuple]:
        taken: set[int] = set()
        out: list[tuple] = []
        for row in rows:
            if row[3] not in taken and (not out or out[-1][1] != row[1]):
                taken.add(row[3])
                out.append(row)
        return out

    return _by_lane(candidates(truth, found, tolerance), solve)


def ratio(a: F.Column, b: F.Column) -> F.Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def scores(matched: F.Column, found: F.Column, wanted: F.Column) -> dict[str, F.Column]:
    precision, recall = ratio(matched, found), ratio(matched, wanted)
    return {"precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall)}


def clip_metrics(truth: DataFrame, found: DataFrame, matched: DataFrame) -> DataFrame:
    """Counts and mean errors per clip; 0 where nothing matched."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    of_match = matched.groupBy("clip_id").agg(
        F.count("*").alias("matched"),
        F.avg("error").alias("onset_mae"),
        F.percentile("error", F.lit(0.95)).alias("onset_p95"),
        F.avg("duration_error").alias("duration_mae"),
        F.avg(F.col("same_hand").cast("double")).alias("hand_accuracy"),
    )
    counts = truth.groupBy("clip_id").agg(F.count("*").alias("reference_count"))
    found_counts = found.groupBy("clip_id").agg(F.count("*").alias("estimate_count"))
    joined = counts.join(found_counts, "clip_id", "left").join(of_match, "clip_id", "left")
    names = ["estimate_count", "matched", "onset_mae", "onset_p95", "duration_mae", "hand_accuracy"]
    whole = joined.select("clip_id", "reference_count", *[zero(F.col(n)).alias(n) for n in names])
    return whole.withColumns(scores(F.col("matched"), F.col("estimate_count"), F.col("reference_count")))


def pooled(metrics: DataFrame) -> DataFrame:
    """Metrics per clip and over all clips (clip_id null), pooled over notes and not averaged over clips."""
    sums = metrics.rollup("clip_id").agg(
        *[F.sum(c).alias(c) for c in ("reference_count", "estimate_count", "matched")],
        F.sum(F.col("hand_accuracy") * F.col("matched")).alias("_hands"),
    )
    with_scores = sums.withColumns(scores(F.col("matched"), F.col("estimate_count"), F.col("reference_count")))
    return with_scores.withColumn("hand_accuracy", ratio(F.col("_hands"), F.col("matched"))).drop("_hands")


def regressions(baseline: DataFrame, current: DataFrame, fall: float = FALL) -> DataFrame:
    """Clips whose F1 fell by more than ``fall``; a clip that isn't there any more counts as 0."""
    after = current.select(F.col("clip_id").alias("_c"), F.col("f1").alias("after"))
    joined = baseline.select("clip_id", F.col("f1").alias("before")).join(after, F.col("clip_id") == F.col("_c"), "left").drop("_c")
    joined = joined.withColumn("after", F.coalesce("after", F.lit(0.0)))
    return joined.where(F.col("before") - F.col("after") > fall).withColumn("delta", F.col("after") - F.col("before"))


def settled_chords(page: DataFrame, played: DataFrame, pairs: DataFrame) -> DataFrame:
    """Further pairs that an alignment in order dropped only for the order in which a chord came in.

    page: clip_id, page_no, pitch, beat; played: clip_id, played_no, pitch; pairs: clip_id, page_no, played_no. A page's note without a
    partner whose chord (its beat, two notes or more) has one elsewhere takes the first free played note of its pitch that is no
    further from the chord's partners than the chord is large. Notes of a page take turns in their order.
    """
    met = page.join(pairs, ["clip_id", "page_no"], "left")
    chord = met.groupBy("clip_id", "beat").agg(F.count("*").alias("size"), F.min("played_no").alias("low"), F.max("played_no").alias("high"))
    chord = chord.where("size > 1 and low is not null").select("clip_id", "beat", (F.col("low") - F.col("size")).alias("from"), (F.col("high") + F.col("size")).alias("to"))
    open_ = met.where("played_no is null").drop("played_no").join(chord, ["clip_id", "beat"])
    free = played.join(pairs.select("clip_id", "played_no"), ["clip_id", "played_no"], "left_anti")
    # places near a chord are a generator, so that this is a join on equality
    asked = open_.select("clip_id", "pitch", "page_no", F.explode(F.sequence("from", "to")).alias("played_no"))
    found = asked.join(free, ["clip_id", "pitch", "played_no"])

    def solve(rows: list[tuple]) -> list[tuple]:
        taken: set[int] = set()
        given: set[int] = set()
        out = []
        for row in rows:  # (page_no, page_no, distance, played_no), in order
            if row[1] not in given and row[3] not in taken:
                given.add(row[1])
                taken.add(row[3])
                out.append(row)
        return out

    lanes = found.select(
        F.col("clip_id").cast("long"), F.col("pitch").cast("long"), F.col("page_no").cast("double").alias("ref_onset"), F.col("page_no").cast("long").alias("ref_id"),
        F.col("played_no").cast("double").alias("error"), F.col("played_no").cast("long").alias("est_id"),
    )
    return _by_lane(lanes, solve).select("clip_id", F.col("ref_id").alias("page_no"), F.col("est_id").alias("played_no"))
