"""Written values: how long a note is on the page, and how a printed page judges what was heard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEGATO, FILL_PULSES, ONSET, VALUE = 0.6, 1.25, 0.07, 0.15


def written_durations(notes: DataFrame, step: float) -> DataFrame:
    """Plain rule: a note held for most of the way to the hand's next onset is written up to it, as is one that ends within a
    pulse and a quarter of it; others keep their snapped length. A hand's last onset keeps its length.

    notes: clip_id, note_id, hand, onset, duration (all in beats).
    """
    lane = W.partitionBy("clip_id", "hand").orderBy("onset")
    dense = notes.select("clip_id", "hand", "onset").distinct().withColumn("next", F.lead("onset").over(lane))
    gaps = dense.withColumn("gap", F.col("next") - F.col("onset"))
    pulse = gaps.where("gap > 0").groupBy("clip_id", "hand").agg(F.array_sort(F.collect_list("gap")).alias("g"))
    pulse = pulse.select("clip_id", "hand", F.element_at("g", F.expr("cast(size(g) div 2 + 1 as int)")).alias("pulse"))
    rows = notes.join(gaps.drop("next"), ["clip_id", "hand", "onset"]).join(pulse, ["clip_id", "hand"], "left")
    legato = F.col("duration") >= F.col("gap") * LEGATO
    near = (F.col("gap") <= F.col("pulse") * FILL_PULSES) & (F.col("duration") >= F.col("gap") / 2)
    own = F.greatest(F.lit(step), F.rint(F.col("duration") / step) * step)
    written = F.when(F.col("gap").isNull(), own).when(legato | near, F.col("gap")).otherwise(F.least(own, F.col("gap")))
    return rows.withColumn("written", written).select("clip_id", "note_id", "hand", "onset", "written")


def printed_score(page: DataFrame, heard: DataFrame, bar: float) -> DataFrame:
    """Per clip: printed notes, those heard within 70 ms, and of these the right staff and a written value within 15% of a bar.

    page: clip_id, note_id, pitch, onset, length, staff; heard: clip_id, note_id, pitch, onset, written, staff.
    """
    from ostinato.operators.matching import greedy_in_order

    as_note = lambda d, length, staff: d.select(
        "note_id", "clip_id", "onset", "pitch", F.col(length).alias("duration"), F.col(staff).alias("hand"), F.lit(0).cast("long").alias("velocity")
    )
    pairs = greedy_in_order(as_note(page, "length", "staff"), as_note(heard, "written", "staff"), ONSET)
    wanted = page.select(F.col("note_id").alias("ref_id"), F.col("length"), F.col("staff").alias("want"))
    got = heard.select(F.col("note_id").alias("est_id"), F.col("written"), F.col("staff").alias("got"))
    found = pairs.join(wanted, "ref_id").join(got, "est_id").groupBy("clip_id").agg(
        F.count("*").alias("found"), F.count_if(F.col("want") == F.col("got")).alias("staff_right"),
        F.count_if(F.abs(F.col("length") - F.col("written")) <= VALUE * bar).alias("value_right"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("found", "staff_right", "value_right")]
    return page.groupBy("clip_id").agg(F.count("*").alias("printed")).join(found, "clip_id", "left").select("clip_id", "printed", *zero)


def judgements(results: DataFrame) -> DataFrame:
    """Tempo within 3%, bar length within 5%, key among the accepted ones; null where the page doesn't say."""
    bar = lambda tempo, beats: F.col(beats) * 60.0 / F.col(tempo)
    return results.select(
        "name",
        (F.abs(F.col("found_tempo") / F.col("tempo") - 1) <= 0.03).alias("tempo_right"),
        (F.abs(bar("found_tempo", "found_beats") / bar("tempo", "beats") - 1) <= 0.05).alias("meter_right"),
        F.when(F.size("keys") > 0, F.array_contains("keys", F.col("found_key"))).alias("key_right"),
    )


def worded_regressions(before: DataFrame, after: DataFrame, metrics: list[str]) -> DataFrame:
    """(name, metric, was, now) for each metric that fell at all."""
    long = lambda d, value: d.select("name", F.expr(f"stack({len(metrics)}, {', '.join(f'{m!r}, {m}' for m in metrics)}) as (metric, {value})"))
    return long(before, "was").join(long(after, "now"), ["name", "metric"]).where(F.col("now") < F.col("was") - 1e-9)
