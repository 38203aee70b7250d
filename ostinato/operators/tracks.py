"""Tracks of tiles through frames: statistics, clocks, plausibility, and the tracking itself."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ostinato.operators.joins import merged
from ostinato.sources.tiles import SPEED, STRIKE

EDGE, MIN_FALL_SAMPLES, MIN_FALL, MATCH_TOLERANCE = 2.0, 4, -0.05, 0.6
MATCH_PX, MATCH_RATIO, MAX_GAP, RECENT, SEEN_BY_TOP = 8.0, 0.6, 0.12, 8, 2
MIN_TRAVEL, MIN_SCROLLING, SCROLL_RATE = 0.06, 5, 0.15
TRACK = ["clip_id", "note_id"]


def cross_times(tiles: DataFrame) -> DataFrame:
    """When each track's lower edge meets the strike line: the median over frames that show that edge."""
    seen = tiles.where(F.col("bottom") < STRIKE - EDGE)
    return seen.groupBy(*TRACK).agg(F.median(F.col("time") + (F.lit(STRIKE) - F.col("bottom")) / SPEED).alias("onset"), F.count("*").alias("n"))


def fall_rates(tiles: DataFrame) -> DataFrame:
    """Slopes of both edges over frames that show them, and whether the track falls like a tile; too few samples pass."""
    low = F.col("bottom") < STRIKE - EDGE
    high = F.col("top") > EDGE
    when = lambda shown, edge: F.when(shown, F.col(edge))
    rates = tiles.groupBy(*TRACK).agg(
        F.regr_slope(when(low, "bottom"), "time").alias("low_rate"), F.count_if(low).alias("low_n"),
        F.regr_slope(when(high, "top"), "time").alias("high_rate"), F.count_if(high).alias("high_n"),
    )
    like = lambda rate, n: (F.col(n) < MIN_FALL_SAMPLES) | (
        (F.col(rate) >= MIN_FALL * SPEED) & (F.abs(F.col(rate) / SPEED - 1) <= MATCH_TOLERANCE)
    )
    passes = lambda rate, n: F.coalesce(like(rate, n), F.lit(True))
    return rates.withColumn("falls", passes("low_rate", "low_n") | passes("high_rate", "high_n"))


def growth(tiles: DataFrame) -> DataFrame:
    """How fast a track grows while its upper edge is still hidden, and where its upper edge mostly is."""
    return tiles.where(F.col("bottom") < STRIKE - EDGE).groupBy(*TRACK).agg(
        F.regr_slope(F.col("bottom") - F.col("top"), F.col("time")).alias("grows"), F.median("top").alias("top"), F.count("*").alias("n")
    )


def plausible(tiles: DataFrame, interval: float) -> DataFrame:
    """Tracks seen often enough, with an unclipped lower edge, that have fallen far enough."""
    least = max(3, round(0.1 / interval))
    stats = tiles.groupBy(*TRACK).agg(
        F.count("*").alias("n"), F.count_if(F.col("bottom") < STRIKE - EDGE).alias("unclipped"), (F.max("bottom") - F.min("bottom")).alias("fell")
    )
    return stats.withColumn("plausible", (F.col("n") >= least) & (F.col("unclipped") > 0) & (F.col("fell") >= 0.06 * SPEED))


def edge_steps(tiles: DataFrame) -> DataFrame:
    """Pixels and seconds from each frame of a track to its next, where the lower edge is shown in both."""
    order = W.partitionBy(*TRACK).orderBy("frame")
    rows = tiles.where(F.col("bottom") < STRIKE - EDGE).withColumns(
        {"px": F.lead("bottom").over(order) - F.col("bottom"), "seconds": F.lead("time").over(order) - F.col("time")}
    )
    return rows.where("px is not null")


def clock_buckets(steps: DataFrame, width: float, least: int) -> DataFrame:
    """Scroll rate per tumbling bucket: all pixels over all seconds."""
    return (
        steps.groupBy("clip_id", F.floor(F.col("time") / width).alias("bucket"))
        .agg(F.sum("px").alias("px"), F.sum("seconds").alias("seconds"), F.count("*").alias("n"))
        .where(F.col("n") >= least)
        .withColumn("rate", F.col("px") / F.col("seconds"))
    )


def robust_mean(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The mean without what is under half or over twice the median."""
    middle = rows.groupBy(*keys).agg(F.median(column).alias("_m"))
    near = rows.join(middle, keys).where(F.col(column).between(F.col("_m") / 2, F.col("_m") * 2))
    return near.groupBy(*keys).agg(F.avg(column).alias("mean"), F.count("*").alias("n"))


def median_spread(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Median, and median distance from it."""
    middle = rows.groupBy(*keys).agg(F.median(column).alias("middle"))
    return rows.join(middle, keys).groupBy(*keys).agg(F.first("middle").alias("middle"), F.median(F.abs(F.col(column) - F.col("middle"))).alias("spread"))


def pauses(tiles: DataFrame, least: float) -> DataFrame:
    """Runs of frames that show the same picture, of at least ``least`` seconds: (clip_id, first, last)."""
    # two sums of 64-bit hashes and a count tell a frame's picture, whatever the order of its tiles. Sums, as tiles may be there more than
    # once, and by halves, which don't overflow; places are tenths of a pixel, multiplied before they are rounded as SQL does
    tile = [F.col("pitch"), F.col("hand"), F.round(F.col("top") * 10), F.round(F.col("bottom") * 10)]
    hashes = {seed: F.xxhash64(F.lit(seed), *tile) for seed in (1, 2)}
    halves = [F.sum(half).alias(f"{part}{seed}") for seed, h in hashes.items() for part, half in (("low", h.bitwiseAND(0xFFFFFFFF)), ("high", F.shiftrightunsigned(h, 32)))]
    picture = F.struct(F.count("*").alias("n"), *halves).alias("picture")
    movable = F.max(((F.col("bottom") < STRIKE - EDGE) | (F.col("top") > EDGE)).cast("int")).alias("movable")
    frames = tiles.groupBy("clip_id", "frame", "time").agg(picture, movable)
    order = W.partitionBy("clip_id").orderBy("frame")
    same = (F.lag("picture").over(order) == F.col("picture")) & (F.lag("frame").over(order) == F.col("frame") - 1) & (F.col("movable") == 1)
    marked = frames.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).drop("picture")
    run = marked.withColumn("run", F.sum("new").over(order))
    found = run.groupBy("clip_id", "run").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.min("time").alias("a"), F.max("time").alias("b"))
    return found.where(F.col("b") - F.col("a") >= least).select("clip_id", "first", "last")


def scroll_clock(clock: DataFrame, stops: DataFrame) -> DataFrame:
    """Seconds of movement up to each frame: frames inside a pause add nothing."""
    still = stops.select("clip_id", F.explode(F.sequence(F.col("first") + 1, "last")).alias("frame")).withColumn("still", F.lit(1))
    order = W.partitionBy("clip_id").orderBy("frame")
    rows = merged(clock, still, ["clip_id", "frame"], "left")
    step = F.when(F.col("still") == 1, 0.0).otherwise(F.col("time") - F.coalesce(F.lag("time").over(order), F.col("time")))
    return rows.withColumn("step", step).withColumn("moved", F.sum("step").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("still", "step")


class Lane:
    """Open tracks of one lane (clip, pitch, colour), and how a frame's tiles join them.

    A track is a list: id, times seen, and the last RECENT observations (time, top, bottom). Plain lists, so that a stream can keep
    them as its state.
    """

    def __init__(self, next_id: int = 0, top_continuity: bool = False):
        self.open: list[list] = []
        self.next_id, self.top_continuity = next_id, top_continuity

    @staticmethod
    def due(track: list, time: float) -> tuple[float, float]:
        """Where the track's top and bottom should be: falling at the scroll speed from the median of what was seen of each edge; the
        bottom stops at the strike line."""
        seen = track[2]
        low = sorted(b - SPEED * t for t, _, b in seen if b < STRIKE - 1)
        if low:
            base = (low[(len(low) - 1) // 2] + low[len(low) // 2]) / 2
        else:
            base = seen[-1][2] - SPEED * seen[-1][0]
        high = sorted(a - SPEED * t for t, a, _ in seen)
        return (high[(len(high) - 1) // 2] + high[len(high) // 2]) / 2 + SPEED * time, min(base + SPEED * time, STRIKE)

    def _pairs(self, time: float, tops: list[float], bottoms: list[float], places: list) -> list[tuple[float, int, int]]:
        found = []
        for k, track in enumerate(self.open):
            last = track[2][-1]
            past = time - last[0]
            if past <= 0:
                continue
            limit = max(MATCH_PX, MATCH_RATIO * SPEED * past)
            for j, b in enumerate(bottoms):
                error = abs(b - places[k][1])
                if error < limit and not (self.top_continuity and tops[j] > last[1] + SPEED * past + limit):
                    found.append((error, j, k))
        return found

    def _pairs_by_top(self, time: float, tops: list[float], bottoms: list[float], places: list) -> list[tuple[float, int, int]]:
        """A tile whose top is where the track's should be, and that reaches further down than the track should, is the same tile with
        something under it. Only tracks seen before have a course to be judged by."""
        return [
            (error, j, k)
            for k, track in enumerate(self.open)
            if track[1] >= SEEN_BY_TOP and time > track[2][-1][0]
            for j, b in enumerate(bottoms)
            if b > places[k][1] and (error := abs(tops[j] - places[k][0])) < MATCH_PX / 2
        ]

    def frame(self, time: float, before: float | None, tops: list[float], bottoms: list[float]) -> tuple[list[int], list[int]]:
        """Track ids for this frame's tiles, and ids of tracks retired before it. ``before``: the clip's frame before this one."""
        late = [t for t in self.open if before is not None and before - t[2][-1][0] > MAX_GAP + 1e-9]
        if late:
            self.open = [t for t in self.open if t not in late]
        places = [self.due(t, time) for t in self.open]
        ids = [-1] * len(bottoms)
        met: set[int] = set()
        for pairs, by_top in ((self._pairs, False), (self._pairs_by_top, True)) if self.open else ():
            if len(met) == min(len(self.open), len(bottoms)):
                break
            for _, j, k in sorted(pairs(time, tops, bottoms, places)):
                if k in met or ids[j] >= 0:
                    continue
                met.add(k)
                track = self.open[k]
                # what lies below a tile that was known by its top is not the tile
                self._extend(track, time, tops[j], places[k][1] if by_top else bottoms[j])
                ids[j] = track[0]
        for j, b in enumerate(bottoms):
            if ids[j] < 0:
                ids[j] = self.next_id
                self.open.append([self.next_id, 0, []])
                self._extend(self.open[-1], time, tops[j], b)
                self.next_id += 1
        return ids, [t[0] for t in late]

    @staticmethod
    def _extend(track: list, time: float, top: float, bottom: float) -> None:
        track[1] += 1
        track[2] = [*track[2][1 - RECENT :], [time, top, bottom]]


def with_previous_frame(tiles: DataFrame, clock: DataFrame) -> DataFrame:
    """Adds the time of the clip's frame before, whether or not this lane had a tile in it."""
    order = W.partitionBy("clip_id").orderBy("frame")
    before = clock.select("clip_id", "frame", F.lag("time").over(order).alias("prev_frame_time"))
    return merged(tiles, before, ["clip_id", "frame"])


_TILE = ["clip_id", "pitch", "hand", "frame", "bottom", "top", "time", "prev_frame_time"]
_KINDS = {"clip_id": pa.int64(), "pitch": pa.int64(), "hand": pa.string(), "track_id": pa.int64(), "frame": pa.int64(), "time": pa.float64(), "top": pa.float64(), "bottom": pa.float64()}
TRACKED = "clip_id long, pitch long, hand string, track_id long, frame long, time double, top double, bottom double"


def build_tracks(tiles: DataFrame) -> DataFrame:
    """Track ids for tiles (with prev_frame_time), lane by lane: nearest to where a track is due, one to one, within a bound that
    grows with the time since it was seen; what is left over by its top.

    Lanes are dealt by a hash and stream by in order, so neither a clip nor a partition is held, only one lane's open tracks.
    """
    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.select(_TILE).repartition(n, "clip_id", "pitch", "hand").sortWithinPartitions(*_TILE[:6])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lane, frame, out = None, Lane(), [], []

        def close() -> None:
            ids, _ = lane.frame(frame[0][6], frame[0][7], [r[5] for r in frame], [r[4] for r in frame])
            out.extend((*r[:3], i, r[3], r[6], r[5], r[4]) for r, i in zip(frame, ids, strict=True))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS.values())], names=list(_KINDS))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if frame and (row[3] != frame[0][3] or row[:3] != now):
                    close()
                    frame = []
                if row[:3] != now:
                    now, lane = row[:3], Lane()
                frame.append(row)
            yield batch_of(out)
            out.clear()
        if frame:
            close()
        yield batch_of(out)

    return dealt.mapInArrow(run, TRACKED)


def timing_samples(tiles: DataFrame, keys: list[str], interval: float) -> DataFrame:
    """Tiles with ``low`` and ``high``: whether this frame's lower and upper edge tell when the tile meets the strike line.

    An edge that is cut off has stopped moving: the lower one within half a frame's fall of the furthest it got, the upper one within
    half a frame's fall of the highest it sat, if it sat there more than once. A top only moves down; once one has climbed by more than
    a frame's fall, and never is cut off after that, the track follows the next tile, whose top tells nothing of this one. A cut-off
    top forgets the tops before it.
    """
    step = SPEED * interval
    whole = W.partitionBy(*keys)
    order = whole.orderBy("frame")
    highest = F.min("top").over(whole) + step / 2
    rows = tiles.withColumns({"_floor": F.max("bottom").over(whole) - step / 2, "_roof": highest})
    at_roof = F.count_if(F.col("top") <= F.col("_roof")).over(whole) >= 2
    rows = rows.withColumn("_cut", at_roof & (F.col("top") <= F.col("_roof")))
    rows = rows.withColumn("_part", F.count_if(F.col("_cut")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    lowest = F.max("top").over(W.partitionBy(*keys, "_part").orderBy("frame").rowsBetween(W.unboundedPreceding, -1))
    cut_later = F.max(F.col("_cut").cast("int")).over(order.rowsBetween(0, W.unboundedFollowing))
    climbs = ~F.col("_cut") & (F.col("top") < lowest - max(step, 2 * EDGE)) & (cut_later == 0)
    rows = rows.withColumn("_climbs", F.coalesce(climbs, F.lit(False)).cast("int"))
    rows = rows.withColumn("_arrived", F.max("_climbs").over(order.rowsBetween(W.unboundedPreceding, 0)))
    low = (F.col("bottom") < STRIKE - EDGE) & (F.col("bottom") < F.col("_floor"))
    high = (F.col("top") > EDGE) & ~F.col("_cut") & (F.col("_arrived") == 0)
    return rows.withColumns({"low": low, "high": high}).drop("_floor", "_roof", "_cut", "_part", "_climbs", "_arrived")


def notes_of(tiles: DataFrame, keys: list[str], interval: float) -> DataFrame:
    """A note per track (keys) that fell like a tile: onset and end from the medians of where its edges meet the strike line; the height
    it had at most stands for a length whose end never showed. (keys, onset, duration, n)"""
    meet = lambda edge: F.col("time") + (F.lit(STRIKE) - F.col(edge)) / SPEED
    when = lambda shown, value: F.when(F.col(shown), value)
    fell = lambda shown, edge: F.max_by(when(shown, F.col(edge)), when(shown, F.col("frame"))) - F.min_by(when(shown, F.col(edge)), when(shown, F.col("frame")))
    stats = timing_samples(tiles, keys, interval).groupBy(*keys).agg(
        F.count("*").alias("n"), F.median(when("low", meet("bottom"))).alias("onset"), F.median(when("high", meet("top"))).alias("end"),
        F.max(F.col("bottom") - F.col("top")).alias("tall"), F.count_if("low").alias("low_n"), F.count_if("high").alias("high_n"),
        fell("low", "bottom").alias("low_fell"), fell("high", "top").alias("high_fell"),
        F.regr_slope(when("low", F.col("bottom")), F.col("time")).alias("low_rate"), F.regr_slope(when("high", F.col("top")), F.col("time")).alias("high_rate"),
    )
    # the upper edge counts only if it fell at the scroll's rate, for long enough
    by_top = F.when((F.col("high_n") >= MIN_SCROLLING) & (F.abs(F.col("high_rate") / SPEED - 1) <= SCROLL_RATE), F.col("high_fell"))
    travelled = F.greatest(F.col("low_fell"), F.coalesce(by_top, F.lit(0.0))) >= MIN_TRAVEL * SPEED
    like = lambda k: (F.col(f"{k}_n") < MIN_FALL_SAMPLES) | ((F.col(f"{k}_rate") >= MIN_FALL * SPEED) & (F.abs(F.col(f"{k}_rate") / SPEED - 1) <= MATCH_TOLERANCE))
    falls = F.coalesce(like("low"), F.lit(True)) | F.coalesce(like("high"), F.lit(True))
    length = F.coalesce(F.col("end") - F.col("onset"), F.col("tall") / SPEED)
    found = stats.where((F.col("low_n") > 0) & travelled & falls).withColumn("length", length).where("length > 0")
    return found.select(*keys, F.greatest("onset", F.lit(0.0)).alias("onset"), F.greatest("length", F.lit(0.02)).alias("duration"), "n")


def tracks_to_notes(tracks: DataFrame, interval: float) -> DataFrame:
    return notes_of(tracks, ["clip_id", "pitch", "hand", "track_id"], interval)


def weighted_line(rows: DataFrame, keys: list[str], x: str, y: str, w: str) -> DataFrame:
    """(keys, slope, level, n) of the weighted least-squares line; no line where x doesn't vary. One pass of sums."""
    a, b, c = F.col(x), F.col(y), F.col(w)
    sums = rows.groupBy(*keys).agg(
        F.sum(c).alias("_w"), F.sum(c * a).alias("_x"), F.sum(c * b).alias("_y"), F.sum(c * a * a).alias("_xx"), F.sum(c * a * b).alias("_xy"), F.count("*").alias("n")
    )
    across = F.col("_w") * F.col("_xx") - F.col("_x") * F.col("_x")
    slope = (F.col("_w") * F.col("_xy") - F.col("_x") * F.col("_y")) / across
    lines = sums.where(across > 1e-9).withColumn("slope", slope)
    return lines.select(*keys, "slope", ((F.col("_y") - F.col("slope") * F.col("_x")) / F.col("_w")).alias("level"), "n")


def trimmed_line(rows: DataFrame, keys: list[str], x: str, y: str, w: str, reach: float = 3.0) -> DataFrame:
    """The weighted line through the rows that lie within ``reach`` times the median distance from the line through all of them."""
    first = weighted_line(rows, keys, x, y, w).drop("n")
    apart = rows.join(first, keys).withColumn("_off", F.abs(F.col(y) - F.col("slope") * F.col(x) - F.col("level")))
    middle = apart.groupBy(*keys).agg(F.median("_off").alias("_middle"))
    near = apart.join(middle, keys).where(F.col("_off") <= reach * F.col("_middle") + 1e-6)
    return weighted_line(near.drop("slope", "level"), keys, x, y, w)
