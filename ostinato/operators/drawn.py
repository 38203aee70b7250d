"""Pictures of notes' tiles, drawn where they are looked at and held as runs of equal rows.

Pictures and results are those of ``vision.render`` and the operators on it: every frame that shows a tile is drawn, none is left out
and none is sent anywhere. A picture repeats its rows, and pictures of a clip repeat each other's, so each distinct row is drawn and judged
once for all runs of it. Notes are dealt by clip and block of frames, so tiles are made in Python and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.functions.music import BLACK
from ostinato.operators import vision as v
from ostinato.operators.joins import interval_frames
from ostinato.runtime import partitions
from ostinato.sources import tiles as src

#: Frames of a block, and tiles worked on at once (more only where a single frame shows them).
BLOCK, TILES = 64, 1 << 15
HANDS = list(v.COLOURS)


def dealt(notes: DataFrame, by: list[str], behind: int = 0) -> DataFrame:
    """A row per note and block of frames that may show it, dealt by columns and in order of clip and block. A block begins ``behind``
    frames before its own. A note without clip or key has no place in a picture."""
    first, last = src.frame_range()
    rows = notes.where("clip_id is not null and pitch is not null").select(
        F.col("clip_id").cast("long").alias("clip_id"), F.col("pitch").cast("long").alias("pitch"), (F.col("hand") == HANDS[1]).alias("second"),
        "onset", "duration", first.alias("first"), last.alias("last"),
    )
    block = lambda frame: F.floor(frame / BLOCK)
    spread = interval_frames(rows.where("first <= last"), block(F.col("first")), block(F.col("last") + behind)).withColumnRenamed("frame", "block")
    spread = spread.select("clip_id", "block", "first", "last", "onset", "duration", "pitch", "second")
    return spread.repartition(partitions(notes.sparkSession), *by).sortWithinPartitions("clip_id", "block")


@dataclass
class Runs:
    """Pictures of some frames in order of block and frame: runs of equal rows in order of picture and row."""

    clip: np.ndarray  # of each picture
    block: np.ndarray
    frame: np.ndarray
    picture: np.ndarray  # of each run: its picture, first row, past row and distinct row
    top: np.ndarray
    past: np.ndarray
    row: np.ndarray
    rows: np.ndarray  # distinct rows: (number, WIDTH, 3)


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows in which no block is cut."""
    kept: list[pa.RecordBatch] = []

    def columns() -> list[np.ndarray]:
        whole = pa.Table.from_batches(kept)
        return [c.to_numpy() for c in whole.columns]

    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(k).to_numpy() for k in (0, 1)]
        change = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])) + 1
        at = int(change[-1]) if len(change) else 0
        if kept and not at and [kept[-1].column(k)[-1].as_py() for k in (0, 1)] != [key[0][0], key[1][0]]:
            yield columns()
            kept = []
        if at:
            kept.append(batch.slice(0, at))
            yield columns()
            kept = []
        kept.append(batch.slice(at))
    if kept:
        yield columns()


def _portions(batches: Iterator[pa.RecordBatch], behind: int) -> Iterator[tuple]:
    """(clip, block, first, last, onset, duration, pitch, second, group), first and last being inside the block, in portions of about
    TILES tiles. A block that holds more is cut between frames, each part beginning ``behind`` frames early."""
    for clip, block, first, last, *rest in _whole_blocks(batches):
        low, high = np.maximum(first, block * BLOCK - behind), np.minimum(last, block * BLOCK + BLOCK - 1)
        begins = np.flatnonzero(np.concatenate([[True], (clip[1:] != clip[:-1]) | (block[1:] != block[:-1])]))
        size = np.add.reduceat(high - low + 1, begins)
        portion = (np.cumsum(size) - size) // TILES
        portion[1:] = np.cumsum((portion[1:] != portion[:-1]) | (size[1:] > TILES) | (size[:-1] > TILES))
        portion[0] = 0
        group = np.repeat(np.arange(len(begins)), np.diff([*begins, len(clip)]))
        ends = np.flatnonzero(np.append(portion[1:] != portion[:-1], True)) + 1
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            part = slice(begins[a], begins[b] if b < len(begins) else len(clip))
            own = [x[part] for x in (clip, block, low, high, *rest, group)]
            own[-1] = own[-1] - a
            most = int(size[a:b].sum())
            if most <= 2 * TILES:
                yield tuple(own)
                continue
            step = max(1, BLOCK * TILES // most)
            start = int(own[1][0]) * BLOCK
            for s in range(start, start + BLOCK, step):
                lo, hi = np.maximum(own[2], s - behind), np.minimum(own[3], min(s + step, start + BLOCK) - 1)
                some = lo <= hi
                yield tuple(x[some] for x in (*own[:2], lo, hi, *own[4:]))


def _pieces(slot: np.ndarray, top: np.ndarray, bottom: np.ndarray, low: np.ndarray, high: np.ndarray, colour: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, row, change of colour) of what is seen of tiles; where several stand on a key of a picture (a slot), later ones cover the others."""
    crowded = np.bincount(slot)[slot] > 1
    alone = ~crowded
    found = [(slot[alone], low[alone], colour[alone]), (slot[alone], high[alone], -colour[alone])]
    if crowded.any():
        slot, top, bottom, low, high, colour = (x[crowded] for x in (slot, top, bottom, low, high, colour))
        order = np.lexsort((colour, bottom, top, slot))
        slot, low, high, colour = (x[order] for x in (slot, low, high, colour))
        own, at = np.unique(slot, return_inverse=True)
        canvas = np.zeros((len(own), v.HEIGHT + 2), np.int8)  # dark at both ends
        long = high - low
        rows = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long - low, long)
        canvas[np.repeat(at, long), rows + 1] = np.repeat(colour, long)  # the last one stays
        change = np.diff(canvas, axis=1)
        which, row = np.nonzero(change)
        found.append((own[which], row, change[which, row].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def drawn_rows(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Rows of pictures in which keys show the colours (two bits each, 32 keys a word; 0: none), black keys over white ones."""
    spans, rows = v.key_spans(), np.repeat(v._blank(v.WIDTH)[:1], len(words), axis=0)
    for k in sorted(range(len(keys)), key=lambda k: keys[k] % 12 in BLACK):
        shown = (words[:, k // 32] >> np.uint64(2 * (k % 32))) & np.uint64(3)
        a, b = spans[int(keys[k])]
        for c, hand in enumerate(HANDS, 1):
            rows[shown == c, a:b] = v.COLOURS[hand]
    return rows


def pictures(batches: Iterator[pa.RecordBatch], behind: int = 0) -> Iterator[Runs]:
    """Pictures of all frames that show a tile, from dealt notes."""
    board = np.array(sorted(v.key_spans()))
    for clip, block, first, last, onset, duration, pitch, second, group in _portions(batches, behind):
        many = last - first + 1
        note = np.repeat(np.arange(len(many)), many)
        frame = np.arange(len(note)) - np.repeat(np.cumsum(many) - many - first, many)
        # the same steps as src.tiles, so the same doubles
        low = src.STRIKE + (frame / src.FPS - onset[note]) * src.SPEED
        top = np.maximum(low - duration[note] * src.SPEED, 0.0)
        bottom = np.minimum(low, src.STRIKE)
        seen = (bottom > 0) & (top < src.STRIKE) & (bottom - top >= 1)
        if not seen.any():
            continue
        note, frame, top, bottom = note[seen], frame[seen], top[seen], bottom[seen]
        place = group[note] * (BLOCK + behind) + frame - block[note] * BLOCK + behind
        there = np.bincount(place) > 0
        picture = (np.cumsum(there) - 1)[place]
        n = int(there.sum())
        whose = np.zeros(n, np.int64)
        whose[picture] = note
        which = np.zeros(n, np.int64)
        which[picture] = frame

        start = np.rint(top * v.SCALE).astype(np.int64)
        end = np.minimum(np.maximum(np.rint(bottom * v.SCALE).astype(np.int64), start + 1), v.HEIGHT)
        shown = (start < end) & np.isin(pitch[note], board)
        keys, key = np.unique(pitch[note][shown], return_inverse=True)
        slot, at, change = _pieces(picture[shown] * max(1, len(keys)) + key, *(x[shown] for x in (top, bottom, start, end)), (1 + second[note][shown]).astype(np.int64))
        of, key = np.divmod(slot, max(1, len(keys)))
        words = -(-len(keys) // 32) or 1
        steps = np.zeros((n, v.HEIGHT + 1, words), np.uint64)
        # colours of keys have bits of their own and sums wrap, so additions up to a row give the row's colours
        np.add.at(steps.reshape(-1), (of * (v.HEIGHT + 1) + at) * words + key // 32, change.astype(np.uint64) << (2 * (key % 32)).astype(np.uint64))
        new = (steps[:, : v.HEIGHT] != 0).any(axis=2)
        new[:, 0] = True
        of, begins = np.nonzero(new)
        past = np.append(begins[1:], 0)
        past[past == 0] = v.HEIGHT
        code = np.cumsum(steps, axis=1, dtype=np.uint64)[of, begins]
        if words == 1:
            distinct, row = np.unique(code[:, 0], return_inverse=True)
            distinct = distinct[:, None]
        else:
            distinct, row = np.unique(code, axis=0, return_inverse=True)
        yield Runs(clip[whose], block[whose], which, of, begins, past, row.reshape(-1), drawn_rows(distinct, keys))


def _batch(columns: list, schema: dict) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)], names=list(schema))


def detect(notes: DataFrame, radius: float = 60.0) -> DataFrame:
    """``vision.detect`` on the pictures of notes."""
    schema = {"clip_id": pa.int64(), "frame": pa.int64(), "time": pa.float64(), "pitch": pa.int64(), "hand": pa.string(), "top": pa.float64(), "bottom": pa.float64()}
    colours = list(v.COLOURS.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, spans, first, past = v._board(v.WIDTH)
        keys = np.array(keys)
        black = np.array([k % 12 in BLACK for k in keys])
        left, right = (np.array(x) for x in zip(*((max(0, a - 1), min(v.WIDTH - 1, b)) for a, b in (spans[k] for k in keys.tolist())), strict=True))
        for p in pictures(batches):
            label = v.labels(p.rows, colours, radius)
            begins, ends, long = p.top == 0, p.past == v.HEIGHT, p.past - p.top
            for c, hand in enumerate(HANDS):
                near = label == c
                lit = v.lit_keys(near, first, past)
                some = np.flatnonzero(lit.any(axis=0))
                if not len(some):
                    continue
                on = lit.T[some][:, p.row]
                start, stop = on.copy(), on.copy()
                start[:, 1:] &= ~on[:, :-1] | begins[1:]
                stop[:, :-1] &= ~on[:, 1:] | ends[:-1]
                key, a = np.nonzero(start)
                b = np.nonzero(stop)[1]
                own = np.ones(len(a), dtype=bool)
                for side in (left, right):
                    # rows of a black key's run over which the colour goes on at a side of it
                    for k in np.flatnonzero(black[some]):
                        so_far = np.concatenate([[0], np.cumsum(near[:, side[some[k]]][p.row] * long)])
                        at = np.flatnonzero(key == k)
                        own[at] &= ~((so_far[b[at] + 1] - so_far[a[at]]) / (p.past[b[at]] - p.top[a[at]]) > 0.9)
                key, a, b = key[own], a[own], b[own]
                of = p.picture[a]
                yield _batch([p.clip[of], p.frame[of], p.frame[of] / src.FPS, keys[some[key]], np.full(len(a), hand), p.top[a].astype(float), p.past[b].astype(float)], schema)

    return dealt(notes, ["clip_id", "block"]).mapInArrow(run, "clip_id long, frame long, time double, pitch long, hand string, top double, bottom double")


def palette(notes: DataFrame, colours: int = 3, seed: int = 5) -> DataFrame:
    """``vision.palette`` of the pictures of notes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 15, np.int64)
        for p in pictures(batches):
            c = p.rows.astype(np.int64) >> 3
            rows = np.bincount(p.row, p.past - p.top, minlength=len(p.rows))
            code = (c[:, :, 0] << 10) | (c[:, :, 1] << 5) | c[:, :, 2]
            # sums of whole numbers, which doubles hold exactly up to 2^53
            total += np.bincount(code.reshape(-1), np.repeat(rows, v.WIDTH), minlength=1 << 15).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["c", "n"])

    return v.clustered(dealt(notes, ["clip_id", "block"]).mapInArrow(count, "c int, n long"), colours, seed)


def median_picture(notes: DataFrame) -> DataFrame:
    """``vision.median_picture`` of the pictures of notes: greys are counted by pixel, a clip at a time."""
    greys = sorted({sum(c) // 3 for c in (v.BACKGROUND, *v.COLOURS.values())})
    values = np.array(greys, np.uint16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, 0
        counts = np.zeros((len(greys), v.HEIGHT, v.WIDTH), np.int64)

        def middle() -> pa.RecordBatch:
            so_far = np.cumsum(counts, axis=0)
            low, high = (values[(so_far <= k).sum(axis=0)] for k in ((n - 1) // 2, n // 2))
            grey = ((low + high) // 2).astype(np.uint8)
            bands = range(-(-v.HEIGHT // v.BAND))
            return pa.record_batch(
                [pa.array([now] * len(bands), pa.int64()), pa.array(bands, pa.int32()), pa.array([grey[k * v.BAND : (k + 1) * v.BAND].tobytes() for k in bands], pa.binary())],
                names=["clip_id", "band", "grey"],
            )

        for p in pictures(batches):
            grey = p.rows.sum(axis=2, dtype=np.uint16) // 3
            at = np.flatnonzero(np.append(True, p.clip[1:] != p.clip[:-1]))
            for a, b in zip(at, [*at[1:], len(p.clip)], strict=True):
                if p.clip[a] != now:
                    if n:
                        yield middle()
                    now, n = int(p.clip[a]), 0
                    counts[:] = 0
                n += int(b - a)
                part = slice(*np.searchsorted(p.picture, (a, b)))
                used, row = np.unique(p.row[part], return_inverse=True)
                steps = np.zeros((len(used), v.HEIGHT + 1))
                np.add.at(steps, (row, p.top[part]), 1)
                np.subtract.at(steps, (row, p.past[part]), 1)
                shown = np.cumsum(steps, axis=1)[:, : v.HEIGHT].T  # pictures that show the distinct row at each row
                for k, g in enumerate(greys):
                    counts[k] += (shown @ (grey[used] == g).astype(float)).astype(np.int64)
        if n:
            yield middle()

    return dealt(notes, ["clip_id"]).mapInArrow(run, "clip_id long, band int, grey binary")


def row_shifts(p: Runs, pairs: np.ndarray) -> np.ndarray:
    """``vision.row_shift`` of lit pixels between pictures (pairs - 1) and pairs; 0 where no column tells."""
    lit = p.rows.sum(axis=2, dtype=np.uint16) > 150
    # columns that are the same in all rows count as often as they stand there
    columns, weight = np.unique(lit, axis=1, return_counts=True)
    begins = np.searchsorted(p.picture, np.arange(len(p.clip)))
    shown = columns[p.row]
    told = np.logical_or.reduceat(shown, begins) & ~np.logical_and.reduceat(shown, begins)
    shift = np.zeros(len(pairs))
    which, column = np.nonzero(told[pairs - 1] & told[pairs])
    if not len(which):
        return shift
    need, at = np.unique(np.concatenate([(pairs[which] - 1) * len(weight) + column, pairs[which] * len(weight) + column]), return_inverse=True)
    rows = np.repeat(p.row, p.past - p.top).reshape(len(p.clip), v.HEIGHT)
    profile = columns.T[(need % len(weight))[:, None], rows[need // len(weight)]].astype(float)
    wave = np.fft.rfft(profile - profile.mean(axis=1, keepdims=True), axis=1, n=2 * v.HEIGHT)
    first = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
    cross = np.add.reduceat(wave[at[: len(which)]].conj() * wave[at[len(which) :]] * weight[column][:, None], first, axis=0)
    size = np.abs(cross)
    spread = np.fft.irfft(np.where(size > 1e-9, cross / np.maximum(size, 1e-9), 0), axis=1)
    top = spread[:, : v.HEIGHT].argmax(axis=1)
    each = np.arange(len(top))
    low, mid, high = spread[each, top - 1], spread[each, top], spread[each, (top + 1) % spread.shape[1]]
    bend = low - 2 * mid + high
    flat = np.abs(bend) <= 1e-12
    shift[which[first]] = top + np.where(flat, 0.0, 0.5 * (low - high) / np.where(flat, 1.0, bend))
    return shift


def scroll_speeds(notes: DataFrame) -> DataFrame:
    """``vision.scroll_speeds`` of the pictures of notes; a block begins with the last picture before it."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pictures(batches, behind=1):
            time = p.frame / src.FPS
            past = time[1:] - time[:-1]
            same = (p.clip[1:] == p.clip[:-1]) & (p.block[1:] == p.block[:-1]) & (past < 0.3)
            pairs = np.flatnonzero(same) + 1
            for k in range(0, len(pairs), 512):
                own = pairs[k : k + 512]
                speed = row_shifts(_part(p, own[0] - 1, own[-1] + 1), own - own[0] + 1) / past[own - 1]
                good = (speed > 1) & (speed < 200)
                yield pa.record_batch([pa.array(p.clip[own[good]], pa.int64()), pa.array(speed[good])], names=["clip_id", "speed"])

    return v.speed_summary(dealt(notes, ["clip_id", "block"], behind=1).mapInArrow(measure, "clip_id long, speed double"))


def _part(p: Runs, a: int, b: int) -> Runs:
    """Pictures from a to before b."""
    runs = slice(*np.searchsorted(p.picture, (a, b)))
    used, row = np.unique(p.row[runs], return_inverse=True)
    return Runs(p.clip[a:b], p.block[a:b], p.frame[a:b], p.picture[runs] - a, p.top[runs], p.past[runs], row, p.rows[used])
