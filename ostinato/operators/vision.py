"""Frames as pictures: drawing tiles, measuring the board, finding colours and tiles again, and the scroll speed.

A picture is a row (clip_id, frame, time, height, width, image), image being row-major 8-bit BGR. Kernels are numpy over one
picture or one band of rows; Spark deals pictures out, and statistics over pictures are grouped by clip and band.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ostinato.functions.music import BLACK, LOWEST, MAJOR_SCALE
from ostinato.runtime import persist_table

HEIGHT, WIDTH, BAND = 100, 208, 32
SCALE = HEIGHT / 300.0
BACKGROUND = (16, 12, 12)
COLOURS = {"L": (230, 120, 40), "R": (60, 200, 90)}
FRAME = "clip_id long, frame long, time double, height int, width int, image binary"


def key_spans(width: int = WIDTH) -> dict[int, tuple[int, int]]:
    """First and past column of each of the 88 keys."""
    unit, out, white = width / 52, {}, 0
    for pitch in range(LOWEST, LOWEST + 88):
        if pitch % 12 in BLACK:
            half = unit * 0.31
            out[pitch] = (round(white * unit - half), round(white * unit + half))
        else:
            out[pitch] = (round(white * unit), round((white + 1) * unit))
            white += 1
    return out


@cache
def _blank(width: int) -> np.ndarray:
    return np.tile(np.array(BACKGROUND, np.uint8), (HEIGHT, width, 1))


def drawn(tiles: list[tuple[bool, int, int, int, int, str]], width: int = WIDTH) -> np.ndarray:
    """A picture of tiles (black key, first column, past column, first row, past row, hand), black keys over white ones."""
    image = _blank(width).copy()
    for _, a, b, top, bottom, hand in sorted(tiles, key=lambda t: t[0]):
        image[top:bottom, a:b] = COLOURS[hand]
    return image


def render(tiles: DataFrame) -> DataFrame:
    """A picture per frame that shows a tile. A frame's tiles, which one picture has room for, are gathered; drawing is one pass."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = key_spans()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                images = []
                for shown in part.column(3).to_pylist():
                    own = []
                    for t in shown:
                        top = round(t["top"] * SCALE)
                        own.append((t["pitch"] % 12 in BLACK, *spans[t["pitch"]], top, max(round(t["bottom"] * SCALE), top + 1), t["hand"]))
                    images.append(drawn(own).tobytes())
                n = part.num_rows
                columns = [*(part.column(k) for k in range(3)), pa.array([HEIGHT] * n, pa.int32()), pa.array([WIDTH] * n, pa.int32()), pa.array(images, pa.binary())]
                yield pa.record_batch(columns, names=["clip_id", "frame", "time", "height", "width", "image"])

    each = F.struct(F.col("pitch").cast("int").alias("pitch"), "top", "bottom", "hand")
    shown = tiles.groupBy(F.col("clip_id").cast("long").alias("clip_id"), F.col("frame").cast("long").alias("frame"), "time")
    return shown.agg(F.sort_array(F.collect_list(each)).alias("tiles")).mapInArrow(build, FRAME)


def picture(image: bytes, height: int, width: int) -> np.ndarray:
    return np.frombuffer(image, np.uint8).reshape(height, width, 3)


def row_runs(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each run of equal rows, and the run that each row is in. What is a row's own is worked out once for each run."""
    flat = image.reshape(len(image), -1)
    new = np.ones(len(image), dtype=bool)
    new[1:] = (flat[1:] != flat[:-1]).any(axis=1)
    return np.flatnonzero(new), np.cumsum(new) - 1


def labels(rows: np.ndarray, colours: list[tuple[int, int, int]], radius: float) -> np.ndarray:
    """Which colour each pixel is nearest to, within the radius; -1: none."""
    planes = rows.astype(np.int32).transpose(2, 0, 1)
    label, best = np.full(rows.shape[:2], -1), np.full(rows.shape[:2], radius * radius)
    for c, colour in enumerate(colours):
        apart = sum(np.square(plane - v) for plane, v in zip(planes, colour, strict=True))
        near = (apart < best) | ((apart == best) & (label < 0))
        label[near], best[near] = c, apart[near]
    return label


def lit_keys(lit: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """For each row and key, whether most of the key's own columns are lit."""
    so_far = np.zeros((len(lit), lit.shape[1] + 1), dtype=np.int32)
    np.cumsum(lit, axis=1, out=so_far[:, 1:])
    return 2 * (so_far[:, past] - so_far[:, first]) > past - first


def detect(frames: DataFrame, palette: dict[str, tuple[int, int, int]] = COLOURS, radius: float = 60.0) -> DataFrame:
    """Tiles in pictures: for each key, runs of rows in which most of its columns are near a colour of the palette.

    A black key's columns count for the black key only. Rows: clip_id, frame, time, pitch, hand, top, bottom (pixels).
    """
    names = list(palette)
    colours = [palette[n] for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boards: dict[int, tuple] = {}
        for batch in batches:
            out: list[tuple] = []
            for clip, frame, time, h, w, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if w not in boards:
                    boards[w] = _board(w)
                keys, spans, first, past = boards[w]
                image = picture(raw, h, w)
                starts, at = row_runs(image)
                label = labels(image[starts], colours, radius)
                whole = label[at]
                for c, name in enumerate(names):
                    lit = label == c
                    if not lit.any():
                        continue
                    on = np.zeros((len(keys), h + 2), dtype=bool)  # a row per key, dark at both ends
                    on[:, 1:-1] = lit_keys(lit, first, past).T[:, at]
                    key, edge = np.nonzero(on[:, 1:] != on[:, :-1])
                    for k, x, y in zip(key[::2].tolist(), edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                        if _own(whole, c, x, y, *spans[keys[k]], keys[k]):
                            out.append((clip, frame, time, keys[k], name, float(x), float(y)))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.string(), pa.float64(), pa.float64())
            columns_ = [pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)]
            yield pa.record_batch(columns_, names=["clip_id", "frame", "time", "pitch", "hand", "top", "bottom"])

    return frames.mapInArrow(run, "clip_id long, frame long, time double, pitch long, hand string, top double, bottom double")


def _board(width: int) -> tuple[list[int], dict[int, tuple[int, int]], np.ndarray, np.ndarray]:
    """Keys, their columns, and the first and past column of each that is its own: black keys stand on the edges of white ones, so what
    they leave of a white key is one piece."""
    spans = key_spans(width)
    keys = sorted(spans)
    own = []
    for pitch in keys:
        a, b = spans[pitch]
        if pitch % 12 not in BLACK:
            a = max([a, *(spans[k][1] for k in (pitch - 1,) if k in spans and k % 12 in BLACK)])
            b = max(a, min([b, *(spans[k][0] for k in (pitch + 1,) if k in spans and k % 12 in BLACK)]))
        own.append((a, b))
    return keys, spans, np.array([a for a, _ in own]), np.array([b for _, b in own])


def _own(label: np.ndarray, colour: int, top: int, bottom: int, a: int, b: int, pitch: int) -> bool:
    """A black key's run is its own unless the colour goes on over the white keys on a side of it."""
    if pitch % 12 not in BLACK:
        return True
    rows = label[top:bottom]
    left, right = rows[:, max(0, a - 1)] == colour, rows[:, min(rows.shape[1] - 1, b)] == colour
    return not (left.mean() > 0.9 or right.mean() > 0.9)


def _middle(stack: np.ndarray) -> np.ndarray:
    """The median of each column of bytes, halves cut off."""
    low, high = (len(stack) - 1) // 2, len(stack) // 2
    parted = np.partition(stack, (low, high), axis=0)
    return ((parted[low].astype(np.uint16) + parted[high]) // 2).astype(np.uint8)


def median_picture(frames: DataFrame) -> DataFrame:
    """Per clip the median over time of each pixel's grey, by bands of 32 rows: (clip_id, band, grey)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for clip, _, _, h, w, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                image = picture(raw, h, w)
                starts, at = row_runs(image)
                grey = (image[starts].sum(axis=2, dtype=np.uint16) // 3).astype(np.uint8)[at]
                out += [(clip, k, grey[k * BAND : (k + 1) * BAND].tobytes()) for k in range(-(-h // BAND))]
            kinds = (pa.int64(), pa.int32(), pa.binary())
            yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["clip_id", "band", "grey"])

    def middle(own: pd.DataFrame) -> pd.DataFrame:
        stack = np.stack([np.frombuffer(x, np.uint8) for x in own["grey"]])
        return pd.DataFrame({"clip_id": [own["clip_id"].iloc[0]], "band": [own["band"].iloc[0]], "grey": [_middle(stack).tobytes()]})

    schema = "clip_id long, band int, grey binary"
    return frames.mapInArrow(cut, schema).groupBy("clip_id", "band").applyInPandas(middle, schema)


def row_shift(first: np.ndarray, second: np.ndarray) -> float:
    """Rows that the second picture has moved down, by phase correlation of row profiles per column, to a part of a row."""
    # a column that is the same in all rows has no part in the correlation
    told = (first != first[:1]).any(axis=0) & (second != second[:1]).any(axis=0)
    if not told.any():
        return 0.0
    first, second = first[:, told], second[:, told]
    a, b = (np.fft.rfft(x - x.mean(axis=0), axis=0, n=2 * len(x)) for x in (first, second))
    cross = (a.conj() * b).sum(axis=1)
    size = np.abs(cross)
    spread = np.fft.irfft(np.where(size > 1e-9, cross / np.maximum(size, 1e-9), 0))
    top = int(spread[: len(first)].argmax())
    low, mid, high = spread[top - 1], spread[top], spread[(top + 1) % len(spread)]
    bend = low - 2 * mid + high
    return top + (0.5 * (low - high) / bend if abs(bend) > 1e-12 else 0.0)


def scroll_speeds(frames: DataFrame) -> DataFrame:
    """Per clip: median rows per second between pictures that follow each other, their spread, and how many were used."""

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for clip, frame, time, h, w, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                image = picture(raw, h, w)
                starts, at = row_runs(image)
                lit = (image[starts].sum(axis=2, dtype=np.uint16) > 150)[at]
                out.append((clip, frame, time, h, w, np.packbits(lit).tobytes() if lit.any() else None))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["clip_id", "frame", "time", "height", "width", "mask"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for clip, past, h, w, before, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = (np.unpackbits(np.frombuffer(x, np.uint8), count=h * w).reshape(h, w) for x in (before, after))
                speed = row_shift(a, b) / past
                if 1 < speed < 200:
                    out.append((clip, float(speed)))
            yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.float64()))], names=["clip_id", "speed"])

    # only masks, as bits, are sorted by clip and frame; each meets the one before it
    made = frames.mapInArrow(masks, "clip_id long, frame long, time double, height int, width int, mask binary")
    order = Window.partitionBy("clip_id").orderBy("frame")
    before = {c: F.lag(c).over(order) for c in ("time", "height", "width", "mask")}
    pairs = made.withColumns({f"{c}_before": x for c, x in before.items()}).withColumn("past", F.col("time") - F.col("time_before"))
    pairs = pairs.where("past < 0.3 and mask is not null and mask_before is not null and height = height_before and width = width_before")
    return speed_summary(pairs.select("clip_id", "past", "height", "width", "mask_before", "mask").mapInArrow(measure, "clip_id long, speed double"))


def speed_summary(speeds: DataFrame) -> DataFrame:
    """(clip_id, speed, spread, samples) of (clip_id, speed)."""
    per_clip = speeds.groupBy("clip_id").agg(F.median("speed").alias("speed"), F.collect_list("speed").alias("all"), F.count("*").alias("samples"))
    apart = per_clip.select("clip_id", "speed", "samples", F.explode("all").alias("one"))
    return apart.groupBy("clip_id", "speed", "samples").agg(F.median(F.abs(F.col("one") - F.col("speed"))).alias("spread")).select("clip_id", "speed", "spread", "samples")


def period(profile: np.ndarray, low: float, high: float) -> float:
    """The lowest strong period of a profile between two bounds, refined on a fine grid."""
    signal = profile - profile.mean()
    size = 8 * len(signal)
    power = np.abs(np.fft.rfft(signal * np.hanning(len(signal)), n=size)) ** 2
    at = np.arange(1, len(power))
    periods = size / at
    inside = (periods >= low) & (periods <= high)
    strong = at[inside][power[1:][inside] >= 0.5 * power[1:][inside].max()]
    coarse = size / strong.min()
    x = np.arange(len(signal))
    fine = np.linspace(coarse * 0.97, coarse * 1.03, 241)
    score = [abs((signal * np.exp(-2j * np.pi * x / p)).sum()) for p in fine]
    return float(fine[int(np.argmax(score))])


def anchor(black: list[bool]) -> int:
    """Which white key of the octave (0 is C) the first gap between white keys follows, from whether a black key stands in each gap."""
    pattern = [(pc + 1) % 12 in BLACK for pc in MAJOR_SCALE]
    scores = [sum(b == pattern[(k + start) % 7] for k, b in enumerate(black)) for start in range(7)]
    return int(np.argmax(scores))


def palette(frames: DataFrame, colours: int = 3, seed: int = 5) -> DataFrame:
    """Most common colours over all pictures: exact counts of colours cut to five bits, then weighted k-means on at most 32768 of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for h, w, raw in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                image = picture(raw, h, w)
                starts, at = row_runs(image)
                p = image[starts].reshape(-1, 3).astype(np.int64) >> 3
                codes.append((p[:, 0] << 10) | (p[:, 1] << 5) | p[:, 2])
                counts.append(np.repeat(np.bincount(at), w))
            # sums of whole numbers, which doubles hold exactly up to 2^53
            total = np.bincount(np.concatenate(codes), np.concatenate(counts), minlength=1 << 15).astype(np.int64)
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["c", "n"])

    return clustered(frames.mapInArrow(count, "c int, n long"), colours, seed)


def clustered(parts: DataFrame, colours: int, seed: int) -> DataFrame:
    """k-means on counts n of colours c."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    # written down: the fit goes over the counts many times, and drawing or decoding pictures is dear
    counts = persist_table(parts.groupBy("c").agg(F.sum("n").cast("double").alias("n")), "colour-counts")
    part = lambda k: (F.shiftright("c", k).bitwiseAND(31) * 8 + 4).cast("double")
    points = counts.select("n", array_to_vector(F.array(part(10), part(5), part(0))).alias("features"))
    model = KMeans(k=colours, seed=seed, weightCol="n", initSteps=4).fit(points)
    named = model.transform(points).select("prediction", "n", vector_to_array("features").alias("f"))
    mean = lambda k: (F.sum(F.col("f")[k] * F.col("n")) / F.sum("n"))
    return named.groupBy(F.col("prediction").alias("color_id")).agg(
        F.sum("n").cast("long").alias("pixels"), *[F.round(mean(k), 3).alias(c) for k, c in enumerate("bgr")]
    )
