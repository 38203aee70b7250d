"""Operators whose next step needs the last one's result: folds over a lane, a clip or a pair of sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_REPEAT, REACH, SAME_END, TAIL_REACH, TAIL_LEAD = 0.07, 0.2, 0.04, 0.4, 0.3
MIN_DURATION, MAX_SHIFT, REPEAT_GAP, SKIP = 0.02, 0.35, 0.05, 0.25
BIN, INERTIA, ANCHOR, LEAST_ONSETS = 0.01, 5.0, 0.2, 8

_NOTE = "clip_id long, pitch long, onset double, duration double, hand string, parts long"


def merge_lane(rows: list[tuple[float, float, str, float | None, bool]]) -> list[tuple[float, float, str, int]]:
    """One note per strike of one key. Rows in onset order: (onset, end, hand, first seen or None, end was measured).

    Pieces of one strike overlap or touch, share an end, or are its tail; a new strike that begins far inside a sounding note
    trims it.
    """
    out: list[tuple[float, float, str, int]] = []
    current: list | None = None
    last_onset = 0.0
    for onset, end, hand, seen, measured in rows:
        if current is None:
            current, last_onset = [onset, end, hand, 1], onset
            continue
        fragment = end - onset < MIN_REPEAT or current[1] - current[0] < MIN_REPEAT
        close = fragment and onset - last_onset < MIN_REPEAT
        overlaps = onset < current[1]
        far = onset - current[0] > REACH
        one_end = abs(end - current[1]) <= SAME_END and (seen is None or seen >= current[0])
        tail = seen is not None and seen >= current[0] and onset - seen <= TAIL_LEAD and onset - current[1] <= TAIL_REACH and not measured
        last_onset = onset
        if overlaps and far and not (close or fragment or one_end or tail):
            out.append((current[0], onset, current[2], current[3]))
            current = [onset, end, hand, 1]
        elif close or overlaps or tail:
            current[1] = max(current[1], end)
            current[3] += 1
        else:
            out.append(tuple(current))
            current = [onset, end, hand, 1]
    if current is not None:
        out.append(tuple(current))
    return out


def merge_overlaps(notes: DataFrame) -> DataFrame:
    """notes: clip_id, pitch, onset, duration, hand and, if known, first_seen and end_measured."""
    extra = {c: F.lit(None).cast(t) for c, t in (("first_seen", "double"), ("end_measured", "boolean")) if c not in notes.columns}
    rows = notes.withColumns(extra).select("clip_id", "pitch", "onset", "duration", "hand", "first_seen", "end_measured")

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        out = []
        own = own.sort_values(["pitch", "onset", "duration"], kind="stable")
        for pitch, lane in own.groupby("pitch", sort=False):
            given = [
                (o, o + d, h, None if pd.isna(s) else s, bool(m) if m is not None and not pd.isna(m) else False)
                for o, d, h, s, m in lane[["onset", "duration", "hand", "first_seen", "end_measured"]].itertuples(index=False)
            ]
            out += [(own["clip_id"].iloc[0], pitch, a, b - a, h, n) for a, b, h, n in merge_lane(given)]
        return pd.DataFrame(out, columns=["clip_id", "pitch", "onset", "duration", "hand", "parts"])

    return rows.groupBy("clip_id").applyInPandas(solve, _NOTE)


def keep_repeats(notes: DataFrame, step: float) -> DataFrame:
    """Snapped notes of one pitch that fell on one grid point: the later one goes a step on if it was struck apart, else it goes.

    notes: clip_id, note_id, pitch, onset (as played), snapped. The moved onset of one decides on the next.
    """

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, lane in own.sort_values(["pitch", "snapped", "onset", "note_id"], kind="stable").groupby("pitch", sort=False):
            last_snap, last_played = None, None
            for row in lane.itertuples():
                at = row.snapped
                if last_snap is not None and at <= last_snap + 1e-9:
                    if row.onset - last_played < REPEAT_GAP:
                        continue
                    at = last_snap + step
                out.append((row.clip_id, row.note_id, row.pitch, at))
                last_snap, last_played = at, row.onset
        return pd.DataFrame(out, columns=["clip_id", "note_id", "pitch", "snapped"])

    return notes.groupBy("clip_id").applyInPandas(solve, "clip_id long, note_id long, pitch long, snapped double")


def beat_strength(onsets: np.ndarray, weights: np.ndarray, beat: float, phase: float) -> np.ndarray:
    """Accent per bin of BIN seconds from the first onset on, 1 at the strongest. A chain may begin only near the steady grid: in the
    first beat, bins further from it than ANCHOR of a beat are silent."""
    since = onsets - onsets.min()
    heard = np.bincount(np.rint(since / BIN).astype(int), weights=weights, minlength=int(since.max() / BIN) + 2)
    opening = np.arange(min(len(heard), int(np.ceil(beat / BIN))))
    place = (onsets.min() + opening * BIN - phase) / beat
    heard[opening[np.abs(place - np.rint(place)) > ANCHOR]] = 0
    top = heard.max()
    return heard / top if top > 0 else heard


def best_chain(strength: np.ndarray, period: float) -> np.ndarray:
    """Bins of the chain of beats of the greatest total strength less INERTIA * log(step / period) ** 2 for each step.

    Steps go from half the period to twice it. The shortest step bounds how far a bin's total depends on others: that many bins
    are settled at once, each from a window over the totals before it, all windows being rows of one strided view.
    """
    short, long = max(2, int(period * 0.5)), int(period * 2)
    if len(strength) < 4 or not strength.any() or long < short:
        return np.zeros(0, dtype=int)
    price = INERTIA * np.square(np.log(np.arange(long, short - 1, -1) / period))  # in the order of a window: longest step first
    total = np.concatenate([np.full(long, -np.inf), strength])  # padded, so that each window is whole
    before = np.full(len(strength), -1)
    for low in range(short, len(strength), short):
        high = min(low + short, len(strength))
        window = np.lib.stride_tricks.sliding_window_view(total[low : high + long - short], long - short + 1) - price
        step = short + window[:, ::-1].argmax(axis=1)  # of equal ones the shortest step
        gain = window[np.arange(high - low), long - step]
        grows = gain > 0
        total[long + low : long + high][grows] += gain[grows]
        before[low:high][grows] = (np.arange(low, high) - step)[grows]
    last = max(0, len(strength) - int(period * 2))
    chain = [last + int(total[long + last :].argmax())]
    while before[chain[-1]] >= 0:
        chain.append(int(before[chain[-1]]))
    return np.array(chain[::-1]) if len(chain) > 1 else np.zeros(0, dtype=int)


def beat_times(onsets: np.ndarray, weights: np.ndarray, beat: float, phase: float) -> np.ndarray:
    """Where each beat falls; none for fewer than LEAST_ONSETS notes."""
    if len(onsets) < LEAST_ONSETS or beat <= 0:
        return np.zeros(0)
    return onsets.min() + best_chain(beat_strength(onsets, weights, beat, phase), beat / BIN) * BIN


def track_beats(accented: DataFrame, beat: float, phases: DataFrame) -> DataFrame:
    """(clip_id, beat_no, time) from notes with accents and each clip's steady phase (clip_id, phase)."""

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        times = beat_times(own["onset"].to_numpy(), own["accent"].to_numpy(), beat, float(own["phase"].iloc[0]))
        return pd.DataFrame({"clip_id": own["clip_id"].iloc[0], "beat_no": np.arange(len(times)), "time": times})

    rows = accented.select("clip_id", "onset", "accent").join(phases.select("clip_id", "phase"), "clip_id")
    return rows.groupBy("clip_id").applyInPandas(solve, "clip_id long, beat_no long, time double")


def align(page: list[int], played: list[int]) -> tuple[float, list[tuple[int, int]]]:
    """Longest common subsequence with a penalty for each played note skipped inside; skips of the page, and of what is played
    before and after, are free."""
    n, m = len(page), len(played)
    score = np.zeros((n + 1, m + 1))
    step = np.zeros((n + 1, m + 1), dtype=np.int8)  # 0 start, 1 match, 2 skip page, 3 skip played
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            options = [(0.0, 0), (score[i - 1, j], 2), (score[i, j - 1] - SKIP, 3)]
            if page[i - 1] == played[j - 1]:
                options.append((score[i - 1, j - 1] + 1, 1))
            score[i, j], step[i, j] = max(options, key=lambda x: (x[0], -abs(x[1] - 1)))
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    total, pairs = float(score[i, j]), []
    while i and j and step[i, j]:
        if step[i, j] == 1:
            pairs.append((int(i - 1), int(j - 1)))
            i, j = i - 1, j - 1
        elif step[i, j] == 2:
            i -= 1
        else:
            j -= 1
    return total, pairs[::-1]


def ordered_alignment(page: DataFrame, played: DataFrame) -> DataFrame:
    """Pairs of a printed page's notes with what was played, in order, clip by clip. Both: clip_id, note_id, onset, pitch."""

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["onset", "pitch", "note_id"], kind="stable")
        left, right = (own[own["side"] == k].reset_index(drop=True) for k in (0, 1))
        total, pairs = align(left["pitch"].tolist(), right["pitch"].tolist())
        rows = [(own["clip_id"].iloc[0], left["note_id"][i], right["note_id"][j], total) for i, j in pairs]
        return pd.DataFrame(rows, columns=["clip_id", "page_id", "played_id", "score"])

    sided = lambda d, k: d.select("clip_id", "note_id", "onset", "pitch", F.lit(k).alias("side"))
    both = sided(page, 0).unionAll(sided(played, 1))
    return both.groupBy("clip_id").applyInPandas(solve, "clip_id long, page_id long, played_id long, score double")
