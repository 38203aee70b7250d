"""Scalar functions on pitches, grids and circles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the twelve pitch classes, and of the keys on each.
PITCH_CLASSES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
MAJOR_KEYS = ["C", "Db", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B"]
MINOR_KEYS = ["C", "C#", "D", "Eb", "E", "F", "F#", "G", "G#", "A", "Bb", "B"]
# Semitones of the major and the natural minor scale, and of the naturals.
MAJOR_SCALE = [0, 2, 4, 5, 7, 9, 11]
MINOR_SCALE = [0, 2, 3, 5, 7, 8, 10]
# Krumhansl and Kessler's probe-tone profiles.
MAJOR_PROFILE = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR_PROFILE = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
# The piano's range, and the pitch classes of its black keys.
LOWEST, HIGHEST = 21, 108
BLACK = [1, 3, 6, 8, 10]


def pitch_name(pitch: Column) -> Column:
    """Name and octave; middle C (60) is C4."""
    name = F.element_at(F.array(*map(F.lit, PITCH_CLASSES)), F.pmod(pitch, F.lit(12)).cast("int") + 1)
    return F.concat(name, (F.floor(pitch / 12) - 1).cast("string"))


def is_black(pitch: Column) -> Column:
    return F.pmod(pitch, F.lit(12)).isin(BLACK)


def white_ordinal(pitch: Column) -> Column:
    """White keys below this pitch, counted from pitch 0; a black key counts those up to its left neighbour."""
    inside = F.lit(0)
    for pc in MAJOR_SCALE[1:]:
        inside = inside + (F.pmod(pitch, F.lit(12)) >= pc).cast("int")
    return F.floor(pitch / 12) * 7 + inside


def valid_note(pitch: Column, onset: Column, duration: Column) -> Column:
    return pitch.between(LOWEST, HIGHEST) & (onset >= 0) & (duration > 0)


def snapped(value: Column, step: Column, phase: Column, max_shift: float) -> Column:
    """The nearest grid point (halves to even), or null if it is more than max_shift steps away."""
    point = F.rint((value - phase) / step) * step + phase
    return F.when(F.abs(point - value) <= step * max_shift, point)


def floor_mod(value: Column, divisor: Column) -> Column:
    return value - F.floor(value / divisor) * divisor


def nearest_unit(value: Column, digits: int) -> Column:
    """The value in whole units of its last digit, halves away from zero, rounded as SQL engines round doubles: after the scaling, whose
    product decides what is a half. Spark's own round goes by the decimal digits that the double prints as."""
    return F.round(value * 10.0**digits, 0)
