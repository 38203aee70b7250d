"""Colours as column expressions: 8-bit BGR to 8-bit CIE Lab, hue and distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# sRGB's transfer curve and matrix to XYZ, and the white point D65 (IEC 61966-2-1); CIE's cube root limit.
MATRIX = [[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]
WHITE = [0.950456, 1.0, 1.088754]
LIMIT = 0.008856
#: Below this chroma a colour is neutral and has no hue.
MIN_CHROMA = 12.0


def lab(b: Column, g: Column, r: Column) -> Column:
    """struct(L, a, b) on 8-bit scales: L times 2.55, a and b with 128 added."""
    linear = lambda c: F.when(c / 255 <= 0.04045, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4)))
    rgb = [linear(c) for c in (r, g, b)]
    xyz = [(rgb[0] * m[0] + rgb[1] * m[1] + rgb[2] * m[2]) / w for m, w in zip(MATRIX, WHITE, strict=True)]
    root = lambda t: F.when(t > LIMIT, F.pow(t, F.lit(1 / 3))).otherwise(t * 7.787 + 16 / 116)
    x, y, z = map(root, xyz)
    light = F.when(xyz[1] > LIMIT, y * 116 - 16).otherwise(xyz[1] * 903.3)
    return F.struct((light * 2.55).alias("L"), ((x - y) * 500 + 128).alias("a"), ((y - z) * 200 + 128).alias("b"))


def chroma(c: Column) -> Column:
    return F.sqrt((c["a"] - 128) * (c["a"] - 128) + (c["b"] - 128) * (c["b"] - 128))


def same_hue(one: Column, two: Column, degrees: float) -> Column:
    """Whether two Lab colours have the same hue, whatever their lightness; neutral ones never do."""
    hue = lambda c: F.degrees(F.atan2(c["b"] - 128, c["a"] - 128))
    apart = F.abs(F.pmod(hue(one) - hue(two) + 180, F.lit(360.0)) - 180)
    return (chroma(one) >= MIN_CHROMA) & (chroma(two) >= MIN_CHROMA) & (apart < degrees)


def distance(one: Column, two: Column, weight: float) -> Column:
    """Distance in Lab with lightness weighted."""
    return F.sqrt(F.pow((one["L"] - two["L"]) * weight, F.lit(2)) + F.pow(one["a"] - two["a"], F.lit(2)) + F.pow(one["b"] - two["b"], F.lit(2)))


def farther_from(one: Column, two: Column, background: Column, weight: float, tie: float) -> Column:
    """Whether one is farther from the background than two; a near tie goes by lightness alone."""
    mine, theirs = distance(one, background, weight), distance(two, background, weight)
    by_light = F.abs(one["L"] - background["L"]) > F.abs(two["L"] - background["L"])
    return F.when(F.abs(mine - theirs) > F.greatest(mine, theirs) * tie, mine > theirs).otherwise(by_light)
