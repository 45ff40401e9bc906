"""Colour arithmetic on integer channel columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def gray(b: Column, g: Column, r: Column) -> Column:
    return half_up(0.299 * r + 0.587 * g + 0.114 * b)


def value(b: Column, g: Column, r: Column) -> Column:
    return F.greatest(b, g, r)


def saturation(b: Column, g: Column, r: Column) -> Column:
    top = F.greatest(b, g, r)
    return F.when(top == 0, 0).otherwise(half_up(255.0 * (top - F.least(b, g, r)) / F.when(top != 0, top)))


def hue(b: Column, g: Column, r: Column) -> Column:
    """0 to 179: half degrees."""
    top, span = F.greatest(b, g, r), F.greatest(b, g, r) - F.least(b, g, r)
    some = F.when(span != 0, span)
    deg = F.when(top == r, 60.0 * (g - b) / some).when(top == g, 120.0 + 60.0 * (b - r) / some).otherwise(240.0 + 60.0 * (r - g) / some)
    deg = F.when(deg < 0, deg + 360.0).otherwise(deg)
    return F.when(span == 0, 0).otherwise(half_up(deg / 2) % 180)


def is_water(h: Column, s: Column, v: Column) -> Column:
    return h.between(90, 135) & (s >= 60) & (v >= 60)


def is_out_of_bounds(h: Column, s: Column, v: Column) -> Column:
    return h.between(135, 170) & (s >= 40) & (v >= 40)


def is_ink(h: Column, s: Column, v: Column) -> Column:
    """Course overprint."""
    return ((h <= 15) | (h >= 150)) & (s > 70) & (v > 40) & (v < 235)


def is_light(s: Column, v: Column) -> Column:
    return (s < 60) & (v > 150)


def is_dark(gray_: Column) -> Column:
    return gray_ < 90


def gained(channel: Column, gain: Column) -> Column:
    return F.least(F.greatest(half_up(channel * gain), F.lit(0)), F.lit(255))


def vegetation(h: Column, s: Column, v: Column) -> Column:
    """Class of a colour cluster's centre."""
    green = F.when((v < 150) | (s > 140), "thicket").otherwise("forest")
    return F.when(h.between(12, 34) & (v >= 120), "clearing").when((h > 34) & (h <= 95), green).otherwise("forest")


def heat_index(cost: Column, cap: float = 6.0) -> Column:
    return (F.least(F.greatest(cost, F.lit(0.0)), F.lit(cap)) / cap * 255).cast("int")


def blended(fill: Column, image: Column, alpha: float = 0.4) -> Column:
    return half_up(alpha * fill + (1 - alpha) * image)
