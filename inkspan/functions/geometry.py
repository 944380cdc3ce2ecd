"""Columns over intervals, rectangles and their text form "x,y,w,h" (extents, not corners)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDS = "struct<x:bigint,y:bigint,w:bigint,h:bigint>"
_FOUR = r"^[+-]?[0-9]+(,[+-]?[0-9]+){3}$"


def parse_bounds(text: Column, strict: bool = True) -> Column:
    """The rectangle of "x,y,w,h": four whole numbers of 64 bits. Else an error, or null if not strict."""
    parts = F.split(text, ",", 4)
    fields = [F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint") for i in range(4)]
    good = text.rlike(_FOUR)
    for f in fields:
        good = good & f.isNotNull()
    box = F.struct(*[f.alias(n) for f, n in zip(fields, "xywh", strict=True)])
    bad = F.raise_error(F.concat(F.lit("bounds are not four whole numbers: "), F.coalesce(text, F.lit("null")))).cast(BOUNDS) if strict else F.lit(None).cast(BOUNDS)
    return F.when(good, box).otherwise(bad)


def bounds_text(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.concat_ws(",", *[c.cast("string") for c in (x, y, w, h)])


def halfway(a: Column, b: Column) -> Column:
    """The whole number midway, nearer the lower one."""
    return F.least(a, b) + F.call_function("div", F.abs(a - b), F.lit(2))


def interval_meets(l0: Column, r0: Column, l1: Column, r1: Column) -> Column:
    """Whether two closed intervals share a point."""
    return (l0 <= r1) & (l1 <= r0)


def interval_overlap(l0: Column, r0: Column, l1: Column, r1: Column) -> Column:
    """The length that two intervals share."""
    return F.greatest(F.lit(0).cast("long"), F.least(r0, r1) - F.greatest(l0, l1))


def rect_meets(a: Column, b: Column) -> Column:
    """Whether two rectangles share a point; touching counts."""
    return interval_meets(a["x"], a["x"] + a["w"], b["x"], b["x"] + b["w"]) & interval_meets(a["y"], a["y"] + a["h"], b["y"], b["y"] + b["h"])


def overlap_area(a: Column, b: Column) -> Column:
    return interval_overlap(a["x"], a["x"] + a["w"], b["x"], b["x"] + b["w"]) * interval_overlap(a["y"], a["y"] + a["h"], b["y"], b["y"] + b["h"])


def box_contains(d0: Column, d1: Column, lo0: Column, lo1: Column, hi0: Column, hi1: Column) -> Column:
    """Whether a point is in a closed box."""
    return d0.between(lo0, hi0) & d1.between(lo1, hi1)


def box_meets(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two closed boxes (lo0, lo1, hi0, hi1) share a point."""
    return interval_meets(a[0], a[2], b[0], b[2]) & interval_meets(a[1], a[3], b[1], b[3])


def l1_distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.abs(a0 - b0) + F.abs(a1 - b1)


def scaled(fraction: Column, size: Column) -> Column:
    """A part of a page in pixels: half a pixel goes up."""
    return (fraction * size.cast("double") + F.lit(0.5)).cast("long")


def corners_text(xs: Column, ys: Column) -> Column:
    """"x,y,w,h" around points given as arrays of coordinates."""
    x, y = F.array_min(xs), F.array_min(ys)
    return bounds_text(x, y, F.array_max(xs) - x, F.array_max(ys) - y)


def separator(a: Column, b: Column) -> Column:
    """The level line between two rectangles: midway in height, as wide as both."""
    mid = halfway(a["y"] + a["h"], b["y"])
    left, right = F.least(a["x"], b["x"]), F.greatest(a["x"] + a["w"], b["x"] + b["w"])
    return F.struct(left.alias("x0"), mid.alias("y0"), right.alias("x1"), mid.alias("y1"))


def font_size(text: Column, width: Column) -> Column:
    """The smallest whole size at which monospaced text (0.6 em a byte) is at least that wide; empty text: 0."""
    n = F.octet_length(text)
    # 10 * width / (6 * n), rounded up, in whole numbers
    return F.when(n == 0, F.lit(0)).otherwise(F.call_function("div", 10 * width + 6 * n - 1, 6 * n)).cast("long")
