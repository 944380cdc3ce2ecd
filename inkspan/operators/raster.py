"""Drawing as tables: shapes in, pixels (x, y) out, clipped to a canvas, in closed form.

The pixel of a line at step i of n is the rounded point at i/n of the way, halves away from the start; so every
line is a sequence and no state runs along it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.tables import join_same
from inkspan.functions.text import base_name

_PIXELS = "array<struct<x:bigint,y:bigint>>"


def _pixel(x: Column, y: Column) -> Column:
    return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))


def point(x: Column, y: Column, size: Column) -> Column:
    """The square of 2 * size + 1 around a point."""
    side = F.sequence(-size.cast("long"), size.cast("long"))
    return F.flatten(F.transform(side, lambda i: F.transform(side, lambda j: _pixel(x + i, y + j))))


def line(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The pixels from one end to the other, both included; drawn from the end with the smaller x."""
    swap = x1 < x0
    ax, ay, bx, by = F.when(swap, x1).otherwise(x0), F.when(swap, y1).otherwise(y0), F.when(swap, x0).otherwise(x1), F.when(swap, y0).otherwise(y1)
    w, h, up = (bx - ax).cast("long"), F.abs(by - ay).cast("long"), F.signum((by - ay).cast("double")).cast("long")
    div = lambda a, b: F.call_function("div", a, b)
    flat = F.transform(F.sequence(F.lit(0).cast("long"), w), lambda i: _pixel(ax + i, ay + up * div(2 * i * h + w, 2 * F.greatest(w, F.lit(1)))))
    steep = F.transform(F.sequence(F.lit(0).cast("long"), h), lambda i: _pixel(ax + div(2 * i * w + h, 2 * F.greatest(h, F.lit(1))), ay + up * i))
    return F.when(w >= h, flat).otherwise(steep)


def polygon(*corners: tuple[Column, Column]) -> Column:
    """The closed outline through the corners; where sides meet or cross, a pixel comes more than once."""
    sides = [line(*a, *b) for a, b in zip(corners, [*corners[1:], corners[0]], strict=True)]
    return F.concat(*sides)


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The outline of w + 1 by h + 1 pixels."""
    return polygon((x, y), (x + w, y), (x + w, y + h), (x, y + h))


def drawn(shapes: DataFrame, keys: list[str], pixels: Column, width: Column | int, height: Column | int, weight: Column | None = None) -> DataFrame:
    """(keys, x, y) of the distinct pixels on the canvas; ``weight`` stamps each pixel as a point of that size."""
    if weight is not None:
        side = lambda: F.sequence(-weight.cast("long"), weight.cast("long"))
        pixels = F.flatten(F.transform(pixels, lambda p: F.flatten(F.transform(side(), lambda i: F.transform(side(), lambda j: _pixel(p["x"] + i, p["y"] + j))))))
    width, height = (v.cast("long") if isinstance(v, Column) else F.lit(v).cast("long") for v in (width, height))
    inside = F.filter(pixels.cast(_PIXELS), lambda p: (p["x"] >= 0) & (p["y"] >= 0) & (p["x"] < width) & (p["y"] < height))
    # numbers are told apart by a hash set, structs each by all others
    places = F.array_distinct(F.transform(inside, lambda p: p["y"] * width + p["x"]))
    rows = shapes.select(*keys, width.alias("_width"), F.explode(places).alias("_at"))
    return rows.select(*keys, (F.col("_at") % F.col("_width")).alias("x"), F.call_function("div", F.col("_at"), F.col("_width")).alias("y"))


def annotate(rectangles: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """(keys, x, y): the outlines of ``layout.rectangles`` on their pages, at weight 1."""
    box = F.col("box")
    return drawn(rectangles, keys, rect(box["x"], box["y"], box["w"], box["h"]), width, height, F.lit(1)).distinct()


def _png(picture: np.ndarray) -> bytes:
    """A PNG of an array of rows, columns and 3 or 4 channels (red, green, blue and, with 4, opacity)."""
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width, channels = picture.shape
    rows = np.zeros((height, 1 + width * channels), dtype=np.uint8)
    rows[:, 1:] = picture.reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def _bars(box: Column, weight: int) -> Column:
    """The four filled bars that make a rectangle's outline."""
    x0, x1 = F.least(box["x"], box["x"] + box["w"]), F.greatest(box["x"], box["x"] + box["w"])
    y0, y1 = F.least(box["y"], box["y"] + box["h"]), F.greatest(box["y"], box["y"] + box["h"])
    bar = lambda a, b, c, d: F.struct((a - weight).alias("x0"), (b - weight).alias("y0"), (c + weight).alias("x1"), (d + weight).alias("y1"))
    return F.array(bar(x0, y0, x1, y0), bar(x0, y1, x1, y1), bar(x0, y0, x0, y1), bar(x1, y0, x1, y1))


def annotated(pictures: DataFrame, rectangles: DataFrame, keys: list[str], colour: tuple[int, int, int] = (0, 0, 0), weight: int = 1) -> DataFrame:
    """(keys, png): pages' own pictures with the outlines of ``layout.rectangles`` (keys, box) drawn on them.

    ``pictures`` has keys and ``image`` as Spark's image source decodes it. An outline is four bars, cut off at the edges, which are
    laid over the picture's rows; all other pixels are the picture's. A page's bars are gathered, its pixels are not
    exploded. Pages without rectangles keep their picture; pictures that couldn't be decoded drop out.
    """
    bars = rectangles.select(*keys, F.explode(_bars(F.col("box"), weight)).alias("bar"))
    bars = bars.groupBy(*keys).agg(*[F.collect_list(F.col("bar")[c].cast("long")).alias(c) for c in ("x0", "y0", "x1", "y1")])
    rows = join_same(pictures.where("image.width > 0").select(*keys, "image"), bars, keys, "left")

    @F.udf("binary", useArrow=True)
    def draw(width, height, channels, data, x0, y0, x1, y1):
        page = np.frombuffer(data, np.uint8).reshape(height, width, channels)
        page = np.repeat(page, 3, axis=2) if channels == 1 else page[:, :, [2, 1, 0, 3][:channels]].copy()
        for a, b, c, d in zip(x0 or [], y0 or [], x1 or [], y1 or [], strict=True):
            page[max(b, 0) : max(d + 1, 0), max(a, 0) : max(c + 1, 0)] = [*colour, 255][: page.shape[2]]
        return _png(page)

    return rows.select(*keys, draw("image.width", "image.height", "image.nChannels", "image.data", "x0", "y0", "x1", "y1").alias("png"))


def annotated_name(picture: Column, algo: Column, blocks: bool, lines: bool, words: bool) -> Column:
    """The file name of an annotated picture: the picture's without its ending, the levels drawn, the algorithm."""
    levels = "".join(c for c, on in zip("blw", (blocks, lines, words), strict=True) if on)
    return F.concat_ws(".", F.regexp_replace(base_name(picture), r"\.[^.]*$", ""), F.lit(levels), F.lower(algo), F.lit("png"))


def png(pixels: DataFrame, keys: list[str], width: int, height: int, colour: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """(keys, png): each group's pixels on white as a PNG picture; a group is one page, bounded by its canvas."""
    def encode(at: list[int]) -> bytes:
        picture = np.full((height, width, 3), 255, dtype=np.uint8)
        picture.reshape(-1, 3)[np.asarray(at, dtype=np.int64)] = colour
        return _png(picture)

    make = F.udf(lambda at: encode(at), "binary", useArrow=True)
    gathered = pixels.groupBy(*keys).agg(F.collect_set(F.col("y") * width + F.col("x")).alias("at"))
    return gathered.select(*keys, make("at").alias("png"))
