"""Boxes, crops and signatures on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (structs x1, y1, x2, y2); 0 where they don't meet."""
    area = lambda r: F.greatest(F.lit(0.0), r["x2"] - r["x1"]) * F.greatest(F.lit(0.0), r["y2"] - r["y1"])
    both = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])) * F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return F.when(both > 0, both / (area(a) + area(b) - both)).otherwise(0.0)


def breaches(b: Column, safe: Column, width: float, height: float) -> Column:
    """Names of the sides where a box leaves the safe zone, then `canvas` if it leaves that."""
    canvas = (b["x1"] < 0) | (b["y1"] < 0) | (b["x2"] > width) | (b["y2"] > height)
    return F.array_compact(F.array(F.when(b["x1"] < safe["x1"], "left"), F.when(b["y1"] < safe["y1"], "top"), F.when(b["x2"] > safe["x2"], "right"), F.when(b["y2"] > safe["y2"], "bottom"), F.when(canvas, "canvas")))


def crop_to_aspect(width: Column, height: Column, ratio: float) -> Column:
    """Struct (w, h): the largest crop with the ratio, sides even."""
    even = lambda c: (F.floor(c / 2) * 2).cast("long")
    wide = width / height > ratio
    return F.struct(even(F.when(wide, height * ratio).otherwise(width)).alias("w"), even(F.when(wide, height).otherwise(width / ratio)).alias("h"))


def crop_origin(focus: Column, size: Column, crop: Column) -> Column:
    """Where a crop around a focus begins, kept inside."""
    return F.greatest(F.lit(0), F.least(F.bround(focus - crop / 2), size - crop)).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit signatures; 64 if one is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(64))


def sign_bits(vector: Column) -> Column:
    """64-bit signature of the first 64 components: bit k is set where component k is positive."""
    bit = lambda acc, x: struct_next(acc, x)
    struct_next = lambda acc, x: F.struct((acc["bits"] + F.when(x > 0, acc["unit"]).otherwise(F.lit(0).cast("long"))).alias("bits"), F.shiftleft(acc["unit"], 1).alias("unit"))
    start = F.struct(F.lit(0).cast("long").alias("bits"), F.lit(1).cast("long").alias("unit"))
    return F.aggregate(F.slice(vector, 1, 63), start, bit)["bits"]


def parse_aspect(text: Column) -> Column:
    """Width over height of `9:16`, `9x16` or a number."""
    parts = F.split(text, "[:xX/]")
    return F.when(F.size(parts) == 2, parts[0].try_cast("double") / F.nullif(parts[1].try_cast("double"), F.lit(0.0))).otherwise(text.try_cast("double"))


# A frame for its hash has 9 x 8 pixels; shares of red, green and blue in 256 parts of grey.
FRAME_WIDTH, FRAME_HEIGHT = 9, 8
GREY = (77, 150, 29)


def reduced_frame(pixels: Column, width: Column, height: Column) -> Column:
    """A picture (an array of width x height x 3 colour values, row by row) as one of FRAME_WIDTH x FRAME_HEIGHT: each pixel the mean of its area, rounded down; null for pictures that are smaller or whose array is too short."""
    edge = lambda k, of, n: F.floor(k * of / n).cast("int")

    def mean(i: Column) -> Column:
        pixel, colour = F.floor(i / 3).cast("int"), i % 3
        x, y = pixel % FRAME_WIDTH, F.floor(pixel / FRAME_WIDTH).cast("int")
        left, right, top, bottom = edge(x, width, FRAME_WIDTH), edge(x + 1, width, FRAME_WIDTH), edge(y, height, FRAME_HEIGHT), edge(y + 1, height, FRAME_HEIGHT)
        row = lambda r: F.aggregate(F.sequence(left, right - 1), F.lit(0).cast("long"), lambda acc, c: acc + F.get(pixels, (r * width + c) * 3 + colour))
        total = F.aggregate(F.sequence(top, bottom - 1), F.lit(0).cast("long"), lambda acc, r: acc + row(r))
        return F.floor(total / ((right - left) * (bottom - top))).cast("int")

    fits = (width >= FRAME_WIDTH) & (height >= FRAME_HEIGHT) & (F.size(pixels) >= width * height * 3)
    return F.when(fits, F.transform(F.sequence(F.lit(0), F.lit(FRAME_WIDTH * FRAME_HEIGHT * 3 - 1)), mean))


def frame_signature(pixels: Column) -> Column:
    """(dhash, mean_rgb) of a frame of FRAME_WIDTH x FRAME_HEIGHT (an array of colour values, row by row): 64 bits that say where grey falls from a pixel to the next, in hexadecimal digits, and the mean colours to 3 places; null for shorter arrays."""
    n = FRAME_WIDTH * FRAME_HEIGHT
    red, green, blue = (_every_third(F.slice(pixels, 1, n * 3), k) for k in range(3))
    grey = F.transform(F.zip_with(F.zip_with(red, green, lambda r, g: GREY[0] * r + GREY[1] * g), blue, lambda x, b: x + GREY[2] * b), lambda x: F.floor(x / 256))
    falls = F.zip_with(grey, F.slice(grey, 2, n - 1), lambda here, after: (here > after).cast("long"))
    inside = F.filter(F.slice(falls, 1, n - 1), lambda _, i: i % FRAME_WIDTH < FRAME_WIDTH - 1)  # not from the end of a row to the next
    bits = F.aggregate(inside, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))
    mean = lambda c: F.round(F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x) / n, 3)
    return F.when(F.size(pixels) >= n * 3, F.struct(F.lower(F.lpad(F.hex(bits), 16, "0")).alias("dhash"), F.array(mean(red), mean(green), mean(blue)).alias("mean_rgb")))


def _every_third(values: Column, k: int) -> Column:
    return F.filter(values, lambda _, i: i % 3 == k)
