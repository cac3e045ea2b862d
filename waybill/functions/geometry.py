"""Column functions on boxes of pages and images. JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamped_box(x0: Column, y0: Column, x1: Column, y1: Column, margin_x: float = 0.0, margin_y: float = 0.0) -> Column:
    """struct<x0, y0, x1, y1> in [0, 1], ordered, widened by margins of its own size; null if narrower than 0.005."""
    low_x, high_x, low_y, high_y = F.least(x0, x1), F.greatest(x0, x1), F.least(y0, y1), F.greatest(y0, y1)
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    a, b, c, d = unit(low_x), unit(high_x), unit(low_y), unit(high_y)
    w, h = b - a, d - c
    box = F.struct(unit(a - margin_x * w).alias("x0"), unit(c - margin_y * h).alias("y0"), unit(b + margin_x * w).alias("x1"), unit(d + margin_y * h).alias("y1"))
    return F.when((w >= 0.005) & (h >= 0.005), box)


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def overlap(a: Column, b: Column) -> Column:
    """Common area of two boxes over the smaller one's."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.coalesce(F.try_divide(F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h), F.least(area(a), area(b))), F.lit(0.0))


def centre_distance(a: Column, b: Column) -> Column:
    return F.hypot((a["x0"] + a["x1"] - b["x0"] - b["x1"]) / 2, (a["y0"] + a["y1"] - b["y0"] - b["y1"]) / 2)


def fit(width: Column, height: Column, box_width: Column, box_height: Column) -> Column:
    """struct<width, height, dx, dy>: a picture in a box, in proportion, centred; whole units, offsets rounded down."""
    scale = F.least(box_width / width, box_height / height)
    w, h = (width * scale).cast("long"), (height * scale).cast("long")
    return F.struct(w.alias("width"), h.alias("height"), F.floor((box_width - w) / 2).alias("dx"), F.floor((box_height - h) / 2).alias("dy"))


def is_heading(size: Column, bold: Column, median: Column) -> Column:
    return (size > median + 2) | (bold & (size >= median))


def is_centred(x0: Column, x1: Column, page_width: Column) -> Column:
    return (F.abs((x0 + x1) / 2 - page_width / 2) < 0.08 * page_width) & (x0 > 0.15 * page_width)


def region_kept(w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """Whether an ink region can be a logo: neither specks nor full frames nor lines (sizes in points)."""
    share = (w * h) / (page_w * page_h)
    return share.between(0.001, 0.5) & ~((w > 0.97 * page_w) & (h > 0.97 * page_h)) & (F.least(w, h) >= 15) & (F.greatest(w, h) <= 12 * F.least(w, h))


def letterhead(position: Column, first_table: Column, width: Column, height: Column, inline_first: Column, dx_in: Column, dy_in: Column) -> Column:
    """Whether a picture is a letterhead's logo: before the first table, wide, and first in line or near the top left."""
    near = (F.coalesce(dx_in, F.lit(9.0)) < 1.5) & (F.coalesce(dy_in, F.lit(9.0)) < 1.5)
    return (position <= F.coalesce(first_table, position)) & (((F.try_divide(width, height) >= 1.8) & (inline_first | near)) | (F.coalesce(dy_in, F.lit(0.0)) < 0))


def pixel_box(box: Column, width: Column, height: Column) -> Column:
    """struct<x0, y0, x1, y1>: a box of fractions in whole pixels, cut off."""
    return F.struct((box["x0"] * width).cast("int").alias("x0"), (box["y0"] * height).cast("int").alias("y0"), (box["x1"] * width).cast("int").alias("x1"), (box["y1"] * height).cast("int").alias("y1"))
