"""Boxes (x1, y1, x2, y2) as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def union_box(a: Box, b: Box) -> Box:
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for boxes apart or without area."""
    w, h = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    inner = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    whole = area(a) + area(b) - inner
    return F.when(whole > 0, inner / whole).otherwise(F.lit(0.0))


def region(b: Box, begin: Column, end: Column) -> Box:
    """The horizontal slice of a box between two fractions of its height."""
    h = b[3] - b[1]
    return b[0], b[1] + h * begin, b[2], b[1] + h * end


def padded(b: Box, pad_x: float, pad_y: float, width: int, height: int) -> Box:
    """Box with padding in shares of its size, cut to whole pixels inside an image."""
    w, h = b[2] - b[0], b[3] - b[1]
    zero = F.lit(0)
    return (
        F.greatest(zero, (b[0] - w * pad_x).cast("int")),
        F.greatest(zero, (b[1] - h * pad_y).cast("int")),
        F.least(F.lit(width), (b[2] + w * pad_x).cast("int")),
        F.least(F.lit(height), (b[3] + h * pad_y).cast("int")),
    )


def to_xywh(b: Box) -> Box:
    return b[0], b[1], b[2] - b[0], b[3] - b[1]


def from_xywh(b: Box) -> Box:
    return b[0], b[1], b[0] + b[2], b[1] + b[3]


def letterbox(width: Column, height: Column, target: int) -> tuple[Column, Column, Column, Column]:
    """New width and height, and the offsets that centre them in a square."""
    scale = F.least(F.lit(float(target)) / width, F.lit(float(target)) / height)
    w, h = (width * scale).cast("int"), (height * scale).cast("int")
    return w, h, ((F.lit(target) - w) / 2).cast("int"), ((F.lit(target) - h) / 2).cast("int")


def fill_crop(width: Column, height: Column, to_w: int, to_h: int) -> tuple[Column, Column, Column, Column]:
    """Size after scaling to cover a frame, and the crop offsets that centre it."""
    scale = F.greatest(F.lit(float(to_w)) / width, F.lit(float(to_h)) / height)
    w, h = (width * scale).cast("int"), (height * scale).cast("int")
    return w, h, F.greatest(F.lit(0), ((w - to_w) / 2).cast("int")), F.greatest(F.lit(0), ((h - to_h) / 2).cast("int"))


def from_center(cx: Column, cy: Column, w: Column, h: Column, scale: Column, dx: Column, dy: Column, width: int, height: int) -> Box:
    """Detector output (centre and size in a letterboxed square) as a box clipped to the image."""
    clip = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(top)))
    return clip((cx - w / 2 - dx) / scale, width), clip((cy - h / 2 - dy) / scale, height), clip((cx + w / 2 - dx) / scale, width), clip((cy + h / 2 - dy) / scale, height)
