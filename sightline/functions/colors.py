"""Colour arithmetic on pixel rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.vocab import HUES


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue (0 to 360), saturation and value (0 to 100) of 8-bit channels."""
    r, g, b = (c.cast("double") / 255 for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    turn = F.when(span == 0, F.lit(0.0)).when(top == r, (g - b) / span).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
    hue = turn * 60
    hue = F.when(hue < 0, hue + 360).otherwise(hue)
    return hue, F.when(top == 0, F.lit(0.0)).otherwise(span / top * 100), top * 100


def in_hue(h: Column, name: str) -> Column:
    out = F.lit(False)
    for begin, end in HUES[name]:
        out = out | ((h >= begin) & (h < end))
    return out


def name_of(h: Column, s: Column, v: Column) -> Column:
    """One name for a colour; null for none."""
    out = F.when((s < 25) & (v > 65), "white").when((s < 25) & (v < 30), "black").when(s < 25, "gray")
    for n in HUES:
        out = out.when(in_hue(h, n), n)
    return out


def classes(h: Column, s: Column, v: Column) -> dict[str, Column]:
    """Overlapping colour classes, as used for counting."""
    out = {"white": (s < 35) & (v > 55), "black": (s < 30) & (v < 30), "gray": (s < 30) & (v >= 30) & (v <= 60)}
    return out | {n: (s >= 25) & in_hue(h, n) for n in HUES}


#: Hues in degrees up to which a colour has this name; red begins again at 345.
SIMPLE_HUES = ((15, "red"), (45, "orange"), (75, "yellow"), (155, "green"), (200, "cyan"), (260, "blue"), (300, "purple"), (345, "pink"), (361, "red"))


def simple_name(h: Column, s: Column, v: Column) -> Column:
    """A name by hue alone, or for pale colours by brightness (s and v in percent)."""
    gray = F.when(v > 80, "white").when(v < 30, "black").otherwise("gray")
    hue = F.coalesce(*(F.when(h < end, F.lit(name)) for end, name in SIMPLE_HUES))
    return F.when(s < 20, gray).otherwise(hue)


def in_range(h: Column, s: Column, v: Column, name: str, least: float = 50) -> Column:
    """Whether a colour lies in a named range."""
    if name in ("white", "black", "gray"):
        return {"white": (s < 20) & (v > 80), "black": v < 30, "gray": (s < 20) & (v >= 30) & (v <= 80)}[name]
    return (s >= least) & (v >= least) & in_hue(h, name)


def matches_rgb(r: Column, g: Column, b: Column, target: tuple[int, int, int], tolerance: float = 100, spread: int = 40) -> Column:
    """Whether a pixel is like a target: for grey targets by spread and brightness, else by distance."""
    if max(target) - min(target) < 30:
        bright, want = (r + g + b) / 3, sum(target) / 3
        near = (bright >= 100) if want > 200 else (F.abs(bright - want) <= tolerance)
        return (F.greatest(r, g, b) - F.least(r, g, b) <= spread) & near
    return F.sqrt(sum(F.pow(c - t, F.lit(2)) for c, t in zip((r, g, b), target, strict=True))) <= tolerance


def like_rgb(pixel: tuple[Column, ...], target: tuple[Column, ...], tolerance: float = 100, spread: int = 40) -> Column:
    """matches_rgb for targets that are columns."""
    bright, want = (sum(c[1:], c[0]) / 3 for c in (pixel, target))
    near = F.when(want > 200, bright >= 100).otherwise(F.abs(bright - want) <= tolerance)
    gray = (F.greatest(*pixel) - F.least(*pixel) <= spread) & near
    far = F.sqrt(sum((F.pow(c - t, F.lit(2)) for c, t in zip(pixel[1:], target[1:], strict=True)), F.pow(pixel[0] - target[0], F.lit(2))))
    return F.when(F.greatest(*target) - F.least(*target) < 30, gray).otherwise(far <= tolerance)


def matches_hsv(h: Column, s: Column, v: Column, target: tuple[float, float, float], hue: float = 20, sat: float = 50, val: float = 50) -> Column:
    """Whether a colour is within tolerances of a target; hue wraps and does not count for grey targets."""
    near = (F.abs(s - target[1]) <= sat) & (F.abs(v - target[2]) <= val)
    if target[1] < 10:
        return near
    d = F.abs(h - target[0])
    return near & (F.least(d, F.lit(360) - d) <= hue)


def in_ellipse(x: Column, y: Column, w: Column, h: Column, margin: float = 0.05) -> Column:
    """Whether a pixel lies in the ellipse inscribed in a w by h crop."""
    part = lambda p, n: F.pow((p - n / 2) / (n / 2 * (1 - margin)), F.lit(2))
    return part(x, w) + part(y, h) <= 1


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(c.cast("long")), 2, "0")) for c in (r, g, b)))


def from_hex(c: Column) -> tuple[Column, Column, Column]:
    return tuple(F.conv(F.substring(c, i, 2), 16, 10).cast("int") for i in (2, 4, 6))
