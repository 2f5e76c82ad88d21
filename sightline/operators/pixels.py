"""Colours of regions given as pixel rows (region_id, px_x, px_y, r, g, b)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import colors
from sightline.vocab import IMAGE_REGIONS


def _rgb() -> tuple[Column, Column, Column]:
    return F.col("r"), F.col("g"), F.col("b")


def _share(hit: Column) -> Column:
    return F.avg(hit.cast("double")) * 100


def with_hsv(px: DataFrame) -> DataFrame:
    h, s, v = colors.hsv(*_rgb())
    return px.withColumns({"h": h, "s": s, "v": v})


def class_counts(px: DataFrame) -> DataFrame:
    """Pixels of each colour class per region; the classes overlap."""
    hsv = with_hsv(px)
    each = colors.classes(F.col("h"), F.col("s"), F.col("v"))
    return hsv.groupBy("region_id").agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in each.items()))


def dominant(px: DataFrame, least: float = 5.0) -> DataFrame:
    """The most frequent class of each region (the first listed of equals); null below a share in percent."""
    counts = class_counts(px)
    names = [c for c in counts.columns if c not in ("region_id", "n")]
    top = F.greatest(*names)
    first = F.coalesce(*(F.when(F.col(c) == top, F.lit(c)) for c in names))
    return counts.select("region_id", F.when(top * 100.0 / F.col("n") >= least, first).alias("color"), (top * 100.0 / F.col("n")).alias("pct"))


def target_match(px: DataFrame, target: tuple[int, int, int], width: int, height: int, least: float = 20.0) -> DataFrame:
    """Share of a crop's pixels inside its ellipse that are like a target, and whether that is enough."""
    inside = colors.in_ellipse(F.col("px_x"), F.col("px_y"), F.lit(float(width)), F.lit(float(height)))
    hit = colors.matches_rgb(*_rgb(), target)
    return px.where(inside).groupBy("region_id").agg(_share(hit).alias("pct")).withColumn("matched", F.col("pct") >= least)


def hsv_match(px: DataFrame, target: tuple[float, float, float], least: float = 20.0) -> DataFrame:
    hit = colors.matches_hsv(F.col("h"), F.col("s"), F.col("v"), target)
    return with_hsv(px).groupBy("region_id").agg(_share(hit).alias("pct")).withColumn("matched", F.col("pct") >= least)


def named_match(px: DataFrame, name: str, width: int, height: int, least: float = 20.0, margin: float = 0.1) -> DataFrame:
    inside = colors.in_ellipse(F.col("px_x"), F.col("px_y"), F.lit(float(width)), F.lit(float(height)), margin)
    hit = colors.in_range(F.col("h"), F.col("s"), F.col("v"), name)
    return with_hsv(px.where(inside)).groupBy("region_id").agg(_share(hit).alias("pct")).withColumn("matched", F.col("pct") >= least)


def meets_any(px: DataFrame, targets: list[tuple[int, int, int]], width: int, height: int, least: float = 20.0) -> DataFrame:
    """Whether a region is like any of the targets; every region is read once for all of them."""
    inside = colors.in_ellipse(F.col("px_x"), F.col("px_y"), F.lit(float(width)), F.lit(float(height)))
    shares = [_share(colors.matches_rgb(*_rgb(), t)) for t in targets]
    return px.where(inside).groupBy("region_id").agg((F.greatest(*shares) if len(shares) > 1 else shares[0]).alias("pct")).withColumn("met", F.col("pct") >= least)


def regions_met(px: DataFrame, asked: DataFrame, width: int, height: int, least: float = 20.0, regions: dict[str, tuple[float, float]] = IMAGE_REGIONS) -> DataFrame:
    """Of asked rows (det_id, region, red, green, blue) those that the detection's crop shows: enough of the pixels inside the
    ellipse of the region's part of the crop are like the colour. px has det_id in place of region_id; unknown regions and
    detections without pixels give nothing."""
    part = lambda k: F.coalesce(*(F.when(F.col("region") == name, F.lit(ends[k])) for name, ends in regions.items())) * height
    want = asked.select("det_id", "region", "red", "green", "blue", part(0).alias("top"), part(1).alias("bottom")).where("top is not null").distinct()
    inside = (F.col("px_y") >= F.col("top")) & (F.col("px_y") < F.col("bottom")) & colors.in_ellipse(F.col("px_x"), F.col("px_y") - F.col("top"), F.lit(float(width)), F.col("bottom") - F.col("top"))
    hit = colors.like_rgb(_rgb(), (F.col("red"), F.col("green"), F.col("blue")))
    shown = px.join(want, "det_id").where(inside).groupBy("det_id", "region", "red", "green", "blue").agg(_share(hit).alias("pct"))
    return shown.where(F.col("pct") >= least).drop("pct")
