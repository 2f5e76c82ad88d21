"""Pairs of detections in one frame, and suppression of overlapping ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.attributes import score
from sightline.functions.geometry import area, box, iou, union_box
from sightline.vocab import NMS_IOU, PERSON, WEIGHTS

BOX = ["x1", "y1", "x2", "y2"]


def _sides(det: DataFrame, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    return tuple(det.withColumnsRenamed({c: f"{p}_{c}" for c in carried}) for p in ("a", "b"))


def overlapping_pairs(det: DataFrame, frame: list[str], cell: float = 64.0, least: float = 0.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a_det_id < b_det_id) of a frame with IoU above least.

    Boxes are dealt to the cells of a grid that they touch, so that only near boxes meet; the pair is taken in the first
    cell that both touch."""
    at = lambda c: F.floor(F.col(c) / cell).cast("int")
    gridded = det.select(*frame, "det_id", *BOX, *carry, at("x1").alias("cx"), at("y1").alias("cy"))
    cells = F.explode(F.sequence("cx", at("x2"))).alias("gx")
    gridded = gridded.select("*", cells).select("*", F.explode(F.sequence("cy", at("y2"))).alias("gy"))
    a, b = _sides(gridded, ["det_id", *BOX, "cx", "cy", *carry])
    first = (F.col("gx") == F.greatest("a_cx", "b_cx")) & (F.col("gy") == F.greatest("a_cy", "b_cy"))
    met = a.join(b, [*frame, "gx", "gy"]).where((F.col("a_det_id") < F.col("b_det_id")) & first)
    return met.withColumn("iou", iou(box("a_"), box("b_"))).where(F.col("iou") > least).drop("gx", "gy", "a_cx", "a_cy", "b_cx", "b_cy")


def similarity(a: dict[str, Column], b: dict[str, Column], mask: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted mean of how tightly two detections pack, how alike in size they are, their categories (both wanted: 1)
    and the mean attribute score of the persons among them (0.5 without). a and b: box, area, category_id, attr_bits."""
    hull = area(union_box(a["box"], b["box"]))
    packed = F.when(hull > 0, F.least(F.lit(1.0), (a["area"] + b["area"]) / hull)).otherwise(F.lit(0.0))
    top = F.greatest(a["area"], b["area"])
    size = F.when(top > 0, F.least(a["area"], b["area"]) / top).otherwise(F.lit(0.0))
    person = lambda d: d["category_id"] == PERSON
    rated = lambda d: score(d["attr_bits"], mask)
    attr = F.when(person(a) & person(b), (rated(a) + rated(b)) / 2).when(person(a), rated(a)).when(person(b), rated(b)).otherwise(F.lit(0.5))
    total = packed * weights["proximity"] + size * weights["size"] + F.lit(weights["category"]) + attr * weights["attribute"]
    return total / sum(weights.values())


def similar_pairs(det: DataFrame, frame: list[str], mask: Column | None = None) -> DataFrame:
    """Similarity of all pairs of one frame that differ in category. A frame is one picture, whose detections the detector
    bounds; pairs of a frame are what the measure is defined on."""
    mask = F.lit(0) if mask is None else mask
    carried = ["det_id", *BOX, "category_id", "attr_bits"]
    a, b = _sides(det.select(*frame, *carried), carried)
    met = a.join(b, frame).where("a_det_id < b_det_id and a_category_id <> b_category_id")
    side = lambda p: {"box": box(p), "area": area(box(p)), "category_id": F.col(f"{p}category_id"), "attr_bits": F.col(f"{p}attr_bits")}
    return met.select(*frame, "a_det_id", "b_det_id", similarity(side("a_"), side("b_"), mask).alias("similarity"))


def best_pair(pairs: DataFrame, frame: list[str]) -> DataFrame:
    """The most similar pair of each frame; of equals the one of least ids."""
    first = F.struct("similarity", -F.col("a_det_id"), -F.col("b_det_id"))
    return pairs.groupBy(*frame).agg(F.max_by(F.struct("a_det_id", "b_det_id", "similarity"), first).alias("p")).select(*frame, "p.*")


def suppress(det: DataFrame, frame: list[str], threshold: float = NMS_IOU) -> DataFrame:
    """Greedy non-maximum suppression per frame: by confidence, a box goes if its IoU with a kept one is above threshold."""
    boxes = F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("rank"), "det_id", *BOX)))
    as_box = lambda s: tuple(s[c] for c in BOX)
    grouped = det.groupBy(*frame).agg(boxes.alias("all"))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda kept, s: F.when(F.exists(kept, lambda k: iou(as_box(k), as_box(s)) > threshold), kept).otherwise(F.concat(kept, F.array(s))))
    return grouped.select(*frame, F.explode(kept).alias("k")).select(*frame, "k.det_id", (-F.col("k.rank")).alias("confidence"))
