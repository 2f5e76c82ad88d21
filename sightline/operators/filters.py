"""Search filters applied to detections.

A filter is a row (filter_id, cat_mask, attr_mask, ord), cat_mask an array with a boolean for each category of the
vocabulary (as requests.lower makes it); a detection has category_id and attr_bits. Filters are exploded to their categories,
so that matching is an equi-join. Up to MOST_FILTERS filters (a few megabytes with their masks) are turned into rows of known
size, whatever they come from, so that Spark broadcasts them below its threshold and detections stay where they are; more of
them are joined as they are, by the sizes that Catalyst knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.attributes import all_present, in_mask, score
from sightline.operators import pixels
from sightline.session import small
from sightline.vocab import ATTRIBUTE_MATCH, CATEGORIES, PERSON, PERSON_REGIONS, REMATCH, UNKNOWN

MOST_FILTERS = 10_000


def bits_of(mask: Column, size: int) -> Column:
    """Numbers of the set bits of a mask."""
    return F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.call_function("getbit", mask, i) == 1)


def enabled(mask: Column) -> Column:
    """Numbers of the enabled slots of a mask array."""
    return F.filter(F.transform(mask, lambda on, i: F.when(on, i)), lambda i: i.isNotNull())


def merged_mask(filters: DataFrame) -> DataFrame:
    """One row: the categories that any filter enables, as a mask array."""
    ids = filters.select(F.explode(enabled(F.col("cat_mask"))).alias("i")).agg(F.collect_set("i").alias("ids"))
    return ids.select(F.transform(F.sequence(F.lit(0), F.lit(len(CATEGORIES) - 1)), lambda i: F.array_contains("ids", i)).alias("cat_mask"))


def by_category(filters: DataFrame) -> DataFrame:
    """A row per filter and category that it enables, without the mask."""
    others = [c for c in filters.columns if c != "cat_mask"]
    return small(filters, MOST_FILTERS).select(*others, F.explode(enabled(F.col("cat_mask"))).alias("category_id"))


def route_by_category(det: DataFrame, filters: DataFrame) -> DataFrame:
    """Detections whose category any filter enables; unknown ones never are."""
    return det.where(in_mask(F.col("category_id"), merged_mask(filters).scalar()))


def with_placeholders(det: DataFrame, filters: DataFrame, frame: list[str]) -> DataFrame:
    """Kept detections, and one of unknown category without confidence for each frame that lost all of its own."""
    kept = in_mask(F.col("category_id"), merged_mask(filters).scalar())
    marked = det.withColumn("kept", kept)
    empty = marked.groupBy(*frame).agg(F.bool_or("kept").alias("any")).where("not any").drop("any")
    return marked.where("kept").drop("kept").unionByName(_blank(empty), allowMissingColumns=True)


def _blank(frames: DataFrame) -> DataFrame:
    return frames.withColumns({"category_id": F.lit(UNKNOWN), "confidence": F.lit(0.0)})


def keep_frames(kept: DataFrame, det: DataFrame, frame: list[str]) -> DataFrame:
    """What a filter kept, and a detection of unknown category without confidence for each frame of det that it kept nothing of,
    so that the frame goes on."""
    lost = det.select(*frame).distinct().join(kept.select(*frame).distinct(), frame, "left_anti")
    return kept.unionByName(_blank(lost), allowMissingColumns=True)


def pairs(det: DataFrame, filters: DataFrame) -> DataFrame:
    """Detections with each filter that enables their category, and the attribute score (1 for other than persons)."""
    by = by_category(filters.select("filter_id", "cat_mask", "attr_mask", "ord"))
    rated = F.when(F.col("category_id") == PERSON, score(F.col("attr_bits"), F.col("attr_mask"))).otherwise(F.lit(1.0))
    return det.join(by, "category_id").withColumn("attr_score", rated)


def all_attributes(det: DataFrame, filters: DataFrame) -> DataFrame:
    return pairs(det, filters).where(all_present(F.col("attr_bits"), F.col("attr_mask")))


def any_attributes(det: DataFrame, filters: DataFrame) -> DataFrame:
    """Detections whose attributes are all that some filter of their category asks for; all of them where there is no filter."""
    none = filters.agg((F.count("*") == 0).alias("none")).scalar()
    hit = all_attributes(det.select("det_id", "category_id", "attr_bits"), filters).select("det_id").distinct().withColumn("hit", F.lit(True))
    return det.join(hit, "det_id", "left").where(F.col("hit").isNotNull() | none).drop("hit")


def match(det: DataFrame, filters: DataFrame, threshold: float = ATTRIBUTE_MATCH) -> DataFrame:
    """Pairs that match: a person needs attributes and enough of the required ones."""
    return pairs(det, filters).where((F.col("category_id") != PERSON) | ((F.col("attr_bits") != 0) & (F.col("attr_score") >= threshold)))


def matched_list(det: DataFrame, filters: DataFrame, threshold: float = ATTRIBUTE_MATCH) -> DataFrame:
    """det_id and matched_filters (ids in filter order) of detections that match any."""
    found = match(det.select("det_id", "category_id", "attr_bits"), filters, threshold)
    ordered = F.sort_array(F.collect_list(F.struct("ord", "filter_id")))
    return found.groupBy("det_id").agg(F.transform(ordered, lambda x: x["filter_id"]).alias("matched_filters"))


def rematch(det: DataFrame, filters: DataFrame, threshold: float = REMATCH) -> DataFrame:
    """For detections that carry no matched filters: category, and for persons half of the attributes."""
    return pairs(det, filters).where((F.col("category_id") != PERSON) | (F.col("attr_score") >= threshold))


def match_colors(matched: DataFrame, requirements: DataFrame, px: DataFrame, width: int, height: int, least: float = 20.0) -> DataFrame:
    """Of matched pairs those whose colours fit too: the filter asks for none in the detection's category, or the crop shows
    any of those it asks for. A detection without pixels never fits.

    requirements: filter_id, category_id, region, r, g, b; px: det_id, px_x, px_y, r, g, b."""
    asked = requirements.select("filter_id", "category_id", "region", F.col("r").alias("red"), F.col("g").alias("green"), F.col("b").alias("blue"))
    pictured = matched.join(px.select("det_id").distinct(), "det_id", "left_semi")
    free = pictured.join(asked, ["filter_id", "category_id"], "left_anti")
    wanted = pictured.select("det_id", "filter_id", "category_id").join(asked, ["filter_id", "category_id"])
    met = pixels.regions_met(px, wanted, width, height, least)
    shown = wanted.join(met, ["det_id", "region", "red", "green", "blue"], "left_semi").select("det_id", "filter_id")
    return free.unionByName(pictured.join(shown, ["det_id", "filter_id"], "left_semi"))


def match_attribute_colors(matched: DataFrame, requirements: DataFrame, px: DataFrame, width: int, height: int, least: float = 50.0) -> DataFrame:
    """Of matched pairs those whose crop shows every colour that the filter asks for by attribute (in the attribute's region);
    a filter that asks for none takes all. requirements: filter_id, attribute, r, g, b; px as for match_colors."""
    asked = requirements.select("filter_id", F.col("attribute").alias("region"), F.col("r").alias("red"), F.col("g").alias("green"), F.col("b").alias("blue")).distinct()
    wanted = matched.select("det_id", "filter_id").join(asked, "filter_id")
    met = pixels.regions_met(px, wanted, width, height, least, PERSON_REGIONS)
    missed = wanted.join(met, ["det_id", "region", "red", "green", "blue"], "left_anti").select("det_id", "filter_id").distinct()
    return matched.join(missed, ["det_id", "filter_id"], "left_anti")


def details(matched: DataFrame, filters: DataFrame) -> DataFrame:
    """A row per matched filter id with the filter's columns."""
    return matched.select("det_id", F.explode("matched_filters").alias("filter_id")).join(filters, "filter_id")


def color_requirements(filters: DataFrame, requirements: DataFrame) -> DataFrame:
    """Distinct (category_id, region, r, g, b) that filters enabling the category ask for; requirements has filter_id."""
    return by_category(filters).join(requirements, ["filter_id", "category_id"]).select("category_id", "region", "r", "g", "b").distinct()


def quality_score(category: Column, attr_score: Column, required: Column, matched: Column) -> Column:
    """How well a detection shows what its filter asks for."""
    return F.when(category == PERSON, attr_score).when(required == 0, F.lit(1.0)).otherwise(matched / required)
