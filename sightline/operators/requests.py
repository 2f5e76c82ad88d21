"""Parsed natural-language requests (JSON) lowered to filter rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.vocab import ATTRIBUTES, CATEGORIES

RESPONSE = (
    "search_terms array<struct<search_term string, objects array<struct<category string, attributes array<string>,"
    " negative_attributes array<string>, colors map<string,array<int>>>>>>,"
    " strategy struct<completeness_score double, requires_vlm boolean, vlm_reasoning string>"
)


def _mask(names: Column, vocabulary: tuple[str, ...]) -> Column:
    """A boolean for every name of the vocabulary."""
    return F.transform(F.array(*map(F.lit, vocabulary)), lambda n: F.coalesce(F.array_contains(names, n), F.lit(False)))


def lower(df: DataFrame, response: str = "response") -> DataFrame:
    """Add category_mask, attribute_mask, color_requirements (category id -> region -> colours), category_colors,
    vlm_required and vlm_reasoning.

    Of several search terms the first counts; names outside the vocabularies are passed over; attributes count for
    persons alone; negative attributes are not used; of objects of one category the last with colours gives the regions.
    A response that is not JSON gives empty masks."""
    parsed = F.from_json(response, RESPONSE)
    none = F.array().cast("array<struct<category:string,attributes:array<string>,negative_attributes:array<string>,colors:map<string,array<int>>>>")
    objects = F.coalesce(F.get(parsed["search_terms"], F.lit(0))["objects"], none)
    with_objects = df.withColumns({"objects": objects, "strategy": parsed["strategy"]})
    names = F.transform("objects", lambda o: o["category"])
    persons = F.filter("objects", lambda o: o["category"] == "person")
    attributes = F.flatten(F.transform(persons, lambda o: F.coalesce(o["attributes"], F.array().cast("array<string>"))))
    at = lambda o: F.array_position(F.array(*map(F.lit, CATEGORIES)), o["category"]).cast("int") - 1
    colored = F.filter("objects", lambda o: (F.coalesce(F.cardinality(o["colors"]), F.lit(0)) > 0) & (at(o) >= 0))
    last = F.filter(colored, lambda o, i: ~F.exists(F.slice(colored, i + 2, F.greatest(F.size(colored), F.lit(1))), lambda p: p["category"] == o["category"]))
    regions = F.map_from_entries(F.transform(last, lambda o: F.struct(at(o), F.transform_values(o["colors"], lambda _, c: F.array(c)))))
    plain = F.filter(last, lambda o: o["attributes"].isNull())
    return with_objects.withColumns(
        {
            "category_mask": _mask(names, CATEGORIES),
            "attribute_mask": _mask(attributes, ATTRIBUTES),
            "color_requirements": regions,
            "category_colors": F.map_from_entries(F.transform(plain, lambda o: F.struct(at(o), F.get(F.map_values(o["colors"]), F.lit(0))))),
            "vlm_required": F.coalesce(F.col("strategy.requires_vlm"), F.lit(False)),
            "vlm_reasoning": F.coalesce(F.col("strategy.vlm_reasoning"), F.lit("")),
        }
    ).drop("objects", "strategy")


def mask_names(mask: Column, vocabulary: tuple[str, ...]) -> Column:
    """Names of the enabled slots (none for a null mask). The mask stands outside of any lambda, so it is made once a row."""
    slots = F.coalesce(mask, F.array().cast("array<boolean>"))
    return F.array_compact(F.zip_with(slots, F.array(*map(F.lit, vocabulary)), lambda on, name: F.when(on, name)))
