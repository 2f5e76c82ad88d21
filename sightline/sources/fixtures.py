"""Detections, filters, pixels and metric points derived from the test tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.vocab import CATEGORIES

#: (filter_id, name, categories, attribute bits, order)
FILTERS = (("f1", "two attrs", (0,), 129, 1), ("f2", "person+car", (0, 2), 0, 2), ("f3", "animals", (15, 16), 0, 3), ("f4", "car only", (2,), 0, 4), ("f5", "four attrs", (0,), 5249, 5), ("f6", "small things", (63, 67, 79), 0, 6), ("f7", "person+animal", (0, 15), 0, 7), ("f8", "car+thing", (2, 63, 67), 5, 8))
CATEGORY_OF = {"click": 0, "view": 2, "purchase": 15, "signup": 16}
#: Categories of the other events, by the rest of their id.
OTHERS = {0: 63, 1: 67, 2: 79}
OTHERS_OF = 5
SERIES_OF = {"click": "pipeline.fps", "view": "pipeline.duration", "purchase": "memory.track", "signup": "cache.objects"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(column: str, values: dict, other):
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections_of(table(spark, sf_dir, "events"))


def detections_of(events: DataFrame) -> DataFrame:
    """One row per detection; the device is the user, a frame is a device's day."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = events.withColumns({"k": k, "rest": F.col("event_id") % OTHERS_OF}).withColumn("ts", F.col("ts").cast("timestamp"))
    row = F.floor(F.col("k") / 10).cast("int")
    bits = F.pmod(F.col("event_id") * 2654435 + F.col("k") * 40503, F.lit(67108864))
    return e.select(
        F.col("event_id").alias("det_id"),
        F.col("user_id").alias("device_id"),
        "ts",
        F.date_trunc("day", "ts").alias("frame_ts"),
        F.when(F.col("event_type").isin(*CATEGORY_OF), _case("event_type", CATEGORY_OF, -1)).otherwise(_case("rest", OTHERS, -1)).alias("category_id"),
        F.when(F.col("value") >= 200, F.lit(1.0)).otherwise(F.col("value") / 200).alias("confidence"),
        (F.col("k") % 10 * 4).cast("double").alias("x1"),
        (row * 4).cast("double").alias("y1"),
        (F.col("k") % 10 * 4 + 40 + F.col("event_id") % 7).cast("double").alias("x2"),
        (row * 4 + 60 + F.col("event_id") % 11).cast("double").alias("y2"),
        F.when(F.col("event_type") == "click", bits).otherwise(F.lit(0)).cast("int").alias("attr_bits"),
    )


def filters(spark: SparkSession) -> DataFrame:
    rows = [(i, n, [c in on for c in range(len(CATEGORIES))], a, o) for i, n, on, a, o in FILTERS]
    kinds = {"filter_id": pa.string(), "name": pa.string(), "cat_mask": pa.list_(pa.bool_()), "attr_mask": pa.int32(), "ord": pa.int32()}
    return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds)))


def stored_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters as rows of a table: each part enables two categories and asks for some attributes."""
    p = table(spark, sf_dir, "part")
    slots = F.sequence(F.lit(0), F.lit(len(CATEGORIES) - 1))
    on = F.transform(slots, lambda i: (i == F.col("p_partkey") % 37) | (i == F.col("p_size") + 20))
    return p.select(F.col("p_partkey").cast("string").alias("filter_id"), F.col("p_name").alias("name"), on.alias("cat_mask"), (F.col("p_partkey") * 40503 % 67108864).cast("int").alias("attr_mask"), F.col("p_partkey").cast("int").alias("ord"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of 8 by 8 crops, one crop per order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("region_id"),
        (F.col("l_partkey") % 8).cast("int").alias("px_x"),
        (F.col("l_suppkey") % 8).cast("int").alias("px_y"),
        (F.col("l_quantity") * 5).cast("int").alias("r"),
        (F.col("l_partkey") * 37 % 256).cast("int").alias("g"),
        (F.col("l_suppkey") * 101 % 256).cast("int").alias("b"),
    )


def datapoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datapoints_of(table(spark, sf_dir, "events"))


def datapoints_of(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("seq"), _case("event_type", SERIES_OF, "cache.references").alias("series"), F.col("user_id").alias("device_id"), F.col("ts").cast("timestamp").alias("ts"), "value")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bus messages: topic, payload, ts."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("msg_id"), F.concat(F.lit("devices/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("topic"), F.col("props").alias("payload"), F.col("ts").cast("timestamp").alias("ts"))
