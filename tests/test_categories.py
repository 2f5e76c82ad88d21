"""Every category of the vocabulary can be routed, matched and clustered."""

from pyspark.sql import functions as F

from sightline.functions.attributes import in_mask
from sightline.operators import clusters, filters
from sightline.vocab import CATEGORIES


def _filters(spark):
    mask = lambda *on: [i in on for i in range(len(CATEGORIES))]
    rows = [("phone", mask(67), 0, 1), ("desk", mask(63, 79), 0, 2)]
    return spark.createDataFrame(rows, "filter_id string, cat_mask array<boolean>, attr_mask int, ord int")


def _detections(spark):
    rows = [(i, 1, c, 0, 0.0, 0.0, 10.0, 10.0, 0.5) for i, c in enumerate((67, 63, 79, 62, 80, -1))]
    det = spark.createDataFrame(rows, "det_id long, device_id long, category_id int, attr_bits int, x1 double, y1 double, x2 double, y2 double, confidence double")
    return det.withColumn("frame_ts", F.timestamp_seconds(F.lit(0)))


def test_categories_beyond_62(spark):
    det, flt = _detections(spark), _filters(spark)
    assert sorted(r.category_id for r in filters.route_by_category(det, flt).collect()) == [63, 67, 79]
    kept = filters.with_placeholders(det, flt, ["device_id", "frame_ts"])
    assert sorted(r.category_id for r in kept.collect()) == [63, 67, 79]
    assert sorted((r.category_id, r.filter_id) for r in filters.match(det, flt).collect()) == [(63, "desk"), (67, "phone"), (79, "desk")]
    mask = filters.merged_mask(flt).first().cat_mask
    assert len(mask) == len(CATEGORIES) and [i for i, on in enumerate(mask) if on] == [63, 67, 79]
    assert not any(filters.merged_mask(flt.limit(0)).first().cat_mask)
    found = clusters.cluster(det, flt).collect()
    assert [sorted(r.members) for r in found if r.filter_id == "desk"] == [[1, 2]]
    assert det.where(in_mask(F.col("category_id"), F.array(*map(F.lit, mask)))).count() == 3
