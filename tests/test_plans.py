"""Plans of the filter queries: filters are broadcast by their known size, and detections stay where they are."""

import pyarrow as pa
from pyspark.sql import functions as F

from sightline.operators import filters
from sightline.plans.registry import QUERIES
from sightline.session import small
from sightline.sources import fixtures


def plan(df):
    """The physical plan before anything runs, from the top."""
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def test_filters_have_a_size(spark):
    for flt in (fixtures.filters(spark), spark.createDataFrame(fixtures.filters(spark).collect(), fixtures.filters(spark).schema)):
        by = filters.by_category(flt)
        assert by._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 100_000
        assert by.count() == sum(len(f[2]) for f in fixtures.FILTERS)


def test_detections_are_not_moved_to_meet_filters(spark, sf):
    """Even where nothing else would be broadcast: the limit lies far below the size of the events."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        for name in ("filter_match", "device_alert_summary", "attribute_score"):
            lines = plan(QUERIES[name](spark, sf))
            assert any("BroadcastHashJoin" in x for x in lines) and not any("SortMergeJoin" in x or "ShuffledHashJoin" in x for x in lines)
            # what is shuffled has been through a partial aggregate (or nothing is)
            for i, x in enumerate(lines):
                if "Exchange hashpartitioning" in x:
                    assert "partial_" in lines[i + 1], (name, x)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_filters_are_left_as_they_are(spark):
    df = spark.range(30).select(F.col("id").alias("a"))
    assert small(df, 29) is df
    assert sorted(r.a for r in small(df, 30).collect()) == list(range(30))
    assert small(df.limit(0), 5).count() == 0
    assert small(spark.createDataFrame(pa.table({"m": [[True, None], None]})), 5).collect()[0].m == [True, None]


def test_frames_go_on(spark):
    det = spark.createDataFrame([(1, "a", 0, 0.5), (2, "a", 0, 0.6), (3, "b", 2, 0.7), (4, "c", 0, 0.8)], "det_id long, frame string, category_id int, confidence double")
    out = filters.keep_frames(det.where("det_id in (2, 4)"), det, ["frame"])
    assert sorted((r.frame, r.det_id, r.category_id, r.confidence) for r in out.where("det_id is not null").collect()) == [("a", 2, 0, 0.6), ("c", 4, 0, 0.8)]
    assert [tuple(r) for r in out.where("det_id is null").select("frame", "category_id", "confidence").collect()] == [("b", -1, 0.0)]
    assert filters.keep_frames(det, det, ["frame"]).count() == 4
