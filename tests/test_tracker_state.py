"""What the streaming tracker keeps as state, and which devices it can have."""

import pytest
from pyspark.sql import functions as F

from sightline.operators import tracking
from sightline.streaming import live
from test_streams import RULES, SEEN, detections


@pytest.mark.parametrize("odd", [None, -5])
def test_state_has_a_value_a_device_not_a_row(spark, tmp_path, odd):
    """Numbers beyond those that doubles hold, also beside a device without a number."""
    times = [float(i // 2 * 3 + i // 40 * 400) for i in range(400)]
    ids = [7, 2**60 + 1, 2**60 + 3, odd]
    data = [(r[0], ids[i // 100], *r[2:7], False, *r[8:]) for i, r in enumerate(detections(times[:100] * 4))]
    spark.createDataFrame(data, SEEN).coalesce(1).write.parquet(f"{tmp_path}/in")
    stamped = lambda df: df.withColumn("ts", F.timestamp_micros((F.col("seconds") * 1e6).cast("long")))
    rows = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    with live.keyed_state(spark):
        # no message of its own for an observation
        out = live.track(rows.where("filter_id is not null"), stamped(rows.where("filter_id is null")), RULES, "0 seconds")
        query = out.writeStream.option("checkpointLocation", f"{tmp_path}/checkpoint").option("path", f"{tmp_path}/out").format("parquet").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
            updated = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]]
        finally:
            query.stop()
    assert updated == [len(ids)]
    whole = stamped(spark.read.parquet(f"{tmp_path}/in"))
    batch = tracking.confirmations(whole.where("filter_id is not null").withColumn("attr_score", F.col("score")), whole, RULES)
    last = max(r[4] for r in data)
    want = sorted(tuple(e) for e in batch.collect() if e.device_id is not None and e.event_ts < last - 0.001)
    got = [tuple(r) for r in spark.read.schema(tracking.OUT).parquet(f"{tmp_path}/out").collect()]
    assert sorted(e for e in got if e[0] is not None) == want and {e[0] for e in want} >= set(ids[:3])
    assert {e[0] for e in got} == set(ids)
