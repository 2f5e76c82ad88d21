"""Places in a total order, without a window over everything."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.session import materialize


def numbered(df: DataFrame, order: list, place: str = "place") -> DataFrame:
    """df with each row's place (from 1) in an order: a range sort, whose partitions are counted (a number each, on the driver)
    and then numbered on from the one before. Rows that are equal in the order get places in any order."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id())
    stored = materialize(ordered, "ordered")
    part = F.shiftright("at_", 33)
    sizes = stored.groupBy(part.alias("part_")).agg(F.count("*").alias("n")).orderBy("part_").toArrow()
    n = sizes["n"].to_numpy().astype(np.int64)
    before = df.sparkSession.createDataFrame(pa.table({"part_": sizes["part_"], "before_": pa.array(np.cumsum(n) - n, pa.int64())}))
    at = (F.col("before_") + F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(place)
    return stored.withColumn("part_", part).join(before, "part_").select(*df.columns, at)
