"""As-of joins: for each row the last row of another table at or before it, within a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, found: str = "found", strict: bool = False, slot: float = 3600.0) -> DataFrame:
    """left with found, the last right row (a struct of its columns but the keys) of the same keys whose at (a number) is not
    above the left row's, or with strict is below it; null if there is none. Of right rows of one time the greatest struct
    counts; a null at finds nothing and is not found.

    The search runs within slots of time (of the given width, in at's unit) and, for what it doesn't find there, among the
    slots' last rows, so that a key with very many rows is dealt over its slots and nothing is sorted whole but a row a slot."""
    values = [c for c in right.columns if c not in keys]
    names = [c for c in left.columns if c not in keys]
    sides = left.select(*keys, F.col(at).cast("double").alias("at_"), F.lit(0 if strict else 1).alias("turn_"), F.struct(*names).alias("left_"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("right_"))
    others = right.where(F.col(at).isNotNull()).select(*keys, F.col(at).cast("double").alias("at_"), F.lit(1 if strict else 0).alias("turn_"), F.lit(None).cast(left.select(F.struct(*names)).schema[0].dataType).alias("left_"), F.struct(*values).alias("right_"))
    place = F.floor(F.col("at_") / slot).alias("slot_")
    both = sides.union(others).select("*", place)
    inside = W.partitionBy(*keys, "slot_").orderBy("at_", "turn_", "right_").rowsBetween(W.unboundedPreceding, 0)
    here = both.withColumn("here_", F.last("right_", ignorenulls=True).over(inside)).where("left_ is not null")
    ends = others.select("*", place).groupBy(*keys, "slot_").agg(F.max_by("right_", F.struct("at_", "right_")).alias("end_"))
    # the slots of both sides, so that each left row finds the last earlier slot that has any right row
    slots = both.select(*keys, "slot_").distinct().join(ends, [*keys, "slot_"], "left")
    earlier = W.partitionBy(*keys).orderBy("slot_").rowsBetween(W.unboundedPreceding, -1)
    before = slots.select(*keys, "slot_", F.last("end_", ignorenulls=True).over(earlier).alias("before_")).where("before_ is not null")
    joined = here.join(before, [*keys, "slot_"], "left")
    return joined.select(*keys, "left_.*", F.when(F.col("at_").isNotNull(), F.coalesce("here_", "before_")).alias(found))
