"""Latest values, bounded histories and time to live, as windows and grouped extremes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ring_by_kind(df: DataFrame, keys: list[str], order: list[str], capacity: Column, most: int) -> DataFrame:
    """The newest rows of each key up to a capacity that depends on the row (at most most), with their place."""
    return last_n(df, keys, order, most).where(F.col("place") <= capacity)


def confirmed_within(df: DataFrame, keys: list[str], order: list[str], hits: int, seconds: float) -> DataFrame:
    """The first row of each key that is at least its hits-th and lies within so many seconds of the key's first (by ts, the
    first column of order); the last column of order is returned."""
    w = W.partitionBy(*keys).orderBy(*order)
    each = df.withColumns({"n": F.row_number().over(w), "first": F.first(order[0]).over(w)})
    soon = (F.unix_micros(order[0]) - F.unix_micros("first")) / 1e6 <= seconds
    return each.where((F.col("n") >= hits) & soon).groupBy(*keys).agg(F.min(order[-1]).alias(order[-1]))


def running_mask(mask: Column, keys: list[str], order: list[str]) -> Column:
    """How many rows of the key are masked up to this one."""
    return F.sum(mask.cast("long")).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def last_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The n newest rows of each key with their place (1: newest). Spark cuts every partition to n before the shuffle."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return df.withColumn("place", place).where(F.col("place") <= n)


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= n)


def offered(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Every row with kept (whether it is among the first n of its key) and accepted, which such a buffer always answers."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumns({"kept": place <= n, "accepted": F.lit(True)})


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by a grouped maximum with partial results."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r")).select(*keys, "r.*")


def decimate(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Every n-th row of a key: n, 2n, 3n ..."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") % n == 0)


def alive(last_write: Column, as_of: Column, seconds: int) -> Column:
    """Whether something written last_write still lives at as_of; null counts as never written."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(last_write.cast("timestamp"))) / 1e6
    return F.coalesce(age < seconds, F.lit(False))


def rate_cap(df: DataFrame, keys: list[str], ts: str, order: list[str], bucket_ms: int, n: int) -> DataFrame:
    """At most n rows of a key in each bucket of time."""
    bucket = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (bucket_ms * 1000)).alias("bucket")
    return first_n(df.select("*", bucket), [*keys, "bucket"], order, n).drop("place")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)
