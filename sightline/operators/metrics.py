"""Instruments over metric points (series, device_id, ts, seq, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.operators.history import last_n


def summary(points: DataFrame, keys: list[str]) -> DataFrame:
    """Average (0 without values), least, greatest, number and newest of each key's values."""
    return points.groupBy(*keys).agg(
        F.coalesce(F.avg("value"), F.lit(0.0)).alias("avg"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count("*").alias("count"),
        F.max_by("value", F.struct("ts", "seq")).alias("last"),
    )


def rate(points: DataFrame, keys: list[str], start: Column, as_of: Column) -> DataFrame:
    """Points per second since the instrument was made."""
    seconds = (F.unix_micros(as_of) - F.unix_micros(start)) / 1e6
    return points.groupBy(*keys).agg(F.when(seconds > 0, F.count("*") / seconds).otherwise(F.lit(0.0)).alias("rate"))


def recent(points: DataFrame, keys: list[str], n: int = 100) -> DataFrame:
    """The newest n values in order, oldest first, and the number of all."""
    newest = last_n(points.select(*keys, "ts", "seq", "value"), keys, ["ts", "seq"], n)
    lists = newest.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ts", "seq", "value"))).alias("s"))
    counts = points.groupBy(*keys).agg(F.count("*").alias("count"))
    return counts.join(lists, keys).select(*keys, "count", F.transform("s", lambda x: x["value"]).alias("samples"))


def lifetimes(created: DataFrame, removed: DataFrame, as_of: Column, leak_after: float) -> DataFrame:
    """From created (kind, object_id, ts, bytes) and removed (object_id): per kind, objects made, removed and alive, and of
    the living ones older than leak_after seconds the number, bytes and greatest age."""
    gone = removed.select("object_id", F.lit(True).alias("gone")).distinct()
    age = (F.unix_micros(as_of) - F.unix_micros(F.col("ts"))) / 1e6
    each = created.join(gone, "object_id", "left").withColumns({"alive": F.col("gone").isNull(), "age": age})
    leaked = F.col("alive") & (F.col("age") > leak_after)
    return each.groupBy("kind").agg(
        F.count("*").alias("tracked"),
        F.count_if(~F.col("alive")).alias("cleaned"),
        F.count_if("alive").alias("alive"),
        F.count_if(leaked).alias("leaked"),
        F.coalesce(F.sum(F.when(leaked, F.col("bytes"))), F.lit(0)).alias("leaked_bytes"),
        F.max(F.when(leaked, F.col("age"))).alias("max_age"),
        F.avg(F.when(F.col("alive"), F.col("age"))).alias("avg_age"),
    )


def instrument_rows(stats: DataFrame, name: str) -> DataFrame:
    """Statistics (avg, count, rate, alive, cleaned, leaked; null where an instrument lacks them) as typed rows (name, type,
    value): a lifetime gives alive, cleaned and, if any, leaked; else a rate, an average, a count, whichever is there first."""
    row = lambda suffix, kind, value: F.struct(F.concat(F.col(name), F.lit(suffix)).alias("name"), F.lit(kind).alias("type"), value.cast("double").alias("value"))
    memory = F.array_compact(F.array(row(".alive", "memory", F.col("alive")), row(".cleaned", "memory", F.col("cleaned")), F.when(F.col("leaked") > 0, row(".leaked", "memory", F.col("leaked")))))
    one = F.when(F.col("rate").isNotNull(), F.array(row("", "rate", F.col("rate")))).when(F.col("avg").isNotNull(), F.array(row("", "avg_duration", F.col("avg")))).when(F.col("count").isNotNull(), F.array(row("", "counter", F.col("count"))))
    return stats.select(F.inline(F.when(F.col("alive").isNotNull(), memory).otherwise(one)))


def counters(events: DataFrame, kinds: dict[str, Column], distinct: str, measured: Column) -> DataFrame:
    """One row: events seen, those of each kind, distinct devices, and the average of a measure (0 where there is none)."""
    return events.agg(F.count("*").alias("seen"), *(F.count_if(c).alias(k) for k, c in kinds.items()), F.count_distinct(distinct).alias("devices"), F.coalesce(F.avg(measured), F.lit(0.0)).alias("avg_inference"))


def fps_band(fps: Column, good: float = 25, fair: float = 15) -> Column:
    return F.when(fps >= good, "good").when(fps >= fair, "fair").otherwise("poor")


def frame_seconds(fps: Column) -> Column:
    """Time between frames; a second where the rate says nothing."""
    return F.when(fps <= 0, F.lit(1.0)).otherwise(1 / fps)


def session_document(points: DataFrame, key: str) -> DataFrame:
    """A JSON document of each key's session: the day it began, and total and count of its values."""
    s = points.groupBy(key).agg(F.min("ts").alias("start"), F.sum("value").alias("total"), F.count("*").alias("count"))
    return s.select(key, F.to_json(F.struct(F.date_format("start", "yyyy-MM-dd").alias("start_day"), F.array(F.struct(F.lit("value").alias("name"), "total", "count")).alias("instruments"))).alias("document"))


def published(instruments: DataFrame, settings: DataFrame, least: float = 10.0, every: float = 30.0) -> DataFrame:
    """Instruments (device_id, name, ...) that their device's settings (device_id, enabled, frequency, instruments) publish,
    with the interval in seconds: at least least, every where none is given. Missing settings publish all; a list of
    instruments is a whitelist unless it is empty."""
    both = instruments.join(settings, "device_id", "left").where(F.coalesce("enabled", F.lit(True)))
    allowed = F.col("instruments").isNull() | (F.size("instruments") == 0) | F.array_contains("instruments", F.col("name"))
    interval = F.coalesce(F.greatest(F.col("frequency").cast("double"), F.lit(least)), F.lit(every))
    return both.where(allowed).select(*instruments.columns, interval.alias("interval"))


def first_instrument(instruments: Column, suffix: str | None = None, kind: str | None = None) -> Column:
    """The first of an array of structs (name, type, value) whose name ends so or whose type is this; null if none."""
    fits = lambda x: F.lit(True) & (F.endswith(x["name"], F.lit(suffix)) if suffix else F.lit(True)) & ((x["type"] == kind) if kind else F.lit(True))
    return F.get(F.filter(instruments, fits), F.lit(0))


def bound(points: DataFrame, key: str, attribute: str) -> DataFrame:
    """Count and average of the points whose attribute has the value that came first for the key."""
    first = points.groupBy(key).agg(F.min_by(attribute, F.struct("ts", "seq")).alias(attribute))
    return points.join(first, [key, attribute], "left_semi").groupBy(key).agg(F.count("*").alias("count"), F.avg("value").alias("avg"))


def histogram(points: DataFrame, keys: list[str], attribute: str) -> DataFrame:
    return points.groupBy(*keys, attribute).agg(F.sum("value").alias("sum"), F.count("*").alias("count"))


def evicting(points: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Count and sum of the newest n points as of each point."""
    w = W.partitionBy(*keys).orderBy("ts", "seq").rowsBetween(-(n - 1), 0)
    return points.select(*keys, "seq", F.count("*").over(w).alias("count"), F.sum("value").over(w).alias("sum"))


def ewma(points: DataFrame, keys: list[str], alpha: float = 0.2) -> DataFrame:
    """Exponentially weighted average of each key's values in order, begun with the first.

    A value's weight falls by 1 - alpha with each later one, so those beyond the horizon where it is under 2**-60 are below
    a double's precision; each key folds that many of its newest values, not its whole history."""
    horizon = math.ceil(60 * math.log(2) / -math.log(1 - alpha)) + 1
    newest = last_n(points.select(*keys, "ts", "seq", "value"), keys, ["ts", "seq"], horizon)
    folded = newest.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ts", "seq", "value"))).alias("s"))
    rest = F.transform(F.slice("s", 2, horizon), lambda x: x["value"])
    start = F.get("s", F.lit(0))["value"]
    return folded.select(*keys, F.aggregate(rest, start, lambda acc, x: acc * (1 - alpha) + x * alpha).alias("ewma"))


def completion(ewma: Column, started: Column, budget: Column) -> Column:
    """When a task that starts at this time (seconds) will be done: by its average duration (ms), else by its budget, else
    after a second."""
    duration = F.coalesce(ewma, F.nullif(budget, F.lit(0).cast("double")), F.lit(1000.0))
    return started + duration / 1000


def pivot_latest(points: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Newest value of chosen series as columns."""
    newest = lambda s: F.max_by(F.when(F.col("series") == s, F.col("value")), F.when(F.col("series") == s, F.struct("ts", "seq")))
    return points.where(F.col("series").isin(list(columns))).groupBy(key).agg(*(newest(s).alias(c) for s, c in columns.items()))
