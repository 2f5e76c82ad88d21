"""Bounded outbound queues as a scan: what a queue of limited room sends and loses, without walking through a key's rows.

In a tick a queue takes what arrives as far as there is room, then sends at most `drain`. Over the time to the next arrival
its length q becomes min(high, max(low, q + shift)); such functions are closed under composition, so that they are composed
within slots of time (arrays of a slot's ticks); one pass over the slots' functions in order of time, a row each, tells what
every slot begins with, and then its ticks are walked. A device of very many rows is dealt over its slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.operators.fold import fold


def _after(q: Column, f: Column) -> Column:
    """A queue's length after a step (shift, low, high)."""
    return F.least(f["high"], F.greatest(f["low"], q + f["shift"]))


def _then(f: Column, g: Column) -> Column:
    """First f, then g."""
    return F.struct((f["shift"] + g["shift"]).alias("shift"), _after(f["low"], g).alias("low"), _after(f["high"], g).alias("high"))


def ticks(arrivals: DataFrame, keys: list[str], capacity: int, drain: int, slot_ticks: int = 1024) -> DataFrame:
    """From arrivals (keys, tick, n) of ticks at which anything comes the rows (keys, tick, n, waiting, accepted, dropped):
    waiting is the queue's length before the tick. Between ticks a queue sends on."""
    if not 0 <= drain <= capacity:
        raise ValueError("drain must be at most capacity")
    none = lambda value: F.lit(value).cast("long")
    gap = F.coalesce(F.lead("tick").over(W.partitionBy(*keys, "slot").orderBy("tick")), (F.col("slot") + 1) * slot_ticks) - F.col("tick")
    placed = arrivals.withColumn("slot", F.floor(F.col("tick") / slot_ticks)).withColumn("gap", gap)
    # what is sent until the next arrival, or the end of the slot
    sent = F.col("gap") * drain
    step = F.struct((F.col("n") - sent).alias("shift"), none(0).alias("low"), F.greatest(none(0), F.lit(capacity) - sent).alias("high"))
    lists = placed.withColumn("step", step).groupBy(*keys, "slot").agg(F.sort_array(F.collect_list(F.struct("tick", "n", "step"))).alias("all"))
    idle = F.struct((-(F.col("all")[0]["tick"] - F.col("slot") * slot_ticks) * drain).alias("shift"), none(0).alias("low"), none(capacity).alias("high"))
    # a slot's own function, from its beginning to its end
    whole = F.aggregate("all", idle, lambda f, x: _then(f, x["step"]))
    slots = lists.withColumns({"idle": idle, "whole": whole})
    rest = (F.coalesce(F.lead("slot").over(W.partitionBy(*keys).orderBy("slot")), F.col("slot") + 1) - F.col("slot") - 1) * slot_ticks * drain
    until = _then(F.col("whole"), F.struct((-rest).alias("shift"), none(0).alias("low"), none(capacity).alias("high")))

    class Scan:
        def __init__(self, row):
            self.q = 0

        def step(self, row):
            yield *(row[k] for k in keys), row["slot"], self.q
            self.q = min(row["high"], max(row["low"], self.q + row["shift"]))

        def close(self):
            return ()

    kinds = [arrivals.schema[k].dataType.simpleString() for k in keys]
    started = fold(slots.select(*keys, "slot", until.alias("u")).select(*keys, "slot", "u.*"), keys, ["slot"], ", ".join([*(f"{k} {kind}" for k, kind in zip(keys, kinds, strict=True)), "slot long", "q long"]), Scan)
    walked = slots.join(started, [*keys, "slot"])
    first = F.struct(F.array().cast("array<long>").alias("q"), _after(F.col("q"), F.col("idle")).alias("now"))
    waiting = F.aggregate("all", first, lambda a, x: F.struct(F.concat(a["q"], F.array(a["now"])).alias("q"), _after(a["now"], x["step"]).alias("now")))["q"]
    each = walked.select(*keys, F.inline(F.arrays_zip(F.transform("all", lambda x: x["tick"]).alias("tick"), F.transform("all", lambda x: x["n"]).alias("n"), waiting.alias("waiting"))))
    accepted = F.least(F.col("n"), F.lit(capacity) - F.col("waiting"))
    return each.select(*keys, "tick", "n", "waiting", accepted.alias("accepted"), (F.col("n") - accepted).alias("dropped"))


def bounded(rows: DataFrame, keys: list[str], ts: str, order: list[str], capacity: int = 1000, drain: int = 10, tick_ms: int = 100, slot_ticks: int = 1024) -> DataFrame:
    """rows with tick, kept (whether the queue had room) and sent_tick (at which it leaves; null if not kept): a queue of capacity
    rows a key, of which drain leave at the end of every tick."""
    tick = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (tick_ms * 1000))
    told = rows.withColumn("tick", tick)
    flow = ticks(told.groupBy(*keys, "tick").agg(F.count("*").alias("n")), keys, capacity, drain, slot_ticks)
    nth = F.row_number().over(W.partitionBy(*keys, "tick").orderBy(*order))
    placed = told.withColumn("nth_", nth).join(flow.select(*keys, "tick", "waiting", "accepted"), [*keys, "tick"])
    kept = F.col("nth_") <= F.col("accepted")
    # those that wait go first
    leaves = F.col("tick") + F.floor((F.col("waiting") + F.col("nth_") - 1) / drain)
    return placed.select(*rows.columns, "tick", kept.alias("kept"), F.when(kept, leaves).alias("sent_tick"))
