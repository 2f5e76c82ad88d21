"""Routing of events to alerts or to a single busy verifier with a bounded queue."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.text import answer
from sightline.operators.asof import as_of
from sightline.operators.fold import fold

CAPACITY = 10


def route(events: DataFrame, key: str = "device_id", order: tuple[str, ...] = ("event_ts", "event_id"), capacity: int = CAPACITY, message: str = "event_id") -> DataFrame:
    """From events (key, order..., event_id, vlm_required, ready, and the message that they came in) the rows (key, event_id,
    at, target, vlm_status). Events of a message follow each other in the order.

    With a ready verifier one waiting event goes to it before each message. An event that needs no verification becomes an
    alert; else it goes to a ready verifier or waits, and a full queue gives up its oldest as an alert that timed out. What
    still waits at the end is returned as queued. at is the event that caused the routing."""
    kind = events.schema[key].dataType.simpleString()

    class Router:
        def __init__(self, row):
            self.key, self.queue, self.last, self.message = row[key], deque(), None, None

        def step(self, row):
            at = self.last = row["event_id"]
            opens, self.message = self.message is None or row[message] != self.message[0], (row[message],)
            if opens and self.queue and row["ready"]:
                yield self.key, self.queue.popleft(), at, "verify", None
            if not row["vlm_required"]:
                yield self.key, at, at, "alerts", None
            elif row["ready"]:
                yield self.key, at, at, "verify", None
            else:
                if len(self.queue) >= capacity:
                    yield self.key, self.queue.popleft(), at, "alerts", "timeout"
                self.queue.append(at)

        def close(self):
            for waiting in self.queue:
                yield self.key, waiting, self.last, "queued", None

    return fold(events, [key], list(order), f"{key} {kind}, event_id long, at long, target string, vlm_status string", Router)


def with_ready(events: DataFrame, runs: DataFrame, key: str = "device_id", at: str = "seconds") -> DataFrame:
    """Events with ready: whether the verifier is free at their time. runs are the verifier's own (key, started, finished, in
    the unit of at); it takes one at a time, so that the last one begun tells. It is free again at the moment it finishes."""
    busy = runs.select(key, F.col("started").alias(at), "finished")
    found = as_of(events, busy, [key], at)
    return found.withColumn("ready", F.coalesce(F.col("found.finished") <= F.col(at), F.lit(True))).drop("found")


def counters(routed: DataFrame) -> DataFrame:
    """One row: what a router has counted, from its own rows."""
    gone = F.col("target") != "queued"
    late = F.coalesce(F.col("vlm_status") == "timeout", F.lit(False))
    return routed.agg(
        F.count_if((F.col("target") == "alerts") & ~late).alias("routed_to_alerts"),
        F.count_if(F.col("target") == "verify").alias("routed_to_verifier"),
        F.count_if(~gone | late | ((F.col("target") == "verify") & (F.col("at") != F.col("event_id")))).alias("queued"),
        F.count_if(late).alias("timeouts"),
        F.count_if(~gone).alias("still_waiting"),
    )


def outcome(response: Column, has_crop: Column) -> tuple[Column, Column]:
    """(status, published) of a verifier's response: a plain no is not published; without a crop it is invalid."""
    confirmed, valid = answer(response)
    valid = valid & has_crop
    status = F.when(valid & confirmed, "confirmed").when(valid, "rejected").otherwise("invalid_response")
    return status, status != "rejected"


def interval_gate(df: DataFrame, key: str, ts: str, every: float) -> DataFrame:
    """Rows at which a task with this interval (seconds) runs: the first, then each that comes at least that long after the
    last run. Rows with equal times are one chance. Returns key, ts and the number of the run."""
    kind = df.schema[key].dataType.simpleString()

    class Gate:
        def __init__(self, row):
            self.key, self.last, self.n = row[key], None, 0

        def step(self, row):
            if self.last is None or row["seconds"] - self.last >= every:
                self.last, self.n = row["seconds"], self.n + 1
                yield self.key, row["seconds"], self.n

        def close(self):
            return ()

    rows = df.select(key, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("seconds"))
    return fold(rows, [key], ["seconds"], f"{key} {kind}, seconds double, run long", Gate)
