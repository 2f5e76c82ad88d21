"""Streaming twins: bounded histories, and the tracker with its tracks as keyed state."""

from __future__ import annotations

import contextlib
import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from sightline.operators.tracking import OUT, Rules, Tracker


def read_table(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A Parquet folder, or a single file, as a stream with the schema of what is there.

    All that is there comes in one trigger unless per_trigger limits its files. Files need not be cut by time, so under a
    watermark a limit would drop the rows of later files that lie before the newest of earlier ones."""
    now = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    single = any(f.rpartition("/")[2] == name for f in now.inputFiles()[:1])
    reader = spark.readStream.schema(now.schema)
    reader = reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader
    return reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)


def windowed_counts(events: DataFrame, ts: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts per key and tumbling window; rows later than late may be lost, as a watermark says."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("window.start").alias("begin"), "n")


_ROW = "seconds double, det_id long, filter_id string, category_id int, x1 double, y1 double, x2 double, y2 double, attr_bits int, score double, vlm_required boolean, colors array<string>, track_id string, confirmed boolean, valid boolean"
_ROW_NAMES = [c.split()[0] for c in _ROW.split(", ")]
_ANSWERS = _ROW_NAMES.index("track_id") - 4
#: Packs of rows in one value of state, at most.
_PACKS = 10_000


def _plain(column: pa.Array) -> list:
    """A column's values as Python has them."""
    if pa.types.is_nested(column.type):
        return [None if v is None else v.tolist() for v in column.to_numpy(zero_copy_only=False)]
    if column.null_count and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return np.where(column.is_valid().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy(), None).tolist()
    return column.to_numpy(zero_copy_only=False).tolist()


def _packed(timed: DataFrame) -> DataFrame:
    """Rows of one device and time that come one after the other as one row with their bytes."""
    kept = ["device", "at", "seconds"]
    schema = StructType([*(timed.schema[c] for c in kept), *StructType.fromDDL("pack binary").fields])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes = [b.column(c).dictionary_encode("encode").indices.to_numpy() for c in kept[:2]]
            starts = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in codes])) + 1).tolist()]
            rows = list(zip(*(_plain(b.column(c)) for c in _ROW_NAMES), strict=True))
            packs = [pickle.dumps(rows[i:j], 5) for i, j in zip(starts, [*starts[1:], len(rows)], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(starts)) for c in kept), pa.array(packs, pa.binary())], names=schema.names)

    return timed.mapInArrow(pack, schema)


def _unpacked(events: DataFrame) -> DataFrame:
    """The events of devices as rows."""
    schema = StructType.fromDDL(OUT)
    arrow = to_arrow_schema(schema)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if rows := [e for p in b.column(0).to_pylist() for e in pickle.loads(p)]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return events.mapInArrow(unpack, schema)


class _DeviceTracks(StatefulProcessor):
    """The tracks of one device over all filters and categories. State: the live tracks with the time of the last message, and
    rows whose time the watermark has not passed. Rows wait for the watermark, so that the order in which files or triggers bring
    them doesn't matter; the timer of the earliest wakes the device. One more timer ends the state of a silent device.

    Rows and tracks are kept as bytes, many in one value, rows come as frames, and a device's events go as one value: Spark sends
    the schema along with every value of state that Python reads, makes single rows a cell at a time, and frames a column at a time."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracks = handle.getValueState("tracks", "tracks binary, seconds double")
        self.waiting = handle.getListState("waiting", "packs binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = math.inf
        for some in rows:
            self.waiting.appendValue((pickle.dumps(some["pack"].tolist(), 5),))
            first = min(first, some["seconds"].min())
        self.handle.registerTimer(_after(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due, rest = [], []
        for (packs,) in self.waiting.get():
            for p in pickle.loads(packs):
                rows = pickle.loads(p)  # all of one time
                if _after(rows[0][0]) < now:
                    due += rows
                else:
                    rest.append((rows[0][0], p))
        due.sort(key=_turn)
        tracks, last = self.tracks.get() or (None, None)
        device = int(key[0]) if key[0] else None
        machines = {(device, *k): Tracker((device, *k), self.rules, live) for k, live in (pickle.loads(tracks) if tracks else ())}
        out, since = [], last
        for seconds, det_id, filter_id, category_id, *others in due:
            answers = others[_ANSWERS] is not None
            if not answers and seconds != last:  # a new message
                since, last = last, seconds
            if filter_id is not None:
                k = (device, filter_id, category_id)
                if k not in machines:
                    machines[k] = Tracker(k, self.rules)
                row = dict(zip(_ROW_NAMES, (seconds, det_id, filter_id, category_id, *others), strict=True))
                row["since"] = last if answers else since
                out += machines[k].either(row)
        for m in machines.values():
            m.expire(last)
        live = [(k[1:], m.tracks) for k, m in machines.items() if m.tracks]
        ends = _after(max(t["last_seen"] for _, of in live for t in of) + self.rules.ttl) if live else 0
        if not rest and ends < now:
            self.tracks.clear(), self.waiting.clear()
        else:
            self.tracks.update((pickle.dumps(live, 5), last))
            if rest:
                self.waiting.put([(pickle.dumps([p for _, p in rest[i : i + _PACKS]], 5),) for i in range(0, len(rest), _PACKS)])
            else:
                self.waiting.clear()
            self.handle.registerTimer(_after(min(at for at, _ in rest)) if rest else ends)
        return iter([pd.DataFrame({"events": [pickle.dumps(out, 5)]})] if out else [])


def _turn(row: tuple) -> tuple:
    """Rows of a device in their order: by time, and answers before detections by their numbers."""
    return row[0], row[4 + _ANSWERS] is None, row[1] or 0


def _after(seconds: float) -> int:
    """The first whole millisecond after a time; a row is due when the watermark is beyond it."""
    return math.floor(seconds * 1000) + 1


def track(observed: DataFrame, messages: DataFrame, rules: Rules = Rules(), late: str = "1 hour") -> DataFrame:
    """Confirmation events of a stream of observations (as operators.tracking.observations gives them), or of these and a
    verifier's answers (operators.tracking.with_answers); messages is a stream with device_id and ts of all messages, of which
    those of an observation may be left out. The query needs the state store of `keyed_state`. An event comes when the watermark
    has passed it."""
    ticks = messages.select("device_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))
    names = [f.split() for f in _ROW.split(", ")]
    both = observed.unionByName(ticks, allowMissingColumns=True)
    both = both.select("device_id", *((F.col(c) if c in both.columns else F.lit(None)).cast(kind).alias(c) for c, kind in names))
    # a key that is never null, as frames would make numbers beside a null inexact
    device = F.coalesce(F.col("device_id").cast("long").cast("string"), F.lit(""))
    timed = both.withColumns({"device": device, "at": F.timestamp_micros((F.col("seconds") * 1e6).cast("long"))})
    return _unpacked(_packed(timed).withWatermark("at", late).groupBy("device").transformWithStateInPandas(_DeviceTracks(rules), "events binary", "append", "eventTime"))


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """Streams that start inside keep their state where keyed state with timers can be kept."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def split_tables(path: str, tables: dict[str, Column], checks: dict[str, Column] | None = None, known: Callable[[SparkSession], DataFrame] | None = None, key: str = "device_id"):
    """A foreachBatch function that deals messages over tables below path, and what none takes over to a dead-letter table.

    tables: the condition of each table, of which the first that holds counts; checks: reasons with the conditions of a good
    message; known: the devices that exist (read anew for each batch), of which others' messages are orphans. A dead letter
    has its reason: that of the first check that fails, "orphan", or "no table". Each batch is written under its epoch, over what
    an earlier try has left there, so that a repeated epoch changes nothing; read_split reads the tables."""
    choice = F.lit(None).cast("string")
    for name, condition in reversed(tables.items()):
        choice = F.when(condition, F.lit(name)).otherwise(choice)
    fault = F.lit(None).cast("string")
    for reason, good in reversed((checks or {}).items()):
        fault = F.when(~F.coalesce(good, F.lit(False)), F.lit(reason)).otherwise(fault)

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("reason", fault)
        if known is not None:
            there = known(batch.sparkSession).select(key, F.lit(True).alias("there_")).distinct()
            rows = rows.join(there, key, "left").withColumn("reason", F.coalesce("reason", F.when(F.col("there_").isNull(), F.lit("orphan")))).drop("there_")
        placed = rows.withColumn("table", F.when(F.col("reason").isNull(), choice))
        placed = placed.withColumn("reason", F.when(F.col("table").isNull(), F.coalesce("reason", F.lit("no table"))))
        placed = placed.withColumn("table", F.coalesce("table", F.lit("dead")))
        # one write for all tables: the committed epoch has all of them or none
        placed.write.partitionBy("table").mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def read_split(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """What split_tables wrote: the messages (of this schema) with their table, reason and epoch."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(StructType([*schema.fields, *StructType.fromDDL("reason string, table string, epoch long").fields])).parquet(path)


def run_once(stream: DataFrame, checkpoint: str, mode: str = "append", **sink) -> None:
    """Run a stream over all that is there; sink is foreach=function or path=folder."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer = writer.foreachBatch(sink["foreach"]) if "foreach" in sink else writer.format("parquet").option("path", sink["path"])
    query = writer.start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
