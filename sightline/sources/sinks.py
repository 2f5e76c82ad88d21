"""What leaves the pipeline: alerts, snapshots and messages as rows, and key-value state kept by merging."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sightline.functions.text import two_decimals
from sightline.operators.history import last_n, latest
from sightline.session import delete

SNAPSHOT_CONFIDENCE = 0.01


def alert(confirmed: DataFrame) -> DataFrame:
    """Alert rows of confirmation events (filter_id, ts, confidence, x1..y2, description, vlm_required)."""
    place = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"))
    return confirmed.select(
        F.lit("detection").alias("type"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.col("filter_id").alias("watchlist_item_id"),
        "description",
        "confidence",
        "vlm_required",
        F.struct(place.alias("bounding_box")).alias("metadata"),
    )


def as_messages(df: DataFrame, topic: Column) -> DataFrame:
    """Rows as (topic, payload) of a broker; those without topic are left out."""
    return df.select(topic.alias("topic"), F.to_json(F.struct(*df.columns)).alias("payload")).where("topic is not null and payload is not null")


def snapshot(det: DataFrame, least: float = SNAPSHOT_CONFIDENCE) -> DataFrame:
    """The newest frame of each device with its boxes of enough confidence."""
    boxes = F.sort_array(F.collect_list(F.when(F.col("confidence") >= least, F.struct("det_id", "category_id", "confidence", "x1", "y1", "x2", "y2"))))
    frames = det.groupBy("device_id", "frame_ts").agg(boxes.alias("boxes"))
    return latest(frames, ["device_id"], ["frame_ts"])


def crop_name(ts: Column, label: Column, confidence: Column, attributes: Column, colors: Column) -> Column:
    """File name of a crop: time, label, confidence, names of true attributes, colours as part-name."""
    names = F.map_keys(F.map_filter(attributes, lambda _, v: v))
    shades = F.transform(F.map_entries(colors), lambda e: F.concat_ws("-", e["key"], e["value"]))
    return F.concat(F.concat_ws("_", F.date_format(ts, "yyyyMMdd_HHmmss"), label, two_decimals(confidence), F.array_join(names, "_"), F.array_join(shades, "_")), F.lit(".jpg"))


def heartbeats(devices: DataFrame, begin: Column, end: Column, every: float = 30.0) -> DataFrame:
    """A message of each device (device_id) at every interval (seconds) from begin until before end."""
    at = F.explode(F.sequence(begin, end - F.make_dt_interval(secs=F.lit(0.000001)), F.make_dt_interval(secs=F.lit(every)))).alias("at")
    beat = devices.select("device_id", at)
    stamp = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = F.to_json(F.struct("device_id", stamp.alias("timestamp"), F.lit("online").alias("status")))
    return beat.select(F.concat(F.lit("devices/"), F.col("device_id").cast("string"), F.lit("/heartbeat")).alias("topic"), body.alias("payload"))


def to_open_clients(messages: DataFrame, clients: DataFrame) -> DataFrame:
    """Each message (device_id, payload) for every client (client_id, device_id, state) of its device whose session is open;
    a payload that is no JSON object is not sent."""
    valid = messages.where(F.from_json("payload", "map<string,string>").isNotNull())
    return valid.join(clients.where("state = 'OPEN'").select("client_id", "device_id"), "device_id")


def insert(rows: DataFrame, path: str) -> DataFrame:
    """Append rows to the Parquet table below path, in a part of their own, and return what was written."""
    part = f"{path}/insert={uuid.uuid4().hex}"
    rows.write.parquet(part)
    return rows.sparkSession.read.schema(rows.schema).parquet(part)


def flatten(queued: DataFrame, fields: list[str]) -> DataFrame:
    """Messages of one outbound step: the items of all fields' lists, each with its topic; items without topic or payload are
    left out. A field is an array of structs (topic, payload)."""
    return queued.select(F.inline(F.concat(*(F.coalesce(F.col(f), F.array().cast(queued.schema[f].dataType)) for f in fields)))).where("topic is not null and payload is not null")


def _versions(spark: SparkSession, path: str, below: int | None = None) -> dict[int, list[tuple[int, str]]]:
    """The versions of each bucket of a state table, oldest first, before a given one."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/bucket=*")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or ()
    out: dict[int, list[tuple[int, str]]] = {}
    for f in found:
        folder = f.getPath().toString()
        version, bucket = (int(part.partition("=")[2]) for part in folder.split("/")[-2:])
        if below is None or version < below:
            out.setdefault(bucket, []).append((version, folder))
    return {b: sorted(v) for b, v in out.items()}


def merge_latest(path: str, keys: list[str], order: list[str], n: int = 1, buckets: int = 32):
    """A foreachBatch function that keeps the n newest rows of each key in a Parquet table below path (see read_state).

    Keys are dealt over buckets, and a trigger rewrites those that it touches alone, as new versions of them. A bucket keeps
    its last two versions, so that a repeated trigger finds what it had before."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        touched = {r[0] for r in batch.select(bucket.alias("b")).distinct().collect()}  # at most buckets rows
        before = {b: v for b, v in _versions(spark, path, epoch).items() if b in touched}
        both = batch.unionByName(spark.read.schema(batch.schema).parquet(*(v[-1][1] for v in before.values()))) if before else batch
        newest = latest(both, keys, order) if n == 1 else last_n(both, keys, order, n).drop("place")
        newest.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/version={epoch}")
        for old in (folder for v in before.values() for _, folder in v[:-1]):
            delete(spark, old)

    return write


def read_state(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The newest version of each bucket that merge_latest wrote."""
    return spark.read.schema(schema).parquet(*(v[-1][1] for v in _versions(spark, path).values()))
