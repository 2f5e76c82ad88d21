"""Streams over several files that are not cut by time."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from compare import database, same_rows
from sightline.operators import tracking
from sightline.plans.registry import ORACLE_SQL, QUERIES
from sightline.streaming import live


@pytest.fixture(scope="module")
def eight(spark, sf, tmp_path_factory):
    """The events in eight files, each of which spans all days."""
    folder = str(tmp_path_factory.mktemp("eight"))
    spark.read.parquet(f"{sf}/events.parquet").repartition(8, "event_id").write.parquet(f"{folder}/events.parquet")
    assert len(spark.read.parquet(f"{folder}/events.parquet").inputFiles()) == 8
    return folder


def test_counts_of_unsorted_files(spark, sf, eight):
    assert same_rows(QUERIES["stream_windowed_counts"](spark, eight), ORACLE_SQL["stream_windowed_counts"], database(sf)) > 0


def test_tracks_of_unsorted_files(spark, sf, eight):
    assert same_rows(QUERIES["stream_tracker"](spark, eight), ORACLE_SQL["stream_tracker"], database(sf)) > 0


SEEN = "det_id long, device_id long, filter_id string, category_id int, seconds double, attr_bits int, score double, vlm_required boolean, x1 double, y1 double, x2 double, y2 double"
RULES = tracking.Rules(hits=2, window=50, cooldown=120, ttl=300)


def detections(times):
    """Of one device: a person, a car (category 2) or nothing that a filter matches (category -1) at each time."""
    kinds = (0, 2, -1)
    return [(i, 1 + i % 2, "f" if kinds[i % 3] >= 0 else None, kinds[i % 3], 1e6 + t, 3, 0.5 + i % 7 / 14, i % 4 == 0, 0.0, 0.0, 10.0, 20.0) for i, t in enumerate(times)]


def test_tracks_over_triggers_and_a_restart(spark, tmp_path):
    """Files that overlap in time come in triggers of their own, the second half after a restart, with a verifier's answers."""
    rng = random.Random(3)
    rows, at = [], 0.0
    for i in range(900):
        at += rng.choice((0, 0, 1, 2, 2, 3, 5, 130, 400))
        rows.append(at)
    data = detections(rows)
    whole = spark.createDataFrame(data, SEEN).withColumn("ts", F.timestamp_micros((F.col("seconds") * 1e6).cast("long")))
    matched = whole.where("filter_id is not null").withColumn("attr_score", F.col("score"))
    asked = [e for e in tracking.confirmations(matched, whole, RULES).collect() if e.vlm_required]
    said = [(e.device_id, e.filter_id, e.category_id, e.track_id, e.event_ts + 7, i % 3 == 0, i % 2 == 0) for i, e in enumerate(asked)]
    answers = spark.createDataFrame(said, "device_id long, filter_id string, category_id int, track_id string, seconds double, confirmed boolean, valid boolean")
    last = max(r[4] for r in data)
    late = int((last - 1e6) / 5)
    want = sorted(tuple(e) for e in tracking.confirmations(matched, whole, RULES, answers=answers).collect() if e.event_ts < last - late - 0.001)
    assert len(want) > 30 and len(asked) > 10
    # each file has what is before its end and was in no earlier one, but for some rows that come a file late
    ends = [last * k / 6 + 1e6 * (6 - k) / 6 for k in range(1, 6)] + [last + 1]
    file_of = lambda key, t: min(5, next(k for k, e in enumerate(ends) if t < e) + (zlib.crc32(str(key).encode()) % 5 == 0))

    def put(k):
        part = spark.createDataFrame([r for r in data if file_of(r[0], r[4]) == k], SEEN)
        told = spark.createDataFrame([r for r in said if file_of(r[3], r[4]) == k], answers.schema)
        part.unionByName(told, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        rows = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        found = rows.where("filter_id is not null")
        ticks = rows.where("track_id is null").select("device_id", F.timestamp_micros((F.col("seconds") * 1e6).cast("long")).alias("ts"))
        with live.keyed_state(spark):
            live.run_once(live.track(found, ticks, RULES, f"{late} seconds"), f"{tmp_path}/checkpoint", path=f"{tmp_path}/out")

    for k in range(3):
        put(k)
    run()
    for k in range(3, 6):
        put(k)
    run()
    out = spark.read.schema(tracking.OUT).parquet(f"{tmp_path}/out")
    got = sorted(tuple(r) for r in out.collect())
    assert got == want


def test_newest_of_unsorted_files(spark, sf, eight):
    assert same_rows(QUERIES["stream_last_n"](spark, eight), ORACLE_SQL["stream_last_n"], database(sf)) > 0


def test_a_repeated_epoch_changes_nothing(spark, tmp_path):
    schema = "device_id long, kind string, value int"
    known = lambda s: s.createDataFrame([(1,), (2,)], "device_id long")
    write = live.split_tables(str(tmp_path / "out"), {"a": F.col("kind") == "a", "late": F.col("kind").startswith("a"), "b": F.col("kind") == "b"}, {"no value": F.col("value").isNotNull(), "negative": F.col("value") >= 0}, known)
    first = spark.createDataFrame([(1, "a", 1), (1, "ab", 2), (2, "b", None), (2, "b", -1), (3, "b", 5), (None, "a", 1), (1, "c", 1), (1, None, 1)], schema)
    second = spark.createDataFrame([(2, "b", 7)], schema)
    rows = lambda: sorted((r.epoch, r.table, r.reason or "", r.kind or "", -9 if r.value is None else r.value) for r in live.read_split(spark, str(tmp_path / "out"), schema).collect())
    write(first, 0)
    want = [(0, "a", "", "a", 1), (0, "dead", "negative", "b", -1), (0, "dead", "no table", "", 1), (0, "dead", "no table", "c", 1), (0, "dead", "no value", "b", -9), (0, "dead", "orphan", "a", 1), (0, "dead", "orphan", "b", 5), (0, "late", "", "ab", 2)]
    assert rows() == want
    write(second, 1)
    write(first, 0)
    write(second, 1)
    assert rows() == [*want, (1, "b", "", "b", 7)]
