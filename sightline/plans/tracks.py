"""Queries over order-dependent state: tracks, verification, routing and streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions.attributes import in_mask
from sightline.operators import filters, routing, tracking
from sightline.plans import machines
from sightline.plans.base import POINTS, query
from sightline.session import new_folder
from sightline.sources import fixtures
from sightline.sources.sinks import merge_latest, read_state
from sightline.streaming import live
from sightline.vocab import PERSON

DAY = 86400.0
#: Frames are a day apart in the fixture.
RULES = tracking.Rules(hits=2, window=3 * DAY, cooldown=7 * DAY, ttl=10 * DAY)


#: A detection's colours: none of every fourth, else one of three.
_COLORS = "CASE WHEN det_id % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE [['red', 'blue', 'green'][det_id // 4 % 3 + 1]] END"


def _with_colors(det):
    one = F.array(F.element_at(F.array(*map(F.lit, ("red", "blue", "green"))), (F.floor(F.col("det_id") / 4) % 3 + 1).cast("int")))
    return det.withColumn("colors", F.when(F.col("det_id") % 4 == 0, F.array().cast("array<string>")).otherwise(one))


def _matched(spark, sf_dir, required):
    """Matched detections, and all messages."""
    det = fixtures.detections(spark, sf_dir)
    found = filters.match(_with_colors(det), fixtures.filters(spark))
    return found.withColumn("vlm_required", required), det.select("device_id", "ts")


def _shown(events):
    return events.select("device_id", "filter_id", "category_id", F.round("event_ts", 3).alias("event_ts"), F.round("first_seen", 3).alias("first_seen"), "best_det_id", F.round("best_score", 6).alias("best_score"), "hits", "vlm_required")


@query(machines.tracks(RULES, "false", _COLORS))
def track_confirmations(spark, sf_dir):
    return _shown(tracking.confirmations(*_matched(spark, sf_dir, F.lit(False)), RULES))


@query(machines.tracks(RULES, "category_id = 0", _COLORS, "best % 3 = 0", "best % 5 <> 0"))
def verification_feedback(spark, sf_dir):
    """Persons need a verifier, whose answers depend on the detection."""

    def verify(event):
        return event[6] % 3 == 0, event[6] % 5 != 0

    return _shown(tracking.confirmations(*_matched(spark, sf_dir, F.col("category_id") == 0), RULES, verify))


@query(machines.routes("SELECT user_id AS device_id, ts AS event_ts, event_id, event_id AS message, event_type IN ('click', 'view') AS vlm_required, event_type = 'purchase' AS ready FROM events", 3))
def route_verification(spark, sf_dir):
    e = fixtures.table(spark, sf_dir, "events")
    kind = F.col("event_type")
    events = e.select(F.col("user_id").alias("device_id"), F.col("ts").alias("event_ts"), "event_id", kind.isin("click", "view").alias("vlm_required"), (kind == "purchase").alias("ready"))
    return routing.route(events, capacity=3)


#: A device's day is one message at noon; each purchase keeps the verifier busy for as many hours as its value, or
#: until the next begins.
_NOON = "epoch_us(date_trunc('day', ts)) / 1e6 + 43200"
_RUNS = "runs AS (SELECT user_id AS device_id, epoch_us(ts) / 1e6 AS started, least(epoch_us(ts) / 1e6 + floor(value) * 3600, coalesce(lead(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id), 1e18)) AS finished FROM events WHERE event_type = 'purchase')"
_BUSY = f"""WITH {_RUNS}, told AS (SELECT user_id AS device_id, event_id, {_NOON} AS event_ts, {_NOON} AS message, event_type IN ('click', 'view') AS vlm_required FROM events)
SELECT told.*, coalesce(finished <= event_ts, true) AS ready FROM told ASOF LEFT JOIN runs ON told.device_id = runs.device_id AND told.event_ts >= runs.started"""


def _routed_by_messages(spark, sf_dir):
    e = fixtures.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    seconds = lambda c: F.unix_micros(c) / 1e6
    noon = (seconds(F.date_trunc("day", "ts")) + 43200).alias("event_ts")
    events = e.select(F.col("user_id").alias("device_id"), "event_id", noon, F.col("event_type").isin("click", "view").alias("vlm_required"))
    runs = e.where("event_type = 'purchase'").select(F.col("user_id").alias("device_id"), seconds(F.col("ts")).alias("started"), (F.floor("value") * 3600).alias("took"), "event_id")
    begins = F.lead("started").over(W.partitionBy("device_id").orderBy("started", "event_id"))
    runs = runs.select("device_id", "started", F.least(F.col("started") + F.col("took"), begins).alias("finished"))
    return routing.route(routing.with_ready(events, runs, at="event_ts"), capacity=2, message="event_ts")


@query(machines.routes(_BUSY, 2))
def route_by_messages(spark, sf_dir):
    """Messages of several events, of which only one waiting event is taken each; readiness follows from the verifier's runs."""
    return _routed_by_messages(spark, sf_dir)


@query(f"""SELECT count(*) FILTER (target = 'alerts' AND vlm_status IS NULL) AS routed_to_alerts, count(*) FILTER (target = 'verify') AS routed_to_verifier,
count(*) FILTER (target = 'queued' OR vlm_status IS NOT NULL OR (target = 'verify' AND "at" <> event_id)) AS queued, count(*) FILTER (vlm_status = 'timeout') AS timeouts, count(*) FILTER (target = 'queued') AS still_waiting
FROM ({machines.routes(_BUSY, 2)})""")
def router_counters(spark, sf_dir):
    return routing.counters(_routed_by_messages(spark, sf_dir))


_SAID = "CASE event_id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no.' WHEN 2 THEN '?' ELSE 'YES' END"


@query(f"""SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 4 = 2 THEN 'invalid_response' WHEN event_id % 4 IN (0, 3) THEN 'confirmed' END AS vlm_status FROM events WHERE event_id % 3 = 0 OR event_id % 4 <> 1""")
def verifier_outcomes(spark, sf_dir):
    status, published = routing.outcome(F.expr(_SAID), F.col("event_id") % 3 != 0)
    return fixtures.table(spark, sf_dir, "events").where(published).select("event_id", status.alias("vlm_status"))


_TABLES = {"alerts": "event_type = 'purchase'", "heartbeats": "event_type = 'view'", "registrations": "event_type = 'signup'"}
_REASON = "CASE WHEN coalesce(value, 0) <= 0 OR value >= 150 THEN 'invalid' WHEN user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3) THEN 'orphan' END"
_CHOICE = "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for t, c in _TABLES.items()) + " END"


@query(f"""WITH told AS (SELECT event_id, {_REASON} AS fault, {_CHOICE} AS choice FROM events)
SELECT CASE WHEN fault IS NULL AND choice IS NOT NULL THEN choice ELSE 'dead' END AS kept_in, CASE WHEN fault IS NOT NULL THEN fault WHEN choice IS NULL THEN 'no table' END AS reason,
count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM told GROUP BY 1, 2""")
def stream_split(spark, sf_dir):
    """One stream of messages dealt over several tables, with orphans and invalid ones as dead letters."""
    base = new_folder(spark, "stream")
    events = live.read_table(spark, f"{sf_dir}/events.parquet")
    devices = lambda s: fixtures.table(s, sf_dir, "customer").where("c_nationkey <> 3").select(F.col("c_custkey").alias("user_id"))
    write = live.split_tables(f"{base}/out", {t: F.expr(c) for t, c in _TABLES.items()}, {"invalid": F.expr("value > 0 and value < 150")}, devices, "user_id")
    live.run_once(events, f"{base}/checkpoint", foreach=write)
    out = live.read_split(spark, f"{base}/out", events.schema)
    return out.groupBy(F.col("table").alias("kept_in"), "reason").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(f"WITH {POINTS} SELECT device_id, series, max(seq) AS seq FROM points GROUP BY 1, 2")
def stream_last_n(spark, sf_dir):
    """Newest point by device and series, kept by a stream over all that is there."""
    base = new_folder(spark, "stream")
    events = live.read_table(spark, f"{sf_dir}/events.parquet", per_trigger=1)
    points = fixtures.datapoints_of(events)
    live.run_once(points, f"{base}/checkpoint", foreach=merge_latest(f"{base}/state", ["device_id", "series"], ["ts", "seq"]))
    return read_state(spark, f"{base}/state", points.schema).select("device_id", "series", "seq")


@query("SELECT event_type, strftime(time_bucket(INTERVAL 1 day, ts), '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts < date_trunc('day', (SELECT max(ts) FROM events)) GROUP BY 1, 2")
def stream_windowed_counts(spark, sf_dir):
    """Closed daily windows of a stream with a watermark: all but the newest day."""
    base = new_folder(spark, "stream")
    events = live.read_table(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    live.run_once(live.windowed_counts(events, "ts", ["event_type"], "1 day", "1 hour"), f"{base}/checkpoint", path=f"{base}/out")
    out = spark.read.schema("event_type string, begin timestamp, n long").parquet(f"{base}/out")
    return out.select("event_type", F.date_format("begin", "yyyy-MM-dd").alias("day"), "n")


@query(machines.tracks(RULES, "false", _COLORS, until="floor(event_ts * 1000) + 1 < (SELECT epoch_ms(max(ts)) FROM det)"))
def stream_tracker(spark, sf_dir):
    """The tracker as a stream: the events of track_confirmations that the watermark has passed (all but the last millisecond)."""
    base = new_folder(spark, "stream")
    events = live.read_table(spark, f"{sf_dir}/events.parquet")
    det = fixtures.detections_of(events)
    flt = fixtures.filters(spark)
    found = filters.match(_with_colors(det), flt).withColumn("vlm_required", F.lit(False))
    # a detection that some filter matches says when its message came; of other than persons the category decides
    sure = in_mask(F.col("category_id"), filters.merged_mask(flt).scalar()) & (F.col("category_id") != PERSON)
    with live.keyed_state(spark):
        live.run_once(live.track(tracking.observations(found), det.where(~sure).select("device_id", "ts"), RULES, "0 seconds"), f"{base}/checkpoint", path=f"{base}/out")
    return _shown(spark.read.schema(tracking.OUT).parquet(f"{base}/out"))
