"""Queries over metric points and bounded histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import history, instruments, metrics, queues, routing
from sightline.plans.base import MESSAGES, POINTS, query
from sightline.sources import fixtures

_W = f"WITH RECURSIVE {POINTS}"
_START, _AS_OF = "2024-01-01 00:00:00", "2024-01-31 00:00:00"


def _points(spark, sf_dir):
    return fixtures.datapoints(spark, sf_dir)


def _ts(text: str):
    return F.lit(text).cast("timestamp")


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(f"{_W} SELECT series, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, count(*) AS count, arg_max(value, seq) AS last FROM points GROUP BY 1")
def metric_summary(spark, sf_dir):
    return _round(metrics.summary(_points(spark, sf_dir), ["series"]), "avg")


@query(f"{_W} SELECT series, device_id, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, count(*) AS count, arg_max(value, seq) AS last FROM points WHERE series IN ('pipeline.fps', 'memory.track') GROUP BY 1, 2")
def metric_instruments(spark, sf_dir):
    """Instruments per device, of the series that a whitelist names."""
    allowed = _points(spark, sf_dir).where(F.col("series").isin("pipeline.fps", "memory.track"))
    return _round(metrics.summary(allowed, ["series", "device_id"]), "avg")


@query(f"{_W} SELECT series, round(count(*) / date_diff('second', TIMESTAMP '{_START}', TIMESTAMP '{_AS_OF}')::DOUBLE, 9) AS rate FROM points GROUP BY 1")
def metric_rate(spark, sf_dir):
    return _round(metrics.rate(_points(spark, sf_dir), ["series"], _ts(_START), _ts(_AS_OF)), "rate", digits=9)


@query(f"""{_W} SELECT series, device_id, count(*) AS count, array_to_string(list_reverse(list_sort(list({{'s': seq, 'v': value}}), 'DESC')[1:5]).list_transform(lambda x: CAST(CAST(round(x.v * 100) AS BIGINT) AS VARCHAR)), ',') AS samples FROM points GROUP BY 1, 2""")
def metric_recent_samples(spark, sf_dir):
    out = metrics.recent(_points(spark, sf_dir), ["series", "device_id"], 5)
    return out.withColumn("samples", F.array_join(F.transform("samples", lambda v: F.round(v * 100).cast("long").cast("string")), ","))


_LIFE = """made AS (SELECT l_orderkey * 8 + l_linenumber AS object_id, l_returnflag AS kind, l_shipdate AS ts, CAST(l_quantity AS BIGINT) AS bytes, l_linestatus FROM lineitem),
born AS (SELECT kind, object_id, min(ts) AS ts, max(bytes) AS bytes FROM made GROUP BY ALL), gone AS (SELECT DISTINCT object_id FROM made WHERE l_linestatus = 'F'),
aged AS (SELECT born.*, object_id NOT IN (SELECT object_id FROM gone) AS alive, date_diff('second', ts, TIMESTAMP '1999-01-01')::DOUBLE AS age FROM born)"""


@query(f"""WITH {_LIFE} SELECT kind, count(*) AS tracked, count(*) FILTER (NOT alive) AS cleaned, count(*) FILTER (alive) AS alive, count(*) FILTER (alive AND age > 1e8) AS leaked,
CAST(coalesce(sum(bytes) FILTER (alive AND age > 1e8), 0) AS BIGINT) AS leaked_bytes, max(age) FILTER (alive AND age > 1e8) AS max_age, round(avg(age) FILTER (alive), 3) AS avg_age FROM aged GROUP BY 1""")
def lifetime_leaks(spark, sf_dir):
    li = fixtures.table(spark, sf_dir, "lineitem")
    made = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("object_id"), F.col("l_returnflag").alias("kind"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_quantity").cast("long").alias("bytes"), "l_linestatus")
    born = made.groupBy("kind", "object_id").agg(F.min("ts").alias("ts"), F.max("bytes").alias("bytes"))
    return _round(metrics.lifetimes(born, made.where("l_linestatus = 'F'"), _ts("1999-01-01"), 1e8), "avg_age", digits=3)


@query(f"""{_W}, s AS (SELECT series, avg(value) AS a, count(*) AS n FROM points GROUP BY 1)
SELECT series AS name, CASE series WHEN 'pipeline.fps' THEN 'rate' WHEN 'pipeline.duration' THEN 'avg_duration' ELSE 'counter' END AS type,
round(CASE series WHEN 'pipeline.fps' THEN n / 2592000.0 WHEN 'pipeline.duration' THEN a ELSE n END, 6) AS value FROM s WHERE series <> 'memory.track'
UNION ALL SELECT 'memory.track.alive', 'memory', n FROM s WHERE series = 'memory.track' UNION ALL SELECT 'memory.track.cleaned', 'memory', n // 3 FROM s WHERE series = 'memory.track'
UNION ALL SELECT 'memory.track.leaked', 'memory', n // 10 FROM s WHERE series = 'memory.track' AND n // 10 > 0""")
def metric_unpivot(spark, sf_dir):
    s = metrics.summary(_points(spark, sf_dir), ["series"])
    when = lambda name, c: F.when(F.col("series") == name, c)
    stats = s.select(
        "series",
        when("pipeline.fps", F.col("count") / 2592000.0).alias("rate"),
        when("pipeline.duration", F.col("avg")).alias("avg"),
        "count",
        when("memory.track", F.col("count")).alias("alive"),
        when("memory.track", F.floor(F.col("count") / 3)).alias("cleaned"),
        when("memory.track", F.floor(F.col("count") / 10)).alias("leaked"),
    )
    return _round(metrics.instrument_rows(stats, "series"), "value")


@query("""SELECT count(*) AS seen, count(*) FILTER (event_type = 'click') AS confirmed, count(*) FILTER (event_type = 'error') AS rejected, count(DISTINCT user_id) AS devices,
round(coalesce(avg(value) FILTER (event_type = 'purchase'), 0), 6) AS avg_inference FROM events""")
def running_counters(spark, sf_dir):
    e = fixtures.table(spark, sf_dir, "events")
    of = lambda kind: F.col("event_type") == kind
    return _round(metrics.counters(e, {"confirmed": of("click"), "rejected": of("error")}, "user_id", F.when(of("purchase"), F.col("value"))), "avg_inference")


@query(f"""{_W}, first AS (SELECT device_id, arg_min(series, seq) AS series FROM points GROUP BY 1)
SELECT device_id, count(*) AS count, round(avg(value), 6) AS avg FROM points JOIN first USING (device_id, series) GROUP BY 1""")
def metric_bound(spark, sf_dir):
    return _round(metrics.bound(_points(spark, sf_dir), "device_id", "series"), "avg")


@query(f"{_W} SELECT series, device_id, round(sum(value), 4) AS sum, count(*) AS count FROM points GROUP BY 1, 2")
def metric_histogram_by_attr(spark, sf_dir):
    return _round(metrics.histogram(_points(spark, sf_dir), ["series"], "device_id"), "sum", digits=4)


@query(f"""{_W} SELECT series, device_id, seq, count(*) OVER w AS count, round(sum(value) OVER w, 4) AS sum FROM points WINDOW w AS (PARTITION BY series, device_id ORDER BY seq ROWS 2 PRECEDING)""")
def metric_evicting_window(spark, sf_dir):
    return _round(metrics.evicting(_points(spark, sf_dir), ["series", "device_id"], 3), "sum", digits=4)


@query(f"""{_W}, ranked AS (SELECT *, row_number() OVER (PARTITION BY series, device_id ORDER BY seq) AS n FROM points),
run AS (SELECT series, device_id, n, value AS e FROM ranked WHERE n = 1 UNION ALL
    SELECT r.series, r.device_id, r.n, run.e * 0.8::DOUBLE + r.value * 0.2::DOUBLE FROM run JOIN ranked r ON r.series = run.series AND r.device_id = run.device_id AND r.n = run.n + 1)
SELECT series, device_id, round(arg_max(e, n), 4) AS ewma FROM run GROUP BY 1, 2""")
def ewma_duration(spark, sf_dir):
    return _round(metrics.ewma(_points(spark, sf_dir), ["series", "device_id"]), "ewma", digits=4)


@query(f"""{_W}, ranked AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY seq) AS n FROM points WHERE series = 'pipeline.duration'),
run AS (SELECT device_id, n, value AS e FROM ranked WHERE n = 1 UNION ALL
    SELECT r.device_id, r.n, run.e * 0.8::DOUBLE + r.value * 0.2::DOUBLE FROM run JOIN ranked r ON r.device_id = run.device_id AND r.n = run.n + 1),
last AS (SELECT device_id, arg_max(e, n) AS ewma FROM run GROUP BY 1)
SELECT c_custkey AS device_id, round(100 + coalesce(ewma, nullif(c_custkey % 3 * 250.0, 0), 1000.0) / 1000, 6) AS done FROM customer LEFT JOIN last ON device_id = c_custkey""")
def predicted_completion(spark, sf_dir):
    """When each device's next run, begun at second 100, will be done."""
    past = metrics.ewma(_points(spark, sf_dir).where("series = 'pipeline.duration'"), ["device_id"])
    tasks = fixtures.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device_id"), (F.col("c_custkey") % 3 * 250.0).cast("double").alias("budget"))
    return tasks.join(past, "device_id", "left").select("device_id", F.round(metrics.completion(F.col("ewma"), F.lit(100.0), F.col("budget")), 6).alias("done"))


@query(f"""{_W} SELECT device_id, arg_max(value, seq) FILTER (series = 'pipeline.fps') AS fps, arg_max(value, seq) FILTER (series = 'pipeline.duration') AS avg_duration,
arg_max(value, seq) FILTER (series = 'cache.objects') AS cache_objects, arg_max(value, seq) FILTER (series = 'cache.references') AS cache_references FROM points WHERE series <> 'memory.track' GROUP BY 1""")
def metrics_pivot_latest(spark, sf_dir):
    columns = {"pipeline.fps": "fps", "pipeline.duration": "avg_duration", "cache.objects": "cache_objects", "cache.references": "cache_references"}
    return metrics.pivot_latest(_points(spark, sf_dir), "device_id", columns)


@query(f"{_W} SELECT device_id, seq, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, seq DESC) AS place FROM points) WHERE place <= 3")
def last_n_per_device(spark, sf_dir):
    return history.last_n(_points(spark, sf_dir), ["device_id"], ["ts", "seq"], 3).select("device_id", "seq", "place")


@query(f"{_W} SELECT device_id, series, max(seq) AS seq, arg_max(value, seq) AS value FROM points GROUP BY 1, 2")
def keep_latest(spark, sf_dir):
    return history.latest(_points(spark, sf_dir).select("device_id", "series", "ts", "seq", "value"), ["device_id", "series"], ["ts", "seq"]).select("device_id", "series", "seq", "value")


@query(f"{_W} SELECT device_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY seq) AS n FROM points) WHERE n % 2 = 0")
def decimate_n(spark, sf_dir):
    return history.decimate(_points(spark, sf_dir), ["device_id"], ["ts", "seq"], 2).select("device_id", "seq")


@query(f"{_W} SELECT device_id, seq FROM points QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY seq) <= 4")
def drop_newest_first_n(spark, sf_dir):
    return history.first_n(_points(spark, sf_dir), ["device_id"], ["ts", "seq"], 4).select("device_id", "seq")


@query(f"{_W} SELECT device_id, seq, row_number() OVER (PARTITION BY device_id ORDER BY seq) <= 4 AS kept, true AS accepted FROM points")
def drop_newest_flags(spark, sf_dir):
    return history.offered(_points(spark, sf_dir), ["device_id"], ["ts", "seq"], 4).select("device_id", "seq", "kept", "accepted")


@query(f"{_W} SELECT series, device_id, seq FROM points QUALIFY row_number() OVER (PARTITION BY series, device_id ORDER BY seq DESC) <= CASE series WHEN 'pipeline.fps' THEN 5 ELSE 2 END")
def ring_buffer_by_kind(spark, sf_dir):
    """Capacity of a ring buffer that depends on the kind of message."""
    cap = F.when(F.col("series") == "pipeline.fps", 5).otherwise(2)
    return history.ring_by_kind(_points(spark, sf_dir), ["series", "device_id"], ["ts", "seq"], cap, 5).select("series", "device_id", "seq")


@query(f"""{_W}, f AS (SELECT series, device_id, seq, ts, min(ts) OVER w AS first, row_number() OVER (PARTITION BY series, device_id ORDER BY seq) AS n FROM points WINDOW w AS (PARTITION BY series, device_id))
SELECT series, device_id, min(seq) AS seq FROM f WHERE n >= 3 AND epoch(ts) - epoch(first) <= 864000 GROUP BY 1, 2""")
def confirmation_window(spark, sf_dir):
    """The first point at which a series has three points within ten days of its first."""
    return history.confirmed_within(_points(spark, sf_dir), ["series", "device_id"], ["ts", "seq"], 3, 864000)


@query(f"""{_W}, t AS (SELECT device_id, epoch(ts) AS s FROM points),
run AS (SELECT device_id, min(s) AS s, 1 AS run FROM t GROUP BY 1 UNION ALL
    (SELECT run.device_id, min(t.s), any_value(run.run) + 1 FROM run JOIN t ON t.device_id = run.device_id AND t.s - run.s >= 172800 GROUP BY run.device_id))
SELECT device_id, round(s, 3) AS seconds, CAST(run AS BIGINT) AS run FROM run""")
def interval_gate(spark, sf_dir):
    return routing.interval_gate(_points(spark, sf_dir), "device_id", "ts", 172800.0).withColumn("seconds", F.round("seconds", 3))


@query(f"""{_W} SELECT device_id, series, coalesce(epoch(TIMESTAMP '{_AS_OF}') - epoch(max(ts)) < CASE series WHEN 'pipeline.fps' THEN 259200 ELSE 86400 END, false) AS live FROM points GROUP BY 1, 2""")
def ttl_live_keys(spark, sf_dir):
    newest = _points(spark, sf_dir).groupBy("device_id", "series").agg(F.max("ts").alias("ts"))
    live = F.when(F.col("series") == "pipeline.fps", history.alive(F.col("ts"), _ts(_AS_OF), 259200)).otherwise(history.alive(F.col("ts"), _ts(_AS_OF), 86400))
    return newest.select("device_id", "series", live.alias("live"))


@query(f"{_W} SELECT device_id, seq, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY seq) AS BIGINT) - 1 AS position FROM points")
def mask_positions(spark, sf_dir):
    """Running sum of a mask, less one."""
    position = history.running_mask(F.col("value") > 50, ["device_id"], ["ts", "seq"]) - 1
    return _points(spark, sf_dir).select("device_id", "seq", position.alias("position"))


@query(f"""WITH {MESSAGES}, e AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'error' THEN 40 WHEN 'purchase' THEN 30 WHEN 'signup' THEN 20 ELSE 10 END AS level FROM events)
SELECT user_id AS device_id, event_id AS msg_id, level FROM e WHERE level >= 20 QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_id) <= 2""")
def log_rate_cap(spark, sf_dir):
    """Log records of a level or above, a few per bucket of time and device."""
    level = F.when(F.col("event_type") == "error", 40).when(F.col("event_type") == "purchase", 30).when(F.col("event_type") == "signup", 20).otherwise(10)
    logs = fixtures.table(spark, sf_dir, "events").select(F.col("user_id").alias("device_id"), F.col("event_id").alias("msg_id"), F.col("ts").cast("timestamp").alias("ts"), level.alias("level"))
    return history.rate_cap(logs.where("level >= 20"), ["device_id"], "ts", ["msg_id"], 86_400_000, 2).select("device_id", "msg_id", "level")


#: A device's log queue: room for three records, one of which leaves at the end of each tick of twelve hours.
_ROOM, _TICK_MS = 3, 43_200_000


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS device_id, event_id AS msg_id, CAST(epoch_us(ts) // {_TICK_MS * 1000} AS BIGINT) AS tick FROM events WHERE event_type <> 'error'),
came AS (SELECT device_id, tick, count(*) AS n, row_number() OVER (PARTITION BY device_id ORDER BY tick) AS i FROM e GROUP BY 1, 2),
run AS (SELECT device_id, tick, n, i, CAST(0 AS BIGINT) AS waiting, least(n, {_ROOM}) AS accepted FROM came WHERE i = 1
    UNION ALL SELECT device_id, c.tick, c.n, c.i, left_over, least(c.n, {_ROOM} - left_over)
    FROM (SELECT run.device_id, c, greatest(0, run.waiting + run.accepted - (c.tick - run.tick)) AS left_over FROM run JOIN came AS c ON c.device_id = run.device_id AND c.i = run.i + 1)),
placed AS (SELECT *, row_number() OVER (PARTITION BY device_id, tick ORDER BY msg_id) AS nth FROM e)
SELECT device_id, msg_id, tick, nth <= accepted AS kept, CASE WHEN nth <= accepted THEN tick + waiting + nth - 1 END AS sent_tick FROM placed JOIN run USING (device_id, tick)""")
def log_queue(spark, sf_dir):
    """Log records of a level or above in a bounded queue: which find room, and when those leave."""
    logs = fixtures.table(spark, sf_dir, "events").where("event_type <> 'error'").select(F.col("user_id").alias("device_id"), F.col("event_id").alias("msg_id"), "ts")
    return queues.bounded(logs, ["device_id"], "ts", ["msg_id"], capacity=_ROOM, drain=1, tick_ms=_TICK_MS, slot_ticks=16).drop("ts")


_SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@query(f"""{_W}, b AS (SELECT series, CASE WHEN value > 0 THEN ceil(ln(value) / ln(1.01 / 0.99)) END AS k, count(*) AS n FROM points WHERE value IS NOT NULL GROUP BY 1, 2),
ranked AS (SELECT series, k, sum(n) OVER (PARTITION BY series ORDER BY k NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY series) AS total FROM b)
SELECT series, CAST(max(total) AS BIGINT) AS n, {', '.join(f"round(coalesce(2 * pow(1.01 / 0.99, min(k) FILTER (upto > floor({q} * (total - 1)))) / (1.01 / 0.99 + 1), 0), 6) AS {name}" for name, q in _SHARES.items())} FROM ranked GROUP BY series""")
def metric_quantiles(spark, sf_dir):
    """Quantiles of each series within one percent, by a pluggable instrument."""
    return _round(instruments.measure(_points(spark, sf_dir), ["series"], instruments.Quantiles(_SHARES, 0.01)), *_SHARES)


@query(f"""{_W}, s AS (SELECT device_id, avg(value) AS fps, count(*) AS n FROM points WHERE series = 'pipeline.fps' GROUP BY 1)
SELECT device_id, CASE WHEN fps >= 25 THEN 'good' WHEN fps >= 15 THEN 'fair' ELSE 'poor' END AS band, round(least(100, fps), 4) AS pct, round(CASE WHEN fps <= 0 THEN 1 ELSE 1 / fps END, 6) AS frame_seconds FROM s""")
def fps_bands(spark, sf_dir):
    fps = _points(spark, sf_dir).where("series = 'pipeline.fps'").groupBy("device_id").agg(F.avg("value").alias("fps"))
    return fps.select("device_id", metrics.fps_band(F.col("fps")).alias("band"), F.round(F.least(F.lit(100.0), F.col("fps")), 4).alias("pct"), F.round(metrics.frame_seconds(F.col("fps")), 6).alias("frame_seconds"))


@query(f"""{_W}, s AS (SELECT device_id, min(ts) AS start_time, sum(value) AS total, count(*) AS n FROM points GROUP BY 1)
SELECT device_id, CAST(start_time AS DATE)::VARCHAR AS start_day, n AS count, round(total, 4) AS total FROM s""")
def session_export(spark, sf_dir):
    """Totals of a device's session as a JSON document, read back."""
    said = metrics.session_document(_points(spark, sf_dir), "device_id")
    back = said.select("device_id", F.from_json("document", "start_day string, instruments array<struct<name string, total double, count long>>").alias("d"))
    only = F.get("d.instruments", F.lit(0))
    return back.select("device_id", "d.start_day", only["count"].alias("count"), F.round(only["total"], 4).alias("total"))
