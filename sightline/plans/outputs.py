"""Queries over what leaves the pipeline, injected models and small lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions import colors, text
from sightline.operators import flow, metrics, models, pixels, trees
from sightline.plans.base import PIXELS, query
from sightline.session import new_folder
from sightline.sources import fixtures, schemas, sinks, tables

_BEGIN, _END = "2024-01-01 00:00:00", "2024-01-01 00:05:00"


@query(f"""SELECT s_suppkey AS device_id, 'devices/' || s_suppkey || '/heartbeat' AS topic, strftime(beat, '%Y-%m-%dT%H:%M:%S.000000Z') AS timestamp, 'online' AS status
FROM supplier, (SELECT unnest(range(TIMESTAMP '{_BEGIN}', TIMESTAMP '{_END}', INTERVAL 30 SECOND)) AS beat)""")
def heartbeats(spark, sf_dir):
    """Messages of five minutes, read back from their JSON."""
    devices = fixtures.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("device_id"))
    sent = sinks.heartbeats(devices, F.lit(_BEGIN).cast("timestamp"), F.lit(_END).cast("timestamp"))
    return sent.select("topic", F.from_json("payload", "device_id long, timestamp string, status string").alias("b")).select("topic", "b.*")


@query("""WITH clients AS (SELECT c_custkey AS client_id, c_custkey % 50 AS device_id, c_custkey % 3 = 0 AS open FROM customer)
SELECT event_id, client_id FROM events JOIN clients ON device_id = user_id AND open WHERE event_id % 7 <> 0""")
def client_fanout(spark, sf_dir):
    """Messages for the open clients of their device; every seventh payload is broken and goes to none."""
    e = fixtures.table(spark, sf_dir, "events")
    messages = e.select("event_id", F.col("user_id").alias("device_id"), F.when(F.col("event_id") % 7 == 0, F.lit("broken")).otherwise(F.col("props")).alias("payload"))
    state = F.when(F.col("c_custkey") % 3 == 0, "OPEN").otherwise("CLOSED")
    clients = fixtures.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client_id"), (F.col("c_custkey") % 50).alias("device_id"), state.alias("state"))
    return sinks.to_open_clients(messages, clients).select("event_id", "client_id")


@query("""WITH q AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'a/' || user_id END AS ta, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS pa FROM events)
SELECT ta AS topic, pa AS payload FROM q WHERE ta IS NOT NULL AND pa IS NOT NULL UNION ALL SELECT 'b/' || event_id, props FROM events WHERE event_id % 2 = 0""")
def outbound_flatten(spark, sf_dir):
    """One outbound step: two fields' lists flattened to messages."""
    e = fixtures.table(spark, sf_dir, "events")
    one = F.struct(F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("a/"), F.col("user_id").cast("string"))).alias("topic"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("payload"))
    two = F.when(F.col("event_id") % 2 == 0, F.array(F.struct(F.concat(F.lit("b/"), F.col("event_id").cast("string")).alias("topic"), F.col("props").alias("payload"))))
    return sinks.flatten(e.select(F.array(one).alias("first"), two.alias("second")), ["first", "second"])


@query("SELECT c_custkey AS id, c_name AS name, 'active' AS status FROM customer WHERE c_custkey % 2 = 0")
def insert_returning(spark, sf_dir):
    """The rows of the second of two inserts, as written."""
    path = new_folder(spark, "inserted")
    rows = fixtures.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("active").alias("status"))
    sinks.insert(rows.where("id % 2 = 1"), path)
    return sinks.insert(rows.where("id % 2 = 0"), path)


@query("""WITH first AS (SELECT c_custkey AS id, c_nationkey AS owner, c_name AS name FROM customer WHERE c_custkey % 3 <> 0),
added AS (SELECT c_custkey AS id, c_nationkey AS owner, c_name AS name FROM customer WHERE c_custkey % 3 = 0),
whole AS (SELECT id, owner, CASE WHEN id % 5 = 0 AND id % 2 = 0 THEN 'renamed' ELSE name END AS name FROM (SELECT * FROM first UNION ALL SELECT * FROM added))
SELECT 'inserted' AS change, id, owner, name FROM added UNION ALL SELECT 'updated', id, owner, name FROM whole WHERE id % 5 = 0
UNION ALL SELECT 'deleted', id, owner, name FROM whole WHERE id % 7 = 0 AND owner = 3 UNION ALL SELECT 'left', id, owner, name FROM whole WHERE NOT (id % 7 = 0 AND owner = 3)""")
def stored_changes(spark, sf_dir):
    """What an insert of rows partly there, an update and a delete by owner return, and what the stored table then holds."""
    c = fixtures.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("owner"), F.col("c_name").alias("name"))
    t = tables.StoredTable(spark, new_folder(spark, "stored"), c.schema, "id", buckets=8)
    t.insert(c.where("id % 3 <> 0"))
    added = t.insert(c)
    updated = t.update(c.where("id % 5 = 0").select("id", F.when(F.col("id") % 2 == 0, "renamed").otherwise("").alias("name")))
    deleted = t.remove(c.where("id % 7 = 0").select("id", F.lit(3).cast(c.schema["owner"].dataType).alias("owner")))
    parts = {"inserted": added, "updated": updated, "deleted": deleted, "left": t.read()}
    return reduce(lambda a, b: a.unionByName(b), [df.select(F.lit(name).alias("change"), "id", "owner", "name") for name, df in parts.items()])


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey = 0 THEN NULL ELSE p_partkey // 4 END AS parent_id, p_size FROM part),
t AS (SELECT id, p_size, id AS root, 0 AS depth FROM n WHERE parent_id IS NULL UNION ALL SELECT n.id, n.p_size, t.root, t.depth + 1 FROM t JOIN n ON n.parent_id = t.id)
SELECT root AS id, count(*) AS n_objects, CAST(sum(p_size) AS BIGINT) AS sizes, CAST(max(depth) AS BIGINT) + 1 AS levels FROM t GROUP BY root""")
def detection_json(spark, sf_dir):
    """Detections within detections as nested JSON, all in one tree, counted in what its text says. The text comes in pieces; the
    levels are the most brackets open within a piece after those that the pieces before it (some numbers each) leave open."""
    part = fixtures.table(spark, sf_dir, "part")
    parent = F.when(F.col("p_partkey") != 0, F.floor(F.col("p_partkey") / 4).cast(part.schema["p_partkey"].dataType))
    texts = trees.pieces(part.select(F.col("p_partkey").alias("id"), parent.alias("parent_id"), F.col("p_size").alias("size")), ["id", "size"])
    sizes = F.aggregate(F.regexp_extract_all("payload", F.lit('"size":([0-9]+)'), F.lit(1)), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    brackets = F.aggregate(F.split(F.regexp_replace("payload", "[^\\[\\]]", ""), ""), F.struct(F.lit(0).cast("long").alias("now"), F.lit(0).cast("long").alias("most")),
        lambda a, c: F.struct((a["now"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)).cast("long").alias("now"), F.greatest(a["most"], a["now"] + F.when(c == "[", 1).otherwise(0)).cast("long").alias("most")))
    counts = texts.select("id", "place", F.size(F.regexp_extract_all("payload", F.lit('"id":'), F.lit(0))).cast("long").alias("n"), sizes.alias("sizes"), brackets.alias("b"))
    before = F.coalesce(F.sum("b.now").over(W.partitionBy("id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    levels = counts.select("id", "n", "sizes", (before + F.col("b.most")).alias("levels"))
    return levels.groupBy("id").agg(F.sum("n").alias("n_objects"), F.sum("sizes").alias("sizes"), F.max("levels").alias("levels"))


@query("SELECT event_id AS id, event_type AS label, value AS score FROM events")
def flow_field_mapping(spark, sf_dir):
    e = fixtures.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return flow.map_fields(e, {"event_id": "id", "event_type": "label", "value": "score"})


@query("""WITH i AS (SELECT user_id AS device_id, event_id, CASE event_id % 3 WHEN 0 THEN 'frames.alive' WHEN 1 THEN 'frames.cleaned' ELSE 'fps' END AS name, CASE event_id % 3 WHEN 2 THEN 'rate' ELSE 'memory' END AS type, value FROM events)
SELECT device_id, arg_min(value, event_id) FILTER (ends_with(name, '.alive')) AS alive, arg_min(value, event_id) FILTER (type = 'rate') AS fps FROM i GROUP BY 1""")
def instrument_lookup(spark, sf_dir):
    """The first instrument of each device by suffix and by type."""
    k = F.col("event_id") % 3
    name, kind = F.when(k == 0, "frames.alive").when(k == 1, "frames.cleaned").otherwise("fps"), F.when(k == 2, "rate").otherwise("memory")
    rows = fixtures.table(spark, sf_dir, "events").select(F.col("user_id").alias("device_id"), F.struct("event_id", name.alias("name"), kind.alias("type"), "value").alias("i"))
    held = rows.groupBy("device_id").agg(F.sort_array(F.collect_list("i")).alias("all"))
    first = lambda **by: metrics.first_instrument(F.col("all"), **by)["value"]
    return held.select("device_id", first(suffix=".alive").alias("alive"), first(kind="rate").alias("fps"))


@query("""WITH s AS (SELECT c_custkey AS device_id, c_custkey % 4 <> 1 AS enabled, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 40 END AS frequency,
    CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN [] ELSE ['click', 'view'] END AS instruments FROM customer WHERE c_custkey % 2 = 1)
SELECT event_id, coalesce(greatest(frequency::DOUBLE, 10.0), 30.0) AS interval FROM events LEFT JOIN s ON device_id = user_id
WHERE coalesce(enabled, true) AND (instruments IS NULL OR len(instruments) = 0 OR list_contains(instruments, event_type))""")
def metrics_publish(spark, sf_dir):
    """Instruments that settings publish, and how often."""
    c = F.col("c_custkey")
    listed = F.when(c % 5 == 1, F.array().cast("array<string>")).when(c % 5 != 0, F.array(F.lit("click"), F.lit("view")))
    settings = fixtures.table(spark, sf_dir, "customer").where(c % 2 == 1).select(c.alias("device_id"), (c % 4 != 1).alias("enabled"), F.when(c % 3 != 0, c % 40).alias("frequency"), listed.alias("instruments"))
    rows = fixtures.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("device_id"), F.col("event_type").alias("name"))
    return metrics.published(rows, settings).select("event_id", "interval")


_NOW = "2024-01-30 12:00:00"


@query(f"""WITH a AS (SELECT event_id, ts, CASE WHEN event_id % 50 = 0 THEN NULL ELSE (epoch_us(TIMESTAMP '{_NOW}') - epoch_us(ts)) / 1e6 END AS s FROM events WHERE ts <= TIMESTAMP '{_NOW}'),
said AS (SELECT *, CASE WHEN s IS NULL THEN 'Never' WHEN s < 60 THEN 'Just now' WHEN s < 120 THEN '1 minute ago' WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || ' minutes ago' WHEN s < 7200 THEN '1 hour ago' END AS near, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM a)
SELECT event_id, coalesce(near, stamp) AS seen, coalesce(near, CASE WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || ' hours ago' ELSE stamp END) AS seen_hours,
CASE WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ago' WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || 'h ago' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM said""")
def last_seen_words(spark, sf_dir):
    """The three ways of telling when something was seen."""
    now = F.lit(_NOW).cast("timestamp")
    e = fixtures.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).where(F.col("ts") <= now)
    s = F.when(F.col("event_id") % 50 != 0, (F.unix_micros(now) - F.unix_micros("ts")) / 1e6)
    return e.select("event_id", text.last_seen(s, F.col("ts")).alias("seen"), text.last_seen(s, F.col("ts"), hours=True).alias("seen_hours"), text.ago_or_date(s, F.col("ts")).alias("day"))


@query(f"""WITH {PIXELS} SELECT CASE WHEN s < 20 THEN CASE WHEN v > 80 THEN 'white' WHEN v < 30 THEN 'black' ELSE 'gray' END
ELSE CASE {" ".join(f"WHEN h < {end} THEN '{name}'" for end, name in colors.SIMPLE_HUES)} END END AS color, count(*) AS n FROM hsv GROUP BY 1""")
def simple_color_name(spark, sf_dir):
    px = pixels.with_hsv(fixtures.pixels(spark, sf_dir))
    return px.groupBy(colors.simple_name(F.col("h"), F.col("s"), F.col("v")).alias("color")).agg(F.count("*").alias("n"))


@query("""SELECT event_id AS det_id, unnest(range(1, event_id % 3 + 1)) AS box, round(value * unnest(range(1, event_id % 3 + 1)), 6) AS size FROM events WHERE event_id % 3 > 0""")
def injected_detector(spark, sf_dir):
    """A detector that gives none to two boxes a picture (a deterministic stand-in), run over batches."""

    def load():
        import pandas as pd

        def detect(batch):
            rows = [(i, k, round(v * k, 6)) for i, v in zip(batch["event_id"], batch["value"], strict=True) for k in range(1, i % 3 + 1)]
            return pd.DataFrame(rows, columns=["det_id", "box", "size"])

        return detect

    e = fixtures.table(spark, sf_dir, "events").select("event_id", "value")
    return models.explode(e, load, "det_id long, box long, size double")


@query("SELECT event_id, round(value * 2 + user_id, 6) AS score, value * 2 + user_id >= 60 AS hit FROM events")
def injected_attributes(spark, sf_dir):
    """A model that adds columns to rows (a deterministic stand-in)."""

    def load():
        import pandas as pd

        def predict(batch):
            score = batch["value"] * 2 + batch["user_id"]
            return pd.DataFrame({"score": score, "hit": score >= 60})

        return predict

    e = fixtures.table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return models.apply(e, load, ["value", "user_id"], "score double, hit boolean").select("event_id", F.round("score", 6).alias("score"), "hit")


#: Schemas of two kinds of messages.
_SCHEMAS = {
    "devices/+/click": {
        "type": "object", "required": ["id", "kind", "box"], "additionalProperties": False,
        "properties": {"id": {"type": "integer", "minimum": 0}, "kind": {"enum": ["click", 1]}, "box": {"$ref": "#/definitions/box"}, "note": {"type": ["string", "null"], "maxLength": 5}, "at": {"type": "string", "format": "date-time"}},
        "definitions": {"box": {"type": "array", "minItems": 4, "maxItems": 4, "items": {"type": "number", "maximum": 100}}},
    },
    "devices/+/view": {"type": "object", "oneOf": [{"required": ["a"], "properties": {"a": {"const": "x"}}}, {"required": ["b"]}], "additionalProperties": {"type": "string", "pattern": "^[a-z]+$"}},
}
_CLICK = """'{"id": ' || CASE WHEN event_id % 11 = 0 THEN '-1' WHEN event_id % 11 = 1 THEN '1.5' ELSE CAST(event_id AS STRING) END || ', "kind": ' || CASE event_id % 7 WHEN 0 THEN '1' WHEN 1 THEN '"no"' ELSE '"click"' END
|| ', "box": [1, 2.5, ' || CASE WHEN event_id % 13 = 0 THEN '101' ELSE '3' END || CASE WHEN event_id % 17 = 0 THEN '' ELSE ', 4' END || ']' || CASE event_id % 5 WHEN 0 THEN ', "note": null' WHEN 1 THEN ', "note": "longer"' WHEN 2 THEN ', "more": 1' WHEN 3 THEN ', "at": "2024-01-01T00:00:00Z"' ELSE '' END || '}'"""
_VIEW = """CASE event_id % 6 WHEN 0 THEN '{"a": "x"}' WHEN 1 THEN '{"a": "x", "b": "y"}' WHEN 2 THEN '{"b": "y", "c": "z"}' WHEN 3 THEN '{"b": "Y"}' WHEN 4 THEN 'no json' ELSE '[]' END"""


@query("""SELECT event_id, CASE event_type
    WHEN 'click' THEN event_id % 11 > 1 AND event_id % 7 <> 1 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 5 NOT IN (1, 2)
    WHEN 'view' THEN event_id % 6 IN (0, 2) ELSE false END AS valid FROM events""")
def schema_validate(spark, sf_dir):
    """Messages checked against the JSON Schema of their topic; topics without one are rejected."""
    e = fixtures.table(spark, sf_dir, "events")
    topic = F.concat(F.lit("devices/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"))
    payload = F.when(F.col("event_type") == "click", F.expr(_CLICK)).when(F.col("event_type") == "view", F.expr(_VIEW)).otherwise(F.col("props"))
    return schemas.by_topic(e.select("event_id", topic.alias("topic"), payload.alias("payload")), _SCHEMAS).select("event_id", "valid")
