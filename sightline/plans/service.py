"""Queries over devices, messages, configurations and strings."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions import text
from sightline.operators import configs, devices, flow, history, requests, trees
from sightline.plans.base import MESSAGES, query
from sightline.sources import bus, fixtures, images
from sightline.vocab import ATTRIBUTES, CATEGORIES

_AS_OF = "2024-01-31 00:00:00"
_DEV = """dev AS (SELECT c_custkey AS device_id, c_name AS name, CASE WHEN c_nationkey = 0 THEN NULL ELSE c_nationkey END AS owner_id,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'connected' WHEN 'MACHINERY' THEN 'registered' ELSE c_mktsegment END AS status FROM customer),
seen AS (SELECT user_id AS device_id, max(ts) AS last_seen FROM events GROUP BY 1)"""


def _table(spark, sf_dir, name):
    return fixtures.table(spark, sf_dir, name)


def _devices(spark, sf_dir):
    segment = F.col("c_mktsegment")
    status = F.when(segment == "BUILDING", "connected").when(segment == "MACHINERY", "registered").otherwise(segment)
    owner = F.when(F.col("c_nationkey") != 0, F.col("c_nationkey"))
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device_id"), F.col("c_name").alias("name"), owner.alias("owner_id"), status.alias("status"))


def _seen(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("device_id")).agg(F.max(F.col("ts").cast("timestamp")).alias("last_seen"))


@query(f"WITH {_DEV} SELECT device_id, name, CASE WHEN device_id IN (SELECT device_id FROM seen) THEN 'connected' ELSE 'disconnected' END AS status FROM dev WHERE owner_id = 3 OR owner_id IS NULL")
def device_list_online(spark, sf_dir):
    mine = devices.visible(_devices(spark, sf_dir), F.lit(3))
    return devices.with_online(mine, _seen(spark, sf_dir)).select("device_id", "name", "status")


@query(f"WITH {_DEV} SELECT device_id, status FROM dev WHERE owner_id = 3 OR owner_id IS NULL OR status = 'connected'")
def device_list_active(spark, sf_dir):
    return devices.visible(_devices(spark, sf_dir), F.lit(3), connected_too=True).select("device_id", "status")


@query(f"""WITH {_DEV} SELECT device_id, CASE WHEN status IN ('manufactured', 'registered', 'connected', 'disconnected') THEN status ELSE 'disconnected' END AS status,
coalesce(epoch(TIMESTAMP '{_AS_OF}') - epoch(last_seen) < 86400, false) AS alive, CAST(row_number() OVER (ORDER BY last_seen DESC NULLS FIRST, device_id) AS BIGINT) AS place FROM dev LEFT JOIN seen USING (device_id) QUALIFY place <= 50""")
def admin_devices(spark, sf_dir):
    """The first page of devices, those never seen first."""
    out = _devices(spark, sf_dir).join(_seen(spark, sf_dir), "device_id", "left")
    first = history.page(out, [F.desc_nulls_first("last_seen"), F.col("device_id")], 50)
    live = devices.is_alive(F.col("last_seen"), F.lit(_AS_OF).cast("timestamp"), 86400)
    rows = first.select("device_id", devices.normal_status(F.col("status")).alias("status"), live.alias("alive"), "last_seen")
    return rows.select("device_id", "status", "alive", F.row_number().over(W.orderBy(F.desc_nulls_first("last_seen"), "device_id")).cast("long").alias("place"))


@query(f"WITH {MESSAGES} SELECT msg_id, topic FROM messages WHERE topic = 'devices/7/click' ORDER BY ts DESC, msg_id DESC LIMIT 10 OFFSET 5")
def device_messages_page(spark, sf_dir):
    mine = fixtures.messages(spark, sf_dir).where("topic = 'devices/7/click'")
    return history.page(mine, [F.desc("ts"), F.desc("msg_id")], 10, 5).select("msg_id", "topic")


@query("""SELECT event_id AS alert_id, p_name AS search_string FROM events LEFT JOIN part ON p_partkey = event_id * 7""")
def alert_enriched(spark, sf_dir):
    alerts = _table(spark, sf_dir, "events").select(F.col("event_id").alias("alert_id"), (F.col("event_id") * 7).alias("watchlist_item_id"))
    terms = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("term_id"), F.col("p_name").alias("search_string"))
    return devices.enrich_alerts(alerts, terms).select("alert_id", "search_string")


@query("""SELECT event_id AS alert_id, coalesce(CAST(json_extract_string(props, '$.confidence') AS DOUBLE), 0) AS confidence, coalesce(json_extract_string(props, '$.category'), 'unknown') AS category,
coalesce(json_extract_string(props, '$.bbox'), '[0,0,0,0]') AS bbox, coalesce('data:image/jpeg;base64,' || to_base64(encode(event_type)), '') AS image FROM events""")
def alert_to_detection(spark, sf_dir):
    """Alerts as detections with defaults for what they lack, and a picture as a data URI."""
    field = lambda n: F.get_json_object("props", f"$.{n}")
    image = F.concat(F.lit("data:image/jpeg;base64,"), F.base64(F.encode("event_type", "UTF-8")))
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("alert_id"), F.coalesce(field("confidence").cast("double"), F.lit(0.0)).alias("confidence"), F.coalesce(field("category"), F.lit("unknown")).alias("category"), F.coalesce(field("bbox"), F.lit("[0,0,0,0]")).alias("bbox"), F.coalesce(image, F.lit("")).alias("image"))


@query("SELECT o_orderkey AS msg_id, o_custkey AS device_id FROM orders WHERE o_custkey IN (SELECT user_id FROM events)")
def orphan_skip(spark, sf_dir):
    msgs = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("msg_id"), F.col("o_custkey").alias("device_id"))
    return devices.known_only(msgs, _seen(spark, sf_dir)).select("msg_id", "device_id")


@query("SELECT l_orderkey AS det_id, l_partkey AS term_id, l_linenumber AS line FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 5)")
def user_detections(spark, sf_dir):
    det = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("det_id"), F.col("l_partkey").alias("term_id"), F.col("l_linenumber").alias("line"))
    terms = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("term_id"), F.col("p_size").alias("user_id"))
    return devices.of_user(det, terms, F.lit(5))


@query("SELECT l_orderkey AS det_id, l_linenumber AS line FROM lineitem WHERE l_partkey = 11 ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_extendedprice LIMIT 10 OFFSET 5")
def term_detections_page(spark, sf_dir):
    det = _table(spark, sf_dir, "lineitem").where("l_partkey = 11")
    return history.page(det, [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice")], 10, 5).select(F.col("l_orderkey").alias("det_id"), F.col("l_linenumber").alias("line"))


@query(f"WITH {_DEV} SELECT s_suppkey AS term_id, device_id FROM supplier JOIN dev ON s_nationkey = owner_id")
def publish_fanout(spark, sf_dir):
    terms = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("term_id"), F.col("s_nationkey").alias("user_id"))
    return devices.fan_out(terms, _devices(spark, sf_dir)).select("term_id", "device_id")


@query("""SELECT user_id AS device_id, max(event_id) AS seq, coalesce(CASE WHEN arg_max(event_type, event_id) = 'click' THEN NULL ELSE arg_max(event_type, event_id) END, CAST(user_id AS VARCHAR)) AS name,
'unknown' AS type, '' AS ip FROM events GROUP BY user_id""")
def device_upsert(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    name = F.when(F.col("event_type") != "click", F.col("event_type"))
    reg = e.select(F.col("user_id").alias("device_id"), F.col("event_id").alias("seq"), "ts", name.alias("name"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("ip"))
    return devices.upsert(reg, ["ts", "seq"]).drop("ts")


@query("""WITH ends AS (SELECT user_id, max(event_id) AS closed FROM events WHERE event_type = 'error' GROUP BY 1),
begun AS (SELECT user_id, min(event_id) FILTER (closed IS NULL OR event_id > closed) AS since FROM events LEFT JOIN ends USING (user_id) WHERE event_type = 'signup' GROUP BY 1)
SELECT b.user_id AS device_id, since IS NOT NULL AS open, strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS since FROM begun b LEFT JOIN events e ON e.event_id = b.since""")
def session_state(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("device_id"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    return devices.session_state(e, "signup", "error").withColumn("since", F.date_format("since", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT user_id AS device_id, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last_seen FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def heartbeat_last_seen(spark, sf_dir):
    beats = _table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    return beats.groupBy(F.col("user_id").alias("device_id")).agg(F.date_format(F.max(F.col("ts").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_seen"))


_KIND = "CASE event_type WHEN 'click' THEN 'metrics' WHEN 'view' THEN 'heartbeat' WHEN 'signup' THEN 'register' WHEN 'error' THEN 'logs' ELSE 'alerts' END"


@query(f"SELECT {_KIND} AS kind, {_KIND} IN ('register', 'status', 'heartbeat', 'alerts') AS stored, count(*) AS n FROM events GROUP BY 1, 2")
def ingest_type_split(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(F.expr(_KIND).alias("kind")).groupBy("kind", bus.stored(F.col("kind")).alias("stored")).agg(F.count("*").alias("n"))


_CFG = "cfg AS (SELECT o_custkey AS owner, o_orderkey AS save_id, o_orderpriority AS body, row_number() OVER w AS version, lead(1) OVER w IS NULL AS is_active FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"


def _configs(spark, sf_dir):
    saves = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("save_id"), F.col("o_orderpriority").alias("body"), "o_orderdate")
    return configs.versions(saves, "owner", ["o_orderdate", "save_id"]).drop("o_orderdate")


@query(f"WITH {_CFG} SELECT owner, save_id, CAST(version AS INT) AS version, is_active FROM cfg")
def config_versions(spark, sf_dir):
    return _configs(spark, sf_dir).select("owner", "save_id", "version", "is_active")


@query("SELECT o_custkey AS owner, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS save_id FROM orders GROUP BY 1")
def config_active(spark, sf_dir):
    """The newest configuration, as a grouped maximum that needs no window."""
    saves = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("save_id"), "o_orderdate")
    return history.latest(saves, ["owner"], ["o_orderdate", "save_id"]).select("owner", "save_id")


@query(f"WITH {_CFG} SELECT c.owner, c.save_id, c.body, 'Rollback to version 2' AS description, CAST(t.top + 1 AS INT) AS version, true AS is_active FROM cfg c JOIN (SELECT owner, max(version) AS top FROM cfg GROUP BY 1) t USING (owner) WHERE c.version = 2")
def config_rollback(spark, sf_dir):
    asked = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.lit(2).alias("to_version"))
    return configs.rollback(_configs(spark, sf_dir), asked, "owner")


@query("""WITH asked AS (SELECT DISTINCT lower(split_part(c_name, '#', 1)) || (c_custkey % 997) || '@mail.example' AS email FROM customer),
users AS (SELECT 'customer' || s_suppkey || '@mail.example' AS email FROM supplier) SELECT email, split_part(email, '@', 1) AS name FROM asked WHERE email NOT IN (SELECT email FROM users)""")
def find_or_create(spark, sf_dir):
    email = F.concat(F.lower(F.split_part("c_name", F.lit("#"), F.lit(1))), (F.col("c_custkey") % 997).cast("string"), F.lit("@mail.example"))
    asked = _table(spark, sf_dir, "customer").select(email.alias("email"), F.lit(None).cast("string").alias("name"))
    users = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("customer"), F.col("s_suppkey").cast("string"), F.lit("@mail.example")).alias("email"))
    return devices.find_or_create(asked, users)


@query("""SELECT c_custkey AS device_id, CASE WHEN s_suppkey % 2 = 1 THEN s_name ELSE c_name END AS name, coalesce(nullif(s_nationkey, 0), c_nationkey) AS owner_id FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def partial_update(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("owner_id"))
    changes = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("device_id"), F.when(F.col("s_suppkey") % 2 == 1, F.col("s_name")).otherwise(F.lit("")).alias("name"), F.col("s_nationkey").alias("owner_id"))
    return devices.partial_update(rows, changes, "device_id")


_ASKED = "SELECT s_suppkey, s_nationkey FROM supplier"


@query(f"SELECT c_custkey AS device_id, (c_custkey, c_nationkey) IN ({_ASKED}) AS deleted FROM customer")
def delete_owned(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device_id"), F.col("c_nationkey").alias("owner_id"))
    asked = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("device_id"), F.col("s_nationkey").alias("owner_id"))
    stay, gone = devices.delete_owned(rows, asked, "device_id", "owner_id")
    return stay.select("device_id", F.lit(False).alias("deleted")).union(gone.select("device_id", F.lit(True)))


@query("SELECT n_name AS name, 'nation' AS origin FROM nation UNION ALL SELECT * FROM (VALUES ('lab', 'default')) AS d(name, origin) WHERE name NOT IN (SELECT n_name FROM nation)")
def seed_if_absent(spark, sf_dir):
    have = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("origin"))
    first = have.agg(F.min("name").alias("name")).select("name", F.lit("default").alias("origin"))
    return devices.seed(have, spark.createDataFrame([("lab", "default")], "name string, origin string").union(first), "name")


@query("""SELECT conv_id, turn, role, length(coalesce(text, '')) AS chars FROM conversations
UNION ALL SELECT conv_id, turn + 1, 'assistant', length('echo: ' || coalesce(text, '')) FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS n FROM conversations) WHERE n = 1 AND role = 'user'""")
def chat_turns(spark, sf_dir):
    """Conversations whose last row is a user's get a reply of an injected answerer."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    last = history.latest(rows, ["conv_id"], ["turn", "role", "text"]).where("role = 'user'")
    reply = last.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"), F.concat(F.lit("echo: "), "text").alias("text"))
    return rows.unionByName(reply).select("conv_id", "turn", "role", F.length("text").alias("chars"))


@query(f"WITH {MESSAGES} SELECT msg_id, split_part(topic, '/', 2) AS device, split_part(topic, '/', 3) AS kind, CASE WHEN topic LIKE '%/click' THEN 'clicks' WHEN topic LIKE '%/error' THEN 'errors' ELSE 'any' END AS route, CAST(json_extract(payload, '$.k') AS INT) AS k FROM messages")
def topic_route(spark, sf_dir):
    parsed = bus.parse(fixtures.messages(spark, sf_dir), "k int")
    route = bus.route(F.col("topic"), {"clicks": "devices/+/click", "errors": "devices/+/error", "any": "devices/+/+", "never": "devices/+"})
    return parsed.select("msg_id", "device", "kind", route.alias("route"), F.col("body.k").alias("k"))


@query("""SELECT event_id AS msg_id, value BETWEEN 5 AND 150 AND event_type IN ('click', 'view', 'error') AND regexp_matches(props, '^\\{"k": [0-9]+\\}$') AS valid FROM events""")
def payload_validate(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    rule = bus.check("value", {"required": True, "minimum": 5, "maximum": 150}) & bus.check("event_type", {"enum": ["click", "view", "error"]}) & bus.check("props", {"pattern": r'^\{"k": [0-9]+\}$'})
    good, bad = bus.split_valid(e, rule)
    return good.select(F.col("event_id").alias("msg_id"), F.lit(True).alias("valid")).union(bad.select("event_id", F.lit(False)))


_SAID = "CASE c_custkey % 5 WHEN 0 THEN ' Yes, it is' WHEN 1 THEN 'NO' WHEN 2 THEN 'maybe' WHEN 3 THEN 'yesterday' END"


@query(f"""WITH s AS (SELECT c_custkey, lower(trim({_SAID})) AS a, c_mktsegment FROM customer)
SELECT c_custkey AS id, coalesce(starts_with(a, 'yes'), false) AS confirmed, coalesce(starts_with(a, 'yes') OR starts_with(a, 'no'), false) AS is_valid,
'Is this: ' || CASE WHEN c_mktsegment = 'BUILDING' THEN 'a match' ELSE c_mktsegment END || '? Answer yes or no.' AS prompt FROM s""")
def vlm_answer_parse(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    yes, valid = text.answer(F.expr(_SAID))
    reason = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise(F.lit(""))
    return c.select(F.col("c_custkey").alias("id"), yes.alias("confirmed"), valid.alias("is_valid"), text.prompt(reason).alias("prompt"))


@query(f"""WITH a AS (SELECT event_id, epoch(TIMESTAMP '{_AS_OF}') - epoch(ts) AS s FROM events)
SELECT event_id, CASE WHEN s < 3600 THEN CAST(floor(s / 60) AS INT) || 'm ago' WHEN s < 86400 THEN CAST(floor(s / 3600) AS INT) || 'h ago' ELSE CAST(floor(s / 86400) AS INT) || 'd ago' END AS ago FROM a""")
def relative_time(spark, sf_dir):
    s = (F.unix_micros(F.lit(_AS_OF).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return _table(spark, sf_dir, "events").select("event_id", text.ago(s).alias("ago"))


_LINE = "'RAM ' || CAST(p_size * 10 AS STRING) || '/' || CAST(p_size * 25 + 5 AS STRING) || 'MB (lfb 4x4MB) GR3D_FREQ ' || CAST(p_partkey % 100 AS STRING) || '% gpu@' || CAST(p_size AS STRING) || '.5C VDD_IN ' || CAST(p_partkey AS STRING) || 'mW/' || CAST(p_partkey + 1 AS STRING) || 'mW VDD_CPU_GPU_CV ' || CAST(p_size AS STRING) || 'mW'"


@query("""SELECT p_partkey, CAST(p_size * 10 AS BIGINT) AS ram_used_mb, CAST(p_size * 25 + 5 AS BIGINT) AS ram_total_mb, round(p_size * 10 / (p_size * 25 + 5)::DOUBLE * 100, 1) AS ram_pct, p_partkey % 100 AS gpu_util,
p_size + 0.5::DOUBLE AS gpu_temp, p_partkey AS power_instant_mw, p_partkey + 1 AS power_avg_mw, CAST(p_size AS BIGINT) AS cpu_gpu_power_mw FROM part""")
def telemetry_regex(spark, sf_dir):
    lines = _table(spark, sf_dir, "part").select("p_partkey", F.expr(_LINE).alias("line"))
    return lines.select("p_partkey", *(c.alias(n) for n, c in text.telemetry(F.col("line")).items()))


_REQUESTS = """CASE p_partkey % 4
WHEN 0 THEN '{"search_terms":[{"search_term":"x","objects":[{"category":"person","attributes":["Hat","Female","Wings"],"negative_attributes":["Glasses"],"colors":{"top":[255,0,0]}},{"category":"bicycle"}]},{"search_term":"y","objects":[{"category":"car"}]}],"strategy":{"requires_vlm":true,"vlm_reasoning":"riding"}}'
WHEN 1 THEN '{"search_terms":[{"search_term":"c","objects":[{"category":"car","colors":{"all":[0,0,255]}},{"category":"dragon"}]}]}'
WHEN 2 THEN '{"search_terms":[]}' ELSE 'not json' END"""


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'person,bicycle' WHEN 1 THEN 'car' ELSE '' END AS categories, CASE p_partkey % 4 WHEN 0 THEN 'Female,Hat' ELSE '' END AS attributes,
p_partkey % 4 = 0 AS vlm_required, CASE p_partkey % 4 WHEN 0 THEN 'riding' ELSE '' END AS vlm_reasoning, CASE p_partkey % 4 WHEN 0 THEN '{"0":{"top":[[255,0,0]]}}' WHEN 1 THEN '{"2":{"all":[[0,0,255]]}}' ELSE '{}' END AS colors,
CASE p_partkey % 4 WHEN 1 THEN '{"2":[0,0,255]}' ELSE '{}' END AS category_colors FROM part""")
def nl_to_masks(spark, sf_dir):
    asked = _table(spark, sf_dir, "part").select("p_partkey", F.expr(_REQUESTS).alias("response"))
    out = requests.lower(asked)
    names = lambda mask, words: F.array_join(requests.mask_names(F.col(mask), words), ",")
    return out.select(
        "p_partkey",
        names("category_mask", CATEGORIES).alias("categories"),
        names("attribute_mask", ATTRIBUTES).alias("attributes"),
        "vlm_required",
        "vlm_reasoning",
        F.to_json("color_requirements").alias("colors"),
        F.to_json("category_colors").alias("category_colors"),
    )


@query("SELECT event_type AS label, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def label_merge_dedup(spark, sf_dir):
    """Two branches of a flow merged; an item counts once per label."""
    e = _table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("label"), F.col("user_id").alias("item"))
    left, right = e.where("event_id % 2 = 0").drop("event_id"), e.where("event_id % 2 = 1").drop("event_id")
    return left.unionByName(right).dropDuplicates(["label", "item"]).groupBy("label").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT label, d, avg(v::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS d FROM embeddings) GROUP BY 1, 2),
w AS (SELECT label AS watch, sqrt(sum(m * m)) AS norm FROM c GROUP BY 1), e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS d FROM embeddings),
n AS (SELECT vec_id, sqrt(sum(v * v)) AS norm FROM e GROUP BY 1), s AS (SELECT vec_id, label AS watch, sum(v * m) AS dot FROM e JOIN c USING (d) GROUP BY 1, 2)
SELECT vec_id, watch, round(dot / (n.norm * w.norm), 6) AS cosine, dot / (n.norm * w.norm) >= 0.6 AS matched FROM s JOIN n USING (vec_id) JOIN w USING (watch)""")
def watchlist_cosine(spark, sf_dir):
    """Every embedding against the mean of each label, which come in blocks of 256 that the embeddings are joined with."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    means = e.select("label", F.posexplode("v").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("m"))
    watch = means.groupBy(F.col("label").alias("watch")).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("m"))
    n_blocks = max(1, -(-watch.count() // 256))
    blocks = watch.groupBy(F.pmod(F.xxhash64("watch"), F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct("watch", "m")).alias("ws"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    placed = e.select("vec_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"))
    each = placed.join(blocks, "block").select("vec_id", "v", F.explode("ws").alias("w"))
    cosine = dot(F.col("v"), F.col("w.m")) / (F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("w.m"), F.col("w.m"))))
    return each.select("vec_id", F.col("w.watch").alias("watch"), F.round(cosine, 6).alias("cosine"), (cosine >= 0.6).alias("matched"))


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey = 0 THEN NULL ELSE p_partkey // 4 END AS parent_id FROM part),
t AS (SELECT id, id AS root, 0 AS depth FROM n WHERE parent_id IS NULL UNION ALL SELECT n.id, t.root, t.depth + 1 FROM t JOIN n ON n.parent_id = t.id) SELECT id, root, depth FROM t""")
def children_walk(spark, sf_dir):
    parent = F.when(F.col("p_partkey") != 0, F.floor(F.col("p_partkey") / 4).cast("long"))
    return trees.walk(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), parent.alias("parent_id")))


@query("SELECT DISTINCT event_type || '-v1' AS schema_id FROM events")
def schema_ids(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("-v1")).alias("schema_id")).distinct()


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'b' ELSE 'a' END AS x, 'z' AS y, p_size + 1 AS k FROM part""")
def map_merge(spark, sf_dir):
    """Metadata merged with later values over earlier ones, and text keys as numbers."""
    a, b = F.create_map(F.lit("x"), F.lit("a"), F.lit("y"), F.lit("z")), F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("x"), F.lit("b"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    merged = text.merged(a, b)
    keys = text.numbered(F.create_map((F.col("p_size") + 1).cast("string"), F.lit(1)))
    return _table(spark, sf_dir, "part").select("p_partkey", merged["x"].alias("x"), merged["y"].alias("y"), F.get(F.map_keys(keys), F.lit(0)).alias("k"))


@query("SELECT p_partkey, trim(w) AS prompt FROM (SELECT p_partkey, unnest(string_split(p_name || ', ' || p_brand, ',')) AS w FROM part)")
def prompt_source(spark, sf_dir):
    each = F.explode(text.prompts(F.concat("p_name", F.lit(", "), "p_brand"))).alias("prompt")
    return _table(spark, sf_dir, "part").select("p_partkey", each)


@query("""SELECT 'large' AS label, event_id, user_id FROM events WHERE value > 100 UNION ALL SELECT 'click' AS label, event_id, user_id FROM events WHERE event_type = 'click'""")
def flow_fork_merge(spark, sf_dir):
    """Two branches of one source, each under a contract; an event that reaches the merge twice counts once per label."""
    needs = {"event_id": "bigint", "value": "double", "event_type": "string"}
    keep = lambda where: flow.contract(needs, {"event_id": "bigint"})(lambda df: df.where(where).select("event_id", "user_id"))
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    forked = flow.fork(events, {"large": keep("value > 100"), "click": keep("event_type = 'click'")})
    again = flow.fork(events, {"click": keep("event_type = 'click' AND value > 100")})
    return flow.merge([forked, again], ["event_id"]).select("label", "event_id", "user_id")


_LIMIT = 50_000
_HALVED = f"h AS (SELECT o_orderkey, CAST(greatest(0, ceil(log2(o_totalprice / {_LIMIT}))) AS INT) AS need FROM orders)"


@query(f"""WITH {_HALVED}, rounds AS (SELECT k, count_if(need > k) AS above, count(*) AS n FROM h, (SELECT unnest(range(64)) AS k) GROUP BY k),
ends AS (SELECT 'broken' AS loop, min(k) FILTER (20 * above < n) AS rounds, 1 AS code FROM rounds UNION ALL SELECT 'settled', min(k) FILTER (above = 0) + 1, 0 FROM rounds)
SELECT loop, CAST(rounds AS INT) AS rounds, CAST(code AS INT) AS code, least(need, CAST(rounds AS INT)) AS halvings, count(*) AS n FROM h, ends GROUP BY ALL""")
def flow_loop(spark, sf_dir):
    """Halve the totals above a limit, once until nothing changes and once until few are above it (a break with a code)."""
    start = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("total"), F.lit(0).alias("halvings"))
    above = F.col("total") > _LIMIT
    step = lambda df, n: df.select("o_orderkey", F.when(above, F.col("total") / 2).otherwise(F.col("total")).alias("total"), (F.col("halvings") + above.cast("int")).alias("halvings"))
    runs = {"settled": flow.loop(start, step), "broken": flow.loop(start, step, breaks={1: F.count_if(above) * 20 < F.count("*")})}
    shown = lambda name, r: r.rows.groupBy("halvings").agg(F.count("*").alias("n")).select(F.lit(name).alias("loop"), F.lit(r.rounds).alias("rounds"), F.lit(r.code).alias("code"), "halvings", "n")
    return shown("settled", runs["settled"]).unionByName(shown("broken", runs["broken"]))


_PATH = "'root/' || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN p_type || '/' ELSE p_type || '/' || p_brand || '/' END || p_partkey || '.jpg'"


@query(f"""WITH files AS (SELECT p_partkey, {_PATH} AS path FROM part), parts AS (SELECT *, string_split(path, '/') AS s FROM files)
SELECT p_partkey, path, row_number() OVER (ORDER BY list_transform(s, lambda x, i: CASE WHEN i = len(s) THEN '0' ELSE '1' END || x)) AS place FROM parts""")
def image_reading_order(spark, sf_dir):
    """Paths of pictures in the order in which a folder is read: its files first, then its subfolders, each by name."""
    brand = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, F.concat("p_type", F.lit("/"))).otherwise(F.concat("p_type", F.lit("/"), "p_brand", F.lit("/")))
    files = _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("root/"), brand, F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("path"))
    return images.numbered(files, "path")


@query(f"""WITH {MESSAGES}, placed AS (SELECT msg_id, topic, split_part(topic, '/', 2) AS device, split_part(topic, '/', 3) AS kind, row_number() OVER (PARTITION BY topic ORDER BY ts DESC, msg_id DESC) AS place FROM messages)
SELECT device, kind, msg_id, place FROM placed WHERE place <= CASE kind WHEN 'click' THEN 200 WHEN 'view' THEN 50 WHEN 'purchase' THEN 20 ELSE 3 END""")
def client_caps(spark, sf_dir):
    """What a device's page shows: the newest detections, metric points, chart points and alerts, each kind to its cap."""
    parts = F.split("topic", "/")
    rows = fixtures.messages(spark, sf_dir).select("msg_id", "ts", F.get(parts, F.lit(1)).alias("device"), F.get(parts, F.lit(2)).alias("kind"))
    cap = F.when(F.col("kind") == "click", 200).when(F.col("kind") == "view", 50).when(F.col("kind") == "purchase", 20).otherwise(3)
    return history.ring_by_kind(rows, ["device", "kind"], ["ts", "msg_id"], cap, 200).select("device", "kind", "msg_id", F.col("place").cast("long").alias("place"))


@query("SELECT user_id, event_id, CAST(count_if(event_type <> 'view') OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS position FROM events")
def masked_positions(spark, sf_dir):
    """Positions of the tokens of a sequence: the running sum of its mask."""
    position = history.running_mask(F.col("event_type") != "view", ["user_id"], ["event_id"])
    return _table(spark, sf_dir, "events").select("user_id", "event_id", position.alias("position"))


_REGION = """CASE p_partkey % 4 WHEN 0 THEN '[0.1, 0.4]' WHEN 1 THEN '{"start": 0.2, "end": 0.5}' WHEN 2 THEN '{"end": 0.3}' END"""


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 0.1 WHEN 1 THEN 0.2 ELSE 0.0 END::DOUBLE AS region_begin, CASE p_partkey % 4 WHEN 0 THEN 0.4 WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 1.0 END::DOUBLE AS region_end FROM part""")
def region_settings(spark, sf_dir):
    """A configured region is a pair or an object with start and end; what is left out has its default."""
    settings = _table(spark, sf_dir, "part").select("p_partkey", F.expr(_REGION).alias("region"))
    begin, end = configs.region(F.col("region"))
    return settings.select("p_partkey", begin.alias("region_begin"), end.alias("region_end"))


#: A configuration's fields and defaults; what the texts of the query give is left out, null, of another type or nested.
_DEFAULTS = {"name": "camera", "fps": 10, "tracking": {"iou": 0.3, "keep": True}, "classes": ["person"]}
_GIVEN = """CASE p_partkey % 5 WHEN 0 THEN '{"fps": ' || p_size || ', "tracking": {"iou": 0.' || p_size || '}}' WHEN 1 THEN '{"name": "' || p_name || '", "fps": "fast", "tracking": {"keep": false, "other": 1}}'
WHEN 2 THEN '{"classes": ["car", "' || p_brand || '"], "name": null}' WHEN 3 THEN 'no json' END"""


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 1 THEN p_name ELSE 'camera' END AS name, CAST(CASE WHEN p_partkey % 5 = 0 THEN p_size ELSE 10 END AS BIGINT) AS fps,
CASE WHEN p_partkey % 5 = 0 THEN CAST('0.' || p_size AS DOUBLE) ELSE 0.3 END::DOUBLE AS iou, p_partkey % 5 <> 1 AS keep, CASE WHEN p_partkey % 5 = 2 THEN 'car,' || p_brand ELSE 'person' END AS classes FROM part""")
def config_defaults(spark, sf_dir):
    """Configurations as given, over their defaults at every level."""
    c = _table(spark, sf_dir, "part").select("p_partkey", configs.loaded(F.expr(_GIVEN), _DEFAULTS).alias("c"))
    return c.select("p_partkey", "c.name", "c.fps", "c.tracking.iou", "c.tracking.keep", F.array_join("c.classes", ",").alias("classes"))


@query(f"WITH {_CFG} SELECT owner, save_id, CAST(version AS INT) AS version FROM cfg WHERE owner = 7 ORDER BY version DESC LIMIT 10")
def config_history_page(spark, sf_dir):
    """The newest versions of one owner's configuration."""
    mine = _configs(spark, sf_dir).where("owner = 7").select("owner", "save_id", "version")
    return history.page(mine, [F.desc("version")], 10)


@query("SELECT p_partkey AS term_id, p_name AS search_string, p_size AS priority FROM part ORDER BY p_size DESC, p_partkey LIMIT 50 OFFSET 50")
def search_terms_page(spark, sf_dir):
    """The second page of search terms."""
    terms = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("term_id"), F.col("p_name").alias("search_string"), F.col("p_size").alias("priority"))
    return history.page(terms, [F.desc("priority"), F.col("term_id")], 50, 50)
