"""Queries over detections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import attributes, geometry, text
from sightline.functions.geometry import area, box
from sightline.operators import clusters, filters, history, spatial
from sightline.plans import machines
from sightline.plans.base import ALL_DET, query
from sightline.sources import fixtures, sinks
from sightline.vocab import ATTRIBUTES, CATEGORIES, IMAGE_REGIONS, PERSON_REGIONS

FRAME = ["device_id", "frame_ts"]


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fixtures.detections(spark, sf_dir), fixtures.filters(spark)


def _r(c, digits: int = 6):
    return F.round(c, digits)


@query(f"""{ALL_DET} SELECT device_id, filter_id, count(*) AS alerts, round(max(confidence), 6) AS max_confidence, max(det_id) AS latest_det_id
FROM matched GROUP BY ALL""")
def device_alert_summary(spark, sf_dir):
    """Detections that pass the category router and match a filter, by device and filter."""
    det, flt = _both(spark, sf_dir)
    found = filters.match(filters.route_by_category(det, flt), flt)
    return found.groupBy("device_id", "filter_id").agg(F.count("*").alias("alerts"), _r(F.max("confidence")).alias("max_confidence"), F.max("det_id").alias("latest_det_id"))


@query(f"{ALL_DET} SELECT det_id, category_id FROM det WHERE category_id IN (SELECT category_id FROM enabled)")
def category_router(spark, sf_dir):
    return filters.route_by_category(*_both(spark, sf_dir)).select("det_id", "category_id")


@query(f"""{ALL_DET}, kept AS (SELECT * FROM det WHERE category_id IN (SELECT category_id FROM enabled))
SELECT device_id, CAST(frame_ts AS VARCHAR) AS frame, det_id, category_id, round(confidence, 6) AS confidence FROM kept
UNION ALL SELECT DISTINCT device_id, CAST(frame_ts AS VARCHAR), NULL, -1, 0.0 FROM det WHERE (device_id, frame_ts) NOT IN (SELECT (device_id, frame_ts) FROM kept)""")
def router_placeholder(spark, sf_dir):
    out = filters.with_placeholders(*_both(spark, sf_dir), FRAME)
    return out.select("device_id", F.date_format("frame_ts", "yyyy-MM-dd HH:mm:ss").alias("frame"), "det_id", "category_id", _r(F.col("confidence")).alias("confidence"))


@query(f"{ALL_DET} SELECT string_agg(CASE WHEN i IN (SELECT category_id FROM enabled) THEN '1' ELSE '0' END, '' ORDER BY i) AS cat_mask FROM (SELECT unnest(range({len(CATEGORIES)})) AS i)")
def merged_category_mask(spark, sf_dir):
    """The merged mask, a digit for each category of the vocabulary."""
    digits = F.transform("cat_mask", lambda on: on.cast("int").cast("string"))
    return filters.merged_mask(fixtures.filters(spark)).select(F.array_join(digits, "").alias("cat_mask"))


#: Filters that are rows of a table.
_STORED = f"stored AS (SELECT CAST(p_partkey AS VARCHAR) AS filter_id, [p_partkey % 37, p_size + 20] AS cats, CAST(p_partkey * 40503 % 67108864 AS INT) AS attr_mask FROM part)"  # noqa: F541


@query(f"WITH {_STORED}, used AS (SELECT DISTINCT unnest(cats) AS c FROM stored) SELECT string_agg(CASE WHEN i IN (SELECT c FROM used) THEN '1' ELSE '0' END, '' ORDER BY i) AS cat_mask FROM (SELECT unnest(range({len(CATEGORIES)})) AS i)")
def stored_category_mask(spark, sf_dir):
    """The merged mask of filters that are rows of a table."""
    digits = F.transform("cat_mask", lambda on: on.cast("int").cast("string"))
    return filters.merged_mask(fixtures.stored_filters(spark, sf_dir)).select(F.array_join(digits, "").alias("cat_mask"))


_NAMES = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"
_ATTRS = "[" + ", ".join(f"'{a}'" for a in ATTRIBUTES) + "]"


@query(f"""{ALL_DET} SELECT filter_id, (SELECT string_agg({_NAMES}[i + 1], ',' ORDER BY i) FROM (SELECT unnest(cats) AS i)) AS categories,
coalesce((SELECT string_agg({_ATTRS}[i + 1], ',' ORDER BY i) FROM (SELECT unnest(range(26)) AS i) WHERE attr_mask >> i & 1 = 1), '') AS attributes,
CAST(bit_count(attr_mask) AS BIGINT) AS n_attributes FROM filters""")
def mask_to_names(spark, sf_dir):
    name = lambda ids, words: F.array_join(F.transform(ids, lambda i: F.get(F.array(*map(F.lit, words)), i)), ",")
    return fixtures.filters(spark).select("filter_id", name(filters.enabled(F.col("cat_mask")), CATEGORIES).alias("categories"), name(filters.bits_of(F.col("attr_mask"), 26), ATTRIBUTES).alias("attributes"), F.bit_count("attr_mask").cast("long").alias("n_attributes"))


@query(f"""WITH {_STORED} SELECT filter_id, (SELECT string_agg({_NAMES}[i + 1], ',' ORDER BY i) FROM (SELECT DISTINCT unnest(cats) AS i)) AS categories,
coalesce((SELECT string_agg({_ATTRS}[i + 1], ',' ORDER BY i) FROM (SELECT unnest(range(26)) AS i) WHERE attr_mask >> i & 1 = 1), '') AS attributes FROM stored""")
def stored_filter_names(spark, sf_dir):
    name = lambda ids, words: F.array_join(F.transform(ids, lambda i: F.get(F.array(*map(F.lit, words)), i)), ",")
    return fixtures.stored_filters(spark, sf_dir).select("filter_id", name(filters.enabled(F.col("cat_mask")), CATEGORIES).alias("categories"), name(filters.bits_of(F.col("attr_mask"), 26), ATTRIBUTES).alias("attributes"))


@query(f"{ALL_DET} SELECT det_id, filter_id FROM pairs WHERE attr_bits & attr_mask = attr_mask")
def attribute_all_match(spark, sf_dir):
    return filters.all_attributes(*_both(spark, sf_dir)).select("det_id", "filter_id")


@query(f"{ALL_DET} SELECT DISTINCT det_id FROM pairs WHERE attr_bits & attr_mask = attr_mask")
def attribute_any_filter(spark, sf_dir):
    return filters.any_attributes(*_both(spark, sf_dir)).select("det_id")


@query(f"{ALL_DET} SELECT det_id FROM det")
def attribute_no_filters(spark, sf_dir):
    """Without filters every detection passes."""
    det, flt = _both(spark, sf_dir)
    return filters.any_attributes(det, flt.limit(0)).select("det_id")


@query(f"{ALL_DET} SELECT det_id, filter_id, round(attr_score, 6) AS attr_score FROM pairs")
def attribute_score(spark, sf_dir):
    return filters.pairs(*_both(spark, sf_dir)).select("det_id", "filter_id", _r(F.col("attr_score")).alias("attr_score"))


@query(f"{ALL_DET} SELECT det_id, string_agg(filter_id, ',' ORDER BY ord) AS matched_filters FROM matched GROUP BY det_id")
def filter_match(spark, sf_dir):
    return filters.matched_list(*_both(spark, sf_dir)).select("det_id", F.array_join("matched_filters", ",").alias("matched_filters"))


@query(f"{ALL_DET} SELECT det_id, filter_id, name, ord FROM matched JOIN (SELECT filter_id, name FROM filters) USING (filter_id)")
def matched_filter_details(spark, sf_dir):
    det, flt = _both(spark, sf_dir)
    return filters.details(filters.matched_list(det, flt), flt).select("det_id", "filter_id", "name", "ord")


@query(f"{ALL_DET} SELECT det_id, filter_id FROM pairs WHERE category_id <> 0 OR attr_score >= 0.5")
def rematch_fallback(spark, sf_dir):
    return filters.rematch(*_both(spark, sf_dir)).select("det_id", "filter_id")


@query(f"{ALL_DET} SELECT category_id, count(*) AS n FROM det WHERE confidence >= 0.25 AND category_id <> -1 GROUP BY 1")
def confident_known(spark, sf_dir):
    det = fixtures.detections(spark, sf_dir)
    return det.where("confidence >= 0.25 and category_id <> -1").groupBy("category_id").agg(F.count("*").alias("n"))


_REGIONS = IMAGE_REGIONS | PERSON_REGIONS
_REGION_ROWS = ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE, {str(k in PERSON_REGIONS).lower()})" for k, (a, b) in _REGIONS.items())


@query(f"""{ALL_DET}, regions AS (SELECT * FROM (VALUES {_REGION_ROWS}) AS t(region, a, b, person))
SELECT det_id, region, x1, round(y1 + (y2 - y1) * a, 6) AS top, x2, round(y1 + (y2 - y1) * b, 6) AS bottom FROM det, regions WHERE NOT person OR category_id = 0""")
def region_slices(spark, sf_dir):
    rows = [(k, a, b, k in PERSON_REGIONS) for k, (a, b) in _REGIONS.items()]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("region"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(p).alias("person")) for k, a, b, p in rows))).alias("s")
    det = fixtures.detections(spark, sf_dir).select("*", each).where("not s.person or category_id = 0")
    x1, top, x2, bottom = geometry.region(box(), F.col("s.a"), F.col("s.b"))
    return det.select("det_id", "s.region", x1.alias("x1"), _r(top).alias("top"), x2.alias("x2"), _r(bottom).alias("bottom"))


@query(f"""{ALL_DET} SELECT det_id, greatest(0, CAST(trunc(x1 - (x2 - x1) * 0.1) AS INT)) AS x1, greatest(0, CAST(trunc(y1 - (y2 - y1) * 0.1) AS INT)) AS y1,
least(80, CAST(trunc(x2 + (x2 - x1) * 0.1) AS INT)) AS x2, least(100, CAST(trunc(y2 + (y2 - y1) * 0.1) AS INT)) AS y2 FROM det""")
def padded_crop(spark, sf_dir):
    cut = geometry.padded(box(), 0.1, 0.1, 80, 100)
    return fixtures.detections(spark, sf_dir).select("det_id", *(c.alias(n) for c, n in zip(cut, spatial.BOX, strict=True)))


@query(f"{ALL_DET} SELECT det_id, x1 AS x, y1 AS y, x2 - x1 AS width, y2 - y1 AS height, true AS same FROM det")
def bbox_roundtrip(spark, sf_dir):
    x, y, w, h = geometry.to_xywh(box())
    back = geometry.from_xywh((x, y, w, h))
    same = F.lit(True)
    for a, b in zip(back, box(), strict=True):
        same = same & (a == b)
    return fixtures.detections(spark, sf_dir).select("det_id", x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"), same.alias("same"))


_IOU = """pair AS (SELECT a.*, b.det_id AS b_id, b.category_id AS b_cat, b.attr_bits AS b_bits, b.x1 AS u1, b.y1 AS v1, b.x2 AS u2, b.y2 AS v2
    FROM det a JOIN det b ON a.device_id = b.device_id AND a.frame_ts = b.frame_ts AND a.det_id < b.det_id),
inner_area AS (SELECT *, greatest(least(x2, u2) - greatest(x1, u1), 0.0) * greatest(least(y2, v2) - greatest(y1, v1), 0.0) AS i FROM pair),
ious AS (SELECT *, i / ((x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) - i) AS iou FROM inner_area)"""


@query(f"{ALL_DET}, {_IOU} SELECT det_id AS a_det_id, b_id AS b_det_id, round(iou, 6) AS iou FROM ious WHERE iou > 0")
def iou_pairs(spark, sf_dir):
    found = spatial.overlapping_pairs(fixtures.detections(spark, sf_dir), FRAME)
    return found.select("a_det_id", "b_det_id", _r(F.col("iou")).alias("iou"))


@query(f"""{ALL_DET}, {_IOU} SELECT det_id AS a_det_id, b_id AS b_det_id,
round(CASE WHEN attr_bits = 0 OR b_bits = 0 THEN 0 ELSE bit_count(attr_bits & b_bits) / sqrt(bit_count(attr_bits)::DOUBLE * bit_count(b_bits)) END, 6) AS cosine
FROM ious WHERE iou > 0 AND category_id = 0 AND b_cat = 0""")
def attr_cosine_pairs(spark, sf_dir):
    persons = fixtures.detections(spark, sf_dir).where("category_id = 0")
    met = spatial.overlapping_pairs(persons, FRAME, carry=("attr_bits",))
    return met.select("a_det_id", "b_det_id", _r(attributes.cosine(F.col("a_attr_bits"), F.col("b_attr_bits"))).alias("cosine"))


_SIMILAR = f"""{_IOU}, sized AS (SELECT *, (x2 - x1) * (y2 - y1) AS s, (u2 - u1) * (v2 - v1) AS t,
    (greatest(x2, u2) - least(x1, u1)) * (greatest(y2, v2) - least(y1, v1)) AS room,
    bit_count(attr_bits & 129) / 2.0 AS p, bit_count(b_bits & 129) / 2.0 AS q FROM pair WHERE category_id <> b_cat),
similar_pairs AS (SELECT *, (least(1.0, (s + t) / room) + least(s, t) / greatest(s, t) + 1.5
    + 0.8 * CASE WHEN category_id = 0 AND b_cat = 0 THEN (p + q) / 2 WHEN category_id = 0 THEN p WHEN b_cat = 0 THEN q ELSE 0.5 END) / 4.3 AS similarity FROM sized)"""


@query(f"{ALL_DET}, {_SIMILAR} SELECT det_id AS a_det_id, b_id AS b_det_id, round(similarity, 6) AS similarity FROM similar_pairs")
def cluster_similarity_pairs(spark, sf_dir):
    return spatial.similar_pairs(fixtures.detections(spark, sf_dir), FRAME, F.lit(129)).select("a_det_id", "b_det_id", _r(F.col("similarity")).alias("similarity"))


@query(f"""{ALL_DET}, {_SIMILAR} SELECT device_id, det_id AS a_det_id, b_id AS b_det_id, round(similarity, 6) AS similarity FROM similar_pairs
QUALIFY row_number() OVER (PARTITION BY device_id, frame_ts ORDER BY round(similarity, 9) DESC, det_id, b_id) = 1""")
def best_pair_per_frame(spark, sf_dir):
    pairs = spatial.similar_pairs(fixtures.detections(spark, sf_dir), FRAME, F.lit(129)).withColumn("similarity", _r(F.col("similarity"), 9))
    return spatial.best_pair(pairs, FRAME).select("device_id", "a_det_id", "b_det_id", _r(F.col("similarity")).alias("similarity"))


@query(f"""{ALL_DET} SELECT device_id, CAST(frame_ts AS VARCHAR) AS frame, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, sum((x2 - x1) * (y2 - y1)) AS area,
string_agg(DISTINCT CAST(category_id AS VARCHAR), ',' ORDER BY CAST(category_id AS VARCHAR)) AS categories FROM det GROUP BY device_id, frame_ts""")
def merged_boxes(spark, sf_dir):
    det = fixtures.detections(spark, sf_dir)
    out = det.groupBy(*FRAME).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.sum(area(box())).alias("area"), F.array_join(F.sort_array(F.collect_set(F.col("category_id").cast("string"))), ",").alias("categories"))
    return out.select("device_id", F.date_format("frame_ts", "yyyy-MM-dd HH:mm:ss").alias("frame"), "x1", "y1", "x2", "y2", "area", "categories")


@query(f"""{ALL_DET}, ranked AS (SELECT *, row_number() OVER (PARTITION BY device_id, frame_ts ORDER BY confidence DESC, det_id) AS n FROM det),
run AS (SELECT device_id, frame_ts, 1 AS n, [{{'id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM ranked WHERE n = 1
    UNION ALL SELECT r.device_id, r.frame_ts, r.n, CASE WHEN len(list_filter(run.kept, lambda k:
        greatest(least(k.x2, r.x2) - greatest(k.x1, r.x1), 0.0) * greatest(least(k.y2, r.y2) - greatest(k.y1, r.y1), 0.0)
        / ((k.x2 - k.x1) * (k.y2 - k.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - greatest(least(k.x2, r.x2) - greatest(k.x1, r.x1), 0.0) * greatest(least(k.y2, r.y2) - greatest(k.y1, r.y1), 0.0)) > 0.45)) > 0
        THEN run.kept ELSE list_append(run.kept, {{'id': r.det_id, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}}) END
    FROM run JOIN ranked r ON r.device_id = run.device_id AND r.frame_ts = run.frame_ts AND r.n = run.n + 1),
final AS (SELECT kept FROM run QUALIFY row_number() OVER (PARTITION BY device_id, frame_ts ORDER BY n DESC) = 1)
SELECT unnest(list_transform(kept, lambda k: k.id)) AS det_id FROM final""")
def nms_detections(spark, sf_dir):
    return spatial.suppress(fixtures.detections(spark, sf_dir), FRAME).select("det_id")


@query(machines.clusters())
def cluster_detections(spark, sf_dir):
    det, flt = _both(spark, sf_dir)
    out = clusters.cluster(det, flt)
    return out.select("device_id", F.date_format("frame_ts", "yyyy-MM-dd").alias("frame"), "filter_id", F.array_join("members", ",").alias("members"), "category_id", *spatial.BOX, _r(F.col("confidence")).alias("confidence"), _r(F.col("cost")).alias("cost"))


@query(f"{ALL_DET}, {machines.claims()} SELECT det_id FROM unclaimed")
def unclaimed_detections(spark, sf_dir):
    """What no filter of several categories takes into its clusters."""
    alone = clusters.cluster(*_both(spark, sf_dir)).where("filter_id is null")
    return alone.select(F.explode("members").alias("det_id"))


@query(f"""{ALL_DET} SELECT det_id, filter_id, round(CASE WHEN category_id = 0 THEN attr_score WHEN det_id % 3 = 0 THEN 1.0 ELSE (det_id % 2) / (det_id % 3)::DOUBLE END, 6) AS quality FROM pairs""")
def quality_score(spark, sf_dir):
    pairs = filters.pairs(*_both(spark, sf_dir))
    score = filters.quality_score(F.col("category_id"), F.col("attr_score"), F.col("det_id") % 3, F.col("det_id") % 2)
    return pairs.select("det_id", "filter_id", _r(score).alias("quality"))


@query("""WITH sized AS (SELECT p_partkey, CAST(p_size * 40 + 1 AS DOUBLE) AS w, CAST(p_partkey % 1000 + 100 AS DOUBLE) AS h FROM part),
scaled AS (SELECT *, least(640.0 / w, 640.0 / h) AS k, greatest(1920.0 / w, 1080.0 / h) AS f FROM sized)
SELECT p_partkey, CAST(trunc(w * k) AS INT) AS box_w, CAST(trunc(h * k) AS INT) AS box_h, CAST(trunc((640 - CAST(trunc(w * k) AS INT)) / 2.0) AS INT) AS dx, CAST(trunc((640 - CAST(trunc(h * k) AS INT)) / 2.0) AS INT) AS dy,
CAST(trunc(w * f) AS INT) AS fill_w, CAST(trunc(h * f) AS INT) AS fill_h, greatest(0, CAST(trunc((CAST(trunc(w * f) AS INT) - 1920) / 2.0) AS INT)) AS crop_x, greatest(0, CAST(trunc((CAST(trunc(h * f) AS INT) - 1080) / 2.0) AS INT)) AS crop_y FROM scaled""")
def frame_geometry(spark, sf_dir):
    """Letterbox and cover-and-crop geometry of pictures."""
    p = fixtures.table(spark, sf_dir, "part")
    w, h = (F.col("p_size") * 40 + 1).cast("double"), (F.col("p_partkey") % 1000 + 100).cast("double")
    letter, cover = geometry.letterbox(w, h, 640), geometry.fill_crop(w, h, 1920, 1080)
    names = ("box_w", "box_h", "dx", "dy", "fill_w", "fill_h", "crop_x", "crop_y")
    return p.select("p_partkey", *(c.alias(n) for c, n in zip((*letter, *cover), names, strict=True)))


@query(f"""{ALL_DET}, d AS (SELECT det_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h FROM det)
SELECT det_id, round(least(greatest((cx - w / 2 - 10.0) / 0.5, 0.0), 120.0), 6) AS x1, round(least(greatest((cy - h / 2 - 20.0) / 0.5, 0.0), 90.0), 6) AS y1,
round(least(greatest((cx + w / 2 - 10.0) / 0.5, 0.0), 120.0), 6) AS x2, round(least(greatest((cy + h / 2 - 20.0) / 0.5, 0.0), 90.0), 6) AS y2 FROM d""")
def detector_boxes(spark, sf_dir):
    """Centre-and-size boxes of a letterboxed picture back in the picture's own pixels."""
    b = box()
    cut = geometry.from_center((b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1], F.lit(0.5), F.lit(10.0), F.lit(20.0), 120, 90)
    return fixtures.detections(spark, sf_dir).select("det_id", *(_r(c).alias(n) for c, n in zip(cut, spatial.BOX, strict=True)))


_LOGITS = {a: f"(event_id * {i + 3} % 17 - 8) / 4.0" for i, a in enumerate(ATTRIBUTES)}
_TOP = {"a": ("AgeLess18", "Age18-60", "AgeOver60"), "f": ("Front", "Side", "Back")}


def _first_best(group: tuple[str, ...]) -> str:
    top = "greatest(" + ", ".join(_LOGITS[g] for g in group) + ")"
    return "CASE " + " ".join(f"WHEN {_LOGITS[g]} = {top} THEN '{g}'" for g in group) + " END"


_BINARY = [a for a in ATTRIBUTES if a not in _TOP["a"] + _TOP["f"]]


@query(f"""SELECT event_id AS det_id, {_first_best(_TOP["a"])} AS age, {_first_best(_TOP["f"])} AS facing,
CAST({" + ".join(f"CASE WHEN {_LOGITS[a]} > 0 THEN 1 ELSE 0 END" for a in _BINARY)} AS BIGINT) AS n_binary, round(1 / (1 + exp(-{_LOGITS["Hat"]})), 6) AS p_hat FROM events""")
def attribute_decisions(spark, sf_dir):
    """Logits to attributes: one of each exclusive group, the others by threshold."""
    prob = {a: attributes.sigmoid(F.expr(e)) for a, e in _LOGITS.items()}
    said = attributes.decide(prob)
    one = lambda group: F.coalesce(*(F.when(said[g], F.lit(g)) for g in group))
    n = sum((said[a].cast("long") for a in _BINARY[1:]), said[_BINARY[0]].cast("long"))
    return fixtures.table(spark, sf_dir, "events").select(F.col("event_id").alias("det_id"), one(_TOP["a"]).alias("age"), one(_TOP["f"]).alias("facing"), n.alias("n_binary"), _r(prob["Hat"]).alias("p_hat"))


@query(f"""{ALL_DET}, newest AS (SELECT device_id, max(frame_ts) AS frame_ts FROM det GROUP BY 1)
SELECT device_id, CAST(frame_ts AS VARCHAR) AS frame, count(*) FILTER (confidence >= 0.01) AS n_boxes, coalesce(string_agg(CAST(det_id AS VARCHAR), ',' ORDER BY det_id) FILTER (confidence >= 0.01), '') AS det_ids
FROM det JOIN newest USING (device_id, frame_ts) GROUP BY ALL""")
def latest_snapshot(spark, sf_dir):
    out = sinks.snapshot(fixtures.detections(spark, sf_dir))
    ids = F.array_join(F.transform("boxes", lambda b: b["det_id"].cast("string")), ",")
    return out.select("device_id", F.date_format("frame_ts", "yyyy-MM-dd HH:mm:ss").alias("frame"), F.size("boxes").cast("long").alias("n_boxes"), ids.alias("det_ids"))


@query(f"""{ALL_DET}, held AS (SELECT det_id, device_id, ts, confidence, category_id, x1, y1, x2 - x1 AS w, y2 - y1 AS h FROM matched WHERE filter_id = 'f2')
SELECT det_id, 'devices/' || device_id || '/alerts' AS topic, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(millisecond(ts) % 1000 AS VARCHAR), 3, '0') || 'Z' AS timestamp,
'f2' AS watchlist_item_id, CASE WHEN category_id = 0 THEN 'person' ELSE 'car' END AS description, x1 AS x, y1 AS y, w AS width, h AS height FROM held""")
def alert_rows(spark, sf_dir):
    """Matches of one filter as alert messages, read back from their JSON."""
    det, flt = _both(spark, sf_dir)
    names = F.element_at(F.array(*map(F.lit, CATEGORIES)), F.col("category_id") + 1)
    found = filters.match(det, flt).where("filter_id = 'f2'").withColumns({"description": names, "vlm_required": F.lit(False)})
    alerts = sinks.alert(found.withColumn("filter_id", F.concat_ws("/", "filter_id", "det_id", "device_id")))
    sent = sinks.as_messages(alerts, F.concat(F.lit("devices/"), F.element_at(F.split("watchlist_item_id", "/"), 3), F.lit("/alerts")))
    body = F.from_json("payload", alerts.schema)
    back = sent.select("topic", body.alias("b")).select("topic", "b.*", F.split("b.watchlist_item_id", "/").alias("ids"), "b.metadata.bounding_box.*")
    ids = F.get("ids", F.lit(1)).cast("long").alias("det_id"), F.get("ids", F.lit(0)).alias("watchlist_item_id")
    return back.select(*ids, "topic", "timestamp", "description", "x", "y", "width", "height")


def _bit(i: int) -> str:
    return f"(attr_bits >> {i} & 1 = 1)"


@query(f"""{ALL_DET} SELECT det_id, CASE WHEN said = '' THEN 'Detection alert' ELSE 'Person detected: ' || said END AS description FROM (SELECT det_id, concat_ws(', ',
CASE WHEN {_bit(0)} THEN 'female' END, CASE WHEN {_bit(1)} THEN 'elderly' WHEN {_bit(3)} THEN 'young' END, CASE WHEN {_bit(7)} THEN 'red hat' END,
CASE WHEN {_bit(8)} THEN 'glasses' END, CASE WHEN {_bit(11)} THEN 'backpack' END, CASE WHEN {_bit(10)} THEN 'shoulder bag' END, CASE WHEN {_bit(9)} THEN 'handbag' END,
CASE WHEN {_bit(14)} THEN 'blue long sleeve' WHEN {_bit(13)} THEN 'short sleeve' END, CASE WHEN {_bit(21)} THEN 'coat' END,
CASE WHEN {_bit(22)} THEN 'trousers' WHEN {_bit(23)} THEN 'shorts' WHEN {_bit(24)} THEN 'dress/skirt' END) AS said FROM det)""")
def alert_description(spark, sf_dir):
    has = lambda a: F.call_function("getbit", F.col("attr_bits"), F.lit(ATTRIBUTES.index(a))) == 1
    color = lambda part: F.lit({"Hat": "red", "LongSleeve": "blue"}.get(part)).cast("string")
    return fixtures.detections(spark, sf_dir).select("det_id", text.description(has, color).alias("description"))


@query(f"{ALL_DET} SELECT det_id, substr(md5(category_id || '_' || device_id || '_' || det_id), 1, 16) AS track_id FROM det")
def track_id_md5(spark, sf_dir):
    return fixtures.detections(spark, sf_dir).select("det_id", text.track_id(F.col("category_id"), F.col("device_id"), F.col("det_id")).alias("track_id"))


@query(f"""{ALL_DET}, scored AS (SELECT *, row_number() OVER (PARTITION BY device_id, filter_id ORDER BY attr_score DESC, det_id) AS n FROM matched WHERE attr_score > 0)
SELECT device_id, filter_id, det_id, round(attr_score, 6) AS score FROM scored WHERE n = 1""")
def best_snapshot(spark, sf_dir):
    """The best detection so far by device and filter: the first of the highest score above zero."""
    found = filters.match(*_both(spark, sf_dir)).where("attr_score > 0").withColumn("first", -F.col("det_id"))
    best = history.latest(found.select("device_id", "filter_id", "det_id", "attr_score", "first"), ["device_id", "filter_id"], ["attr_score", "first"])
    return best.select("device_id", "filter_id", "det_id", _r(F.col("attr_score")).alias("score"))


@query(f"""{ALL_DET} SELECT det_id, strftime(ts, '%Y%m%d_%H%M%S') || '_' || category_id || '_' || printf('%.2f', confidence) || '_' || (CASE WHEN {_bit(7)} THEN 'Hat' ELSE '' END)
|| '_Hat-red.jpg' AS name FROM det""")
def crop_names(spark, sf_dir):
    hat = F.call_function("getbit", F.col("attr_bits"), F.lit(7)) == 1
    name = sinks.crop_name(F.col("ts"), F.col("category_id").cast("string"), F.col("confidence"), F.create_map(F.lit("Hat"), hat), F.create_map(F.lit("Hat"), F.lit("red")))
    return fixtures.detections(spark, sf_dir).select("det_id", name.alias("name"))
