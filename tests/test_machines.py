"""Golden cases of the order-dependent operators."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sightline.operators import clusters, configs, filters, flow, history, metrics, routing, spatial, tracking
from sightline.operators.tracking import Rules, Tracker
from sightline.plans.registry import QUERIES
from sightline.sources import fixtures, images

BOX = {"x1": 0.0, "y1": 0.0, "x2": 10.0, "y2": 20.0}
F_TIME = 1_700_000_000.0
RULES = Rules(hits=2, window=3, cooldown=120, ttl=300)


def events(times, rules=RULES, required=False, **more):
    """Each time is a message of its own."""
    t = Tracker((1, "f", 2), rules)
    row = lambda i, s: {"since": times[i - 1] if i else None, "seconds": s, "det_id": i, "attr_bits": 0, "score": 1.0, "vlm_required": required} | BOX | more
    return [(s, e[4], e[6]) for i, s in enumerate(times) for e in t.either(row(i, s))]


def test_tracker():
    assert [e[0] for e in events([0, 1])] == [1]
    assert events([0, 4, 5]) == []
    assert [e[0] for e in events([0, 1, 2, 122, 123, 124])] == [1, 124]
    assert events([0, 1], score=0.0) == [(1, 1, None)]
    assert [e[0] for e in events([0, 400, 401])] == [401]


def test_person_without_attributes_never_matches():
    t = Tracker((1, "f", 0), RULES)
    row = {"det_id": 1, "attr_bits": 0, "score": 1.0, "vlm_required": False} | BOX
    assert [e for s in range(5) for e in t.detection(row | {"seconds": s})] == []


def test_feedback():
    t = Tracker((1, "f", 2), RULES)
    see = lambda s: t.detection({"seconds": s, "det_id": s, "attr_bits": 0, "score": 1.0, "vlm_required": True} | BOX)
    see(0)
    track = see(1)[0][3]
    assert see(2) == []
    t.answer("other", 2, True, True)
    t.answer(track, 2, False, True)
    assert t.tracks[0]["state"] == "watching" and t.tracks[0]["attempts"] == 1
    see(3)
    assert len(see(4)) == 1
    t.answer(track, 4, False, False)
    assert t.tracks[0]["attempts"] == 1
    for s in (5, 7):
        see(s), see(s + 1)
        t.answer(track, s + 1, False, True)
    assert t.tracks[0]["state"] == "suppressed"


SEEN = "det_id long, device_id long, filter_id string, category_id int, at double, attr_bits int, attr_score double, vlm_required boolean, x1 double, y1 double, x2 double, y2 double"


def seen(spark, rows, required=False):
    """Matched detections from (time, category)."""
    data = [(i, 1, "f", c, F_TIME + s, 1, 1.0, required, 0.0, 0.0, 10.0, 20.0) for i, (s, c) in enumerate(rows)]
    return spark.createDataFrame(data, SEEN).withColumn("ts", F.timestamp_seconds("at"))


def fired(df, messages=None, rules=Rules(hits=1, window=3, cooldown=120, ttl=300)):
    out = tracking.confirmations(df, df if messages is None else messages, rules).collect()
    return sorted((e.event_ts - F_TIME, e.category_id, e.best_det_id) for e in out)


def test_clean_up_follows_a_message(spark):
    """Two detections of one message meet the same tracks; the suppressed one goes after both."""
    assert fired(seen(spark, [(0, 2), (125, 2), (125, 2), (130, 2)])) == [(0, 2, 0), (130, 2, 3)]


def test_clean_up_by_other_messages(spark):
    """A car's message, or one without any match, ends a person's suppression before the next person comes."""
    persons = [(0, 0), (125, 0)]
    assert fired(seen(spark, persons)) == [(0, 0, 0)]
    assert fired(seen(spark, [(0, 0), (121, 2), (125, 0)])) == [(0, 0, 0), (121, 2, 1), (125, 0, 2)]
    df = seen(spark, persons)
    assert fired(df, seen(spark, [*persons, (121, -1)])) == [(0, 0, 0), (125, 0, 1)]
    assert fired(df, seen(spark, [*persons, (119, -1), (125, 5)])) == [(0, 0, 0)]


def test_time_to_live_by_messages(spark):
    """A track too old to be found stays until a message cleans it up, and is found by nothing meanwhile."""
    rules = Rules(hits=2, window=1000, cooldown=120, ttl=300)
    assert fired(seen(spark, [(0, 2), (301, 2), (302, 2)]), rules=rules) == [(302, 2, 1)]


def test_previous_times_over_slots(spark):
    times = spark.createDataFrame([(1, float(s)) for s in (0, 5, 5, 9, 100, 250)] + [(2, 7.0)], "device_id long, seconds double")
    rows = spark.createDataFrame([(1, float(s), s) for s in (0, 5, 6, 100, 101, 250, 999)] + [(2, 7.0, 7), (2, 8.0, 8)], "device_id long, seconds double, n int")
    got = {(r.device_id, r.n): r.since for r in tracking.previous_times(rows, times.distinct(), slot=10.0).collect()}
    assert got == {(1, 0): None, (1, 5): 0, (1, 6): 5, (1, 100): 9, (1, 101): 100, (1, 250): 100, (1, 999): 250, (2, 7): None, (2, 8): 7}


def test_answers_as_rows(spark):
    """A no starts the track over, a yes suppresses it, a stale answer counts for nothing."""
    df = seen(spark, [(s, 2) for s in (0, 1, 3, 4, 6, 7)], required=True)
    first = tracking.confirmations(df, df, RULES).collect()
    assert [e.event_ts - F_TIME for e in first] == [1]
    track = first[0].track_id

    def after(*answers):
        rows = spark.createDataFrame([(1, "f", 2, t, F_TIME + s, yes, good) for t, s, yes, good in answers], "device_id long, filter_id string, category_id int, track_id string, seconds double, confirmed boolean, valid boolean")
        return [e.event_ts - F_TIME for e in tracking.confirmations(df, df, RULES, answers=rows).collect()]

    assert after((track, 2, False, True)) == [1, 4]
    assert after((track, 2, True, True)) == [1]
    assert after(("other", 2, False, True)) == [1]
    assert after((track, 2, False, True), (track, 5, False, False)) == [1, 4, 7]


def _route(spark, rows, capacity):
    df = spark.createDataFrame([(1, float(i), i, *r) for i, r in enumerate(rows, 1)], "device_id long, event_ts double, event_id long, vlm_required boolean, ready boolean")
    return [(r.event_id, r.target, r.vlm_status) for r in routing.route(df, capacity=capacity).collect()]


def test_router(spark):
    assert sorted(_route(spark, [(True, False)] * 3, 2)) == [(1, "alerts", "timeout"), (2, "queued", None), (3, "queued", None)]
    assert sorted(_route(spark, [(False, True), (True, True), (False, True)], 2)) == [(1, "alerts", None), (2, "verify", None), (3, "alerts", None)]
    assert _route(spark, [(True, False), (False, True)], 2) == [(1, "verify", None), (2, "alerts", None)]


def test_similarity_of_the_worked_example():
    node = lambda i, c, b: clusters.Node.of({"det_id": i, "category_id": c, "attr_bits": 0, "confidence": 0.5} | dict(zip(("x1", "y1", "x2", "y2"), b, strict=True)))
    p, b = node(1, 0, (0.0, 0.0, 10.0, 20.0)), node(2, 1, (5.0, 10.0, 15.0, 20.0))
    assert abs(clusters.similarity(p, b, 0) - 0.883721) < 1e-6
    assert abs(tracking.iou(p.box, b.box) - 0.2) < 1e-12
    assert abs(tracking.cosine(129, 1) - 1 / math.sqrt(2)) < 1e-12
    merged = clusters.agglomerate([p, b], 0, 0.6, 10)
    assert [(n.members, n.category, n.area) for n in merged] == [([1, 2], 0, 300.0)]
    assert len(clusters.agglomerate([p, b], 0, 0.9, 10)) == 2


def test_clusters_agree_with_the_relational_first_round(spark, sf):
    """Every detection is in one cluster; the first merge of a frame's only filter is its best pair."""
    det, flt = fixtures.detections(spark, sf), fixtures.filters(spark)
    out = clusters.cluster(det, flt)
    members = [m for r in out.collect() for m in r.members]
    assert sorted(members) == sorted(r.det_id for r in det.collect())
    two = det.where("category_id in (0, 2)")
    best = {(r.device_id, r.frame_ts): r for r in spatial.best_pair(spatial.similar_pairs(two, ["device_id", "frame_ts"]), ["device_id", "frame_ts"]).collect()}
    merged = {tuple(r.members): r for r in out.where("filter_id = 'f2' and size(members) = 2").collect()}
    for r in merged.values():
        pair = best[r.device_id, r.frame_ts]
        assert pair.similarity >= r.cost - 1e-9
    assert merged


def test_suppression_against_a_plain_loop(spark, sf):
    frames = {}
    for r in fixtures.detections(spark, sf).collect():
        frames.setdefault((r.device_id, r.frame_ts), []).append(r)
    want = set()
    for rows in frames.values():
        kept = []
        for r in sorted(rows, key=lambda r: (-r.confidence, r.det_id)):
            if all(tracking.iou((k.x1, k.y1, k.x2, k.y2), (r.x1, r.y1, r.x2, r.y2)) <= 0.45 for k in kept):
                kept.append(r)
        want |= {r.det_id for r in kept}
    assert {r.det_id for r in QUERIES["nms_detections"](spark, sf).collect()} == want


def test_grid_pairs_do_not_depend_on_the_cell(spark, sf):
    det = fixtures.detections(spark, sf)
    one = lambda cell: {(r.a_det_id, r.b_det_id) for r in spatial.overlapping_pairs(det, ["device_id", "frame_ts"], cell).collect()}
    assert one(7.0) == one(64.0) == one(1e6)


def test_buffers(spark):
    df = spark.createDataFrame([("a", i) for i in range(1, 7)], "k string, id int")
    ids = lambda out: sorted(r.id for r in out.collect())
    assert ids(history.last_n(df.where("id < 4"), ["k"], ["id"], 2)) == [2, 3]
    assert ids(history.first_n(df.where("id < 4"), ["k"], ["id"], 2)) == [1, 2]
    assert ids(history.decimate(df, ["k"], ["id"], 2)) == [2, 4, 6]
    assert ids(history.latest(df, ["k"], ["id"])) == [6]
    assert history.latest(df.limit(0), ["k"], ["id"]).count() == 0


def test_instruments(spark):
    data = [("s", 1, "x", 10.0), ("s", 2, "x", 20.0), ("s", 3, "y", 30.0)]
    p = spark.createDataFrame(data, "series string, seq int, user string, value double").withColumn("ts", F.timestamp_seconds("seq"))
    r = metrics.bound(p, "series", "user").first()
    assert (r["count"], r["avg"]) == (2, 15.0)
    last = metrics.evicting(p, ["series"], 2).orderBy(F.desc("seq")).first()
    assert (last["count"], last["sum"]) == (2, 50.0)
    assert {(r.user, r["sum"], r["count"]) for r in metrics.histogram(p, ["series"], "user").collect()} == {("x", 30.0, 2), ("y", 30.0, 1)}
    assert metrics.ewma(p, ["series"]).first().ewma == (10 * 0.8 + 20 * 0.2) * 0.8 + 30 * 0.2
    long = spark.range(2000).selectExpr("'s' as series", "id as seq", "timestamp_seconds(id) as ts", "double(id * id % 97) as value")
    e = 0.0
    for i in range(2000):
        e = float(i * i % 97) if i == 0 else e * 0.8 + float(i * i % 97) * 0.2
    assert abs(metrics.ewma(long, ["series"]).first().ewma - e) < 1e-12


def test_no_filters_and_no_detections(spark, sf):
    det, flt = fixtures.detections(spark, sf), fixtures.filters(spark)
    assert filters.route_by_category(det, flt.limit(0)).count() == 0
    assert filters.matched_list(det.limit(0), flt).count() == 0
    assert clusters.cluster(det, flt.limit(0)).count() == det.count()
    assert tracking.confirmations(filters.match(det.limit(0), flt).withColumn("vlm_required", F.lit(False)), det).count() == 0


def test_image_folder_order(spark, tmp_path):
    names = ["root.jpg", "a_dir/a1.jpg", "a_dir/b_subdir/b1.jpg", "b_dir/c1.JPEG"]
    for n in [*names, "a_dir/skip.txt"]:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    got = images.scan(spark, str(tmp_path)).orderBy(images.reading_order(F.col("path"))).collect()
    assert [r.path.rpartition(f"{tmp_path.name}/")[2] for r in got] == names


def test_heap_against_scoring_all_pairs_anew():
    """The same merges as by scoring all pairs after each, ties included."""

    def plain(nodes, mask, threshold):
        for _ in range(clusters.MAX_MERGES):
            pairs = [(clusters.similarity(a, b, mask), -i, -j) for (i, a), (j, b) in combinations(enumerate(nodes), 2) if not a.kinds & b.kinds]
            if not pairs or max(pairs)[0] < threshold:
                break
            s, i, j = max(pairs)
            nodes = [n for k, n in enumerate(nodes) if k not in (-i, -j)] + [nodes[-i].joined(nodes[-j], s)]
        return [(n.members, n.cost) for n in nodes]

    rng = random.Random(1)
    for _ in range(60):
        boxes = [(x := rng.randint(0, 3) * 10.0, y := rng.randint(0, 3) * 10.0, x + rng.choice((10.0, 20.0)), y + 10.0) for _ in range(rng.randint(0, 14))]
        row = lambda i, b: {"det_id": i, "category_id": rng.randint(0, 6), "attr_bits": rng.randint(0, 7), "confidence": 0.5} | dict(zip(("x1", "y1", "x2", "y2"), b, strict=True))  # noqa: B023, E731
        nodes = [clusters.Node.of(row(i, b)) for i, b in enumerate(boxes)]
        for threshold in (0.0, 0.6, 0.8):
            assert [(n.members, n.cost) for n in clusters.agglomerate(nodes, 5, threshold, 99)] == plain(nodes, 5, threshold)


def test_disjoint_categories_only():
    nodes = [clusters.Node([i], (0.0, 0.0, 10.0, 10.0), 100.0, 0, {0}, 1, 0.5) for i in range(4)]
    assert len(clusters.agglomerate(nodes, 0, 0.0, 10)) == 4 and len(list(combinations(nodes, 2))) == 6


def test_flow_contracts(spark):
    df = spark.range(3)
    double = flow.contract({"id": "bigint"}, {"twice": "bigint"})(lambda d: d.select((F.col("id") * 2).alias("twice")))
    assert [r.twice for r in flow.chain(df, double).orderBy("twice").collect()] == [0, 2, 4]
    with pytest.raises(TypeError, match="requires id bigint"):
        flow.chain(df.selectExpr("cast(id AS string) AS id"), double)
    with pytest.raises(TypeError, match="must produce other"):
        flow.contract({}, {"other": "int"})(lambda d: d)(df)


def test_flow_merge_counts_an_item_once_per_label(spark):
    forked = flow.fork(spark.range(4), {"even": lambda d: d.where("id % 2 = 0"), "all": lambda d: d})
    merged = flow.merge([forked, forked], ["id"])
    assert sorted((r.label, r.id) for r in merged.collect()) == [("all", 0), ("all", 1), ("all", 2), ("all", 3), ("even", 0), ("even", 2)]


def test_region_settings(spark):
    rows = spark.createDataFrame([("[0.1, 0.2]",), ('{"start": 0.3}',), (None,), ("nonsense",), ("[]",)], "s string")
    begin, end = configs.region(F.col("s"))
    assert [tuple(r) for r in rows.select(begin, end).collect()] == [(0.1, 0.2), (0.3, 1.0), (0.0, 1.0), (0.0, 1.0), (0.0, 1.0)]


def test_loop_ends(spark):
    start = spark.createDataFrame([(1, 0), (2, 5), (3, 9)], "id int, left int")
    down = lambda df, n: df.select("id", F.greatest(F.lit(0), F.col("left") - 1).alias("left"))
    done = flow.loop(start, down)
    assert (done.rounds, done.code) == (10, 0) and {r.left for r in done.rows.collect()} == {0}
    few = flow.loop(start, down, breaks={3: F.max("left") < -1, 7: F.count_if(F.col("left") > 0) < 2})
    assert (few.rounds, few.code) == (5, 7) and sorted(r.left for r in few.rows.collect()) == [0, 0, 4]
    sums = flow.loop(start, down, settled=lambda df: F.count_if(F.col("left") > 6))
    assert sums.rounds == 1
    assert flow.loop(start.limit(0), down).code == 0
    with pytest.raises(RuntimeError, match="did not settle in 4 rounds"):
        flow.loop(start, down, most=4)


def test_configuration_over_defaults(spark):
    defaults = {"a": 1, "b": {"c": 0.5, "d": {"e": True}}, "f": "x", "g": ["p", "q"]}
    texts = ['{"a": 7, "b": {"c": 2, "d": {"e": false}}, "f": "", "g": []}', '{"a": "7", "b": {"c": true}, "f": 3, "g": "p", "z": 1}', '{"b": 4}', "[1]", "nonsense", None, '{"a": null, "b": null}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c.asDict(recursive=True) for r in df.select("i", configs.loaded(F.col("t"), defaults).alias("c")).collect()}
    assert got == {0: {"a": 7, "b": {"c": 2.0, "d": {"e": False}}, "f": "", "g": []}} | dict.fromkeys(range(1, 7), defaults)
