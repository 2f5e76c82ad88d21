"""DuckDB SQL for order-dependent operators: recursion over the rows of a key in their order, a list as state."""

from __future__ import annotations

from sightline.operators.tracking import SUPPRESSED, WATCHING, Rules
from sightline.plans.base import ALL_DET
from sightline.sources.fixtures import FILTERS
from sightline.vocab import MAX_CLUSTERS, MAX_MERGES, MERGE_THRESHOLD, PERSON, WEIGHTS

_TRACK = "STRUCT(flt VARCHAR, kind INT, state VARCHAR, first_seen DOUBLE, confirmed DOUBLE, hits INT, best BIGINT, score DOUBLE, attempts INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, bits INT, colors VARCHAR[], last_seen DOUBLE)"


def tracks(rules: Rules, required: str, colors: str, confirmed: str = "false", valid: str = "false", until: str = "true") -> str:
    """Confirmation events of the tracker, by the device's messages one after the other: the detections of a message first, then
    a clean-up of all tracks of the device. required and colors: expressions of a detection; confirmed and valid: the verifier's
    answer in terms of best (the event's best detection); until: which events are returned."""
    inner = "(greatest(0.0, least(t.x2, r) - greatest(t.x1, l)) * greatest(0.0, least(t.y2, d) - greatest(t.y1, u)))"
    whole = f"((t.x2 - t.x1) * (t.y2 - t.y1) + (r - l) * (d - u) - {inner})"
    alike = f"(kind <> {PERSON} OR (t.bits <> 0 AND has <> 0 AND bit_count(t.bits & has) / sqrt(bit_count(t.bits)::DOUBLE * bit_count(has)) >= {rules.cosine!r}))"
    fits = f"t.flt = filter_id AND t.kind = kind AND now - t.last_seen <= {rules.ttl!r} AND {whole} > 0 AND {inner} / {whole} >= {rules.iou!r} AND {alike} AND (len(t.colors) = 0 OR len(shown) = 0 OR list_has_any(t.colors, shown))"
    box = "'x1': l, 'y1': u, 'x2': r, 'y2': d, 'bits': has, 'colors': shown, 'last_seen': now"
    named = "'flt': filter_id, 'kind': kind"
    return f"""{ALL_DET},
seen AS (SELECT device_id, filter_id, category_id AS kind, det_id, ord, ts, x1 AS l, y1 AS u, x2 AS r, y2 AS d, attr_bits AS has, attr_score AS found,
    ({required}) AS asks, ({colors}) AS shown, false AS ends FROM matched WHERE category_id <> -1),
ended AS (SELECT DISTINCT device_id, ts, true AS ends FROM det),
steps AS (SELECT *, epoch_us(ts) / 1e6 AS now, row_number() OVER (PARTITION BY device_id ORDER BY ts, ends, det_id, ord) AS step FROM (SELECT * FROM seen UNION ALL BY NAME SELECT * FROM ended)),
run AS (
    SELECT DISTINCT device_id, CAST(NULL AS VARCHAR) AS by_filter, CAST(NULL AS INT) AS by_kind, CAST(0 AS BIGINT) AS n, CAST([] AS {_TRACK}[]) AS tracks, false AS fired, 0.0::DOUBLE AS event_ts,
        0.0::DOUBLE AS first_seen, CAST(NULL AS BIGINT) AS best, 0.0::DOUBLE AS score, CAST(0 AS INT) AS hits, false AS req FROM steps
    UNION ALL
    SELECT device_id, filter_id, kind, step, CAST(CASE WHEN ends THEN list_filter(tracks,
            lambda t: now - t.last_seen <= {rules.ttl!r} AND NOT (t.state = '{SUPPRESSED}' AND now - t.confirmed > {rules.cooldown!r}))
        ELSE list_transform(known, lambda t, i: CASE WHEN i = place THEN {{{named},
            'state': CASE WHEN NOT fires THEN was.state WHEN again THEN '{WATCHING}' ELSE '{SUPPRESSED}' END,
            'first_seen': CASE WHEN again THEN now ELSE was.first_seen END, 'confirmed': CASE WHEN fires THEN now ELSE was.confirmed END,
            'hits': CASE WHEN again THEN 0 ELSE count END, 'best': CASE WHEN again THEN NULL ELSE best END, 'score': CASE WHEN again THEN 0.0 ELSE top END,
            'attempts': CASE WHEN fires AND asks THEN tries ELSE was.attempts END, {box}}} ELSE t END) END AS {_TRACK}[]),
        fires AND NOT ends, now, was.first_seen, best, top, CAST(count AS INT), asks
    FROM (SELECT *, fires AND asks AND NOT ({confirmed}) AND tries < {rules.attempts} AS again FROM (
        SELECT *, was.attempts + CASE WHEN ({valid}) AND NOT ({confirmed}) THEN 1 ELSE 0 END AS tries, was.state = '{WATCHING}' AND count >= {rules.hits} AND now - was.first_seen <= {rules.window!r} AS fires FROM (
        SELECT *, was.hits + CASE WHEN was.state = '{WATCHING}' THEN 1 ELSE 0 END AS count,
            CASE WHEN was.state = '{WATCHING}' AND found > was.score THEN det_id ELSE was.best END AS best,
            CASE WHEN was.state = '{WATCHING}' AND found > was.score THEN found ELSE was.score END AS top FROM (
        SELECT *, known[place] AS was FROM (
        SELECT *, CAST(CASE WHEN place > len(tracks) AND NOT ends THEN list_append(tracks, CAST({{{named}, 'state': '{WATCHING}', 'first_seen': now, 'confirmed': 0.0, 'hits': 0, 'best': NULL, 'score': 0.0, 'attempts': 0, {box}}} AS {_TRACK})) ELSE tracks END AS {_TRACK}[]) AS known FROM (
        SELECT steps.*, tracks, CASE WHEN ends THEN 0 ELSE coalesce(list_position(list_transform(tracks, lambda t: {fits}), true), len(tracks) + 1) END AS place
        FROM run JOIN steps ON steps.device_id = run.device_id AND steps.step = run.n + 1)))))))
SELECT device_id, by_filter AS filter_id, by_kind AS category_id, round(event_ts, 3) AS event_ts, round(first_seen, 3) AS first_seen, best AS best_det_id, round(score, 6) AS best_score, hits, req AS vlm_required
FROM run WHERE fired AND {until}"""


def routes(events: str, capacity: int) -> str:
    """Routing to alerts or a busy verifier; events is a query with device_id, event_ts, event_id, message, vlm_required and ready."""
    given = "STRUCT(event_id BIGINT, target VARCHAR, vlm_status VARCHAR)[]"
    one = lambda e, target, status="NULL": f"[{{'event_id': {e}, 'target': '{target}', 'vlm_status': {status}}}]"
    return f"""WITH RECURSIVE ev AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY event_ts, event_id) AS step,
    row_number() OVER (PARTITION BY device_id, message ORDER BY event_ts, event_id) = 1 AS opens FROM ({events})),
run AS (
    SELECT DISTINCT device_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS cause, CAST([] AS BIGINT[]) AS queue, CAST([] AS {given}) AS out FROM ev
    UNION ALL
    SELECT device_id, step, event_id, CASE WHEN NOT vlm_required OR ready THEN rest WHEN len(rest) >= {capacity} THEN list_append(rest[2:], event_id) ELSE list_append(rest, event_id) END,
        CAST(first || CASE WHEN NOT vlm_required THEN {one("event_id", "alerts")} WHEN ready THEN {one("event_id", "verify")} WHEN len(rest) >= {capacity} THEN {one("rest[1]", "alerts", "'timeout'")} ELSE [] END AS {given})
    FROM (SELECT ev.*, CASE WHEN ready AND opens THEN queue[2:] ELSE queue END AS rest, CAST(CASE WHEN ready AND opens AND len(queue) > 0 THEN {one("queue[1]", "verify")} ELSE [] END AS {given}) AS first
        FROM run JOIN ev ON ev.device_id = run.device_id AND ev.step = run.n + 1)),
gone AS (SELECT device_id, cause, unnest(out) AS o FROM run),
waiting AS (SELECT device_id, cause, unnest(queue) AS event_id FROM run QUALIFY n = max(n) OVER (PARTITION BY device_id))
SELECT device_id, o.event_id AS event_id, cause AS "at", o.target AS target, o.vlm_status AS vlm_status FROM gone
UNION ALL SELECT device_id, event_id, cause, 'queued', NULL FROM waiting"""


def claims() -> str:
    """claimed (detections with the filter that takes them and its mask) and unclaimed: filters of several categories take what is
    still free of theirs in a frame, one after the other, if it is two or more."""
    several = [f for f in sorted(FILTERS, key=lambda f: f[4]) if len(f[2]) >= 2]
    steps = ["free0 AS (SELECT * FROM det)"]
    for k, (filter_id, _, cats, mask, _) in enumerate(several):
        steps.append(f"claim{k} AS (SELECT *, '{filter_id}' AS filter_id, {mask} AS mask FROM free{k} WHERE category_id IN {cats} QUALIFY count(*) OVER (PARTITION BY device_id, frame_ts) >= 2)")
        steps.append(f"free{k + 1} AS (SELECT * FROM free{k} WHERE det_id NOT IN (SELECT det_id FROM claim{k}))")
    every = " UNION ALL ".join(f"SELECT * FROM claim{k}" for k in range(len(several)))
    return ", ".join([*steps, f"claimed AS ({every})", f"unclaimed AS (SELECT * FROM free{len(several)})"])


def clusters(threshold: float = MERGE_THRESHOLD) -> str:
    """Agglomerated detections of each frame and filter of several categories, and the detections that none claims."""
    node = "STRUCT(members BIGINT[], x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, area DOUBLE, category INT, kinds INT[], bits INT, confidence DOUBLE, cost DOUBLE)"
    w = WEIGHTS
    room = "((greatest(a.x2, b.x2) - least(a.x1, b.x1)) * (greatest(a.y2, b.y2) - least(a.y1, b.y1)))"
    rated = lambda n: f"CASE WHEN mask = 0 THEN 1.0 ELSE bit_count({n}.bits & mask) / bit_count(mask)::DOUBLE END"
    attr = f"CASE WHEN a.category = {PERSON} AND b.category = {PERSON} THEN ({rated('a')} + {rated('b')}) / 2 WHEN a.category = {PERSON} THEN {rated('a')} WHEN b.category = {PERSON} THEN {rated('b')} ELSE 0.5 END"
    packed = f"CASE WHEN {room} > 0 THEN least(1.0, (a.area + b.area) / {room}) ELSE 0.0 END"
    size = "CASE WHEN greatest(a.area, b.area) > 0 THEN least(a.area, b.area) / greatest(a.area, b.area) ELSE 0.0 END"
    alike = f"(({packed}) * {w['proximity']!r} + ({size}) * {w['size']!r} + {w['category']!r} + ({attr}) * {w['attribute']!r}) / {sum(w.values())!r}"
    pair = f"list_transform(nodes, lambda a, i: list_transform(nodes, lambda b, j: CASE WHEN i < j AND NOT list_has_any(a.kinds, b.kinds) THEN {{'s': {alike}, 'i': -i, 'j': -j}} END))"
    merged = f"""{{'members': a.members || b.members, 'x1': least(a.x1, b.x1), 'y1': least(a.y1, b.y1), 'x2': greatest(a.x2, b.x2), 'y2': greatest(a.y2, b.y2), 'area': a.area + b.area,
        'category': CASE WHEN a.area > b.area THEN a.category ELSE b.category END, 'kinds': a.kinds || b.kinds, 'bits': CASE WHEN b.bits <> 0 THEN b.bits ELSE a.bits END, 'confidence': greatest(a.confidence, b.confidence), 'cost': best.s}}"""
    first = "{'members': [det_id], 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'area': (x2 - x1) * (y2 - y1), 'category': category_id, 'kinds': [category_id], 'bits': attr_bits, 'confidence': confidence, 'cost': 1.0}"
    return f"""{ALL_DET}, {claims()},
groups AS (SELECT device_id, frame_ts, filter_id, any_value(mask) AS mask, CAST(list({first} ORDER BY det_id) AS {node}[]) AS nodes
    FROM claimed GROUP BY device_id, frame_ts, filter_id),
run AS (
    SELECT *, 0 AS n FROM groups
    UNION ALL
    SELECT device_id, frame_ts, filter_id, mask, CAST(list_append(list_filter(nodes, lambda x, k: k <> -best.i AND k <> -best.j), {merged}) AS {node}[]), n + 1
    FROM (SELECT *, nodes[-best.i] AS a, nodes[-best.j] AS b FROM (SELECT *, list_max(flatten({pair})) AS best FROM run WHERE n < {MAX_MERGES})) WHERE best.s >= {threshold!r}),
done AS (SELECT * FROM run QUALIFY n = max(n) OVER (PARTITION BY device_id, frame_ts, filter_id)),
placed AS (SELECT device_id, frame_ts, filter_id, unnest(nodes) AS c, unnest(range(1, len(nodes) + 1)) AS k FROM done),
kept AS (SELECT device_id, frame_ts, filter_id, c FROM placed QUALIFY row_number() OVER (PARTITION BY device_id, frame_ts, filter_id ORDER BY c.cost DESC, k) <= {MAX_CLUSTERS}),
every AS (SELECT device_id, frame_ts, filter_id, array_to_string(c.members, ',') AS members, c.category AS category_id, c.x1 AS x1, c.y1 AS y1, c.x2 AS x2, c.y2 AS y2, c.confidence AS confidence, c.cost AS cost FROM kept
    UNION ALL SELECT device_id, frame_ts, NULL, CAST(det_id AS VARCHAR), category_id, x1, y1, x2, y2, confidence, 1.0 FROM unclaimed)
SELECT device_id, strftime(frame_ts, '%Y-%m-%d') AS frame, filter_id, members, category_id, x1, y1, x2, y2, round(confidence, 6) AS confidence, round(cost, 6) AS cost FROM every"""
