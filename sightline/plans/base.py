"""Registration of queries, and the derived views in DuckDB SQL for their oracles."""

from __future__ import annotations

from sightline.sources.fixtures import CATEGORY_OF, FILTERS, OTHERS, OTHERS_OF, SERIES_OF

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _case(values: dict, other, column: str = "event_type") -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {show(v)}" for k, v in values.items()) + f" ELSE {other if str(other).startswith("CASE") else show(other)} END"


_K = "CAST(json_extract(props, '$.k') AS INT)"
DET = f"""det AS (
    SELECT event_id AS det_id, user_id AS device_id, ts, date_trunc('day', ts) AS frame_ts, {_case(CATEGORY_OF, _case(OTHERS, -1, f"event_id % {OTHERS_OF}"))} AS category_id,
        CASE WHEN value >= 200 THEN 1.0::DOUBLE ELSE value / 200 END AS confidence,
        CAST(({_K} % 10) * 4 AS DOUBLE) AS x1, CAST(({_K} // 10) * 4 AS DOUBLE) AS y1,
        CAST(({_K} % 10) * 4 + 40 + event_id % 7 AS DOUBLE) AS x2, CAST(({_K} // 10) * 4 + 60 + event_id % 11 AS DOUBLE) AS y2,
        CAST(CASE WHEN event_type = 'click' THEN (event_id * 2654435 + {_K} * 40503) % 67108864 ELSE 0 END AS INT) AS attr_bits
    FROM events)"""
FILTER = "filters AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{n}', {list(c)}, {a}, {o})" for i, n, c, a, o in FILTERS) + ") AS t(filter_id, name, cats, attr_mask, ord))"
ENABLED = "enabled AS (SELECT filter_id, name, attr_mask, ord, unnest(cats) AS category_id FROM filters)"
SCORE = "CASE WHEN category_id <> 0 OR attr_mask = 0 THEN 1.0 ELSE bit_count(attr_bits & attr_mask) / bit_count(attr_mask)::DOUBLE END"
PAIRS = f"pairs AS (SELECT det.*, filter_id, attr_mask, ord, {SCORE} AS attr_score FROM det JOIN enabled USING (category_id))"
MATCHED = "matched AS (SELECT * FROM pairs WHERE category_id <> 0 OR (attr_bits <> 0 AND attr_score >= 0.75))"
ALL_DET = f"WITH RECURSIVE {DET}, {FILTER}, {ENABLED}, {PAIRS}, {MATCHED}"
POINTS = f"points AS (SELECT event_id AS seq, {_case(SERIES_OF, 'cache.references')} AS series, user_id AS device_id, ts, value, props FROM events)"
MESSAGES = "messages AS (SELECT event_id AS msg_id, 'devices/' || user_id || '/' || event_type AS topic, props AS payload, ts FROM events)"
_RGB = "CAST(l_quantity * 5 AS INT) AS r, CAST(l_partkey * 37 % 256 AS INT) AS g, CAST(l_suppkey * 101 % 256 AS INT) AS b"
PIXELS = f"""px AS (SELECT l_orderkey AS region_id, CAST(l_partkey % 8 AS INT) AS px_x, CAST(l_suppkey % 8 AS INT) AS px_y, {_RGB} FROM lineitem),
norm AS (SELECT *, r / 255::DOUBLE AS fr, g / 255::DOUBLE AS fg, b / 255::DOUBLE AS fb FROM px),
wide AS (SELECT *, greatest(fr, fg, fb) AS top, greatest(fr, fg, fb) - least(fr, fg, fb) AS span FROM norm),
turned AS (SELECT *, 60 * CASE WHEN span = 0 THEN 0.0 WHEN top = fr THEN (fg - fb) / span WHEN top = fg THEN (fb - fr) / span + 2 ELSE (fr - fg) / span + 4 END AS raw FROM wide),
hsv AS (SELECT * EXCLUDE (raw), CASE WHEN raw < 0 THEN raw + 360 ELSE raw END AS h, CASE WHEN top = 0 THEN 0.0 ELSE span / top * 100 END AS s, top * 100 AS v FROM turned)"""
