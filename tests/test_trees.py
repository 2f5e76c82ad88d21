"""Forests that are deep, have more nodes than a recursive query may give rows, or have odd nodes."""

import json

import pytest

from sightline.operators import trees
from sightline.plans.registry import ORACLE_SQL, QUERIES


def _walk(spark, rows):
    return sorted(tuple(r) for r in trees.walk(spark.createDataFrame(rows, "id long, parent_id long")).select("id", "root", "depth").collect())


def test_deep_chain(spark):
    rows = [(i, i - 1 if i else None) for i in range(1000)]
    assert _walk(spark, rows) == [(i, 0, i) for i in range(1000)]


def test_odd_nodes(spark):
    """A node with two parents, one given twice, a missing parent, and a circle without a root."""
    rows = [(1, None), (2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (7, None), (8, 7), (8, 7), (10, 99), (11, 10), (20, 21), (21, 22), (22, 20)]
    want = [(1, 1, 0), (2, 1, 1), (3, 1, 1), (4, 1, 2), (4, 1, 2), (5, 1, 3), (5, 1, 3), (7, 7, 0), (8, 7, 1), (8, 7, 1)]
    assert _walk(spark, rows) == want
    assert _walk(spark, [(20, 21), (21, 20)]) == []
    with pytest.raises(ValueError):
        _walk(spark, [(1, None), (2, 1), (2, 3), (3, 2)])


def test_nested_texts(spark):
    """Children in the order of their ids, below each of their parents; a text of any depth."""
    rows = [(1, None, "a"), (12, 1, "b"), (3, 1, 'c"'), (40, 3, None), (41, 3, "e"), (41, 12, "e"), (7, None, "f"), (99, 98, "lost")]
    found = {r.id: json.loads(r.payload) for r in trees.nested(spark.createDataFrame(rows, "id long, parent_id long, t string"), ["id", "t"]).collect()}
    leaf = lambda i, t, *c: {"id": i, "t": t, "children": list(c)} if t else {"id": i, "children": list(c)}
    assert found == {1: leaf(1, "a", leaf(3, 'c"', leaf(40, None), leaf(41, "e")), leaf(12, "b", leaf(41, "e"))), 7: leaf(7, "f")}
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(300)], "id long, parent_id long")
    text = trees.nested(chain, ["id"]).first().payload
    assert text == "".join(f'{{"id":{i},"children":[' for i in range(300)) + "]}" * 300
    assert trees.nested(chain.limit(0), ["id"]).count() == 0


def test_pieces_of_one_tree(spark):
    """A tree's text is written by several tasks in pieces of bounded size, and is the same text."""
    rows = [(i, (i - 1) // 3 if i else None) for i in range(2000)] + [(i, (i - 1 if i % 50 else None)) for i in range(5000, 5200)]
    df = spark.createDataFrame(rows, "id long, parent_id long")
    whole = {r.id: r.payload for r in trees.nested(df, ["id"]).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = trees.pieces(df, ["id"], 300).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.id: "".join(x.payload for x in sorted((x for x in found if x.id == r.id), key=lambda x: x.place)) for r in found} == whole
    assert len({r.place >> 33 for r in found if r.id == 0}) > 1 and max(len(r.payload) for r in found) < 500

    def nodes(x):
        return [x["id"], *(y for c in x["children"] for y in nodes(c))]

    assert sorted(i for t in whole.values() for i in nodes(json.loads(t))) == [i for i, _ in rows]


def test_detection_json_nests_the_whole_table(spark, sf):
    """One tree of all parts, whose depth grows with the table."""
    n = spark.read.parquet(f"{sf}/part.parquet").count()
    depth, last = 1, n - 1
    while last:
        depth, last = depth + 1, last // 4
    assert [tuple(r)[:2] + (r.levels,) for r in QUERIES["detection_json"](spark, sf).collect()] == [(0, n, depth)]
    assert "%" not in ORACLE_SQL["detection_json"]
