"""Stored tables: changes return rows, writers don't lose each other's, and nothing is seen before its commit."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from sightline.sources import tables

SCHEMA = "id long, owner string, name string, n int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def make(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_changes_return_their_rows(spark, tmp_path):
    t = tables.StoredTable(spark, f"file://{tmp_path}/t", SCHEMA, "id", buckets=4)
    assert rows(t.read()) == [] and t.version() == 0
    assert rows(t.insert(make(spark, [(1, "a", "x", 1), (2, "b", "y", 2), (2, "b", "w", 2)]))) == [(1, "a", "x", 1), (2, "b", "w", 2)]
    assert rows(t.insert(make(spark, [(2, "c", "again", 9), (3, "a", "z", 3)]))) == [(3, "a", "z", 3)]
    changes = spark.createDataFrame([(1, "new", 0), (3, "", 7), (9, "none", 1)], "id long, name string, n int")
    assert rows(t.update(changes)) == [(1, "a", "new", 1), (3, "a", "z", 7)]
    asked = spark.createDataFrame([(1, "b"), (2, "b"), (9, "b")], "id long, owner string")
    assert rows(t.remove(asked)) == [(2, "b", "w", 2)]
    assert rows(t.read()) == [(1, "a", "new", 1), (3, "a", "z", 7)] and t.version() == 4
    assert rows(t.read(1)) == [(1, "a", "x", 1), (2, "b", "w", 2)]
    t.vacuum(keep=1)
    assert rows(t.read()) == [(1, "a", "new", 1), (3, "a", "z", 7)]
    assert rows(t.insert(make(spark, []))) == []
    other = tables.StoredTable(spark, f"file://{tmp_path}/t", SCHEMA, "id", buckets=4)
    assert rows(other.read()) == rows(t.read())


def test_two_writers(spark, tmp_path):
    """Each commits on what the other has left; of one key exactly one insert returns a row."""
    path = f"file://{tmp_path}/t"

    def writer(w):
        t = tables.StoredTable(spark, path, SCHEMA, "id", buckets=2)
        return [rows(t.insert(make(spark, [(i, f"w{w}", "n", i), (100 + 10 * w + i, f"w{w}", "own", i)]))) for i in range(4)]

    with ThreadPoolExecutor(2) as pool:
        returned = [r for made in pool.map(writer, (0, 1)) for one in made for r in one]
    t = tables.StoredTable(spark, path, SCHEMA, "id", buckets=2)
    assert sorted(returned) == rows(t.read()) and len(returned) == 4 + 8 and t.version() == 8


def test_a_crash_before_the_commit(spark, tmp_path, monkeypatch):
    t = tables.StoredTable(spark, f"file://{tmp_path}/t", SCHEMA, "id", buckets=2)
    t.insert(make(spark, [(1, "a", "x", 1)]))
    real = tables.StoredTable._commit

    def crash(self, *args):
        raise KeyboardInterrupt

    monkeypatch.setattr(tables.StoredTable, "_commit", crash)
    with pytest.raises(KeyboardInterrupt):
        t.insert(make(spark, [(2, "a", "x", 1)]))
    assert rows(t.read()) == [(1, "a", "x", 1)]
    monkeypatch.setattr(tables.StoredTable, "_commit", real)
    assert rows(t.insert(make(spark, [(2, "a", "x", 1)]))) == [(2, "a", "x", 1)]
    monkeypatch.setattr(tables.StoredTable, "_commit", lambda *a: False)
    with pytest.raises(tables.Conflict):
        t.remove(spark.createDataFrame([(1,)], "id long"))
    assert len(rows(t.read())) == 2


def test_a_version_is_committed_once(spark, tmp_path):
    t = tables.StoredTable(spark, f"file://{tmp_path}/t", SCHEMA, "id")
    assert t._commit(1, {0: "a"}) and not t._commit(1, {0: "b"}) and t._folders(1) == {0: "a"}
