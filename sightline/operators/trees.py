"""Detections nested in detections, as (id, parent_id) rows, walked by pointer doubling.

A round joins all upward paths of 2^k steps with the finished ones and with each other, so that rounds grow with the
logarithm of the depth; neither rows nor depth are limited. As in a recursive query, a node gives a row for each of its
paths from a root, nodes below a missing parent or in a circle without a root give none, and a circle below a root, which
has endless paths, is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sightline.session import delete, materialize, new_folder

#: Characters of a piece of text.
PIECE = 1 << 20


def pieces(nodes: DataFrame, fields: list[str], size: int = PIECE) -> DataFrame:
    """The texts of nested() in pieces: rows (id, place, payload), whose payloads in order of place make a root's text.

    The paths from the roots are walked and sorted by ranges, so that the nodes of one root, however many, are dealt over the
    tasks. A task writes its nodes from top to bottom and holds one piece of about size characters, which ends between nodes;
    the brackets where two tasks meet come from a root and a depth at each end of a task, on the driver."""
    own = nodes.groupBy("id").agg(F.min(F.to_json(F.struct(*fields))).alias("own"))
    rows = walk(nodes.select("id", "parent_id"), paths=True).join(own, "id").select("root", "path", "depth", "own")
    schema = T.StructType.fromDDL(f"id {nodes.schema['id'].dataType.simpleString()}, part long, n long, payload string, depth long, open long")
    arrow = to_arrow_schema(schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, root, text, length, begin, open_ = TaskContext.get().partitionId(), 0, None, [], 0, 0, 0

        def piece(end: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((root, part, n, "".join(text) + end, begin, open_), arrow, strict=True)], schema=arrow)

        for b in batches:
            for r, depth, own in zip(*(b.column(c).to_pylist() for c in ("root", "depth", "own")), strict=True):
                if text and (r != root or length >= size):
                    yield piece("]}" * open_ if r != root else "")
                    n, text, length = n + 1, [], 0
                node = (_between(open_, depth) if r == root else "") + own[:-1] + ',"children":['
                begin = begin if text else depth
                root, open_, length = r, depth + 1, length + len(node)
                text.append(node)
        if text:
            yield piece("")

    stored = materialize(rows.repartitionByRange("root", "path").sortWithinPartitions("root", "path").mapInArrow(write, schema), "pieces")
    ends = stored.groupBy("part").agg(F.min_by(F.struct("id", "depth"), "n").alias("first"), F.max_by(F.struct("id", "open"), "n").alias("last"), F.max("n").alias("n")).orderBy("part").collect()
    leads = [_between(a.last.open, z.first.depth) if a and a.last.id == z.first.id else "" for a, z in zip([None, *ends], ends)]
    tails = ["" if z and a.last.id == z.first.id else "]}" * a.last.open for a, z in zip(ends, [*ends[1:], None])]
    columns = {"part": pa.array([e.part for e in ends], pa.int64()), "most": pa.array([e.n for e in ends], pa.int64()), "lead": pa.array(leads, pa.string()), "tail": pa.array(tails, pa.string())}
    joined = stored.join(nodes.sparkSession.createDataFrame(pa.table(columns)), "part")
    payload = F.concat(F.when(F.col("n") == 0, F.col("lead")).otherwise(""), "payload", F.when(F.col("n") == F.col("most"), F.col("tail")).otherwise(""))
    return joined.select("id", (F.shiftleft("part", 33) + F.col("n")).alias("place"), payload.alias("payload"))


def _between(open_: int, depth: int) -> str:
    """What stands between a node with open_ lists open after it and the next node of the root."""
    return "]}" * (open_ - depth) + ("," if open_ > depth else "")


def nested(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """From (id, parent_id, fields) a row (id, payload) of each root: a JSON object with the fields and, as children, the
    objects of its parts in the order of their ids. A root's text is one value here; where it may not fit a row, use pieces()."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("place", "payload"))), lambda x: x["payload"])
    return pieces(nodes, fields).groupBy("id").agg(F.array_join(parts, "").alias("payload"))


def walk(nodes: DataFrame, paths: bool = False) -> DataFrame:
    """From (id, parent_id) the rows (id, root, depth) of everything reachable from a node without parent; with paths also the
    ids from the root to the node."""
    spark = nodes.sparkSession
    base = new_folder(spark, "walk")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    path = [F.array("id").alias("path")] if paths else []
    found = stored(nodes.where("parent_id is null").select("id", F.col("id").alias("root"), F.lit(0).alias("depth"), *path), "roots")
    up = stored(nodes.where("parent_id is not null").select("id", F.col("parent_id").alias("top"), *path), "up0")
    total, steps, k = up.count(), 1, 0
    while True:
        longer = [F.concat("above", "path").alias("path")] if paths else []
        above = found.select(F.col("id").alias("top"), "root", (F.col("depth") + F.lit(steps)).alias("depth"), *([F.col("path").alias("above")] if paths else []))
        more = stored(up.join(above, "top").select("id", "root", "depth", *longer), f"found{k}")
        # the paths of a length are the paths one longer without their first step: where none ends here, none is longer
        if more.isEmpty():
            return found
        if steps > total:
            raise ValueError("a node reachable from a root is its own ancestor")
        found = found.union(more)
        further = up.select(F.col("id").alias("top"), F.col("top").alias("next"), *([F.col("path").alias("above")] if paths else []))
        up, old = stored(up.join(further, "top").select("id", F.col("next").alias("top"), *longer), f"up{k + 1}"), f"{base}/up{k}"
        delete(spark, old)
        steps, k = 2 * steps, k + 1
