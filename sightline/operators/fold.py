"""State machines over the ordered rows of a key.

Rows are hash-partitioned by key and sorted (both by Spark, which spills); a task streams through them and holds the
state of one key at a time. A hot key keeps one task busy, but not its memory as long as what its machine holds is bounded by
rules of its own (live tracks, queue capacity); the clusterer alone holds all rows of its key, the detections of one picture.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], schema: str | T.StructType, start: Callable) -> DataFrame:
    """start(first row) makes a machine with step(row) and close(), both of which give rows (tuples of the schema)."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)
    keys = list(keys)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, current = None, None
        for b in batches:
            out: list[tuple] = []
            for row in b.to_pylist():
                key = [row[k] for k in keys]
                if machine is None or key != current:
                    if machine is not None:
                        out += machine.close()
                    machine, current = start(row), key
                out += machine.step(row)
            if out:
                yield batch(out)
        if machine is not None and (out := list(machine.close())):
            yield batch(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
