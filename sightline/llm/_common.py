"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sightline.session import materialize, new_folder, own_shuffles, release  # noqa: F401

#: Bytes of text that one slice of an Arrow batch may hold before Python objects are made from it.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of texts; one whose files give fewer splits than there are slots (a single row group, say) is dealt out first,
    as the work on a text outweighs moving it."""
    df, slots = read(spark, sf_dir, table), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE_BYTES of the given string column each (a longer text stays whole)."""
    if not batch.num_rows:
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > SLICE_BYTES:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    yield batch.slice(begin)


def append_columns(
    df: DataFrame,
    text: str,
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[[list], list]],
    drop: Sequence[str] = (),
) -> DataFrame:
    """Add columns that a function computes from whole texts, a slice of rows at a time.

    make() runs once per task and returns a function from a list of texts (None for null) to one list or Arrow
    array per field. Columns of df that clash with an added field (letter case ignored) are replaced by it.
    """
    lost = {f.name.lower() for f in fields} | {d.lower() for d in drop}
    kept = [f for f in df.schema.fields if f.name.lower() not in lost]
    if not isinstance(df.schema[text].dataType, T.StringType):
        raise TypeError(f"{text} must be a string column")
    out = T.StructType([*kept, *(T.StructField(f.name, f.dataType, True) for f in fields)])
    names = [f.name for f in kept]
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text):
                added = work(part.column(text).to_pylist())
                arrays = [part.column(n) for n in names]
                for values, field in zip(added, list(arrow)[len(names) :], strict=True):
                    arrays.append(values if isinstance(values, pa.Array) else pa.array(values, field.type))
                arrays = [a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, out)
