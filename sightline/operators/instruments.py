"""Pluggable instruments: user-defined aggregates in two phases.

An instrument keeps a small state per key: add(state, values) takes a batch of a key's values, merge(a, b) joins two states,
result(state) gives a row. States are made where the points lie, one per key and task (or per KEYS keys held), and only they
are shuffled; the states of a key, a few per task, are merged in one place. A hot key therefore costs a task no more than its
own share of the points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Keys whose states a task holds before it sends them.
KEYS = 10_000


class Instrument(Protocol):
    #: DDL of the result's columns.
    schema: str

    def zero(self) -> Any: ...

    def add(self, state: Any, values: np.ndarray) -> Any: ...

    def merge(self, a: Any, b: Any) -> Any: ...

    def result(self, state: Any) -> tuple: ...


class Quantiles:
    """Quantiles within a relative error: values are counted in buckets whose bounds grow by a factor, and a quantile is told by
    its bucket's middle. With factor (1 + e) / (1 - e) that is within a share e of the value of that rank. States have a count
    for each bucket met: 1,400 for values between 1e-6 and 1e6 at one percent."""

    def __init__(self, shares: dict[str, float], error: float = 0.01):
        self.shares, self.factor = shares, (1 + error) / (1 - error)
        self.schema = ", ".join(["n long", *(f"{name} double" for name in shares)])

    def zero(self) -> dict[int | None, int]:
        return {}

    def add(self, state: dict, values: np.ndarray) -> dict:
        plus = values[values > 0]
        buckets, n = np.unique(np.ceil(np.log(plus) / math.log(self.factor)).astype(np.int64), return_counts=True)
        found = dict(zip(buckets.tolist(), n.tolist(), strict=True))
        if low := int((values <= 0).sum()):  # counted as zero
            found[None] = low
        return self.merge(state, found)

    def merge(self, a: dict, b: dict) -> dict:
        return {k: a.get(k, 0) + b.get(k, 0) for k in a.keys() | b.keys()}

    def result(self, state: dict) -> tuple:
        total, zeros = sum(state.values()), state.get(None, 0)
        buckets = sorted(k for k in state if k is not None)
        upto = zeros + np.cumsum([state[k] for k in buckets], dtype=np.int64)
        out: list[float] = []
        for share in self.shares.values():
            rank = math.floor(share * (total - 1))
            k = int(np.searchsorted(upto, rank, "right"))
            out.append(0.0 if rank < zeros else 2 * self.factor ** buckets[k] / (self.factor + 1))
        return total, *out


def measure(points: DataFrame, keys: list[str], instrument: Instrument, value: str = "value") -> DataFrame:
    """The instrument's result for each key (null values and NaN are no points)."""
    key_fields = [points.schema[k] for k in keys]
    partial = T.StructType([*key_fields, T.StructField("state", T.BinaryType())])
    out = T.StructType([*key_fields, *T.StructType.fromDDL(instrument.schema).fields])
    arrow, arrow_out = to_arrow_schema(partial), to_arrow_schema(out)

    def sent(states: dict[tuple, Any]) -> pa.RecordBatch:
        rows = [(*k, cloudpickle.dumps(s)) for k, s in states.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(value).to_numpy(zero_copy_only=False)
            rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            number = {k: i for i, k in enumerate(dict.fromkeys(rows))}
            of = np.array([number[r] for r in rows])
            order = np.argsort(of, kind="stable")
            for k, part in zip(number, np.split(values[order], np.cumsum(np.bincount(of))[:-1]), strict=True):
                states[k] = instrument.add(states[k] if k in states else instrument.zero(), part)
            if len(states) >= KEYS:
                yield sent(states)
                states = {}
        if states:
            yield sent(states)

    def merge(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        state = instrument.zero()
        for s in table.column("state").to_pylist():
            state = instrument.merge(state, cloudpickle.loads(s))
        row = (*(k.as_py() for k in group), *instrument.result(state))
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow_out, strict=True)], schema=arrow_out)

    clean = points.select(*keys, points[value].cast("double").alias(value)).where(f"{value} is not null and not isnan({value})")
    return clean.mapInArrow(add, partial).groupBy(*keys).applyInArrow(merge, out)
