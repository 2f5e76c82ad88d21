"""Flows of DataFrame steps: forks, merges by label, and contracts that are checked while the plan is built."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.session import materialize, release

Step = Callable[[DataFrame], DataFrame]


def _missing(df: DataFrame, wanted: dict[str, str]) -> list[str]:
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [f"{name} {kind} (found {have.get(name, 'none')})" for name, kind in wanted.items() if have.get(name) != kind]


def contract(requires: dict[str, str] | None = None, produces: dict[str, str] | None = None) -> Callable[[Step], Step]:
    """A step that names the columns (and types) it reads and gives; a breach is a TypeError before anything runs."""

    def of(step: Step) -> Step:
        @wraps(step)
        def checked(df: DataFrame) -> DataFrame:
            if lost := _missing(df, requires or {}):
                raise TypeError(f"{step.__name__} requires {', '.join(lost)}")
            out = step(df)
            if lost := _missing(out, produces or {}):
                raise TypeError(f"{step.__name__} must produce {', '.join(lost)}")
            return out

        return checked

    return of


def map_fields(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename the fields that a step reads or gives; a field that isn't there is a TypeError."""
    if lost := [n for n in names if n not in df.columns]:
        raise TypeError(f"no field {', '.join(lost)}")
    return df.withColumnsRenamed(names)


def chain(df: DataFrame, *steps: Step) -> DataFrame:
    return reduce(lambda d, step: d.transform(step), steps, df)


def fork(df: DataFrame, branches: dict[str, Step], label: str = "label") -> DataFrame:
    """What every branch makes of df, marked with the branch's label. Branches share the scan where Catalyst can reuse it."""
    parts = [step(df).withColumn(label, F.lit(name)) for name, step in branches.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge(flows: list[DataFrame], identity: list[str], label: str = "label") -> DataFrame:
    """The union of flows in which an item (its identity columns) counts once per label."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), flows).dropDuplicates([label, *identity])


@dataclass(frozen=True)
class Loop:
    """What a loop ended with: its rows, the rounds that ran, and why it ended (0: nothing changed any more; else a break's code)."""

    rows: DataFrame
    rounds: int
    code: int


def loop(start: DataFrame, step: Callable[[DataFrame, int], DataFrame], settled: Callable[[DataFrame], Column] | None = None, breaks: dict[int, Column] | None = None, most: int = 100, label: str = "loop") -> Loop:
    """Repeat step(rows, round) until nothing changes or a break holds. Each round's rows are written (so that no plan grows and
    a lost executor repeats one round), and those of the round before deleted.

    settled is an aggregate over a round's rows that says all that may change (by default the rows themselves, as an
    order-free digest): two equal values in a row end the loop with code 0. breaks are aggregates by code, the first of
    which that is true ends it; they are computed with it in one pass. More than `most` rounds are an error."""
    told = settled or (lambda df: F.struct(F.count("*"), F.bit_xor(F.xxhash64(*df.columns)), F.sum(F.xxhash64(F.lit(7), *df.columns).cast("decimal(38,0)"))))
    now, before = materialize(start, label), None
    for n in range(most + 1):
        marks = now.agg(told(now).alias("state"), *(c.alias(f"code{k}") for k, c in (breaks or {}).items())).first()
        for k in breaks or {}:
            if marks[f"code{k}"]:
                return Loop(now, n, k)
        if n and marks["state"] == before:
            return Loop(now, n, 0)
        if n == most:
            break
        before, old = marks["state"], now
        now = materialize(step(old, n), label)
        release(old)
    raise RuntimeError(f"{label} did not settle in {most} rounds")
