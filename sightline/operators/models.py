"""Models that are injected, run over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def apply(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], reads: list[str], gives: str) -> DataFrame:
    """df's columns and what a model makes of those it reads. load() runs once a task and returns the model, which turns a
    frame of these columns into one of as many rows with the columns of gives (DDL)."""
    out = T.StructType([*df.schema.fields, *T.StructType.fromDDL(gives).fields])
    names = [f.name for f in T.StructType.fromDDL(gives).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            made = model(batch[reads]).set_axis(batch.index)
            yield pd.concat([batch, made[names]], axis=1)

    return df.mapInPandas(run, out)


def explode(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], gives: str) -> DataFrame:
    """What a model makes of df's rows where it gives any number of rows for one (a detector's boxes of a picture)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return df.mapInPandas(run, gives)
