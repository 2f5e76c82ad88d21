"""Versioned configurations: every save is the next version, the newest is active, a rollback saves an old one again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def versions(saves: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Add version (from 1) and is_active."""
    w = W.partitionBy(key).orderBy(*order)
    return saves.withColumns({"version": F.row_number().over(w), "is_active": F.lead(F.lit(1)).over(w).isNull()})


def rollback(versioned: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """The rows to insert for requests (key, to_version): a copy as the next version with a note; requests for versions that
    don't exist give none."""
    top = versioned.groupBy(key).agg(F.max("version").alias("top"))
    old = versioned.join(requests.withColumnRenamed("to_version", "version"), [key, "version"])
    note = F.concat(F.lit("Rollback to version "), F.col("version").cast("string"))
    return old.join(top, key).select(*(c for c in versioned.columns if c not in ("version", "is_active")), note.alias("description"), (F.col("top") + 1).alias("version"), F.lit(True).alias("is_active"))


def region(setting: Column, default: tuple[float, float] = (0.0, 1.0)) -> tuple[Column, Column]:
    """Begin and end of a region written in JSON as [begin, end] or {"start": begin, "end": end}; a bound that is left out
    or can't be read has its default."""
    pair, named = F.from_json(setting, "array<double>"), F.from_json(setting, "start double, end double")
    is_pair = F.startswith(F.ltrim(setting), F.lit("["))
    bound = lambda i, name: F.coalesce(F.when(is_pair, F.get(pair, F.lit(i))).otherwise(named[name]), F.lit(default[i]))
    return bound(0, "start"), bound(1, "end")


def loaded(text: Column, defaults: dict) -> Column:
    """A configuration in JSON as a struct of the defaults' fields (nested dicts, numbers, booleans, strings, lists of strings):
    what is given counts, and a field that is left out, null or of another type has its default, at every level. Fields without
    a default are left out; a text that is no JSON object gives the defaults alone."""

    def kind(value) -> T.DataType:
        if isinstance(value, dict):
            return T.StructType([T.StructField(k, kind(v)) for k, v in value.items()])
        if isinstance(value, list):
            return T.ArrayType(T.StringType())
        for own, t in ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType())):
            if isinstance(value, own):
                return t
        return T.StringType()

    def filled(v: Column, value, path: str) -> Column:
        if isinstance(value, dict):
            return F.struct(*(filled(v, inner, f"{path}.{k}").alias(k) for k, inner in value.items()))
        wanted = kind(value)
        # numbers and texts are not made of each other
        fits = {T.BooleanType: "^BOOLEAN$", T.StringType: "^STRING$", T.ArrayType: "^ARRAY"}.get(type(wanted), "^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        part = F.try_variant_get(v, path, "variant")
        found = F.when(F.schema_of_variant(part).rlike(fits), F.try_variant_get(v, path, wanted.simpleString()))
        default = F.array(*map(F.lit, value)).cast(wanted) if isinstance(value, list) else F.lit(value).cast(wanted)
        return F.coalesce(found, default)

    return filled(F.try_parse_json(text), defaults, "$")
