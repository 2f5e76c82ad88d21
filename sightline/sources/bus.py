"""Messages of a broker: routing, parsing, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.text import topic_part, topic_regex


def parse(messages: DataFrame, schema: str) -> DataFrame:
    """Add device, kind, subkind from the topic and the payload as a struct; what is not JSON goes to raw."""
    body = F.from_json("payload", schema, {"mode": "PERMISSIVE"})
    valid = F.try_parse_json("payload").isNotNull()
    return messages.select("*", topic_part(F.col("topic"), 1).alias("device"), topic_part(F.col("topic"), 2).alias("kind"), topic_part(F.col("topic"), 3).alias("subkind"), F.when(valid, body).alias("body"), F.when(~valid, F.col("payload")).alias("raw"))


def route(topic: Column, patterns: dict[str, str]) -> Column:
    """Name of the first pattern that fits the topic; null for none."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(patterns.items()):
        out = F.when(topic.rlike(topic_regex(pattern)), name).otherwise(out)
    return out


def split_valid(df: DataFrame, rule: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that fit a rule, and the quarantine of those that don't (or where it is null)."""
    good = F.coalesce(rule, F.lit(False))
    return df.where(good), df.where(~good)


def check(name: str, spec: dict) -> Column:
    """A constraint on one field as a predicate: required, enum, minimum, maximum, pattern, items (array length)."""
    c = F.col(name)
    out = F.lit(True)
    if "enum" in spec:
        out = out & c.isin(spec["enum"])
    if "minimum" in spec:
        out = out & (c >= spec["minimum"])
    if "maximum" in spec:
        out = out & (c <= spec["maximum"])
    if "pattern" in spec:
        out = out & c.rlike(spec["pattern"])
    if "items" in spec:
        out = out & (F.size(c) == spec["items"])
    return (c.isNotNull() & out) if spec.get("required") else (c.isNull() | out)


def stored(kind: Column) -> Column:
    """Which message kinds become table rows; the others only update state."""
    return kind.isin("register", "status", "heartbeat", "alerts")
