"""Strings: answers, descriptions, topics, times, telemetry."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def answer(text: Column) -> tuple[Column, Column]:
    """(confirmed, is_valid) of a yes/no answer."""
    low = F.trim(F.lower(text))
    yes = F.coalesce(F.startswith(low, F.lit("yes")), F.lit(False))
    return yes, yes | F.coalesce(F.startswith(low, F.lit("no")), F.lit(False))


def prompt(reasoning: Column, default: str = "a match") -> Column:
    return F.concat(F.lit("Is this: "), F.coalesce(F.nullif(reasoning, F.lit("")), F.lit(default)), F.lit("? Answer yes or no."))


def description(has, color) -> Column:
    """Sentence about a person; has(attribute) is a boolean column, color(part) a string column or null."""

    def worn(what: str, *parts: str) -> Column:
        shade = F.coalesce(*(F.nullif(color(p), F.lit("")) for p in parts), F.lit(None).cast("string"))
        return F.concat_ws(" ", shade, F.lit(what))

    # The words of alerts and their order.
    phrases = [
        F.when(has("Female"), "female"),
        F.when(has("AgeOver60"), "elderly").when(has("AgeLess18"), "young"),
        F.when(has("Hat"), worn("hat", "Hat")),
        *(F.when(has(a), w) for a, w in (("Glasses", "glasses"), ("Backpack", "backpack"), ("ShoulderBag", "shoulder bag"), ("HandBag", "handbag"))),
        F.when(has("LongSleeve"), worn("long sleeve", "UpperStride", "LongSleeve")).when(has("ShortSleeve"), worn("short sleeve", "ShortSleeve")),
        F.when(has("LongCoat"), worn("coat", "LongCoat")),
        F.when(has("Trousers"), worn("trousers", "LowerStripe", "Trousers")).when(has("Shorts"), worn("shorts", "Shorts")).when(has("Skirt&Dress"), worn("dress/skirt", "Skirt&Dress")),
    ]
    said = F.concat_ws(", ", *phrases)
    return F.when(said == "", F.lit("Detection alert")).otherwise(F.concat(F.lit("Person detected: "), said))


def track_id(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", *(p.cast("string") for p in parts))), 1, 16)


def topic_regex(pattern: str) -> str:
    """A topic pattern ("+" is one level) as an anchored regular expression."""
    return "^" + "/".join("[^/]+" if p == "+" else re.escape(p) for p in pattern.split("/")) + "$"


def topic_part(topic: Column, i: int) -> Column:
    return F.try_element_at(F.split(topic, "/"), F.lit(i + 1))


def ago(seconds: Column) -> Column:
    """Minutes under an hour, hours under a day, else days."""
    m = F.floor(seconds / 60)
    h = F.floor(m / 60)
    return F.when(m < 60, F.concat(m.cast("string"), F.lit("m ago"))).when(h < 24, F.concat(h.cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(h / 24).cast("string"), F.lit("d ago")))


def ago_or_date(seconds: Column, ts: Column) -> Column:
    """Minutes under an hour, hours under a day, else the date."""
    return F.when(seconds < 86400, ago(seconds)).otherwise(F.date_format(ts, "yyyy-MM-dd"))


def last_seen(seconds: Column, ts: Column, hours: bool = False) -> Column:
    """When a device was seen, in words; the time itself after two hours, or after a day where hours are told too."""
    many = lambda n, what: F.concat(F.floor(seconds / n).cast("string"), F.lit(f" {what} ago"))
    out = F.when(seconds.isNull(), "Never").when(seconds < 60, "Just now").when(seconds < 120, "1 minute ago").when(seconds < 3600, many(60, "minutes")).when(seconds < 7200, "1 hour ago")
    out = out.when(seconds < 86400, many(3600, "hours")) if hours else out
    return out.otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))


def prompts(listed: Column) -> Column:
    """The prompts of a comma-separated list."""
    return F.transform(F.split(listed, ","), lambda w: F.trim(w))


def merged(first: Column, second: Column) -> Column:
    """Two maps in one; where both have a key the second's value counts."""
    return F.map_zip_with(first, second, lambda _, p, q: F.coalesce(q, p))


def numbered(named: Column) -> Column:
    """A map with text keys by the numbers they are."""
    return F.transform_keys(named, lambda k, _: k.cast("int"))


def telemetry(line: Column) -> dict[str, Column]:
    """Typed fields of a board's status line; null where a field is missing."""
    found = lambda p, i=1: F.nullif(F.regexp_extract(line, p, i), F.lit(""))
    used, total = (found(r"RAM (\d+)/(\d+)MB", i).cast("long") for i in (1, 2))
    return {
        "ram_used_mb": used,
        "ram_total_mb": total,
        "ram_pct": F.round(used / total * 100, 1),
        "gpu_util": found(r"GR3D_FREQ (\d+)%").cast("long"),
        "gpu_temp": found(r"gpu@([\d.]+)C").cast("double"),
        "power_instant_mw": found(r"VDD_IN (\d+)mW/(\d+)mW", 1).cast("long"),
        "power_avg_mw": found(r"VDD_IN (\d+)mW/(\d+)mW", 2).cast("long"),
        "cpu_gpu_power_mw": found(r"VDD_CPU_GPU_CV (\d+)mW").cast("long"),
    }


def two_decimals(share: Column) -> Column:
    """A number from 0 to 1 with two decimals, rounded by its exact binary value (ties to even), as printf in C does; Spark's
    own formatting rounds the shortest decimal form. The number times 2**62 is a whole number."""
    one = 1 << 62
    hundred = F.expr("decimal(100)") * (share * float(one)).cast("long").cast("decimal(20,0)")
    whole = F.floor(hundred / F.lit(one).cast("decimal(20,0)")).cast("long")
    rest = hundred - whole.cast("decimal(20,0)") * F.lit(one).cast("decimal(20,0)")
    whole = F.when(rest < 0, whole - 1).otherwise(whole)
    rest = F.when(rest < 0, rest + F.lit(one).cast("decimal(20,0)")).otherwise(rest)
    half = F.lit(one // 2).cast("decimal(20,0)")
    up = (rest > half) | ((rest == half) & (whole % 2 == 1))
    n = whole + up.cast("long")
    return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
