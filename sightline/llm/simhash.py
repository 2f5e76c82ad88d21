"""SimHash near-duplicates by multi-index hashing.

Fingerprints are 64 bits wide. Two of them within three differing bits have a half in which at most one bit differs, so
each distinct fingerprint is stored under its two halves, every fingerprint looks up the 33 values within one bit of
each of its halves, and each match's complete distance is checked. Equal fingerprints are one node, so copies never
meet in pairs, and the links between different fingerprints go to a distributed component search.

A null or empty text, or one of white space, has fingerprint zero and links like any other; a text of fewer words than a
shingle is one shingle; repeated rows link to each other; null ids belong to their fingerprint's component and are never
its smallest id (a component of null ids alone has a null id); an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm._common import append_columns, materialize, release
from sightline.llm.components import components

SEED, SHINGLE, MOST_BITS = 42, 3, 3
#: Fixed by the pigeonhole: a half of a pair within MOST_BITS bits differs in at most MOST_BITS // 2 bits.
HALF = 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 majority bits over the XXH64 of all word shingles (repeats included) of the text with A-Z in lower case."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(x) for x in zip(*(words[i:] for i in range(shingle)), strict=False)] or [b" ".join(words)]
    h = xxhash.xxh64_intdigest
    sums = np.zeros(64, np.int64)
    for i in range(0, len(parts), 4096):
        block = np.array([h(x, SEED) for x in parts[i : i + 4096]], np.uint64)
        sums += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * sums > len(parts), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, text: str = "text", shingle: int = SHINGLE, keep_text: bool = True) -> DataFrame:
    """Add fp, the fingerprint as a signed 64-bit number."""
    fields = [T.StructField("fp", T.LongType())]
    return append_columns(df, text, fields, lambda: lambda texts: [[fingerprint(t, shingle) for t in texts]], () if keep_text else (text,))


def _half(c, k: int):
    return F.shiftrightunsigned(c, HALF).cast("long") if k else c.bitwiseAND(F.lit((1 << HALF) - 1))


def links(distinct: DataFrame) -> DataFrame:
    """All pairs (u, v) of different fingerprints within MOST_BITS bits; distinct has a row (fp) for each fingerprint."""
    halves = F.array(*(F.struct(F.lit(k).alias("k"), _half(F.col("fp"), k).alias("value")) for k in (0, 1)))
    stored = distinct.select(F.col("fp").alias("v"), F.inline(halves))
    ball = F.array(F.lit(0).cast("long"), *(F.lit(1 << b).cast("long") for b in range(HALF)))
    probes = stored.select(F.col("v").alias("u"), "k", F.explode(F.transform(ball, lambda m: F.col("value").bitwiseXOR(m))).alias("value"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MOST_BITS
    return probes.join(stored, ["k", "value"]).where((F.col("u") < F.col("v")) & near).select("u", "v")


def group_near_duplicates(prints: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """From prints (doc_id, fp; read more than once, so cheap to read) the rows (fp, component_id, root)."""
    each = materialize(prints.groupBy("fp").agg(F.min(doc_id).alias("least")), "fingerprints")
    roots = components(links(each.select("fp")))
    nodes = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    nodes = materialize(nodes, "nodes")
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    out = materialize(nodes.select("fp", "root").join(least, "root").select("fp", "component_id", "root"), "components")
    release(each, nodes)
    return out


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Return doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) for each row."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = materialize(fingerprints(rows, shingle=shingle, keep_text=False), "prints")
    groups = group_near_duplicates(prints)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(groups, "fp").select("doc_id", hexed, "component_id")


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Keep one row of each component: that of the least doc_id (of equal or null ids, the first row read)."""
    names = [c for c in df.columns if c.lower() not in ("fp", "row_")]
    kept = materialize(fingerprints(df.select(*names), text, shingle).withColumn("row_", F.monotonically_increasing_id()), "documents")
    prints = kept.select(F.col(doc_id).alias("doc_id"), "fp", "row_")
    groups = group_near_duplicates(prints.select("doc_id", "fp"))
    first = prints.groupBy("fp").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row_")).alias("first"))
    keep = first.join(groups, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row_").alias("row_"))
    return kept.join(keep, "row_", "left_semi").select(*names)
