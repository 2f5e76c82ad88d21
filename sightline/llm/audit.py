"""Interaction audit of document filters by Walsh-Hadamard sums.

Five filters judge every document on its own: A few words, B many repeated words, C many capitals, D symbols, E a copy of a
document of smaller id. What a document fails is a mask of five bits. For every part (a column's value) and label (good,
toxic, both, neither) 32 signed sums are added up, one per subset of the filters: the sign of a document in it is the parity
of the subset's filters that it fails. The sums are the Walsh-Hadamard transform of the 32 mask cells, so that the inverse
transform gives the cells exactly; every order of the filters and the Shapley values are functions of the cells. A document
that fails k filters is removed by each of them in 120 / k of the 120 orders.

Sums can be corrected, so that the only table-wide filter, E, needs no join and no window: every document is added as a copy,
and one row per distinct text (the least doc_id that has it, found by a grouped minimum with map-side partial results) takes
that back for the documents of this id. A text is known by its SHA-256. However many copies a text has, a task sends one row
of them. Before that, the rows of one doc_id are brought together once, which the labels need anyway.

Null texts are empty, and empty ones fail A alone, beside E; a null part is the empty string; rows of equal doc_id and text
are no copies of each other (no smaller doc_id has their text), a null doc_id is no copy, is copied by none and has no label;
of several labels of a doc_id the largest counts. Long texts are read in pieces of CHUNK bytes. An empty table gives no rows.
Columns other than doc_id, text and the part are not read, so that none can clash.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm._common import append_columns, materialize

FILTERS = "ABCDE"
#: Fixed values of the filters: words at least, distinct words and capitals in percent, symbols.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
_SYMBOL = re.compile(r"[#$%&*|]")
_NOT_CAPITAL = bytes(c for c in range(256) if not 65 <= c <= 90)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
COPY = 1 << FILTERS.index("E")
#: Bytes of a text whose words are split at a time.
CHUNK = 4 << 20
SUBSETS = 1 << len(FILTERS)


def chunks(text: bytes, size: int):
    """Pieces of a text that end at white space, of about size bytes unless a word is longer."""
    at = 0
    while at + size < len(text):
        cut = _SPACE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def own_mask(text: str | None) -> int:
    """The filters that a text fails by itself."""
    text = text or ""
    b = text.encode()
    n, distinct = 0, set()
    for piece in chunks(b, CHUNK):
        words = piece.split()
        n += len(words)
        distinct.update(words)
    fails = (n < MIN_WORDS, 100 * len(distinct) < MIN_DISTINCT * n, 100 * len(b.translate(None, _NOT_CAPITAL)) > MAX_CAPITALS * len(text), _SYMBOL.search(text) is not None)
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def _judge():
    def work(texts: list) -> list:
        return [pa.array([own_mask(t) for t in texts], pa.int32()), pa.array([hashlib.sha256((t or "").encode()).digest() for t in texts], pa.binary())]

    return work


def _sign(mask: Column, subset: int | Column) -> Column:
    """1, or -1 where the parity of the subset's failed filters is odd."""
    subset = F.lit(subset) if isinstance(subset, int) else subset
    return 1 - 2 * F.bit_count(mask.bitwiseAND(subset)).bitwiseAND(F.lit(1))


def documents(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """A row per doc_id and text (a row each where the id is null): mask (without E), hash, label (1 good, 2 toxic, 3 both)
    and owners, the parts of its rows with their numbers."""
    kept = docs.select("doc_id", "text", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    judged = append_columns(kept, "text", [T.StructField("mask", T.IntegerType()), T.StructField("hash", T.BinaryType())], _judge, drop=["text"])
    judged = materialize(judged, "judged")
    label = F.when(F.max("quality") == 1, 1).otherwise(0) + F.when(F.max("toxic") == 1, 2).otherwise(0)
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(label.alias("label")).where("label > 0")
    named = judged.where("doc_id is not null").join(said, "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    # both grouped by doc_id, as the join has dealt them out
    rows = named.groupBy("doc_id", "hash", "mask", "label", "part").agg(F.count("*").alias("n"))
    whole = rows.groupBy("doc_id", "hash", "mask", "label").agg(F.collect_list(F.struct("part", "n")).alias("owners"))
    nameless = judged.where("doc_id is null").select("doc_id", "hash", "mask", F.lit(0).alias("label"), F.array(F.struct("part", F.lit(1).cast("long").alias("n"))).alias("owners"))
    return whole.unionByName(nameless)


def parity_sums(rows: DataFrame) -> DataFrame:
    """The 32 signed sums of every part and label, as an array, from documents(); written first, as it is read twice."""
    rows = materialize(rows, "masks")
    each = lambda df, mask, sign: df.select(F.inline("owners"), mask.alias("mask"), "label", F.lit(sign).alias("sign"))
    copied = F.col("mask").bitwiseOR(F.lit(COPY))
    first = F.struct("doc_id", "mask", "label", "owners")
    firsts = rows.where("doc_id is not null").groupBy("hash").agg(F.min_by(first, "doc_id").alias("first")).select("first.*")
    nameless = rows.where("doc_id is null")
    signed = each(rows.where("doc_id is not null"), copied, 1).union(each(firsts, copied, -1)).union(each(firsts, F.col("mask"), 1)).union(each(nameless, F.col("mask"), 1))
    weight = F.col("n") * F.col("sign")
    sums = signed.groupBy("part", "label").agg(*(F.sum(weight * _sign(F.col("mask"), k)).alias(f"s{k}") for k in range(SUBSETS)))
    return sums.select("part", "label", F.array(*(f"s{k}" for k in range(SUBSETS))).alias("sums"))


def _each_mask(value) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), value)


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)


def cells(sums: DataFrame) -> DataFrame:
    """The numbers of documents by mask: the inverse transform, exact in integers."""
    inverse = _each_mask(lambda m: _total(F.transform("sums", lambda s, k: s * _sign(m, k))) / SUBSETS)
    return sums.select("part", "label", F.transform(inverse, lambda x: x.cast("long")).alias("cells"))


def orders() -> list[tuple[str, int, int, int]]:
    """Every order of the filters with its steps: (order, step, the step's filter, the filters before it), as bits."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    return [("".join(p), s + 1, bit[p[s]], sum(bit[f] for f in p[:s])) for p in permutations(FILTERS) for s in range(len(FILTERS))]


def evaluate(cells: DataFrame) -> DataFrame:
    """All orders and steps of every part: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    add = lambda label: F.sum(F.when(F.col("label").bitwiseAND(F.lit(label)) == label, F.col("cell")).otherwise(F.lit(0)))
    at = cells.select("part", "label", F.posexplode("cells").alias("mask", "cell"))
    by_mask = at.groupBy("part", "mask").agg(add(0).alias("n"), add(1).alias("good"), add(2).alias("toxic"))
    whole = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))
    steps = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(f).alias("own"), F.lit(b).alias("before")) for o, s, f, b in orders()))
    rows = whole.select("part", "c", F.inline(steps))
    own, before = F.col("own"), F.col("before")
    fails = lambda c, bits: c["mask"].bitwiseAND(bits) != 0
    total = lambda test, value=lambda c: c["n"]: _total(F.transform(F.filter("c", test), value))
    here = lambda c: fails(c, own) & ~fails(c, before)
    # 120 is a multiple of every number of failures
    share = lambda c: c["n"] * (F.lit(len(orders()) // len(FILTERS)) / F.bit_count(c["mask"])).cast("long")
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda c: ~fails(c, own.bitwiseOR(before))).alias("kept"),
        total(here).alias("removed"),
        total(lambda c: fails(c, own) & fails(c, before)).alias("redundant"),
        total(lambda c: c["mask"] == own).alias("unique_fails"),
        total(here, lambda c: c["good"]).alias("good_lost"),
        total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        total(lambda c: fails(c, own), share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """How the filters interact: a row per part, order of the filters and step."""
    return evaluate(cells(parity_sums(documents(docs, labels, part))))
