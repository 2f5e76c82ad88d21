"""Importance resampling towards a target by hashed word runs, with word tries.

A task reads its texts into a trie: a node stands for a run of words, holds how often it was met and the state of the CRC-32
of its text, which a child carries on from. When the task ends, or the trie has MOST_NODES nodes, the counts are added to the
buckets (CRC modulo their number), and every task sends its bucket totals, which are merged. From the totals of the corpus
and of the target each bucket gets a gain. Documents are scored by walking a trie again, whose nodes carry the gain of their
bucket: a document's weight is the floored mean of the gains along its paths. Scores add noise that follows from the id's
hash (Gumbel), so that the highest scores are a draw without replacement.

Ranks are counted over a range sort of those documents alone that reach the lowest score drawn, which the numbers of documents
by score tell; scores are integers between a gain's least and its greatest plus what the noise of 32 bits can be, some
60,000 values at most.

A null text has no words; a document without features has weight 0; documents of fewer than MIN_WORDS words get a score, but
are never drawn. A null doc_id is hashed as an empty string and comes last among equal scores, repeated rows are scored and
drawn each for itself, long texts are read in pieces of CHUNK bytes, an empty table gives no rows (an empty target gives gains
too), and columns that clash with the added ones are replaced.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sightline.llm._common import append_columns, materialize, slices
from sightline.llm.decontaminate import fold

BUCKETS, LONGEST, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Nodes of a task's trie (some 300 bytes each); beyond it the counts go to the buckets and the trie starts afresh.
MOST_NODES = 500_000
CHUNK = 1 << 20


class _Depth(dict):
    """Nodes of one depth by (parent, word), or by word at depth 1; a new one is made when it is first walked to."""

    def __init__(self, above: _Depth | None, attach: Callable[[int], int]):
        self.above, self.attach, self.crcs, self.values = above, attach, array("q"), array("q")

    def __missing__(self, key) -> int:
        node = self[key] = len(self.crcs)
        crc = zlib.crc32(key) if self.above is None else zlib.crc32(b" " + key[1], self.above.crcs[key[0]])
        self.crcs.append(crc)
        self.values.append(self.attach(crc))
        return node


class Trie:
    """Runs of up to `longest` words. A node has the CRC of its run and a value, attach(CRC) at first."""

    def __init__(self, longest: int, attach: Callable[[int], int]):
        self.depths: list[_Depth] = []
        for _ in range(longest):
            self.depths.append(_Depth(self.depths[-1] if self.depths else None, attach))

    def __len__(self) -> int:
        return sum(map(len, self.depths))

    def walk(self, words: list[bytes], old: int = 0) -> Iterator[tuple[_Depth, np.ndarray]]:
        """Each depth with the nodes of all its runs that end after the first old words."""
        nodes: list[int] = []
        for d, depth in enumerate(self.depths):
            nodes = list(map(depth.__getitem__, zip(nodes, words[d:], strict=False) if d else words))
            yield depth, np.array(nodes[max(0, old - d) :], np.int64)


def pieces(text: str | None, longest: int) -> Iterator[tuple[list[bytes], int]]:
    """(words, how many of them came before) of a text, a piece after the other."""
    b, at, before = fold(text), 0, []
    while at < len(b):
        cut = b.find(b" ", at + CHUNK)
        end = len(b) if cut < 0 else cut
        words = before + b[at:end].split()
        yield words, len(before)
        before = words[max(0, len(words) - longest + 1) :]
        at = end


def bucket_totals(df: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n) over all runs of all texts."""
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        trie = Trie(longest, lambda crc: 0)

        def merge() -> Trie:
            for depth in trie.depths:
                np.add.at(total, np.frombuffer(depth.crcs, np.int64) % buckets, np.frombuffer(depth.values, np.int64))
            return Trie(longest, lambda crc: 0)

        for batch in batches:
            for part in slices(batch, "text"):
                for value in part.column("text").to_pylist():
                    for words, old in pieces(value, longest):
                        for depth, nodes in trie.walk(words, old):
                            met, n = np.unique(nodes, return_counts=True)
                            np.frombuffer(depth.values, np.int64)[met] += n
                        if len(trie) > MOST_NODES:
                            trie = merge()
        merge()
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], schema=arrow)

    return df.select(F.col(text).alias("text")).mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> list[int]:
    """Each bucket's gain, on the driver (a number per bucket)."""
    both = []
    for df in (docs, target):
        n = np.zeros(buckets, np.int64)
        found = bucket_totals(df, buckets=buckets, longest=longest).toArrow()
        n[found["bucket"].to_numpy()] = found["n"].to_numpy()
        both.append([float(x) for x in n])
    s, t = both
    all_s, all_t = sum(s), sum(t)
    return [math.floor(1000 * math.log((y + 1) * (all_s + buckets) / ((x + 1) * (all_t + buckets)))) for x, y in zip(s, t, strict=True)]


def weigh(df: DataFrame, gain: list[int], text: str = "text", longest: int = LONGEST, keep_text: bool = True) -> DataFrame:
    """Add n_words, n_features and weight."""
    fields = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]

    def make():
        attach = lambda crc: gain[crc % len(gain)]
        trie = Trie(longest, attach)

        def work(texts: list) -> list:
            nonlocal trie
            out: list[tuple[int, int, int]] = []
            for value in texts:
                n_words = n = total = 0
                for words, old in pieces(value, longest):
                    n_words += len(words) - old
                    for depth, nodes in trie.walk(words, old):
                        n += len(nodes)
                        total += int(np.frombuffer(depth.values, np.int64)[nodes].sum()) if len(nodes) else 0
                    if len(trie) > MOST_NODES:
                        trie = Trie(longest, attach)
                out.append((n_words, n, total // n if n else 0))
            return [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]

        return work

    return append_columns(df, text, fields, make, drop=[] if keep_text else [text])


def noise(doc_id, seed: int = SEED):
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32))))


def draw(weighed: DataFrame, doc_id: str = "doc_id", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Add score, and rank for those drawn: percent of the documents of at least min_words words."""
    names = [c for c in weighed.columns if c.lower() not in ("score", "rank")]
    scored = weighed.select(*names).withColumn("score", F.col("weight") + noise(F.col(doc_id), seed))
    scored = materialize(scored, "scored")
    eligible = F.col("n_words") >= min_words
    by_score = scored.where(eligible).groupBy("score").agg(F.count("*").alias("n")).toArrow()
    scores, n = by_score["score"].to_numpy(), by_score["n"].to_numpy()
    quota = int(n.sum()) * percent // 100
    down = np.argsort(-scores)
    reached = np.searchsorted(np.cumsum(n[down]), quota) if quota else 0
    lowest = int(scores[down[reached]]) if quota else None
    above = eligible & (F.col("score") >= lowest) if quota else F.lit(False)
    order = [F.desc("score"), F.asc_nulls_last(doc_id), F.xxhash64("n_features", "weight")]
    sorted_ = scored.where(above).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(sorted_.withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").toArrow()
    n = sizes["n"].to_numpy().astype(np.int64)
    before = scored.sparkSession.createDataFrame(pa.table({"part": sizes["part"], "before": pa.array(np.cumsum(n) - n, pa.int64())}))
    # a number for each partition of the sort
    ranked = placed.withColumn("part", part).join(before, "part")
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    ranked = ranked.select(*scored.columns, F.when(rank <= quota, rank).alias("rank"))
    return scored.where(~F.coalesce(above, F.lit(False))).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, longest: int = LONGEST, keep_text: bool = True) -> DataFrame:
    """Documents (doc_id, text, any others) with n_words, n_features, weight, score and rank towards the texts of target."""
    return draw(weigh(docs, gains(docs, target, buckets, longest), longest=longest, keep_text=keep_text), percent=percent)
