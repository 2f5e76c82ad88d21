"""Benchmark decontamination with an FM-index per training shard.

A shard is a few megabytes of documents. Its words are projected on the benchmark's vocabulary (known by hashes): every other
word can't be part of a match, and a stretch of them becomes one separator, like a document's end. Over that sequence of
symbols an FM-index is built once - suffix array by prefix doubling, Burrows-Wheeler transform in a wavelet matrix, a sample
of the suffix positions. All benchmark windows are searched backward, block by block and all of a block at once, their places
are found by walking to the next sampled position, and overlapping places are merged to spans.

Windows are n consecutive words of an item; a shorter item is one window; an item without words has none. Blocks of about
BLOCK_BYTES of benchmark text are made by Spark, a row each, and reach the tasks as files (long items are dealt over blocks, in
pieces that overlap), so that neither the driver nor a task holds the benchmark; a task holds one block and 8 bytes for every
word of the vocabulary. The texts are read once, however many blocks there are.

Null and empty texts have no words; long texts are a shard of their own; repeated rows are judged each for itself; items
with equal ids count as one item, and a null item id is written as an empty string; empty tables on either side give no
hits; columns that clash with the added ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sightline.llm._common import append_columns, new_folder, slices

#: Words of a window, bytes of benchmark text in a block, and words of an item in one piece.
WINDOW, BLOCK_BYTES, PIECE_WORDS = 10, 4 << 20, 100_000
#: Every SAMPLE-th text position keeps its place in the suffix array.
SAMPLE = 16
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def fold(text: str | None) -> bytes:
    """The text in lower case (A-Z only), with a space for all that is in no word."""
    return (text or "").encode().translate(_FOLD)


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case: runs of ASCII letters, digits and everything beyond ASCII."""
    return fold(text).split()


class Patterns:
    """The windows of a block of benchmark items, numbered; symbols count from 1, as the words do."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        symbol: dict[bytes, int] = {}
        numbers: dict[tuple, int] = {}
        owners: set[tuple[int, int]] = set()
        self.items = sorted({key for key, words in items if words})
        rank = {key: i for i, key in enumerate(self.items)}
        for key, words in items:
            ids = [symbol.setdefault(w, len(symbol) + 1) for w in words]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.add((numbers.setdefault(tuple(ids[i : i + window]), len(numbers)), rank[key]))
        self.words = list(symbol)
        self.length = np.array([len(w) for w in numbers], np.int32)
        self.symbols = np.zeros((len(numbers), window), np.int32)
        for w, k in numbers.items():
            self.symbols[k, : len(w)] = w
        own = np.array(sorted(owners), np.int32).reshape(-1, 2)
        self.owner = own[:, 1].copy()
        self.owner_from = np.searchsorted(own[:, 0], np.arange(len(numbers) + 1)).astype(np.int32)

    def row(self) -> dict:
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words], np.uint64)
        arrays = {k: getattr(self, k).tobytes() for k in ("length", "symbols", "owner", "owner_from")}
        return {"words": b"\n".join(self.words), "hashes": hashes.tobytes(), "items": self.items, **arrays}

    @classmethod
    def of(cls, row: dict) -> Patterns:
        out = cls.__new__(cls)
        out.words, out.items = row["words"].split(b"\n") if row["words"] else [], row["items"]
        for k in ("length", "symbols", "owner", "owner_from"):
            setattr(out, k, np.frombuffer(row[k], np.int32))
        out.symbols = out.symbols.reshape(len(out.length), -1)
        return out


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of symbols 0..sigma-1; the end sorts first. Doubling goes on where prefixes are still equal."""
    n, bits = len(text), max(1, int(sigma).bit_length())
    depth = max(1, 62 // bits)
    key, padded = np.zeros(n, np.int64), np.r_[text + 1, np.zeros(depth, np.int64)]
    for d in range(depth):
        key = key << bits | padded[d : d + n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = begin
    while True:
        lone = new & np.r_[new[1:], True]
        tied = np.flatnonzero(~lone)
        if not len(tied):
            return order
        at = order[tied]
        second = rank[np.minimum(at + depth, n)]
        key = begin[tied] * (n + 1) + second + 1
        perm = np.argsort(key, kind="stable")
        order[tied] = at[perm]
        key = key[perm]
        fresh = np.r_[True, key[1:] != key[:-1]]
        new[tied] = fresh
        begin[tied] = np.maximum.accumulate(np.where(fresh, tied, 0))
        rank[order[tied]] = begin[tied]
        depth *= 2


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        words = np.packbits(np.r_[bits, np.zeros(-len(bits) % 64 + 64, bool)], bitorder="little").view(np.uint64)
        self.words = words
        self.before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    def __init__(self, values: np.ndarray, sigma: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for level in reversed(range(max(1, int(sigma - 1).bit_length()))):
            bit = values >> level & 1 != 0
            self.levels.append((level, Bits(bit), int((~bit).sum())))
            values = np.r_[values[~bit], values[bit]]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position i."""
        begin, end = np.zeros_like(i), i
        for level, bits, zeros in self.levels:
            one = symbol >> level & 1 != 0
            b, e = bits.rank(begin), bits.rank(end)
            begin, end = np.where(one, zeros + b, begin - b), np.where(one, zeros + e, end - e)
        return end - begin

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for level, bits, zeros in self.levels:
            one, r = bits.get(i), bits.rank(i)
            out |= one.astype(np.int64) << level
            i = np.where(one, zeros + r, i - r)
        return out


class FMIndex:
    """Symbol 0 separates; it can't be searched."""

    def __init__(self, text: np.ndarray, sigma: int):
        self.n = len(text)
        order = suffix_array(text, sigma)
        before = np.where(order > 0, text[order - 1], 0)
        self.tree = WaveletMatrix(before, sigma)
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))]
        kept = (order % SAMPLE == 0) | (before == 0)
        self.kept, self.places = Bits(kept), order[kept]

    def search(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array ranges [lo, hi) of all patterns, by backward search."""
        lo, hi = np.zeros(len(length), np.int64), np.full(len(length), self.n, np.int64)
        for step in range(symbols.shape[1]):
            live = np.flatnonzero((step < length) & (lo < hi))
            c = symbols[live, length[live] - 1 - step]
            lo[live] = self.first[c] + self.tree.rank(c, lo[live])
            hi[live] = self.first[c] + self.tree.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by walking back to a sampled one."""
        out, steps = np.empty(len(rows), np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            there = self.kept.get(rows)
            out[live[there]] = self.places[self.kept.rank(rows[there])] + steps
            live, rows = live[~there], rows[~there]
            c = self.tree.access(rows)
            rows = self.first[c] + self.tree.rank(c, rows)
            steps += 1
        return out


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of the ranges and which range each is of."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + lo[which], which


class Shard:
    """Finds the windows of all blocks in the documents of a shard. hashes: of the benchmark's words, sorted; blocks: gives
    the blocks one after the other."""

    def __init__(self, hashes: np.ndarray, blocks: Callable[[], Iterator[Patterns]]):
        self.hashes, self.blocks = hashes, blocks
        self.ids: dict[bytes, int] = {}

    def _number(self, docs: list[list[bytes]]) -> None:
        """Numbers from 1 for words of the vocabulary that were not met before."""
        new = [w for w in set(chain.from_iterable(docs)) if w not in self.ids]
        if new and len(self.hashes):
            h = np.array([xxhash.xxh3_64_intdigest(w) for w in new], np.uint64)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            for i in np.flatnonzero(self.hashes[at] == h).tolist():
                self.ids[new[i]] = len(self.ids) + 1

    def __call__(self, docs: list[list[bytes]]) -> list[tuple[np.ndarray, list[str]]]:
        """Per document the numbers of the hit words and the ids of the items found."""
        self._number(docs)
        sizes = np.array([len(w) for w in docs], np.int64)
        begin = np.r_[0, np.cumsum(sizes + 1)]
        text = np.zeros(int(begin[-1]), np.int64)
        get = self.ids.get
        for words, b in zip(docs, begin.tolist(), strict=False):
            text[b : b + len(words)] = [get(w, 0) for w in words]
        keep = np.flatnonzero((text != 0) | np.r_[True, text[:-1] != 0][: len(text)])
        out: list[tuple[np.ndarray, list[str]]] = [(np.zeros(0, np.int64), []) for _ in docs]
        own, short = np.unique(np.r_[0, text[keep]], return_inverse=True)
        short = short[1:]
        if len(own) < 2:
            return out
        index = FMIndex(short, len(own))
        place_of = np.zeros(len(self.ids) + 1, np.int64)
        place_of[own] = np.arange(len(own))
        ends = np.zeros(len(short) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for block in self.blocks():
            self._search(block, index, place_of, ends, keep, begin, items)
        hit = keep[np.cumsum(ends)[:-1] > 0]
        owner = np.searchsorted(begin, hit, "right") - 1
        for d, at in zip(*_groups(owner, hit), strict=True):
            out[d] = (at - begin[d], sorted(items[d]))
        return out

    def _search(self, block: Patterns, index: FMIndex, place_of: np.ndarray, ends: np.ndarray, keep: np.ndarray, begin: np.ndarray, items: dict[int, set[str]]) -> None:
        """Add the places of a block's windows to ends (+1 where one begins, -1 after it) and the items to the documents'."""
        of_block = place_of[[0, *(self.ids.get(w, 0) for w in block.words)]]
        symbols, length = of_block[block.symbols], block.length.astype(np.int64)
        there = np.flatnonzero((symbols > 0).sum(1) == length)
        lo, hi = index.search(symbols[there], length[there])
        met = np.flatnonzero(lo < hi)
        if not len(met):
            return
        pairs = []
        for part in np.array_split(met, 1 + int((hi - lo)[met].sum()) // 1_000_000):
            rows, which = _ranges(lo[part], hi[part])
            place, window = index.locate(rows), there[part[which]]
            ends += np.bincount(place, minlength=len(ends)) - np.bincount(place + length[window], minlength=len(ends))
            pairs.append(np.unique(np.searchsorted(begin, keep[place], "right") - 1 << 32 | window))
        pair = np.unique(np.concatenate(pairs))
        members, which = _ranges(block.owner_from[pair & 0xFFFFFFFF].astype(np.int64), block.owner_from[(pair & 0xFFFFFFFF) + 1].astype(np.int64))
        mine = np.unique((pair >> 32)[which] << 32 | block.owner[members])
        for d, k in zip(*_groups(mine >> 32, mine & 0xFFFFFFFF), strict=True):
            items.setdefault(d, set()).update(block.items[i] for i in k.tolist())


def _groups(key: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    if not len(key):
        return [], []
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[at].tolist(), np.split(values, at[1:])


def merge_spans(text: str, hit: np.ndarray) -> list[dict]:
    """Character spans of runs of hit words."""
    if not len(hit):
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    cut = np.flatnonzero(np.diff(hit) > 1) + 1
    return [{"begin": places[r[0]][0], "end": places[r[-1]][1]} for r in np.split(hit, cut)]


_BLOCK = "words binary, hashes binary, items array<string>, length binary, symbols binary, owner binary, owner_from binary"


def _pieces(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item, words), the words joined by spaces; a long item has several pieces, which overlap by less than a window."""
    schema = T.StructType.fromDDL("item string, words binary")
    arrow = to_arrow_schema(schema)
    size = max(PIECE_WORDS, 2 * window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for item, value in zip(*(part.column(c).to_pylist() for c in ("item", "text")), strict=True):
                    words = words_of(value)
                    for at in range(0, len(words), size - window + 1):
                        if at == 0 or len(words) - at >= window:
                            rows.append((item, b" ".join(words[at : at + size])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text")).mapInArrow(run, schema)


def write_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, limit: int = BLOCK_BYTES) -> list[str]:
    """Write the windows of a benchmark in blocks of about limit bytes of text, for tasks to read; returns the names of files."""
    spark = benchmark.sparkSession
    pieces = _pieces(benchmark, item_id, text, window)
    total = int(pieces.agg(F.coalesce(F.sum(F.length("words")), F.lit(0))).first()[0])
    block = F.pmod(F.xxhash64("item", "words"), F.lit(max(1, -(-total // limit))))
    schema = T.StructType.fromDDL(_BLOCK)

    def build(group: pa.Table) -> pa.Table:
        items = [(i, w.split()) for i, w in zip(*(group.column(c).to_pylist() for c in ("item", "words")), strict=True)]
        return pa.Table.from_pylist([Patterns(items, window).row()], to_arrow_schema(schema))

    path = new_folder(spark, "windows")
    pieces.withColumn("block", block).groupBy("block").applyInArrow(build, schema).write.parquet(path)
    files = spark.read.parquet(path).inputFiles()
    for f in files:
        spark.sparkContext.addFile(f)
    return [f.rpartition("/")[2] for f in files]


class Blocks:
    """The blocks that write_blocks has left, as a task reads them; a single one is kept."""

    def __init__(self, files: list[str]):
        self.files = [pq.ParquetFile(SparkFiles.get(f)) for f in files]
        found = [np.frombuffer(h.as_buffer(), np.uint64) for f in self.files for b in f.iter_batches(1, columns=["hashes"]) for h in b.column(0)]
        self.hashes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        self.only = list(self._read()) if len(found) == 1 else None

    def _read(self) -> Iterator[Patterns]:
        for f in self.files:
            for batch in f.iter_batches(1):
                yield Patterns.of(batch.to_pylist()[0])

    def __call__(self) -> Iterator[Patterns]:
        return iter(self.only) if self.only else self._read()


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add n_words, hits (numbers of the hit words), items (ids as strings, sorted) and spans (character spans)."""
    span = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", span)]
    files = write_blocks(benchmark, item_id, item_text, window, block_bytes)

    def make():
        blocks = Blocks(files)
        shard = Shard(blocks.hashes, blocks)

        def work(texts):
            words = [words_of(t) for t in texts]
            found = shard(words)
            return [[len(w) for w in words], [h.tolist() for h, _ in found], [i for _, i in found], [merge_spans(t or "", h) for t, (h, _) in zip(texts, found, strict=True)]]

        return work

    return append_columns(docs, text, fields, make)


def remove_spans(text, spans):
    """Column expression: text without the character spans (sorted, apart from each other)."""
    n = F.size(spans)
    kept = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.substring(
            text,
            (F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(spans, i)["end"]) + 1).cast("int"),
            (F.when(i == n, F.length(text)).otherwise(F.try_element_at(spans, i + 1)["begin"]) - F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(spans, i)["end"])).cast("int"),
        ),
    )
    return F.when(n > 0, F.concat_ws("", kept)).otherwise(text)
