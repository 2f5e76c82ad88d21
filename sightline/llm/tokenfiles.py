"""Token ids of a corpus in Huffman-coded files, and reading them back.

Ids are counted over the whole corpus, code lengths of at most MAX_BITS come from package-merge over these counts, and codes
are canonical, so that the lengths alone are stored. Documents lie in ascending order of doc_id; they are coded first, so that
the sort moves codes instead of ids. A table folder has

    codebook   id, bits            the code's length of every id that occurs
    blocks     part, block, first, n_ids, payload, marks, docs
               a run of BLOCK_IDS ids or a few more that is decoded on its own: first is the number of ids of the part before
               it, payload the codes (highest bit first, every document from a whole byte on), marks the bit offset of every
               MARK-th id of each document, docs a row per document in it: doc_id, n (all its ids), at (ids of the document
               before this piece), size
    parts      part, base          ids before each part; written last, so that a folder with parts is complete

Blocks are rows of Parquet, whose files Spark commits: a task that is lost is done again and leaves nothing behind, and any
store that Spark reads will do. A document's ids lie in one block unless it has more than BLOCK_IDS of them; then its pieces
lie in several. Decoding looks MAX_BITS bits up in a table of symbols and lengths, at all marks of a block at once.

Null texts are empty (the end id alone), rows of null doc_id come first, rows of equal doc_id follow each other by a hash of
their ids, an empty table gives files without blocks, and columns other than id and text are not written.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sightline.llm._common import materialize, own_shuffles, release, slices
from sightline.llm.packing import Encoder

MAX_BITS, BLOCK_IDS, MARK = 20, 1 << 16, 128


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `most` bits for symbols of these counts (all above 0), by package-merge."""
    n = len(counts)
    if n > 1 << most:
        raise ValueError(f"{n} symbols have no codes of {most} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    packages, levels = np.zeros(0, np.int64), []
    for _ in range(most):
        both = np.concatenate([leaves, packages])
        at = np.argsort(both, kind="stable")
        levels.append(at < n)
        merged = both[at]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        k = int(is_leaf[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def _lanes(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many marks runs of these sizes have, and the number of each mark in its run."""
    lanes = -(-sizes // MARK)
    return lanes, np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)


class Code:
    """Canonical codes of symbols (ascending ids) with given lengths."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = ids[order].astype(np.uint32), bits[order].astype(np.int64)
        self.most = int(self.bits.max(initial=1))
        # each code is the sum of the room of those before it, at the scale of the longest
        room = np.left_shift(1, self.most - self.bits)
        self.starts = np.cumsum(room) - room
        if room.sum() > 1 << self.most:
            raise ValueError("lengths leave no room for all codes")

    def encoder(self):
        """A function from the ids of runs, one after the other, and the runs' sizes (above 0) to (bytes, bytes of each run, bit
        offset in its run of every MARK-th id, marks of each run). Every run begins with a whole byte."""
        top = int(self.ids.max(initial=0)) + 1
        code, size = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        code[self.ids], size[self.ids] = (self.starts >> (self.most - self.bits)).astype(np.uint64), self.bits

        def encode(ids: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
            n = size[ids]
            ends = np.cumsum(n)
            run_ends = ends[np.cumsum(sizes) - 1]
            bits = np.diff(run_ends, prepend=0)
            long = (bits + 7) >> 3
            own = 8 * (np.cumsum(long) - long)
            begins = ends - n + np.repeat(own - (run_ends - bits), sizes)
            word = begins >> 5
            # a code lies in a window of two 32-bit words
            window = code[ids] << (64 - n - (begins & 31)).astype(np.uint64)
            out = np.zeros(int(long.sum() >> 2) + 2, np.uint32)
            firsts = np.flatnonzero(np.diff(word, prepend=-1))
            at = word[firsts]
            out[at] |= np.bitwise_or.reduceat(window >> np.uint64(32), firsts).astype(np.uint32)
            out[at + 1] |= np.bitwise_or.reduceat(window & np.uint64(0xFFFFFFFF), firsts).astype(np.uint32)
            lanes, nth = _lanes(sizes)
            marks = begins[np.repeat(np.cumsum(sizes) - sizes, lanes) + MARK * nth] - np.repeat(own, lanes)
            return out.astype(">u4").tobytes()[: int(long.sum())], long, marks, lanes

        return encode

    def decoder(self):
        """A function from (bytes, marks of all runs, their numbers of ids) to the ids of the runs one after the other."""
        room = np.left_shift(1, self.most - self.bits)
        table = np.zeros(1 << self.most, np.int64)
        filled = np.repeat((self.ids.astype(np.int64) << 6) | self.bits, room)
        table[: len(filled)] = filled
        most = np.uint64(64 - self.most)

        def decode(payload: bytes, marks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
            raw = np.frombuffer(payload + b"\0" * 12, np.uint8)
            words = raw[: len(raw) // 4 * 4].view(">u4").astype(np.uint64)
            windows = (words[:-1] << np.uint64(32)) | words[1:]
            # a lane is what follows a mark; the longest come first, so that those still going on are the first
            lanes, nth = _lanes(sizes)
            place = np.repeat(np.cumsum(sizes) - sizes, lanes) + MARK * nth
            length = np.minimum(MARK, np.repeat(sizes, lanes) - MARK * nth)
            order = np.argsort(-length, kind="stable")
            at, place, length = marks[order], place[order], length[order]
            going = np.searchsorted(-length, -np.arange(MARK), side="left")
            out = np.empty(int(sizes.sum()), np.uint32)
            for k in range(int(length[0]) if len(length) else 0):
                at = at[: going[k]]
                found = table[((windows[at >> 5] << (at & 31).astype(np.uint64)) >> most).astype(np.int64)]
                out[place[: going[k]] + k] = found >> 6
                at = at + (found & 63)
            return out

        return decode


def tokenize(df: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows (doc_id, ids) of whole texts, ids as little-endian unsigned 32-bit integers, the end id included; and a row per task
    without them that says how often it wrote which id (met, n). Counts and ids are one table, so that they always agree."""
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("doc_id", df.schema["doc_id"].dataType), T.StructField("ids", T.BinaryType()), T.StructField("met", longs), T.StructField("n", longs)])
    arrow = to_arrow_schema(schema)
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, total = Encoder(tokenizer), np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [encode(t) + end for t in part.column("text").to_pylist()]
                found = np.bincount(np.frombuffer(b"".join(ids), np.uint32))
                if len(found) > len(total):
                    found, total = total, found.astype(np.int64)
                total[: len(found)] += found
                none = pa.nulls(len(ids), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), none.cast(arrow.field("met").type), none.cast(arrow.field("n").type)], schema=arrow)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_pylist([{"met": met, "n": total[met]}], schema=arrow)

    return df.select("doc_id", "text").mapInArrow(run, schema)


def count_ids(tokenized: DataFrame) -> DataFrame:
    """(id, n) over all texts."""
    each = tokenized.where("met is not null").select(F.inline(F.arrays_zip(F.col("met").alias("id"), F.col("n"))))
    return each.groupBy(F.col("id")).agg(F.sum("n").alias("n"))


def _schema(kind: T.DataType, more: list[T.StructField]) -> T.StructType:
    longs = [T.StructField(c, T.LongType()) for c in ("n", "at", "size")]
    return T.StructType([T.StructField("doc_id", kind), *longs, *more])


def encode_pieces(encoded: DataFrame, book: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """From rows (doc_id, ids, tie, row) a row per BLOCK_IDS ids of a document: its codes and marks."""
    rest = [T.StructField(c, T.LongType()) for c in ("tie", "row")] + [T.StructField("payload", T.BinaryType()), T.StructField("marks", T.ArrayType(T.LongType()))]
    schema = _schema(encoded.schema["doc_id"].dataType, rest)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Code(*book).encoder()
        rows: list[tuple] = []
        runs: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(r) for r in runs], np.int64)
            payload, long, marks, lanes = encode(np.concatenate(runs), sizes)
            bytes_at, marks_at = np.cumsum(long), np.cumsum(lanes)
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=False)]
            columns.append(pa.array([payload[z - n : z] for z, n in zip(bytes_at.tolist(), long.tolist(), strict=True)], pa.binary()))
            columns.append(pa.ListArray.from_arrays(np.append(0, marks_at).astype(np.int32), marks).cast(arrow.field("marks").type))
            rows.clear()
            runs.clear()
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        held = 0
        for batch in batches:
            for key, raw, tie, row in zip(*(batch.column(c) for c in ("doc_id", "ids", "tie", "row")), strict=True):
                ids = np.frombuffer(raw.as_buffer(), np.uint32)
                for at in range(0, len(ids), BLOCK_IDS):
                    runs.append(ids[at : at + BLOCK_IDS])
                    rows.append((key.as_py(), len(ids), at, len(runs[-1]), tie.as_py(), row.as_py()))
                    held += len(runs[-1])
                    if held >= 2 * BLOCK_IDS:
                        yield flush()
                        held = 0
        if runs:
            yield flush()

    return encoded.select("doc_id", "ids", "tie", "row").mapInArrow(run, schema)


def _blocks(ordered: DataFrame) -> DataFrame:
    """Blocks of every partition of pieces, in their order."""
    piece = _schema(ordered.schema["doc_id"].dataType, [])
    longs = [T.StructField(c, T.LongType()) for c in ("part", "block", "first", "n_ids")]
    schema = T.StructType([*longs, T.StructField("payload", T.BinaryType()), T.StructField("marks", T.ArrayType(T.LongType())), T.StructField("docs", T.ArrayType(piece))])
    arrow = to_arrow_schema(schema)
    names = piece.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = block = first = held = size = 0
        payloads: list[bytes] = []
        marks: list[np.ndarray] = []
        docs: list[dict] = []

        def close() -> pa.RecordBatch:
            nonlocal block, first, held, size
            row = {"part": part, "block": block, "first": first, "n_ids": held, "payload": b"".join(payloads), "marks": np.concatenate(marks), "docs": docs}
            out = pa.RecordBatch.from_pylist([row], schema=arrow)
            block, first, held, size = block + 1, first + held, 0, 0
            for held_list in (payloads, marks, docs):
                held_list.clear()
            return out

        for batch in batches:
            own = batch.select(["part", *names]).to_pylist()
            for row, payload, own_marks in zip(own, batch.column("payload"), batch.column("marks"), strict=True):
                part = row.pop("part")
                payloads.append(payload.as_py())
                marks.append(own_marks.values.to_numpy() + 8 * size)
                docs.append(row)
                held, size = held + row["size"], size + len(payloads[-1])
                if held >= BLOCK_IDS:
                    yield close()
        if held:
            yield close()

    return ordered.select("part", *names, "payload", "marks").mapInArrow(run, schema)


def write(df: DataFrame, path: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all texts to the folder path.

    The driver holds the counts of ids (at most the vocabulary) and a number per part (partition of the sort)."""
    spark = df.sparkSession
    encoded = materialize(tokenize(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), tokenizer, end_id), "ids")
    counts = count_ids(encoded).orderBy("id").toArrow()
    ids, n = counts["id"].to_numpy(), counts["n"].to_numpy()
    book = (ids, code_lengths(n))
    spark.createDataFrame(pa.table({"id": pa.array(book[0], pa.int64()), "bits": pa.array(book[1], pa.int64())})).coalesce(1).write.parquet(f"{path}/codebook")
    coded = materialize(encode_pieces(encoded.where("ids is not null").withColumns({"tie": F.xxhash64("ids"), "row": F.monotonically_increasing_id()}), book), "codes")
    release(encoded)
    order = ["doc_id", "tie", "row", "at"]
    ordered = coded.repartitionByRange(*order).sortWithinPartitions(*order)
    with own_shuffles(spark):
        _blocks(ordered.withColumn("part", F.spark_partition_id().cast("long"))).write.parquet(f"{path}/blocks")
    release(coded)
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").toArrow()
    n = sizes["n"].to_numpy().astype(np.int64)
    spark.createDataFrame(pa.table({"part": sizes["part"], "base": pa.array(np.cumsum(n) - n, pa.int64())})).coalesce(1).write.parquet(f"{path}/parts")


def codebook(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    book = spark.read.parquet(f"{path}/codebook").orderBy("id").toArrow()
    return book["id"].to_numpy(), book["bits"].to_numpy()


def read_pieces(spark: SparkSession, path: str, begin: int | None = None, end: int | None = None, parted: bool = False) -> DataFrame:
    """Pieces of documents (doc_id, n, at, size, start, ids), decoded; start: ids of all documents before the piece's. With begin
    and end the blocks alone that hold ids of this range (counted over the whole corpus) are read and decoded; with parted
    those that hold a part of a document."""
    blocks, parts = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/parts")
    # a number for every partition of the writer's sort, in one file of known size
    placed = blocks.join(parts, "part").withColumn("first", F.col("first") + F.col("base"))
    if begin is not None:
        placed = placed.where(F.col("first") + F.col("n_ids") > begin)
    if end is not None:
        placed = placed.where(F.col("first") < end)
    if parted:
        placed = placed.where(F.exists("docs", lambda d: d["size"] < d["n"]))
    kind = blocks.schema["docs"].dataType.elementType["doc_id"].dataType
    schema = _schema(kind, [T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])
    arrow = to_arrow_schema(schema)
    book = codebook(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Code(*book).decoder()
        for batch in batches:
            for first, payload, marks, docs in zip(*(batch.column(c) for c in ("first", "payload", "marks", "docs")), strict=True):
                docs = docs.as_py()
                ids = decode(payload.as_py(), marks.values.to_numpy(), np.array([d["size"] for d in docs], np.int64))
                out, done = [], 0
                for d in docs:
                    out.append((*(d[c] for c in schema.names[:4]), first.as_py() + done - d["at"], ids[done : done + d["size"]].astype("<u4").tobytes()))
                    done += d["size"]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return placed.select("first", "payload", "marks", "docs").mapInArrow(run, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Whole documents: doc_id, start, n_tokens, ids. Only pieces of documents of several blocks are brought together."""
    whole = read_pieces(spark, path).where("size = n").select("doc_id", "start", F.col("n").alias("n_tokens"), "ids")
    # the place of an id in the corpus names its document
    pieces = read_pieces(spark, path, parted=True).where("size < n")
    parted = pieces.groupBy("start", "doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("all"))
    ids = F.aggregate("all", F.lit(b""), lambda so_far, p: F.concat(so_far, p["ids"]))
    return whole.unionByName(parted.select("doc_id", "start", F.col("n").alias("n_tokens"), ids.alias("ids")))
