"""Packing by power-of-two decomposition.

A document of n ids (its text's tokens and an end id) is split into pieces whose lengths are the powers of two of n's
binary digits, with as many pieces of max_len as fit first. Every piece is a sequence of its own, so that no sequence
crosses documents and none is padded. Sequences of equal length share a bucket: every task gives its pieces bucket by
bucket with running numbers, so that batches of one length are consecutive sequences. No row is moved: the pieces stay
in the task that tokenized them, and a common length is no hot spot.

A null text is an empty document (one piece with the end id alone); very long texts become many pieces of max_len;
repeated rows are packed each for itself; an empty table gives no pieces. Columns other than id and text are not
carried, so that none can clash.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sightline.llm._common import slices
from sightline.llm.tokens import PRE_TOKEN, Splitter, byte_symbols

#: Bytes of ids in one Arrow batch of pieces.
OUT_BYTES = 8 << 20
#: White space so long that the pattern's look-ahead would outgrow the matcher's stack; the pattern makes one piece of all
#: of it but the last character before a word.
_BLANK = regex.compile(r"\s{100000,}")


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    The vocabulary file's own entries drive tiktoken's merging, which takes the pair of least id first; that is the file's
    rule as long as its merges come in the order of their ids, which is checked."""

    def __init__(self, path: str):
        import tiktoken

        self.split = Splitter(path)
        model, self.split.spec = self.split.spec["model"], None
        vocab = model["vocab"]
        made = [vocab[m.replace(" ", "", 1) if isinstance(m, str) else "".join(m)] for m in model["merges"]]
        if made != sorted(made):
            raise ValueError("merges must come in the order of their ids")
        as_bytes = {ord(c): i for i, c in enumerate(byte_symbols())}
        self.ranks = {token.translate(as_bytes).encode("latin-1"): i for token, i in vocab.items() if token not in self.split.added}
        self.fast = tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks=self.ranks, special_tokens={})

    @cached_property
    def one(self):
        """Takes all of a text as one pre-token."""
        import tiktoken

        return tiktoken.Encoding("one", pat_str=r"(?s).+", mergeable_ranks=self.ranks, special_tokens={})

    def _ids(self, text: str) -> bytes:
        out, at = [], 0
        for m in _BLANK.finditer(text):
            end = m.end() - (m.end() < len(text))
            out += [self.fast.encode_to_numpy(text[at : m.start()], disallowed_special=()), self.one.encode_to_numpy(text[m.start() : end], disallowed_special=())]
            at = end
        out.append(self.fast.encode_to_numpy(text[at:], disallowed_special=()))
        return b"".join(x.tobytes() for x in out)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not any(s in text for s in self.split.added):
            return self._ids(text)
        return b"".join(array("I", [self.split.added[t]]).tobytes() if special else self._ids(t) for t, special in self.split.segments(text))


def binary_lengths(n: int, max_len: int) -> list[int]:
    """Piece lengths, longest first: as many of max_len (a power of two) as fit, then the digits of the rest."""
    out = [max_len] * (n // max_len)
    rest = n % max_len
    while rest:
        out.append(1 << (rest.bit_length() - 1))
        rest -= out[-1]
    return out


def pack(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", max_len: int = 2048, end_id: int = 1) -> DataFrame:
    """Return a row per piece: doc_id, start, length, bucket (log2 of length), input_ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset.

    sequence_id is unique over the whole result, ascends by bucket within a task's part of it, and depends only on how the
    input is split into tasks.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    kind = df.schema[doc_id].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind)]
        + [T.StructField(n, T.LongType()) for n in ("start", "length", "bucket")]
        + [T.StructField("input_ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType())]
    )
    arrow = to_arrow_schema(schema)
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)]
            rows.clear()
            held = 0
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in batches:
            for part in slices(batch, "text"):
                for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = encode(text) + end
                    n, start = len(ids) // 4, 0
                    for length in binary_lengths(n, max_len):
                        rows.append((key, start, length, length.bit_length() - 1, ids[4 * start : 4 * (start + length)], n))
                        start += length
                        held += 4 * length + 64
                        if held > OUT_BYTES:
                            yield flush()
        if rows:
            yield flush()

    pieces = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
    pieces = pieces.sortWithinPartitions("bucket")
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write each bucket to a folder of its own; every task writes its own files."""
    packed.write.partitionBy("bucket").parquet(path)
