"""Removal of byte strings that occur elsewhere: suffix sorting by a difference cover, as far as prefixes of a bounded length.

* Sample. Positions whose residue lies in a difference cover D modulo v are sampled. Any two starts p and q have a
  distance d < v at which both p + d and q + d are sampled, so that two equal strings of `short` bytes have aligned samples
  that agree on the next w = short - v + 1 bytes, their triple (of three characters of w / 3 bytes).
* Sort and name. Triples are dealt by ranges of their fingerprints and sorted there; equal neighbours get one name. A
  sample with a name of its own takes part in no repeat and goes no further.
* Recurse on names. A sampled position p is followed by the samples p + v, p + 2v ...; the sequence of their names is the
  next level's triple, and the same sort tells which of these repeat. Long sequences cover so much more than `length` bytes
  that all starts up to the next sample are settled, and a repeat's inside with them, by ranks of samples alone.
* Merge the remaining suffixes: starts that a repeated shorter sequence begins close after and that the ranks don't settle
  (they lie near the ends of repeats). They are sorted by their prefixes of `length` bytes, together with the settled starts
  of one sample of each repeated long sequence, which stands for all of its kind.
* Compare adjacent prefixes: equal neighbours in that order are repeats; covered bytes are the union of their strings.

Names are fingerprints, as only equality of neighbours counts here, not which of two texts sorts first: 48 bits and the
number of the range (64 bits at most) for the first filter, 16 bits more for what decides.

There are as many ranges as keep one of them near RANGE_BYTES of text (some 4.6 million samples), whatever the input's size;
beyond FIRST_RANGES a task deals its names to groups of ranges, and the groups are dealt to their ranges by a second shuffle,
so that rows stay long. A range holds a name once for every HELD samples of a task, however often it occurs: positions whose
name a task met twice are settled there and travel by their text, not by their name.

The unit is a distinct text: byte-equal documents are recognised by two hashes of the whole text, are covered whole, and
one of them stands for all against other texts. A name that a task meets several times is settled there and sent once, so
that a passage in a third of all documents gives one row a flush, not one a document.

A null text is empty; texts under `length` bytes are kept whole; a long text's names are sent while it is read (a task needs some
30 bytes for each of its bytes); repeated rows are copies of each other; an empty table gives an empty one; only id and text are read, so that no other column can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sightline.llm._common import materialize, release, slices

#: Repeats of LENGTH bytes are removed; repeats of SHORT bytes (a passage of some 45 words) are noticed.
LENGTH, SHORT = 400, 256
#: Perfect difference sets by modulus (every non-zero residue is the difference of exactly one pair).
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52), 91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)}
#: Samples that a task holds before it sends them, and how many of a text are named at a time.
HELD, AT_ONCE = 1_000_000, 1 << 18
#: Bytes of text whose samples make one range, and ranges that a task deals its names to at once.
RANGE_BYTES, FIRST_RANGES = 32 << 20, 1 << 11
#: Added to the positions of long sequences, and of starts that stand for others; texts are shorter.
OUTER = STANDS = 1 << 31
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: What a row of names holds: one position of each name, of those that the task met once or twice; or all positions of these.
ONCE, TWICE, SETTLED = 0, 1, 2
_PACKED = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("kind", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("k1", "k2", "n", "name4", "name2", "check", "pos0", "pos1"))])
_PARTS = T.StructType([T.StructField("part", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("k1", "k2", "n", "pos", "name"))])
_FOUND = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.IntegerType()), T.StructField("pos", T.BinaryType()), T.StructField("name", T.BinaryType())])
_SPAN = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))


class Cover:
    """The sampling and what follows from it for strings of short and of length bytes."""

    def __init__(self, length: int, short: int):
        fit = [v for v in COVERS if 4 * v <= short]
        if not fit or short > length:
            raise ValueError("short must be at most length and at least 12")
        self.length, self.short = length, short
        self.v = max(fit)
        self.residues = np.array(COVERS[self.v], np.int64)
        self.w = short - self.v + 1
        gap = int(np.diff(np.r_[self.residues, self.v]).max())
        #: Names in a sequence that every string of length bytes has within its first v, and in one that settles all starts
        #: up to the next sample.
        self.inner = 1 + (length - self.short) // self.v
        self.outer = 1 + max(1, -(-(length + gap - 1 - self.w) // self.v))
        self.settles = (self.outer - 1) * self.v + self.w - length

    def sample(self, n: int) -> np.ndarray:
        at = (np.arange(0, n, self.v)[:, None] + self.residues).ravel()
        return at[: np.searchsorted(at, n - self.w, "right")]

    def starts(self, n: int, sequences: dict | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the starts in a text of n bytes those that are settled as repeats, that are open, and that stand for others."""
        m = max(0, n - self.length + 1)

        def spread(at: np.ndarray, before: int, after: int) -> np.ndarray:
            step = np.zeros(m + 1, np.int32)
            np.add.at(step, np.clip(at - before, 0, m), 1)
            np.add.at(step, np.clip(at + after + 1, 0, m), -1)
            return np.cumsum(step)[:-1] > 0

        at, lead = _positions(sequences)
        outer = at >= OUTER
        known = spread(at[outer] - OUTER, 0, self.settles)
        maybe = spread(at[~outer], self.v - 1, 0)
        leads = spread(at[outer & (lead > 0)] - OUTER, 0, self.settles)
        return np.flatnonzero(known), np.flatnonzero(maybe & ~known), np.flatnonzero(leads)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * _K2
    return x ^ x >> np.uint64(32)


class Sender:
    """Collects named positions of texts and packs them by ranges of names."""

    def __init__(self, bits: int):
        self.bits, self.n, self.parts = bits, 0, []

    def add(self, k1: int, k2: int, pos: np.ndarray, name: np.ndarray, check: np.ndarray | None = None) -> bool:
        """Whether it is time to flush."""
        if len(pos):
            self.parts.append((k1, k2, pos, name, check))
            self.n += len(pos)
        return self.n >= HELD

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        sizes = [len(p[2]) for p in self.parts]
        k1, k2 = (np.repeat(np.array([p[i] for p in self.parts], kind), sizes) for i, kind in ((0, np.int64), (1, np.int32)))
        pos = np.concatenate([p[2] for p in self.parts]).astype(np.uint32)
        name = np.concatenate([p[3] for p in self.parts]) >> np.uint64(max(0, 16 - self.bits))
        check = np.concatenate([p[4] for p in self.parts]) if self.parts[0][4] is not None else None
        self.n, self.parts = 0, []
        order = np.argsort(name, kind="stable") if check is None else np.lexsort((check, name))
        new = _new(name[order], check[order] if check is not None else None)
        many = np.diff(np.r_[np.flatnonzero(new), len(new)])
        twice = np.zeros(len(pos), bool)
        twice[order] = np.repeat(many > 1, many)
        one = np.zeros(len(pos), bool)
        one[order[new]] = True
        by_name = _slot(name, self.bits)
        by_text = (k1.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)
        for kind, which, slot in ((ONCE, one & ~twice, by_name), (TWICE, one & twice, by_name), (SETTLED, twice, by_text)):
            at = np.flatnonzero(which)
            yield from _packed(kind, slot[at], k1[at], k2[at], pos[at], name[at], None if check is None else check[at])


def _slot(name: np.ndarray, bits: int) -> np.ndarray:
    """The range of a name: its highest bits; with fewer than 16 of them a name is shorter."""
    return (name >> np.uint64(48 if bits <= 16 else 64 - bits)).astype(np.int64)


def _packed(kind: int, slot: np.ndarray, k1: np.ndarray, k2: np.ndarray, pos: np.ndarray, name: np.ndarray, check: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows of one kind by slot, names as two columns of 32 and 16 bits, as the slot tells the rest (32 bits for SETTLED)."""
    order = np.argsort(slot, kind="stable")
    rows: list[tuple] = []
    for k, i in zip(*_runs(slot[order], order), strict=True):
        first, own = np.flatnonzero(_cut(_texts(k1[i], k2[i]))), name[i]
        high = (own >> np.uint64(32)).astype(np.uint32 if kind == SETTLED else np.uint16)
        rows.append((k, kind, k1[i][first].tobytes(), k2[i][first].tobytes(), np.diff(np.r_[first, len(i)]).astype(np.uint16).tobytes(), own.astype(np.uint32).tobytes(), high.tobytes(), b"" if check is None or kind == SETTLED else check[i].tobytes(), pos[i].astype(np.uint16).tobytes(), (pos[i] >> np.uint32(16)).astype(np.uint16).tobytes()))
        if len(rows) == 256:
            yield _batch(rows, _PACKED)
            rows = []
    if rows:
        yield _batch(rows, _PACKED)


def _unpacked(table: pa.Table, kind: int, bits: int) -> tuple[np.ndarray, ...]:
    """(k1, k2, pos, name, check or None) of the rows of one kind."""
    table = table.filter(pa.compute.equal(table.column("kind"), kind))
    n = _whole(table, "n", np.uint16)
    k1, k2 = np.repeat(_whole(table, "k1", np.int64), n), np.repeat(_whole(table, "k2", np.int32), n)
    pos = _whole(table, "pos0", np.uint16).astype(np.uint32) | _whole(table, "pos1", np.uint16).astype(np.uint32) << np.uint32(16)
    high = _whole(table, "name2", np.uint32 if kind == SETTLED else np.uint16).astype(np.uint64)
    name = high << np.uint64(32) | _whole(table, "name4", np.uint32)
    if kind != SETTLED:
        top = np.array(table.column("slot").to_pylist(), np.uint64) >> np.uint64(max(0, bits - 16))
        name |= np.repeat(top, np.array([len(x) // 4 for x in table.column("name4").to_pylist()], np.int64)) << np.uint64(48)
    check = _whole(table, "check", np.uint16)
    return k1, k2, pos, name, check if len(check) else None


def _deal(coarse: int, bits: int) -> Callable:
    """From rows of a group of ranges (coarse bits) rows of its ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def send() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            for kind in (ONCE, TWICE, SETTLED):
                k1, k2, pos, name, check = _unpacked(table, kind, coarse)
                slot = (k1.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if kind == SETTLED else _slot(name, bits)
                yield from _packed(kind, slot, k1, k2, pos, name, check)

        for batch in batches:
            for i in range(batch.num_rows):  # a row has HELD names at most
                held.append(batch.slice(i, 1))
                n += len(batch.column("name4")[i].as_py()) // 4
                if n >= HELD:
                    yield from send()
                    held, n = [], 0
        if held:
            yield from send()

    return run


def _new(name: np.ndarray, check: np.ndarray | None) -> np.ndarray:
    if not len(name):
        return np.zeros(0, bool)
    return np.r_[True, (name[1:] != name[:-1]) | (False if check is None else check[1:] != check[:-1])]


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def _whole(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _texts(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Where a new text begins."""
    return np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])] if len(k1) else np.zeros(0, bool)


def _cut(new: np.ndarray) -> np.ndarray:
    """Where a new count begins; counts have 16 bits."""
    new[:: 1 << 15] = True
    return new


def _runs(key: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Sorted keys, and the values of each."""
    if not len(key):
        return [], []
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[at].tolist(), np.split(values, at[1:])


def _compare(table: pa.Table, leads: bool, bits: int) -> pa.Table:
    """Sort one range of names and compare neighbours: the positions whose name another position has too, with their names
    or, for leads, 1 for one position of each name and 0 for others; a row for each of as many parts of the texts as there
    are ranges. Settled positions pass through."""
    once, twice = (_unpacked(table, kind, bits) for kind in (ONCE, TWICE))
    k1, k2, pos, name = (np.concatenate([a, b]) for a, b in zip(once[:4], twice[:4], strict=True))
    checks = [c if c is not None else np.zeros(len(x[0]), np.uint16) for x in (once, twice) for c in (x[4],)]
    check = np.concatenate(checks)
    known = np.r_[np.zeros(len(once[0]), bool), np.ones(len(twice[0]), bool)]
    order = np.lexsort((check, name))
    new = _new(name[order], check[order])
    begins, run = np.flatnonzero(new), np.cumsum(new) - 1
    found, first = np.zeros(len(pos), bool), np.zeros(len(pos), bool)
    if len(begins):
        lead = order[begins][run]
        other = (k1[order] != k1[lead]) | (k2[order] != k2[lead]) | (pos[order] != pos[lead])
        found[order] = np.logical_or.reduceat(other | known[order], begins)[run]
        first[order[begins]] = True
    value = first.astype(np.uint64) if leads else name
    past = _unpacked(table, SETTLED, bits)
    at = np.flatnonzero(found)
    k1, k2, pos = (np.concatenate([x[at], y]) for x, y in zip((k1, k2, pos), past[:3], strict=True))
    value = np.concatenate([value[at], np.zeros(len(past[3]), np.uint64) if leads else past[3]])
    at = np.lexsort((pos, k2, k1.view(np.uint64)))
    part = (k1[at].view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    rows = []
    for k, i in zip(*_runs(part, at), strict=True):
        first = np.flatnonzero(_cut(_texts(k1[i], k2[i])))
        rows.append((k, k1[i][first].tobytes(), k2[i][first].tobytes(), np.diff(np.r_[first, len(i)]).astype(np.uint16).tobytes(), pos[i].tobytes(), value[i].tobytes()))
    return pa.Table.from_batches([_batch(rows, _PARTS)] if rows else [], to_arrow_schema(_PARTS))


def _gather(table: pa.Table) -> pa.Table:
    """The positions of each text of a part of the texts, from all ranges, sorted; of one that came twice the larger value."""
    n = _whole(table, "n", np.uint16)
    k1, k2 = np.repeat(_whole(table, "k1", np.int64), n), np.repeat(_whole(table, "k2", np.int32), n)
    pos, name = _whole(table, "pos", np.uint32), _whole(table, "name", np.uint64)
    order = np.lexsort((~name, pos, k2, k1))
    order = order[_texts(k1[order], k2[order]) | np.r_[True, pos[order][1:] != pos[order][:-1]]] if len(order) else order
    new = _texts(k1[order], k2[order])
    rows = [(int(k1[i[0]]), int(k2[i[0]]), pos[i].tobytes(), name[i].tobytes()) for i in np.split(order, np.flatnonzero(new)[1:])] if len(order) else []
    return pa.Table.from_batches([_batch(rows, _FOUND)] if rows else [], to_arrow_schema(_FOUND))


def range_bits(total: int, least: int) -> int:
    """Bits of the number of ranges for texts of total bytes; at least as many ranges as this."""
    return max(1, min(30, max(least.bit_length(), (total // RANGE_BYTES).bit_length())))


def _repeated(df: DataFrame, bits: int, make: Callable[[Sender], Callable[[dict], Iterator[bool]]], label: str, leads: bool = False) -> DataFrame:
    """make(sender) gives a function that adds the names of a row's positions, and says in between whether it is time to send;
    the repeated of these, a row (k1, k2, label) per text, where label has sorted positions and their names."""
    columns, large = df.columns, "text" if "text" in df.columns else None
    coarse = min(bits, max(1, FIRST_RANGES.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(coarse)
        add = make(sender)
        for batch in batches:
            for part in slices(batch, large) if large else [batch]:
                for row in zip(*(part.column(c).to_pylist() for c in columns), strict=True):
                    for full in add(dict(zip(columns, row, strict=True))):
                        if full:
                            yield from sender.flush()
        yield from sender.flush()

    packed = df.mapInArrow(run, _PACKED)
    if bits > coarse:
        packed = packed.repartition("slot").mapInArrow(_deal(coarse, bits), _PACKED)
    parts = packed.groupBy("slot").applyInArrow(lambda t: _compare(t, leads, bits), _PARTS)
    found = parts.groupBy("part").applyInArrow(_gather, _FOUND)
    return materialize(found.select("k1", "k2", F.struct("pos", "name").alias(label)), label)


def _positions(found: dict | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions and their names."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.frombuffer(found["pos"], np.uint32).astype(np.int64), np.frombuffer(found["name"], np.uint64)


def _some(at: np.ndarray) -> Iterator[np.ndarray]:
    return (at[i : i + AT_ONCE] for i in range(0, len(at), AT_ONCE))


def _name_triples(cover: Cover):
    def make(sender: Sender):
        h = xxhash.xxh3_64_intdigest
        seen: set[tuple[int, int]] = set()

        def add(row: dict) -> Iterator[bool]:
            if not sender.parts:
                seen.clear()
            if (row["k1"], row["k2"]) in seen:
                return
            seen.add((row["k1"], row["k2"]))
            raw, w = row["text"].encode(), cover.w
            for at in _some(cover.sample(len(raw))):
                names = np.fromiter((h(raw[p : p + w]) for p in at.tolist()), np.uint64, len(at))
                yield sender.add(row["k1"], row["k2"], at, names)

        return add

    return make


def _name_sequences(cover: Cover):
    def make(sender: Sender):
        def add(row: dict) -> Iterator[bool]:
            pos, name = _positions(row["named"])
            whole, mark = np.ones(len(pos), bool), 0
            a, b = np.full(len(pos), _K1), np.full(len(pos), _K2)
            for k in range(cover.outer):
                at = np.minimum(np.searchsorted(pos, pos + k * cover.v), len(pos) - 1)
                whole &= pos[at] == pos + k * cover.v
                a, b = _mix(a * _K1 + name[at]), _mix((b ^ name[at]) * _K1 + _K2)
                if k + 1 in (cover.inner, cover.outer):
                    for i in _some(np.flatnonzero(whole)):
                        yield sender.add(row["k1"], row["k2"], pos[i] + mark, a[i], (b[i] >> np.uint64(48)).astype(np.uint16))
                    mark = OUTER

        return add

    return make


def _name_remaining(cover: Cover):
    def make(sender: Sender):
        h = xxhash.xxh3_128_digest

        def add(row: dict) -> Iterator[bool]:
            raw = row["text"].encode()
            _, unsettled, leads = cover.starts(len(raw), row["sequences"])
            for every, mark in ((unsettled, 0), (leads, STANDS)):
                for at in _some(every):
                    both = np.frombuffer(b"".join([h(raw[p : p + cover.length]) for p in at.tolist()]), np.uint64).reshape(-1, 2)
                    yield sender.add(row["k1"], row["k2"], at + mark, both[:, 0], (both[:, 1] >> np.uint64(48)).astype(np.uint16))

        return add

    return make


def _covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal covered runs [begin, end) of the strings at these (sorted) starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + length).tolist(), strict=True))


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, short: int = SHORT, with_kept: bool = True) -> DataFrame:
    """Return doc_id, n_bytes, n_removed, spans (array of removed [begin, end) byte runs), kept_sha256 (of the other bytes),
    n_repeated (bytes in triples that recur, which any passage of `short` bytes that occurs elsewhere has, and none of under
    w bytes; they stay) and kept (the other bytes; null without with_kept, which spares moving them)."""
    cover = Cover(length, short)
    body = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(doc_id).alias("doc_id"), body.alias("text"))
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.hash("text").alias("k2"), F.octet_length("text").cast("long").alias("size"))
    long = docs.where(F.col("size") >= short)
    key = ["k1", "k2"]
    total = long.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bits = range_bits(int(total), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = _repeated(long.select("k1", "k2", "text"), bits, _name_triples(cover), "named")
    sequences = _repeated(named, bits, _name_sequences(cover), "sequences", leads=True)
    twice = materialize(long.groupBy(key).agg(F.count("*").alias("copies"), F.first("size").alias("size")).where("copies > 1"), "copies")
    # one text of each group of copies that has sequences, with what is known of its samples
    one = long.join(sequences.select(key), key, "left_semi").groupBy(key).agg(F.first("text").alias("text"))
    work = materialize(one.join(named.join(sequences, key), key), "work")
    merged = _repeated(work.select("k1", "k2", "text", "sequences"), bits, _name_remaining(cover), "merged")

    schema = T.StructType([*T.StructType.fromDDL("k1 long, k2 int, n_removed long").fields, T.StructField("spans", _SPAN), *T.StructType.fromDDL("kept_sha256 string, n_repeated long, kept binary").fields])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for r in part.to_pylist():
                    raw = r["text"].encode()
                    known, _, _ = cover.starts(len(raw), r["sequences"])
                    more = _positions(r["merged"])[0]
                    spans = _covered(np.union1d(known, more[more < STANDS]), length)
                    at, kept = 0, []
                    for a, b in spans:
                        kept.append(raw[at:a])
                        at = b
                    rest = b"".join([*kept, raw[at:]])
                    noticed = sum(b - a for a, b in _covered(_positions(r["named"])[0], cover.w))
                    rows.append((r["k1"], r["k2"], len(raw) - len(rest), [{"begin": a, "end": b} for a, b in spans], hashlib.sha256(rest).hexdigest(), noticed, rest if with_kept else None))
                if rows:
                    yield _batch(rows, schema)

    def notice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["k1"], r["k2"], 0, [], None, sum(b - a for a, b in _covered(_positions(r["named"])[0], cover.w)), None) for r in batch.to_pylist()]
            if rows:
                yield _batch(rows, schema)

    single = lambda df: df.join(twice.select(key), key, "left_anti")
    known = single(work.join(merged, key, "left")).select("k1", "k2", "text", "named", "sequences", "merged").mapInArrow(strip, schema)
    # texts that have no more than triples in common with others stay whole
    noticed = single(named.join(sequences.select(key), key, "left_anti")).mapInArrow(notice, schema)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("size").alias("end")))
    gone = F.col("size") >= length
    nothing = F.array().cast(_SPAN)
    copies = twice.select("k1", "k2", F.when(gone, F.col("size")).otherwise(F.lit(0)).alias("n_removed"), F.when(gone, whole).otherwise(nothing).alias("spans"), F.when(gone, F.sha2(F.lit(""), 256)).alias("kept_sha256"), F.col("size").alias("n_repeated"), F.when(gone, F.lit("")).cast("binary").alias("kept"))
    # written, so that this join has two plain sides and hot groups of copies can be split over tasks
    result = materialize(known.unionByName(noticed).unionByName(copies), "result")
    release(named, sequences, twice, work, merged)
    own = docs.select("doc_id", "k1", "k2", "size", F.sha2("text", 256).alias("whole"), (F.col("text") if with_kept else F.lit(None)).cast("binary").alias("all"))
    joined = own.join(result, key, "left")
    return joined.select(
        "doc_id",
        F.col("size").alias("n_bytes"),
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("spans", nothing).alias("spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
        F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"),
        F.coalesce("kept", "all").alias("kept"),
    )
