import heapq
import random
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from sightline.llm import queries, tokenfiles


def huffman_cost(counts):
    heap = list(counts)
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    return cost


@pytest.mark.parametrize("n", [2, 3, 7, 100, 5000])
def test_lengths(n):
    counts = np.array(random.Random(n).choices(range(1, 1000), k=n), np.int64) ** 3
    bits = tokenfiles.code_lengths(counts, 60)
    assert int((bits * counts).sum()) == huffman_cost(counts.tolist())
    short = max(1, (n - 1).bit_length())
    assert tokenfiles.code_lengths(counts, short).max() == short
    limited = tokenfiles.code_lengths(counts, short + 1)
    assert limited.max() <= short + 1 and sum(2.0 ** -limited) == 1
    if n == 7:  # the best of all lengths of at most four bits
        from itertools import product

        best = min(sum(b * c for b, c in zip(x, counts.tolist(), strict=True)) for x in product(range(1, 5), repeat=n) if sum(2.0**-b for b in x) <= 1)
        assert int((limited * counts).sum()) == best


def test_no_room():
    with pytest.raises(ValueError):
        tokenfiles.code_lengths(np.ones(5, np.int64), 2)


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 256, 1000, 70_001])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 50_257).astype(np.uint32)
    kinds, counts = np.unique(ids, return_counts=True)
    code = tokenfiles.Code(kinds, tokenfiles.code_lengths(counts))
    payload, long, marks, lanes = code.encoder()(ids, np.array([n]))
    assert (code.decoder()(payload, marks, np.array([n])) == ids).all()
    bits = dict(zip(code.ids.tolist(), code.bits.tolist(), strict=True))
    assert len(payload) == long.sum() == (sum(bits[i] for i in ids.tolist()) + 7) // 8
    assert len(marks) == lanes.sum() == -(-n // tokenfiles.MARK)
    # several runs of one payload, each from a whole byte on
    runs = [ids[: n // 3 + 1], ids[n // 3 :], ids[:1]]
    sizes = np.array(list(map(len, runs)))
    payload, long, marks, lanes = code.encoder()(np.concatenate(runs), sizes)
    whole = marks + np.repeat(8 * (np.cumsum(long) - long), lanes)
    assert (code.decoder()(payload, whole, sizes) == np.concatenate(runs)).all()
    for r, one in zip(runs, np.split(np.frombuffer(payload, np.uint8), np.cumsum(long)[:-1]), strict=True):
        assert one.tobytes() == code.encoder()(r, np.array([len(r)]))[0]


def test_codes_are_canonical():
    """The codes of symbols of one length count up, and longer ones go on from them."""
    code = tokenfiles.Code(np.array([9, 4, 7, 1]), np.array([2, 3, 1, 3]))
    assert [(int(i), format(int(s) >> (3 - int(b)), f"0{b}b")) for i, b, s in zip(code.ids, code.bits, code.starts, strict=True)] == [(7, "0"), (9, "10"), (1, "110"), (4, "111")]


def wanted(rows, path, end=0):
    library, out, start = Tokenizer.from_file(path), [], 0
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end]
        out.append((key, start, len(ids), zlib.crc32(array("I", ids).tobytes())))
        start += len(ids)
    return out


def test_query(spark, sf, rows, path):
    got = sorted(tuple(r) for r in queries.op12_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == wanted([(r.doc_id, r.text) for r in rows], path)


def test_small_blocks_and_ranges(spark, docs, rows, path, tmp_path, monkeypatch):
    """Documents of several blocks, and ranges of ids read from the middle of the corpus."""
    monkeypatch.setattr(tokenfiles, "BLOCK_IDS", 300)
    at = str(tmp_path / "ids")
    tokenfiles.write(docs.repartition(5), at, path)
    got = sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in tokenfiles.read(spark, at).collect())
    assert got == wanted([(r.doc_id, r.text) for r in rows], path)
    library = Tokenizer.from_file(path)
    whole = [i for r in rows for i in [*library.encode(r.text or "", add_special_tokens=False).ids, 0]]
    begin, end = 5000, 5700
    pieces = tokenfiles.read_pieces(spark, at, begin, end).collect()
    assert 0 < len(pieces) < len(rows) // 4
    found = {}
    for p in pieces:
        found |= dict(enumerate(array("I", bytes(p.ids)), p.start + p["at"]))
    assert [found[i] for i in range(begin, end)] == whole[begin:end]
    assert spark.read.parquet(f"{at}/blocks").selectExpr("max(n_ids) < 600", "count(*) > 100").first()[:] == (True, True)


def test_hard_rows(spark, hard, path, tmp_path):
    library = Tokenizer.from_file(path)
    at = str(tmp_path / "hard")
    tokenfiles.write(hard, at, path)
    got = sorted(((r.start, r.doc_id, r.n_tokens, list(array("I", bytes(r.ids)))) for r in tokenfiles.read(spark, at).collect()))
    keys = [r[1] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and keys[0] is None
    assert [r[0] for r in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
    want = Counter((r.doc_id, tuple([*library.encode(r.text or "", add_special_tokens=False).ids, 0])) for r in hard.collect())
    assert Counter((k, tuple(ids)) for _, k, _, ids in got) == want
    none = str(tmp_path / "none")
    tokenfiles.write(hard.limit(0), none, path)
    assert tokenfiles.read(spark, none).count() == 0
