import random
import zlib
from array import array
from collections import Counter

import pytest
from tokenizers import Tokenizer

from sightline.llm import packing, queries, tokens

ODD = ["", " ", "  a", "a  \n\n b", "it's we'LL", "ééé日本語\U0001f600", "aaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 5000, "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endo", "12345,67.8", "  x", "é", "\x00\x01", "abababababab" * 40, "\r\n\t" * 9, "²³ ½ Ⅷ", " " * 3000 + "x", "y" * 3000 + "<|endoftext|>z", "\u2028\u0085 a", "   <|endoftext|>   "]


@pytest.fixture(scope="module")
def library(path):
    return Tokenizer.from_file(path)


def test_odd_texts(path, library):
    assert tokens.TokenCounter(path)(ODD) == [len(library.encode(t, add_special_tokens=False).ids) for t in ODD]
    assert [list(array("I", x)) for x in map(packing.Encoder(path), ODD)] == [library.encode(t, add_special_tokens=False).ids for t in ODD]


def test_long_pieces(path, library):
    """Unbroken strings of 100 kB and 1 MB."""
    rng = random.Random(8)
    say = lambda chars, k: "".join(rng.choices(chars, k=k))
    texts = [say("abcdefghijklmnopqrstuvwxyz", 100_000), "a" * 300_001, say("漢字仮名交文日本語", 30_000), "aab" * 70_000, " " * 1_000_000 + "x", "x " + "\n" * 150_000, "ab" + " \n\t\x0b" * 60_000 + "  c", say("etaoin", 1_000_000)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert tokens.TokenCounter(path)(texts) == list(map(len, want))
    assert [list(array("I", x)) for x in map(packing.Encoder(path), texts)] == want


def test_queue_of_ranks(path, library, monkeypatch):
    """Pre-tokens that go on by the queue after few rounds."""
    monkeypatch.setattr(tokens, "ROUNDS", 2)
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcé ï漢 0\U0001f600eee", k=rng.randint(0, 300))) for _ in range(1500)]
    assert tokens.TokenCounter(path)(texts) == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_counts(spark, sf, rows, library):
    want = {}
    for r in rows:
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want[r.doc_id] = (len((r.text or "").encode()), n, n > 512)
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op2_token_counts(spark, sf).collect()} == want


def test_packing(spark, sf, rows, library):
    got = queries.op6_packing(spark, sf).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and 1 <= r.length <= 2048 for r in got)
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == {r.doc_id for r in rows}
    for d in rows:
        ids, at = [*library.encode(d.text or "", add_special_tokens=False).ids, 1], 0
        for p in sorted(pieces[d.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            at += p.length
            assert p.ids_crc32 == zlib.crc32(array("I", ids[p.start : at]).tobytes())
        assert at == len(ids)


def test_sequences_come_bucket_by_bucket(spark, docs, path):
    parts = packing.pack(docs.repartition(3), path).select("sequence_id", "bucket").orderBy("sequence_id").collect()
    for a, b in zip(parts, parts[1:], strict=False):
        assert a.bucket <= b.bucket or a.sequence_id >> 33 < b.sequence_id >> 33
    assert len({p.bucket for p in parts}) > 3


def test_hard_rows(hard, path, library):
    want = Counter((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in hard.collect())
    out = tokens.token_counts(hard, path)
    assert Counter((r.doc_id, r.n_tokens) for r in out.collect()) == want
    assert "spans" in out.columns and "N_TOKENS" not in out.columns
    packed = packing.pack(hard, path)
    assert packed.agg({"length": "sum"}).first()[0] == sum((n + 1) * k for (_, n), k in want.items())
    assert tokens.token_counts(hard.limit(0), path).count() == packing.pack(hard.limit(0), path).count() == 0


def test_buckets(spark, docs, path, tmp_path):
    packed = packing.pack(docs.limit(20), path)
    packing.write_buckets(packed, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.where("length <> shiftleft(1, bucket)").count() == 0
    assert back.count() == packed.count()
