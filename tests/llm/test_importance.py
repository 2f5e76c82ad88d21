import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from sightline.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, longest):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(rows, target, longest, buckets, percent):
    """Every document's (n_features, weight, score, rank) by id, from the contract's words."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in runs(t, longest)[1])
    t = Counter(bucket(f) for text in target for f in runs(text, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets))))
    out = []
    for key, text in rows:
        n, found = runs(text, longest)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    drawn = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    place = {id(r): i + 1 for i, r in enumerate(drawn[: len(drawn) * percent // 100])}
    return Counter((r[0], r[2], r[3], r[4], place.get(id(r))) for r in out)


@pytest.mark.parametrize(("longest", "nodes", "chunk"), [(1, 500_000, 1 << 20), (3, 2000, 50)])
def test_brute_force(spark, docs, sf, monkeypatch, longest, nodes, chunk):
    """Also with tries that start afresh, texts in many pieces, and longer runs."""
    monkeypatch.setattr(importance, "MOST_NODES", nodes)
    monkeypatch.setattr(importance, "CHUNK", chunk)
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    out = importance.resample(docs.select("doc_id", "text"), target, percent=30, buckets=997, longest=longest)
    got = Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect())
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got == plain(rows, [r.text for r in target.collect()], longest, 997, 30)
    assert sum(1 for r in got if r[-1]) > 20


def test_trie_pieces(monkeypatch):
    monkeypatch.setattr(importance, "CHUNK", 7)
    text = "Aa bb  cc dd-aa bb cc, dd eeé ff aa"
    trie = importance.Trie(3, lambda crc: crc)
    got = Counter()
    for words, old in importance.pieces(text, 3):
        for depth, nodes in trie.walk(words, old):
            got.update(depth.values[n] for n in nodes)
    assert got == Counter(zlib.crc32(f.encode()) for f in runs(text, 3)[1])


def test_hard_rows(spark, hard):
    target = spark.createDataFrame([("the lazy dog jumps",), (None,)], "text string")
    out = importance.resample(hard, target, percent=50)
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()) == plain(rows, ["the lazy dog jumps"], 1, 10_000, 50)
    assert "spans" in out.columns and out.columns.count("score") == 1
    none = hard.limit(0)
    assert importance.resample(none, target).count() == 0
    assert importance.resample(hard, none).count() == len(rows)
