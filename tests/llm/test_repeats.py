import hashlib
import random
from collections import Counter

import pytest

from sightline.llm import queries, repeats


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, x in zip(r, gone, strict=True) if not x)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shown(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in df.collect())


def test_random_copies(spark):
    rng = random.Random(5)
    for alphabet in ("ab", "abcdefgh é"):
        pool = ["".join(rng.choices(alphabet, k=rng.randint(10, 80))) for _ in range(12)]
        texts = ["".join(rng.choices(pool, k=rng.randint(0, 4))) + "".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(150)]
        texts += [texts[3], texts[3], None, "", "a" * 300, "ab" * 100, "a" * 15]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        for length, short in ((16, 12), (16, 16), (30, 28), (60, 52)):
            want = Counter((i, *w) for i, w in enumerate(brute(texts, length)))
            assert shown(repeats.remove_repeats(df, length=length, short=short)) == want


@pytest.mark.parametrize("first", [1 << 11, 4])
def test_many_ranges(spark, monkeypatch, first):
    """Many ranges, dealt at once or in two steps, and tasks that send often; names that are met twice in a task, and only
    across tasks."""
    monkeypatch.setattr(repeats, "RANGE_BYTES", 20)
    monkeypatch.setattr(repeats, "FIRST_RANGES", first)
    monkeypatch.setattr(repeats, "HELD", 150)
    monkeypatch.setattr(repeats, "AT_ONCE", 40)
    rng = random.Random(6)
    pool = ["".join(rng.choices("abcdef é", k=rng.randint(20, 90))) for _ in range(25)]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 5))) + "".join(rng.choices("abcdef", k=rng.randint(0, 50))) for _ in range(120)] + ["ab" * 300]
    want = Counter((i, *w) for i, w in enumerate(brute(texts, 30)))
    for parts in (1, 6):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
        assert shown(repeats.remove_repeats(df, length=30, short=28)) == want


def test_one_very_long_text(spark, monkeypatch):
    """A text of many times what a task sends at once, that has passages of its own twice and shares one with a short text."""
    monkeypatch.setattr(repeats, "HELD", 20_000)
    monkeypatch.setattr(repeats, "AT_ONCE", 3000)
    rng = random.Random(7)
    say = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    a, b = say(5000), say(700)
    long = say(900_000) + a + say(600_000) + b + say(400_000) + a + say(10)
    df = spark.createDataFrame([(1, long), (2, say(100) + b + say(50)), (3, say(3000))], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in repeats.remove_repeats(df).collect()}
    at = [900_000, 1_505_000, 1_905_700]
    assert got == {1: [(at[0], at[0] + 5000), (at[1], at[1] + 700), (at[2], at[2] + 5000)], 2: [(100, 800)], 3: []}


def test_number_of_ranges():
    """A range keeps the size of its texts, whatever the input's."""
    for total in (10**6, 10**9, 10**12, 10**14):
        n = 1 << repeats.range_bits(total, 8)
        assert total / n <= repeats.RANGE_BYTES and (n <= 16 or total / n >= repeats.RANGE_BYTES / 2.01)


def test_production_length(spark, sf, rows):
    want = Counter((r.doc_id, *w) for r, w in zip(rows, brute([r.text for r in rows], 400), strict=True))
    got = Counter(tuple(r) for r in queries.op1_suffix_array_dedup(spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == want
    assert any(r[2] for r in want)


def test_hard_rows(spark, hard):
    data = hard.collect()
    want = Counter((r.doc_id, *w) for r, w in zip(data, brute([r.text for r in data], 400), strict=True))
    assert shown(repeats.remove_repeats(hard)) == want
    assert repeats.remove_repeats(hard.limit(0)).count() == 0
