import random
import re
from collections import Counter

from sightline.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(texts, items, n=10):
    windows = {}
    for key, t in items:
        w = words(t)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if key is None else str(key))
    sizes = {len(k) for k in windows}
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for s in sizes:
            for i in range(len(w) - s + 1):
                if found := windows.get(tuple(w[i : i + s])):
                    hit |= set(range(i, i + s))
                    ids |= found
        out.append((len(w), tuple(sorted(hit)), tuple(sorted(ids))))
    return out


def cut(text, hit):
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    gone = set()
    for p in hit:
        gone |= set(range(*places[p]))
        if p + 1 in hit:
            gone |= set(range(places[p][1], places[p + 1][0]))
    return "".join(c for i, c in enumerate(text) if i not in gone)


def test_random_words(spark):
    rng = random.Random(4)
    for vocabulary in (2, 5, 40):
        say = lambda n: " ".join(rng.choices([f"W{i}é" if i % 3 else f"w{i}" for i in range(vocabulary)], k=n))  # noqa: B023, E731
        items = [(rng.choice([1, 2, 3, None, 10]), say(rng.randint(0, 14))) for _ in range(12)] + [(7, None), (8, "...")]
        texts = [say(rng.randint(0, 60)) for _ in range(60)] + [None, "", *(f"x {t} y" for _, t in items)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        bench = spark.createDataFrame(items, "item_id long, text string")
        for size in (D.BLOCK_BYTES, 200):
            got = D.find_contamination(docs, bench, window=4, block_bytes=size).orderBy("doc_id").collect()
            assert [(r.n_words, tuple(r.hits), tuple(r.items)) for r in got] == brute(texts, items, 4)
        shown = D.find_contamination(docs, bench, window=4)
        for r in shown.select("text", "hits", D.remove_spans(shown["text"], shown["spans"]).alias("rest")).collect():
            assert r.rest == (r.text if r.text is None else cut(r.text, set(r.hits)))


def test_many_blocks_read_the_texts_once(spark, monkeypatch):
    """Some twenty blocks, and items of several pieces."""
    monkeypatch.setattr(D, "PIECE_WORDS", 12)
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choices([f"w{i}" for i in range(30)], k=n))
    items = [(i % 25, say(rng.randint(1, 60))) for i in range(60)]
    texts = [say(rng.randint(0, 40)) + " " + rng.choice(items)[1][10:] for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    pieces = D._pieces(bench, "item_id", "text", 5)
    assert pieces.count() > 120
    out = D.find_contamination(docs, bench, window=5, block_bytes=400)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert [(r.n_words, tuple(r.hits), tuple(r.items)) for r in out.orderBy("doc_id").collect()] == brute(texts, items, 5)


def test_hard_rows(spark, hard):
    bench = spark.createDataFrame([(1, "quick brown fox"), (1, "quick brown fox"), (2, "it the quick brown fox jumps over it the quick")], "item_id long, text string")
    rows = hard.collect()
    got = D.find_contamination(hard, bench).collect()
    assert Counter((r.n_words, tuple(r.hits), tuple(r.items)) for r in got) == Counter(brute([r.text for r in rows], [tuple(r) for r in bench.collect()]))
    assert D.find_contamination(hard, bench.limit(0)).where("size(hits) > 0").count() == 0
    assert D.find_contamination(hard.limit(0), bench).count() == 0
