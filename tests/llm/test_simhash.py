import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sightline.llm import components, queries, simhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 3):
            x, y = find(i), find(i + 1 + int(j))
            root[max(x, y)] = min(x, y)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return [least.get(find(i)) for i in range(len(ids))]


def test_query(spark, sf, rows):
    prints = [fingerprint(r.text) for r in rows]
    want = {r.doc_id: (f"{p:016x}", c) for r, p, c in zip(rows, prints, groups([r.doc_id for r in rows], prints), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op3_simhash_near_dedup(spark, sf).collect()} == want
    assert any(c != d for d, (_, c) in want.items())


def test_hard_rows(hard):
    data = hard.collect()
    prints = [fingerprint(r.text) for r in data]
    want = sorted(map(str, zip([r.doc_id for r in data], [f"{p:016x}" for p in prints], groups([r.doc_id for r in data], prints), strict=True)))
    got = simhash.near_duplicates(hard)
    assert sorted(str(tuple(r)) for r in got.select("doc_id", "fingerprint", "component_id").collect()) == want
    assert simhash.near_duplicates(hard.limit(0)).count() == simhash.drop_near_duplicates(hard.limit(0)).count() == 0
    assert simhash.drop_near_duplicates(hard).count() == len({w[2] for w in zip(prints, prints, groups(list(range(len(prints))), prints), strict=True)})


def test_links_of_random_prints(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(12)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {(r.u, r.v) for r in simhash.links(df).collect()}
    want = {(u, v) for u in signed for v in signed if u < v and ((u ^ v) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want and want


def test_components_of_a_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1002), (5000, 5000)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(n)} | {i: 1000 for i in (1000, 1001, 1002)}
    assert components.components(spark.createDataFrame([], "u long, v long")).agg(F.count("*")).first()[0] == 0
