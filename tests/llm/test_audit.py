import re
from collections import Counter, defaultdict
from itertools import permutations

from pyspark.sql import functions as F

from sightline.llm import audit


def plain(rows, labels):
    """Runs every order over the rows themselves: {(part, order, step): counts}."""
    said = defaultdict(lambda: [0, 0])
    for key, quality, toxic in labels:
        if key is not None:
            said[key] = [max(said[key][0], quality or 0), max(said[key][1], toxic or 0)]
    judged = []
    for key, text, part in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in rows),
        }
        judged.append((part or "", {f for f, bad in fails.items() if bad}, *(said[key] if key is not None else (0, 0))))
    out, shapley = {}, Counter()
    for p in {r[0] for r in judged}:
        docs = [r for r in judged if r[0] == p]
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                redundant = sum(1 for d in docs if f in d[1] and d[1] & set(order[: step - 1]))
                out[p, order, step] = [len(left), len(gone), redundant, sum(1 for d in docs if d[1] == {f}), sum(d[2] == 1 for d in gone), sum(d[3] == 1 for d in gone)]
                shapley[p, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def collected(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_brute_force(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    few = docs.withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")))
    got = collected(audit.audit(few, labels))
    rows = [(r.doc_id, r.text, r.source) for r in few.collect()]
    assert got == plain(rows, [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert len(got) == 3 * 600


def test_hard_rows(spark, hard, monkeypatch):
    monkeypatch.setattr(audit, "CHUNK", 40)
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (None, 1, 1), (5, None, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    rows = hard.unionByName(hard.where("doc_id in (5, 7)").withColumn("doc_id", F.col("doc_id") + 20)).unionByName(hard.where("doc_id = 1").withColumn("lang", F.lit("de"))).unionByName(hard.where("doc_id is null"))
    got = collected(audit.audit(rows, labels, part="lang"))
    assert got == plain([(r.doc_id, r.text, r.lang) for r in rows.collect()], [tuple(r) for r in labels.collect()])
    assert audit.audit(hard.limit(0), labels, part="lang").count() == 0
    assert collected(audit.audit(rows, labels.limit(0), part="lang")).keys() == got.keys()


def test_sums_invert_to_cells(spark):
    owners = [[("p", 1)], [("p", 2), ("q", 1)], [("p", 1)], [("q", 1)], [("p", 3)]]
    masks = [0, 5, 15, 5, 5]
    rows = spark.createDataFrame([(i, bytes([h]), m, 0, o) for i, (h, m, o) in enumerate(zip([1, 2, 3, 2, 2], masks, owners, strict=True))], "doc_id long, hash binary, mask int, label int, owners array<struct<part:string,n:long>>")
    cells = {r.part: r.cells for r in audit.cells(audit.parity_sums(rows)).collect()}
    p, q = Counter(dict(enumerate(cells["p"]))), Counter(dict(enumerate(cells["q"])))
    assert +p == Counter({0: 1, 5: 2, 15: 1, 5 + 16: 3}) and +q == Counter({5: 1, 5 + 16: 1})


def test_long_words_stay_whole():
    assert b"".join(audit.chunks(b"aa bb " * 9 + b"c" * 50 + b" d", 7)) == b"aa bb " * 9 + b"c" * 50 + b" d"
    assert all(c[-1:] == b" " for c in list(audit.chunks(b"aa bb " * 9 + b"c" * 50 + b" d", 7))[:-1])
