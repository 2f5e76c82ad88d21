from array import array

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from sightline.llm import language
from test_decontaminate import brute, cut
from test_language import by_plain_compression
from test_pii import base
from test_simhash import fingerprint, groups


def test_stages_against_brute_force(spark, sf, docs, rows, path):
    stage = dict(P.STAGES)
    columns = docs.columns

    dictionaries = language.train(docs)
    clear = lambda t: t and any(c.isalpha() for c in t) and by_plain_compression(dictionaries, t)[1] >= language.MIN_MARGIN
    want = {r.doc_id for r in rows if clear(r.text)}
    first = stage["language_id"](spark, docs, sf).cache()
    assert {r.doc_id for r in first.collect()} == want and first.columns == columns
    assert len(want) > 0.8 * len(rows)

    kept = first.orderBy("doc_id").collect()
    ids = [r.doc_id for r in kept]
    second = stage["simhash_near_dedup"](spark, first, sf).cache()
    assert sorted(r.doc_id for r in second.collect()) == sorted(set(groups(ids, [fingerprint(r.text) for r in kept])))
    assert second.columns == columns

    text = {r.doc_id: r.text for r in second.collect()}
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    third = stage["benchmark_decontamination"](spark, second, sf).cache()
    hits = dict(zip(text, brute(text.values(), bench), strict=True))
    got = {r.doc_id: r.text for r in third.collect()}
    assert got == {d: cut(t, set(hits[d][1])) if t else t for d, t in text.items()} and any(h[1] for h in hits.values())
    assert third.columns == columns

    fourth = stage["pii"](spark, third, sf).cache()
    masked = {r.doc_id: r.text for r in fourth.collect()}
    for d, t in got.items():
        if not base(t):
            assert masked[d] == t
        else:
            assert masked[d] != t and all(t[a:b] not in masked[d] for a, _, b in base(t))
    assert fourth.columns == columns

    library = Tokenizer.from_file(path)
    packed = {}
    for r in stage["packing"](spark, fourth, sf).orderBy("doc_id", "start").collect():
        packed.setdefault(r.doc_id, []).extend(array("I", bytes(r.input_ids)))
    assert packed == {d: [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t in masked.items()}


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 0 and P.ORACLE_SQL is None


def test_no_documents_and_clashing_columns(spark, sf, docs):
    """Stages keep the columns that they are given, whatever their names, and stand an empty table."""
    clash = docs.withColumns({c: F.lit("clash") for c in ("spans", "score", "hits", "fp", "rejected", "n_words", "items")})
    for of in (clash.limit(0), clash.limit(40)):
        for name, stage in P.STAGES[:-1]:
            of = stage(spark, of, sf)
            assert of.columns == clash.columns, name
            assert {tuple(r) for r in of.select("spans", "score", "hits", "rejected", "items").distinct().collect()} <= {("clash",) * 5}
    assert P.pack(spark, docs.limit(0), sf).count() == 0
