import zlib

import zstandard

from sightline import session
from sightline.llm import language, queries


def test_held_out_accuracy(spark, sf, rows):
    lang = {r.doc_id: r.lang for r in rows}
    got = {r.doc_id: r for r in queries.op7_language_id(spark, sf).collect()}
    assert set(got) == set(lang)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 for d, r in got.items())
    held = [d for d, r in got.items() if r.held_out and lang[d] and r.lang_pred != "und"]
    assert sum(got[d].lang_pred == lang[d] for d in held) >= 0.95 * len(held)
    for r in rows:
        none = not r.text or not any(c.isalpha() for c in r.text)
        assert (got[r.doc_id].lang_pred == "und") == none


def test_hard_rows(hard):
    out = language.identify(hard, language.train(hard))
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in out.collect()}
    assert got[2] == got[3] == got[4] == ("und", True)
    assert got[5][0] == got[6][0] == "en"
    assert "spans" in out.columns
    assert language.train(hard.limit(0)) == {}
    assert {r.lang_pred for r in language.identify(hard, {}).collect()} == {"und"}
    assert language.identify(hard.limit(0), {"en": b"the quick brown fox"}).count() == 0


def test_letters_are_of_category_l(spark):
    texts = ["²", "½ Ⅳ", "١٢", "_ _", "ª", "字", "é", "12 a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.lang_pred == "und" for r in language.identify(df, {"en": b"the quick brown fox", "de": b"der schnelle braune fuchs"}).collect()}
    assert [got[i] for i in range(len(texts))] == [not any(c.isalpha() for c in t) for t in texts]


def by_plain_compression(dictionaries, text):
    """(language, score) by a compressor made anew for every text and block."""
    raw = language.plain(text)
    sizes = []
    for d in dictionaries.values():
        content = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        sizes.append(sum(len(zstandard.ZstdCompressor(level=language.LEVEL, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False).compress(raw[i : i + language.BLOCK])) for i in range(0, len(raw), language.BLOCK)))
    best, second = sorted(sizes)[:2]
    return list(dictionaries)[sizes.index(best)], (second - best) / second


def test_against_plain_compression(docs):
    dictionaries = language.train(docs)
    for r in language.identify(docs.limit(60), dictionaries).collect():
        if not r.text or not any(c.isalpha() for c in r.text):
            continue
        name, score = by_plain_compression(dictionaries, r.text)
        assert r.lang_pred == name and abs(r.score - score) < 1e-12 and r.rejected == (score < language.MIN_MARGIN)


def test_many_languages_share_the_dictionary_bytes(spark, monkeypatch):
    monkeypatch.setattr(language, "ALL_BYTES", 64_000)
    rows = [(f"l{i:03}", f"word{i} " * 400 + str(k)) for i in range(200) for k in range(3)]
    found = language.train(spark.createDataFrame(rows, "lang string, text string"))
    assert len(found) == 200 and sum(map(len, found.values())) <= 64_000


def test_what_the_driver_gets_is_bounded(spark, monkeypatch):
    """200 languages of long texts: the rows that are fetched have as many characters as all dictionaries have bytes."""
    monkeypatch.setattr(language, "ALL_BYTES", 256_000)
    rows = [(f"l{i:03}", f"word{i} " * 3000 + str(k)) for i in range(200) for k in range(3)]
    sizes, fetched = language.sample(spark.createDataFrame(rows, "lang string, text string"))
    assert len(sizes) == 200 and set(sizes.values()) == {1280}
    got = fetched.collect()
    assert {r.lang for r in got} == set(sizes) and 200_000 < sum(len(r.text) for r in got) <= 256_000


def test_shares():
    assert language.shares([10, 100, 100], 60) == [10, 30, 20]
    assert language.shares([5, 5], 60) == [5, 5]
    assert sum(language.shares([1000] * 7, 100)) <= 100


def test_training_writes_no_table(docs, monkeypatch):
    """Every file that an executor writes makes it start processes, which share its memory until they run."""
    want = language.train(docs)

    def refuse(spark):
        raise AssertionError("a table is written")

    monkeypatch.setattr(session, "shared_dir", refuse)
    assert language.train(docs) == want and want


def test_least_hashes_are_exact(spark):
    """Those of least hash among all distinct texts, also where most rows are copies; empty texts and their languages don't count."""
    rows = [("a", f"text {i}") for i in range(3000)] + [("a", "copy")] * 500 + [("b", f"texte {i}") for i in range(5)] + [("d", "")] * 9
    rows += [("c", f"testo {i}") for i in range(200)] + [("c", "copia")] * 20_000 + [("b", None)] * 9000
    df = spark.createDataFrame(rows, "lang string, text string")
    hashes = df.where("length(text) > 0").distinct().selectExpr("lang", "text", "xxhash64(text) AS h").collect()
    want = {(r.lang, r.text) for name in "abc" for r in sorted((r for r in hashes if r.lang == name), key=lambda r: r.h)[:20]}
    sizes, fetched = language.sample(df, docs=20)
    assert list(sizes) == ["c", "a", "b"] and {(r.lang, r.text) for r in fetched.collect()} == want
