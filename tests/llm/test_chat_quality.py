import math
from collections import Counter

from pyspark.sql import functions as F

from sightline.llm import chat, quality


def test_control_strings_round_trip(spark):
    texts = ["<|end|>\n", "<|user|>\n", "&lt;", "&amp;lt;", "[INST]", "a|>\nb", "", None, "</s>", "&", "\n"]
    data = [(1, i, "assistant" if i % 2 else "us|>\ner", t, "x") for i, t in enumerate(texts)] + [(2, 0, "user", "only", "x"), (None, 0, None, None, "x"), (3, None, "assistant", "a", "x"), (3, None, "assistant", "a", "x")]
    out = chat.format_chat(spark.createDataFrame(data, "conv_id long, turn int, role string, text string, example string"))
    whole = {r.conv_id: r.t for r in out.where("is_last").select("conv_id", chat.read_turns(F.col("text")).alias("t")).collect()}
    assert [(t.role, t.text) for t in whole[1]] == [(r, t or "") for c, _, r, t, _ in data if c == 1]
    assert [(t.role, t.text) for t in whole[None]] == [("", "")] and len(whole[3]) == 2
    loss = [r[0] for r in out.where("conv_id = 1").orderBy("example").select(chat.read_loss(F.col("text"), F.col("loss_start"), F.col("loss_end"))).collect()]
    assert loss == [t or "" for i, t in enumerate(texts) if i % 2] + [None]
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_long_conversation(spark):
    data = [(1, i, "assistant" if i % 3 == 1 else None if i % 50 == 0 else "user", f"turn {i} <|end|> " * (i % 7)) for i in range(300)]
    out = chat.format_chat(spark.createDataFrame(data, "conv_id long, turn int, role string, text string"))
    assert out.count() == 101
    whole = out.where("is_last").select(chat.read_turns(F.col("text")).alias("t")).first().t
    assert [(t.role, t.text) for t in whole] == [(r or "", t) for _, _, r, t in data]
    loss = [r[0] for r in out.orderBy("example").select(chat.read_loss(F.col("text"), F.col("loss_start"), F.col("loss_end"))).collect()]
    assert loss == [t for _, _, r, t in data if r == "assistant"] + [None]


def test_every_stratum_certifies_together(spark):
    """300 good labels a stratum suffice where no rule rejects any; the cutoffs are those of the strictest step."""
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), (i + F.col("id")).cast("string"))))
    docs = spark.range(900).select(F.col("id").alias("doc_id"), text.alias("text"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("lang"))
    measured = quality.measure(docs)
    cuts = quality.cutoffs(measured, docs.select("doc_id", F.lit(1).alias("quality"))).first().cuts
    assert set(cuts) == {"a", "b", "c"}
    assert all(c[k] == quality.RULES[k][-1] for c in cuts.values() for k in quality.RULES)
    few = quality.cutoffs(measured, docs.limit(30).select("doc_id", F.lit(1).alias("quality"))).first().cuts
    assert all(c[k] is None for c in few.values() for k in quality.RULES)


def measure(text):
    t = text or ""
    words = [w for w in "".join(" " if c in quality.SPACES else c for c in t).split(" ") if w]
    lines = [x for x in t.split("\n") if any(c not in quality.SPACES for c in x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in t), len(lines), len(lines) - len(set(lines)), len(hit)


def test_figures(hard):
    rows = hard.collect()
    assert max(len(r.text or "") for r in rows) > 90_000
    got = quality.measure(hard).collect()
    key = lambda r: str(r)
    assert sorted(map(key, ((r.doc_id, *measure(r.text)) for r in rows))) == sorted(map(key, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) for r in got)))


def test_binomial_tail(spark):
    rate = 0.005
    data = [(k, n) for n in (1, 10, 600, 5000) for k in (0, 1, 2, 20) if k <= n]
    for r in spark.createDataFrame(data, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), rate).alias("p")).collect():
        exact = sum(math.comb(r.n, j) * rate**j * (1 - rate) ** (r.n - j) for j in range(r.k + 1))
        assert abs(r.p - (1.0 if r.k > r.n * rate else exact)) < 1e-9


def test_risk_is_held_and_empty_tables(spark, hard):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 500 == 0, F.lit(text + " #" * 20)).otherwise(F.lit(text)).alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    out = quality.judge(docs, labels)
    assert out.where("not kept").count() <= quality.RISK * 2000
    assert out.where("doc_id = 500").first().kept in (True, False)
    none = quality.judge(hard, labels.limit(0))
    assert none.where("size(failed_rules) > 0").count() == 0 and none.count() == hard.count()
    assert quality.judge(hard.limit(0), labels).count() == 0
