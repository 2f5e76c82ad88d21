"""Quality rules with risk-controlled thresholds, in built-in functions only.

Every rule rejects documents whose figure lies above its cutoff. The cutoffs of all rules are tried together, in LEVELS
fixed steps from the loosest to the strictest, per stratum (language), on the labelled documents of good quality: the exact
binomial probability of seeing so few of them rejected by any rule, if the true rate were above RISK, must be at most
ERROR / strata, and the last step before the first failure is taken. So, with probability 1 - ERROR over all strata
(Bonferroni; within a sequence of a fixed order no further correction is due), every stratum loses at most RISK of its
good documents to the rules. Where the labels are too few to show it, the rules reject nothing there.

Strata are the STRATA - 1 most labelled languages, and one for all others and for null, which bounds the table of cutoffs.
Labels that contradict each other count as not good; several rows of one labelled id count once, as rejected where any
of them is; null ids are not labelled. Null texts have no words; empty, very long and repeated texts need no care; an empty
table gives an empty one, empty labels no cutoffs. Only the named columns are read, so that others can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.llm._common import materialize

SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\f\r"
MIN_WORDS, MAX_REPEATED = 50, 50
RISK, ERROR, STRATA = 0.02, 0.05, 256
#: Figure and its cutoffs from loose to strict, a step of the sequence each.
RULES = {
    "symbol_ratio": (1.0, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03),
    "dup_line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "repeat_ratio": (0.5, 0.45, 0.4, 0.35, 0.3, 0.27, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05),
    "mean_word_chars": (40.0, 35.0, 30.0, 25.0, 22.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0),
}
LEVELS = len(RULES["symbol_ratio"])
OTHER = ""


def measure(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Return doc_id, lang, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each row.

    Windows of three words are sorted as numbers, their hash with the low bits replaced by their place; neighbours with
    equal high bits are candidates, which are compared by whole hash. All of it stays in the document's own row.
    """
    t = F.col("text")
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    count_of = lambda c, chars: F.length(c) - F.length(F.translate(c, chars, ""))
    step = rows.select(
        "doc_id",
        "lang",
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        count_of(t, SYMBOLS).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("lines"),
        F.transform(F.array_remove(F.split(t, "[ \\t-\\r]+"), ""), lambda w: F.xxhash64(w)).alias("h"),
    )
    step = step.select(
        "doc_id",
        "lang",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("h").cast("long").alias("n_words"),
        "h",
        F.expr("bigint(1) << length(bin(size(h)))").alias("low"),
    )
    carried = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    h, low = F.col("h"), F.col("low")
    window = lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))
    n = F.size("h")
    places = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    step = step.select(*carried, "h", "low", F.transform(places, lambda i: window(i).bitwiseAND(-low).bitwiseOR(i.cast("long"))).alias("packed"))
    step = step.select(*carried, "h", "low", F.sort_array("packed").alias("s"))
    alike = lambda x, y: F.coalesce(x.bitwiseAND(-low) == y.bitwiseAND(-low), F.lit(False))
    s = F.col("s")
    maybe = F.filter(s, lambda x, j: alike(x, F.get(s, j - 1)) | alike(x, F.get(s, j + 1)))
    exact = F.sort_array(F.transform(maybe, lambda x: F.struct(window(x.bitwiseAND(low - 1).cast("int")).alias("w"), x.bitwiseAND(low - 1).cast("int").alias("p"))))
    step = step.select(*carried, exact.alias("e"))
    e = F.col("e")
    same = lambda x, y: F.coalesce(x["w"] == y["w"], F.lit(False))
    places = F.sort_array(F.transform(F.filter(e, lambda x, j: same(x, F.get(e, j - 1)) | same(x, F.get(e, j + 1))), lambda x: x["p"]))
    step = step.select(*carried, places.alias("p"))
    p = F.col("p")
    covered = F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return step.select(*carried, covered.cast("long").alias("n_repeat_words"))


def figures() -> dict[str, Column]:
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {"symbol_ratio": ratio("n_symbols", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"), "repeat_ratio": ratio("n_repeat_words", "n_words"), "mean_word_chars": ratio("word_chars", "n_words")}


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X of n trials at this rate, summed term by term in logarithms; 1 where k is beyond the mean."""
    odds = F.lit(rate / (1 - rate))
    start = F.ln(F.lit(1 - rate)) * n
    steps = F.when((k > 0) & (k <= n * rate), F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))

    def add(acc, i):
        term = acc["term"] + F.ln(odds * (n - i + 1) / i)
        top = F.greatest(acc["sum"], term)
        return F.struct(term.alias("term"), (top + F.ln(F.exp(acc["sum"] - top) + F.exp(term - top))).alias("sum"))

    tail = F.aggregate(steps, F.struct(start.alias("term"), start.alias("sum")), add, lambda acc: F.exp(acc["sum"]))
    return F.when(k > n * rate, F.lit(1.0)).otherwise(tail)


def cutoffs(measured: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row with a map from stratum to its struct of cutoffs (null: the rules reject nothing)."""
    names = list(RULES)
    good = labels.select(F.col(doc_id).alias("doc_id"), F.col(quality).alias("q")).where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("q", F.lit(0))).alias("q")).where("q = 1")
    shown = measured.select("doc_id", F.coalesce("lang", F.lit(OTHER)).alias("lang"), *(c.alias(k) for k, c in figures().items()))
    # the first level that rejects a document; with several rows of one id the least
    passes = lambda k: F.size(F.filter(F.array(*map(F.lit, RULES[k])), lambda c: F.col(k) <= c))
    level = F.least(*map(passes, names))
    held = shown.join(good, "doc_id").groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min(level).alias("level"))
    counts = held.groupBy("lang").agg(F.count("*").alias("n"), *(F.count_if(F.col("level") <= i).alias(f"k{i}") for i in range(LEVELS)))
    place = F.row_number().over(W.orderBy(F.desc("n"), "lang"))
    folded = counts.withColumn("stratum", F.when(place < STRATA, F.col("lang")).otherwise(F.lit(OTHER)))
    summed = folded.groupBy("stratum").agg(F.sum("n").alias("n"), *(F.sum(f"k{i}").alias(f"k{i}") for i in range(LEVELS)))
    tests = summed.crossJoin(summed.agg(F.count("*").alias("m")))
    passed = F.array(*(binomial_tail(F.col(f"k{i}"), F.col("n"), risk) <= F.lit(error) / F.col("m") for i in range(LEVELS)))
    # the steps before the first that fails
    upto = F.array_position(F.concat(passed, F.array(F.lit(False))), False) - 1
    cut = F.struct(*(F.when(upto > 0, F.get(F.array(*map(F.lit, RULES[k])), (upto - 1).cast("int"))).alias(k) for k in names))
    return tests.select("stratum", cut.alias("cut")).agg(F.map_from_entries(F.collect_list(F.struct("stratum", "cut"))).alias("cuts"))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """Return measure()'s columns, base_failed, failed_rules (names of the rules that reject) and kept."""
    rows = materialize(measure(docs, doc_id, text, lang), "quality")
    cuts = cutoffs(rows, labels, label_id, quality).scalar()
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    stratum = F.coalesce("lang", F.lit(OTHER))
    with_cut = rows.select("*", base.alias("base_failed"), F.coalesce(F.try_element_at(cuts, stratum), F.try_element_at(cuts, F.lit(OTHER))).alias("cut"))
    failed = F.array_compact(F.array(*(F.when(c > F.col("cut")[k], F.lit(k)) for k, c in figures().items())))
    judged = with_cut.select(*rows.columns, "base_failed", failed.alias("failed_rules"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
