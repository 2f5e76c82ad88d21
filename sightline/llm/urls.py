"""URL filtering: rules, and for the other URLs a character language-model ratio, in built-in functions only.

What is judged is the host without its last label and the path. Accepted and rejected URLs (those that a rule decides, also
without the rest of the host and the path that the rule asks for, as these say nothing about URLs that no rule fits) give one
Markov model each: characters after contexts of two, one
and no characters, every order smoothed by the next lower one in proportion to the number of different continuations. A
URL's score is the log-likelihood difference per character. The cut is calibrated on a fold of the accepted URLs that the
models did not see: at most FALSE_REJECTION of them lie below it. It is the exact score of that rank, found by counting
scores in ranges and then in the parts of the one range that holds the rank.

Characters are folded to an alphabet of SIZE symbols, so a model has SIZE**3 numbers (under 40,000), whatever the input;
these numbers are fetched once and stand in the scoring expression as a constant array, so that scoring moves no row.

A null url, or one without "://", has empty host and path, fits no rule and is allowed (there is no evidence), as are all
undecided URLs where rules accept or reject none. Ties in a score count as on the allowed side. Repeated rows are judged
each for itself; an empty table gives an empty one; only id and url are read, so that no other column can clash.
"""

from __future__ import annotations

import math
import string
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm._common import materialize

#: (verdict, host, path prefix); a rule fits its host and all subdomains, and the longest rule that fits wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Folded alphabet: begin, end, letters, any digit, punctuation, anything else.
ALPHABET = "^$" + string.ascii_lowercase + "0" + "./-_" + "*"
SIZE = len(ALPHABET)
FALSE_REJECTION, FOLDS = 0.01, 5
#: Ranges of scores in a unit, as powers of two, from coarse to finer than the 9 digits of a score.
RANGES = (8, 19, 30)
_PLAIN = string.ascii_lowercase + "./-_"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def apply_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column, Column, Column]:
    """Rule (host and path), its verdict, and what the models see of host and path: not the last label, nor what the rule asks
    for (but a last "/"). Of equally long rules the first listed wins."""
    rule = verdict = F.lit(None).cast("string")
    host_rest, path_rest = F.regexp_replace(host, "[^.]*$", ""), path
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
        host_rest = F.when(fits, F.substr(host, F.lit(1), F.length(host) - len(h))).otherwise(host_rest)
        path_rest = F.when(fits, F.substr(path, F.lit(max(1, len(p))))).otherwise(path_rest)
    return rule, verdict, host_rest, path_rest


def symbols(host: Column, path: Column) -> Column:
    """The folded characters as numbers, between two begins and an end."""
    low = F.translate(F.concat(host, path), string.ascii_uppercase + string.digits, string.ascii_lowercase + "0" * 10)
    folded = F.regexp_replace(low, "[^a-z0./_-]", "*")
    numbers = F.transform(F.split(F.concat(F.lit("^^"), folded, F.lit("$")), ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.filter(numbers, lambda c: c >= 0)


def grams(s: Column) -> Column:
    """Codes (0 to SIZE**3 - 1) of all windows of three symbols; s must be a column, as every window looks into it."""
    return F.transform(F.slice(s, F.lit(1), F.size(s) - 2), lambda c, i: (c * SIZE + F.get(s, i + 1)) * SIZE + F.get(s, i + 2))


def held_out(url: Column) -> Column:
    """Whether a URL is in the fold that calibrates the cut (every FOLDS-th by its MD5, which any SQL engine has)."""
    return F.conv(F.substr(F.md5(url), F.lit(1), F.lit(8)), 16, 10).cast("long") % FOLDS == 0


def log_ratios(train: DataFrame) -> DataFrame:
    """From (accepted, code) rows, one row: an array with the log of the two models' ratio for each code."""
    seen = train.groupBy("code").agg(F.count_if("accepted").alias("n1"), F.count_if(~F.col("accepted")).alias("n0"))
    grid = train.sparkSession.range(SIZE**3).select(F.col("id").cast("int").alias("code"))
    grid = grid.join(seen, "code", "left").na.fill(0).select("code", F.array("n0", "n1").alias("n"), F.expr(f"code div {SIZE}").alias("ab"), F.expr(f"code div {SIZE} % {SIZE}").alias("b"), F.expr(f"code % {SIZE}").alias("c"))
    both = lambda f: F.array(*(f(k) for k in (0, 1)))
    n = lambda k: F.get("n", F.lit(k))
    one = grid.groupBy("c").agg(both(lambda k: F.sum(n(k))).alias("n"))
    total = one.agg(both(lambda k: F.sum(n(k))).alias("all"))
    one = one.crossJoin(total).select("c", both(lambda k: (n(k) + 1) / (F.get("all", F.lit(k)) + SIZE)).alias("p1"))
    two = grid.groupBy("b", "c").agg(both(lambda k: F.sum(n(k))).alias("n"))
    row = lambda what: both(lambda k: F.sum(n(k)) if what == "sum" else F.count_if(n(k) > 0))
    two_all = two.groupBy("b").agg(row("sum").alias("all"), row("kinds").alias("kinds"))
    smooth = lambda lower: both(lambda k: F.when(F.get("all", F.lit(k)) > 0, (n(k) + F.get("kinds", F.lit(k)) * F.get(lower, F.lit(k))) / (F.get("all", F.lit(k)) + F.get("kinds", F.lit(k)))).otherwise(F.get(lower, F.lit(k))))
    two = two.join(two_all, "b").join(one, "c").select("b", "c", smooth("p1").alias("p2"))
    three_all = grid.groupBy("ab").agg(row("sum").alias("all"), row("kinds").alias("kinds"))
    three = grid.join(three_all, "ab").join(two, ["b", "c"]).select("code", smooth("p2").alias("p3"))
    ratio = F.ln(F.get("p3", F.lit(1))) - F.ln(F.get("p3", F.lit(0)))
    return three.agg(F.sort_array(F.collect_list(F.struct("code", ratio.alias("r")))).alias("m")).select(F.transform("m", lambda x: x["r"]).alias("m"))


def exact_quantile(scores: DataFrame, share: float) -> float | None:
    """The least of the values in (score, n) rows, n their counts, that has this share of all values at or below it.

    Log ratios are small numbers, so that the coarse ranges are some thousand and the parts of a range 2,048 at most; only
    these are fetched."""
    rows = scores.where("score is not null")
    total = rows.agg(F.sum("n").alias("n")).first()["n"]
    if not total:
        return None
    rank = max(1, math.ceil(Fraction(str(share)) * total))
    for value in (*(F.floor(F.col("score") * float(1 << k)) for k in RANGES), F.col("score")):
        for at, n in sorted(tuple(r) for r in rows.groupBy(value.alias("at")).agg(F.sum("n").alias("n")).collect()):
            if rank <= n:
                break
            rank -= n
        rows = rows.where(value == F.lit(at))
    return at


def judge(df: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """Return page_id, host, path, rule, score (log-likelihood difference per character; null without host) and verdict."""
    host, path = split_url(F.col("url"))
    pages = df.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict, host_rest, path_rest = apply_rules(F.col("host"), F.col("path"), rules)
    pages = pages.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("ruled"), symbols(host_rest, path_rest).alias("s"))
    known = pages.where("ruled is not null").select((F.col("ruled") == "allow").alias("accepted"), held_out(F.col("url")).alias("held"), grams(F.col("s")).alias("g"))
    model = log_ratios(known.where("not held").select("accepted", F.explode("g").alias("code")))
    ratios = F.split(F.lit(",".join(f"{x:.5f}" for x in model.first()["m"])), ",").cast("array<double>")
    score = lambda g: F.round(F.aggregate(g, F.lit(0.0), lambda s, code: s + F.get(ratios, code)) / F.size(g), 9)
    counted = known.select("accepted", F.when(F.col("held") & F.col("accepted"), score(F.col("g"))).alias("score")).groupBy("accepted", "score").agg(F.count("*").alias("n"))
    counted = materialize(counted, "scores")
    sides = counted.agg(F.bool_or("accepted").alias("yes"), F.bool_or(~F.col("accepted")).alias("no")).first()
    cut = exact_quantile(counted, FALSE_REJECTION) if sides["yes"] and sides["no"] else None
    with_grams = pages.select("page_id", "host", "path", "rule", "ruled", grams(F.col("s")).alias("g"))
    scored = with_grams.select("page_id", "host", "path", "rule", "ruled", F.when(F.col("host") != "", score(F.col("g"))).alias("score"))
    below = F.coalesce(F.col("score") < F.lit(cut).cast("double"), F.lit(False))
    return scored.select("page_id", "host", "path", "rule", "score", F.coalesce("ruled", F.when(below, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
