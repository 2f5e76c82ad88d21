import math
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from sightline.llm import queries, urls


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    tail = rest[cut:]
    end = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def seen(url):
    """What the models see: not the last label, nor what the rule asks for."""
    host, path = split(url)
    rule = rule_of(host, path)[0]
    if rule is None:
        return host[: host.rfind(".") + 1], path
    fit = next(x for x in urls.RULES if x[1] + x[2] == rule)
    return host[: -len(fit[1])], path[len(fit[2]) - 1 :]


def symbols(host, path):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host + path)
    low = "".join("0" if c in "0123456789" else c for c in low)
    return [urls.ALPHABET.index(c if c in urls.ALPHABET[2:-1] else "*") for c in low]


def model(strings):
    """p(c | a, b) by interpolation of orders three to one, plainly."""
    count = [Counter(), Counter(), Counter()]
    for s in strings:
        s = [0, 0, *s, 1]
        for i in range(2, len(s)):
            count[0][s[i]] += 1
            count[1][s[i - 1], s[i]] += 1
            count[2][s[i - 2], s[i - 1], s[i]] += 1
    total = sum(count[0].values())
    after = [None, defaultdict(list), defaultdict(list)]
    for k in (1, 2):
        for g, n in count[k].items():
            after[k][g[:-1]].append(n)

    def p(a, b, c):
        out = (count[0][c] + 1) / (total + urls.SIZE)
        for k, context, gram in ((1, (b,), (b, c)), (2, (a, b), (a, b, c))):
            n = after[k].get(context)
            if n:
                out = (count[k][gram] + len(n) * out) / (sum(n) + len(n))
        return out

    return p


@pytest.fixture(scope="module")
def pages(spark):
    data = [(i, u) for i, u in enumerate(["http://a.com/x", "HTTP://Sub.A.COM/p?q#r", "x.net/es/a", None, "", "http://", "://b.net/es/", "http://example.com/en/1", "http://www.example.com/en/1", "http://wexample.com/en/", "http://c.net/fr/a?://z.com/", "http://c.net/frx", "http://ü.org/é#a", "http://net/es/"])]
    data += [(100 + i, f"https://shop{i}.com/item/{i * 7}") for i in range(60)] + [(200 + i, f"https://spam-win{i}.net/es/casino-{i}") for i in range(60)] + [(300 + i, f"https://x{i}.org/{'casino' if i % 2 else 'item'}-{i}") for i in range(20)]
    return spark.createDataFrame([*data, data[0], (None, "http://a.com/x")], "page_id long, url string")


def test_split_and_rules(pages):
    for r in urls.judge(pages).join(pages, ["page_id"]).collect():
        host, path = split(r.url)
        assert (r.host, r.path) == (host, path)
        rule, verdict = rule_of(host, path)
        assert r.rule == rule and (verdict is None or r.verdict == verdict)


def test_scores_against_a_plain_model(spark, pages):
    held = {r.page_id for r in pages.select("page_id", urls.held_out(F.col("url")).alias("held")).collect() if r.held}
    known = {True: [], False: []}
    for r in pages.collect():
        verdict = rule_of(*split(r.url))[1]
        if verdict and r.page_id not in held:
            known[verdict == "allow"].append(symbols(*seen(r.url)))
    yes, no = model(known[True]), model(known[False])
    url = {r.page_id: r.url for r in pages.collect()}
    for r in urls.judge(pages).where("host <> ''").collect():
        s = [0, 0, *symbols(*seen(url[r.page_id])), 1]
        want = sum(math.log(yes(*s[i - 2 : i + 1]) / no(*s[i - 2 : i + 1])) for i in range(2, len(s))) / (len(s) - 2)
        assert abs(r.score - want) < 1e-4


def test_query(spark, sf):
    url = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op5_url_filters(spark, sf).collect()
    assert len(got) == len(url)
    for r in got:
        rule, verdict = rule_of(*split(url[r.page_id]))
        assert (r.host, r.path, r.rule) == (*split(url[r.page_id]), rule) and r.verdict in ("allow", "block")
        assert verdict in (None, r.verdict)
    assert urls.judge(spark.read.parquet(f"{sf}/pages.parquet").limit(0)).count() == 0


def test_cut_is_exact(spark):
    """The score of the exact rank, of many values on any partitioning, where the approximate percentile is off."""
    value = F.round((F.xxhash64("id") % 1000003) / 271828.0 - (F.col("id") % 7) / 9, 9)
    rows = spark.range(200000, numPartitions=7).select(value.alias("score"))
    want = sorted(r.score for r in rows.collect())[1999]
    assert rows.agg(F.percentile_approx("score", F.lit(0.01), F.lit(10000))).first()[0] != want
    for counted in (rows.select("score", F.lit(1).alias("n")), rows.repartition(3).groupBy("score").agg(F.count("*").alias("n"))):
        assert urls.exact_quantile(counted, 0.01) == want
    few = lambda *v: spark.createDataFrame([(float(x), n) for x, n in v], "score double, n long")
    assert urls.exact_quantile(few((-1.5, 1), (0, 98), (-0.5, 2)), 0.01) == -0.5 and urls.exact_quantile(few((3, 1)), 0.01) == 3.0
    assert urls.exact_quantile(few((1, 1)).limit(0), 0.01) is None


def test_long_urls_and_clashing_columns(spark, pages):
    long = [(9001, "http://x.org/" + "a/" * 50_000), (9002, "http://" + "b." * 2_000 + "com/en"), (9003, None), (9003, "http://" + "é" * 5_000)]
    df = pages.union(spark.createDataFrame(long, pages.schema)).select("*", *(F.lit("clash").alias(c) for c in ("host", "path", "rule", "verdict", "score", "held", "g")))
    got = [r for r in urls.judge(df).collect() if (r.page_id or 0) > 9000]
    assert sorted((r.page_id, r.host, r.path) for r in got) == sorted((i, *split(u)) for i, u in long)
    assert all(r.verdict in ("allow", "block") for r in got) and {r.rule for r in got} == {None, "com/"}
