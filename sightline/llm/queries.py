"""The operators of this subpackage as queries over whole tables."""

from __future__ import annotations

import string
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import audit, chat, decontaminate, importance, language, packing, pii, quality, repeats, simhash, tokenfiles, tokens, urls
from sightline.llm._common import new_folder, read, read_spread

HELD_OUT_OF, HELD_OUT = 4, 2


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(read_spread(spark, sf_dir, "documents"), with_kept=False)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "n_repeated")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_spread(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, tokenizer_path(), keep_text=False)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_spread(spark, sf_dir, "documents"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_spread(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs), keep_text=False)
    of_kind = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = map(of_kind, pii.KINDS)
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_spread(spark, sf_dir, "pages")).drop("score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(read_spread(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "start", "length", F.crc32("input_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % HELD_OUT_OF
    docs = read_spread(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold == HELD_OUT).alias("held_out"))
    dictionaries = language.train(docs.where("not held_out"))
    found = language.identify(docs.select("doc_id", "held_out", "text"), dictionaries, keep_text=False)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


#: A conversation that says the usual control strings.
CONTROL = "</s>[INST] ok [/INST]"


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    rows = read_spread(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    examples = chat.format_chat(rows.unionByName(own))
    turns = chat.read_turns(F.col("text"))
    each = examples.select(
        "conv_id",
        "example",
        F.when(F.col("is_last"), turns).alias("turns"),
        chat.read_loss(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
        F.length("text").alias("chars"),
    )
    whole = each.groupBy("conv_id").agg(
        F.max("turns").alias("turns"),
        F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]).alias("losses"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", "losses")
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(read_spread(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_spread(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.find_contamination(docs, read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_spread(spark, sf_dir, "documents").select("doc_id", "text")
    out = importance.resample(docs, read(spark, sf_dir, "benchmark").select("text"), keep_text=False)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-files")
    tokenfiles.write(read_spread(spark, sf_dir, "documents"), path, tokenizer_path())
    return tokenfiles.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(read_spread(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_suffix_array_dedup, op2_token_counts, op3_simhash_near_dedup, op4_pii, op5_url_filters, op6_packing, op7_language_id, op8_chat_formatting, op9_quality_rules, op10_benchmark_decontamination, op11_importance_resampling, op12_token_files, op13_filter_audit)}


def _oracle_repeats() -> str:
    n, cover = repeats.LENGTH, repeats.Cover(repeats.LENGTH, repeats.SHORT)
    part = lambda a, z: f"CASE WHEN {z} >= {a} THEN hex(b[{a}:{z}]) ELSE '' END"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT row, b, unnest(range(1, octet_length(b) - {n - 2})) AS i FROM docs WHERE octet_length(b) >= {n}),
strings AS (SELECT row, i, md5(b[i:i + {n - 1}]) AS string FROM starts),
twice AS (SELECT row, i FROM strings QUALIFY count(*) OVER (PARTITION BY string) > 1),
apart AS (SELECT row, i, coalesce(i > lag(i) OVER (PARTITION BY row ORDER BY i) + {n}, true) AS opens FROM twice),
numbered AS (SELECT row, i, count_if(opens) OVER (PARTITION BY row ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM apart),
spans AS (SELECT row, min(i) AS a, max(i) + {n - 1} AS z FROM numbered GROUP BY row, span),
gaps AS (SELECT row, a, z, coalesce(lag(z) OVER (PARTITION BY row ORDER BY a), 0) + 1 AS since FROM spans),
cut AS (SELECT row, sum(z - a + 1) AS n_removed, count(*) AS n_spans, max(z) + 1 AS rest, string_agg({part('since', '(a - 1)')}, '' ORDER BY a) AS before
    FROM gaps JOIN docs USING (row) GROUP BY row),
texts AS (SELECT b, count(*) AS copies, min(row) AS id FROM docs WHERE octet_length(b) >= {cover.short} GROUP BY b),
samples AS (SELECT id, p, md5(b[p + 1:p + {cover.w}]) AS triple FROM (SELECT id, b, unnest(range(0, octet_length(b) - {cover.w} + 1)) AS p FROM texts) WHERE p % {cover.v} IN {tuple(cover.residues.tolist())}),
recurring AS (SELECT id, p FROM samples QUALIFY count(*) OVER (PARTITION BY triple) > 1),
noticed AS (SELECT id, sum(own) AS n FROM (SELECT id, least({cover.w}, coalesce(lead(p) OVER (PARTITION BY id ORDER BY p) - p, {cover.w})) AS own FROM recurring) GROUP BY id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    CASE WHEN n_spans IS NULL THEN sha256(b) ELSE sha256(unhex(before || {part('rest', 'octet_length(b)')})) END AS kept_sha256,
    CAST(CASE WHEN copies > 1 THEN octet_length(b) ELSE coalesce(noticed.n, 0) END AS BIGINT) AS n_repeated
FROM docs LEFT JOIN cut USING (row) LEFT JOIN texts USING (b) LEFT JOIN noticed USING (id)"""


def _oracle_urls() -> str:
    upper, lower, size = string.ascii_uppercase, string.ascii_lowercase, urls.SIZE
    fits = {r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')" for r in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))}
    chosen = lambda what: "CASE " + " ".join(f"WHEN {c} THEN '{what(r)}'" for r, c in fits.items()) + " END"
    number = lambda what: "CASE " + " ".join(f"WHEN {c} THEN {what(r)}" for r, c in fits.items()) + " ELSE 0 END"
    smooth = lambda low: f"CASE WHEN of_all > 0 THEN (n + kinds * {low}) / (of_all + kinds) ELSE {low} END"
    return f"""
WITH rests AS (SELECT row_number() OVER () AS row, page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT row, page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
ruled AS (SELECT *, {chosen(lambda r: r[1] + r[2])} AS rule, {chosen(lambda r: r[0])} AS ruling,
    CASE WHEN {number(lambda r: len(r[1]))} > 0 THEN host[1:length(host) - {number(lambda r: len(r[1]))}] ELSE regexp_replace(host, '[^.]*$', '') END || path[greatest(1, {number(lambda r: len(r[2]))}):] AS rest FROM parts),
folded AS (SELECT row, ruling, CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) % {urls.FOLDS} = 0 AS held,
    '^^' || regexp_replace(translate(rest, '{upper}{string.digits}', '{lower}{'0' * 10}'), '[^a-z0./_-]', '*', 'g') || '$' AS s FROM ruled WHERE host <> ''),
places AS (SELECT row, ruling, held, s, unnest(range(1, length(s) - 1)) AS i FROM folded),
symbols AS (SELECT row, ruling, held, instr('{urls.ALPHABET}', s[i]) - 1 AS a, instr('{urls.ALPHABET}', s[i + 1]) - 1 AS b, instr('{urls.ALPHABET}', s[i + 2]) - 1 AS c FROM places),
seen AS (SELECT ruling = 'allow' AS yes, a, b, c, count(*) AS n FROM symbols WHERE ruling IS NOT NULL AND NOT held GROUP BY ALL),
letters AS (SELECT unnest(range({size})) AS x),
grid AS (SELECT yes, a.x AS a, b.x AS b, c.x AS c FROM (VALUES (true), (false)) AS t(yes), letters AS a, letters AS b, letters AS c),
three AS (SELECT grid.*, CAST(coalesce(n, 0) AS DOUBLE) AS n FROM grid LEFT JOIN seen USING (yes, a, b, c)),
one AS (SELECT yes, c, (sum(n) + 1) / (sum(sum(n)) OVER (PARTITION BY yes) + {size}) AS p1 FROM three GROUP BY yes, c),
pairs AS (SELECT yes, b, c, sum(n) AS n FROM three GROUP BY yes, b, c),
pairs_of AS (SELECT *, sum(n) OVER (PARTITION BY yes, b) AS of_all, count_if(n > 0) OVER (PARTITION BY yes, b) AS kinds FROM pairs),
two AS (SELECT yes, b, c, {smooth('p1')} AS p2 FROM pairs_of JOIN one USING (yes, c)),
three_of AS (SELECT *, sum(n) OVER (PARTITION BY yes, a, b) AS of_all, count_if(n > 0) OVER (PARTITION BY yes, a, b) AS kinds FROM three),
whole AS (SELECT yes, a, b, c, {smooth('p2')} AS p3 FROM three_of JOIN two USING (yes, b, c)),
ratios AS (SELECT a, b, c, round(sum(CASE WHEN yes THEN ln(p3) ELSE -ln(p3) END), 5) AS r FROM whole GROUP BY a, b, c),
scores AS (SELECT row, any_value(ruling) AS ruling, any_value(held) AS held, round(sum(r) / count(*), 9) AS score FROM symbols JOIN ratios USING (a, b, c) GROUP BY row),
cuts AS (SELECT CASE WHEN bool_or(ruling = 'allow') AND bool_or(ruling = 'block') THEN quantile_disc(score, {urls.FALSE_REJECTION}) FILTER (ruling = 'allow' AND held) END AS cut FROM scores)
SELECT page_id, host, path, rule, coalesce(ruled.ruling, CASE WHEN score < cut THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN scores USING (row) CROSS JOIN cuts"""


def _oracle_chat() -> str:
    escaped = "{}"
    for plain, entity in chat.ENTITIES:
        escaped = f"replace({escaped}, '{plain}', '{entity}')"
    size = f"length({escaped.format('role')}) + length({escaped.format('text')}) + {len(chat.OPEN + chat.NAMED + chat.CLOSE)}"
    return f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'),
numbered AS (
    SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, sum({size}) OVER w AS upto
    FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, CAST(max(n) AS BIGINT) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '')) AS loss_sha256,
    CAST(sum(CASE WHEN role = 'assistant' OR i = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM numbered GROUP BY conv_id"""


def _oracle_quality() -> str:
    letters = r"[\x20\x09-\x0D]+"
    rules = list(quality.RULES)
    names = {"symbol_ratio": ("n_symbols", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"), "mean_word_chars": ("word_chars", "n_words")}
    ratios = ", ".join(f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0 END AS {k}" for k, (a, b) in names.items())
    grid = ", ".join(f"({i}, {', '.join(f'CAST({quality.RULES[k][i]} AS DOUBLE)' for k in rules)})" for i in range(quality.LEVELS))
    rate = quality.RISK
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(lang, '{quality.OTHER}') AS lang, coalesce(text, '') AS text FROM documents),
parts AS (SELECT *, list_filter(regexp_split_to_array(text, '{letters}'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '{letters}', '', 'g')) > 0) AS l FROM docs),
places AS (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM parts WHERE len(w) >= 3),
windows AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM places),
twice AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, win) > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY row),
measured AS (SELECT parts.row, doc_id, lang, len(w) AS n_words, length(regexp_replace(text, '{letters}', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words FROM parts LEFT JOIN covered USING (row)),
figures AS (SELECT *, {ratios} FROM measured),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(coalesce(quality, 0)) = 1),
held AS (SELECT doc_id, min(lang) AS lang, {', '.join(f'max({k}) AS {k}' for k in rules)} FROM figures SEMI JOIN good USING (doc_id) GROUP BY doc_id),
strata AS (SELECT lang AS old, CASE WHEN row_number() OVER (ORDER BY count(*) DESC, lang) < {quality.STRATA} THEN lang ELSE '{quality.OTHER}' END AS lang FROM held GROUP BY lang),
folded AS (SELECT held.* REPLACE (strata.lang AS lang) FROM held JOIN strata ON held.lang = strata.old),
sized AS (SELECT lang, count(*) AS n, (SELECT count(DISTINCT lang) FROM folded) AS m FROM folded GROUP BY lang),
grid AS (SELECT * FROM (VALUES {grid}) AS t(i, {', '.join(f'max_{k}' for k in rules)})),
tried AS (SELECT lang, i, CAST(count_if({' OR '.join(f'{k} > max_{k}' for k in rules)}) AS BIGINT) AS k FROM folded, grid GROUP BY lang, i),
tested AS (SELECT tried.*, CASE WHEN k > n * {rate!r} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j:
        exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({rate!r}) + (n - j) * ln(1 - {rate!r})))) END <= {quality.ERROR!r} / m AS passed
    FROM tried JOIN sized USING (lang)),
certified AS (SELECT lang, max(i) AS i FROM (SELECT *, bool_and(passed) OVER (PARTITION BY lang ORDER BY i) AS so_far FROM tested) WHERE so_far GROUP BY lang),
limits AS (SELECT * FROM sized LEFT JOIN certified USING (lang) LEFT JOIN grid USING (i)),
judged AS (SELECT figures.*, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed,
    {' OR '.join(f'coalesce({k} > max_{k}, false)' for k in rules)} AS failed
    FROM figures LEFT JOIN limits ON limits.lang = CASE WHEN figures.lang IN (SELECT lang FROM limits) THEN figures.lang ELSE '{quality.OTHER}' END)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT failed AS kept
FROM judged"""


def _oracle_decontamination() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    n = decontaminate.WINDOW
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {words('text')} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {words('text')} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, array_to_string(w[i:i + least(len(w), {n}) - 1], ' ') AS win, least(len(w), {n}) AS size
    FROM (SELECT *, unnest(range(1, greatest(len(w) - {n}, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
spots AS (SELECT row, i, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM places, sizes WHERE i + size - 1 <= len(w)),
found AS (SELECT row, i, spots.size, item FROM spots JOIN windows USING (size, win)),
hit AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS p FROM found) GROUP BY row),
named AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT row, item FROM found) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (row) LEFT JOIN named USING (row)"""


def _oracle_importance() -> str:
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    n = importance.BUCKETS
    words = "regexp_extract_all(translate(coalesce(text, ''), '{}', '{}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(upper, lower)
    # CRC-32 by its table, which eight shifts make from the reflected polynomial
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = "CAST('0x' || hex(encode(word))[2 * i - 1:2 * i] AS BIGINT)"
    return f"""
WITH RECURSIVE shifted AS (SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, {step}, k + 1 FROM shifted WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM shifted WHERE k = 8),
docs AS (SELECT row_number() OVER () AS row, doc_id, {words} AS w FROM documents),
goal AS (SELECT {words} AS w FROM benchmark),
said AS (SELECT word, count(*) AS s FROM (SELECT unnest(w) AS word FROM docs) GROUP BY word),
aimed AS (SELECT word, count(*) AS t FROM (SELECT unnest(w) AS word FROM goal) GROUP BY word),
vocabulary AS (SELECT word FROM said UNION SELECT word FROM aimed),
hashed AS (SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, octet_length(encode(word)) + 1), lambda i: {byte})),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {n} AS bucket FROM vocabulary, tab),
met AS (SELECT bucket, CAST(coalesce(sum(s), 0) AS DOUBLE) AS s, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t FROM hashed LEFT JOIN said USING (word) LEFT JOIN aimed USING (word) GROUP BY bucket),
whole AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM met),
gains AS (SELECT word, CAST(floor(1000 * ln((t + 1) * (all_s + {n}) / ((s + 1) * (all_t + {n})))) AS BIGINT) AS gain FROM hashed JOIN met USING (bucket), whole),
paths AS (SELECT row, unnest(w) AS word FROM docs),
weights AS (SELECT row, CAST(count(*) AS BIGINT) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM paths JOIN gains USING (word) GROUP BY row),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{importance.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM docs LEFT JOIN weights USING (row)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {importance.MIN_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place,
    count(*) OVER (PARTITION BY n_features >= {importance.MIN_WORDS}) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {importance.MIN_WORDS} AND place <= {importance.PERCENT} * n // 100 THEN place END AS rank FROM placed"""


def _oracle_audit() -> str:
    letters = r"[\x20\x09-\x0D]+"
    steps = ", ".join(f"('{''.join(p)}', {s + 1}, {1 << audit.FILTERS.index(p[s])}, {sum(1 << audit.FILTERS.index(f) for f in p[:s])})" for p in permutations(audit.FILTERS) for s in range(len(audit.FILTERS)))
    return f"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, list_filter(regexp_split_to_array(text, '{letters}'), lambda x: x <> '') AS w FROM docs),
said AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
judged AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < {audit.MIN_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < {audit.MIN_DISTINCT} * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {audit.MAX_CAPITALS} * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) THEN 16 ELSE 0 END AS mask
    FROM words LEFT JOIN said USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM judged GROUP BY part, mask),
steps AS (SELECT * FROM (VALUES {steps}) AS t(filter_order, step, own, before)),
shares AS (SELECT mask, own, count(*) AS orders FROM (SELECT mask, filter_order, arg_min(own, step) AS own FROM (SELECT DISTINCT mask FROM cells), steps WHERE mask & own <> 0 GROUP BY mask, filter_order) GROUP BY mask, own)
SELECT part, filter_order, step,
    CAST(sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
    CAST(sum(n * coalesce(orders, 0)) AS BIGINT) AS shapley
FROM cells CROSS JOIN steps LEFT JOIN shares USING (mask, own) GROUP BY part, filter_order, step"""


ORACLE_SQL = {
    "op1_suffix_array_dedup": _oracle_repeats(),
    "op5_url_filters": _oracle_urls(),
    "op8_chat_formatting": _oracle_chat(),
    "op9_quality_rules": _oracle_quality(),
    "op10_benchmark_decontamination": _oracle_decontamination(),
    "op11_importance_resampling": _oracle_importance(),
    "op13_filter_audit": _oracle_audit(),
}
