"""Language identification by compression.

Every language has a zstandard raw-content dictionary made of some of its texts; a text belongs to the language whose
dictionary compresses it to the fewest bytes, and is rejected where the second best is almost as good. Texts and
dictionaries are compared in lower case, with everything between words made one space.

Whole texts are used, in blocks, as long as they are. A null text, an empty one and one without a letter are "und" with
score 0; equal sizes go to the language with more training texts, then to the one that sorts first. Repeated rows are judged each for itself, an empty table gives
an empty table, columns that clash with the added ones are replaced. Without any training text everything is "und".
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm._common import append_columns

#: Training documents per language at most, bytes of dictionary per language, and of all dictionaries together: with very
#: many languages each has a smaller one.
TRAIN_DOCS, DICT_BYTES, ALL_BYTES = 256, 512 << 10, 64 << 20
#: Texts are compressed in blocks of this many bytes, so that a long text is always judged by the dictionaries.
BLOCK = 4096
#: Reject when the winner saves less than this share of the runner-up's size.
MIN_MARGIN = 0.004
LEVEL = 6
_LETTER = regex.compile(r"\p{L}")
_BETWEEN = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    return _BETWEEN.sub(" ", text.lower()).encode()


def shares(sizes: list[int], whole: int) -> list[int]:
    """How much of each text to take, whole together at most: equal shares, and long texts take what short ones leave."""
    share = max(1, whole // max(1, len(sizes)))
    spare = max(0, whole - sum(min(n, share) for n in sizes))
    out = []
    for n in sizes:
        out.append(min(n, share + spare))
        spare -= max(0, out[-1] - share)
    return out


def sample(labelled: DataFrame, text: str = "text", lang: str = "lang", docs: int = TRAIN_DOCS, size: int = DICT_BYTES) -> tuple[dict[str, int], DataFrame | None]:
    """A bounded sample: the size of dictionary of every language, in order of their number of training texts, and the rows (lang,
    text) to make them of. Each language's texts are those of least hash; of a text no more is read than its share, so that
    all rows together have at most ALL_BYTES characters."""
    rows = labelled.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    limits = lambda names: (n := max(1, min(size, ALL_BYTES // max(1, names))), min(docs, max(1, n // 1024)))
    # Nothing is written on the way: an executor starts three processes a file (chmod), which count its memory twice for a moment.
    counts = labelled.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).toArrow().to_pylist()
    # Of n hashes four times as many as are wanted lie below a share of their range; a language with too many copies is tried again.
    tried = {r["lang"]: min(1.0, 4 * limits(len(counts))[1] / r["n"]) for r in counts}
    short = list(tried)
    while short:
        below = pa.table([pa.array(tried, pa.string()), pa.array([min((1 << 63) - 1, int(t * (1 << 64)) - (1 << 63)) for t in tried.values()], pa.int64())], ["lang", "most"])
        hashes = rows.select("lang", "h", F.length("text").alias("chars")).join(labelled.sparkSession.createDataFrame(below), "lang")
        near = hashes.groupBy("lang", F.when(F.col("h") <= F.col("most"), F.col("h")).alias("h")).agg(F.count("*").alias("n"), F.max("chars").alias("chars")).toArrow().to_pylist()
        total: Counter[str] = Counter()
        least: dict[str, list[tuple[int, int]]] = {}
        for r in near:
            total[r["lang"]] += r["n"]
            if r["h"] is not None:
                least.setdefault(r["lang"], []).append((r["h"], r["chars"]))
        share, most = limits(len(total))
        short = [name for name in total if len(least.get(name, ())) < most and tried[name] < 1]
        tried |= {name: min(1.0, 8 * tried[name]) for name in short}
    names = sorted(total, key=lambda name: (-total[name], name)) if counts else []
    if not names:
        return {}, None
    size, of_lang = share, {name: sorted(least[name])[:most] for name in names}
    takes = [(name, h, n) for name, own in of_lang.items() for (h, _), n in zip(own, shares([c for _, c in own], size), strict=True)]
    wanted = pa.table([pa.array(c, kind) for c, kind in zip(zip(*takes, strict=True), (pa.string(), pa.int64(), pa.int32()), strict=True)], ["lang", "h", "take"])
    chosen = rows.join(labelled.sparkSession.createDataFrame(wanted), ["lang", "h"])
    return dict.fromkeys(names, size), chosen.select("lang", F.substring("text", F.lit(1), F.col("take")).alias("text")).distinct()


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", docs: int = TRAIN_DOCS, size: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionaries by language, of a bounded sample."""
    sizes, rows = sample(labelled, text, lang, docs, size)
    found: dict[str, set[str]] = {}
    for r in rows.collect() if sizes else ():
        found.setdefault(r["lang"], set()).add(r["text"])
    return {name: b"\n".join(map(plain, sorted(found[name])))[-n:] for name, n in sizes.items()}


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)
        self.each = []
        for n in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[n], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            c = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            self.each.append(c.compress)

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (share of bytes saved against the runner-up) and whether it is rejected."""
        if not text or not self.names or not _LETTER.search(text):
            return "und", 0.0, True
        raw = plain(text)
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = [sum(len(c(b)) for b in blocks) for c in self.each]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for i, s in enumerate(sizes) if i != best), default=len(raw) + 1)
        score = min(1.0, max(0.0, (second - sizes[best]) / second))
        return self.names[best], score, score < MIN_MARGIN


def identify(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add lang_pred, score (0 to 1) and rejected (no letter, or a margin below MIN_MARGIN)."""

    def make():
        judge = Compressors(dictionaries)
        return lambda texts: list(zip(*map(judge, texts), strict=True)) if texts else [[], [], []]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return append_columns(df, text, fields, make, () if keep_text else (text,))
