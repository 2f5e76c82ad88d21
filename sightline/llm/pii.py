"""Personal data with a skip-chain conditional random field.

Patterns with checks give the base spans. The nodes of the field are the base spans, each whole and with its label; the
document's mentions of their values, which are open: words equal to an address's local part (letters and digits compared,
5 at least, or else the whole word, which must not be letters alone), and numbers over adjacent groups of digits that equal
a card's digits or the last 7 or more of a phone's, with or without leading zeros; and the other tokens with a digit or an
"@", which have no label in a match that failed its check and else are open. Neighbouring nodes are joined by chain edges,
and nodes that are equal or alike by skip edges however far apart, each occurrence to the next. Loopy message passing over all edges of a slice of
documents carries a document's certain entities to its other mentions; those become added spans.

Unary weights are a softmax over shape features and edge weights are smoothed log ratios of label pairs, both learned
from the base labels of a bounded sample of documents (TRAIN_DOCS). Mentions have no label to learn from, nor have skip
edges to open nodes; other open tokens count as none.

A null text is empty; whole texts are searched, however long; spans of several kinds may overlap and are all returned;
repeated rows are judged each for itself; an empty table gives an empty one (an untrained field adds nothing); columns
that clash with the added ones are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm._common import append_columns

KINDS = ("email", "ip", "card", "phone")
#: Documents that the weights are learned from, at most, and characters of each.
TRAIN_DOCS, TRAIN_CHARS = 2000, 8000
ROUNDS, DAMPING, SURE = 10, 0.5, 0.9

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can't begin inside a stretch of digits, as the whole stretch would fail or be taken alike
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HIT = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
_DIGITS = re.compile(r"[^0-9]+")
_PLAIN = re.compile(r"[^0-9a-z]+")
_WORD = re.compile(r"[A-Za-z0-9._%+-]+")
_GROUP = re.compile(r"[0-9]+")
_GAP = re.compile(r"[\x20().-]{1,3}")
#: Digits that a mention of a phone number shares with it, at least, and that a mention may have, at most.
LEAST_SHARED, MOST_DIGITS = 7, 21


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches of a local part, "@" and a domain with a dot, found from each "@"."""
    done = 0
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            begin = at
            while begin > done and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < at:
                yield begin, m.end()
                done = m.end()
                at = text.find("@", done)
                continue
        at = text.find("@", at + 1)


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(begin, kind, end) of every match that passes its check, sorted, and (begin, end) of those that fail."""
    found, failed = [(a, 0, b) for a, b in _emails(text)], []
    if _HIT.search(text):
        for m in _IP.finditer(text):
            good = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))
            found.append((m.start(), 1, m.end())) if good else failed.append(m.span())
        for m in _CARD.finditer(text):
            d = _DIGITS.sub("", m.group())
            if len(d) >= 14:
                good = len(d) <= 19 and luhn(d)
                found.append((m.start(), 2, m.end())) if good else failed.append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                good = 10 <= len(_DIGITS.sub("", m.group())) <= 15
                found.append((m.start(), 3, m.end())) if good else failed.append(m.span())
    return sorted(found), failed


def tokens(text: str) -> list[tuple[int, int]]:
    """Tokens with a digit or "@", without the punctuation around them."""
    out, at = [], 0
    while m := _HIT.search(text, at):
        a = m.start()
        while a > at and not text[a - 1].isspace():
            a -= 1
        end = _SPACE.search(text, m.start())
        at = b = end.start() if end else len(text)
        while not (text[a].isalnum() or text[a] in "@+"):
            a += 1
        while not (text[b - 1].isalnum() or text[b - 1] == "@"):
            b -= 1
        out.append((a, b))
    return out


def form(token: str) -> str | None:
    """What alike tokens have in common: their digits if those are many, else letters and digits of the local part."""
    digits = _DIGITS.sub("", token)
    if len(digits) >= 6 and "@" not in token:
        return digits
    plain = _PLAIN.sub("", token.partition("@")[0].lower())
    return plain if len(plain) >= 5 else None


def _name(local: str) -> str | None:
    """What an address and the mentions of its local part have in common."""
    plain = _PLAIN.sub("", local)
    if len(plain) >= 5:
        return plain
    return "." + local if local and not local.isalpha() else None


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(begin, end, key) of what equals a value of a base span; may overlap base spans."""
    names, numbers, out = set(), {}, []
    for a, k, b in base:
        if k == 0:
            names.add(_name(text[a:b].partition("@")[0].lower().strip("._%+-")))
        elif k > 1:
            d = _DIGITS.sub("", text[a:b])
            numbers[d] = d
            for n in range(LEAST_SHARED, len(d)) if k == 3 else ():
                numbers.setdefault(d[-n:], d)
    names.discard(None)
    free = lambda i: not (0 <= i < len(text) and text[i].isalnum())
    for m in _WORD.finditer(text) if names else ():
        word = m.group().lower()
        core = word.strip("._%+-")
        key = _name(core)
        if key in names and free(m.start() - 1) and free(m.end()) and text[m.end() : m.end() + 1] != "@":
            a = m.start() + word.index(core)
            out.append((a, a + len(core), key))
    groups = [m.span() for m in _GROUP.finditer(text)] if numbers else []
    tight = lambda i, j: 0 <= i < len(text) and 0 <= j < len(text) and text[i] in ".-" and text[j] in "0123456789"
    for i, (_, end) in enumerate(groups):
        if not free(end) or tight(end, end + 1):
            continue
        digits, best = "", None
        for j in range(i, -1, -1):
            a, b = groups[j]
            if len(digits) + b - a > MOST_DIGITS or j < i and not _GAP.fullmatch(text, b, groups[j + 1][0]):
                break
            digits = text[a:b] + digits
            plain = digits.lstrip("0")
            whole = numbers.get(digits) or (numbers.get(plain) if len(plain) >= LEAST_SHARED else None)
            if whole and free(a - 1) and not tight(a - 1, a - 2):
                before = text[a - 1 : a]
                best = a - (before == "+" or before == "(" and ")" in text[a:end]), end, whole
        if best:
            out.append(best)
    return out


def _bucket(n: int, limits: tuple[int, ...]) -> int:
    return sum(n >= x for x in limits)


N_FEATURES = 29


def features(text: str, a: int, b: int) -> np.ndarray:
    t = text[a:b]
    x = np.zeros(N_FEATURES)
    n_digits = sum(map(t.count, "0123456789"))
    x[0] = 1
    x[1 + _bucket(n_digits, (1, 4, 7, 10, 14, 20))] = 1
    x[8 + _bucket(t.count("."), (1, 2, 3, 4))] = 1
    x[13 + _bucket(b - a, (5, 9, 17, 33))] = 1
    x[18 + _bucket(t.count("-"), (1, 2, 4))] = 1
    x[22:29] = ["@" in t, "@" in t and "." in t.partition("@")[2], t[0] == "+", "(" in t or ")" in t, n_digits == b - a, any(map(str.isalpha, t)), text[max(0, a - 1) : a] in ("-", "(", "+")]
    return x


class Graph:
    """The fields of many documents as arrays; label 0 is none, -1 is open."""

    def __init__(self, texts: list[str]):
        self.base: list[list[tuple[int, int, int]]] = []
        self.nodes: list[tuple[int, int, int]] = []
        rows, label, edges, equal = [], [], [], []
        for d, text in enumerate(texts):
            base, failed = base_spans(text) if text else ([], [])
            self.base.append(base)
            last: dict[str, int] = {}
            failed.sort()
            end_before, j = -9, 0
            for a, b, cover, keys, value in self._spans(text, base):
                k = len(self.nodes)
                while j < len(failed) and failed[j][1] <= a:
                    j += 1
                if cover is None and not value and j < len(failed) and failed[j][0] < b:
                    cover = 0
                label.append(-1 if cover is None else cover)
                equal.append(value)
                rows.append(features(text, a, b))
                self.nodes.append((d, a, b))
                if a - end_before <= 3:
                    edges.append((k - 1, k, 0))
                end_before = b
                edges.extend((i, k, 1) for i in {last[f] for f in keys if f in last})
                last.update(dict.fromkeys(keys, k))
        self.x = np.array(rows).reshape(-1, N_FEATURES)
        self.label = np.array(label, np.int64)
        self.equal = np.array(equal, bool)
        self.edges = np.array(edges, np.int64).reshape(-1, 3)

    @staticmethod
    def _spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int | None, set[str], bool]]:
        """(begin, end, label, keys of alike nodes, whether by its value) of disjoint nodes: base spans, of overlapping ones
        the first; mentions, of overlapping ones the longest; and tokens."""
        out: list[tuple[int, int, int | None, set[str], bool]] = []
        for a, k, b in base:
            if not out or a >= out[-1][1]:
                t = text[a:b]
                keys = {_name(t.partition("@")[0].lower().strip("._%+-"))} if k == 0 else {_DIGITS.sub("", t)} if k > 1 else {form(t)}
                out.append((a, b, k + 1, keys - {None}, False))
        taken = [(a, b) for a, _, b in base]

        def add(spans):
            """Those that overlap none of the taken spans, nor an earlier one of theirs."""
            begins, ends, most = [a for a, _ in taken], [], 0
            for _, b in taken:
                ends.append(most := max(most, b))
            end = 0
            for s in spans:
                i = bisect_right(begins, s[1] - 1)
                if s[0] >= end and (not i or ends[i - 1] <= s[0]):
                    out.append(s)
                    end = s[1]

        add(sorted(((a, b, None, {key}, True) for a, b, key in mentions(text, base)), key=lambda s: (s[0], -s[1])))
        taken = sorted(taken + [s[:2] for s in out])
        add([(a, b, None, {form(text[a:b])} - {None}, False) for a, b in tokens(text)])
        return sorted(out, key=lambda s: s[:2])


class Field:
    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    @classmethod
    def learn(cls, texts: list[str], steps: int = 300, rate: float = 1.0, decay: float = 1e-3) -> Field | None:
        """Piecewise training on the base labels of texts that have any; an open token counts as none."""
        g = Graph([t for t in texts if base_spans(t)[0]])
        if not len(g.label):
            return None
        y, size = np.maximum(g.label, 0), len(KINDS) + 1
        used = np.flatnonzero(~g.equal)
        x, target = g.x[used], np.eye(size)[y[used]]
        w = np.zeros((N_FEATURES, size))
        for _ in range(steps):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            w -= rate * (x.T @ (p - target) / len(x) + decay * w)
        share = (np.bincount(y[used], minlength=size) + 1.0) / (len(x) + size)
        pair = np.zeros((2, size, size))
        for kind in (0, 1):
            e = g.edges[g.edges[:, 2] == kind]
            e = e[(g.label[e[:, :2]] >= 0).all(1)] if kind else e[~g.equal[e[:, :2]].any(1)]
            seen = np.zeros((size, size))
            np.add.at(seen, (y[e[:, 0]], y[e[:, 1]]), 1)
            # smoothed by independence for the chain, by agreement for alike tokens
            seen = seen + seen.T + 10 * (np.outer(share, share) if kind == 0 else 0.9 * np.diag(share) + 0.1 * np.outer(share, share))
            joint = seen / seen.sum()
            pair[kind] = np.log(joint / np.outer(joint.sum(1), joint.sum(0)))
        return cls(w, pair)

    def marginals(self, g: Graph) -> np.ndarray:
        """Loopy sum-product over chain and skip edges."""
        u = g.x @ self.unary
        known = g.label >= 0
        u[known] = np.where(np.eye(u.shape[1])[g.label[known]] > 0, 0.0, -50.0)
        e = g.edges
        src, dst = np.r_[e[:, 0], e[:, 1]], np.r_[e[:, 1], e[:, 0]]
        back = np.r_[np.arange(len(e)) + len(e), np.arange(len(e))]
        w = np.concatenate([self.pair[e[:, 2]], self.pair[e[:, 2]].transpose(0, 2, 1)]) if len(e) else np.zeros((0, u.shape[1], u.shape[1]))
        msg = np.zeros((len(src), u.shape[1]))
        for _ in range(ROUNDS if len(e) else 0):
            belief = u.copy()
            np.add.at(belief, dst, msg)
            z = (belief[src] - msg[back])[:, :, None] + w
            top = z.max(1)
            new = top + np.log(np.exp(z - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            msg = DAMPING * msg + (1 - DAMPING) * new
        np.add.at(u, dst, msg)
        p = np.exp(u - u.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def added(self, g: Graph) -> list[list[tuple[int, int, int]]]:
        out: list[list[tuple[int, int, int]]] = [[] for _ in g.base]
        if not len(g.label):
            return out
        p = self.marginals(g)
        alike = np.zeros(len(g.label), bool)
        skip = g.edges[g.edges[:, 2] == 1]
        alike[skip[:, :2].ravel()] = True
        best = p.argmax(1)
        for k in np.flatnonzero((g.label < 0) & alike & (best > 0) & (p.max(1) >= SURE)).tolist():
            d, a, b = g.nodes[k]
            out[d].append((a, int(best[k]) - 1, b))
        return out


def train(df: DataFrame, text: str = "text", docs: int = TRAIN_DOCS) -> Field | None:
    """Learn from the docs texts of least hash among those that may hold personal data, TRAIN_CHARS characters of each from a
    tenth of them before the first place that may."""
    rows = df.select(F.col(text).alias("text")).where(F.col("text").rlike("[0-9]{3}|@"))
    bound = rows.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(docs).agg(F.max("h")).first()[0]
    if bound is None:
        return None
    first = F.regexp_instr("text", F.lit("[0-9]{3}|@"))
    around = F.substring("text", F.greatest(F.lit(1), first - TRAIN_CHARS // 10), F.lit(TRAIN_CHARS)).alias("text")
    return Field.learn([r["text"] for r in rows.where(F.xxhash64("text") <= bound).select(around).distinct().collect()])


def find(df: DataFrame, field: Field | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add base_spans and spans (base and added): array<struct<kind,begin,end>> in code points, sorted by begin, then
    kind in the order of KINDS."""
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))

    def make():
        def work(texts):
            g = Graph([t or "" for t in texts])
            more = field.added(g) if field else [[] for _ in texts]
            show = lambda spans: [{"kind": KINDS[k], "begin": a, "end": b} for a, k, b in spans]
            return [[show(b) for b in g.base], [show(sorted(b + m)) for b, m in zip(g.base, more, strict=True)]]

        return work

    return append_columns(df, text, [T.StructField("base_spans", span), T.StructField("spans", span)], make, () if keep_text else (text,))


def mask(text, spans):
    """Column expression: text with each span (of overlapping ones, their union) replaced by its kind in angle brackets."""
    step = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.when(s["begin"] < acc["at"], acc["out"])
            .otherwise(F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), (s["begin"] - acc["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">")))
            .alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"))),
    )
    return F.when(F.size(spans) > 0, step).otherwise(text)
