"""Token counts by rank-synchronous array merging, and the ids of the same pieces.

A text is cut into pre-tokens; the distinct pre-tokens of a slice of rows that were not met before are held as one
ragged numpy array of symbols. In every round each pre-token's lowest-ranked pair is merged, at all its places and in
all pre-tokens at once; a pre-token without a known pair is done and its surviving symbols are counted. Pre-tokens that
outlast ROUNDS rounds (unbroken strings of many different pairs) go on in the same order with their places queued by rank,
so that a round touches the places of one rank and their neighbours alone.

Null texts count as empty, empty texts have no tokens, repeated rows are counted each for itself, an empty table gives
an empty table, and columns that clash with the added ones are replaced.
"""

from __future__ import annotations

import heapq
import json
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sightline.llm._common import append_columns

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose result a task keeps; beyond it the memory starts afresh.
KEPT = 400_000
#: Rounds over the whole array of a batch.
ROUNDS = 48
_NONE = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Splitter:
    """Cuts texts at added special strings, which count as one token each by default, and into pre-tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        if self.spec["model"]["type"] != "BPE" or self.spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE vocabulary in JSON is needed")
        self.added = {x["content"]: x["id"] for x in self.spec["added_tokens"]}
        self.find = regex.compile(PRE_TOKEN).findall
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest_first))) if self.added else None

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """Non-empty parts of a text, and whether each is a special string."""
        out: list[tuple[str, bool]] = []
        at = 0
        for m in self.special.finditer(text):
            out += [(text[at : m.start()], False), (m.group(), True)]
            at = m.end()
        return [x for x in (*out, (text[at:], False)) if x[0]]

    def pieces(self, text: str | None) -> list[str]:
        if not text:
            return []
        if not any(s in text for s in self.added):
            return self.find(text)
        return [p for t, special in self.segments(text) for p in ([t] if special else self.find(t))]


class RankMerger:
    """Counts what byte-pair merging leaves of many sequences at once."""

    def __init__(self, spec: dict):
        vocab = spec["model"]["vocab"]
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], np.int64)
        rows = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            rows.append((vocab[a] << 32 | vocab[b], rank, vocab[a + b]))
        table = np.array(sorted(rows), np.int64)
        self.pair, self.rank, self.made = (np.ascontiguousarray(table[:, i]) for i in range(3))

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols that survive in each (non-empty) word."""
        out = np.zeros(len(words), np.int64)
        if not words:
            return out
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        seq = np.repeat(np.arange(len(words)), sizes)
        for _ in range(ROUNDS):
            if not len(sym):
                return out
            begins = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            rank = np.full(len(sym), _NONE)
            key = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            known = (self.pair[at] == key) & (seq[:-1] == seq[1:])
            rank[:-1][known] = self.rank[at[known]]
            lowest = np.minimum.reduceat(rank, begins)
            sizes = np.diff(np.r_[begins, len(sym)])
            done = lowest == _NONE
            out[seq[begins[done]]] = sizes[done]
            each = np.repeat(lowest, sizes)
            merge = (rank == each) & (rank < _NONE)
            # a run of the same symbol has overlapping pairs: every second one counts, from the left
            first = merge & ~np.r_[False, merge[:-1]]
            place = np.arange(len(sym))
            merge &= (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0
            where = np.flatnonzero(merge)
            sym[where] = self.made[at[where]]
            stay = each < _NONE
            stay[where + 1] = False
            sym, seq = sym[stay], seq[stay]
        return self._queued(sym, seq, out)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (_NONE if unknown) and product of each pair of symbols."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], _NONE), self.made[at]

    def _queued(self, sym: np.ndarray, seq: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Go on with what is left. A rule ranks after the rules that make its parts, so that ranks only ascend, and all
        sequences can take their turns by one queue."""
        n = len(sym)
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        sym, alive = np.r_[sym, 0], np.ones(n, bool)
        seq = np.r_[seq, -1]
        queue: list[int] = []
        places: dict[int, list[np.ndarray]] = {}

        def offer(at: np.ndarray) -> None:
            to = following[at]
            rank, _ = self._ranks(sym[at], sym[to])
            good = (rank < _NONE) & (seq[at] == seq[to])
            at, rank = at[good], rank[good]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else []
            for a, b in zip(cuts, [*cuts[1:], len(rank)], strict=True) if len(rank) else ():
                r = int(rank[a])
                if r not in places:
                    places[r] = []
                    heapq.heappush(queue, r)
                places[r].append(at[a:b])

        offer(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at]]
            rank, made = self._ranks(sym[at], sym[following[at]])
            good = (rank == r) & (seq[at] == seq[following[at]])
            at, made = at[good], made[good]
            if not len(at):
                continue
            # a run of the same symbol has overlapping pairs: every second one counts, from the left
            first = np.r_[True, following[at[:-1]] != at[1:]]
            place = np.arange(len(at))
            take = (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0
            at, made = at[take], made[take]
            gone = following[at]
            sym[at], alive[gone] = made, False
            following[at] = following[gone]
            inside = following[at] < n
            before[following[at][inside]] = at[inside]
            left = before[at]
            offer(np.unique(np.r_[at, left[left >= 0]]))
        np.add.at(out, seq[:n][alive], 1)
        return out


class TokenCounter:
    """Token counts of texts; pre-tokens met before are looked up."""

    def __init__(self, path: str):
        self.split = Splitter(path)
        self.merge = RankMerger(self.split.spec)
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str | None]) -> list[int]:
        pieces = [self.split.pieces(t) for t in texts]
        new = [p for p in set(chain.from_iterable(pieces)) if p not in self.known]
        if len(self.known) + len(new) > KEPT:
            self.known = {}
            new = list(set(chain.from_iterable(pieces)))
        plain = [p for p in new if p not in self.split.added]
        plain.sort(key=len)  # words of like length finish in like rounds
        for i in range(0, len(plain), 50_000):
            part = plain[i : i + 50_000]
            self.known.update(zip(part, self.merge.counts([p.encode() for p in part]).tolist(), strict=True))
        self.known.update((p, 1) for p in new if p in self.split.added)
        get = self.known.__getitem__
        return [sum(map(get, p)) for p in pieces]


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", limit: int = 512, keep_text: bool = True) -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit); tokenizer is the path of the vocabulary."""

    def make():
        count = TokenCounter(tokenizer)

        def work(texts):
            n = count(texts)
            return [[len((t or "").encode()) for t in texts], n, [x > limit for x in n]]

        return work

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return append_columns(df, text, fields, make, () if keep_text else (text,))
