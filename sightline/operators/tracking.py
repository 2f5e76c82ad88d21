"""Tracks of detections over time: confirmation, suppression and expiry, with a verifier's answers fed back.

Tracks of one device, filter and category never meet others, so that is the key; what they share is the device's clock: after
each message of the device, whatever it holds, tracks that are out of date go. Such a clean-up is the same whether it is done
after each message or once, as of the last message before the next row of the key, so that every row carries the time of the
device's message before its own (`previous_times`), and the machine first expires as of then. All rows of one device and time
are one message. Time is event time: every "now" is the row's ts. The machine holds live tracks alone. Batch and stream share
it.
"""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.asof import as_of
from sightline.operators.fold import fold
from sightline.vocab import PERSON, TRACK_COSINE, TRACK_IOU

KEYS = ["device_id", "filter_id", "category_id"]
OUT = "device_id long, filter_id string, category_id int, track_id string, event_ts double, first_seen double, best_det_id long, best_score double, hits int, vlm_required boolean"
WATCHING, VERIFYING, SUPPRESSED = "watching", "verifying", "suppressed"


@dataclass(frozen=True)
class Rules:
    """Times in seconds."""

    hits: int = 3
    window: float = 10.0
    cooldown: float = 120.0
    ttl: float = 300.0
    iou: float = TRACK_IOU
    cosine: float = TRACK_COSINE
    attempts: int = 3


def iou(a, b) -> float:
    inner = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    whole = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inner
    return inner / whole if whole > 0 else 0.0


def colors_meet(a, b) -> bool:
    """Whether two sets of colours share one; nothing is known where one is empty."""
    return a is None or b is None or not len(a) or not len(b) or bool(set(a) & set(b))


def cosine(a: int, b: int) -> float:
    n = a.bit_count() * b.bit_count()
    return (a & b).bit_count() / n**0.5 if n else 0.0


class Tracker:
    """Tracks as plain dicts, so that a stream can keep them as state."""

    def __init__(self, key: tuple, rules: Rules, tracks: list[dict] | None = None):
        self.key, self.rules, self.tracks = key, rules, tracks if tracks is not None else []

    def _find(self, row: dict, now: float) -> dict | None:
        r = self.rules
        for t in self.tracks:
            if now - t["last_seen"] <= r.ttl and iou(t["box"], row["box"]) >= r.iou and (self.key[2] != PERSON or cosine(t["bits"], row["attr_bits"]) >= r.cosine) and colors_meet(t["colors"], row.get("colors")):
                return t
        return None

    def expire(self, now: float | None) -> None:
        """The clean-up after a message at this time (none yet: null)."""
        if now is None or now != now:
            return
        r = self.rules
        self.tracks = [t for t in self.tracks if now - t["last_seen"] <= r.ttl and not (t["state"] == SUPPRESSED and now - t["confirmed"] > r.cooldown)]

    def detection(self, row: dict) -> list[tuple]:
        now, r = row["seconds"], self.rules
        row["box"] = [row[c] for c in ("x1", "y1", "x2", "y2")]
        t = self._find(row, now)
        if t is None:
            t = {"id": None, "began": (row["det_id"], now), "state": WATCHING, "first_seen": now, "confirmed": 0.0, "hits": 0, "best": None, "score": 0.0, "attempts": 0}
            self.tracks.append(t)
        colors = row.get("colors")
        t |= {"box": row["box"], "bits": row["attr_bits"], "colors": None if colors is None else list(colors), "last_seen": now}
        out = []
        if t["state"] == WATCHING:
            if row["score"] > t["score"]:
                t |= {"best": row["det_id"], "score": row["score"]}
            t["hits"] += 1
            if t["hits"] >= r.hits and now - t["first_seen"] <= r.window:
                # most tracks never confirm, and until then nobody asks for their names
                t["id"] = t["id"] or hashlib.md5("_".join(map(str, (*self.key, *t["began"]))).encode()).hexdigest()[:16]
                out.append((*self.key, t["id"], now, t["first_seen"], t["best"], t["score"], t["hits"], row["vlm_required"]))
                t |= {"state": VERIFYING if row["vlm_required"] else SUPPRESSED, "confirmed": now}
        return out

    def either(self, row: dict) -> list[tuple]:
        """A detection, or an answer if the row names a track, after what earlier messages of the device have expired."""
        self.expire(row.get("since"))
        if isinstance(row.get("track_id"), str):
            self.answer(row["track_id"], row["seconds"], row["confirmed"], row["valid"])
            return []
        return self.detection(row)

    def answer(self, track_id: str, now: float, confirmed: bool, valid: bool) -> None:
        """A verifier's answer; one for a track that doesn't wait is stale and ignored."""
        for t in self.tracks:
            if t["id"] == track_id and t["state"] == VERIFYING:
                t["attempts"] += valid and not confirmed
                if confirmed or t["attempts"] >= self.rules.attempts:
                    t |= {"state": SUPPRESSED, "confirmed": now}
                else:
                    t |= {"state": WATCHING, "hits": 0, "best": None, "score": 0.0, "first_seen": now}


class _Machine(Tracker):
    """Answers come as rows of their own, or by a function of the event that asks (an injected verifier), at its time."""

    verify = None

    def step(self, row):
        out = self.either(row)
        for event in out:
            if event[-1] and self.verify:
                self.answer(event[3], event[4], *self.verify(event))
        return out

    def close(self):
        return ()


def observations(matched: DataFrame) -> DataFrame:
    """Rows that a tracker reads, from matched detections (det_id, device_id, ts, box, attr_bits, attr_score, vlm_required, and
    colors, an array of names, where detections have it)."""
    colors = ["colors"] if "colors" in matched.columns else []
    return matched.where("category_id <> -1").select(*KEYS, "det_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"), "x1", "y1", "x2", "y2", "attr_bits", F.col("attr_score").alias("score"), "vlm_required", *colors)


def message_times(messages: DataFrame) -> DataFrame:
    """(device_id, seconds) of every message; messages: a row or more per message (device_id, ts), such as all detections,
    whether a filter matches them or not, and messages without any."""
    return messages.select("device_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds")).distinct()


def previous_times(rows: DataFrame, times: DataFrame, slot: float = 3600.0) -> DataFrame:
    """Rows (device_id, seconds, ...) with since, the time of the device's last message before them."""
    found = as_of(rows, times, ["device_id"], "seconds", strict=True, slot=slot)
    return found.withColumn("since", F.col("found.seconds")).drop("found")


def with_answers(observed: DataFrame, answers: DataFrame) -> DataFrame:
    """Observations and a verifier's answers (the keys and track_id of the event that asked, seconds, confirmed, valid) as one
    input of a tracker, in batch or as a stream; at equal times the answer comes first."""
    return observed.unionByName(answers.select(*KEYS, "track_id", "seconds", "confirmed", "valid"), allowMissingColumns=True)


def confirmations(matched: DataFrame, messages: DataFrame, rules: Rules = Rules(), verify=None, answers: DataFrame | None = None) -> DataFrame:
    """Confirmation events of matched detections. messages has the device_id and ts of all messages of the devices. Events that
    require verification are answered by verify(event) -> (confirmed, valid), or by a table of answers."""
    settings = asdict(rules)
    observed = observations(matched) if answers is None else with_answers(observations(matched), answers)
    observed = previous_times(observed, message_times(messages))

    def start(row):
        machine = _Machine(tuple(row[k] for k in KEYS), Rules(**settings))
        machine.verify = verify
        return machine

    return fold(observed, KEYS, ["seconds", "det_id"], OUT, start)
