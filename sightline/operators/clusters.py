"""Greedy agglomeration of a frame's detections across categories."""

from __future__ import annotations

from heapq import heapify, heappop, heappush
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.filters import MOST_FILTERS, enabled
from sightline.operators.fold import fold
from sightline.vocab import MAX_CLUSTERS, MAX_MERGES, MERGE_THRESHOLD, PERSON, WEIGHTS

OUT = "device_id long, frame_ts timestamp, filter_id string, members array<long>, category_id int, x1 double, y1 double, x2 double, y2 double, confidence double, cost double"


class Node:
    """One or more detections; bits 0 means no attributes."""

    def __init__(self, members, box, area, category, kinds, bits, confidence, cost=1.0):
        self.members, self.box, self.area, self.category = members, box, area, category
        self.kinds, self.bits, self.confidence, self.cost = kinds, bits, confidence, cost

    @classmethod
    def of(cls, r: dict) -> Node:
        b = (r["x1"], r["y1"], r["x2"], r["y2"])
        return cls([r["det_id"]], b, (b[2] - b[0]) * (b[3] - b[1]), r["category_id"], {r["category_id"]}, r["attr_bits"], r["confidence"])

    def joined(self, other: Node, cost: float) -> Node:
        """A hull with the areas' sum; category of the larger part, attributes of the second where it has some."""
        category = self.category if self.area > other.area else other.category
        return Node(self.members + other.members, hull(self.box, other.box), self.area + other.area, category, self.kinds | other.kinds, other.bits or self.bits, max(self.confidence, other.confidence), cost)


def hull(a, b):
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def similarity(a: Node, b: Node, mask: int, w: dict[str, float] = WEIGHTS) -> float:
    h = hull(a.box, b.box)
    room, top = (h[2] - h[0]) * (h[3] - h[1]), max(a.area, b.area)
    packed = min(1.0, (a.area + b.area) / room) if room > 0 else 0.0
    size = min(a.area, b.area) / top if top > 0 else 0.0
    rated = [(n.bits & mask).bit_count() / mask.bit_count() if mask else 1.0 for n in (a, b) if n.category == PERSON]
    attr = sum(rated) / len(rated) if rated else 0.5
    return (packed * w["proximity"] + size * w["size"] + w["category"] + attr * w["attribute"]) / sum(w.values())


def agglomerate(nodes: list[Node], mask: int, threshold: float, most: int) -> list[Node]:
    """Merge the most similar two of disjoint categories (the first of equals) while they are similar enough.

    Pairs that are similar enough wait in a heap; those of a node that was merged are passed over when they come up."""
    alive = dict(enumerate(nodes))

    def pair(i: int, j: int) -> list[tuple[float, int, int]]:
        if alive[i].kinds & alive[j].kinds:
            return []
        s = similarity(alive[i], alive[j], mask)
        return [(-s, i, j)] if s >= threshold else []

    heap = [p for i, j in combinations(alive, 2) for p in pair(i, j)]
    heapify(heap)
    for new in range(len(nodes), len(nodes) + MAX_MERGES):
        while heap and not (heap[0][1] in alive and heap[0][2] in alive):
            heappop(heap)
        if not heap:
            break
        s, i, j = heappop(heap)
        others = [k for k in alive if k not in (i, j)]
        alive[new] = alive[i].joined(alive[j], -s)
        for k in others:
            for p in pair(k, new):
                heappush(heap, p)
        del alive[i], alive[j]
    left = list(alive.values())
    return sorted(left, key=lambda n: -n.cost)[:most] if len(left) > most else left


def cluster(det: DataFrame, filters: DataFrame, threshold: float = MERGE_THRESHOLD, most: int = MAX_CLUSTERS) -> DataFrame:
    """Clusters of every frame (device_id, frame_ts): filters in their order claim the detections of their categories if they
    enable two or more and two or more are there; what none claimed is returned by itself with a null filter.

    Beyond most clusters the costliest stay (lone detections cost 1); the others of that filter are lost, as specified.
    A frame is one picture, whose detections the detector bounds; its rows are held together. Filters travel with the code:
    those of two or more categories alone, MOST_FILTERS at most."""
    several = filters.where(F.size(enabled(F.col("cat_mask"))) >= 2).select("filter_id", "cat_mask", "attr_mask", "ord").limit(MOST_FILTERS + 1).collect()
    if len(several) > MOST_FILTERS:
        raise ValueError(f"more than {MOST_FILTERS} filters of several categories")
    asked = sorted(((r["ord"], r["filter_id"], {c for c, on in enumerate(r["cat_mask"]) if on}, r["attr_mask"]) for r in several), key=lambda f: f[:2])

    class Frame:
        def __init__(self, row):
            self.key, self.rows = (row["device_id"], row["frame_ts"]), []

        def step(self, row):
            self.rows.append(row)
            return ()

        def close(self):
            free = self.rows
            for _, filter_id, wanted, mask in asked:
                claimed = [r for r in free if r["category_id"] in wanted]
                if len(claimed) >= 2:
                    free = [r for r in free if r["category_id"] not in wanted]
                    for n in agglomerate([Node.of(r) for r in claimed], mask, threshold, most):
                        yield *self.key, filter_id, n.members, n.category, *n.box, n.confidence, n.cost
            for r in free:
                n = Node.of(r)
                yield *self.key, None, n.members, n.category, *n.box, n.confidence, n.cost

    return fold(det, ["device_id", "frame_ts"], ["det_id"], OUT, Frame)
