"""Scans against plain loops."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import instruments, ordered, queues, routing
from sightline.operators.asof import as_of


def walk(arrivals, capacity, drain):
    """(tick, waiting, accepted, sent ids by tick) of one key: every tick from the first on, a list as queue."""
    queue, out, left, tick = [], {}, {}, min(arrivals)
    last = max(arrivals)
    while tick <= last or queue:
        came = arrivals.get(tick, [])
        if came:
            room = capacity - len(queue)
            out[tick] = (len(queue), min(room, len(came)))
            queue += came[:room]
        for x in queue[:drain]:
            left[x] = tick
        queue = queue[drain:]
        tick += 1
    return out, left


@pytest.mark.parametrize(("capacity", "drain", "slot"), [(5, 2, 4), (1000, 10, 64), (7, 0, 3), (3, 3, 1), (40, 1, 1024)])
def test_bounded_queue(spark, capacity, drain, slot):
    rng = random.Random(capacity)
    rows, arrivals, seq = [], defaultdict(lambda: defaultdict(list)), 0
    for key in ("quiet", "hot", "bursts"):
        at = rng.randint(0, 5)
        for _ in range(60 if drain else 20):
            at += rng.choice((1, 1, 1, 2, 9, 40))
            for _ in range(rng.choice({"quiet": (1, 1, 2), "hot": (8, 14, 30), "bursts": (1, 1, 150 if capacity == 40 else 1100 if capacity > 500 else 9)}[key])):
                seq += 1
                rows.append((key, seq, at))
                arrivals[key][at].append(seq)
    df = spark.createDataFrame(rows, "device string, seq long, at long").withColumn("ts", F.timestamp_millis(F.col("at") * 100 + F.col("seq") % 100))
    got = {r.seq: (r.kept, r.sent_tick) for r in queues.bounded(df.repartition(5), ["device"], "ts", ["seq"], capacity, drain, 100, slot).collect()} if drain else None
    flow = {(r.device, r.tick): (r.waiting, r.accepted, r.n, r.dropped) for r in queues.ticks(df.groupBy("device", F.col("at").alias("tick")).agg(F.count("*").alias("n")), ["device"], capacity, drain, slot).collect()}
    lost = 0
    for key, of in arrivals.items():
        if drain:
            seen, left = walk(of, capacity, drain)
        else:
            seen, left, n = {}, {}, 0
            for t in sorted(of):
                seen[t] = (n, min(capacity - n, len(of[t])))
                n += seen[t][1]
        for t, came in of.items():
            waiting, accepted = seen[t]
            assert flow[key, t] == (waiting, accepted, len(came), len(came) - accepted), (key, t)
            lost += len(came) - accepted
            for x in came:
                assert not drain or got[x] == (x in left, left.get(x))
    assert lost > 0


def test_drain_above_room(spark):
    with pytest.raises(ValueError):
        queues.ticks(spark.createDataFrame([("a", 1, 1)], "k string, tick long, n long"), ["k"], 3, 4)


@pytest.mark.parametrize("error", [0.01, 0.1])
def test_quantiles_keep_their_bound(spark, error):
    rng = np.random.default_rng(3)
    values = np.r_[rng.lognormal(3, 2, 4000), np.zeros(40), -rng.random(10)]
    df = spark.createDataFrame([(f"k{i % 3}", float(v)) for i, v in enumerate(values)] + [("k0", None), ("k1", math.nan)], "key string, value double").repartition(7)
    shares = {"low": 0.0, "some": 0.005, "half": 0.5, "most": 0.95, "top": 1.0}
    for r in instruments.measure(df, ["key"], instruments.Quantiles(shares, error)).collect():
        own = np.sort(values[int(r.key[1]) :: 3])
        assert r.n == len(own)
        for name, share in shares.items():
            exact = max(0.0, own[math.floor(share * (len(own) - 1))])
            assert abs(r[name] - exact) <= error * exact + 1e-9


def test_own_instrument_and_many_keys(spark, monkeypatch):
    """Any object with the four functions will do; more keys than a task holds."""
    monkeypatch.setattr(instruments, "KEYS", 5)

    class Longest:
        schema = "longest double, seen long"

        def zero(self):
            return 0.0, 0

        def add(self, state, values):
            return max(state[0], float(values.max())), state[1] + len(values)

        def merge(self, a, b):
            return max(a[0], b[0]), a[1] + b[1]

        def result(self, state):
            return state

    df = spark.range(1000).select((F.col("id") % 40).alias("k"), F.col("id").cast("double").alias("value")).repartition(6)
    got = {r.k: (r.longest, r.seen) for r in instruments.measure(df, ["k"], Longest()).collect()}
    assert got == {k: (960.0 + k, 25) for k in range(40)}
    assert instruments.measure(df.limit(0), ["k"], Longest()).count() == 0


def test_as_of_over_slots(spark):
    rng = random.Random(2)
    left = [(rng.choice("ab"), float(rng.randint(0, 300)), i) for i in range(80)] + [("a", None, 99), ("c", 5.0, 98)]
    right = [(rng.choice("ab"), float(rng.randint(0, 300)), i) for i in range(25)]
    a = spark.createDataFrame(left, "k string, at double, i int")
    b = spark.createDataFrame([*right, ("a", None, 77)], "k string, at double, j int")
    for strict in (False, True):
        for slot in (7.0, 1e6):
            got = {r.i: r.found and (r.found["at"], r.found.j) for r in as_of(a, b, ["k"], "at", strict=strict, slot=slot).collect()}
            for k, at, i in left:
                fits = [(t, j) for key, t, j in right if at is not None and key == k and (t < at or t == at and not strict)]
                assert got[i] == max(fits, default=None), (k, at, i)


def test_router_takes_one_waiting_event_per_message(spark):
    rows = [(1, 1.0, i, True, False) for i in (1, 2)] + [(1, 5.0, i, True, True) for i in (3, 4)] + [(1, 6.0, 5, False, True)]
    df = spark.createDataFrame(rows, "device_id long, event_ts double, event_id long, vlm_required boolean, ready boolean")
    got = sorted((r["at"], r.event_id, r.target) for r in routing.route(df, message="event_ts").collect())
    assert got == [(3, 1, "verify"), (3, 3, "verify"), (4, 4, "verify"), (5, 2, "verify"), (5, 5, "alerts")]
    # as messages of their own, the second one takes another
    got = sorted((r["at"], r.event_id, r.target) for r in routing.route(df).collect())
    assert got == [(3, 1, "verify"), (3, 3, "verify"), (4, 2, "verify"), (4, 4, "verify"), (5, 5, "alerts")]


def test_readiness_from_runs(spark):
    events = spark.createDataFrame([(1, t) for t in (0.0, 1.0, 2.9, 3.0, 4.0, 9.0)] + [(2, 1.5)], "device_id long, seconds double")
    runs = spark.createDataFrame([(1, 1.0, 3.0), (1, 3.5, 8.0)], "device_id long, started double, finished double")
    got = {(r.device_id, r.seconds): r.ready for r in routing.with_ready(events, runs).collect()}
    assert got == {(1, 0.0): True, (1, 1.0): False, (1, 2.9): False, (1, 3.0): True, (1, 4.0): False, (1, 9.0): True, (2, 1.5): True}


def test_counters_of_a_full_queue(spark):
    rows = [(1, float(i), i, True, i == 5) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "device_id long, event_ts double, event_id long, vlm_required boolean, ready boolean")
    assert routing.counters(routing.route(df, capacity=2)).first().asDict() == {"routed_to_alerts": 0, "routed_to_verifier": 2, "queued": 4, "timeouts": 2, "still_waiting": 1}


def test_places(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, i % 5) for i in range(1000)], "a int, b int")
    got = {r.a: r.place for r in ordered.numbered(df.repartition(9), [F.desc("b"), "a"]).collect()}
    want = {a: i + 1 for i, (a, _) in enumerate(sorted(((r.a, r.b) for r in df.collect()), key=lambda r: (-r[1], r[0])))}
    assert got == want and ordered.numbered(df.limit(0), ["a"]).count() == 0
