"""Operators whose work or disk must not grow faster than their input: the same results as plain loops, by plans that stay in proportion."""

import random
import re
from collections import deque

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import flow, graph, outcomes, reads, stance, validation


def one(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def final_plan(df):
    """The plan as it ran, down to where the plan before it is told."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize(("hub", "few"), [(4, 1000), (4, 0), (30, 1000), (10**6, 1000)])
def test_cycles3_deal_their_edges_once(spark, monkeypatch, hub, few):
    """Whatever counts as a hub and however hubs are joined: the cycles of brute force, pairs of several pools and repeated pools among them, from one exchange of the edges."""
    monkeypatch.setattr(graph, "HUB", hub)
    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(5)
    names = ["H0", "H1", *(f"t{i}" for i in range(30))]
    rows = [(rng.randrange(150), *rng.sample(names[:2] if rng.random() < 0.2 else names, 2), rng.uniform(0.85, 1.2)) for _ in range(300)] + [(1000 + i, f"H{i % 2}", f"t{i % 30}", rng.uniform(0.85, 1.2)) for i in range(60)]
    edges = spark.createDataFrame(rows, "pool int, a string, b string, rate double").repartition(4)
    start = {}
    for x in rows:
        start.setdefault(x[1], []).append(x)
    want = sorted((a, b, c, p, q, r, x * y * z) for p, a, b, x in rows for q, _, c, y in start.get(b, ()) for r, _, d, z in start.get(c, ()) if d == a and a < b and a < c and len({p, q, r}) == 3 and x * y * z >= 1.15)
    found = graph.cycles3(edges, 1.15)
    assert sorted(one(found, "a", "b", "c", "p1", "p2", "p3", "gain")) == want and len(want) > 50
    if few:
        dealt = [line for line in final_plan(found).splitlines() if "REPARTITION_BY_COL" in line]
        assert sum("ReusedExchange" not in line for line in dealt) == 1 and len(dealt) > 1

S = 1_000_000


@pytest.fixture(scope="module")
def odd(spark):
    """Prints that share times, stand still, come back in time and have no aggressor: as tuples, and as rows."""
    rng = random.Random(3)
    rows, us = [], {"M0": 0, "M1": 50 * S}
    for seq in range(240):
        m = rng.choice(["M0", "M1"])
        us[m] += rng.choice([0, 0, S // 3, S, 2 * S, 7 * S, -S, 40 * S if seq % 60 == 0 else S])
        rows.append((m, seq, us[m], rng.randrange(95, 105), rng.randrange(1, 5), rng.choice("BANN"), rng.choice("ACCT")))
    return rows, spark.createDataFrame(rows, "instrument string, seq long, us long, px_ticks long, sz long, side string, action string")


def within(rows, r, seconds, same=lambda a, b: True):
    return [q for q in rows if q[0] == r[0] and r[2] - seconds * S <= q[2] <= r[2] and same(q, r)]


def slides(df):
    """Whether Spark adds a range of time up anew for each row."""
    return "RangeFrame, -" in df._jdf.queryExecution().optimizedPlan().toString()


def test_dscore_slopes_do_not_slide(spark, odd):
    rows, df = odd
    found = flow.dscore(df, 10, 5)
    assert not slides(found)
    session, before, want = {}, {}, {}
    for r in rows:
        session[r[1]] = before.get(r[0], (r[2], 0))[1] + (r[2] - before.get(r[0], (r[2], 0))[0] > 5 * S)
        before[r[0]] = r[2], session[r[1]]
    for r in rows:
        w = within(rows, r, 10, lambda a, b: session[a[1]] == session[b[1]])
        t, p = [(q[2] - r[2]) / 60e6 for q in w], [q[3] for q in w]
        flat = len({q[2] for q in w}) < 2
        want[r[1]] = None if len(w) < 3 or flat else sum((a - sum(t) / len(t)) * b for a, b in zip(t, p)) / sum((a - sum(t) / len(t)) ** 2 for a in t)
    got = {r.seq: (r.session, r.slope) for r in found.collect()}
    assert {k: v[0] for k, v in got.items()} == session
    assert all((got[k][1] is None) == (v is None) and (v is None or got[k][1] == pytest.approx(v, rel=1e-9, abs=1e-9)) for k, v in want.items())
    assert sum(v is None for v in want.values()) and len(set(session.values())) > 2


def test_message_rate_does_not_slide(spark, odd):
    rows, df = odd
    found = flow.message_rate(df, 6)
    assert not slides(found)
    n = lambda w, a: sum(q[6] == a for q in w)
    want = [(r[1], len(w), n(w, "C") / n(w, "A") if n(w, "A") else None) for r in rows for w in [within(rows, r, 6)]]
    assert sorted(one(found, "seq", "messages", "cancel_add")) == want and any(x[2] is None for x in want)


def test_travel_does_not_slide(spark, odd):
    """Bars of 64 s and windows of 5 s, which don't fill a bar evenly."""
    rows, df = odd
    found = reads.travel(df, 64, 5)
    assert not slides(found)
    bar = lambda r: (r[0], r[2] // (64 * S))
    bars = {}
    for r in rows:
        bars.setdefault(bar(r), []).append(r)
    want = []
    for r in rows:
        mine = bars[bar(r)]
        w, prior = within(mine, r, 5), [q for q in mine if q[1] < r[1]]
        old = min(w, key=lambda q: q[1]) if len(w) > 1 else prior[-1] if prior else None
        want.append((r[1], r[3] - mine[0][3], None if old is None else old[3] - mine[0][3], 0.0 if old is None else (r[2] - old[2]) / S, max(len(w), 2 if prior else 1)))
    assert sorted(one(found, "seq", "move", "was", "span_s", "samples")) == want and any(x[2] is None for x in want)


def test_velocity_does_not_slide(spark, odd):
    rows, df = odd
    found = flow.velocity(df, 3, 20, 6)
    assert not slides(found)
    want = [(r[1], a, b, a / 3 / (b / 20) if b >= 6 else None) for r in rows for a, b in [(len(within(rows, r, 3)), len(within(rows, r, 20)))]]
    assert sorted(one(found, "seq", "n_burst", "n_base", "ratio")) == want


def test_clearance_does_not_slide(spark, odd):
    rows, df = odd
    book = F.array(F.struct((F.col("px_ticks") + 1).alias("px"), F.col("sz").alias("sz")))
    found = reads.clearance(df, df.select("instrument", "us", "seq", book.alias("bids"), book.alias("asks")), 3, 6, 0.6)
    assert not slides(found)
    want = [(r[1], flow_, flow_ / r[4]) for r in rows for flow_ in [sum(q[4] for q in within(rows, r, 6) if q[5] == "B")]]
    assert sorted(one(found, "seq", "flow", "ratio")) == want and any(x[1] == 0 for x in want)


def test_kinetic_does_not_slide(spark, odd):
    rows, df = odd
    found = flow.kinetic(df, 6)
    assert not slides(found)
    last, dp = {}, {}
    for r in rows:
        dp[r[1]] = r[3] - last[r[0]] if r[0] in last else 0
        last[r[0]] = r[3]
    sign, want = {"B": 1, "A": -1}, []
    for r in rows:
        w = within(rows, r, 6)
        known = [q for q in w if q[5] in sign]
        want.append((r[1], sum(dp[q[1]] * sign[q[5]] * q[4] for q in known), sum(sign[q[5]] * q[4] for q in known) if known else None, sum(q[4] for q in known) if known else None))
    assert sorted(one(found, "seq", "work", "signed", "volume")) == want and any(x[2] is None for x in want)


def test_first_touch_does_not_pair_events_with_prints(spark, odd):
    """Levels, spots and prices may be null; the plan joins nothing."""
    rows, df = odd
    rng = random.Random(4)
    prints = df.withColumn("px", F.when(F.col("seq") % 17 != 0, F.col("px_ticks")))
    ev = [(r[1], r[0], r[2], None if i % 19 == 0 else r[3], None if i % 23 == 0 else r[3] + rng.randrange(-6, 7)) for i, r in enumerate(rows)]
    events = spark.createDataFrame(ev, "event_id long, instrument string, at_us long, spot long, level long")
    want = []
    for i, m, at, spot, level in ev:
        w = sorted((q[2], q[1], q[3] if q[1] % 17 else None) for q in rows if q[0] == m and at < q[2] <= at + 20 * S)
        up = spot is not None and level is not None and level >= spot
        hits = [us for us, _, px in w if level is not None and px is not None and (px >= level if up else px <= level)]
        want.append((i, spot, level, bool(hits), (hits[0] - at) / 60e6 if hits else None, w[-1][2] if w else None, len(w)))
    for parts in (1, 3):
        found = outcomes.first_touch(events, prints, 20 * S, parts)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(one(found, "event_id", "spot", "level", "touched", "minutes", "last_px", "prints"), key=lambda r: r[0]) == want
    assert 20 < sum(r[3] for r in want) < len(want)


def test_after_touch_does_not_pair_touches_with_prints(spark, odd):
    rows, df = odd
    events = spark.createDataFrame([(r[1], r[0], r[2], r[3], r[3] + r[1] % 11 - 5) for r in rows], "event_id long, instrument string, at_us long, spot long, level long")
    want = []
    for r in rows:
        level, at = r[3] + r[1] % 11 - 5, r[2]
        hits = [q[2] for q in rows if q[0] == r[0] and at < q[2] <= at + 20 * S and (q[3] >= level if level >= r[3] else q[3] <= level)]
        after = sorted((q[2], q[1], q[3]) for q in rows if hits and q[0] == r[0] and min(hits) < q[2] <= min(hits) + 9 * S)
        if after:
            want.append((r[1], (after[-1][2] - level) * (1 if level >= r[3] else -1)))
    prints = df.withColumn("px", F.col("px_ticks"))
    found = validation.after_touch(events, prints, 20 * S, 9 * S)
    assert "us" not in {c for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line for c in re.findall(r"[(]*(\w+)#", line)}  # no range of prints
    assert sorted(one(found, "event_id", "move")) == want and len(want) > 50


def test_stance_state_costs_no_scan(monkeypatch):
    """The longest run and the volume of the burst are what scans of all runs and all recent prints find, though neither is scanned."""
    rng = random.Random(6)
    runs, there = stance.Longest(), set()
    for i in range(3000):
        px = rng.randrange(-40, 40)
        runs.remove(px) if px in there else runs.add(px)
        there ^= {px}
        want = max(((b - a, -a) for a in there if a - 1 not in there for b in [next(q for q in range(a, 99) if q + 1 not in there)]), default=None)
        assert runs.longest() == (want and (-want[1], want[0] - want[1])), i
    assert len(runs.heap) <= 64 + 4 * 80

    monkeypatch.setattr(stance.Volumes, "DEEP", 3)  # beyond eight neighbours too
    volumes, held_ = stance.Volumes(), {}
    for _ in range(2000):
        px, v = rng.randrange(-60, 60), rng.randrange(-3, 9)
        volumes.add(px, v)
        held_[px] = held_.get(px, 0) + v
        a = rng.randrange(-70, 60)
        b = a + rng.randrange(60)
        assert volumes.between(a, b) == sum(held_.get(p, 0) for p in range(a, b + 1))


def test_stream_stances_scan_no_recent_prints(monkeypatch):
    """A batch of prints that are all within the burst: its state is loaded and saved, but not gone through for each print."""
    import pandas as pd

    from tapeloom.streaming import stances

    class Kept:
        def __init__(self, *_):
            self.rows = []

        exists = lambda self: bool(self.rows)
        get = lambda self: self.rows if isinstance(self.rows, tuple) else iter(self.rows)
        iterator = lambda self: iter(self.rows)
        clear = lambda self: self.rows.clear()

        def put(self, rows):
            self.rows = list(rows)

        def update(self, row):
            self.rows = row

        def updateValue(self, key, value):  # noqa: N802
            self.rows = [r for r in self.rows if r[0] != key] + [(key, value)]

    class Handle:
        getValueState = getMapState = getListState = staticmethod(Kept)

    class Counted(deque):
        seen = 0

        def __iter__(self):
            Counted.seen += len(self)
            return super().__iter__()

    def fresh(rule, held_=stance.Stance):
        return held_(rule, recent=Counted())

    monkeypatch.setattr(stances, "Stance", fresh)
    walk = stances.Stances(stance.Conditions(2, 10**9, 0.4, 5, 1000, 4, 0.2))
    walk.init(Handle)
    rng = random.Random(8)
    for batch in range(2):
        rows = [(us, us, 1, rng.randrange(100, 110), 1 + us % 5, rng.random() < 0.6, None, None, None, None) for us in range(batch * 400, batch * 400 + 400)]
        list(walk.handleInputRows(("M0",), [pd.DataFrame(rows, columns=["us", "seq", "o", "px", "sz", "buys", "bids_px", "bids_sz", "asks_px", "asks_sz"])], None))
    assert len(walk.recent.rows) == 800 and Counted.seen <= 400 + 800  # saved once a batch
