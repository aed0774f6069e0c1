"""Scans against plain loops, and with later bars cut off."""

import random

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import scans as O

HOUR = 3_600_000_000
BARS = "instrument string, bar_us long, open long, high long, low long, close long, volume long"


def walk(n, seed, instrument="M", step=(-3, -2, -1, 0, 1, 2, 3), gap=0.1):
    rng, px, out = random.Random(seed), 1000, []
    for i in range(n):
        if rng.random() < gap:
            continue
        o = px
        path = [px := px + rng.choice(step) for _ in range(4)]
        out.append((instrument, i * HOUR, o, max(o, *path), min(o, *path), px, rng.randrange(1, 50)))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, BARS)


def sets(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_replay_looks_back_alone(spark):
    rows = walk(260, 3) + walk(200, 4, "N")
    whole = O.replay(table(spark, rows), 2, 5.0, 0)
    assert whole.count() > 300 and {c for c in ("position", "structure", "zone", "vwap") if whole.where(F.col(c).isNotNull()).count() > 10} == {"position", "structure", "zone", "vwap"}
    assert whole.where("abs(zone) = 0.35").count() and whole.where("abs(zone) = 0.8").count()
    for cut in (60, 131, 199):
        early = O.replay(table(spark, [r for r in rows if r[1] < cut * HOUR]), 2, 5.0, 0)
        last = {m: max(r[1] for r in rows if r[0] == m and r[1] < cut * HOUR) for m in "MN"}
        kept = [r for r in whole.collect() if r.bar_us < last[r.instrument]]
        assert sets(early) == sorted(map(str, map(tuple, kept))) and len(kept) > 50


@pytest.mark.parametrize(("hour_s", "most"), [(None, None), (4 * 3600, 2 * 3600)])
def test_agreement_against_a_loop(spark, hour_s, most):
    rows = walk(900, 7) + walk(300, 8, "N", gap=0.4)
    block, trade, buffer, hold, skip = 24 * 3600, 6 * 3600, 3, 2, 1
    want = []
    for m in "MN":
        own = [r for r in rows if r[0] == m]
        fired, leans = set(), {}
        for i, (_, us, o, h, lo, c, _) in enumerate(own):
            for size in {block, hour_s} - {None}:
                k = us // (size * 10**6)
                state = leans.get(size)
                if state is None or state["k"] != k:
                    state = leans[size] = {"k": k, "open": o, "lean": 0, "side": 0, "run": 0}
                side = 1 if c - state["open"] >= buffer else -1 if c - state["open"] <= -buffer else 0
                state["run"] = state["run"] + 1 if side == state["side"] else 1
                state["side"] = side
                if side and state["run"] >= hold:
                    state["lean"] = side
            candle = us // (trade * 10**6) * trade * 10**6
            co = next(r[2] for r in own if r[1] >= candle)
            lean = leans[block]["lean"]
            if not i or not lean or (hour_s and leans[hour_s]["lean"] != lean) or (us - us // (block * 10**6) * block * 10**6) // (trade * 10**6) < skip or candle <= own[0][1] // (trade * 10**6) * trade * 10**6:
                continue
            if most is not None and us - candle > most * 10**6:
                continue
            up, down = h > own[i - 1][3] and lo > own[i - 1][4], h < own[i - 1][3] and lo < own[i - 1][4]
            side = "long" if lean > 0 and c > co and up else "short" if lean < 0 and c < co and down else None
            if side and (candle, side) not in fired:
                fired.add((candle, side))
                end = [r[5] for r in own if candle <= r[1] < candle + trade * 10**6][-1]
                done = own[-1][1] >= candle + trade * 10**6
                want.append((m, us, side, c, co, "provisional" if not done else "confirmed" if (end > co if side == "long" else end < co) else "withdrawn"))
    got = O.agreement(table(spark, rows), block, trade, buffer, hold, 6.0, 1.4, skip, hour_s=hour_s, most_in_s=most)
    assert sets(got.select("instrument", "bar_us", "side", "entry", "stop", "status")) == sorted(map(str, want)) and len(want) > 10


def patterns(rows, memory, accept, near, rotation, confirm, rearm):
    """rows of one session: (us, open, high, low, close, val, vah, poc, hvn, lvn)."""
    out, came, settled, closes = [], {}, set(), []

    def state(cs, val, vah):
        tail = cs[-accept:]
        return 0 if len(tail) < accept or vah <= val else 1 if min(tail) > vah else -1 if max(tail) < val else 0

    for i, (us, _, high, low, c, val, vah, poc, hvn, lvn) in enumerate(rows):
        closes.append(c)
        last = rows[max(0, i - memory + 1) : i + 1]
        for name, beyond in (("Failed_Auction_Down", c < val), ("Failed_Auction_Up", c > vah)):
            if beyond:
                came.pop(name, None)
                settled.discard(name)
        now, was, tail = state(closes, val, vah), state(closes[:-1], val, vah), closes[-accept:]
        full = len(tail) == accept
        longs, shorts = [], []
        ups, downs = [x for x in [*hvn, poc, vah] if x > c + 1], [x for x in [*hvn, poc, val] if x < c - 1]
        if was == 0 and full and min(tail) > vah and c <= vah + confirm:
            longs.append(("VA_Breakout_Up", vah, vah - 1, min(ups, default=2 * vah - val)))
        if was == 0 and full and max(tail) < val and c >= val - confirm:
            shorts.append(("VA_Breakdown", val, val + 1, max(downs, default=2 * val - vah)))
        for n in lvn:
            below, above = max((x for x in hvn if x < n), default=val if val < n else None), min((x for x in hvn if x > n), default=vah if vah > n else None)
            at = abs(c - n) <= near or low <= n <= high
            if now == 1 and at and c > n and None not in (below, above) and above > c:
                longs.append(("LVN_Traversal_Up", n, below - 1, above))
            if now == -1 and at and c < n and None not in (below, above) and below < c:
                shorts.append(("LVN_Traversal_Down", n, above + 1, below))
        for n in hvn:
            if n < c and low <= n + near and c > n + 1 and min(ups, default=vah) > c:
                longs.append(("HVN_Rejection_Up", n, n - 1, min(ups, default=vah)))
            if n > c and high >= n - near and c < n - 1 and max(downs, default=val) < c:
                shorts.append(("HVN_Rejection_Down", n, n + 1, max(downs, default=val)))
        broke = [r[3] for r in last if r[4] < val]
        if broke and not (full and max(tail) < val) and val < c <= val + confirm and "Failed_Auction_Down" not in settled and (poc if poc > c else vah) > c:
            longs.append(("Failed_Auction_Down", val, min(broke) - 1, poc if poc > c else vah))
        broke = [r[2] for r in last if r[4] > vah]
        if broke and not (full and min(tail) > vah) and vah > c >= vah - confirm and "Failed_Auction_Up" not in settled and (poc if poc < c else val) < c:
            shorts.append(("Failed_Auction_Up", vah, max(broke) + 1, poc if poc < c else val))
        if now == 0 and any(r[4] <= poc - rotation for r in last) and poc + rotation <= c <= poc + confirm and vah > c:
            longs.append(("POC_Reclaim", poc, poc - 1, vah))
        if now == 0 and any(r[4] >= poc + rotation for r in last) and poc - confirm <= c <= poc - rotation and val < c:
            shorts.append(("POC_Rejection", poc, poc + 1, val))
        for side, found in (("long", longs), ("short", shorts)):
            if not found:
                continue
            name, node, stop, target = found[0]
            if name in came and abs(c - came[name]) < rearm:
                continue
            if not (stop < c < target if side == "long" else target < c < stop):
                continue
            came[name] = c
            if name.startswith("Failed"):
                settled.add(name)
            out.append((us, name, side, node, c, stop, target))
            break
    return out


def test_each_auction_pattern_against_a_loop(spark):
    rng, rows, want = random.Random(11), [], []
    for day in range(60):
        val = 1000 + rng.randrange(-8, 8)
        vah = val + rng.randrange(0, 14)
        poc = rng.randrange(val, vah + 1)
        hvn, lvn = (sorted(rng.sample(range(985, 1030), rng.randrange(0, 4))) for _ in "ab")
        bars = [(us, o, h, lo, c, val, vah, poc, hvn, lvn) for _, us, o, h, lo, c, _ in walk(40, day, step=(-2, -1, 0, 1, 2), gap=0)]
        rows += [("M", day, us + day * 40 * HOUR, *rest) for us, *rest in bars]
        want += [("M", day, us + day * 40 * HOUR, *rest) for us, *rest in patterns(bars, 12, 2, 2, 4, 12, 8)]
    df = spark.createDataFrame(rows, "instrument string, day_us long, bar_us long, open long, high long, low long, close long, val long, vah long, poc long, hvn array<long>, lvn array<long>")
    got = O.auction(df)
    assert sets(got.select("instrument", "day_us", "bar_us", "pattern", "side", "node", "entry", "stop", "target")) == sorted(map(str, want))
    assert {x[3] for x in want} == {*O.LONG, *O.SHORT}


def test_price_step_on_mixed_ticks(spark):
    rng = random.Random(2)
    rows = [(m, i, *(float(round(tick * rng.randrange(400, 900), 10)) for _ in range(4)), 1.0) for m, tick in (("A", 0.25), ("B", 0.01), ("C", 5.0)) for i in range(300)]
    rows += [("few", 0, 100.0, 105.0, 95.0, 100.0, 1.0), ("zero", 0, 0.0, 0.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, BARS.replace("long", "double").replace("bar_us double", "bar_us long"))
    got = {r.instrument: round(r.tick, 10) for r in O.price_step(df).collect()}
    assert got == {"A": 0.25, "B": 0.01, "C": 5.0, "few": 0.01}
    high = {r.instrument: r.height for r in O.row_height(df, 20).collect()}
    span = max(r[3] for r in rows if r[0] == "A") - min(r[4] for r in rows if r[0] == "A")
    assert high["A"] % 0.25 == 0 and span / 20 <= high["A"] < span / 20 + 0.25


@pytest.mark.parametrize(("now", "gap", "why"), [((2, 3), 3.0, None), ((4, 3), 3.0, "same"), ((2, 3), 0.5, "small gain"), ((2, 3), 30.0, "interval")])
def test_levels_are_proposed_or_refused(spark, now, gap, why):
    """Target 4 pays `gap` more than 2; with a wide spread the interval holds zero."""
    wide = 400.0 if gap == 30.0 else 1.0
    events = [(i, i * 10) for i in range(200)]
    cells = [(i, "M", 1, t, 3, 0, (gap if t == 4 else 0.0) + (0.2 if gap == 0.5 else 0) + (wide if i % 2 else -wide)) for i, _ in events for t in (2, 4)]
    df = spark.createDataFrame(cells, "event_id long, instrument string, side int, target int, stop int, hit int, net double")
    r = O.propose(df, spark.createDataFrame(events, "event_id long, at_us long"), now).first()
    assert (r.target, r.stop, r.fit_n, r.test_n, r.refused) == (4, 3, 120, 80, why)
    few = O.propose(df.where("event_id < 90"), spark.createDataFrame(events[:90], "event_id long, at_us long"), now).first()
    assert few.refused == "few" and O.propose(df.limit(0), spark.createDataFrame(events, "event_id long, at_us long"), now).count() == 0
