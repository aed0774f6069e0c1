"""Runways and proposals against plain loops, and each gate once."""

import math
import random

import pytest

from tapeloom.operators import decisions as O

LV = "array<struct<px:double,sz:double>>"
ENTRY = f"id int, side string, entry double, bids {LV}, asks {LV}, walls array<struct<px:double,size:double>>, swing_high double, swing_low double, cluster_px double, cluster_size double, extra string"
READ = f"id int, samples int, bids {LV}, asks {LV}, direction string, verdict string, backed boolean, conviction double, left_s double, bar_bps double, kind string"


def test_runway_against_a_loop(spark):
    rng, rows = random.Random(5), []
    for i in range(400):
        px = rng.choice([100.0, 250.0])
        book = lambda s: [(px + s * (j + 1) * rng.choice([0.1, 0.2]), float(rng.choice([1, 2, 3, 40]))) for j in range(rng.randrange(0, 8))]  # noqa: B023, E731
        rows.append((i, rng.choice(["long", "short"]), rng.choice([px, px, None, 0.0]), book(-1), book(1), [(px + rng.uniform(-3, 3), 9.0) for _ in range(rng.randrange(3))], rng.choice([None, px + 1.5]), rng.choice([None, px - 0.4]), rng.choice([None, px + 0.3]), rng.choice([0.0, 5.0, None]), "x"))
    rows += [(900, "long", 100.0, None, None, None, None, None, None, None, None), (901, None, 100.0, [(99.0, 1.0)], [(101.0, 1.0)], None, 102.0, 98.0, None, None, None)]
    got = {r.id: r for r in O.runway(spark.createDataFrame(rows, ENTRY), 120.0, 2.5).collect()}
    assert len(got) == len(rows)
    seen = set()
    for i, side, entry, bids, asks, heavy, hi, lo, cpx, csz, _ in rows:
        up = side == "long"
        ok = lambda p: bool(entry) and p is not None and (p > entry if up else p < entry) and abs(p - entry) / entry * 1e4 <= 120  # noqa: B023, E731
        lv = [(p, p * s) for p, s in (asks if up else bids) or [] if ok(p)]
        mean = sum(n for _, n in lv) / len(lv) if len(lv) >= 3 else math.inf
        found = [(p, "shelf") for p, n in lv if n >= 2.5 * mean] + [(p, "volume") for p, _ in heavy or [] if ok(p)]
        found += [(p, "structure") for p in [hi if up else lo] if ok(p)] + [(cpx, "liquidation")] * (ok(cpx) and (csz or 0) > 0)
        want = sorted((abs(p - entry) / entry * 1e4, k, p) for p, k in found)
        assert [(o.bps, o.kind, o.px) for o in got[i].obstacles] == want
        block = [w for w in want if w[1] != "liquidation"]
        assert got[i].clear_bps == (block[0][0] if block else 120.0 if entry else 0.0) and got[i].open_road == (bool(entry) and not block)
        seen |= {k for _, k, _ in want}
    assert seen == {"shelf", "volume", "structure", "liquidation"}


def test_walls_and_extremes(spark):
    p = spark.createDataFrame([("a", 1, 60), ("a", 2, 40), ("a", 3, 5), ("b", 1, 0)], "instrument string, px int, total int")
    assert {r.instrument: [(w.px, w["size"]) for w in r.walls] for r in O.walls(p, ["instrument"], 0.3).collect()} == {"a": [(1, 60), (2, 40)]}
    b = spark.createDataFrame([("a", i, 10 + i, 5 - i) for i in range(6)], "instrument string, bar_us long, high int, low int")
    assert [(r.swing_high, r.swing_low) for r in O.extremes(b, 3, 2).orderBy("bar_us").collect()] == [(None, None)] * 2 + [(11, 4), (12, 3), (13, 2), (14, 1)]
    assert O.extremes(b.limit(0)).count() == 0


def slip(levels, mid, n):
    paid = got = 0.0
    for px, sz in levels:
        take = max(min(px * sz, n - paid), 0.0)
        paid, got = paid + take, got + take / px
    return abs(paid / got - mid) / mid * 1e4 if paid >= n * (1 - 1e-12) else None


def nearest_that_pays(bids, asks, up, left_bps, n, tick, rate, fee):
    """Every target from the first on, until one needs a rate of wins that is low enough."""
    mid, entry, own = (bids[0][0] + asks[0][0]) / 2, (asks if up else bids)[0][0], bids if up else asks
    cost = slip(asks, mid, n) + slip(bids, mid, n) + fee
    big = max(own[1:] or own, key=lambda x: x[0] * x[1])[0]
    shelf, hard = abs(entry - (big - tick if up else big + tick)), max(3 * (asks[0][0] - bids[0][0]), 2 * tick)
    first = max(1, math.ceil(cost * 2 / 1e4 * entry / tick))
    for step in range(first, max(first, int(left_bps * 0.8 / 1e4 * entry / tick)) + 1):
        t = step * tick
        floor, cap = max(hard, 0.8 * t), 2.5 * t
        risk = max(cap, floor) if shelf > max(cap, floor) else max(shelf, floor)
        if (risk + cost / 1e4 * entry) / (t + risk) <= rate:
            return t, risk, shelf > max(cap, floor)
    return None


@pytest.mark.parametrize("rate", [0.6, 0.75, 0.9])
def test_scalp_in_closed_form_is_the_search(spark, rate):
    rng, rows, tick = random.Random(int(rate * 100)), [], 0.25
    for i in range(300):
        px, gap, n = 1000 + rng.randrange(50), rng.choice([1, 2, 4]), rng.randrange(1, 9)
        bids, asks = ([(px + s * (gap / 2 + j) * tick if s > 0 else px - (gap / 2 + j) * tick, float(rng.choice([1, 3, 9, 30]))) for j in range(n)] for s in (-1, 1))
        if i % 3 == 0:
            bids, asks = bids + [(bids[0][0] - 60 * tick, 500.0)], asks + [(asks[0][0] + 60 * tick, 500.0)]
        rows.append((i, 9, bids, asks, rng.choice(["up", "down"]), "confirmed", True, 0.9, 100.0, rng.uniform(1, 90), "k"))
    got = O.suggest(spark.createDataFrame(rows, READ), 100.0, True, notional=4000.0, fee_bps=0.3, most_rate=rate).collect()
    paid = refused = pulled = 0
    for r, (_, _, bids, asks, way, *_, bar, _) in zip(sorted(got, key=lambda r: r.id), rows, strict=True):
        if slip(asks, 1, 4000.0) is None or slip(bids, 1, 4000.0) is None:
            assert r.gate == "depth"
            continue
        t = min([abs(a[0] - b[0]) for s in (bids, asks) for a, b in zip(s, s[1:], strict=False)] or [asks[0][0] - bids[0][0]])
        want = nearest_that_pays(bids, asks, way == "up", bar, 4000.0, t, rate, 0.3)
        if want is None:
            assert r.gate == "breakeven" and r.target_px is None
            refused += 1
        else:
            assert r.gate in (None, "no room")
            assert (abs(r.target_px - r.entry), abs(r.stop_px - r.entry)) == pytest.approx(want[:2]) and r.capped == want[2]
            paid, pulled = paid + (r.gate is None), pulled + want[2]
    assert paid > 20 and (refused > 20 or rate > 0.8) and (pulled or rate < 0.75)


def test_each_gate(spark):
    bids, asks = [(100.0, 50.0), (99.9, 90.0), (99.8, 10.0)], [(100.1, 50.0), (100.2, 90.0), (100.3, 10.0)]
    ok = dict(samples=9, bids=bids, asks=asks, direction="up", verdict="confirmed", backed=True, conviction=0.8, left_s=100.0, bar_bps=300.0, kind="k")
    cases = [
        (None, {}), ("warming", {"samples": 4}), ("warming", {"samples": None}), ("no book", {"bids": [], "asks": None}), ("one sided", {"asks": []}), ("no book", {"bids": [(0.0, 1.0)]}), ("locked", {"bids": [(100.1, 5.0)]}),
        ("flat", {"direction": "flat"}), ("flat", {"direction": None}), ("conflict", {"verdict": "conflict"}), ("unconfirmed", {"verdict": None}), ("conviction", {"conviction": 0.4}), ("too late", {"left_s": 19.0}),
        ("no range", {"bar_bps": None}), ("depth", {"bids": [(100.0, 1.0)]}), ("cost", {"bar_bps": 30.0}), ("shape", {"bar_bps": 80.0}),
    ]
    rows = [(i, *(ok | change).values()) for i, (_, change) in enumerate(cases)]
    got = {r.id: r for r in O.suggest(spark.createDataFrame(rows, READ), 100.0, notional=9000.0).collect()}
    assert [got[i].gate for i in range(len(cases))] == [g for g, _ in cases]
    assert got[0].target_px == pytest.approx(100.1 + 15 * 0.1) and got[0].stop_px == pytest.approx(100.1 - 100.1 * 0.0045) and got[1].entry is None
    rows = [(0, *(ok | {"backed": None}).values()), (1, *(ok | {"bar_bps": 10.0}).values())]
    assert [r.gate for r in O.suggest(spark.createDataFrame(rows, READ), 100.0, True, notional=9000.0).orderBy("id").collect()] == ["unsettled", "breakeven"]
    assert O.suggest(spark.createDataFrame([], READ), 100.0).count() == 0


def test_entry_signal(spark):
    from pyspark.sql import functions as F

    from tapeloom.functions.verdicts import entry_signal

    cases = [
        ("up", "up", True, "up", "flat", None, ("up", None)), ("up", "down", True, None, None, None, (None, "cvd-side")), ("up", None, True, None, None, None, (None, "cvd-side")), ("down", "down", False, None, None, None, (None, "cvd")),
        ("down", "down", None, None, None, None, (None, "cvd")), ("up", "up", True, "down", "down", "down", (None, "stack")), ("up", "up", True, "down", "down", "flat", ("up", None)), ("up", "up", True, "down", "down", None, ("up", None)),
        ("down", "down", True, "up", "up", "up", (None, "stack")), ("flat", "up", True, None, None, None, (None, None)), (None, None, None, None, None, None, (None, None)),
    ]
    df = spark.createDataFrame([(i, *c[:6]) for i, c in enumerate(cases)], "i int, r string, c string, b boolean, x string, y string, z string")
    side, blocked = entry_signal(*(F.col(c) for c in "rcbxyz"))
    assert [(r.s, r.w) for r in df.select("i", side.alias("s"), blocked.alias("w")).orderBy("i").collect()] == [c[6] for c in cases]


def test_journal(spark):
    from tapeloom.operators.machines import journal

    looks = [
        (None, "up", None, None, 1, "none", "no price", 0, None), (10, None, None, None, 1, "none", "no signal", 0, None), (10, "up", None, None, None, "none", "no candle", 0, None), (10, "up", "down", True, 1, "open", "up", 1, None),
        (11, None, "up", None, 1, "none", "held", 1, None), (14, "down", "down", True, 1, "close", "tp", 0, 4), (14, "up", None, None, 1, "none", "side taken", 0, None), (14, "down", None, None, 1, "open", "down", -1, None),
        (17, "up", None, True, 1, "close", "sl", 0, -3), (17, "up", None, None, None, "none", "no candle", 0, None), (17, "down", None, None, 1, "none", "side taken", 0, None), (17, "up", None, None, 2, "open", "up", 1, None),
        (0, "down", None, None, 2, "none", "no price", 1, None), (16, "down", "down", True, 2, "close", "flip", 0, -1), (16, "down", None, None, 3, "open", "down", -1, None), (15, None, "up", True, 3, "close", "disagree", 0, 1),
        (15, "up", None, False, 3, "open", "up", 1, None), (15, "up", "down", False, 3, "close", "diverge", 0, 0), (15, "up", None, None, 4, "open", "up", 1, None),
    ]
    schema = "instrument string, us long, seq long, px long, agree string, price string, disagreed boolean, candle long, action string"
    df = spark.createDataFrame([("M", i, i, *x[:5], "kept") for i, x in enumerate(looks)], schema)
    got = [(r.action, r.why, r.side, r.net) for r in sorted(journal(df, 4, 3).collect(), key=lambda r: r.seq)]
    assert got == [x[5:] for x in looks]
    once = [(r.action, r.why) for r in sorted(journal(df, 0, 0, most=1).collect(), key=lambda r: r.seq)]
    assert once[5] == ("close", "flip") and once[7] == ("none", "candle full")
    assert journal(df.limit(0), 4, 3).count() == 0
