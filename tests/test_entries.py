"""Composite entries and setups of footprints against plain loops."""

import random
from statistics import mean, pstdev

import pytest

from tapeloom.operators import bars as B
from tapeloom.operators import entries as O

from .test_pacing import HOUR, PRINT, prints

SLICE = "instrument string, at_us long, close long, ofi long, delta long, bid_sz long, ask_sz long"
FRAMES = [2 * 3600, 6 * 3600]


def sign(x):
    return (x > 0) - (x < 0)


def made(seed, n=160):
    rng = random.Random(seed)
    return [(m, i * HOUR, 100 + rng.randrange(-4, 5), rng.randrange(-20, 21), rng.randrange(-5, 6), rng.choice([None, 0, 1, 4, 9]), rng.choice([None, 0, 1, 4, 9])) for m in "AB" for i in range(n) if rng.random() < 0.9]


def by_hand(rows, window, baseline, enter, ratio, back):
    """Each slice's sides from all that came before it, built anew."""
    out = {}
    for m in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == m]
        for i, (_, at, close, _, _, b, a) in enumerate(own):
            races = [sum(x[3] for x in own[j - window + 1 : j + 1]) for j in range(window - 1, i + 1)][-baseline:]
            z = (races[-1] - mean(races)) / pstdev(races) if len(races) == baseline and pstdev(races) > 0 else None
            ways = {sign(close - next(x[2] for x in own if x[1] // (f * 1_000_000) == at // (f * 1_000_000))) for f in FRAMES}
            book = 0 if not a or not b else 1 if b >= a * ratio else -1 if a >= b * ratio else 0
            d = sign(sum(x[4] for x in own[i - back + 1 : i + 1])) if i >= back - 1 else 0
            out[m, at] = (z, {"ofi": sign(z) if z is not None and abs(z) >= enter else 0, "agree": ways.pop() if len(ways) == 1 else 0, "book": book, "delta": d})
    return out


@pytest.mark.parametrize("rules", [["ofi"], ["agree"], ["book", "delta"], ["ofi", "agree", "book"], ["delta", "agree"]])
def test_entries_against_a_loop(spark, rules):
    rows = made(9)
    want = by_hand(rows, 4, 12, 0.8, 2.0, 3)
    s = O.sided(spark.createDataFrame(rows, SLICE), FRAMES, 4, 12, 0.8, 2.0, 3)
    got = {(r.instrument, r.at_us): r for r in s.collect()}
    assert got.keys() == want.keys()
    for k, (z, sides) in want.items():
        assert {n: got[k][n] for n in sides} == sides and (got[k].z is None if z is None else got[k].z == pytest.approx(z))
    taken, free = set(), {}
    for m, at in sorted(want):
        sides = {want[m, at][1][r] for r in rules}
        if len(sides) == 1 and 0 not in sides and at >= free.get(m, 0):
            taken.add((m, at, sides.pop()))
            free[m] = at + 5 * HOUR
    assert taken and {(r.instrument, r.at_us, r.side) for r in O.entries(s, rules, 5 * 3600).collect()} == taken


def test_unknown_rules_raise_and_no_rows_give_none(spark):
    s = O.sided(spark.createDataFrame([], SLICE), FRAMES, 4, 12, 0.8, 2.0, 3)
    assert O.entries(s, ["agree"], 60).count() == 0
    with pytest.raises(ValueError, match="dart"):
        O.entries(s, ["ofi", "dart"], 60)


def test_slices_without_a_book(spark):
    p = spark.createDataFrame(prints(2, 1, 40, "M"), PRINT)
    none = spark.createDataFrame([], "instrument string, us long, seq long, bid_px long, ask_px long, bid_sz long, ask_sz long, extra string")
    got = O.slices(p, none, 3600).collect()
    assert len(got) == B.time_bars(p, 3600).count() and {(r.ofi, r.bid_sz) for r in got} == {(0, None)}


def test_setups_against_a_loop(spark):
    rng = random.Random(8)
    levels, bars = [], {}
    for i in range(150):
        lo, n, lean = rng.randrange(50, 60), rng.randrange(1, 9), rng.choice(["buy", "sell", "both"])
        px = list(range(lo, lo + n))
        bars[i] = (px[0], px[-1], rng.choice(px))
        for p in px:
            on = rng.random() < 0.6
            levels.append(("M", i, p, rng.randrange(4), rng.randrange(4), on and lean != "sell", on and lean != "buy" and not (lean == "both" and rng.random() < 0.8)))
    flags = spark.createDataFrame(levels, "instrument string, bar_us long, px long, bid_vol long, ask_vol long, buy_flag boolean, sell_flag boolean")
    b = spark.createDataFrame([("M", i, h, lo, c, "x") for i, (lo, h, c) in bars.items()], "instrument string, bar_us long, high long, low long, close long, extra string")
    want = set()
    for i, (low, high, close) in bars.items():
        buys, sells = ({x[2]: x[4 if s else 3] for x in levels if x[1] == i and x[5 if s else 6]} for s in (1, 0))
        if bool(buys) == bool(sells):
            continue
        side, own = (1, buys) if buys else (-1, sells)
        best = max(own.values())
        want.add((i, side, close, "single", min(p for p in own if own[p] == best), 1, best))
        runs = [range(a, z + 1) for a in own for z in own if z >= a and all(p in own for p in range(a, z + 1)) and a - 1 not in own and z + 1 not in own]
        longest = min(runs, key=lambda r: (-len(r), r[0]))
        if len(longest) >= 2:
            far = longest[0] if side > 0 else longest[-1]
            edge = far <= low + 1 if side > 0 else far >= high - 1
            want |= {(i, side, close, k, far, len(longest), sum(own[p] for p in longest)) for k in (["stacked", "extreme"] if edge else ["stacked"])}
    got = O.setups(flags, b, 60, 2, 1).collect()
    assert {(r.bar_us, r.side, r.entry_px, r.kind, r.flag_px, r.run, r.volume) for r in got} == want and len(got) == len(want)
    assert {x[3] for x in want} == {"single", "stacked", "extreme"} and all(r.at_us == r.bar_us + 60_000_000 for r in got)
    assert O.setups(flags.limit(0), b, 60).count() == 0
