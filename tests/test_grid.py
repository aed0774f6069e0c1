"""Moves after events against the grid, by plain loops."""

import random
from bisect import bisect_left

import pytest

from tapeloom.operators import grid as O
from tapeloom.operators import machines as M

TOUCH = "instrument string, us long, seq long, bid_px long, ask_px long, bid_sz long, ask_sz long, state string"
EVENT = "instrument string, us long, state string, mid2 long"


def touches(seed, n, span, names="MN"):
    rng, out = random.Random(seed), []
    for m in names:
        px = 100
        for us in sorted(rng.randrange(span) for _ in range(n)):
            px += rng.choice([-1, 0, 1])
            out.append((m, us, len(out), rng.choice([px, px, px, 0]), px + rng.choice([1, 2]), rng.randrange(1, 9), rng.randrange(1, 9), "x"))
    return out


def loop(rows, grid):
    """Samples as they are taken live: the first touch at or after the next grid point, which then jumps past it."""
    out, due = {}, {}
    for m, us, _, bid, ask, *_ in rows:
        if bid <= 0 or us < due.setdefault(m, us):
            continue
        out.setdefault(m, []).append((us, bid + ask))
        while due[m] <= us:
            due[m] += grid
    return out


@pytest.mark.parametrize("block", [3_000, 50_000, 10**9])
def test_against_a_loop(spark, block):
    grid, horizons = 700, [0.002, 0.02]
    rows = [r for r in touches(2, 600, 400_000) if not 150_000 < r[1] < 230_000]
    rng = random.Random(8)
    events = [(rng.choice("MNZ"), rng.randrange(420_000), rng.choice(["up", "down", "rare"] if i < 9 else ["up", "down"]), 0) for i in range(500)]
    df = O.samples(spark.createDataFrame(rows, TOUCH), grid)
    sp = loop(rows, grid)
    assert sorted(tuple(r) for r in df.collect()) == sorted((m, *s) for m, v in sp.items() for s in v)
    moves = {}
    for m, v in sp.items():
        at = [u for u, _ in v]
        for i, (us, mid) in enumerate(v):
            for h in horizons:
                j = bisect_left(at, us + round(h * 1e6))
                if j < len(v):
                    moves[m, us, h] = (v[j][1] - mid) / 2
    assert {(r.instrument, r.us, r.horizon_s): r.move for r in O.forward(df, horizons, block).collect()} == moves
    want, ctrl = {}, {}
    for (m, _, h), x in moves.items():
        ctrl.setdefault((m, h), []).append(x)
    for m, us, state, _ in events:
        at = [u for u, _ in sp.get(m, [])]
        j = bisect_left(at, us)
        for h in horizons:
            if j < len(at) and (m, at[j], h) in moves:
                want.setdefault((m, h, state), []).append(moves[m, at[j], h])
    got = {(r.instrument, r.horizon_s, r.state): r for r in O.against_grid(spark.createDataFrame(events, EVENT), df, horizons, block, 20).collect()}
    assert set(got) == set(want) and {r.verdict for r in got.values()} > {"too few", "nothing"}
    for k, v in want.items():
        r, c = got[k], ctrl[k[:2]]
        up, base = sum(x > 0 for x in v) / len(v), sum(x > 0 for x in c) / len(c)
        assert (r.n, r.n_grid) == (len(v), len(c)) and (r.up, r.mean, r.up_grid, r.mean_grid) == pytest.approx((up, sum(v) / len(v), base, sum(c) / len(c)))
        assert r.z == (pytest.approx((up - base) / max(1e-12, up * (1 - up) / len(v)) ** 0.5) if len(v) >= 20 else None)


def test_nothing_to_look_at(spark):
    none = O.samples(spark.createDataFrame([], TOUCH), 50)
    e = spark.createDataFrame([("M", 1, "up", 0)], EVENT)
    assert O.against_grid(e, none, [1.0], 1000).count() == 0 and O.forward(none, [1.0], 1000).count() == 0
    assert [r.then for r in O.at_or_after(e, "us", none, 1000).collect()] == [None]


def test_asks_are_mirrored_bids(spark):
    s = 1_000_000
    rows = [("M", 0, 1, 100, 102, 5, 9, ""), ("M", s, 2, 100, 103, 5, 9, ""), ("M", 2 * s, 3, 99, 102, 5, 9, ""), ("M", 3 * s, 4, 99, 104, 5, 2, ""), ("M", 9 * s, 5, 99, 104, 5, 2, "")]
    e = M.inside_events(O.both_sides(spark.createDataFrame(rows, TOUCH)), 3.0, 0.3, ("instrument", "side")).collect()
    assert {(r.side, r.seq, r.kind, abs(r.level), r.result, r.at_us) for r in e} == {("ask", 2, "VACATED", 102, "FAILED", 2 * s), ("bid", 3, "VACATED", 100, "PERMANENT", 9 * s), ("ask", 4, "VACATED", 102, "PERMANENT", 9 * s)}
