"""Volume pace, clock windows and shapes of bars against plain loops."""

import random
from statistics import median

import pytest

from tapeloom.operators import pacing as O

HOUR, DAY = 3_600_000_000, 86_400_000_000
PRINT = "instrument string, us long, seq long, px_ticks long, sz long, side string, extra string"
BAR = "instrument string, bar_us long, measured boolean, who string, move long, wide boolean, position double, pace double, impact double, through string, at_above boolean, side string"


def prints(seed, days, n, names="MN"):
    rng, out = random.Random(seed), []
    for m in names:
        for us in sorted(rng.randrange(days * DAY) for _ in range(n)):
            out.append((m, us, len(out), 100 + rng.randrange(-9, 10), rng.choice([0, 1, 2, 5, 20]), rng.choice("ABN"), "x"))
    return out


@pytest.mark.parametrize("unit", [None, 2, 3])
def test_curves_and_pace_against_a_loop(spark, unit):
    rows, bar, slices, back, least = [r for r in prints(3, 12, 900) if r[1] // (3 * HOUR) % 9], 12 * HOUR, 4, 5, 4
    p = spark.createDataFrame(rows, PRINT)
    c = O.curves(p, 12 * 3600, slices, back, least, unit and unit * 3600)
    got = {(r.instrument, r.day): r for r in c.collect()}
    bars, first = {}, {}
    for m, us, _, px, sz, *_ in rows:
        if sz:
            bars.setdefault((m, us // bar), []).append((us % bar, px, sz))
    for m, b in bars:
        first[m] = min(first.get(m, b), b)
    whole = {k: v for k, v in bars.items() if (len({u // (unit * HOUR) for u, _, _ in v}) == 12 // unit if unit else k[1] > first[k[0]])}
    assert whole and len(whole) < len(bars)
    learned = 0
    for (m, d), r in got.items():
        seen = [v for (n, b), v in whole.items() if n == m and d - back <= b // 2 < d]
        assert r.samples == len(seen)
        if seen:
            assert r.normal_volume == median(sum(x[2] for x in v) for v in seen) and r.normal_range == median(max(x[1] for x in v) - min(x[1] for x in v) for v in seen)
        assert (r.shares is None) == (len(seen) < least)
        if r.shares:
            learned += 1
            assert r.shares == pytest.approx([median(sum(x[2] for x in v if x[0] * slices // bar <= i) / sum(x[2] for x in v) for v in seen) for i in range(slices)])
            assert r.shares[-1] == 1.0 and r.shares == sorted(r.shares)
    assert learned > 5
    states = set()
    for r in O.volume_pace(p, 12 * 3600, 3600, c).collect():
        own, day = [x for x in bars[r.instrument, r.bar_us // bar] if r.bar_us + x[0] < r.at_us + HOUR], got[r.instrument, r.bar_us // DAY]
        frac = (r.at_us + HOUR - r.bar_us) / bar
        share = frac
        if day.shares:
            k = min(int(frac * slices), slices - 1)
            share = max(1e-4, 1.0 if frac == 1 else ([0.0, *day.shares][k] + (day.shares[k] - [0.0, *day.shares][k]) * (frac * slices - k)))
        assert r.done == sum(x[2] for x in own) and r.share == pytest.approx(share) and r.learned == bool(day.shares)
        if day.normal_volume:
            pace = r.done / (day.normal_volume * share)
            wide = day.normal_range > 0 and r.range >= day.normal_range * frac**0.5 * 0.8
            want = ("paid_for" if wide else "absorbed") if pace >= 1.5 else ("thin" if wide else "no_fuel") if pace <= 0.6 else "paid_for" if wide else "unknown"
            assert r.pace == pytest.approx(pace) and r.state == want
        else:
            assert r.pace is None and r.state == "unknown"
        states.add(r.state)
    assert states == {"paid_for", "absorbed", "thin", "no_fuel", "unknown"}


def test_a_day_never_sees_itself(spark):
    rows = prints(4, 9, 500)
    whole = O.curves(spark.createDataFrame(rows, PRINT), 12 * 3600, 4, 5, 4)
    early = O.curves(spark.createDataFrame([r for r in rows if r[1] < 6 * DAY], PRINT), 12 * 3600, 4, 5, 4)
    assert sorted(map(str, whole.where("day < 6").collect())) == sorted(map(str, early.collect()))
    assert O.volume_pace(spark.createDataFrame([], PRINT), 3600, 60, whole).count() == 0


def test_clock_windows(spark):
    touch = "instrument string, us long, seq long, bid_px long, ask_px long, bid_sz long, ask_sz long"
    s = 10_000_000
    t = [("M", 1, 1, 100, 102, 5, 5), ("M", 2, 2, 100, 102, 9, 5), ("M", 3, 3, 103, 102, 9, 9), ("M", s + 1, 4, 101, 103, 4, 5), ("M", s + 2, 5, 99, 101, 4, 5), ("M", 2 * s, 6, 99, 101, 4, 4), ("M", 3 * s, 7, 99, 101, 4, 4), ("M", 4 * s, 8, 99, 101, 1, 4)]
    p = [("M", 2, 1, 101, 3, "B", ""), ("M", s + 1, 2, 101, 4, "A", ""), ("M", s + 5, 3, 100, 7, None, ""), ("M", 5 * s, 4, 99, 2, "N", ""), ("M", 5 * s, 5, 98, 0, "B", "")]
    got = {r.start_us // s: r for r in O.clock_windows(spark.createDataFrame(t, touch), spark.createDataFrame(p, PRINT), 10).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5}
    assert [(got[i].ofi, got[i].cvd, got[i].books, got[i].trades, got[i].unknown, got[i].unknown_sz) for i in range(6)] == [(4, 3, 2, 1, 0, 0), (0, -4, 2, 2, 1, 7), (1, 0, 1, 0, 0, 0), (0, 0, 1, 0, 0, 0), (-3, 0, 1, 0, 0, 0), (0, 0, 0, 2, 1, 2)]
    assert (got[1].mid2_open, got[1].mid2_close, got[1].last_open, got[1].last_close, got[5].mid2_open) == (204, 200, 101, 100, None)
    assert [got[i].flip for i in range(6)] == [False] * 4 + [True, False] and not got[4].confirmed
    r = O.window_summary(O.clock_windows(spark.createDataFrame(t, touch), spark.createDataFrame(p, PRINT), 10)).first()
    assert (r.windows, r.decided, r.agreed, r.flips, r.confirmed, r.unknown, r.trades) == (6, 1, 0, 1, 0, 2, 5)


def told(bar, before):
    """Shape and side of one bar from the side of the bar before."""
    _, _, measured, who, move, wide, position, pace, impact, through, above, _ = bar
    now = (move or 0) > 0 and "buy" or (move or 0) < 0 and "sell" or None
    away = {"buyers": "sell", "sellers": "buy"}.get(who)
    if not measured:
        return "unknown", None
    if through:
        return ("failed_breakout", "sell") if through == "above" else ("failed_breakdown", "buy")
    if above is not None and wide and position is not None and (position <= 0.35 if above else position >= 0.65):
        return "rejection", "sell" if above else "buy"
    if pace is not None and pace >= 1.5 and impact is not None and impact < 0.5:
        return ("exhaustion" if wide else "absorption"), away
    if before and now and before != now:
        return "reversal", now
    if impact is not None and impact > 2 and wide:
        return "expansion", now
    if wide and now and away and away != now:
        return "continuation", now
    return ("consolidation" if (pace is not None and pace <= 0.6) or not wide else "unknown"), None


def test_shapes_against_a_loop(spark):
    rng, rows = random.Random(11), []
    for m in "MN":
        for i in range(1500):
            rows.append((m, i, rng.random() > 0.03, rng.choice(["buyers", "sellers", None]), rng.choice([-3, -1, 1, 2, 0, None, -2, 4]), rng.choice([True, False, False, None]), rng.choice([None, 0.1, 0.5, 0.9]), rng.choice([None, 0.3, 1.0, 1.0, 2.0]), rng.choice([None, 0.2, 1.0, 3.0]), rng.choice([None] * 30 + ["above", "below"]), rng.choice([None, None, None, True, False]), "kept"))
    got = {(r.instrument, r.bar_us): r for r in O.shapes(spark.createDataFrame(rows, BAR)).collect()}
    before, seen, runs = {}, {}, 0
    for bar in rows:
        shape, side = told(bar, before.get(bar[0]))
        r = got[bar[0], bar[1]]
        assert (r.shape, r.lean, r.side) == (shape, side, "kept") and r.provisional == (shape in ("failed_breakout", "failed_breakdown", "exhaustion", "reversal"))
        runs += shape == "reversal" and seen.get("last") == "reversal"
        before[bar[0]], seen[shape], seen["last"] = side, 1, shape
    assert len(seen) == 11 and runs > 20
    assert O.shapes(spark.createDataFrame([], BAR)).count() == 0
