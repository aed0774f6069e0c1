"""Who wins a time frame, by truth table and against plain loops."""

from statistics import median

import pytest

from tapeloom.operators import bars as B
from tapeloom.operators import contest as O

from .test_pacing import PRINT, prints

HOUR = 3_600_000_000
READING = "instrument string, at_us long, seconds long, open long, high long, low long, last long, buy double, sell double, trades long, measured boolean, span long, elapsed_s double, typical_bps double, typical_notional double, coverage double, seeded boolean, winner string"
USUAL = {"open": 100_000, "high": 100_200, "low": 99_800, "last": 100_000, "buy": 500.0, "sell": 500.0, "trades": 10, "measured": True, "span": 1, "elapsed_s": 3600.0, "typical_bps": 10.0, "typical_notional": 1000.0, "coverage": 1.0, "seeded": True}

# a usual move of 10 basis points makes 3.5 flat in a whole bar
TABLE = [
    ({"buy": 800.0, "sell": 200.0, "last": 100_100}, "buyers", False, False, 0.75),
    ({"buy": 800.0, "sell": 200.0}, "sellers", True, False, 1.0),
    ({"buy": 800.0, "sell": 200.0, "last": 100_035}, "sellers", True, False, 0.9125),
    ({"buy": 200.0, "sell": 800.0, "last": 99_900}, "sellers", False, False, 0.75),
    ({"buy": 200.0, "sell": 800.0, "last": 100_100}, "buyers", True, False, 0.75),
    ({"buy": 80.0, "sell": 20.0}, "contested", False, False, 0.5),
    ({"buy": 80.0, "sell": 20.0, "last": 100_100}, "buyers", False, False, 0.75),
    ({"buy": 80.0, "sell": 20.0, "high": 100_010, "low": 99_990}, "contested", False, True, 0.0),
    ({"last": 100_100}, "buyers", False, False, 0.25),
    ({"last": 100_034}, "contested", False, False, 0.085),
    ({"last": 99_965}, "sellers", False, False, 0.0875),
    ({"buy": 800.0, "sell": 200.0, "trades": 2}, "contested", False, True, 0.0),
    ({"buy": 800.0, "sell": 200.0, "trades": 2, "measured": False}, "sellers", True, False, 0.6),
    ({"buy": 800.0, "sell": 200.0, "seeded": False}, "contested", False, True, 0.0),
    ({"buy": None, "sell": None, "last": 100_100}, "buyers", False, False, 0.25),
    ({"buy": 800.0, "sell": 200.0, "last": 100_040, "elapsed_s": 900.0}, "buyers", False, False, 0.6),
    ({"buy": 800.0, "sell": 200.0, "last": 100_100, "span": 3, "typical_notional": 300.0}, "buyers", False, False, 0.6443),
    ({"buy": 800.0, "sell": 200.0, "last": 100_100, "coverage": 0.5}, "buyers", False, False, 0.375),
    ({"buy": 800.0, "sell": 200.0, "last": 100_044, "typical_bps": None, "typical_notional": None}, "buyers", False, False, 0.61),
    ({"buy": 800.0, "sell": 200.0, "last": 100_043, "typical_bps": None, "typical_notional": None}, "sellers", True, False, 0.8925),
]


def test_truth_table(spark):
    rows = [("M", i, 3600, *{**USUAL, **c}.values(), "extra") for i, (c, *_) in enumerate(TABLE)]
    got = {r.at_us: r for r in O.judged(spark.createDataFrame(rows, READING)).collect()}
    for i, (case, winner, absorbing, forming, strength) in enumerate(TABLE):
        r = got[i]
        assert (r.winner, r.absorbing, r.forming) == (winner, absorbing, forming), case
        assert r.strength == pytest.approx(strength, abs=1e-9), case
        assert r.signed == pytest.approx({"buyers": 1, "sellers": -1, "contested": 0}[winner] * strength)
        assert r.learned == ("typical_bps" not in case)


def test_frames_against_each_other(spark):
    case = {0: "bb", 1: "bs", 2: "bc", 3: "cs", 4: "cc", 5: "b", 6: "bsc", 7: "csb"}
    name, sign = {"b": "buyers", "s": "sellers", "c": "contested"}, {"b": 1, "s": -1, "c": 0}
    frames = [14_400, 3600, 900]
    rows = [("M", i, f, name[w], 0.5 * sign[w]) for i, ws in case.items() for f, w in zip(frames, ws)]
    got = {r.at_us: r for r in O.confronted(spark.createDataFrame(rows, "instrument string, at_us long, seconds long, winner string, signed double"), frames).collect()}
    assert {i: r.shape for i, r in got.items()} == {0: "aligned", 1: "conflict", 2: "aligned", 3: "aligned", 4: "mixed", 5: "single", 6: "mixed", 7: "mixed"}
    for i, ws in case.items():
        score = sum(0.5 * sign[w] * f**0.5 for f, w in zip(frames, ws))
        assert got[i].score == pytest.approx(score)
        assert got[i].consensus == ("contested" if abs(score) < 1e-9 else "buyers" if score > 0 else "sellers")
        assert got[i].readings == len(ws) and got[i].conflicted == ({"b", "s"} <= set(ws))
    assert O.confronted(spark.createDataFrame([], "instrument string, at_us long, seconds long, winner string, signed double"), frames).count() == 0


def test_readings_of_running_bars_against_a_loop(spark):
    frames, rows = [3600, 4 * 3600], prints(5, 6, 400)
    p = spark.createDataFrame(rows, PRINT)
    n = learned = 0
    bars = {}
    for m, us, seq, px, sz, side, _ in rows:
        for f in frames:
            bars.setdefault((m, f), {}).setdefault(us // (f * 1_000_000), []).append((us, px, sz, side))
    for r in O.measured(p, frames, 3600).collect():
        own = bars[r.instrument, r.seconds]
        b = r.at_us // (r.seconds * 1_000_000)
        seen = [x for x in own[b] if x[0] < r.at_us + HOUR]
        px = [x[1] for x in seen]
        assert (r.open, r.high, r.low, r.last, r.trades) == (px[0], max(px), min(px), px[-1], len(px))
        assert r.buy == sum(x[1] * x[2] for x in seen if x[3] == "B") and r.sell == sum(x[1] * x[2] for x in seen if x[3] == "A")
        assert r.elapsed_s == (r.at_us + HOUR) / 1e6 - b * r.seconds and r.seeded == (b > min(own))
        before = [own[k] for k in sorted(own) if k < b][-20:]
        assert (r.typical_bps is None) == (len(before) < 4)
        if len(before) >= 4:
            learned += 1
            assert r.typical_bps == pytest.approx(median(abs(x[-1][1] - x[0][1]) / x[0][1] * 1e4 for x in before))
            assert r.typical_notional == pytest.approx(median(sum(y[2] for y in x) * x[-1][1] for x in before))
        n += 1
    assert n > 400 and learned > 300


@pytest.mark.parametrize("seconds", [300, 3600])
def test_readings_of_closed_bars_against_a_loop(spark, seconds):
    p = spark.createDataFrame(prints(6, 2, 300), PRINT)
    bars = {}
    for b in B.time_bars(p, seconds).orderBy("bar_us").collect():
        bars.setdefault(b.instrument, []).append(b)
    where = {(b.instrument, b.bar_us): i for v in bars.values() for i, b in enumerate(v)}
    span = 1 if seconds == 300 else 3
    for r in O.inferred(B.time_bars(p, seconds), seconds).collect():
        i = where[r.instrument, r.at_us]
        own, before = bars[r.instrument][max(0, i - span + 1) : i + 1], bars[r.instrument][max(0, i - span - 19) : max(0, i - span + 1)]
        share = [(b.close - b.low) / (b.high - b.low) if b.high > b.low else 0.5 for b in own]
        assert r.buy == pytest.approx(sum(b.volume * b.close * s for b, s in zip(own, share))) and r.buy + r.sell == pytest.approx(sum(b.volume * b.close for b in own))
        assert (r.open, r.high, r.low, r.last, r.span) == (own[0].open, max(b.high for b in own), min(b.low for b in own), own[-1].close, len(own))
        if len(before) < 4:
            assert r.typical_bps is None
        else:
            assert r.typical_bps == pytest.approx(median(abs(b.close - b.open) / b.open * 1e4 for b in before))
