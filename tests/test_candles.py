"""Signals of a running candle by truth table, their score and calibration against plain loops."""

import random

import pytest

from tapeloom.operators import candles as O

ROW = "id long, open long, high long, low long, last long, buy long, sell long, imbalance double, impact_ratio double, impact_confident boolean, aggressor_up boolean, aggression long, pa double, vwap double, vwap_sd double, trend string, zone string, zone_fresh boolean, magnet_bps double, magnet_notional double, signals_ string"
NAMES = [x.split()[0] for x in ROW.split(", ")][1:-1]
ABSORBED = {"impact_ratio": 0.1, "impact_confident": True, "aggressor_up": True, "aggression": 50}

TABLE = [
    ({}, {}),
    ({"buy": 70, "sell": 30}, {"flow": 0.4}),
    ({"buy": 52, "sell": 48}, {"flow": 0.0}),
    ({"buy": 0, "sell": 0}, {}),
    ({"buy": 0, "sell": 9}, {"flow": -1.0}),
    ({"buy": 70, "sell": 30, **ABSORBED}, {"flow": 0.0, "absorption": -0.9}),
    ({"buy": 70, "sell": 30, **ABSORBED, "impact_ratio": 0.5}, {"flow": 0.4}),
    ({"buy": 70, "sell": 30, **ABSORBED, "impact_confident": False}, {"flow": 0.4}),
    ({**ABSORBED, "aggressor_up": False, "impact_ratio": -0.7}, {"absorption": 1.0}),
    ({**ABSORBED, "impact_ratio": 2.5}, {"absorption": 0.5}),
    ({**ABSORBED, "impact_ratio": 9.0, "aggressor_up": False}, {"absorption": -1.0}),
    ({**ABSORBED, "aggression": 0}, {}),
    ({"high": 120, "low": 100, "last": 115}, {"position": 0.5}),
    ({"high": 120, "low": 100, "last": 115, **ABSORBED}, {"position": 0.2, "absorption": -0.9}),
    ({"high": 200, "low": 100, "last": 154}, {"position": 0.0}),
    ({"high": 120, "low": 120, "last": 120}, {}),
    ({"imbalance": 0.1}, {"imbalance": 0.0}),
    ({"imbalance": -0.3}, {"imbalance": -0.3}),
    ({"pa": -0.35}, {"price_action": -0.35}),
    ({"pa": 0.0}, {}),
    ({"vwap": 100.0, "vwap_sd": 5.0, "last": 110}, {"vwap": -0.5}),
    ({"vwap": 100.0, "vwap_sd": 5.0, "last": 90}, {"vwap": 0.5}),
    ({"vwap": 100.0, "vwap_sd": 5.0, "last": 109}, {}),
    ({"trend": "up"}, {"structure": 0.6}),
    ({"trend": "down"}, {"structure": -0.6}),
    ({"zone": "supply", "zone_fresh": True}, {"zone": -0.8}),
    ({"zone": "demand", "zone_fresh": False}, {"zone": 0.35}),
    ({"magnet_bps": 1e-9, "magnet_notional": 6e7}, {"magnet": 1.0}),
    ({"magnet_bps": -1e-9, "magnet_notional": 1e7}, {"magnet": -0.2}),
    ({"magnet_bps": 200.0, "magnet_notional": 9e9}, {}),
    ({"magnet_bps": 10.0, "magnet_notional": 0.0}, {}),
    ({"buy": 90, "sell": 10, "high": 20, "low": 10, "last": 20, "trend": "down", "imbalance": 0.05}, {"flow": 0.8, "position": 1.0, "structure": -0.6, "imbalance": 0.0}),
    ({"zone": "demand", "zone_fresh": True, "pa": 0.5, "trend": "up"}, {"zone": 0.8, "price_action": 0.5, "structure": 0.6}),
]


def test_signals_and_score(spark):
    rows = [(i, *(case.get(n) for n in NAMES), "clash") for i, (case, _) in enumerate(TABLE)]
    x = spark.createDataFrame(rows, ROW).selectExpr("*", "0.25D AS elapsed")
    got = {r.id: r for r in O.score(O.signals(x)).collect()}
    for i, (case, want) in enumerate(TABLE):
        r, own = got[i], {n: v for n, v in got[i].signals.asDict().items() if v is not None}
        assert own == pytest.approx(want, abs=1e-8), case
        total = sum(O.WEIGHTS[n] for n in own)
        score = sum(O.WEIGHTS[n] * v for n, v in own.items()) / total if total else 0.0
        lean = "up" if score > 0.15 else "down" if score < -0.15 else "flat"
        sided = [v for v in own.values() if v]
        agreement = 0.0 if lean == "flat" else sum((v > 0) == (lean == "up") for v in sided) / len(sided)
        assert r.score == pytest.approx(score) and r.lean == lean and r.agreement == pytest.approx(agreement)
        assert r.confidence == pytest.approx(0.5 * max(agreement, 0.3) * min(abs(score) / 0.5, 1.0))
    assert {r.lean for r in got.values()} == {"up", "down", "flat"}


def test_other_weights_leave_signals_out(spark):
    x = spark.createDataFrame([(0, *({"buy": 70, "sell": 30, "trend": "down"}.get(n) for n in NAMES), "")], ROW).selectExpr("*", "1.0D AS elapsed")
    w = {"flow": 3.0, "structure": 1.0}
    r = O.score(O.signals(x, w), w).first()
    assert r.score == pytest.approx((3 * 0.4 - 0.6) / 4) and len(r.signals) == 2


def test_bands_meet_at_their_lower_edges(spark):
    s = [-1.0, -0.5001, -0.5, -0.15, -0.1499, 0.0, 0.1499, 0.15, 0.4999, 0.5, 1.0]
    got = [r.b for r in spark.createDataFrame([(i, v) for i, v in enumerate(s)], "i long, s double").orderBy("i").select(O.band(O.F.col("s")).alias("b")).collect()]
    assert got == ["strong down"] * 2 + ["down", "flat", "flat", "flat", "flat", "up", "up", "strong up", "strong up"]


def test_calibration_knows_closed_candles_alone(spark):
    rng = random.Random(4)
    rows = [(m, i, rng.choice(["up", "down", "flat"]), rng.choice([True, False, False])) for m in "AB" for i in range(90)]
    rows[20] = (*rows[20][:3], None)
    df = spark.createDataFrame(rows, "instrument string, bar_us long, band string, up boolean")
    rated = 0
    for r in O.calibrated(df).collect():
        before = [x for x in rows if x[0] == r.instrument and x[1] < r.bar_us and x[3] is not None]
        own = [x[3] for x in before if x[2] == r.band]
        assert (r.samples, r.in_band) == (len(before), len(own))
        assert r.rate == (pytest.approx(sum(own) / len(own)) if len(before) >= 40 and len(own) >= 10 else None)
        rated += r.rate is not None
    assert rated > 50
    table = {r.band: (r.n, r.up_rate) for r in O.calibration(df).collect()}
    for b in ("up", "down", "flat"):
        own = [x[3] for x in rows if x[2] == b and x[3] is not None]
        assert table[b] == (len(own), pytest.approx(sum(own) / len(own)))
    assert table["strong up"] == table["strong down"] == (0, None)
    assert O.calibration(df.limit(0)).count() == 5
