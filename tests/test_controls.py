"""Controls against plain loops."""

import random
from collections import Counter
from math import sqrt
from statistics import correlation, mean, median

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import controls as O

from .test_pacing import HOUR, PRINT, prints


def test_drawn_levels_keep_counts_and_ranges(spark):
    levels = spark.createDataFrame([("A", i, "x") for i in range(400)] + [("B", 7, "x"), ("B", 7, "x"), ("C", 1, "x"), ("D", 1, "x")], "instrument string, level long, extra string")
    ranges = spark.createDataFrame([("A", 100, 109), ("B", -3, 3), ("C", 5, 5)], "instrument string, lo long, hi long")
    got = O.drawn_levels(levels, ranges, ["instrument"], 3).collect()
    assert Counter(r.instrument for r in got) == {"A": 400, "B": 2}  # C has no width, D no range
    seen = Counter(r.level for r in got if r.instrument == "A")
    assert set(seen) == set(range(100, 110)) and min(seen.values()) > 15
    assert sorted(got) == sorted(O.drawn_levels(levels, ranges, ["instrument"], 3).collect()) != sorted(O.drawn_levels(levels, ranges, ["instrument"], 4).collect())


def test_against_control(spark):
    of = lambda *ns: spark.createDataFrame([(n, i) for n, k in zip(("a", "b", "c"), ns) for i in range(k)], "label string, extra long")
    got = {r.label: r for r in O.against_control(of(30, 10, 0), of(45, 30, 5), "label").collect()}
    assert (got["c"].n, got["c"].share, got["c"].control_share) == (0, 0.0, 5 / 80)
    p = 75 / 120
    assert got["a"].z == pytest.approx((30 / 40 - 45 / 80) / sqrt(p * (1 - p) * (1 / 40 + 1 / 80)))
    assert [r.z for r in O.against_control(of(3, 0, 0), of(0, 0, 0), "label").collect()] == [None]
    assert O.against_control(of(0, 0, 0), of(0, 0, 0), "label").count() == 0


def test_checkpoints_and_what_remains_against_a_loop(spark):
    rows, bar, marks = prints(12, 40, 900, "MN"), 6 * HOUR, [0.2, 0.6]
    c = O.checkpoints(spark.createDataFrame(rows, PRINT), 6 * 3600, marks)
    bars, want = {}, {}
    for m, us, _, px, sz, side, _ in rows:
        bars.setdefault((m, us // bar), []).append((us % bar, px, sz, {"B": sz, "A": -sz}.get(side, 0)))
    for (m, b), v in bars.items():
        for mark in marks:
            if seen := [x for x in v if x[0] < mark * bar]:
                want[m, b * bar, mark] = (seen[-1][1] - v[0][1], v[-1][1] - seen[-1][1], sum(x[3] for x in seen), sum(x[2] for x in seen))
    assert {(r.instrument, r.bar_us, r.mark): (r.realised, r.remaining, r.delta, r.volume) for r in c.collect()} == want
    readings = {"momentum": F.col("realised"), "delta": F.col("delta"), "oracle": F.col("remaining"), "none": F.lit(None)}
    got = {(r.mark, r.reading): r for r in O.remaining_calls(c, readings, 50).collect()}
    assert set(got) == {(m, n) for m in marks for n in ("momentum", "delta", "oracle")}
    for mark in marks:
        own = [v for k, v in want.items() if k[2] == mark and v[1]]
        up = mean(v[1] > 0 for v in own)
        for name, xs in (("momentum", [v[0] for v in own]), ("delta", [v[2] for v in own]), ("oracle", [v[1] for v in own])):
            r, sided = got[mark, name], [(x, v[1]) for x, v in zip(xs, own) if x]
            rate = mean((x > 0) == (y > 0) for x, y in sided)
            z = (rate - max(up, 1 - up)) / sqrt(0.25 / len(sided))
            assert (r.n, r.used) == (len(own), len(sided)) and r.rate == pytest.approx(rate) and r.z == pytest.approx(z)
            assert r["corr"] == pytest.approx(correlation(xs, [v[1] for v in own])) and r.verdict == ("real" if z >= 3 else "marginal" if z >= 2 else "nothing")
        assert got[mark, "oracle"].verdict == "real"


def test_states_of_two_lines(spark):
    case = [(0.5, 0.5), (-0.5, -0.5), (0.5, -0.4), (0.4, -0.5), (-0.5, 0.5), (0.25, 0.25), (0.5, 0.1), (0.5, None)]
    got = [r.s for r in spark.createDataFrame([(i, *c) for i, c in enumerate(case)], "i long, b double, t double").orderBy("i").select(O.two_line_state(F.col("b"), F.col("t"), 0.25).alias("s")).collect()]
    assert got == ["both_up", "both_down", "book_leads", "tape_leads", "tape_leads", "flat", "flat", "flat"]


def test_travel_against_a_loop(spark):
    rng, rows = random.Random(7), []
    for m in "AB":
        px = 100
        for i in range(700):
            px += rng.choice([-2, -1, 0, 1, 2])
            if rng.random() < 0.97:
                rows.append((m, i * HOUR, px, rng.choice(["up", "up", "down", "rare"] if i < 60 else ["up", "down"]), "x"))
    at = {(m, t): px for m, t, px, *_ in rows}
    got = {(r.horizon, r.state): r for r in O.travel_by_state(spark.createDataFrame(rows, "instrument string, at_us long, px long, state string, extra string"), 3600, [1, 3], 50).collect()}
    for h in (1, 3):
        moves = [(s, at[m, t + h * HOUR] - px) for m, t, px, s, _ in rows if all((m, t + j * HOUR) in at for j in range(1, h + 1))]
        base = mean(v > 0 for _, v in moves)
        for state in ("all", "up", "down", "rare"):
            v, r = [x for s, x in moves if state in ("all", s)], got[h, state]
            assert r.n == len(v) and r.indep == pytest.approx(len(v) / h)
            if state == "rare":
                assert (r.median, r.travel, r.up, r.z, r.verdict) == (None,) * 5
                continue
            assert r.median == median(v) and r.mean == pytest.approx(mean(v)) and r.travel == median(map(abs, v)) and r.up == pytest.approx(mean(x > 0 for x in v))
            if state != "all":
                assert r.z == pytest.approx((mean(x > 0 for x in v) - base) / sqrt(base * (1 - base) * h / len(v)))
