"""Brackets whose stop moves against a loop over the bars; correlations of series that don't vary."""

import random

import pytest

from tapeloom.operators import outcomes as O
from tapeloom.operators import studies as S
from tapeloom.operators import validation as V

PATH = "event_id long, instrument string, side int, entry long, extra string, path array<struct<bar_us:long,hi:long,lo:long,close:long>>"


def by_hand(side, entry, path, target, stop, breakeven, trail, arm):
    best = 0
    for i, (_, hi, lo, close) in enumerate(path, 1):
        up, down = (hi - entry, lo - entry) if side > 0 else (entry - lo, entry - hi)
        line = -stop
        if trail is not None and best >= arm:
            line = max(line, best - trail)
        if breakeven is not None and best >= breakeven:
            line = max(line, 0)
        if down <= line:
            return "STOP", line, i
        if up >= target:
            return "TARGET", target, i
        best = max(best, up)
    return "OPEN", (path[-1][3] - entry) * side if path else 0, len(path)


@pytest.mark.parametrize("breakeven, trail, arm", [(None, None, 3), (2, None, 3), (None, 2, 3), (3, 1, 2)])
def test_brackets_against_a_loop(spark, breakeven, trail, arm):
    rng, rows = random.Random(6), []
    for i in range(300):
        px, path = 100, []
        for t in range(rng.randrange(0, 12)):
            px += rng.randrange(-2, 3)
            path.append((t, px + rng.randrange(3), px - rng.randrange(3), px))
        rows.append((i, "M", rng.choice([1, -1]), 100, "x", path))
    got = {r.event_id: (r.outcome, r.net, r.bars) for r in O.brackets(spark.createDataFrame(rows, PATH), 5, 3, breakeven, trail, arm).collect()}
    assert got == {i: by_hand(side, entry, path, 5, 3, breakeven, trail, arm) for i, _, side, entry, _, path in rows}
    assert {o for o, *_ in got.values()} == {"STOP", "TARGET", "OPEN"}
    if breakeven:
        assert any(o == "STOP" and n >= 0 for o, n, _ in got.values())


def test_correlation_of_what_does_not_vary_is_null(spark):
    df = spark.createDataFrame([("M", i, 1.0, float(i % 3), float(i)) for i in range(12)], "instrument string, bar_us long, flat double, x double, y double")
    assert {r["corr"] for r in V.lead_lag(df, "flat", "x", "bar_us", 1).collect()} == {None}
    assert {r["corr"] for r in S.rotation_floor(df, "flat", "x", [1, 2]).collect()} == {None}
    assert max(r["corr"] for r in V.lead_lag(df, "y", "y", "bar_us", 1).collect()) == pytest.approx(1.0)
