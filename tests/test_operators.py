"""Edges of the operators: ties, empty inputs, zero ranges, unknown aggressors, and state machines against plain loops."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import calendar as cal
from tapeloom.functions import market, stats, verdicts
from tapeloom.operators import bars, book, flow, graph, machines, outcomes, positions, profile, sequential, structure, studies, validation, zones
from tapeloom.sources import ingest

TAPE = "instrument string, us long, seq long, px_ticks long, sz long, side string"
S = 1_000_000


def tape(spark, rows, instrument="M0"):
    return spark.createDataFrame([(instrument, int(t * S), i, p, z, s) for i, (t, p, z, s) in enumerate(rows)], TAPE)


def one(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def value(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_time_bars_tie_by_seq_and_unknown_side(spark):
    b = bars.time_bars(tape(spark, [(0, 10, 1, "B"), (0, 11, 2, "A"), (59, 9, 4, "N"), (60, 7, 1, "B")]), 60)
    assert sorted(one(b, "bar_us", "open", "high", "low", "close", "volume", "delta")) == [(0, 10, 11, 9, 9, 7, -1), (60 * S, 7, 7, 7, 7, 1, 1)]
    assert bars.time_bars(tape(spark, []), 60).count() == 0


def test_volume_bars_split_prints(spark):
    b = bars.volume_bars(tape(spark, [(0, 10, 7, "B"), (1, 11, 25, "A")]), 10)
    assert sorted(one(b, "bar", "open", "close", "volume", "buy", "sell")) == [(0, 10, 11, 10, 7, 3), (1, 11, 11, 10, 0, 10), (2, 11, 11, 10, 0, 10), (3, 11, 11, 2, 0, 2)]


def test_schmitt_needs_entry(spark):
    xs = [0.1, 0.2, 0.1, 0.05, 0.1, -0.2, -0.1, 0.1, 0.2, -0.1]
    df = spark.createDataFrame([("M0", i, x) for i, x in enumerate(xs)], "instrument string, seq long, x double")
    got = [r.direction for r in flow.schmitt(df, "x", 0.15, 0.08).orderBy("seq").collect()]
    way, want = "flat", []
    for x in xs:
        way = "up" if x > 0.15 or (way == "up" and x > 0.08) else "down" if x < -0.15 or (way == "down" and x < -0.08) else "flat"
        want.append(way)
    assert got == want


def test_footprint_diagonals_and_value_area_tie(spark):
    levels = spark.createDataFrame([("M", 0, 10, 0, 9, 9), ("M", 0, 11, 3, 9, 12), ("M", 0, 12, 9, 0, 9)], "instrument string, bar_us long, px long, bid_vol long, ask_vol long, total long")
    flags = {r.px: (r.buy_flag, r.sell_flag) for r in profile.imbalances(levels, 3.0, 5).collect()}
    assert flags == {10: (False, False), 11: (True, False), 12: (False, False)}
    p = spark.createDataFrame([("M", 1, 5), ("M", 2, 9), ("M", 3, 5), ("M", 4, 9)], "k string, row long, volume long")
    assert one(profile.value_area(p, ["k"], 0.5), "poc", "val", "vah") == [(2, 1, 2)]


def test_profile_of_a_bar_without_range(spark):
    b = spark.createDataFrame([("M", 8, 8, 6), ("M", 0, 8, 8)], "instrument string, low long, high long, volume long")
    assert sorted(one(profile.bar_profile(b, ["instrument"], 4), "row", "volume")) == [(0, 4.0), (1, 4.0), (2, 6.0)]


def test_swings_take_the_leftmost_of_equals(spark):
    highs = [1, 2, 5, 5, 2, 1, 1]
    b = spark.createDataFrame([("M", i, h, -h) for i, h in enumerate(highs)], "instrument string, bar_us long, high long, low long")
    assert one(structure.swings(b, 2).where("kind = 'high'"), "bar_us", "confirmed_us") == [(2, 4)]


def test_barriers_stop_wins_ties(spark):
    p = tape(spark, [(0, 10, 1, "B"), (1, 15, 1, "B"), (1, 5, 1, "B")]).withColumn("px", F.col("px_ticks"))
    e = spark.createDataFrame([(1, "M0", 0, 1, 10)], "event_id long, instrument string, at_us long, side int, entry long")
    assert one(outcomes.triple_barrier(e, p, 3, 3, 10 * S), "outcome", "net") == [("STOP", -3)]
    assert one(outcomes.triple_barrier(e, p, 3, 3, 10 * S, True), "outcome", "net") == [("AMBIGUOUS", None)]


def test_range_join_against_nested_loops(spark):
    rng = random.Random(0)
    ps, es = [(rng.randrange(1000), i) for i in range(300)], [(i, rng.randrange(1000)) for i in range(40)]
    p = spark.createDataFrame([("M", t, i, 1) for t, i in ps], "instrument string, us long, seq long, px long")
    e = spark.createDataFrame([(i, "M", t) for i, t in es], "event_id long, instrument string, at_us long")
    want = sorted((i, s) for i, a in es for t, s in ps if a < t <= a + 70)
    for width in (None, 7, 5000):
        assert sorted(one(outcomes.range_join(e, p, 70, width), "event_id", "seq")) == want


def test_walk_of_a_book(spark):
    b = spark.createDataFrame([("M", 1, [(9, 5)], [(11, 5), (12, 5)]), ("M", 2, [(9, 5)], [])], "instrument string, seq long, bids array<struct<px:long,sz:long>>, asks array<struct<px:long,sz:long>>")
    got = {r.seq: (r.filled, r.worst, r.levels, r.exhausted) for r in book.walk(b, 7).collect()}
    assert got == {1: (7, 12, 2, False), 2: (0, None, 0, True)}


def test_zigzag_legs_join_up(spark):
    rng = random.Random(4)
    px = [100]
    for _ in range(800):
        px.append(px[-1] + rng.choice([-1, 0, 1]))
    legs = sequential.zigzag(tape(spark, [(i, p, 1, "B") for i, p in enumerate(px)]), 5).orderBy("from_seq").collect()
    assert len(legs) > 5
    for a, b in zip(legs, legs[1:]):
        assert a.to_seq == b.from_seq and a.way == -b.way
    assert all(px[x.to_seq] - px[x.from_seq] == x.ticks and (x.ticks > 0) == (x.way > 0) for x in legs)
    assert all(abs(x.ticks) >= 5 for x in legs[1:] if x.done) and [x.done for x in legs] == [True] * (len(legs) - 1) + [False]


def test_level_life(spark):
    rows = [(0, 9, 9, 8, 8), (1, 8, 10, 8, 9), (2, 9, 13, 9, 13), (3, 12, 12, 8, 8), (4, 30, 30, 29, 29), (5, 30, 30, 29, 29), (6, 1, 30, 1, 9)]
    df = spark.createDataFrame([("M", "PDH", 0, t, o, h, lo, c, 10) for t, o, h, lo, c in rows], "instrument string, kind string, session_us long, bar_us long, open long, high long, low long, close long, px long")
    got = one(machines.level_life(df, 2, 5).orderBy("at_us", "old"), "at_us", "old", "new")
    assert got == [(1, "SET", "TOUCHED"), (2, "TOUCHED", "BROKEN_ABOVE"), (3, "BROKEN_ABOVE", "RECLAIMED"), (4, "RECLAIMED", "BROKEN_ABOVE"), (5, "BROKEN_ABOVE", "EXPIRED")]


def test_inside_events(spark):
    rows = [(0, 10, 9), (1, 9, 5), (2, 10, 9), (3, 10, 2), (4, 10, 1), (9, 10, 1), (10, 8, 4)]
    df = spark.createDataFrame([("M", int(t * S), i, p, z) for i, (t, p, z) in enumerate(rows)], "instrument string, us long, seq long, bid_px long, bid_sz long")
    assert sorted(one(machines.inside_events(df, 3.0, 0.3), "seq", "kind", "result")) == [(1, "VACATED", "FAILED"), (3, "DRAINED", "PERMANENT"), (6, "VACATED", "PENDING")]


def test_price_direction(spark):
    px = [10, 12, 14, 13, 10, 10]
    got = machines.price_direction(tape(spark, [(i if i < 5 else 99, p, 1, "B") for i, p in enumerate(px)]), 3, 30.0)
    assert one(got.orderBy("seq"), "seq", "old", "new") == [(2, "flat", "up"), (4, "up", "down"), (5, "down", "flat")]


def test_vpin_prorata_and_ppo(spark):
    v = sequential.vpin_prorata(tape(spark, [(0, 1, 6, "B"), (1, 1, 6, "A"), (2, 1, 8, "N"), (3, 1, 20, "B")]), 10, 2)
    got = one(v.orderBy("bucket"), "bucket", "taking", "vpin")
    assert [g[0] for g in got] == [0, 1, 2] and got[0][1:] == (0.0, None) and got[1][1] == pytest.approx(20 / 22) and got[1][2] == pytest.approx(10 / 22)
    b = spark.createDataFrame([("M", i, 5, 5, 5, 1) for i in range(30)], "instrument string, bar_us long, high long, low long, close long, volume long")
    assert all(r.mix is None and r.signal is None for r in sequential.ppo(b, 5, 3.0, 9, 0.7).collect())


def test_statistics(spark):
    lo, hi = stats.wilson(F.lit(0), F.lit(0))
    assert tuple(value(spark, lo, hi)) == (0.0, 1.0)
    lo, hi = stats.wilson(F.lit(8), F.lit(10))
    assert value(spark, lo, hi)[0] == pytest.approx(0.4902, abs=1e-4)
    for x in (-3.0, -0.5, 0.0, 1.0, 2.5):
        assert value(spark, stats.normal_cdf(F.lit(x)))[0] == pytest.approx(0.5 * math.erfc(-x / 2**0.5), abs=1e-7)
    a = F.array(*map(F.lit, (4, 1, 3, 2)))
    assert tuple(value(spark, stats.quantile_round(a, 0.5), stats.quantile_floor(a, 0.5), stats.upper_median(a))) == (3, 2, 3)


def test_market_mathematics(spark):
    p = lambda s, b: value(spark, market.hit_probability(F.lit(s), F.lit(b), 240.0, 0.001))[0]
    assert p(100.0, 100.0) == 1.0 and 0 < p(100.0, 103.0) < p(100.0, 101.0) < 1
    rng = random.Random(7)
    hits = 0
    for _ in range(2000):
        x, top = 0.0, -9.0
        for _ in range(480):
            x += rng.gauss(-0.25e-6, 0.001 / 2**0.5)
            top = max(top, x)
        hits += top >= math.log(1.01)
    assert p(100.0, 101.0) == pytest.approx(hits / 2000, abs=0.06)
    assert value(spark, market.break_even(F.lit(0.0), F.lit(0.0), F.lit(1.0)))[0] is None
    assert market.quote_v3(0, 1 << 96, 10**18, True, 3000) == 0
    q = market.quote_v3(10**6, 1 << 96, 10**12, True, 3000)
    assert 996_000 <= q <= 997_000
    assert market.quote_v2(1000, 10**6, 10**6, 3000) == 996
    assert market.quote_v2(0, 5, 5, 3000) == market.quote_v2(5, 0, 5, 3000) == market.quote_v2(5, 5, 0, 3000) == 0
    assert market.quote_v3(1, 1 << 96, 10**18, True, 3000) == market.quote_v3(10, 0, 10, True, 0) == market.quote_v3(10, 1 << 96, 0, False, 0) == 0


def test_every_division_of_a_quote_rounds_down():
    """The pool keeps the remainder: the next price, too, is rounded down before the output is taken from it."""
    q96 = 1 << 96
    for amount, liquidity in ((10**6, 10**12), (7, 1000), (12345, 99_999)):
        net = amount * 997_000 // 1_000_000
        nxt = liquidity * q96 * q96 // (liquidity * q96 + net * q96)
        assert market.quote_v3(amount, q96, liquidity, True, 3000) == liquidity * (q96 - nxt) // q96


def test_calendar(spark):
    got = [(r.code, r.expiry) for r in cal.roll_dates(spark.createDataFrame([(dt.date(2024, 5, 1),), (None,), (dt.date(2024, 1, 1),)], "d date"), "d").orderBy("month").collect()]
    assert got == [("H24", dt.date(2024, 3, 15)), ("M24", dt.date(2024, 6, 21)), ("U24", dt.date(2024, 9, 20)), ("Z24", dt.date(2024, 12, 20))]
    cases = {"2024-01-10 14:30:00": ("RTH", "2024-01-10"), "2024-07-10 13:30:00": ("RTH", "2024-07-10"), "2024-01-10 21:30:00": ("POST", "2024-01-10"), "2024-01-10 22:30:00": ("CLOSED", "2024-01-10"), "2024-01-10 23:00:00": ("OVERNIGHT", "2024-01-11"), "2024-01-13 15:00:00": ("CLOSED", "2024-01-13")}
    for ts, (phase, day) in cases.items():
        t = F.lit(ts).cast("timestamp")
        assert tuple(map(str, value(spark, cal.phase(t), cal.trade_date(t)))) == (phase, day), ts
    assert value(spark, cal.near_roll(F.lit("2024-03-12").cast("date"), [dt.date(2024, 3, 15)]))[0]


def test_verdicts(spark):
    f = F.lit
    side, net = verdicts.vote((f("up"), f(1.0)), (f("down"), f(1.0)), (f("flat"), f(5.0)))
    assert tuple(value(spark, side, net)) == ("flat", 0.0)
    side, _ = verdicts.vote((f("up"), f(0.0)), (f("flat"), f(0.0)))
    assert value(spark, side)[0] == "up"
    assert [value(spark, verdicts.grade(f(b), f(d), f(p)))[0] for b, d, p in (("up", "up", "up"), ("up", "flat", "up"), ("up", "down", "up"), ("down", "down", "up"), ("up", "up", "flat"), ("flat", "flat", "up"))] == ["A", "B", "B", "X", "-", "C"]
    assert value(spark, verdicts.exit_reason(("sl", f(False)), ("tp", f(True)), ("flip", f(True))))[0] == "tp"
    assert [value(spark, verdicts.asset_class(f(s)))[0] for s in ("xyz:GOLD", "EURUSD", "BTC", "xyz:TSLA", "SPX")] == ["metals", "fx", "crypto", "equity", "index"]


def test_ingest(spark, tmp_path):
    assert ingest.map_columns(["Close Time", "Open time", "OPEN", "High Price", "low", "close", "Quote Volume", "Volume"]) == {"ts": "Open time", "open": "OPEN", "high": "High Price", "low": "low", "close": "close", "volume": "Volume"}
    for sep in (",", "\t", ";", "|"):
        f = tmp_path / f"c{ord(sep)}.csv"
        rows = [["time", "o", "h", "l", "c", "v"], ["1700000000", "1", "3", "1", "2", "5"], ["1700000000000", "9", "9", "9", "9", "1"], ["2023-11-14T22:14:20Z", "$2", "3", "1", "2", ""], ["x", "1", "1", "1", "1", "1"], ["1700000100", "nan", "1", "1", "1", "1"], ["1700000200", "1", "1", "2", "1", "1"], ["1700000300", "-1", "1", "-2", "1", "1"]]
        f.write_text("\n".join(sep.join(r) for r in rows))
        got = ingest.read_candles(spark, str(f))
        counts = {r.reject: r["count"] for r in got.groupBy("reject").count().collect()}
        assert counts == {None: 2, "duplicate time": 1, "bad time": 1, "bad price": 1, "high below low": 1, "not positive": 1}
        assert sorted(r.us for r in got.where("reject is null").collect()) == [1700000000 * S, 1700000060 * S]


def test_json_sources(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    good = '{"coin":"A","time":5,"levels":[[{"px":"9","sz":"1","n":1},{"px":"8","sz":"0","n":1}],[{"px":"11","sz":"2","n":1}]]}'
    books = ingest.parse_books(lines(good, good.replace('"11"', '"9"'), "junk", '{"coin":"A","time":5,"levels":[[],[]]}'))
    assert [(r.coin, r.us, r.bids[0].px, len(r.bids), r.asks[0].px) for r in books.collect()] == [("A", 5000, 9.0, 1, 11.0)]
    trades = ingest.parse_trades(lines('{"coin":"A","px":"1.5","sz":"2","side":"B","time":1}', '{"coin":"A","px":"0","sz":"2","side":"A","time":1}', "{"))
    assert one(trades, "px", "sz", "side") == [(1.5, 2.0, "B")]
    account = '{"wallet":"w","marginSummary":{"accountValue":"10"},"assetPositions":[{"position":{"coin":"A","szi":"-2","entryPx":"5","liquidationPx":null,"leverage":{"type":"cross","value":3},"cumFunding":{"sinceOpen":"1"}}}]}'
    assert one(ingest.parse_accounts(lines(account, "[]")), "wallet", "coin", "szi", "liquidation_px", "leverage") == [("w", "A", -2.0, None, 3.0)]


def test_sinks(spark):
    df = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    assert one(ingest.insert_or_ignore(df((1, "a")), df((1, "b"), (2, "c"), (2, "c")), ["k"]), "k", "v") == [(2, "c")]
    assert sorted(one(ingest.merge(df((1, "a"), (3, "x")), df((1, "b"), (2, "c")), ["k"]), "k", "v")) == [(1, "b"), (2, "c"), (3, "x")]


def test_validation_edges(spark):
    df = spark.createDataFrame([(i, i % 2, 0.5) for i in range(40)], "block long, touched int, expected double")
    r = validation.block_bootstrap(df, "block", "touched", "expected", 50, 1).first()
    assert r.ratio == 1.0 and r.lo <= 1.0 <= r.hi and r.draws == 50
    assert validation.lift(df.where("false"), [F.col("block")]).count() == 0
    h = validation.pit_histogram(df.withColumn("u", F.lit(1.0)), "u", 4)
    assert sorted(one(h, "bin", "n")) == [(0, 0), (1, 0), (2, 0), (3, 40)]


def test_spells_and_trailing_stop(spark):
    s = spark.createDataFrame([("M", i, x) for i, x in enumerate("aabba")], "instrument string, bar_us long, state string")
    assert sorted(one(studies.spells(s, "state"), "from_us", "state", "rows")) == [(0, "a", 2), (2, "b", 2), (4, "a", 1)]
    p = tape(spark, [(0, 10, 1, "B"), (1, 15, 1, "B"), (2, 12, 1, "B"), (3, 30, 1, "B")]).withColumn("px", F.col("px_ticks"))
    e = spark.createDataFrame([(1, "M0", 0, 1, 10)], "event_id long, instrument string, at_us long, side int, entry long")
    assert one(studies.trailing_stop(e, p, 4, 3, 10 * S), "net", "stopped") == [(2, True)]


def test_cycles_once_each(spark):
    pools = spark.createDataFrame([(1, 0, 1, 100, 300, 0), (2, 1, 0, 200, 100, 0), (3, 1, 2, 100, 100, 0), (4, 2, 0, 100, 100, 0)], "pool int, token0 int, token1 int, reserve0 long, reserve1 long, fee_ppm int")
    edges = graph.swaps(pools)
    assert one(graph.cycles2(edges, 1.0), "p1", "p2", "gain") == [(1, 2, 1.5)]
    assert sorted(one(graph.cycles3(edges, 1.5), "a", "b", "c", "gain")) == [(0, 1, 2, 2.0), (0, 1, 2, 3.0)]


def test_grades_of_all_columns(spark):
    """Price decides: with it both is A, one is B whatever the other says, none C, and X where those who speak oppose."""
    ways = ("up", "down", "flat")
    df = spark.createDataFrame([(b, d, p) for b in ways for d in ways for p in ways], "b string, d string, p string")
    for r in df.select("*", verdicts.grade(F.col("b"), F.col("d"), F.col("p")).alias("g")).collect():
        agree = sum(x == r.p for x in (r.b, r.d))
        oppose = sum(x not in (r.p, "flat") for x in (r.b, r.d))
        want = "-" if r.p == "flat" else "A" if agree == 2 else "B" if agree == 1 else "X" if oppose else "C"
        assert r.g == want, r


def test_strength_of_positions(spark):
    cols = "sweep_id int, wallet long, coin string, szi double, entry_px double, account_value double, liquidation_px double, margin_used double, funding double, isolated boolean"
    rows = [(1, 1, "A", 10.0, 100.0, 1000.0, 90.0, 100.0, 1.0, True), (1, 2, "A", -10.0, 100.0, 1000.0, None, 100.0, -1.0, False), (1, 3, "A", 10.0, 100.0, 0.0, 100.0, 500.0, 0.0, True)]
    got = {r.wallet: r for r in positions.strength(spark.createDataFrame(rows, cols), 100.0, 0.002).collect()}
    sigmas = abs(math.log(0.9)) / (0.002 * 240**0.5)
    assert got[1].sigmas == pytest.approx(sigmas) and got[1].carry == pytest.approx(0.001 * 365) and got[1].commitment == pytest.approx(0.1)
    assert got[1].survivability == pytest.approx((1 - math.exp(-sigmas / 2)) / 1.2 / 1.365)
    assert got[2].sigmas == math.inf and got[2].survivability == pytest.approx(min(1.0, 1 / 1.2 * (1 + 0.365 * 0.3) * 1.15))
    assert got[3].survivability == 0.0 and got[3].fragility == 1.0 and got[3].commitment == 0.0
    c = positions.cohorts(positions.strength(spark.createDataFrame(rows, cols), 100.0, 0.002)).first()
    assert c.n == 3 and c.fragile_longs > c.fragile_shorts and c.paying == pytest.approx(1 / 3)


def test_what_positions_did(spark):
    cols = "wallet long, coin string, szi double, entry_px double, liquidation_px double"
    before = [(1, "A", 10.0, 1.0, 80.0), (2, "A", 10.0, 1.0, 80.0), (3, "A", 10.0, 1.0, 80.0), (4, "A", -10.0, 1.0, 120.0), (5, "A", 10.0, 1.0, 99.5), (6, "A", 10.0, 1.0, 50.0), (7, "A", 10.0, 1.0, 80.0), (8, "A", 10.0, 1.0, None)]
    after = [(1, "A", 11.0, 1.0, 70.0), (2, "A", 9.0, 1.0, 70.0), (3, "A", 10.0, 1.0, 79.0), (4, "A", -10.0, 1.0, 119.0), (7, "A", -10.0, 1.0, 80.1), (8, "A", 10.0, 1.0, 5.0), (9, "A", 1.0, 1.0, 5.0)]
    got = {r.wallet: r.kind for r in positions.diff(spark.createDataFrame(before, cols), spark.createDataFrame(after, cols), 100.0, 0.02, 0.005, 0.01).collect()}
    assert got == {1: "ADDED", 2: "REDUCED", 3: "DEFENDED", 4: "WEAKENED", 5: "LIQUIDATED", 6: "CLOSED", 7: "HELD", 8: "HELD", 9: "OPENED"}


def test_price_action_of_bars(spark):
    flat = [("M", i, 100, 102, 98, 100) for i in range(5)]
    cases = {"upper wick": (100, 103, 99, 100), "equal wicks": (100, 101, 99, 100), "swept high": (100, 104, 100, 101), "accepted": (101, 104, 101, 104), "swept low": (99, 100, 95, 99)}
    for name, last in cases.items():
        df = spark.createDataFrame([*flat, ("M", 5, *last)], "instrument string, bar_us long, open long, high long, low long, close long")
        r = structure.price_action(df, 12).where("bar_us = 5").first()
        if name == "upper wick":
            assert r.rejection == -0.75
        elif name == "equal wicks":
            assert r.rejection == r.sweep == r.acceptance == 0
        elif name == "swept high":
            assert r.sweep == pytest.approx(-1.0) and r.acceptance == 0
        elif name == "accepted":
            assert r.acceptance == 1 and r.sweep == 0
        else:
            assert r.sweep == pytest.approx(1.0)
    first = structure.price_action(spark.createDataFrame(flat[:2], "instrument string, bar_us long, open long, high long, low long, close long"), 12)
    assert all(x.rejection == x.sweep == x.acceptance == 0 for x in first.collect())


def test_state_carries_over_midnight_and_stops_at_a_key(spark):
    day = 86_400_000_000
    rows = [("M", day - 2, 1, 100, 6, "B"), ("M", day + 2, 2, 101, 6, "B"), ("M", day + 9, 3, 102, 1, "A")]
    df = spark.createDataFrame(rows, "instrument string, us long, seq long, px_ticks long, sz long, side string")
    assert one(sequential.delta_bars(df, 10).orderBy("bar"), "first_seq", "delta", "closed") == [(1, 12, True), (3, -1, False)]
    apart = df.withColumn("session_us", F.floor(F.col("us") / day) * day)
    assert sorted(one(sequential.delta_bars(apart, 10, ("instrument", "session_us")), "first_seq", "delta", "closed")) == [(1, 6, False), (2, 5, False)]


def test_a_long_key_streams_through_in_batches(spark):
    """More rows than an Arrow batch or an output batch holds, of one key."""
    n = 25_000
    df = spark.range(n).select(F.lit("M").alias("instrument"), F.col("id").alias("us"), F.col("id").alias("seq"))
    got = sequential.thin(df, 0.000002)
    assert got.count() == n // 2 and got.agg(F.sum("seq")).first()[0] == sum(range(0, n, 2))


def test_size_of_routes(spark):
    """Against every amount that both legs have room for, pools of either kind mixed."""
    rng = random.Random(9)

    def some():
        if rng.random() < 0.5:
            return graph.Leg(rng.randrange(2_000, 9_000), rng.randrange(2_000, 9_000), 3000)
        return graph.Leg(fee_ppm=3000, sqrt_price=int((1 << 96) * rng.uniform(0.7, 1.4)), liquidity=rng.randrange(2_000, 9_000), zero_for_one=rng.random() < 0.5)

    def out(legs, x, bps):
        for leg in legs:
            if x * 10_000 > leg.depth * bps:
                return None
            x = leg.quote(x)
        return x

    won = 0
    for n in [2] * 60 + [3] * 40:
        legs = [some() for _ in range(n)]
        got = [(y - x, x) for x in range(1, legs[0].depth * 300 // 10_000 + 1) if (y := out(legs, x, 300)) is not None]
        gain = max(got, default=(0, 0))[0]
        amount, back = graph.best_size(legs, 300)
        assert not amount or out(legs, amount, 300) == back > amount
        assert max(gain, 0) - (back - amount) <= 3 * n  # what a unit of each leg is worth
        won += gain > 0
    assert won > 20
    assert graph.best_size([graph.Leg(0, 5, 3000), graph.Leg(5, 5, 3000)]) == (0, 0)
    deep = [graph.Leg(10**24, 11 * 10**23, 3000), graph.Leg(10**24, 10**24, 500)]
    amount, back = graph.best_size(deep, 10_000)
    value = lambda x: deep[1].quote(deep[0].quote(x)) - x
    assert back - amount == value(amount) >= max(value(amount + d) for d in (-(10**15), -1, 1, 10**15)) - 2
    assert graph.best_size(deep)[0] == 10**24 * 30 // 10_000 - 0 or deep[0].quote(graph.best_size(deep)[0]) <= 10**24 * 30 // 10_000


def test_routes_of_a_token_and_their_rank(spark):
    pools = spark.createDataFrame([(1, "A", "B", 10**9, 11 * 10**8, 0), (2, "B", "A", 10**9, 10**9, 0), (3, "B", "C", 10**9, 10**9, 0), (4, "C", "A", 10**9, 101 * 10**7, 0), (5, "D", "A", 10**9, 10**9, 0)], "pool int, token0 string, token1 string, reserve0 long, reserve1 long, fee_ppm int")
    found = graph.routes_from(pools, "A")
    assert sorted(tuple(r.route) for r in found.collect()) == [(1, 2), (1, 3, 4), (2, 1), (2, 3, 4), (4, 3, 1), (4, 3, 2)]
    best = graph.ranked(graph.route_sizes(found), 2, 10_000).collect()
    assert [tuple(r.route) for r in best] == [(1, 3, 4), (1, 2)] and best[0].gross >= best[1].gross > 0
    assert graph.ranked(graph.route_sizes(found), 2, 1.0).count() == 0  # edges that no market has are broken readings


def test_cycles_through_a_hub(spark):
    """Three hubs and many tokens: all that brute force finds, without pairing the edges of a hub."""
    rng = random.Random(2)
    names = ["H0", "H1", "H2", *(f"t{i}" for i in range(60))]
    rows = [(i, *rng.sample(names[:3] if rng.random() < 0.4 else names, 2), rng.randrange(900, 1200), rng.randrange(900, 1200), 3000) for i in range(260)]
    rows += [(1000 + i, f"H{i % 3}", f"t{i % 60}", 1000, rng.randrange(900, 1200), 3000) for i in range(180)]
    edges = graph.swaps(spark.createDataFrame(rows, "pool int, token0 string, token1 string, reserve0 long, reserve1 long, fee_ppm int"))
    e = [(r.pool, r.a, r.b, r.rate) for r in edges.collect()]
    start = {}
    for x in e:
        start.setdefault(x[1], []).append(x)
    want = sorted((a, b, c, p, q, r) for p, a, b, x in e for q, _, c, y in start[b] for r, _, d, z in start[c] if d == a and a < b and a < c and len({p, q, r}) == 3 and x * y * z >= 1.1)
    assert sorted(one(graph.cycles3(edges, 1.1), "a", "b", "c", "p1", "p2", "p3")) == want and len(want) > 50
    want = sorted((a, b, p, q) for p, a, b, x in e for q, _, c, y in start[b] if c == a and a < b and p != q and x * y >= 1.02)
    assert sorted(one(graph.cycles2(edges, 1.02), "a", "b", "p1", "p2")) == want
    assert graph.triangles(edges).count() == len({frozenset((a, b, c)) for _, a, b, _ in e for _, _, c, _ in start[b] if any(d == a for _, _, d, _ in start[c])})


def test_levels_weigh_by_configured_depth(spark):
    """A book of three levels of ten weighs them 1, 0.9 and 0.8."""
    level = lambda px, sz: {"px": px, "sz": sz}
    rows = [("M", 1, [level(10 - i, 5) for i in range(3)], [level(11 + i, 5) for i in range(3)]), ("M", 2, [level(10 - i, 5 + 10**i) for i in range(3)], [level(11 + i, 5) for i in range(3)]), ("M", 3, [level(10, 6)], [level(11, 5)]), ("M", 4, [], [])]
    books = spark.createDataFrame(rows, "instrument string, seq long, bids array<struct<px:long,sz:long>>, asks array<struct<px:long,sz:long>>")
    assert [round(r[0], 9) for r in sorted(one(flow.multilevel_ofi(books), "ofi", "seq"), key=lambda r: r[1])] == [1 + 0.9 * 10 + 0.8 * 100, 0.0, 0.0]
    assert [round(r[0], 9) for r in sorted(one(flow.multilevel_ofi(books, depth=2), "ofi", "seq"), key=lambda r: r[1])] == [1 + 0.1 * 10, 0.0, 0.0]


def test_first_touch_against_every_print(spark):
    rng = random.Random(8)
    px, rows = 100, []
    for i in range(900):
        px += rng.choice([-2, -1, 0, 1, 2])
        rows.append((f"M{i % 2}", i * 700 + rng.randrange(600), i, px))
    prints = spark.createDataFrame(rows, "instrument string, us long, seq long, px long")
    events = [(i, m, us + rng.randrange(-50, 50), p, p + rng.randrange(-9, 10)) for m, us, i, p in rows[::3]]
    df = spark.createDataFrame(events, "event_id long, instrument string, at_us long, spot long, level long")
    for horizon, parts in ((90_000, 16), (5, 16), (40_000, 1), (40_000, 3)):
        want = []
        for i, m, at, spot, level in events:
            path = sorted((us, s, p) for n, us, s, p in rows if n == m and at < us <= at + horizon)
            hit = [us for us, _, p in path if (p >= level if level >= spot else p <= level)]
            want.append((i, bool(hit), (hit[0] - at) / 60e6 if hit else None, path[-1][2] if path else None, len(path)))
        assert sorted(one(outcomes.first_touch(df, prints, horizon, parts), "event_id", "touched", "minutes", "last_px", "prints")) == want


def test_what_became_of_a_touch(spark):
    """Each rule on paths of bars (high, low, close) about a level of 100 that was come to from below."""
    paths = {
        "stall": ([(101, 99, 100), (101, 99, 100)], ("stall", 1, 1000, 1, 1, False)),
        "reject": ([(100, 99, 100), (100, 96, 99)], ("reject", 4, 20, 0, 4, False)),
        "through first": ([(102, 96, 101), (102, 100, 101)], ("stall", 2, 1000, 2, 4, False)),  # the close through comes with the reach
        "go": ([(102, 100, 101), (105, 101, 104)], ("break_go", 5, 20, 5, 0, False)),
        "fail": ([(102, 100, 101), (102, 98, 99)], ("break_fail", 2, 20, 2, 2, False)),
        "fail before go": ([(102, 100, 101), (105, 98, 99), (106, 100, 104)], ("break_fail", 5, 20, 6, 2, False)),
        "the leg ends": ([(102, 100, 101), (103, 101, 103), (105, 104, 105), (101, 99, 100), (120, 99, 101)], ("break_go", 5, 30, 5, 0, True)),
        "after the leg": ([(100, 97, 98), (100, 95, 96), (100, 99, 100), (110, 90, 100)], ("reject", 5, 20, 0, 5, True)),
        "no bars": ([], None),
    }
    touches = spark.createDataFrame([(i, f"M{i}", 10, 100, True) for i in range(len(paths))], "event_id long, instrument string, at_us long, level long, up boolean")
    bars = spark.createDataFrame([(f"M{i}", 10 + 10 * j, *b) for i, (path, _) in enumerate(paths.values()) for j, b in enumerate(path)], "instrument string, bar_us long, high long, low long, close long")
    got = {r[0]: tuple(r[1:]) for r in one(zones.touch_outcomes(touches, bars, 1000, 1, 3, 1, 4, 4), "event_id", "label", "dist", "took_us", "mfe", "mae", "returned")}
    for i, (name, (_, want)) in enumerate(paths.items()):
        if want:
            label, dist, took, *rest = want
            assert got.get(i) == (label, dist, took - 10 if took != 1000 else 1000, *rest), name
        else:
            assert i not in got


def test_headers_of_public_exports():
    for header, want in {
        ("Open time", "Open", "High", "Low", "Close", "Volume", "Close time", "Quote asset volume", "Number of trades"): "Open time",
        ("Date", "Open", "High", "Low", "Close", "Adj Close", "Volume"): "Date",
        ("Date", "Close/Last", "Volume", "Open", "High", "Low"): "Date",
        ("timestamp", "open", "high", "low", "close", "volume"): "timestamp",
        ("ts", "o", "h", "l", "c", "v"): "ts",
    }.items():
        got = ingest.map_columns(list(header))
        assert got["ts"] == want and len(got) == 6 and "Quote" not in got["volume"] and "Adj" not in got["close"], header


def test_dates_in_their_forms(spark):
    day = 1_704_067_200_000_000
    texts = {"2024-01-01": day, "2024-01-01 00:01": day + 60_000_000, "2024-01-01 00:00:05": day + 5_000_000, "01-01-2024 00:02": day + 120_000_000, "12-31-2023 23:59": day - 60_000_000, "31-12-2023 23:59": day - 60_000_000, "1704067200": day, "1704067200000": day, "soon": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.us for r in df.select("t", ingest.to_timestamp_us(F.col("t")).alias("us")).collect()} == texts
