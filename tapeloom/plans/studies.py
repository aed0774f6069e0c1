"""Queries on studies and market mathematics."""

from pyspark.sql import functions as F

from ..functions import market as M
from ..operators import bars as B
from ..operators import studies as O
from ..operators import structure as S
from ..sources.fixtures import LEDGER, POSITIONS, TAPE, TOUCH, ledger, positions, table, tape, touch, with_
from .bars import BARS, HOUR, bars_sql, hours
from .outcomes import HORIZON, S as SIG, prints, signals
from .positions import SPOT
from .structure import BARS4, SWINGS, fours, found

DAY = 24 * HOUR
H = HOUR * B.SECOND
D = DAY * B.SECOND


def levels(s, sf):
    return found(s, sf).select("instrument", F.col("px").alias("level")).distinct()


def states(s, sf):
    return hours(s, sf).select("instrument", "bar_us", F.when(F.col("delta") > 10, "buy").when(F.col("delta") < -10, "sell").otherwise("flat").alias("state"))


def limit_orders(s, sf):
    return signals(s, sf).select("event_id", "instrument", "at_us", "side", (F.col("entry") - F.col("side") * 2).alias("price"), F.lit(60).alias("ahead"))


def samples(s, sf):
    w = O.by_bar()
    b = hours(s, sf).withColumn("y", F.lead("close").over(w) - F.col("close")).where("y is not null")
    return b.select(F.signum("delta").alias("d"), F.signum(F.col("close") - F.col("open")).alias("m"), F.when(F.col("prints") > 2, F.signum("delta")).otherwise(0.0).alias("b"), "y")


def closed_form(s, sf):
    p = positions(s, sf)
    return p.select("sweep_id", "wallet", "coin", F.round(M.distance_in_sigmas(F.lit(SPOT), F.col("liquidation_px"), 1440.0, 0.001), 9).alias("sigmas"), F.round(M.hit_probability(F.lit(SPOT), F.col("liquidation_px"), 1440.0, 0.001), 9).alias("p"))


def economics(s, sf):
    """What each instrument's trades need: targets and stops in ticks from the ledger's excursions, instruments by supplier."""
    spec = F.create_map(*(x for k, (_, worth, cost) in M.SPECS.items() for x in (F.lit(k), F.lit(cost / worth))))
    symbols = F.array(*map(F.lit, M.SPECS))
    t = ledger(s, sf).select(F.element_at(symbols, (F.col("supp") % len(M.SPECS) + 1).cast("int")).alias("symbol"), (F.col("mfe_bps") + 1).cast("double").alias("target"), (1 - F.col("mae_bps")).cast("double").alias("stop"), (F.col("exit_reason") == "target").cast("int").alias("won"))
    g = t.groupBy("symbol", "target", "stop").agg(F.count("*").alias("n"), F.avg("won").alias("rate")).withColumn("cost_ticks", F.element_at(spec, F.col("symbol")))
    be = M.break_even(F.col("target"), F.col("stop"), F.col("cost_ticks"))
    return g.select("symbol", "target", "stop", "n", "rate", "cost_ticks", be.alias("breakeven"), (be <= 0.75).alias("viable"), M.expectancy(F.col("rate"), F.col("target"), F.col("stop"), F.col("cost_ticks")).alias("expectancy"))


def names(s, sf):
    """Interval names as the events give them, of seconds to weeks, of prints with and without OFI, and of no known unit."""
    e = table(s, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    unit = F.element_at(F.array(*map(F.lit, ("s", "m", "h", "d", "w", "t", "x"))), (F.col("user_id") % 7 + 1).cast("int"))
    name = F.concat((F.col("k") % 30 + 1).cast("string"), unit, F.when((unit == "t") & (F.col("k") % 2 == 0), F.concat(F.lit("+"), (F.col("k") * 100).cast("string"))).otherwise(""))
    ticks, ofi = M.parse_ticks(F.col("name"))
    return e.select(name.alias("name")).groupBy("name").agg(F.count("*").alias("n")).select("name", "n", F.coalesce(M.seconds_of(F.col("name")), F.lit(-1)).alias("seconds"), F.coalesce(ticks, F.lit(-1)).alias("ticks"), F.coalesce(ofi, F.lit(-1)).alias("ofi"))


def ways(s, sf):
    p = tape(s, sf).withColumn("bar_us", B.bucket("us", 4 * HOUR))
    b = B.time_bars(tape(s, sf), 4 * HOUR).select("instrument", "bar_us", "open")
    x = p.join(b, ["instrument", "bar_us"])
    mark = M.mark_for((F.col("us") - F.col("bar_us")).cast("double"), F.lit(4.0 * H))
    return x.groupBy("instrument", F.coalesce(mark, F.lit(0)).alias("mark"), M.way_of(F.col("px_ticks"), F.col("open"), 0.5).alias("way")).agg(F.count("*").alias("n"))


def confirmed(s, sf):
    b = hours(s, sf)
    p = tape(s, sf).withColumn("bar_us", B.bucket("us", HOUR)).where("side <> 'N'")
    sig = p.groupBy("instrument", "bar_us").agg(F.min("us").alias("at_us"), F.min_by(F.when(F.col("side") == "B", 1).otherwise(-1), "seq").alias("side"))
    return O.confirmed_signals(sig, b)


QUERIES = {
    "agree_horizons": lambda s, sf: O.spells(states(s, sf), "state"),
    "realised_sigma": lambda s, sf: O.realised_sigma(hours(s, sf), 30, HOUR),
    "rungs": lambda s, sf: O.rungs(tape(s, sf), [900, 3600, 14400, 86400]),
    "stack_read": lambda s, sf: O.stack_read(O.rungs(tape(s, sf), [900, 3600, 14400]), 14400),
    "stride_hits": lambda s, sf: O.stride_hits(hours(s, sf), F.signum("delta"), 3, 3),
    "volume_curve": lambda s, sf: O.volume_curve(tape(s, sf), DAY, 6, 8),
    "book_diagonal": lambda s, sf: O.book_diagonal(touch(tape(s, sf)), 4 * HOUR, 1800),
    "developing_poc": lambda s, sf: O.developing_poc(tape(s, sf), DAY, 4 * HOUR),
    "rearmed_touches": lambda s, sf: O.rearmed_touches(tape(s, sf), levels(s, sf), 1, 5),
    "swing_pick": lambda s, sf: O.swing_pick(found(s, sf), 4),
    "nearest_level": lambda s, sf: O.nearest_level(fours(s, sf), levels(s, sf)),
    "resting_fills": lambda s, sf: O.resting_fills(limit_orders(s, sf), tape(s, sf), HORIZON),
    "trailing_stop": lambda s, sf: O.trailing_stop(signals(s, sf), prints(s, sf), 4, 3, HORIZON),
    "threshold_curve": lambda s, sf: O.threshold_curve(samples(s, sf), F.col("d") + F.col("m") * 0.5, F.col("y"), [0.25, 0.5, 0.75, 1.0, 1.25, 1.5]),
    "rotation_floor": lambda s, sf: O.rotation_floor(hours(s, sf).withColumn("ret", F.col("close") - F.col("open")), "ret", "delta", [7, 50, 111, 200, 300]),
    "bar_separation": lambda s, sf: O.bar_separation(tape(s, sf), 4 * HOUR, [20, 40, 60, 80]),
    "top_positions": lambda s, sf: O.top(positions(s, sf).select("sweep_id", "wallet", "coin", F.abs("szi").alias("size")), [F.desc("size"), F.col("wallet"), F.col("coin"), F.col("sweep_id")], 10),
    "signal_survival": confirmed,
    "weight_tuning": lambda s, sf: O.tune_weights(samples(s, sf), ["d", "m", "b"], "y", [0.0, 0.5, 1.0, 2.0], 1),
    "hit_probability": closed_form,
    "instrument_economics": economics,
    "interval_names": names,
    "ways_and_marks": ways,
    "volume_by_price": lambda s, sf: tape(s, sf).groupBy("instrument", F.col("px_ticks").alias("px")).agg(F.sum("sz").alias("volume")).unionByName(levels(s, sf).select("instrument", F.col("level").alias("px"), F.lit(0).cast("long").alias("volume"))).groupBy("instrument", "px").agg(F.sum("volume").alias("volume")),
    "swing_counts": lambda s, sf: S.swings(hours(s, sf), 2).groupBy("instrument", "kind").agg(F.count("*").alias("n"), F.min("px").alias("lo"), F.max("px").alias("hi")),
}

SGN = "CASE side WHEN 'B' THEN sz WHEN 'A' THEN -sz ELSE 0 END"
LV = ", lv AS (SELECT DISTINCT instrument, px AS level FROM swings)"
T = with_(TAPE)
SAMPLES = ", n AS (SELECT delta, close, open, prints, lead(close) OVER (PARTITION BY instrument ORDER BY bar_us) - close AS y FROM bars), smp AS (SELECT sign(delta) AS d, sign(close - open) AS m, CASE WHEN prints > 2 THEN sign(delta) ELSE 0 END AS b, y FROM n WHERE y IS NOT NULL)"
RUNGS = "rungs AS (" + " UNION ALL ".join(f"SELECT instrument, {t} AS seconds, us // {t * B.SECOND} * {t * B.SECOND} AS bar_us, CAST(sum(sz) AS BIGINT) AS volume, CAST(sum({SGN}) AS BIGINT) AS delta, count(*) AS prints FROM tape GROUP BY ALL" for t in (900, 3600, 14400, 86400)) + ")"


def cdf(x: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    poly = f"{t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    tail = f"(0.3989422804014327 * exp(-({x}) * ({x}) / 2) * {poly})"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"


ORACLE = {
    "agree_horizons": BARS
    + """, s AS (SELECT instrument, bar_us, CASE WHEN delta > 10 THEN 'buy' WHEN delta < -10 THEN 'sell' ELSE 'flat' END AS state FROM bars),
c AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY instrument ORDER BY bar_us) THEN 0 ELSE 1 END AS c FROM s), i AS (SELECT *, sum(c) OVER (PARTITION BY instrument ORDER BY bar_us) AS i FROM c)
SELECT instrument, state, min(bar_us) AS from_us, max(bar_us) AS to_us, count(*) AS rows FROM i GROUP BY instrument, state, i""",
    "realised_sigma": BARS
    + ", r AS (SELECT instrument, bar_us, (close / lag(close) OVER (PARTITION BY instrument ORDER BY bar_us) - 1) * 1e4 AS r FROM bars) SELECT instrument, bar_us, CASE WHEN count(r) OVER w = 30 THEN stddev_samp(r) OVER w / 60 END AS sigma FROM r WINDOW w AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)",
    "rungs": with_(TAPE, RUNGS) + "SELECT * FROM rungs",
    "stack_read": with_(TAPE, RUNGS)
    + """, w AS (SELECT instrument, bar_us // 14400000000 * 14400000000 AS base_us, seconds, arg_max(sign(delta), bar_us) AS way FROM rungs WHERE seconds <= 14400 GROUP BY ALL),
r AS (SELECT instrument, base_us, max(CASE WHEN seconds = 14400 THEN way END) AS base, min(CASE WHEN seconds < 14400 THEN way END) AS lo, max(CASE WHEN seconds < 14400 THEN way END) AS hi FROM w GROUP BY ALL)
SELECT instrument, base_us, CASE WHEN base = 0 THEN 'NO_COMMIT' WHEN lo = base AND hi = base THEN 'TREND' WHEN lo = -base OR hi = -base THEN 'PULLBACK' ELSE 'MIXED' END AS state FROM r""",
    "stride_hits": BARS
    + """, b AS (SELECT instrument, sign(delta) AS side, row_number() OVER w AS i, lead(close, 3) OVER w - close AS move FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY bar_us))
SELECT instrument, count(*) AS n, count_if(sign(move) = side) AS hits, count_if(move = 0) AS flat FROM b WHERE i % 3 = 0 AND move IS NOT NULL AND side <> 0 GROUP BY instrument""",
    "volume_curve": T
    + f""", p AS (SELECT instrument, us // {D} AS d, (us % {D}) * 6 // {D} AS slice, sz FROM tape), f AS (SELECT instrument, d, count(*) AS prints, sum(sz) AS v FROM p GROUP BY ALL),
c AS (SELECT f.instrument, f.d, k.slice, (SELECT coalesce(sum(sz), 0) FROM p WHERE p.instrument = f.instrument AND p.d = f.d AND p.slice <= k.slice) / f.v AS share FROM f, (SELECT unnest(range(6)) AS slice) k WHERE prints >= 8)
SELECT instrument, CAST(slice AS INTEGER) AS slice, quantile_cont(share, 0.5) AS share, count(*) AS bars FROM c GROUP BY ALL""",
    "book_diagonal": with_(TAPE, TOUCH)
    + f""", t AS (SELECT *, least(coalesce(lead(us) OVER (PARTITION BY instrument ORDER BY seq) - us, 0), 1800000000) AS dt FROM touch),
g AS (SELECT instrument, us // {4 * H} * {4 * H} AS bar_us, CAST(sum(bid_sz * dt) AS BIGINT) AS bid, CAST(sum(ask_sz * dt) AS BIGINT) AS ask, CAST(sum(dt) AS BIGINT) AS stood FROM t GROUP BY ALL) SELECT *, (bid - ask) / nullif(bid + ask, 0) AS imbalance FROM g""",
    "developing_poc": T
    + f""", v AS (SELECT instrument, us // {D} * {D} AS day_us, us // {4 * H} * {4 * H} AS step_us, px_ticks AS px, sum(sz) AS v FROM tape GROUP BY ALL), s AS (SELECT DISTINCT instrument, day_us, step_us AS at_us FROM v),
x AS (SELECT s.instrument, s.day_us, at_us, px, sum(v) AS v FROM s JOIN v ON v.instrument = s.instrument AND v.day_us = s.day_us AND step_us <= at_us GROUP BY ALL)
SELECT instrument, day_us, at_us, arg_max(px, v * 1000000 - px) AS poc, CAST(sum(v) AS BIGINT) AS volume FROM x GROUP BY ALL""",
    "rearmed_touches": with_(TAPE, bars_sql(4 * HOUR))
    + ","
    + SWINGS
    + LV
    + """, z AS (SELECT t.instrument, level, seq, us, CASE WHEN px_ticks >= level THEN 'above' ELSE 'below' END AS side, CASE WHEN abs(px_ticks - level) <= 1 THEN 'in' WHEN abs(px_ticks - level) >= 5 THEN 'out' END AS zone FROM tape t JOIN lv USING (instrument)),
p AS (SELECT *, lag(zone) OVER (PARTITION BY instrument, level ORDER BY seq) AS prev FROM z WHERE zone IS NOT NULL) SELECT instrument, level, seq, us, side FROM p WHERE zone = 'in' AND (prev IS NULL OR prev = 'out')""",
    "swing_pick": BARS4
    + ","
    + SWINGS
    + """, f AS (SELECT instrument, kind, px, min(bar_us) AS bar_us FROM swings GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY instrument, kind ORDER BY bar_us DESC) AS rank FROM f) SELECT instrument, kind, px, bar_us, rank FROM r WHERE rank <= 4""",
    "nearest_level": BARS4 + "," + SWINGS + LV + " SELECT b.instrument, bar_us, close, min(CASE WHEN level > close THEN level END) AS above, max(CASE WHEN level < close THEN level END) AS below FROM bars b LEFT JOIN lv USING (instrument) GROUP BY ALL",
    "resting_fills": SIG
    + f""", o AS (SELECT event_id, instrument, at_us, side, entry - side * 2 AS price FROM sig),
x AS (SELECT o.*, us, seq, CASE WHEN o.side > 0 THEN px_ticks < price ELSE px_ticks > price END AS thr, px_ticks = price AS eq, sum(CASE WHEN px_ticks = price THEN sz ELSE 0 END) OVER (PARTITION BY event_id ORDER BY us, seq) AS used FROM o JOIN tape t ON t.instrument = o.instrument AND us > at_us AND us <= at_us + {HORIZON}),
g AS (SELECT event_id, bool_or(thr OR used >= 60) AS filled, bool_or(thr OR eq) AS touched FROM x GROUP BY event_id)
SELECT event_id, instrument, side, price, coalesce(filled, false) AS filled, coalesce(touched, false) AS touched FROM o LEFT JOIN g USING (event_id)""",
    "trailing_stop": SIG
    + f""", x AS (SELECT event_id, s.instrument, s.side, us, seq, (px_ticks - entry) * s.side AS gain FROM sig s JOIN tape t ON t.instrument = s.instrument AND us > at_us AND us <= at_us + {HORIZON}),
l AS (SELECT *, greatest(-4, greatest(coalesce(max(gain) OVER (PARTITION BY event_id ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) - 3) AS line FROM x),
g AS (SELECT event_id, instrument, side, arg_min(gain, seq) FILTER (WHERE gain <= line) AS out, bool_or(gain <= line) AS stopped, arg_max(gain, seq) AS last FROM l GROUP BY ALL) SELECT event_id, instrument, side, coalesce(out, last) AS net, stopped FROM g""",
    "threshold_curve": BARS
    + SAMPLES
    + """, t AS (SELECT threshold, count(*) AS n, count_if(abs(d + m * 0.5) >= threshold) AS called, count_if(abs(d + m * 0.5) >= threshold AND sign(d + m * 0.5) = sign(y)) AS "right" FROM smp, (SELECT unnest([0.25, 0.5, 0.75, 1.0, 1.25, 1.5]::DOUBLE[]) AS threshold) GROUP BY threshold) SELECT *, "right" / nullif(called, 0) AS accuracy, called / n AS coverage FROM t""",
    "rotation_floor": BARS
    + """, s AS (SELECT instrument, close - open AS ret, delta, row_number() OVER (PARTITION BY instrument ORDER BY bar_us) - 1 AS i, count(*) OVER (PARTITION BY instrument) AS m FROM bars)
SELECT shift, corr(a.ret, b.delta) AS corr, count(*) AS n FROM s a, (SELECT unnest([7, 50, 111, 200, 300]) AS shift), s b WHERE b.instrument = a.instrument AND b.i = (a.i + shift) % a.m GROUP BY shift""",
    "bar_separation": T
    + f""", g AS (SELECT instrument, us // {4 * H} AS b, arg_min(px_ticks, seq) AS open, arg_max(px_ticks, seq) AS close, """
    + ", ".join(f"CAST(sum(CASE WHEN us % {4 * H} * 100 <= {m} * {4 * H} THEN {SGN} ELSE 0 END) AS BIGINT) AS m{m}" for m in (20, 40, 60, 80))
    + " FROM tape GROUP BY ALL), x AS ("
    + " UNION ALL ".join(f"SELECT CASE WHEN close > open THEN 'up' ELSE 'down' END AS bar, {m} AS mark, m{m} AS delta FROM g WHERE close <> open" for m in (20, 40, 60, 80))
    + ") SELECT bar, mark, quantile_cont(delta, 0.5) AS median, count(*) AS n FROM x GROUP BY ALL",
    "top_positions": with_(POSITIONS) + "SELECT sweep_id, wallet, coin, abs(szi) AS size FROM positions ORDER BY size DESC, wallet, coin, sweep_id LIMIT 10",
    "signal_survival": BARS
    + f""", s AS (SELECT instrument, us // {H} * {H} AS bar_us, CASE WHEN arg_min(side, seq) = 'B' THEN 1 ELSE -1 END AS side FROM tape WHERE side <> 'N' GROUP BY instrument, us // {H})
SELECT instrument, count(*) AS n, avg(CASE WHEN sign(close - open) = s.side THEN 1 ELSE 0 END) AS survival FROM s JOIN bars USING (instrument, bar_us) GROUP BY instrument""",
    "hit_probability": with_(POSITIONS)
    + f""", x AS (SELECT sweep_id, wallet, coin, ln(liquidation_px / {SPOT}) AS l, abs(ln(liquidation_px / {SPOT})) AS a, CASE WHEN liquidation_px >= {SPOT} THEN -0.0000005 ELSE 0.0000005 END AS m FROM positions),
z AS (SELECT *, (-a + m * 1440) / (0.001 * sqrt(1440)) AS z1, (-a - m * 1440) / (0.001 * sqrt(1440)) AS z2 FROM x)
SELECT sweep_id, wallet, coin, round(l / (0.001 * sqrt(1440)), 9) AS sigmas, round(CASE WHEN a < 1e-12 THEN 1 ELSE least(1, greatest(0, {cdf('z1')} + exp(2 * m * a / 0.000001) * {cdf('z2')})) END, 9) AS p FROM z""",
    "instrument_economics": with_(LEDGER)
    + """, t AS (SELECT ['ES', 'MES', 'NQ', 'EQUITY'][supp % 4 + 1] AS symbol, CAST(mfe_bps + 1 AS DOUBLE) AS target, CAST(1 - mae_bps AS DOUBLE) AS stop, exit_reason = 'target' AS won FROM ledger),
g AS (SELECT symbol, target, stop, count(*) AS n, avg(CASE WHEN won THEN 1 ELSE 0 END) AS rate, CAST(CASE symbol WHEN 'ES' THEN 4.0 / 12.5 WHEN 'MES' THEN 1.2 / 1.25 WHEN 'NQ' THEN 4.0 / 5.0 ELSE 0 END AS DOUBLE) AS cost_ticks FROM t GROUP BY ALL),
b AS (SELECT *, least(1.0, (stop + cost_ticks) / (target + stop)) AS breakeven FROM g)
SELECT *, breakeven <= 0.75 AS viable, rate * (target - cost_ticks) - (1 - rate) * (stop + cost_ticks) AS expectancy FROM b""",
    "interval_names": """WITH e AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, ['s', 'm', 'h', 'd', 'w', 't', 'x'][user_id % 7 + 1] AS unit FROM events),
n AS (SELECT (k % 30 + 1) || unit || CASE WHEN unit = 't' AND k % 2 = 0 THEN '+' || (k * 100) ELSE '' END AS name, k % 30 + 1 AS m, unit, CASE WHEN unit = 't' AND k % 2 = 0 THEN k * 100 ELSE -1 END AS ofi FROM e)
SELECT name, count(*) AS n, any_value(CAST(CASE unit WHEN 's' THEN m WHEN 'm' THEN m * 60 WHEN 'h' THEN m * 3600 WHEN 'd' THEN m * 86400 WHEN 'w' THEN m * 604800 ELSE -1 END AS BIGINT)) AS seconds, any_value(CASE unit WHEN 't' THEN m ELSE -1 END) AS ticks, any_value(ofi) AS ofi FROM n GROUP BY name""",
    "ways_and_marks": with_(TAPE, bars_sql(4 * HOUR))
    + f""", x AS (SELECT t.instrument, CASE WHEN us % {4 * H} * 100 >= 75 * {4 * H} THEN 75 WHEN us % {4 * H} * 100 >= 50 * {4 * H} THEN 50 WHEN us % {4 * H} * 100 >= 25 * {4 * H} THEN 25 ELSE 0 END AS mark, (px_ticks / open - 1) * 1e4 AS mv FROM tape t JOIN bars b ON b.instrument = t.instrument AND b.bar_us = us // {4 * H} * {4 * H})
SELECT instrument, mark, CASE WHEN mv > 0.5 THEN 'up' WHEN mv < -0.5 THEN 'down' ELSE 'flat' END AS way, count(*) AS n FROM x GROUP BY ALL""",
    "volume_by_price": with_(TAPE, bars_sql(4 * HOUR)) + "," + SWINGS + LV + ", u AS (SELECT instrument, px_ticks AS px, sz AS volume FROM tape UNION ALL SELECT instrument, level, 0 FROM lv) SELECT instrument, px, CAST(sum(volume) AS BIGINT) AS volume FROM u GROUP BY ALL",
    "swing_counts": BARS
    + """, sw AS (SELECT *, count(*) OVER f = 5 AND high > max(high) OVER b AND high >= max(high) OVER a AS ih, count(*) OVER f = 5 AND low < min(low) OVER b AND low <= min(low) OVER a AS il FROM bars
  WINDOW f AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), b AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
x AS (SELECT instrument, 'high' AS kind, high AS px FROM sw WHERE ih UNION ALL SELECT instrument, 'low', low FROM sw WHERE il) SELECT instrument, kind, count(*) AS n, min(px) AS lo, max(px) AS hi FROM x GROUP BY ALL""",
}
