"""Queries on structure."""

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import structure as O
from ..sources.fixtures import TAPE, tape, with_
from .bars import BARS, HOUR, bars_sql, hours
from .profile import DAY_US, area, area_sql

FOUR = 4 * HOUR
BARS4 = with_(TAPE, bars_sql(FOUR))


def fours(s, sf):
    return B.time_bars(tape(s, sf), FOUR)


SWINGS = """sw AS (SELECT *, lead(bar_us, 3) OVER w AS confirmed_us,
  count(*) OVER f = 7 AND high > max(high) OVER b AND high >= max(high) OVER a AS ih, count(*) OVER f = 7 AND low < min(low) OVER b AND low <= min(low) OVER a AS il FROM bars
  WINDOW w AS (PARTITION BY instrument ORDER BY bar_us), f AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), b AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
swings AS (SELECT instrument, bar_us, confirmed_us, 'high' AS kind, high AS px FROM sw WHERE ih UNION ALL SELECT instrument, bar_us, confirmed_us, 'low', low FROM sw WHERE il)"""


def found(s, sf):
    return O.swings(fours(s, sf), 3)


def levels(s, sf):
    return found(s, sf).where("kind = 'high'").select("instrument", F.col("bar_us").alias("level_us"), "px")


def balance(s, sf):
    w = F.col("bar_us") + F.lit(DAY_US)
    prior = area(s, sf).select("instrument", w.alias("day_us"), "val", "vah")
    return O.balance(hours(s, sf).withColumn("day_us", B.bucket("bar_us", 24 * HOUR)), prior, 2)


QUERIES = {
    "swings": found,
    "pivots": lambda s, sf: O.pivots(fours(s, sf), 5, 1),
    "structure_trend": lambda s, sf: O.trend(found(s, sf)),
    "structure_breaks": lambda s, sf: O.breaks(fours(s, sf), found(s, sf)),
    "level_touches": lambda s, sf: O.level_touches(fours(s, sf), levels(s, sf), 1).withColumn("first_us", F.coalesce("first_us", F.lit(-1))),
    "session_levels": lambda s, sf: O.session_levels(hours(s, sf), DAY_US),
    "auction_state": balance,
    "price_action": lambda s, sf: O.price_action(fours(s, sf), 12),
    "efficiency_ratio": lambda s, sf: O.efficiency(fours(s, sf), 10),
}

ORACLE = {
    "swings": BARS4 + "," + SWINGS + " SELECT * FROM swings",
    "pivots": BARS4
    + """, p AS (SELECT instrument, bar_us, high, low, count(*) OVER b = 5 AND count(*) OVER a = 1 AND high >= max(high) OVER b AND high > max(high) OVER a AS pivot_high, count(*) OVER b = 5 AND count(*) OVER a = 1 AND low <= min(low) OVER b AND low < min(low) OVER a AS pivot_low FROM bars
WINDOW b AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING)) SELECT * FROM p WHERE pivot_high OR pivot_low""",
    "structure_trend": BARS4
    + ","
    + SWINGS
    + """, b AS (SELECT *, lag(px) OVER (PARTITION BY instrument, kind ORDER BY bar_us) AS before FROM swings),
t AS (SELECT *, last_value(CASE WHEN kind = 'high' AND before IS NOT NULL THEN sign(px - before) END IGNORE NULLS) OVER w AS hs, last_value(CASE WHEN kind = 'low' AND before IS NOT NULL THEN sign(px - before) END IGNORE NULLS) OVER w AS ls FROM b
  WINDOW w AS (PARTITION BY instrument ORDER BY bar_us, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT instrument, bar_us, kind, px, CASE WHEN hs > 0 AND ls > 0 THEN 'up' WHEN hs < 0 AND ls < 0 THEN 'down' ELSE 'range' END AS trend FROM t""",
    "structure_breaks": BARS4
    + ","
    + SWINGS
    + """, h AS (SELECT b.instrument, b.bar_us, arg_max(s.px, (s.confirmed_us, s.bar_us)) AS last_high FROM bars b JOIN swings s ON s.instrument = b.instrument AND s.kind = 'high' AND s.confirmed_us <= b.bar_us GROUP BY ALL),
l AS (SELECT b.instrument, b.bar_us, arg_max(s.px, (s.confirmed_us, s.bar_us)) AS last_low FROM bars b JOIN swings s ON s.instrument = b.instrument AND s.kind = 'low' AND s.confirmed_us <= b.bar_us GROUP BY ALL),
x AS (SELECT b.instrument, b.bar_us, b.close, last_high, last_low, lag(b.close) OVER (PARTITION BY b.instrument ORDER BY b.bar_us) AS pc FROM bars b LEFT JOIN h USING (instrument, bar_us) LEFT JOIN l USING (instrument, bar_us)),
y AS (SELECT *, CASE WHEN close > last_high AND NOT coalesce(pc > last_high, false) THEN 'up' WHEN close < last_low AND NOT coalesce(pc < last_low, false) THEN 'down' END AS side FROM x)
SELECT instrument, bar_us, side, close, CASE WHEN side = 'up' THEN last_high ELSE last_low END AS level FROM y WHERE side IS NOT NULL""",
    "level_touches": BARS4
    + ","
    + SWINGS
    + """, x AS (SELECT b.*, s.bar_us AS level_us, s.px, b.low <= s.px + 1 AND b.high >= s.px - 1 AS touch FROM bars b JOIN swings s ON s.instrument = b.instrument AND s.kind = 'high' AND b.bar_us > s.bar_us),
y AS (SELECT *, touch AND NOT coalesce(lag(touch) OVER (PARTITION BY instrument, level_us, px ORDER BY bar_us), false) AS fresh FROM x)
SELECT instrument, level_us, px, count_if(touch) AS bars, count_if(fresh) AS tests, coalesce(min(CASE WHEN touch THEN bar_us END), -1) AS first_us, count_if(sign(close - px) * sign(open - px) < 0) AS through FROM y GROUP BY instrument, level_us, px""",
    "session_levels": BARS
    + f""", d AS (SELECT instrument, bar_us // {DAY_US} * {DAY_US} AS day_us, max(high) AS h, min(low) AS l, arg_max(close, bar_us) AS c FROM bars GROUP BY ALL),
p AS (SELECT instrument, day_us, lag(h) OVER w AS pdh, lag(l) OVER w AS pdl, lag(c) OVER w AS pdc FROM d WINDOW w AS (PARTITION BY instrument ORDER BY day_us))
SELECT b.instrument, b.bar_us, pdh, pdl, pdc, CASE WHEN close > pdh THEN 'above' WHEN close < pdl THEN 'below' WHEN pdh IS NOT NULL THEN 'inside' END AS stands FROM bars b JOIN p ON p.instrument = b.instrument AND p.day_us = b.bar_us // {DAY_US} * {DAY_US}""",
    "auction_state": with_(TAPE, bars_sql(HOUR), area_sql("va", 1)).replace("WITH", "WITH RECURSIVE", 1)
    + f""", x AS (SELECT b.*, va.val, va.vah FROM bars b JOIN va ON va.instrument = b.instrument AND va.bar_us + {DAY_US} = b.bar_us // {DAY_US} * {DAY_US})
SELECT instrument, bar_us, CASE WHEN count(*) OVER w = 2 AND min(close) OVER w > vah THEN 'IMBALANCE_UP' WHEN count(*) OVER w = 2 AND max(close) OVER w < val THEN 'IMBALANCE_DOWN' ELSE 'BALANCE' END AS state FROM x WINDOW w AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""",
    "price_action": BARS4
    + """, x AS (SELECT *, max(high) OVER p AS ph, min(low) OVER p AS pl, count(*) OVER (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n, high - greatest(open, close) AS up, least(open, close) - low AS down, high - low AS span FROM bars WINDOW p AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING))
SELECT instrument, bar_us, CASE WHEN n < 3 OR span <= 0 THEN 0.0 WHEN up / span > 0.45 AND up > down * 1.5 THEN -least(up / span, 1.0) WHEN down / span > 0.45 AND down > up * 1.5 THEN least(down / span, 1.0) ELSE 0.0 END AS rejection,
  CASE WHEN n < 3 THEN 0.0 WHEN high > ph AND close < ph THEN -least(1.0, 0.4 + (high - ph) / ph * 10000 / 25) WHEN low < pl AND close > pl THEN least(1.0, 0.4 + (pl - low) / pl * 10000 / 25) ELSE 0.0 END AS sweep,
  CASE WHEN n < 3 OR high > ph AND close < ph OR low < pl AND close > pl THEN 0.0 WHEN close > ph THEN 1.0 WHEN close < pl THEN -1.0 ELSE 0.0 END AS acceptance FROM x""",
    "efficiency_ratio": BARS4
    + """, s AS (SELECT *, abs(close - lag(close) OVER w) AS step, lag(close, 10) OVER w AS c10 FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY bar_us))
SELECT instrument, bar_us, CASE WHEN count(step) OVER f = 10 THEN abs(close - c10) / nullif(sum(step) OVER f, 0) END AS efficiency FROM s WINDOW f AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
}
