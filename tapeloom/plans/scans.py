"""Queries on agreement of time frames, causal replay, auction patterns, proposed levels, and price steps."""

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import profile as P
from ..operators import scans as O
from ..sources.fixtures import TAPE, tape, with_
from .bars import BARS, HOUR, hours
from .outcomes import PATHS, S, cells, grid_sql, signals
from .profile import DAY_US, area, daily_profile
from .structure import BARS4, FOUR, SWINGS, fours

WEEK, DAY = 5 * 86_400, 86_400


def priced(s, sf):
    """Hours with prices in points instead of ticks."""
    return hours(s, sf).select("instrument", "bar_us", *((F.col(c) / 4).alias(c) for c in ("open", "high", "low", "close")))


def leveled(s, sf):
    """Hours beside the value area and the nodes of the day before."""
    key = ["instrument", "bar_us"]
    n = P.nodes(daily_profile(s, sf), key, high=0.6, low=0.5, reach=1, valley=4)
    n = n.groupBy(*key).agg(*(F.array_sort(F.collect_list(F.when(F.col("node") == k, F.col("row")))).alias(k) for k in ("hvn", "lvn")))
    prior = area(s, sf).join(n, key, "left").withColumns({k: F.coalesce(k, F.array().cast("array<long>")) for k in ("hvn", "lvn")})
    prior = prior.select("instrument", (F.col("bar_us") + F.lit(DAY_US)).alias("day_us"), "val", "vah", "poc", "hvn", "lvn")
    return hours(s, sf).withColumn("day_us", B.bucket("bar_us", DAY)).select("instrument", "day_us", "bar_us", "open", "high", "low", "close").join(prior, ["instrument", "day_us"])


def proposed(s, sf):
    return O.propose(cells(s, sf), signals(s, sf).select("event_id", "at_us"), (2, 3), least_fit=20, least_test=15)


QUERIES = {
    "price_step": lambda s, sf: O.price_step(priced(s, sf)),
    "row_height": lambda s, sf: O.row_height(priced(s, sf), 10),
    "frames_agree": lambda s, sf: O.agreement(hours(s, sf), WEEK, DAY, 2.0, 2, 6.0, 1.4),
    "frames_agree_strict": lambda s, sf: O.agreement(hours(s, sf), WEEK, DAY, 2.0, 2, 6.0, 1.4, hour_s=2 * DAY, most_in_s=12 * 3600),
    "causal_replay": lambda s, sf: O.replay(fours(s, sf), 3, 2.0, 80),
    "auction_patterns": lambda s, sf: O.auction(leveled(s, sf), memory=12, rotation=1, confirm=6, rearm=3, near=1),
    "proposed_levels": proposed,
}


def lean(name: str, seconds: int) -> str:
    u = seconds * 1_000_000
    w = f"PARTITION BY instrument, bar_us // {u} ORDER BY bar_us"
    return f"""{name}_o AS (SELECT instrument, bar_us, bar_us // {u} AS k, close - first_value(open) OVER ({w}) AS d FROM bars),
{name}_s AS (SELECT *, CASE WHEN d >= 2 THEN 1 WHEN d <= -2 THEN -1 ELSE 0 END AS s FROM {name}_o),
{name}_n AS (SELECT *, CASE WHEN lag(s) OVER (PARTITION BY instrument, k ORDER BY bar_us) = s AND s <> 0 THEN s END AS h FROM {name}_s),
{name} AS (SELECT instrument, bar_us, last_value(h IGNORE NULLS) OVER (PARTITION BY instrument, k ORDER BY bar_us) AS {name} FROM {name}_n)"""


def agree_sql(strict: bool) -> str:
    w, d = WEEK * 1_000_000, DAY * 1_000_000
    extra = f" AND hour_lean = lean AND bar_us - candle <= {12 * 3600 * 1_000_000}" if strict else ""
    return (
        BARS
        + ", "
        + lean("lean", WEEK)
        + ((", " + lean("hour_lean", 2 * DAY)) if strict else "")
        + f""", c AS (SELECT b.*, bar_us // {d} * {d} AS candle, bar_us // {w} * {w} AS block, lag(high) OVER i AS h0, lag(low) OVER i AS l0, first_value(open) OVER (PARTITION BY instrument, bar_us // {d} ORDER BY bar_us) AS o, min(bar_us // {d} * {d}) OVER (PARTITION BY instrument) AS f,
  max(bar_us) OVER (PARTITION BY instrument) AS last_us, last_value(close) OVER (PARTITION BY instrument, bar_us // {d} ORDER BY bar_us ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e FROM bars b WINDOW i AS (PARTITION BY instrument ORDER BY bar_us)),
x AS (SELECT *, CASE WHEN lean = 1 AND close > o AND high > h0 AND low > l0 THEN 'long' WHEN lean = -1 AND close < o AND high < h0 AND low < l0 THEN 'short' END AS side FROM c JOIN lean USING (instrument, bar_us){' JOIN hour_lean USING (instrument, bar_us)' if strict else ''}),
y AS (SELECT * FROM x WHERE side IS NOT NULL AND (bar_us - block) // {d} >= 1 AND candle > f AND abs(close - o) >= 1{extra} QUALIFY row_number() OVER (PARTITION BY instrument, candle, side ORDER BY bar_us) = 1)
SELECT instrument, bar_us, side, close AS entry, close + CASE side WHEN 'long' THEN 6.0 ELSE -6.0 END AS target, o AS stop, candle, (bar_us - block) // {d} AS nth, bar_us - candle AS in_us, abs(close - o) / (abs(close - o) + 6.0) AS driftless, least(1.0, (abs(close - o) + 1.4) / (abs(close - o) + 6.0)) AS breakeven,
  CASE WHEN last_us < candle + {d} THEN 'provisional' WHEN CASE side WHEN 'long' THEN e > o ELSE e < o END THEN 'confirmed' ELSE 'withdrawn' END AS status FROM y"""
    )


STEP = ", px AS (SELECT DISTINCT instrument, unnest([open, high, low, close]) / 4 AS px FROM bars), gp AS (SELECT *, px - lag(px) OVER (PARTITION BY instrument ORDER BY px) AS gap FROM px), tk AS (SELECT instrument, CASE WHEN count(*) < 20 THEN pow(10.0, floor(log10((min(px) + max(px)) / 2 * 1e-4))) ELSE min(gap) END AS tick FROM gp GROUP BY instrument)"

ORACLE = {
    "proposed_levels": S
    + PATHS
    + grid_sql([2, 4, 6], [2, 3], 0.5)
    + """, tm AS (SELECT at_us, sum(count(*)) OVER (ORDER BY at_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(count(*)) OVER () AS total FROM sig GROUP BY at_us),
pt AS (SELECT c.*, coalesce(before, 0) < floor(total * 0.6) AS fit FROM cell c JOIN sig USING (event_id) JOIN tm USING (at_us)),
gg AS (SELECT target, stop, count(net) FILTER (fit) AS fit_n, avg(net) FILTER (fit) AS fit_pay, count(net) FILTER (NOT fit) AS test_n, avg(net) FILTER (NOT fit) AS test_pay, 1.959963984540054 * stddev_samp(net) FILTER (NOT fit) / sqrt(count(net) FILTER (NOT fit)) AS e FROM pt GROUP BY ALL),
rr AS (SELECT *, test_pay - e AS lo, test_pay + e AS hi, (SELECT test_pay FROM gg WHERE target = 2 AND stop = 3) AS now_pay FROM gg ORDER BY fit_pay DESC, target, stop LIMIT 1)
SELECT target, stop, fit_n, fit_pay, test_n, test_pay, lo, hi, now_pay, test_pay - now_pay AS gain, CASE WHEN fit_n < 20 OR test_n < 15 THEN 'few' WHEN target = 2 AND stop = 3 THEN 'same' WHEN test_pay - now_pay < 1 THEN 'small gain' WHEN lo IS NULL OR lo <= 0 THEN 'interval' END AS refused FROM rr""",
    "price_step": BARS + STEP + " SELECT * FROM tk",
    "row_height": BARS + STEP + " SELECT instrument, tick, greatest(1, floor((max(high) - min(low)) / 4 / 10 / tick + 0.999999)) * tick AS height FROM bars JOIN tk USING (instrument) GROUP BY instrument, tick",
    "frames_agree": agree_sql(False),
    "frames_agree_strict": agree_sql(True),
    "causal_replay": BARS4
    + ","
    + SWINGS
    + """, sb AS (SELECT *, lag(px) OVER (PARTITION BY instrument, kind ORDER BY bar_us) AS before FROM swings), kn AS (SELECT * FROM sb WHERE confirmed_us IS NOT NULL),
h AS (SELECT b.instrument, b.bar_us, arg_max({'px': px, 'before': before}, s.bar_us) FILTER (kind = 'high') AS hh, arg_max({'px': px, 'before': before}, s.bar_us) FILTER (kind = 'low') AS ll FROM bars b JOIN kn s ON s.instrument = b.instrument AND s.confirmed_us <= b.bar_us GROUP BY ALL),
c AS (SELECT b.instrument, b.bar_us AS at_us, b.close, CASE WHEN b.close < ll.px THEN 'supply' WHEN b.close > hh.px THEN 'demand' END AS kind FROM bars b JOIN h USING (instrument, bar_us) WHERE hh IS NOT NULL AND ll IS NOT NULL),
nb AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY bar_us) AS i FROM bars),
o AS (SELECT c.*, arg_max({'o': p.open, 'h': p.high, 'l': p.low, 'c': p.close}, p.i) AS g FROM c JOIN nb n ON n.instrument = c.instrument AND n.bar_us = at_us JOIN nb p ON p.instrument = c.instrument AND p.i < n.i AND p.i >= n.i - 11 AND CASE kind WHEN 'supply' THEN p.close > p.open ELSE p.close < p.open END WHERE kind IS NOT NULL GROUP BY ALL),
e AS (SELECT *, CASE kind WHEN 'supply' THEN greatest(g.o, g.c) ELSE g.l END AS a, CASE kind WHEN 'supply' THEN g.h ELSE least(g.o, g.c) END AS z FROM o),
f AS (SELECT instrument, at_us, kind, close, CASE WHEN z <= a THEN g.l ELSE a END AS lo, CASE WHEN z <= a THEN g.h ELSE z END AS hi FROM e),
zn AS (SELECT *, lead(at_us) OVER (PARTITION BY instrument ORDER BY at_us) AS next_us FROM f WHERE hi > lo AND abs(close - (lo + hi) / 2) / ((lo + hi) / 2) * 10000 >= 2.0),
te AS (SELECT z.instrument, at_us, min(bar_us) AS tested_us FROM zn z JOIN bars b ON b.instrument = z.instrument AND bar_us >= next_us AND low <= hi AND high >= lo GROUP BY ALL),
hz AS (SELECT b.instrument, b.bar_us, max(at_us) AS at_us, arg_max(kind, at_us) AS zk FROM bars b JOIN zn z ON z.instrument = b.instrument AND at_us <= b.bar_us AND lo <= b.close AND b.close <= hi GROUP BY ALL),
r AS (SELECT b.*, hh, ll, zk, tested_us, count(*) OVER (PARTITION BY b.instrument) AS n, lead(open) OVER w AS no, lead(close) OVER w AS nc, CAST(sum(volume) OVER w AS HUGEINT) AS v0, CAST(sum(volume * (high + low + close)) OVER w AS HUGEINT) AS v1, CAST(sum(volume * (high + low + close) * (high + low + close)) OVER w AS HUGEINT) AS v2
  FROM bars b LEFT JOIN h USING (instrument, bar_us) LEFT JOIN hz USING (instrument, bar_us) LEFT JOIN te USING (instrument, at_us) WINDOW w AS (PARTITION BY b.instrument ORDER BY b.bar_us)),
ra AS (SELECT *, v1 / v0 / 3 AS m FROM r), q AS (SELECT *, sqrt(CAST(v2 * v0 - v1 * v1 AS DOUBLE)) / v0 / 3 AS sd, (close - low) / nullif(high - low, 0) * 2 - 1 AS off, (close - m) / m * 10000 AS far FROM ra WHERE n >= 80 AND no IS NOT NULL),
y AS (SELECT instrument, bar_us, CASE WHEN abs(off) > 0.1 THEN off END AS position, CASE WHEN hh.px > hh.before AND ll.px > ll.before THEN 0.6 WHEN hh.px < hh.before AND ll.px < ll.before THEN -0.6 END AS structure,
  CASE WHEN zk IS NOT NULL THEN CASE zk WHEN 'supply' THEN -1 ELSE 1 END * CASE WHEN tested_us <= bar_us THEN 0.35 ELSE 0.8 END END AS zone,
  CASE WHEN sd > 0 THEN CASE WHEN close >= m + 2 * sd THEN -0.7 WHEN close <= m - 2 * sd THEN 0.7 WHEN far > 5 THEN 0.35 WHEN far < -5 THEN -0.35 END END AS vwap, nc > no AS up, (nc - no) / no * 10000 AS move_bps FROM q)
SELECT * FROM y WHERE position IS NOT NULL OR structure IS NOT NULL OR zone IS NOT NULL OR vwap IS NOT NULL""",
}
