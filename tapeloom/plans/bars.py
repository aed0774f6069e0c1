"""Queries on bars."""

from ..operators import bars as B
from ..sources.fixtures import TAPE, TOUCH, tape, touch, with_

HOUR = 3600
OHLC = "arg_min(px_ticks, seq) AS open, max(px_ticks) AS high, min(px_ticks) AS low, arg_max(px_ticks, seq) AS close"
FLOW = "CAST(sum({s}) AS BIGINT) AS volume, CAST(sum(CASE WHEN side = 'B' THEN {s} ELSE 0 END) AS BIGINT) AS buy, CAST(sum(CASE WHEN side = 'A' THEN {s} ELSE 0 END) AS BIGINT) AS sell, CAST(sum(CASE side WHEN 'B' THEN {s} WHEN 'A' THEN -{s} ELSE 0 END) AS BIGINT) AS delta, count(*) AS prints"


def bars_sql(seconds: int) -> str:
    w = seconds * B.SECOND
    return f"bars AS (SELECT instrument, us // {w} * {w} AS bar_us, {OHLC}, {FLOW.format(s='sz')} FROM tape GROUP BY ALL)"


def hours(spark, sf):
    return B.time_bars(tape(spark, sf), HOUR)


BARS = with_(TAPE, bars_sql(HOUR))
STEPS = "steps AS (SELECT *, sign(px_ticks - lag(px_ticks) OVER (PARTITION BY instrument ORDER BY seq)) AS step, row_number() OVER (PARTITION BY instrument ORDER BY seq) AS rn FROM tape)"
PIECES = """cums AS (SELECT *, CAST(sum(sz) OVER (PARTITION BY instrument ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS c1 FROM {t}),
pieces AS (SELECT *, least(c1, (bar + 1) * {v}) - greatest(c1 - sz, bar * {v}) AS piece FROM (SELECT *, unnest(range((c1 - sz) // {v}, (c1 - 1) // {v} + 1)) AS bar FROM cums))"""

QUERIES = {
    "bars_time": hours,
    "bars_rolling_z": lambda s, sf: B.cumulative_delta(hours(s, sf), 20),
    "bars_resample": lambda s, sf: B.resample(hours(s, sf), 4 * HOUR),
    "bars_tick": lambda s, sf: B.tick_bars(tape(s, sf), 50),
    "bars_volume_split": lambda s, sf: B.volume_bars(tape(s, sf), 200),
    "vpin_exact": lambda s, sf: B.vpin(tape(s, sf), 200, 20),
    "rolling_votes": lambda s, sf: B.rolling_votes(tape(s, sf), 50, 25, 0.02),
    "bars_session": lambda s, sf: B.sessions(hours(s, sf), 24 * HOUR, 6),
    "book_cvd_bars": lambda s, sf: B.book_cvd_bars(touch(tape(s, sf)), HOUR, 40),
    "bars_gaps": lambda s, sf: B.gaps(hours(s, sf), HOUR),
    "bars_typical": lambda s, sf: B.typical(hours(s, sf), 20, 4),
}

ORACLE = {
    "bars_time": BARS + "SELECT * FROM bars",
    "bars_rolling_z": BARS
    + """, c AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cvd FROM bars)
SELECT *, CASE WHEN count(cvd) OVER w = 20 AND stddev_samp(cvd) OVER w > 0 THEN (cvd - avg(cvd) OVER w) / stddev_samp(cvd) OVER w END AS z FROM c
WINDOW w AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "bars_resample": BARS
    + "SELECT instrument, bar_us // 14400000000 * 14400000000 AS bar_us, arg_min(open, b.bar_us) AS open, max(high) AS high, min(low) AS low, arg_max(close, b.bar_us) AS close, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(delta) AS BIGINT) AS delta FROM bars b GROUP BY instrument, b.bar_us // 14400000000",
    "bars_tick": with_(TAPE, STEPS)
    + f"SELECT instrument, (rn - 1) // 50 AS bar, {OHLC}, {FLOW.format(s='sz')}, count_if(step > 0) AS up_votes, count_if(step < 0) AS down_votes, count_if(side = 'N') AS unknown, min(us) AS open_us, max(us) AS close_us FROM steps GROUP BY ALL",
    "bars_volume_split": with_(TAPE, PIECES.format(t="tape", v=200)) + f"SELECT instrument, bar, {OHLC}, {FLOW.format(s='piece')} FROM pieces GROUP BY ALL",
    "vpin_exact": with_(TAPE, "known AS (SELECT * FROM tape WHERE side <> 'N')", PIECES.format(t="known", v=200))
    + """, b AS (SELECT instrument, bar, CAST(sum(piece) AS BIGINT) AS volume, CAST(abs(sum(CASE WHEN side = 'B' THEN piece ELSE -piece END)) AS BIGINT) AS gap FROM pieces GROUP BY ALL HAVING sum(piece) = 200)
SELECT *, CASE WHEN count(*) OVER w = 20 THEN avg(gap / 200) OVER w END AS vpin FROM b WINDOW w AS (PARTITION BY instrument ORDER BY bar ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "rolling_votes": with_(TAPE, STEPS)
    + """, v AS (SELECT instrument, seq, count(*) FILTER (WHERE step > 0) OVER w AS up, count(*) FILTER (WHERE step < 0) OVER w AS down FROM steps WINDOW w AS (PARTITION BY instrument ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT *, CASE WHEN up + down >= 25 THEN CASE WHEN up / (up + down) > 0.52 THEN 'up' WHEN up / (up + down) < 0.48 THEN 'down' ELSE 'flat' END END AS direction FROM v""",
    "bars_session": BARS
    + """, d AS (SELECT instrument, bar_us // 86400000000 * 86400000000 AS bar_us, arg_min(open, b.bar_us) AS open, max(high) AS high, min(low) AS low, arg_max(close, b.bar_us) AS close, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(delta) AS BIGINT) AS delta FROM bars b GROUP BY instrument, b.bar_us // 86400000000),
g AS (SELECT *, open - lag(close) OVER (PARTITION BY instrument ORDER BY bar_us) AS gap FROM d) SELECT *, coalesce(abs(gap) > 6, false) AS suspect FROM g""",
    "book_cvd_bars": with_(TAPE, TOUCH)
    + """, s AS (SELECT *, us // 3600000000 * 3600000000 AS bar_us, CASE WHEN bid_px = lag(bid_px) OVER w AND ask_px = lag(ask_px) OVER w THEN bid_sz - lag(bid_sz) OVER w - ask_sz + lag(ask_sz) OVER w ELSE 0 END AS step FROM touch WINDOW w AS (PARTITION BY instrument ORDER BY seq)),
c AS (SELECT *, CAST(sum(step) OVER (PARTITION BY instrument, bar_us ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cvd FROM s),
b AS (SELECT instrument, bar_us, max(cvd) AS high, min(cvd) AS low, arg_max(cvd, seq) AS close FROM c GROUP BY ALL)
SELECT *, CASE WHEN count(*) OVER w = 40 AND stddev_samp(close) OVER w > 0 THEN (close - avg(close) OVER w) / stddev_samp(close) OVER w END AS z FROM b WINDOW w AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)""",
    "bars_gaps": BARS
    + """, d AS (SELECT *, bar_us - lag(bar_us) OVER (PARTITION BY instrument ORDER BY bar_us) AS d FROM bars)
SELECT instrument, CAST(sum(greatest(round_even(d / 3600000000, 0) - 1, 0)) AS BIGINT) AS missing, quantile_cont(d, 0.5) AS interval_us, count(*) AS bars FROM d GROUP BY instrument""",
    "bars_typical": BARS
    + """, m AS (SELECT *, abs(close - open) AS move FROM bars)
SELECT instrument, bar_us, CASE WHEN count(*) OVER w >= 4 THEN quantile_cont(move, 0.5) OVER w END AS typical_move, CASE WHEN count(*) OVER w >= 4 THEN quantile_cont(volume, 0.5) OVER w END AS typical_volume
FROM m WINDOW w AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
}
