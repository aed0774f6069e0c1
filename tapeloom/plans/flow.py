"""Queries on order flow."""

from pyspark.sql import functions as F

from ..operators import flow as O
from ..sources.fixtures import DEPTH, RECORDS, TAPE, TOUCH, depth, records, tape, touch, with_
from .bars import BARS, hours

LAST = "WINDOW w AS (PARTITION BY instrument ORDER BY seq)"
L1 = f"""l1 AS (SELECT instrument, seq, CASE WHEN lag(seq) OVER w IS NOT NULL THEN
  (CASE WHEN bid_px > lag(bid_px) OVER w THEN bid_sz WHEN bid_px < lag(bid_px) OVER w THEN -lag(bid_sz) OVER w ELSE bid_sz - lag(bid_sz) OVER w END)
  - (CASE WHEN ask_px < lag(ask_px) OVER w THEN ask_sz WHEN ask_px > lag(ask_px) OVER w THEN -lag(ask_sz) OVER w ELSE ask_sz - lag(ask_sz) OVER w END) END AS ofi FROM touch {LAST})"""


def rng(seconds: int) -> str:
    return f"(PARTITION BY instrument ORDER BY us RANGE BETWEEN {seconds * 1_000_000} PRECEDING AND CURRENT ROW)"


def l1(s, sf):
    return O.level1_ofi(touch(tape(s, sf)))


DAY = 86400

QUERIES = {
    "ofi_level1": lambda s, sf: l1(s, sf).select("instrument", "seq", "ofi"),
    "ofi_multilevel": lambda s, sf: O.multilevel_ofi(depth(tape(s, sf))),
    "ofi_race_z": lambda s, sf: O.race(l1(s, sf), 20, 100),
    "ofi_schmitt": lambda s, sf: O.schmitt(O.race(l1(s, sf), 20, 100).where("z is not null"), "z", 1.5, 0.8).select("instrument", "seq", "direction"),
    "book_cvd": lambda s, sf: O.book_cvd(touch(tape(s, sf))),
    "tape_delta_window": lambda s, sf: O.delta_window(tape(s, sf), 6 * 3600),
    "tape_divergence": lambda s, sf: O.divergence(hours(s, sf), 10),
    "velocity_burst": lambda s, sf: O.velocity(tape(s, sf), 3600, DAY, 20),
    "kinetic_push": lambda s, sf: O.kinetic(tape(s, sf), 6 * 3600),
    "dscore_slope": lambda s, sf: O.dscore(tape(s, sf), 6 * 3600, 2 * 3600),
    "vwap_bands": lambda s, sf: O.vwap_bands(hours(s, sf)),
    "atr14": lambda s, sf: O.atr(hours(s, sf), 14),
    "refusals_count": lambda s, sf: O.refusals(touch(tape(s, sf)), 20),
    "message_rate": lambda s, sf: O.message_rate(records(s, sf), DAY),
    "rolling_z_population": lambda s, sf: O.rolling_stats(hours(s, sf), "delta", 30, True, True, 30),
    "rolling_z_excluding": lambda s, sf: O.rolling_stats(hours(s, sf), "delta", 60, False, False, 10),
    "delta_flips": lambda s, sf: O.flips(hours(s, sf), 12),
    "relative_spread": lambda s, sf: touch(tape(s, sf)).select("instrument", "seq", (2 * (F.col("ask_px") - F.col("bid_px")) / (F.col("bid_px") + F.col("ask_px"))).alias("relative_spread"), ((F.col("bid_sz") + F.col("ask_sz")) / (F.col("ask_px") - F.col("bid_px"))).alias("slope")),
}


def rolling(frame: str, sd: str, least: int) -> str:
    return (
        BARS
        + f""", r AS (SELECT instrument, bar_us, delta AS x, avg(delta) OVER w AS m, {sd}(delta) OVER w AS s, count(delta) OVER w AS n FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN {frame}))
SELECT instrument, bar_us, x, CASE WHEN n >= {least} THEN m END AS mean, CASE WHEN n >= {least} THEN s END AS sd, CASE WHEN n >= {least} AND s > 0 THEN (x - m) / s END AS z FROM r"""
    )


RACE = f"""r AS (SELECT instrument, seq, CASE WHEN count(*) OVER w = 20 THEN CAST(sum(ofi) OVER w AS BIGINT) END AS race FROM l1 WHERE ofi IS NOT NULL WINDOW w AS (PARTITION BY instrument ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
z AS (SELECT instrument, seq, race, CASE WHEN count(race) OVER w = 100 AND stddev_pop(race) OVER w > 0 THEN (race - avg(race) OVER w) / stddev_pop(race) OVER w END AS z FROM r WINDOW w AS (PARTITION BY instrument ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))"""

ORACLE = {
    "ofi_level1": with_(TAPE, TOUCH, L1) + "SELECT * FROM l1",
    "ofi_multilevel": with_(TAPE, TOUCH, DEPTH)
    + """, d AS (SELECT seq, instrument, i, (1.0 - i * 0.9 / 9) * ((CASE WHEN bid_px > lag(bid_px) OVER w THEN sz WHEN bid_px < lag(bid_px) OVER w THEN -lag(sz) OVER w ELSE sz - lag(sz) OVER w END)
  - (CASE WHEN ask_px < lag(ask_px) OVER w THEN sz WHEN ask_px > lag(ask_px) OVER w THEN -lag(sz) OVER w ELSE sz - lag(sz) OVER w END)) AS x, lag(seq) OVER w AS p FROM depth WINDOW w AS (PARTITION BY instrument, i ORDER BY seq))
SELECT seq, instrument, sum(x) AS ofi FROM d WHERE p IS NOT NULL GROUP BY ALL""",
    "ofi_race_z": with_(TAPE, TOUCH, L1, RACE) + "SELECT * FROM z",
    "ofi_schmitt": with_(TAPE, TOUCH, L1, RACE).replace("WITH ", "WITH RECURSIVE ", 1)
    + """, n AS (SELECT instrument, seq, z, row_number() OVER (PARTITION BY instrument ORDER BY seq) AS i FROM z WHERE z IS NOT NULL),
st AS (SELECT instrument, i, seq, CASE WHEN z > 1.5 THEN 'up' WHEN z < -1.5 THEN 'down' ELSE 'flat' END AS direction FROM n WHERE i = 1
  UNION ALL SELECT n.instrument, n.i, n.seq, CASE WHEN z > 1.5 THEN 'up' WHEN z < -1.5 THEN 'down' WHEN st.direction = 'up' AND z > 0.8 THEN 'up' WHEN st.direction = 'down' AND z < -0.8 THEN 'down' ELSE 'flat' END FROM st JOIN n ON n.instrument = st.instrument AND n.i = st.i + 1)
SELECT instrument, seq, direction FROM st""",
    "book_cvd": with_(TAPE, TOUCH)
    + f", s AS (SELECT *, CASE WHEN bid_px = lag(bid_px) OVER w AND ask_px = lag(ask_px) OVER w THEN bid_sz - lag(bid_sz) OVER w - ask_sz + lag(ask_sz) OVER w ELSE 0 END AS step FROM touch {LAST}) SELECT instrument, seq, CAST(sum(step) OVER (PARTITION BY instrument ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cvd FROM s",
    "tape_delta_window": with_(TAPE)
    + f", w AS (SELECT instrument, seq, CAST(sum(CASE WHEN side = 'B' THEN sz ELSE 0 END) OVER t AS BIGINT) AS buy, CAST(sum(CASE WHEN side = 'A' THEN sz ELSE 0 END) OVER t AS BIGINT) AS sell FROM tape WINDOW t AS {rng(6 * 3600)}) SELECT *, buy - sell AS delta, (buy - sell) / nullif(buy + sell, 0) AS lean FROM w",
    "tape_divergence": BARS
    + """, c AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cvd FROM bars),
d AS (SELECT instrument, bar_us, close - lag(close, 10) OVER w AS dp, cvd - lag(cvd, 10) OVER w AS dc FROM c WINDOW w AS (PARTITION BY instrument ORDER BY bar_us))
SELECT *, CASE WHEN dp < 0 THEN 'bullish' ELSE 'bearish' END AS kind FROM d WHERE (dp < 0 AND dc > 0) OR (dp > 0 AND dc < 0)""",
    "velocity_burst": with_(TAPE)
    + f", v AS (SELECT instrument, seq, count(*) OVER {rng(3600)} AS n_burst, count(*) OVER {rng(DAY)} AS n_base FROM tape) SELECT *, CASE WHEN n_base >= 20 THEN (n_burst / 3600) / (n_base / 86400) END AS ratio FROM v",
    "kinetic_push": with_(TAPE)
    + f""", p AS (SELECT *, px_ticks - lag(px_ticks) OVER w AS dp, CASE side WHEN 'B' THEN sz WHEN 'A' THEN -sz END AS sg FROM tape {LAST}),
t AS (SELECT instrument, seq, CAST(sum(coalesce(dp * sg, 0)) OVER r AS BIGINT) AS work, CAST(sum(sg) OVER r AS BIGINT) AS signed, CAST(sum(CASE WHEN sg IS NOT NULL THEN sz END) OVER r AS BIGINT) AS volume FROM p WINDOW r AS {rng(6 * 3600)})
SELECT *, work / nullif(volume, 0) AS efficiency, signed / nullif(volume, 0) AS push, CASE WHEN volume > 0 THEN CASE WHEN signed > 0 THEN 'buy' ELSE 'sell' END || CASE WHEN work >= 0 THEN '-pushing' ELSE '-absorbed' END END AS quadrant FROM t""",
    "dscore_slope": with_(TAPE)
    + f""", g AS (SELECT *, CASE WHEN us - lag(us) OVER w > 7200000000 THEN 1 ELSE 0 END AS f FROM tape {LAST}),
s AS (SELECT *, CAST(sum(f) OVER (PARTITION BY instrument ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session FROM g),
m AS (SELECT *, (us - first(us) OVER r) / 60000000 AS minutes, px_ticks - sum(px_ticks * sz) OVER r / sum(sz) OVER r AS vwap_distance FROM s WINDOW r AS (PARTITION BY instrument, session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT instrument, seq, session, CASE WHEN count(*) OVER t >= 3 THEN regr_slope(px_ticks, minutes) OVER t END AS slope, vwap_distance FROM m WINDOW t AS (PARTITION BY instrument, session ORDER BY us RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW)""",
    "vwap_bands": BARS
    + """, t AS (SELECT instrument, bar_us, volume, high + low + close AS tp FROM bars),
s AS (SELECT instrument, bar_us, CAST(sum(volume) OVER r AS DOUBLE) AS v, CAST(sum(tp * volume) OVER r AS DOUBLE) AS pv, CAST(sum(tp * tp * volume) OVER r AS DOUBLE) AS ppv FROM t WINDOW r AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT instrument, bar_us, pv / v / 3 AS vwap, sqrt(greatest((ppv * v - pv * pv) / v / v / 9, 0)) AS sd FROM s)
SELECT *, vwap + sd AS upper1, vwap - sd AS lower1, vwap + 2 * sd AS upper2, vwap - 2 * sd AS lower2 FROM b""",
    "atr14": BARS
    + """, t AS (SELECT instrument, bar_us, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY bar_us))
SELECT *, CASE WHEN count(*) OVER w = 14 THEN avg(tr) OVER w END AS atr FROM t WINDOW w AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""",
    "refusals_count": with_(TAPE, TOUCH)
    + f", r AS (SELECT instrument, CASE WHEN lag(seq) OVER w IS NULL THEN 'first' WHEN bid_px >= ask_px THEN 'crossed' WHEN seq - lag(seq) OVER w > 20 THEN 'gap' ELSE 'ok' END AS reason FROM touch {LAST}) SELECT instrument, reason, count(*) AS n FROM r GROUP BY ALL",
    "message_rate": with_(TAPE, RECORDS)
    + """SELECT instrument, seq, count(*) OVER w AS messages, count_if(action = 'C') OVER w / nullif(count_if(action = 'A') OVER w, 0) AS cancel_add FROM records WINDOW w AS (PARTITION BY instrument ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)""",
    "rolling_z_population": rolling("29 PRECEDING AND CURRENT ROW", "stddev_pop", 30),
    "rolling_z_excluding": rolling("60 PRECEDING AND 1 PRECEDING", "stddev_samp", 10),
    "delta_flips": BARS
    + """, f AS (SELECT instrument, bar_us, CASE WHEN sign(delta) * lag(sign(delta)) OVER w < 0 THEN 1 ELSE 0 END AS flip FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY bar_us))
SELECT *, CAST(sum(flip) OVER (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS BIGINT) AS flips FROM f""",
    "relative_spread": with_(TAPE, TOUCH) + "SELECT instrument, seq, 2 * (ask_px - bid_px) / (bid_px + ask_px) AS relative_spread, (bid_sz + ask_sz) / (ask_px - bid_px) AS slope FROM touch",
}
