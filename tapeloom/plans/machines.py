"""Queries on state machines. SQL follows those whose state is a number or two by recursion; tests hold the others to plain loops."""

from pyspark.sql import functions as F

from ..functions import verdicts as V
from ..operators import bars as B
from ..operators import machines as O
from ..sources.fixtures import TAPE, TOUCH, tape, touch, with_
from . import sessions as L
from .bars import BARS, hours
from .sequential import JOIN, ordered, recursive


def sided(s, sf):
    return tape(s, sf).where("side <> 'N'").select("instrument", "us", "seq", "side")


def signals(s, sf):
    """A read, the side that traded, and three slower reads at every print, and the side to enter."""
    k = F.col("k")
    way = lambda x: F.when(x == 0, "up").when(x == 1, "down").otherwise("flat")
    read, cvd = F.when(k % 21 > 11, "up").when(k % 21 < 9, "down").otherwise("flat"), F.when(F.col("side") == "B", "up").when(F.col("side") == "A", "down")
    side, blocked = V.entry_signal(read, cvd, F.col("sz") >= 2, way(k % 2), way(k % 3), way(k % 4))
    return tape(s, sf).withColumns({"agree": side, "blocked": blocked})


def journaled(s, sf):
    k = F.col("k")
    x = signals(s, sf).select("instrument", "us", "seq", "agree", F.when(k % 53 > 0, F.col("px_ticks")).alias("px"), F.when(k % 11 == 0, "up").when(k % 11 == 1, "down").alias("price"), (k % 37 == 0).alias("disagreed"), F.when(k % 97 > 0, B.bucket("us", 43200)).alias("candle"))
    return O.journal(x, 4, 3)


QUERIES = {
    "entry_signals": lambda s, sf: signals(s, sf).select("instrument", "seq", "agree", "blocked"),
    "journal_decisions": journaled,
    "journal_trades": lambda s, sf: journaled(s, sf).groupBy("instrument", "action", "why").agg(F.count("*").alias("n"), F.sum("net").alias("net")),
    "level_life": lambda s, sf: O.level_life(L.on_levels(hours(s, sf), L.session_levels(hours(s, sf))), 8, 12),
    "l1_queue_events": lambda s, sf: O.inside_events(touch(tape(s, sf)), 3600.0, 0.34).drop("at_us"),
    "price_direction": lambda s, sf: O.price_direction(tape(s, sf), 4, 7200.0),
    "signal_cooldown": lambda s, sf: O.cooldown(sided(s, sf), 3600.0),
    "autopilot_book": lambda s, sf: O.autopilot(hours(s, sf), 30, 15, 4, 3, 6),
    "pace_lead": lambda s, sf: O.pace(tape(s, sf), 3600.0).withColumns({c: F.round(c, 9) for c in ("buy_rate", "sell_rate", "lead")}),
}

INSIDE = f""", st AS (SELECT instrument, i, seq, us, bid_px, bid_sz, bid_sz AS peak, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS level, CAST(NULL AS DOUBLE) AS need FROM o WHERE i = 1
  UNION ALL SELECT o.instrument, o.i, o.seq, o.us, o.bid_px, o.bid_sz, CASE WHEN o.bid_px = st.bid_px THEN greatest(peak, o.bid_sz) ELSE o.bid_sz END,
    CASE WHEN o.bid_px < st.bid_px THEN 'VACATED' WHEN o.bid_px = st.bid_px AND o.bid_sz <= 0.34 * peak AND 0.34 * peak < st.bid_sz THEN 'DRAINED' END, CASE WHEN o.bid_px < st.bid_px THEN st.bid_px ELSE o.bid_px END, peak * 2 / 3 FROM st {JOIN}),
e AS (SELECT * FROM st WHERE kind IS NOT NULL),
f AS (SELECT e.instrument, e.i, e.seq, e.us, e.kind, e.level, min(n.i) FILTER (WHERE n.us - e.us > 3600000000) AS late, min(n.i) FILTER (WHERE n.bid_px > e.level OR n.bid_px = e.level AND (e.kind = 'VACATED' OR n.bid_sz >= e.need)) AS back
      FROM e LEFT JOIN o n ON n.instrument = e.instrument AND n.i > e.i GROUP BY ALL)"""

SIGNALS = """sg0 AS (SELECT *, CASE WHEN k % 21 > 11 THEN 'up' WHEN k % 21 < 9 THEN 'down' END AS rd, CASE side WHEN 'B' THEN 'up' WHEN 'A' THEN 'down' END AS cvd FROM tape),
sg1 AS (SELECT *, CASE WHEN rd IS NULL THEN NULL WHEN cvd IS DISTINCT FROM rd THEN 'cvd-side' WHEN sz < 2 THEN 'cvd' WHEN rd = 'up' AND k % 2 = 1 AND k % 3 = 1 AND k % 4 = 1 OR rd = 'down' AND k % 2 = 0 AND k % 3 = 0 AND k % 4 = 0 THEN 'stack' END AS blocked FROM sg0),
sg AS (SELECT *, CASE WHEN blocked IS NULL THEN rd END AS agree, CASE WHEN blocked IS NULL THEN CASE rd WHEN 'up' THEN 1 WHEN 'down' THEN -1 END END AS w, CASE WHEN k % 53 > 0 THEN px_ticks END AS px, CASE k % 11 WHEN 0 THEN 1 WHEN 1 THEN -1 END AS pw, k % 37 = 0 AS dis, CASE WHEN k % 97 > 0 THEN us // 43200000000 END AS candle FROM sg1)"""
JOURNAL = (
    recursive(TAPE, SIGNALS, ordered("sg"))
    + f""", st AS (SELECT DISTINCT instrument, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS seq, 0 AS p, CAST(0 AS BIGINT) AS entry, CAST(NULL AS BIGINT) AS c, false AS u, false AS d, '' AS action, '' AS why, CAST(NULL AS BIGINT) AS net FROM tape
  UNION ALL SELECT instrument, i, seq, CASE WHEN went IS NOT NULL THEN 0 WHEN opens THEN w ELSE p END, CASE WHEN opens THEN px ELSE entry END, c2, CASE WHEN opens AND w = 1 THEN true ELSE u2 END, CASE WHEN opens AND w = -1 THEN true ELSE d2 END,
    CASE WHEN went IS NOT NULL THEN 'close' WHEN opens THEN 'open' ELSE 'none' END, CASE WHEN px IS NULL THEN 'no price' WHEN p <> 0 THEN coalesce(went, 'held') WHEN w IS NULL THEN 'no signal' WHEN candle IS NULL THEN 'no candle' WHEN NOT opens THEN 'side taken' ELSE agree END, CASE WHEN went IS NOT NULL THEN (px - entry) * p END
  FROM (SELECT *, coalesce(px IS NOT NULL AND p = 0 AND w IS NOT NULL AND candle IS NOT NULL AND NOT CASE w WHEN 1 THEN u2 ELSE d2 END, false) AS opens FROM (
    SELECT o.instrument, o.i, o.seq, o.px, o.w, o.agree, o.candle, p, entry, coalesce(o.candle, c) AS c2, u AND (o.candle IS NULL OR o.candle IS NOT DISTINCT FROM c) AS u2, d AND (o.candle IS NULL OR o.candle IS NOT DISTINCT FROM c) AS d2,
      CASE WHEN p = 0 OR o.px IS NULL THEN NULL WHEN (o.px - entry) * p <= -3 THEN 'sl' WHEN (o.px - entry) * p >= 4 THEN 'tp' WHEN o.w = -p THEN 'flip' WHEN o.dis THEN 'disagree' WHEN o.pw = -p THEN 'diverge' END AS went FROM st {JOIN})))
"""
)

ORACLE = {
    "entry_signals": with_(TAPE, SIGNALS) + "SELECT instrument, seq, agree, blocked FROM sg",
    "journal_decisions": JOURNAL + "SELECT instrument, seq, action, why, p AS side, net FROM st WHERE i > 0",
    "journal_trades": JOURNAL + "SELECT instrument, action, why, count(*) AS n, sum(net) AS net FROM st WHERE i > 0 GROUP BY ALL",
    "signal_cooldown": recursive(TAPE, "sd AS (SELECT instrument, us, seq, side FROM tape WHERE side <> 'N')", ordered("sd"))
    + f""", st AS (SELECT instrument, i, seq, side, CASE WHEN side = 'B' THEN us END AS lb, CASE WHEN side = 'A' THEN us END AS la, true AS taken FROM o WHERE i = 1
  UNION ALL SELECT o.instrument, o.i, o.seq, o.side, CASE WHEN o.side = 'B' AND (lb IS NULL OR o.us - lb >= 3600000000) THEN o.us ELSE lb END, CASE WHEN o.side = 'A' AND (la IS NULL OR o.us - la >= 3600000000) THEN o.us ELSE la END,
    CASE WHEN o.side = 'B' THEN lb IS NULL OR o.us - lb >= 3600000000 ELSE la IS NULL OR o.us - la >= 3600000000 END FROM st {JOIN})
SELECT instrument, seq, side FROM st WHERE taken""",
    "autopilot_book": BARS.replace("WITH ", "WITH RECURSIVE ", 1)
    + ","
    + ordered("bars", "bar_us", "bar_us")
    + f""", st AS (SELECT instrument, i, bar_us, CASE WHEN abs(delta) >= 30 THEN CAST(sign(delta) AS INTEGER) ELSE 0 END AS side, close AS entry, i AS since, CAST(NULL AS VARCHAR) AS reason, 0 AS was, CAST(0 AS BIGINT) AS at_entry, close FROM o WHERE i = 1
  UNION ALL SELECT instrument, i, bar_us, CASE WHEN why IS NOT NULL THEN 0 WHEN side <> 0 THEN side WHEN abs(delta) >= 30 THEN CAST(sign(delta) AS INTEGER) ELSE 0 END, CASE WHEN side = 0 THEN close ELSE entry END, CASE WHEN side = 0 THEN i ELSE since END, why, side, entry, close FROM (
    SELECT o.instrument, o.i, o.bar_us, o.close, o.delta, side, entry, since, CASE WHEN side = 0 THEN NULL WHEN CASE WHEN side > 0 THEN low - entry ELSE entry - high END <= -3 THEN 'stop' WHEN CASE WHEN side > 0 THEN high - entry ELSE entry - low END >= 4 THEN 'target' WHEN o.delta * side <= -15 THEN 'flip' WHEN o.i - since >= 6 THEN 'time' END AS why FROM st {JOIN}))
SELECT instrument, bar_us AS at_us, was AS side, at_entry AS entry, reason, CASE reason WHEN 'stop' THEN -3 WHEN 'target' THEN 4 ELSE (close - at_entry) * was END AS net FROM st WHERE reason IS NOT NULL
UNION ALL SELECT instrument, bar_us, side, entry, 'open', (close - entry) * side FROM st JOIN (SELECT instrument, i, m FROM o) USING (instrument, i) WHERE i = m AND side <> 0""",
    "pace_lead": recursive(TAPE, ordered("tape"))
    + f""", st AS (SELECT instrument, i, us, seq, CASE WHEN side = 'B' THEN sz ELSE 0 END::DOUBLE AS b, CASE WHEN side = 'A' THEN sz ELSE 0 END::DOUBLE AS s FROM o WHERE i = 1
  UNION ALL SELECT o.instrument, o.i, o.us, o.seq, b * exp(-(o.us - st.us) / 1e6 / 3600) + CASE WHEN side = 'B' THEN sz ELSE 0 END, s * exp(-(o.us - st.us) / 1e6 / 3600) + CASE WHEN side = 'A' THEN sz ELSE 0 END FROM st {JOIN})
SELECT instrument, seq, round(b / 3600, 9) AS buy_rate, round(s / 3600, 9) AS sell_rate, round(CASE WHEN b + s > 0 THEN (b - s) / (b + s) END, 9) AS lead FROM st""",
    "level_life": (BARS + "," + L.LEVELS).replace("WITH ", "WITH RECURSIVE ", 1)
    + """, x AS (SELECT b.instrument, l.kind, l.session_us, b.bar_us, open, high, low, close, px FROM lb b JOIN lv l ON l.instrument = b.instrument AND l.session_us = b.session_us AND b.bar_us >= l.set_us),"""
    + ordered("x", "bar_us", "bar_us", "instrument, kind, session_us")
    + f""", r AS (SELECT o.*, abs(high - px) <= 12 OR abs(low - px) <= 12 OR low <= px AND px <= high AS near FROM o),
st AS (SELECT instrument, kind, session_us, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS bar_us, CAST(0 AS BIGINT) AS px, NULL::BOOLEAN AS above, 'SET' AS old, 'SET' AS state, 0 AS clear, false AS expired FROM r WHERE i = 1
  UNION ALL SELECT instrument, kind, session_us, i, bar_us, px, ab, state, new, c, c >= 8 FROM (
    SELECT r.instrument, r.kind, r.session_us, r.i, r.bar_us, r.px, coalesce(above, open > r.px) AS ab, state,
      CASE WHEN state LIKE 'BROKEN%' THEN CASE WHEN CASE WHEN coalesce(above, open > r.px) THEN close > r.px ELSE close < r.px END THEN 'RECLAIMED' ELSE state END
           WHEN CASE WHEN coalesce(above, open > r.px) THEN close < r.px ELSE close > r.px END THEN CASE WHEN coalesce(above, open > r.px) THEN 'BROKEN_BELOW' ELSE 'BROKEN_ABOVE' END
           WHEN low <= r.px AND r.px <= high THEN 'TOUCHED' ELSE state END AS new,
      CASE WHEN near THEN 0 ELSE clear + 1 END AS c
    FROM st JOIN r ON r.instrument = st.instrument AND r.kind = st.kind AND r.session_us = st.session_us AND r.i = st.i + 1 WHERE NOT expired))
SELECT instrument, kind, session_us, bar_us AS at_us, px AS level, old, state AS new FROM st WHERE i > 0 AND old <> state
UNION ALL SELECT instrument, kind, session_us, bar_us, px, state, 'EXPIRED' FROM st WHERE expired""",
    "price_direction": recursive(TAPE, ordered("tape"))
    + f""", st AS (SELECT instrument, i, seq, us, 'flat' AS way, px_ticks AS hi, px_ticks AS lo, us AS moved, 'flat' AS old FROM o WHERE i = 1
  UNION ALL SELECT instrument, i, seq, us, new, CASE new WHEN 'down' THEN least(h2, l2 + 4) ELSE h2 END, CASE new WHEN 'up' THEN greatest(l2, h2 - 4) ELSE l2 END, CASE WHEN new <> way THEN us ELSE mv END, way FROM (
    SELECT *, CASE WHEN new = 'up' AND way <> 'up' OR new = 'flat' AND way <> 'flat' THEN px ELSE h END AS h2, CASE WHEN new = 'down' AND way <> 'down' OR new = 'flat' AND way <> 'flat' THEN px ELSE l END AS l2 FROM (
      SELECT *, CASE WHEN px - l >= 4 AND way <> 'up' THEN 'up' WHEN h - px >= 4 AND way <> 'down' THEN 'down' WHEN us - mv > 7200000000 AND way <> 'flat' THEN 'flat' ELSE way END AS new FROM (
        SELECT o.instrument, o.i, o.seq, o.us, o.px_ticks AS px, way, greatest(hi, o.px_ticks) AS h, least(lo, o.px_ticks) AS l, CASE WHEN o.px_ticks > hi OR o.px_ticks < lo THEN o.us ELSE moved END AS mv FROM st {JOIN}))))
SELECT instrument, seq, old, way AS new FROM st WHERE old <> way""",
    "l1_queue_events": recursive(TAPE, TOUCH, ordered("touch"))
    + INSIDE
    + """
SELECT instrument, seq, kind, level, CASE WHEN late IS NULL AND back IS NULL THEN 'PENDING' WHEN back IS NULL OR late <= back THEN 'PERMANENT' ELSE 'FAILED' END AS result FROM f""",
}
