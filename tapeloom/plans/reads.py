"""Queries on readings of bars and books."""

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import reads as O
from ..operators import sessions as S
from ..sources.fixtures import DEPTH, TAPE, TOUCH, depth, tape, touch, with_
from .bars import BARS, HOUR, hours
from .flow import L1, l1
from .sequential import JOIN, ordered, recursive
from .sessions import LEVELS
from .structure import BARS4, SWINGS, found, fours


def called(s, sf):
    b = hours(s, sf)
    colours = l1(s, sf).groupBy("instrument", B.bucket("us", HOUR).alias("bar_us")).agg(F.coalesce(F.sum("ofi"), F.lit(0)).alias("ofi"))
    b = b.join(colours, ["instrument", "bar_us"]).withColumns({"book": F.when(F.col("ofi") >= 20, "green").when(F.col("ofi") <= -20, "red").otherwise("chop"), "path": F.when(F.col("close") - F.col("open") >= 1, 1).when(F.col("close") - F.col("open") <= -1, -1).otherwise(0)})
    verdict, lean = O.bar_call(F.col("book"), F.col("path"), F.col("delta"), F.col("volume"))
    return b.select("instrument", "bar_us", "book", "path", verdict.alias("verdict"), lean.alias("lean"))


def leaning(s, sf):
    parts = B.time_bars(tape(s, sf), 900).select("instrument", (F.floor(F.col("bar_us") / 14_400_000_000) * 14_400_000_000).alias("bar_us"), "delta")
    return O.delta_read(fours(s, sf), parts, 20)


def agreed(s, sf):
    side, why = O.agreement(F.when(F.col("close") > F.col("open"), " UP").when(F.col("close") < F.col("open"), "down"), F.when(F.col("delta") > 5, "up").when(F.col("delta") < -5, "down").otherwise("flat"))
    return hours(s, sf).select("instrument", "bar_us", side.alias("side"), why.alias("why"))


def swing_call(s, sf):
    flow = hours(s, sf).groupBy("instrument").agg(F.max_by("delta", "bar_us").alias("d")).select("instrument", F.when(F.col("d") > 3, "buy").when(F.col("d") < -3, "sell").alias("side"))
    return O.next_swing(fours(s, sf), found(s, sf), flow)


QUERIES = {
    "bar_calls": called,
    "delta_read": leaning,
    "side_agreement": agreed,
    "slice_reads": lambda s, sf: O.slice_reads(tape(s, sf), depth(tape(s, sf)), 4 * HOUR),
    "near_references": lambda s, sf: O.nearby(S.on_levels(hours(s, sf), S.session_levels(hours(s, sf)))),
    "ladder_clearance": lambda s, sf: O.clearance(tape(s, sf), depth(tape(s, sf)), 3, 6 * HOUR, 0.6),
    "move_travel": lambda s, sf: O.travel(tape(s, sf), 24 * HOUR, 4 * HOUR),
    "trend_modes": lambda s, sf: O.trend(fours(s, sf), 2),
    "bookread_decay": lambda s, sf: O.book_decay(touch(tape(s, sf))).withColumns({c: F.round(c, 9) for c in ("depletion", "replenish")}),
    "absorption_read": lambda s, sf: O.absorption(fours(s, sf), 60, 3, 20),
    "next_swing": swing_call,
}

W20 = "(PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"

ORACLE = {
    "bar_calls": with_(TAPE, TOUCH, L1)
    + """, bars AS (SELECT instrument, us // 3600000000 * 3600000000 AS bar_us, arg_min(px_ticks, seq) AS open, arg_max(px_ticks, seq) AS close, CAST(sum(sz) AS BIGINT) AS volume, CAST(sum(CASE side WHEN 'B' THEN sz WHEN 'A' THEN -sz ELSE 0 END) AS BIGINT) AS delta FROM tape GROUP BY ALL),
o AS (SELECT instrument, t.us // 3600000000 * 3600000000 AS bar_us, coalesce(sum(ofi), 0) AS ofi FROM l1 JOIN touch t USING (instrument, seq) GROUP BY ALL),
x AS (SELECT instrument, bar_us, volume, CASE WHEN ofi >= 20 THEN 'green' WHEN ofi <= -20 THEN 'red' ELSE 'chop' END AS book, CAST(sign(close - open) AS INTEGER) AS path, CASE WHEN volume < 10 THEN 0 ELSE CAST(sign(delta) AS INTEGER) END AS paid FROM bars JOIN o USING (instrument, bar_us)),
y AS (SELECT *, CASE WHEN volume < 10 THEN 'no prints' WHEN book = 'green' AND paid < 0 THEN 'sold into' WHEN book = 'red' AND paid > 0 THEN 'bought into' WHEN paid <> 0 AND path = 0 THEN 'paid, no move' WHEN path <> 0 AND paid = 0 THEN 'unpaid push'
  WHEN path > 0 AND paid > 0 THEN 'confirmed up' WHEN path < 0 AND paid < 0 THEN 'confirmed down' WHEN paid < 0 THEN 'sold into' WHEN paid > 0 THEN 'bought into' ELSE 'no intent' END AS verdict FROM x)
SELECT instrument, bar_us, book, path, verdict, CASE WHEN verdict IN ('no prints', 'unpaid push', 'no intent') THEN 'none' WHEN verdict = 'sold into' THEN 'short' WHEN verdict = 'bought into' THEN 'long' WHEN paid > 0 THEN 'long' ELSE 'short' END AS lean FROM y""",
    "delta_read": BARS4
    + f""", p AS (SELECT instrument, us // 14400000000 * 14400000000 AS bar_us, us // 900000000 AS q, sum(CASE side WHEN 'B' THEN sz WHEN 'A' THEN -sz ELSE 0 END) AS d FROM tape GROUP BY ALL),
s AS (SELECT instrument, bar_us, coalesce(sum(d) / nullif(sum(abs(d)), 0), 0.0) AS persistence FROM p GROUP BY ALL),
e AS (SELECT *, coalesce(avg(volume) OVER {W20}, 0.0) AS expected FROM bars),
x AS (SELECT instrument, bar_us, persistence, delta / volume AS lean, CASE WHEN expected > 0 THEN volume / expected ELSE 0.0 END AS effort, (close / open - 1) * 1e4 AS mv, (high - low) / open * 1e4 AS rg FROM e JOIN s USING (instrument, bar_us) WHERE volume > 0 AND high > low),
y AS (SELECT *, lean * least(effort / 1.5, 1.0) AS score, abs(mv) < greatest(rg * 0.1, 0.5) AS stalled FROM x),
z AS (SELECT *, CASE WHEN score > 0.15 THEN 'up' WHEN score < -0.15 THEN 'down' ELSE 'flat' END AS direction FROM y)
SELECT instrument, bar_us, lean, effort, score, direction, least(abs(score) / 0.5, 1.0) AS strength, persistence, stalled, abs(lean) > 0.25 AND effort >= 0.8 AND stalled AS absorbed, NOT stalled AND (direction = 'up' AND mv < 0 OR direction = 'down' AND mv > 0) AS divergent, abs(persistence) >= 0.6 AND effort >= 0.8 AS working, CASE WHEN effort > 0 THEN mv / effort ELSE 0.0 END AS efficient FROM z""",
    "side_agreement": BARS
    + """, x AS (SELECT instrument, bar_us, CASE WHEN close > open THEN 'up' WHEN close < open THEN 'down' END AS t, CASE WHEN delta > 5 THEN 'up' WHEN delta < -5 THEN 'down' END AS o FROM bars)
SELECT instrument, bar_us, CASE WHEN t = o THEN t END AS side, CASE WHEN t IS NULL AND o IS NULL THEN 'neither' WHEN t IS NULL THEN 'tick is flat' WHEN o IS NULL THEN 'ofi is flat' WHEN t <> o THEN 'they disagree' END AS why FROM x""",
    "slice_reads": with_(TAPE, TOUCH, DEPTH)
    + """, l AS (SELECT instrument, us // 14400000000 * 14400000000 AS slice_us, max(seq) AS seq FROM tape GROUP BY ALL),
ak AS (SELECT l.instrument, l.slice_us, d.i, d.sz AS b, d.sz AS a FROM l JOIN depth d ON d.instrument = l.instrument AND d.seq = l.seq),
p AS (SELECT instrument, us // 14400000000 * 14400000000 AS slice_us, sum(CASE side WHEN 'B' THEN sz WHEN 'A' THEN -sz ELSE 0 END) AS delta, sum(CASE WHEN side <> 'N' THEN sz ELSE 0 END) AS known, count_if(side <> 'N') AS trades FROM tape GROUP BY ALL),
i AS (SELECT instrument, slice_us, (sum(b) FILTER (i < 1) - sum(a) FILTER (i < 1)) / sum(a + b) FILTER (i < 1) AS imb1, (sum(b) FILTER (i < 3) - sum(a) FILTER (i < 3)) / sum(a + b) FILTER (i < 3) AS imb3, (sum(b) FILTER (i < 5) - sum(a) FILTER (i < 5)) / sum(a + b) FILTER (i < 5) AS imb5, (sum(b) - sum(a)) / sum(a + b) AS imb10 FROM ak GROUP BY ALL)
SELECT instrument, slice_us, imb1, imb3, imb5, imb10, coalesce(imb5 - lag(imb5) OVER (PARTITION BY instrument ORDER BY slice_us), 0.0) AS velocity, coalesce(delta / nullif(known, 0), 0.0) AS flow, trades FROM i JOIN p USING (instrument, slice_us)""",
    "near_references": BARS
    + ","
    + LEVELS
    + """, x AS (SELECT b.instrument, b.bar_us, l.kind, l.px, l.px - close AS distance, row_number() OVER (PARTITION BY b.instrument, b.bar_us ORDER BY abs(l.px - close), l.kind) AS rank FROM lb b JOIN lv l ON l.instrument = b.instrument AND l.session_us = b.session_us AND b.bar_us >= l.set_us WHERE high <= low OR abs(l.px - close) <= (high - low) * 1.5)
SELECT * FROM x WHERE rank <= 4""",
    "ladder_clearance": with_(TAPE, TOUCH, DEPTH)
    + """, b AS (SELECT instrument, seq, CAST(sum(sz) AS BIGINT) AS size, CAST(count(*) AS INTEGER) AS levels, max(i) AS covered FROM depth WHERE i <= 3 GROUP BY ALL),
f AS (SELECT instrument, seq, CAST(sum(CASE WHEN side = 'B' THEN sz ELSE 0 END) OVER (PARTITION BY instrument ORDER BY us RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS flow FROM tape)
SELECT instrument, seq, size, levels, covered, false AS truncated, flow, flow / size AS ratio, CASE WHEN flow > 0 THEN size / (flow / 21600) END AS eta_s, CASE WHEN flow / size >= 0.6 THEN 'clears' ELSE 'blocked' END AS verdict FROM b JOIN f USING (instrument, seq)""",
    "move_travel": with_(TAPE)
    + """, m AS (SELECT *, us // 86400000000 * 86400000000 AS bar_us, px_ticks - first(px_ticks) OVER (PARTITION BY instrument, us // 86400000000 ORDER BY seq) AS move FROM tape),
w AS (SELECT *, lag(us) OVER q AS pu, lag(move) OVER q AS pm, count(*) OVER r AS n, arg_min({'us': us, 'move': move}, seq) OVER r AS old FROM m WINDOW q AS (PARTITION BY instrument, bar_us ORDER BY seq), r AS (PARTITION BY instrument, bar_us ORDER BY us RANGE BETWEEN 14400000000 PRECEDING AND CURRENT ROW))
SELECT instrument, seq, bar_us, move, CASE WHEN n < 2 THEN pm ELSE old.move END AS was, CASE WHEN n >= 2 THEN us - old.us WHEN pu IS NOT NULL THEN us - pu ELSE 0 END / 1000000 AS span_s, CASE WHEN n < 2 AND pu IS NOT NULL THEN 2 ELSE n END AS samples FROM w""",
    "trend_modes": BARS4.replace("WITH ", "WITH RECURSIVE ", 1)
    + ","
    + ordered("bars", "bar_us", "bar_us")
    + f""", d AS (SELECT *, CASE WHEN close > open THEN 'up' WHEN close < open THEN 'down' ELSE 'flat' END AS d FROM o),
st AS (SELECT instrument, i, bar_us, d, CASE WHEN d = 'flat' THEN '' ELSE d END AS closed, CASE WHEN d = 'flat' THEN '' ELSE d END AS run, 0 AS against, open AS anchor, close, CAST(0 AS BIGINT) AS flips FROM d WHERE i = 1
  UNION ALL SELECT instrument, i, bar_us, d, CASE WHEN d = 'flat' THEN closed ELSE d END, CASE WHEN turned THEN d ELSE run END, CASE WHEN turned THEN 0 ELSE ag END, CASE WHEN turned THEN open ELSE anchor END, close, flips + CASE WHEN d <> 'flat' AND closed <> '' AND d <> closed THEN 1 ELSE 0 END FROM (
    SELECT *, d <> 'flat' AND (run = '' OR ag >= 2) AS turned FROM (
      SELECT d.instrument, d.i, d.bar_us, d.d, d.open, d.close, closed, run, anchor, flips, CASE WHEN d.d = 'flat' THEN against WHEN d.d = run OR run = '' THEN 0 ELSE against + 1 END AS ag FROM st {JOIN.replace('JOIN o', 'JOIN d').replace('o.', 'd.')})))
SELECT instrument, bar_us, d AS bar, CASE WHEN closed = '' THEN 'flat' ELSE closed END AS closed, CASE WHEN run = '' THEN 'flat' ELSE run END AS run, CASE WHEN close > anchor THEN 'up' WHEN close < anchor THEN 'down' ELSE 'flat' END AS anchor, flips FROM st""",
    "bookread_decay": recursive(TAPE, TOUCH, ordered("touch"))
    + f""", st AS (SELECT instrument, i, seq, bid_px, ask_px, bid_sz, ask_sz, 0.0::DOUBLE AS be, 0.0::DOUBLE AS bb, 0.0::DOUBLE AS ae, 0.0::DOUBLE AS ab FROM o WHERE i = 1
  UNION ALL SELECT o.instrument, o.i, o.seq, o.bid_px, o.ask_px, o.bid_sz, o.ask_sz,
    0.995 * (be + CASE WHEN o.bid_px = st.bid_px AND o.bid_sz < st.bid_sz THEN least((st.bid_sz - o.bid_sz) / st.bid_sz, 1.0) WHEN o.bid_px < st.bid_px THEN 1.0 ELSE 0 END), 0.995 * (bb + CASE WHEN o.bid_px = st.bid_px AND o.bid_sz >= st.bid_sz THEN least((o.bid_sz - st.bid_sz) / st.bid_sz, 1.0) ELSE 0 END),
    0.995 * (ae + CASE WHEN o.ask_px = st.ask_px AND o.ask_sz < st.ask_sz THEN least((st.ask_sz - o.ask_sz) / st.ask_sz, 1.0) WHEN o.ask_px > st.ask_px THEN 1.0 ELSE 0 END), 0.995 * (ab + CASE WHEN o.ask_px = st.ask_px AND o.ask_sz >= st.ask_sz THEN least((o.ask_sz - st.ask_sz) / st.ask_sz, 1.0) ELSE 0 END) FROM st {JOIN})
SELECT instrument, seq, round(CASE WHEN be + ae > 0 THEN (be - ae) / (be + ae) * least((be + ae) / 2, 1.0) ELSE 0 END, 9) AS depletion, round(CASE WHEN bb + ab > 0 THEN (bb - ab) / (bb + ab) * least((bb + ab) / 2, 1.0) ELSE 0 END, 9) AS replenish FROM st""",
    "absorption_read": BARS4
    + """, p AS (SELECT *, CASE WHEN abs(delta) >= 3 THEN abs(close - open) / abs(delta) END AS per FROM bars),
u AS (SELECT *, quantile_cont(per, 0.5) OVER w AS usual, count(per) OVER w AS samples FROM p WINDOW w AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
x AS (SELECT instrument, bar_us, delta, (close - open) * CASE WHEN delta >= 0 THEN 1 ELSE -1 END AS move, coalesce(usual, 0) * abs(delta) AS expected, samples FROM u)
SELECT *, CASE WHEN expected > 0 THEN move / expected ELSE 0.0 END AS ratio, samples >= 20 AS confident FROM x""",
    "next_swing": BARS4
    + ","
    + SWINGS
    + """, e AS (SELECT instrument, max(bar_us) AS end_us FROM bars GROUP BY instrument), k AS (SELECT s.* FROM swings s JOIN e USING (instrument) WHERE confirmed_us <= end_us),
n AS (SELECT instrument, count(*) AS n, arg_max(kind, (confirmed_us, bar_us, kind)) AS lk, arg_max(bar_us, (confirmed_us, bar_us, kind)) AS lu, arg_max(px, bar_us) FILTER (kind = 'high') AS hi, arg_max(px, bar_us) FILTER (kind = 'low') AS lo FROM k GROUP BY instrument HAVING count(*) >= 2),
r AS (SELECT b.instrument, max(high) AS top, min(low) AS bottom FROM bars b JOIN n USING (instrument) WHERE b.bar_us > lu GROUP BY b.instrument),
f AS (SELECT instrument, CASE WHEN d > 3 THEN 'buy' WHEN d < -3 THEN 'sell' END AS side FROM (SELECT instrument, sum(CASE side WHEN 'B' THEN sz WHEN 'A' THEN -sz ELSE 0 END) AS d FROM tape t JOIN (SELECT instrument, max(us) // 3600000000 AS h FROM tape GROUP BY instrument) m USING (instrument) WHERE us // 3600000000 = h GROUP BY instrument)),
x AS (SELECT instrument, CASE lk WHEN 'high' THEN 'low' ELSE 'high' END AS next, CASE lk WHEN 'high' THEN lo ELSE hi END AS reference, CASE lk WHEN 'high' THEN hi ELSE lo END AS fails_at, CASE lk WHEN 'high' THEN bottom ELSE top END AS running, side FROM n JOIN r USING (instrument) LEFT JOIN f USING (instrument) WHERE hi IS NOT NULL AND lo IS NOT NULL),
y AS (SELECT *, CASE next WHEN 'high' THEN running > reference ELSE running < reference END AS settled FROM x)
SELECT *, CASE WHEN settled THEN CASE next WHEN 'high' THEN 'HH' ELSE 'LL' END WHEN side IS NULL THEN NULL WHEN next = 'high' THEN CASE side WHEN 'buy' THEN 'HH' ELSE 'LH' END ELSE CASE side WHEN 'buy' THEN 'HL' ELSE 'LL' END END AS call FROM y""",
}
