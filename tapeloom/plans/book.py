"""Queries on order books."""

from ..operators import book as O
from ..sources.fixtures import DEPTH, TAPE, TOUCH, depth, tape, touch, with_

BOOK = with_(TAPE, TOUCH, DEPTH)


def books(s, sf):
    return depth(tape(s, sf))


QUERIES = {
    "microprice_tilt": lambda s, sf: O.microprice(books(s, sf)),
    "book_depth": lambda s, sf: O.depth(books(s, sf), 5),
    "book_walk_cost": lambda s, sf: O.walk(books(s, sf), 120),
    "book_shelves": lambda s, sf: O.shelves(books(s, sf), 1.7, 5),
    "ladder_changes": lambda s, sf: O.ladder_changes(books(s, sf)),
    "aggressor_audit": lambda s, sf: O.side_convention(tape(s, sf), touch(tape(s, sf)), 0.65, 0.35),
    "quote_fills": lambda s, sf: O.fills(touch(tape(s, sf)), 3),
    "band_flow": lambda s, sf: O.band_flow(touch(tape(s, sf)), 0.02),
}

ORACLE = {
    "microprice_tilt": with_(TAPE, TOUCH, DEPTH)
    + "SELECT instrument, seq, (bid_px * sz + ask_px * sz) / (2 * sz) AS microprice, ((bid_px * sz + ask_px * sz) / (2 * sz) - (bid_px + ask_px) / 2) / ((ask_px - bid_px) / 2) AS tilt FROM depth WHERE i = 0",
    "book_depth": BOOK
    + """, m AS (SELECT *, first(bid_px + ask_px) OVER (PARTITION BY seq ORDER BY i) / 2 AS mid FROM depth),
d AS (SELECT instrument, seq, CAST(sum(CASE WHEN mid - bid_px <= 5 THEN bid_px * sz ELSE 0 END) AS DOUBLE) AS bid, CAST(sum(CASE WHEN ask_px - mid <= 5 THEN ask_px * sz ELSE 0 END) AS DOUBLE) AS ask FROM m GROUP BY ALL)
SELECT *, (bid - ask) / nullif(bid + ask, 0) AS imbalance FROM d""",
    "book_walk_cost": BOOK
    + """, c AS (SELECT *, coalesce(sum(sz) OVER (PARTITION BY seq ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, first(bid_px + ask_px) OVER (PARTITION BY seq ORDER BY i) / 2 AS mid FROM depth),
t AS (SELECT *, greatest(0, least(sz, 120 - before)) AS take FROM c),
w AS (SELECT instrument, seq, CAST(sum(take) AS BIGINT) AS filled, CAST(sum(take * ask_px) AS BIGINT) AS cost, max(CASE WHEN take > 0 THEN ask_px END) AS worst, count_if(take > 0) AS levels, any_value(mid) AS mid FROM t GROUP BY ALL)
SELECT instrument, seq, filled, cost / filled AS avg_px, worst, levels, abs(cost / filled - mid) AS slippage, filled < 120 AS exhausted FROM w""",
    "book_shelves": BOOK
    + """, l AS (SELECT instrument, seq, i, 'bid' AS side, bid_px AS px, sz FROM depth UNION ALL SELECT instrument, seq, i, 'ask', ask_px, sz FROM depth),
m AS (SELECT *, median(sz) OVER (PARTITION BY seq, side) AS med FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY instrument, seq ORDER BY sz DESC, i, side) AS rank FROM m WHERE sz >= med * 1.7)
SELECT instrument, seq, side, px, sz, rank FROM r WHERE rank <= 5""",
    "ladder_changes": BOOK
    + """, o AS (SELECT DISTINCT instrument, seq FROM depth), p AS (SELECT instrument, seq, lag(seq) OVER (PARTITION BY instrument ORDER BY seq) AS prev FROM o),
e AS (SELECT instrument, seq, min(bid_px) AS lo, max(bid_px) AS hi FROM depth GROUP BY ALL),
s AS (SELECT p.instrument, p.seq, p.prev, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM p JOIN e a ON a.seq = p.seq JOIN e b ON b.seq = p.prev),
x AS (SELECT *, unnest(range(lo, hi + 1)) AS px FROM s WHERE lo <= hi),
c AS (SELECT x.instrument, x.seq, coalesce(n.sz, 0) - coalesce(o.sz, 0) AS d FROM x LEFT JOIN depth n ON n.seq = x.seq AND n.bid_px = x.px LEFT JOIN depth o ON o.seq = x.prev AND o.bid_px = x.px)
SELECT instrument, seq, CAST(sum(greatest(d, 0)) AS DOUBLE) AS added, CAST(sum(greatest(-d, 0)) AS DOUBLE) AS lost, count(*) AS levels FROM c GROUP BY ALL""",
    "aggressor_audit": with_(TAPE, TOUCH)
    + """, m AS (SELECT seq, lag(bid_px + ask_px) OVER (PARTITION BY instrument ORDER BY seq) AS mid2 FROM touch),
s AS (SELECT side, count(*) AS n, avg(CASE WHEN 2 * px_ticks > mid2 THEN 1 ELSE 0 END) AS share FROM tape JOIN m USING (seq) WHERE mid2 IS NOT NULL AND 2 * px_ticks <> mid2 GROUP BY side)
SELECT *, CASE WHEN share >= 0.65 THEN 'BUY' WHEN share <= 0.35 THEN 'SELL' ELSE 'ambiguous' END AS reads FROM s""",
    "quote_fills": with_(TAPE, TOUCH)
    + ", r AS (SELECT *, CASE WHEN bid_px <= 0 OR ask_px <= 0 THEN 'empty' WHEN ask_px <= bid_px THEN 'crossed' WHEN ask_px - bid_px > 3 THEN 'wide' ELSE 'ok' END AS reason FROM touch) SELECT instrument, seq, reason, CASE WHEN reason = 'ok' THEN ask_px END AS buy_px, CASE WHEN reason = 'ok' THEN bid_px END AS sell_px FROM r",
    "band_flow": with_(TAPE, TOUCH)
    + """, d AS (SELECT instrument, seq, CASE WHEN bid_px = lag(bid_px) OVER w THEN bid_sz - lag(bid_sz) OVER w END AS d, lag(bid_sz) OVER w AS old FROM touch WINDOW w AS (PARTITION BY instrument ORDER BY seq)),
b AS (SELECT *, d > 0 AND lag(d) OVER (PARTITION BY instrument ORDER BY seq) < 0 AS refill FROM d WHERE abs(d) > 0.02 * old)
SELECT instrument, CAST(sum(greatest(-d, 0)) AS BIGINT) AS consumed, CAST(sum(greatest(d, 0)) AS BIGINT) AS replenished, count_if(refill) AS refills FROM b GROUP BY instrument""",
}
