"""Queries on operators with state. Where recursion can follow the state, DuckDB does."""

from pyspark.sql import functions as F

from ..operators import outcomes as X
from ..operators import sequential as Q
from ..sources.fixtures import TAPE, TOUCH, tape, touch, with_
from .bars import BARS, hours
from .flow import L1, l1
from .outcomes import HORIZON, barrier_sql, prints, signals


def trades(s, sf):
    b = X.triple_barrier(signals(s, sf), prints(s, sf), 4, 3, HORIZON)
    e = signals(s, sf).select("event_id", "at_us")
    return b.join(e, "event_id").select("instrument", "event_id", "at_us", (F.col("at_us") + F.round(F.col("held_s") * 1e6).cast("long")).alias("end_us"), "net")


QUERIES = {
    "delta_bars": lambda s, sf: Q.delta_bars(tape(s, sf), 60),
    "ofi_bars": lambda s, sf: Q.ofi_bars(l1(s, sf), 100, 6 * 3600, 5),
    "fused_bars": lambda s, sf: Q.fused_bars(l1(s, sf), 8, 50, 12 * 3600),
    "zigzag_legs": lambda s, sf: Q.zigzag(tape(s, sf), 4),
    "ema_bars": lambda s, sf: Q.ema(hours(s, sf), "close", 9),
    "ema_irregular": lambda s, sf: Q.ema_time(tape(s, sf), 3600.0),
    "stride_thin": lambda s, sf: Q.thin(tape(s, sf), 7200.0),
    "mtf_walk": lambda s, sf: Q.walk(trades(s, sf)),
    "vpin_prorata": lambda s, sf: Q.vpin_prorata(tape(s, sf), 100, 5).withColumns({c: F.round(c, 9) for c in ("taking", "vpin")}),
    "ppo_hist": lambda s, sf: Q.ppo(hours(s, sf), 20, 3.0, 9, 0.7),
}


def ordered(source: str, us: str = "us", seq: str = "seq", key: str = "instrument") -> str:
    return f"o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {seq}) AS i, count(*) OVER (PARTITION BY {key}) AS m FROM {source})"


def recursive(*tables: str) -> str:
    return with_(*tables).replace("WITH ", "WITH RECURSIVE ", 1)


JOIN = "JOIN o ON o.instrument = st.instrument AND o.i = st.i + 1"
SG = "CASE side WHEN 'B' THEN sz WHEN 'A' THEN -sz ELSE 0 END"

OFI_BARS = f""", st AS (SELECT instrument, i, seq, us, 0 AS bar, CAST(ofi AS BIGINT) AS acc, 1 AS n, us AS start, bid_px + ask_px AS o2, bid_px + ask_px AS h2, bid_px + ask_px AS l2, bid_px + ask_px AS m2, CAST(0 AS BIGINT) AS path,
    CASE WHEN ofi >= 100 THEN 'GREEN' WHEN ofi <= -100 THEN 'RED' END AS colour FROM o WHERE i = 1
  UNION ALL SELECT instrument, i, seq, us, bar, acc, n, start, o2, h2, l2, m2, path, CASE WHEN acc >= 100 THEN 'GREEN' WHEN acc <= -100 THEN 'RED' WHEN us - start >= {6 * 3600 * 1_000_000} AND n >= 5 THEN 'CHOP' END FROM (
    SELECT o.instrument, o.i, o.seq, o.us, CASE WHEN colour IS NULL THEN bar ELSE bar + 1 END AS bar, CASE WHEN colour IS NULL THEN acc ELSE 0 END + o.ofi AS acc, CASE WHEN colour IS NULL THEN n ELSE 0 END + 1 AS n, CASE WHEN colour IS NULL THEN start ELSE st.us END AS start,
      CASE WHEN colour IS NULL THEN o2 ELSE m2 END AS o2, greatest(CASE WHEN colour IS NULL THEN h2 ELSE m2 END, bid_px + ask_px) AS h2, least(CASE WHEN colour IS NULL THEN l2 ELSE m2 END, bid_px + ask_px) AS l2, bid_px + ask_px AS m2, CASE WHEN colour IS NULL THEN path ELSE 0 END + abs(bid_px + ask_px - m2) AS path FROM st {JOIN})),
ob AS (SELECT instrument, CAST(bar AS BIGINT) AS bar, seq AS last_seq, coalesce(colour, 'OPEN') AS colour, o2 AS open2, h2 AS high2, l2 AS low2, m2 AS close2, acc AS ofi, CAST(n AS BIGINT) AS updates, path AS path2 FROM st JOIN (SELECT instrument, i, m FROM o) USING (instrument, i) WHERE colour IS NOT NULL OR i = m)
"""

ORACLE = {
    "delta_bars": recursive(TAPE, ordered("tape"))
    + f""", st AS (SELECT instrument, i, seq, 0 AS bar, CAST({SG} AS BIGINT) AS acc, abs({SG}) >= 60 AS fin FROM o WHERE i = 1
  UNION ALL SELECT o.instrument, o.i, o.seq, CASE WHEN fin THEN bar + 1 ELSE bar END, CASE WHEN fin THEN 0 ELSE acc END + {SG}, abs(CASE WHEN fin THEN 0 ELSE acc END + {SG}) >= 60 FROM st {JOIN})
SELECT instrument, CAST(bar AS BIGINT) AS bar, min(o.seq) AS first_seq, arg_min(px_ticks, o.seq) AS open, max(px_ticks) AS high, min(px_ticks) AS low, arg_max(px_ticks, o.seq) AS close, CAST(sum(sz) AS BIGINT) AS volume, arg_max(acc, o.seq) AS delta, bool_or(fin) AS closed FROM st JOIN o USING (instrument, i) GROUP BY ALL""",
    "ofi_bars": recursive(TAPE, TOUCH, L1, "lt AS (SELECT t.*, coalesce(l.ofi, 0) AS ofi FROM touch t JOIN l1 l USING (instrument, seq))", ordered("lt"))
    + OFI_BARS
    + "SELECT * FROM ob",
    "fused_bars": recursive(TAPE, TOUCH, L1, "lt AS (SELECT t.instrument, t.seq, t.us, coalesce(l.ofi, 0) AS ofi FROM touch t JOIN l1 l USING (instrument, seq))", ordered("lt"))
    + f""", st AS (SELECT instrument, i, seq, us, 0 AS bar, CAST(ofi AS BIGINT) AS acc, 1 AS n, us AS start, CAST(NULL AS VARCHAR) AS tr FROM o WHERE i = 1
  UNION ALL SELECT instrument, i, seq, us, bar, acc, n, start, CASE WHEN n >= 8 AND abs(acc) >= 50 THEN 'both' WHEN us - start >= {12 * 3600 * 1_000_000} THEN 'time' END FROM (
    SELECT o.instrument, o.i, o.seq, o.us, CASE WHEN tr IS NULL THEN bar ELSE bar + 1 END AS bar, CASE WHEN tr IS NULL THEN acc ELSE 0 END + o.ofi AS acc, CASE WHEN tr IS NULL THEN n ELSE 0 END + 1 AS n, CASE WHEN tr IS NULL THEN start ELSE st.us END AS start FROM st {JOIN}))
SELECT instrument, CAST(bar AS BIGINT) AS bar, seq AS last_seq, coalesce(tr, 'open') AS "trigger", acc AS ofi, CAST(n AS BIGINT) AS n FROM st JOIN (SELECT instrument, i, m FROM o) USING (instrument, i) WHERE tr IS NOT NULL OR i = m""",
    "ema_bars": BARS.replace("WITH ", "WITH RECURSIVE ", 1)
    + ","
    + ordered("bars", "bar_us", "bar_us")
    + f""", st AS (SELECT instrument, i, bar_us, CAST(close AS DOUBLE) AS ema FROM o WHERE i = 1 UNION ALL SELECT o.instrument, o.i, o.bar_us, ema + 0.2 * (o.close - ema) FROM st {JOIN}) SELECT instrument, bar_us, ema FROM st""",
    "ema_irregular": recursive(TAPE, ordered("tape"))
    + f""", st AS (SELECT instrument, i, us, seq, CAST(px_ticks AS DOUBLE) AS ema FROM o WHERE i = 1 UNION ALL SELECT o.instrument, o.i, o.us, o.seq, ema + (1 - exp(-(o.us - st.us) / 1e6 / 3600)) * (o.px_ticks - ema) FROM st {JOIN}) SELECT instrument, seq, ema FROM st""",
    "stride_thin": recursive(TAPE, ordered("tape"))
    + f""", st AS (SELECT instrument, i, us, seq, us AS last, true AS kept FROM o WHERE i = 1 UNION ALL SELECT o.instrument, o.i, o.us, o.seq, CASE WHEN o.us - last >= 7200000000 THEN o.us ELSE last END, o.us - last >= 7200000000 FROM st {JOIN}) SELECT instrument, seq, us FROM st WHERE kept""",
    "mtf_walk": barrier_sql(4, 3).replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", b AS (SELECT event_id, instrument, at_us, CASE WHEN s IS NOT NULL AND (t IS NULL OR s <= t) THEN s WHEN t IS NOT NULL THEN t ELSE fin END AS end_us, CASE WHEN s IS NOT NULL AND (t IS NULL OR s <= t) THEN -3 WHEN t IS NOT NULL THEN 4 ELSE last END AS net FROM y),
{ordered('b', 'at_us', 'at_us, event_id')}, st AS (SELECT instrument, i, event_id, at_us, net, end_us AS free, true AS taken FROM o WHERE i = 1
  UNION ALL SELECT o.instrument, o.i, o.event_id, o.at_us, o.net, CASE WHEN o.at_us >= free THEN o.end_us ELSE free END, o.at_us >= free FROM st {JOIN}) SELECT instrument, event_id, at_us, net FROM st WHERE taken""",
    "zigzag_legs": recursive(TAPE, ordered("tape"))
    + f""", st AS (SELECT instrument, i, seq, 0 AS way, px_ticks AS ap, seq AS aseq, px_ticks AS hp, seq AS hseq, px_ticks AS lp, seq AS lseq, CAST(NULL AS BIGINT) AS f, CAST(NULL AS BIGINT) AS t, 0 AS w, CAST(0 AS BIGINT) AS tk FROM o WHERE i = 1
  UNION ALL SELECT instrument, i, seq,
    CASE WHEN dn THEN -1 WHEN up THEN 1 ELSE way END, CASE WHEN ldn THEN hp WHEN lup THEN lp ELSE ap END, CASE WHEN ldn THEN hseq WHEN lup THEN lseq ELSE aseq END,
    CASE WHEN up THEN px ELSE hp END, CASE WHEN up THEN seq ELSE hseq END, CASE WHEN dn THEN px ELSE lp END, CASE WHEN dn THEN seq ELSE lseq END,
    CASE WHEN ldn OR lup THEN aseq END, CASE WHEN ldn THEN hseq WHEN lup THEN lseq END, CASE WHEN ldn THEN 1 WHEN lup THEN -1 ELSE 0 END, CASE WHEN ldn THEN hp - ap WHEN lup THEN lp - ap ELSE 0 END
  FROM (SELECT *, dn AND (way > 0 OR hp > ap) AS ldn, up AND (way < 0 OR lp < ap) AS lup FROM (
    SELECT *, way >= 0 AND hp - px >= 4 AS dn, NOT (way >= 0 AND hp - px >= 4) AND way <= 0 AND px - lp >= 4 AS up FROM (
      SELECT o.instrument, o.i, o.seq, o.px_ticks AS px, way, ap, aseq, greatest(hp, o.px_ticks) AS hp, CASE WHEN hp >= o.px_ticks THEN hseq ELSE o.seq END AS hseq, least(lp, o.px_ticks) AS lp, CASE WHEN lp <= o.px_ticks THEN lseq ELSE o.seq END AS lseq FROM st {JOIN}))))
SELECT instrument, f AS from_seq, t AS to_seq, w AS way, tk AS ticks, true AS done FROM st WHERE f IS NOT NULL
UNION ALL SELECT instrument, aseq, CASE WHEN way > 0 THEN hseq ELSE lseq END, way, CASE WHEN way > 0 THEN hp ELSE lp END - ap, false FROM st JOIN (SELECT instrument, i, m FROM o) USING (instrument, i) WHERE i = m AND way <> 0""",
    "ppo_hist": BARS.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, f AS (SELECT *, CASE WHEN high > low THEN (2 * close - high - low) / (high - low) * volume ELSE 0.0 END AS flow, sign(close - lag(close) OVER (PARTITION BY instrument ORDER BY bar_us)) * volume AS mom FROM bars),
u AS (SELECT instrument, bar_us, CASE WHEN count(flow) OVER w = 20 AND stddev_pop(flow) OVER w > 0 THEN greatest(-3.0, least(3.0, flow / stddev_pop(flow) OVER w)) END AS a, CASE WHEN count(mom) OVER w = 20 AND stddev_pop(mom) OVER w > 0 THEN greatest(-3.0, least(3.0, mom / stddev_pop(mom) OVER w)) END AS b
  FROM f WINDOW w AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
mx AS (SELECT instrument, bar_us, 0.7 * a + 0.3 * b AS mix FROM u),"""
    + ordered("mx", "bar_us", "bar_us")
    + f""", st AS (SELECT instrument, i, bar_us, mix, mix AS signal FROM o WHERE i = 1 UNION ALL SELECT o.instrument, o.i, o.bar_us, o.mix, CASE WHEN o.mix IS NULL THEN signal WHEN signal IS NULL THEN o.mix ELSE signal + 0.2 * (o.mix - signal) END FROM st {JOIN})
SELECT instrument, bar_us, mix, signal, mix - signal AS histogram FROM st""",
    "vpin_prorata": with_(TAPE, "kn AS (SELECT instrument, seq, sz, side, row_number() OVER (PARTITION BY instrument ORDER BY seq) AS k FROM tape WHERE side <> 'N')").replace("WITH ", "WITH RECURSIVE ", 1)
    + """, st AS (SELECT instrument, k, seq, CASE WHEN side = 'B' THEN sz ELSE 0 END::DOUBLE AS b, CASE WHEN side = 'A' THEN sz ELSE 0 END::DOUBLE AS s, 0 AS bucket, CAST(NULL AS DOUBLE) AS taking FROM kn WHERE k = 1
  UNION ALL SELECT st.instrument, CASE WHEN b + s >= 100 THEN st.k ELSE kn.k END, CASE WHEN b + s >= 100 THEN st.seq ELSE kn.seq END,
    CASE WHEN b + s >= 100 THEN b * (1 - 100 / (b + s)) ELSE b + CASE WHEN kn.side = 'B' THEN kn.sz ELSE 0 END END, CASE WHEN b + s >= 100 THEN s * (1 - 100 / (b + s)) ELSE s + CASE WHEN kn.side = 'A' THEN kn.sz ELSE 0 END END,
    CASE WHEN b + s >= 100 THEN bucket + 1 ELSE bucket END, CASE WHEN b + s >= 100 THEN (b - s) * (100 / (b + s)) / 100 END
  FROM st LEFT JOIN kn ON kn.instrument = st.instrument AND kn.k = st.k + 1 WHERE b + s >= 100 OR kn.k IS NOT NULL),
t AS (SELECT instrument, CAST(bucket - 1 AS BIGINT) AS bucket, seq AS last_seq, taking FROM st WHERE taking IS NOT NULL)
SELECT instrument, bucket, last_seq, round(taking, 9) AS taking, round(CASE WHEN count(*) OVER w = 5 THEN avg(abs(taking)) OVER w END, 9) AS vpin FROM t WINDOW w AS (PARTITION BY instrument ORDER BY bucket ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
}
