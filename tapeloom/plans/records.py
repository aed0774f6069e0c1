"""Queries on vendor records."""

from pyspark.sql import functions as F

from ..operators import records as O
from ..sources.fixtures import RECORDS, TAPE, records, with_


def books(s, sf):
    b = O.books(records(s, sf), 2)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["sz"])
    return b.select("instrument", "seq", F.size("bids").alias("n_bids"), F.size("asks").alias("n_asks"), F.get("bids", F.lit(0))["px"].alias("bid"), F.get("asks", F.lit(0))["px"].alias("ask"), total("bids").alias("bid_sz"), total("asks").alias("ask_sz"))


QUERIES = {
    "record_books": books,
    "record_trades": lambda s, sf: O.trades(records(s, sf)),
    "record_trades_flipped": lambda s, sf: O.trades(records(s, sf), True).groupBy("instrument", "aggressor").agg(F.count("*").alias("n"), F.sum("sz").alias("sz")),
    "record_stream": lambda s, sf: O.stream(records(s, sf)),
    "ofi_admissible": lambda s, sf: O.admissible(records(s, sf)),
    "refusal_reasons": lambda s, sf: O.admissible(records(s, sf)).groupBy("instrument", "reason").agg(F.count("*").alias("n"), F.sum("ofi").alias("ofi")),
    "convention_report": lambda s, sf: O.convention(records(s, sf)),
}

R = with_(TAPE, RECORDS)
TRADES = ", tr AS (SELECT instrument, us, seq, price * 1e-9 AS px, size AS sz, side FROM records WHERE action IN ('T', 'F') AND price <> 9223372036854775807 AND price > 0 AND size > 0 AND side IN ('A', 'B'))"
VALID = "({x}.bid_px > 0 AND {x}.ask_px > 0 AND {x}.bid_sz > 0 AND {x}.ask_sz > 0)"
STEP = "(CASE WHEN {b}.bid_px > {a}.bid_px THEN {b}.bid_sz WHEN {b}.bid_px < {a}.bid_px THEN -{a}.bid_sz ELSE {b}.bid_sz - {a}.bid_sz END - CASE WHEN {b}.ask_px < {a}.ask_px THEN {b}.ask_sz WHEN {b}.ask_px > {a}.ask_px THEN -{a}.ask_sz ELSE {b}.ask_sz - {a}.ask_sz END)"
ADMISSIBLE = (
    """, c AS (SELECT *, sum(CASE WHEN action = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY instrument ORDER BY seq) AS clears, CASE WHEN action IN ('N', 'R') THEN 'boundary' WHEN len(levels) = 0 THEN 'no_book' END AS skipped FROM records),
w AS (SELECT *, lag(contract) OVER (PARTITION BY instrument ORDER BY seq) AS c0, lag(sequence) OVER p AS s0, lag(levels) OVER p AS l0 FROM c WHERE skipped IS NULL WINDOW p AS (PARTITION BY instrument, clears ORDER BY seq)),
v AS (SELECT *, l0[1] AS o1, l0[2] AS o2, l0[3] AS o3, levels[1] AS n1, levels[2] AS n2, levels[3] AS n3 FROM w),
a AS (SELECT *, CASE WHEN c0 IS NOT NULL AND c0 <> contract THEN 'roll' WHEN l0 IS NULL THEN 'first' WHEN sequence <> s0 + 1 THEN 'gap' WHEN NOT ("""
    + VALID.format(x="o1")
    + " AND "
    + VALID.format(x="n1")
    + """) THEN 'invalid' WHEN o1.bid_px >= o1.ask_px OR n1.bid_px >= n1.ask_px THEN 'crossed' ELSE 'ok' END AS reason FROM v),
adm AS (SELECT instrument, seq, reason, CASE WHEN reason = 'ok' THEN """
    + STEP.format(a="o1", b="n1")
    + " END AS ofi, CASE WHEN reason = 'ok' THEN CAST("
    + " + ".join(f"CASE WHEN {VALID.format(x=f'o{i}')} AND {VALID.format(x=f'n{i}')} THEN {STEP.format(a=f'o{i}', b=f'n{i}')} * (1 - {i - 1} * 0.9 / 9) ELSE 0 END" for i in (1, 2, 3))
    + " AS DOUBLE) END AS ofi_levels FROM a UNION ALL SELECT instrument, seq, skipped, NULL, NULL FROM c WHERE skipped IS NOT NULL)"
)

ORACLE = {
    "record_books": R
    + """, b AS (SELECT instrument, seq, list_filter(levels[1:2], lambda x: x.bid_px > 0 AND x.bid_sz > 0) AS b, list_filter(levels[1:2], lambda x: x.ask_px > 0 AND x.ask_sz > 0) AS a FROM records WHERE len(levels) > 0)
SELECT instrument, seq, len(b) AS n_bids, len(a) AS n_asks, b[1].bid_px * 1e-9 AS bid, a[1].ask_px * 1e-9 AS ask, CAST(coalesce(list_sum(list_transform(b, lambda x: x.bid_sz)), 0) AS BIGINT) AS bid_sz, CAST(coalesce(list_sum(list_transform(a, lambda x: x.ask_sz)), 0) AS BIGINT) AS ask_sz FROM b""",
    "record_trades": R + TRADES + " SELECT instrument, us, seq, px, sz, CASE side WHEN 'B' THEN 'buy' ELSE 'sell' END AS aggressor FROM tr",
    "record_trades_flipped": R + TRADES + " SELECT instrument, CASE side WHEN 'B' THEN 'sell' ELSE 'buy' END AS aggressor, count(*) AS n, CAST(sum(sz) AS BIGINT) AS sz FROM tr GROUP BY ALL",
    "record_stream": R + TRADES + " SELECT instrument, seq, 0 AS part, 'trade' AS kind FROM tr UNION ALL SELECT instrument, seq, 1, 'book' FROM records WHERE action <> 'R' AND len(levels) > 0 UNION ALL SELECT instrument, seq, 0, 'clear' FROM records WHERE action = 'R'",
    "ofi_admissible": R + ADMISSIBLE + " SELECT * FROM adm",
    "refusal_reasons": R + ADMISSIBLE + " SELECT instrument, reason, count(*) AS n, CAST(sum(ofi) AS BIGINT) AS ofi FROM adm GROUP BY ALL",
    "convention_report": R
    + """, b AS (SELECT *, last_value(CASE WHEN len(levels) > 0 THEN levels[1] END IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bk FROM records),
p AS (SELECT *, coalesce(bk.bid_px > 0 AND bk.ask_px >= bk.bid_px, false) AS quotable FROM b WHERE action IN ('T', 'F', 'A') AND price <> 9223372036854775807),
q AS (SELECT *, quotable AND 2 * price <> bk.bid_px + bk.ask_px AS off, quotable AND 2 * price > bk.bid_px + bk.ask_px AS above FROM p),
g AS (SELECT instrument, count(*) AS seen, count_if(side NOT IN ('A', 'B')) AS unlabelled, count_if(quotable) AS quotable, count_if(off) AS off_mid, count_if(side = 'B' AND off) AS b_total, count_if(side = 'B' AND above) AS b_above, count_if(side = 'A' AND off) AS a_total, count_if(side = 'A' AND above) AS a_above FROM q GROUP BY instrument)
SELECT *, coalesce(off_mid / nullif(quotable, 0), 0.0) AS assignable, CASE WHEN unlabelled = seen THEN 'no label' WHEN b_total + a_total < 40 OR b_total = 0 OR a_total = 0 THEN 'not enough samples' WHEN b_above / b_total >= 0.8 AND a_above / a_total <= 1 - 0.8 THEN 'b is buyer' WHEN a_above / a_total >= 0.8 AND b_above / b_total <= 1 - 0.8 THEN 'a is buyer' ELSE 'unclear' END AS verdict FROM g""",
}
