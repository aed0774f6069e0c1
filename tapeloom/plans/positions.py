"""Queries on positions."""

from pyspark.sql import functions as F

from ..operators import positions as O
from ..sources.fixtures import POSITIONS, positions, with_

SPOT, SIGMA = 115.0, 0.002


def sweep(s, sf, i):
    return positions(s, sf).where(F.col("sweep_id") == i)


def lmap(s, sf):
    return O.liquidation_map(sweep(s, sf, 1), SPOT, 50.0, 0.25, 1000.0)


def diff(s, sf):
    return O.diff(sweep(s, sf, 1), sweep(s, sf, 2), SPOT, 0.02, 0.005, 0.01)


def strengths(s, sf):
    return O.strength(positions(s, sf), SPOT, SIGMA)


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 4) for c in cols})


QUERIES = {
    "liq_map": lambda s, sf: rounded(lmap(s, sf), "long_notional", "short_notional"),
    "liq_concentration": lambda s, sf: O.concentration(lmap(s, sf), 5),
    "position_diff": diff,
    "conviction_flow": lambda s, sf: rounded(O.conviction(diff(s, sf)), "notional", "net_of_coin"),
    "strength_scores": strengths,
    "cohort_summary": lambda s, sf: rounded(O.cohorts(strengths(s, sf)), "longs", "shorts", "fragile_longs", "fragile_shorts", "net_fragile"),
    "consensus": lambda s, sf: rounded(O.consensus(strengths(s, sf), SPOT, 5000.0), "longs", "shorts", "winning_longs", "winning_shorts"),
    "pressure_map": lambda s, sf: rounded(O.pressure_map(strengths(s, sf), positions(s, sf), SPOT, 50.0, 0.25, 1000.0), "long_notional", "short_notional"),
    "latest_position": lambda s, sf: O.latest(positions(s, sf), ["wallet", "coin"], [F.desc("sweep_id")]).select("wallet", "coin", "sweep_id", "szi"),
    "unresolved_positions": lambda s, sf: O.unresolved(sweep(s, sf, 1).select("wallet", "coin"), sweep(s, sf, 2).select("wallet"), "wallet"),
}

P = with_(POSITIONS)
MAP = f""", m AS (SELECT coin, CAST(floor((liquidation_px - {SPOT}) / ({SPOT} * 50.0 / 1e4)) AS BIGINT) AS bucket, sum(CASE WHEN szi > 0 THEN abs(szi) * entry_px ELSE 0 END) AS long_notional, sum(CASE WHEN szi < 0 THEN abs(szi) * entry_px ELSE 0 END) AS short_notional, count(*) AS n, count(DISTINCT wallet) AS wallets
FROM positions WHERE sweep_id = 1 AND abs(liquidation_px / {SPOT} - 1) <= 0.25 AND abs(szi) * entry_px >= 1000 AND CASE WHEN szi > 0 THEN liquidation_px <= {SPOT} ELSE liquidation_px >= {SPOT} END GROUP BY ALL)"""
DIFF = f""", b AS (SELECT * FROM positions WHERE sweep_id = 1), a AS (SELECT * FROM positions WHERE sweep_id = 2),
x AS (SELECT wallet, coin, b.szi AS s0, a.szi AS s1, b.liquidation_px AS l0, a.liquidation_px AS l1, coalesce(abs(b.szi) * b.entry_px, 0) AS notional_0, coalesce(abs(a.szi) * a.entry_px, 0) AS notional_1 FROM b FULL JOIN a USING (wallet, coin) WHERE b.szi IS NULL OR a.szi IS NULL OR b.szi <> 0),
y AS (SELECT *, CASE WHEN s1 IS NULL THEN -1.0 WHEN s0 IS NULL THEN 1.0 ELSE (abs(s1) - abs(s0)) / abs(s0) END AS size_change FROM x),
z AS (SELECT *, CASE WHEN s0 IS NOT NULL AND s1 IS NOT NULL AND size_change BETWEEN -0.02 AND 0.02 AND l0 > 0 AND l1 IS NOT NULL THEN (l1 - l0) / l0 ELSE 0.0 END AS liq_move FROM y),
d AS (SELECT wallet, coin, CASE WHEN s0 IS NULL THEN 'OPENED' WHEN s1 IS NULL THEN CASE WHEN coalesce(abs({SPOT} - l0) / {SPOT} <= 0.01, false) THEN 'LIQUIDATED' ELSE 'CLOSED' END WHEN size_change > 0.02 THEN 'ADDED' WHEN size_change < -0.02 THEN 'REDUCED'
  WHEN CASE WHEN s0 > 0 THEN -liq_move ELSE liq_move END > 0.005 THEN 'DEFENDED' WHEN CASE WHEN s0 > 0 THEN -liq_move ELSE liq_move END < -0.005 THEN 'WEAKENED' ELSE 'HELD' END AS kind, size_change, liq_move, notional_0, notional_1 FROM z)"""
ST = f""", st AS (SELECT sweep_id, wallet, coin, szi, entry_px, abs(szi) * entry_px AS notional, account_value, CASE WHEN liquidation_px > 0 THEN abs(ln(liquidation_px / {SPOT})) / ({SIGMA} * 240 ** 0.5) ELSE 'infinity'::DOUBLE END AS sigmas, CASE WHEN liquidation_px > 0 THEN abs(liquidation_px - {SPOT}) / {SPOT} ELSE 'infinity'::DOUBLE END AS distance,
  CASE WHEN account_value > 0 THEN margin_used / account_value ELSE 0.0 END AS commitment, funding / coalesce(nullif(abs(szi) * entry_px, 0), 1.0) * 365.0 AS carry, szi * ({SPOT} - entry_px) / coalesce(nullif(abs(szi) * entry_px, 0), 1.0) AS maturity, CASE WHEN account_value > 0 THEN coalesce(nullif(abs(szi) * entry_px, 0), 1.0) / account_value ELSE 0.0 END AS effective_leverage, isolated FROM positions),
sv AS (SELECT *, CASE WHEN sigmas <= 0 THEN 0.0 ELSE least(1.0, (1 - exp(-sigmas / 2)) / (1 + 2 * greatest(0.0, commitment)) * CASE WHEN carry > 0 THEN 1 / (1 + carry) ELSE 1 + least(0.15, abs(carry) * 0.3) END * CASE WHEN isolated THEN 1.0 ELSE 1.15 END) END AS survivability FROM st),
str AS (SELECT * EXCLUDE (isolated), greatest(0.0, least(1.0, 1 - survivability)) AS fragility FROM sv)"""

ORACLE = {
    "liq_map": P + MAP + "SELECT coin, bucket, round(long_notional, 4) AS long_notional, round(short_notional, 4) AS short_notional, n, wallets FROM m",
    "liq_concentration": P + MAP + ", r AS (SELECT *, long_notional + short_notional AS t, row_number() OVER (PARTITION BY coin ORDER BY long_notional + short_notional DESC, bucket) AS rank FROM m) SELECT coin, sum(CASE WHEN rank <= 5 THEN t END) / sum(t) AS share, count(*) AS buckets FROM r GROUP BY coin",
    "position_diff": P + DIFF + " SELECT * FROM d",
    "conviction_flow": P
    + DIFF
    + """, c AS (SELECT coin, kind, count(*) AS n, sum(greatest(notional_0, notional_1)) AS notional FROM d WHERE kind <> 'LIQUIDATED' GROUP BY ALL)
SELECT coin, kind, n, round(notional, 4) AS notional, round(sum(notional * CASE WHEN kind IN ('OPENED', 'ADDED', 'DEFENDED') THEN 1 WHEN kind IN ('CLOSED', 'REDUCED', 'WEAKENED') THEN -1 ELSE 0 END) OVER (PARTITION BY coin), 4) AS net_of_coin FROM c""",
    "strength_scores": P + ST + " SELECT * FROM str",
    "cohort_summary": P
    + ST
    + """, g AS (SELECT coin, count(*) AS n, sum(CASE WHEN szi > 0 THEN notional ELSE 0 END) AS longs, sum(CASE WHEN szi > 0 THEN 0 ELSE notional END) AS shorts, sum(CASE WHEN szi > 0 THEN notional * fragility ELSE 0 END) AS fl, sum(CASE WHEN szi > 0 THEN 0 ELSE notional * fragility END) AS fs, avg(survivability) AS survivability, avg(CASE WHEN carry > 0 THEN 1 ELSE 0 END) AS paying FROM str GROUP BY coin)
SELECT coin, n, round(longs, 4) AS longs, round(shorts, 4) AS shorts, round(fl, 4) AS fragile_longs, round(fs, 4) AS fragile_shorts, survivability, paying, round(fl - fs, 4) AS net_fragile FROM g""",
    "consensus": P
    + ST
    + f""", w AS (SELECT *, maturity > 0 AS wins, maturity > 0 OR NOT max(maturity > 0) OVER (PARTITION BY coin) AS counts FROM str WHERE notional >= 5000 AND szi <> 0),
g AS (SELECT coin, count(*) AS n, count_if(wins) AS winning, count_if(maturity < 0) AS losing, sum(CASE WHEN szi > 0 THEN notional ELSE 0 END) AS longs, sum(CASE WHEN szi > 0 THEN 0 ELSE notional END) AS shorts, sum(CASE WHEN szi > 0 AND counts THEN notional ELSE 0 END) AS wl, sum(CASE WHEN szi < 0 AND counts THEN notional ELSE 0 END) AS ws FROM w GROUP BY coin),
h AS (SELECT w.coin, sum(entry_px * notional) / sum(notional) AS entry, quantile_cont(sigmas, 0.5) AS room FROM w JOIN g USING (coin) WHERE counts AND (szi > 0) = (wl >= ws) GROUP BY w.coin),
x AS (SELECT *, CASE WHEN wl >= ws THEN 'long' ELSE 'short' END AS direction, greatest(wl, ws) / (wl + ws) AS strength, CASE WHEN wl >= ws THEN 1 ELSE -1 END * ({SPOT} - entry) / entry AS entry_gap FROM g JOIN h USING (coin))
SELECT coin, n, winning, losing, round(longs, 4) AS longs, round(shorts, 4) AS shorts, round(wl, 4) AS winning_longs, round(ws, 4) AS winning_shorts, direction, entry, room, strength, entry_gap, entry_gap > 0.02 AS late, strength >= 0.75 AND room < 1.5 AS crowded FROM x""",
    "pressure_map": P
    + ST
    + f""", q AS (SELECT p.coin, p.wallet, p.szi, p.liquidation_px, abs(p.szi) * p.entry_px * fragility AS v FROM positions p JOIN str USING (sweep_id, wallet, coin))
SELECT coin, CAST(floor((liquidation_px - {SPOT}) / ({SPOT} * 50.0 / 1e4)) AS BIGINT) AS bucket, round(sum(CASE WHEN szi > 0 THEN v ELSE 0 END), 4) AS long_notional, round(sum(CASE WHEN szi < 0 THEN v ELSE 0 END), 4) AS short_notional, count(*) AS n, count(DISTINCT wallet) AS wallets
FROM q WHERE abs(liquidation_px / {SPOT} - 1) <= 0.25 AND v >= 1000 AND CASE WHEN szi > 0 THEN liquidation_px <= {SPOT} ELSE liquidation_px >= {SPOT} END GROUP BY ALL""",
    "latest_position": P + "SELECT wallet, coin, max(sweep_id) AS sweep_id, arg_max(szi, sweep_id) AS szi FROM positions GROUP BY ALL",
    "unresolved_positions": P + "SELECT wallet, coin FROM positions WHERE sweep_id = 1 AND wallet NOT IN (SELECT wallet FROM positions WHERE sweep_id = 2)",
}
