"""Queries on closed trades and calls."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ledger as O
from ..sources.fixtures import LEDGER, ledger, with_
from .bars import BARS, hours

DIMS = ["grade", "interval_name", "coin", "exit_reason", "source", "agreeing"]


def gates():
    return [("few agree", F.col("agreeing") < 1), ("short", F.col("held_s") < 600), ("adverse", F.col("mae_bps") < -8)]


def calls(s, sf):
    """A call at each hour from its delta, the naive call from its last move, and what the next bar did."""
    w = W.partitionBy("instrument").orderBy("bar_us")
    b = hours(s, sf)
    side = F.when(F.col("delta") > 20, 1).when(F.col("delta") < -20, -1).otherwise(0)
    b = b.select("instrument", "bar_us", side.alias("side"), F.signum(F.col("close") - F.col("open")).cast("int").alias("naive"), F.signum(F.lead("close").over(w) - F.col("close")).cast("int").alias("outcome"), (F.lead("close").over(w) - F.col("close")).alias("move"), "volume", "prints", "delta")
    return b.where("outcome is not null")


def states(s, sf):
    return calls(s, sf).where("side <> 0").withColumn("called", F.col("move") * F.col("side"))


def members():
    return [("confirmed up", (F.col("side") == 1) & (F.col("naive") == 1)), ("confirmed down", (F.col("side") == -1) & (F.col("naive") == -1)), ("confirmed", F.col("side") == F.col("naive")), ("conflict", F.col("side") == -F.col("naive")), ("unconfirmed", F.col("naive") == 0)]


QUERIES = {
    "scorecard_by_dim": lambda s, sf: O.scorecard(ledger(s, sf), DIMS),
    "exit_audit": lambda s, sf: O.exit_audit(ledger(s, sf)),
    "gate_audit": lambda s, sf: O.gate_audit(ledger(s, sf), gates()),
    "callbook_edge": lambda s, sf: O.callbook(calls(s, sf), ["instrument"]),
    "agreement_table": lambda s, sf: O.agreement_table(states(s, sf), members()),
    "feature_slice": lambda s, sf: O.feature_slice(states(s, sf), F.col("volume").cast("double"), [0, 20, 40, 60, 80, 1000], "called"),
    "trade_summary": lambda s, sf: O.summary(ledger(s, sf), ["coin", "source"], 5.0),
    "expectancy": lambda s, sf: O.expectancy(ledger(s, sf), 40.0, 40.0, 2.0),
    "exit_census": lambda s, sf: O.census(ledger(s, sf)),
    "net_histogram": lambda s, sf: O.histogram(ledger(s, sf), "net_bps", -60.0, 60.0, 24),
    "equity_drawdown": lambda s, sf: O.equity(ledger(s, sf), "coin", ["closed_at"]),
}

SCORES = "count(*) AS n, avg(CASE WHEN net_bps > 0 THEN 1 ELSE 0 END) AS hit, avg(net_bps) AS mean_net, stddev_samp(net_bps) AS sd_net, avg(gross_bps) AS mean_gross, avg(mae_bps) AS mae, avg(mfe_bps) AS mfe, avg(held_s) AS held_s"
CALLS = """, b AS (SELECT instrument, bar_us, CASE WHEN delta > 20 THEN 1 WHEN delta < -20 THEN -1 ELSE 0 END AS side, CAST(sign(close - open) AS INTEGER) AS naive, CAST(sign(lead(close) OVER w - close) AS INTEGER) AS outcome, lead(close) OVER w - close AS move, volume FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY bar_us)),
calls AS (SELECT * FROM b WHERE outcome IS NOT NULL), states AS (SELECT *, move * side AS called FROM calls WHERE side <> 0)"""
L = with_(LEDGER)
W95 = "((k / n + 1.9207294103470 / n) {s} 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 0.9603647051735 / (n * n))) / (1 + 3.841458820694124 / n)"

ORACLE = {
    "scorecard_by_dim": L
    + ", g AS ("
    + " UNION ALL ".join(f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, {SCORES} FROM ledger GROUP BY {d}" for d in DIMS)
    + f" UNION ALL SELECT 'all', NULL, {SCORES} FROM ledger) SELECT *, CASE WHEN n < 30 THEN 'too few' WHEN mean_net - 1.96 * sd_net / sqrt(n) > 0 THEN 'pays' WHEN mean_net + 1.96 * sd_net / sqrt(n) < 0 THEN 'loses' WHEN n < 100 THEN 'early' ELSE 'unclear' END AS verdict FROM g",
    "exit_audit": L + "SELECT exit_reason, count(*) AS n, CAST(sum(net_bps) AS BIGINT) AS net, CAST(sum(gross_bps) AS BIGINT) AS gross, CAST(sum(gross_bps - net_bps) AS BIGINT) AS cost, count_if(exit_reason = 'stop' AND mfe_bps >= 6) AS turned FROM ledger GROUP BY ALL",
    "gate_audit": L + "SELECT CASE WHEN agreeing < 1 THEN 'few agree' WHEN held_s < 600 THEN 'short' WHEN mae_bps < -8 THEN 'adverse' ELSE 'taken' END AS gate, count(*) AS n FROM ledger GROUP BY ALL",
    "callbook_edge": BARS
    + CALLS
    + """, g AS (SELECT instrument, count(*) AS offered, count_if(side <> 0) AS called, count_if(side <> 0 AND outcome <> 0) AS scored, count_if(side <> 0 AND outcome = side) AS hits, count_if(side <> 0 AND outcome <> 0 AND outcome = naive) AS naive_hits, count_if(side <> 0 AND side = naive) AS agreed FROM calls GROUP BY ALL)
SELECT *, hits / nullif(scored, 0) AS rate, (hits - naive_hits) / nullif(scored, 0) AS edge, called / nullif(offered, 0) AS coverage, agreed / nullif(called, 0) AS agreement FROM g""",
    "agreement_table": BARS
    + CALLS
    + ", m AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS condition, called FROM states WHERE {c}" for n, c in (("confirmed up", "side = 1 AND naive = 1"), ("confirmed down", "side = -1 AND naive = -1"), ("confirmed", "side = naive"), ("conflict", "side = -naive"), ("unconfirmed", "naive = 0"), ("all", "true")))
    + ") SELECT condition, count(*) AS n, avg(called) AS mean, quantile_cont(called, 0.5) AS median, avg(CASE WHEN called > 0 THEN 1 ELSE 0 END) AS hit, count(*) / (SELECT count(*) FROM states) AS share FROM m GROUP BY condition",
    "feature_slice": BARS
    + CALLS
    + ", f AS (SELECT CASE WHEN volume < 20 THEN 0.0 WHEN volume < 40 THEN 20.0 WHEN volume < 60 THEN 40.0 WHEN volume < 80 THEN 60.0 WHEN volume < 1000 THEN 80.0 END AS band, called FROM states) SELECT CAST(band AS DOUBLE) AS band, count(*) AS n, avg(called) AS mean, avg(CASE WHEN called > 0 THEN 1 ELSE 0 END) AS hit FROM f WHERE band IS NOT NULL GROUP BY band",
    "trade_summary": L
    + f", g AS (SELECT coin, source, count_if(net_bps > 5) AS wins, count_if(net_bps < -5) AS losses, count_if(abs(net_bps) <= 5) AS scratches, CAST(sum(net_bps) AS BIGINT) AS net, list_sort(list(net_bps))[count(*) // 2 + 1] AS median FROM ledger GROUP BY ALL), h AS (SELECT *, wins AS k, wins + losses AS n FROM g) SELECT coin, source, wins, losses, scratches, net, median, {W95.format(s='-')} AS lo, {W95.format(s='+')} AS hi FROM h",
    "expectancy": L + "SELECT coin, count(*) AS n, avg(CASE exit_reason WHEN 'target' THEN 40.0 WHEN 'stop' THEN -40.0 ELSE CAST(gross_bps AS DOUBLE) END - 2) AS expectancy FROM ledger GROUP BY coin",
    "exit_census": L + "SELECT coin, count_if(exit_reason = 'target') AS target, count_if(exit_reason = 'stop') AS stop, count_if(exit_reason = 'candle_end') AS candle_end FROM ledger GROUP BY coin",
    "net_histogram": L + "SELECT CAST(least(floor((net_bps + 60) / 5), 23) AS BIGINT) AS bucket, count(*) AS n FROM ledger WHERE net_bps >= -60 GROUP BY ALL",
    "equity_drawdown": L
    + """, d AS (SELECT coin, closed_at, CAST(sum(net_bps) AS BIGINT) AS day_net FROM ledger GROUP BY ALL),
t AS (SELECT *, CAST(sum(day_net) OVER (PARTITION BY coin ORDER BY closed_at) AS BIGINT) AS total FROM d) SELECT *, greatest(max(total) OVER (PARTITION BY coin ORDER BY closed_at), 0) - total AS drawdown FROM t""",
}
