"""Queries on candles read before they close."""

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import candles as O
from ..operators import flow as L
from ..operators import reads as R
from ..operators import structure as S
from ..sources.fixtures import TAPE, TOUCH, tape, touch, with_
from ..sources.scratch import held
from .bars import FLOW, HOUR, OHLC

BAR, SEEN = 12 * HOUR, 9 * HOUR


def read(s, sf):
    """Bars of twelve hours as they stand after nine. Structure is the way of the bar before; nothing feeds zones and magnets here."""
    t = tape(s, sf)
    early = F.col("us") - B.bucket("us", BAR) < SEEN * B.SECOND
    part, bars, key = held(B.time_bars(t.where(early), BAR)), held(B.time_bars(t, BAR)), ["instrument", "bar_us"]
    whole = bars.select(*key, (F.col("close") > F.col("open")).alias("up"))
    flow = R.absorption(part, 60, 3, 10).select(*key, F.col("ratio").alias("impact_ratio"), (F.col("confident") & (F.col("expected") > 0)).alias("impact_confident"), (F.col("delta") >= 0).alias("aggressor_up"), F.abs("delta").alias("aggression"))
    pa = S.price_action(part, 12).select(*key, (F.col("sweep") * 0.5 + F.col("rejection") * 0.3 + F.col("acceptance") * 0.2).alias("pa"))
    bands = L.vwap_bands(part).select(*key, "vwap", F.col("sd").alias("vwap_sd"))
    top = touch(t).where(early).groupBy("instrument", B.bucket("us", BAR).alias("bar_us")).agg(F.max_by((F.col("bid_sz") - F.col("ask_sz")) / (F.col("bid_sz") + F.col("ask_sz")), "seq").alias("imbalance"))
    x = part.withColumn("last", F.col("close"))
    for other in (whole, flow, pa, bands, top):
        x = x.join(other, key)
    was = bars.select("instrument", (F.col("bar_us") + BAR * B.SECOND).alias("bar_us"), F.when(F.col("close") > F.col("open"), "up").when(F.col("close") < F.col("open"), "down").alias("trend"))
    none = {n: F.lit(None).cast(t) for n, t in (("zone", "string"), ("zone_fresh", "boolean"), ("magnet_bps", "double"), ("magnet_notional", "double"))}
    x = x.join(was, key, "left").withColumns(none | {"elapsed": F.lit(SEEN / BAR)})
    return O.score(O.signals(x))


SHOWN = ["instrument", "bar_us", "score", "lean", "band", "agreement", "confidence"]

QUERIES = {
    "candle_signals": lambda s, sf: read(s, sf).select("instrument", "bar_us", *(f"signals.{n}" for n in O.WEIGHTS)),
    "candle_read": lambda s, sf: read(s, sf).select(*SHOWN, "up"),
    "candle_calibration": lambda s, sf: O.calibration(read(s, sf)),
    "candle_calibrated": lambda s, sf: O.calibrated(read(s, sf)).select("instrument", "bar_us", "band", "samples", "in_band", "rate"),
}

_U = BAR * B.SECOND
SQL = (
    with_(TAPE, TOUCH)
    + f""", pt AS (SELECT instrument, us // {_U} * {_U} AS bar_us, {OHLC}, {FLOW.format(s="sz")} FROM tape WHERE us % {_U} < {SEEN * B.SECOND} GROUP BY 1, 2),
wh AS (SELECT instrument, us // {_U} * {_U} AS bar_us, arg_min(px_ticks, seq) AS o, arg_max(px_ticks, seq) AS c FROM tape GROUP BY 1, 2),
tp AS (SELECT instrument, us // {_U} * {_U} AS bar_us, arg_max((bid_sz - ask_sz) / (bid_sz + ask_sz), seq) AS imbalance FROM touch WHERE us % {_U} < {SEEN * B.SECOND} GROUP BY 1, 2),
a AS (SELECT *, CASE WHEN abs(delta) >= 3 THEN abs(close - open) / abs(delta) END AS per, high + low + close AS tp3, high - greatest(open, close) AS wick_up, least(open, close) - low AS wick_down FROM pt),
b AS (SELECT *, median(per) OVER u AS usual, count(per) OVER u AS samples, sum(volume) OVER r::DOUBLE AS v, sum(tp3 * volume) OVER r::DOUBLE AS pv, sum(tp3 * tp3 * volume) OVER r::DOUBLE AS ppv, max(high) OVER p AS ph, min(low) OVER p AS pl, count(*) OVER r AS nth FROM a
  WINDOW u AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING)),
c AS (SELECT b.*, CASE WHEN delta >= 0 THEN 1 ELSE -1 END AS aggr, coalesce(usual, 0) * abs(delta) AS expected, pv / v / 3 AS vwap, sqrt(greatest((ppv * v - pv * pv) / v / v / 9, 0)) AS sd, imbalance, w.c > w.o AS up, sign(q.c - q.o) AS trend FROM b JOIN wh w USING (instrument, bar_us) JOIN tp USING (instrument, bar_us) LEFT JOIN wh q ON q.instrument = b.instrument AND q.bar_us = b.bar_us - {_U}),
d AS (SELECT *, CASE WHEN expected > 0 THEN (close - open) * aggr / expected END AS ratio, samples >= 10 AND expected > 0 AS sure,
  CASE WHEN nth < 3 THEN 0 ELSE 0.5::DOUBLE * CASE WHEN high > ph AND close < ph THEN -least(1.0, 0.4 + (high - ph) / ph * 10000 / 25) WHEN low < pl AND close > pl THEN least(1.0, 0.4 + (pl - low) / pl * 10000 / 25) ELSE 0 END
  + 0.3::DOUBLE * CASE WHEN high <= low THEN 0 WHEN wick_up / (high - low) > 0.45 AND wick_up > wick_down * 1.5 THEN -wick_up / (high - low) WHEN wick_down / (high - low) > 0.45 AND wick_down > wick_up * 1.5 THEN wick_down / (high - low) ELSE 0 END
  + 0.2::DOUBLE * CASE WHEN high > ph AND close < ph OR low < pl AND close > pl THEN 0 WHEN close > ph THEN 1 WHEN close < pl THEN -1 ELSE 0 END END AS pa FROM c),
e AS (SELECT *, sure AND abs(delta) > 0 AND ratio < 0.5 AS absorbed FROM d),
sg AS (SELECT instrument, bar_us, up, CASE WHEN buy + sell > 0 THEN CASE WHEN absorbed OR abs(buy - sell) / (buy + sell) <= 0.05 THEN 0.0 ELSE (buy - sell) / (buy + sell) END END AS flow,
  CASE WHEN high > low THEN CASE WHEN abs((close - low) / (high - low) - 0.5) * 2 <= 0.1 THEN 0.0 ELSE ((close - low) / (high - low) - 0.5) * 2 * CASE WHEN absorbed THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END END END AS position,
  CASE WHEN abs(imbalance) > 0.1 THEN imbalance ELSE 0.0 END AS imbalance, CASE WHEN absorbed THEN -aggr * least(1 - greatest(ratio, 0), 1) WHEN sure AND abs(delta) > 0 AND ratio > 2 THEN aggr * least((ratio - 1) / 3, 1) END AS absorption, CASE WHEN pa <> 0 THEN pa END AS price_action,
  CASE WHEN close >= vwap + 2 * sd THEN CASE WHEN close > vwap THEN -0.5 ELSE 0.5 END WHEN close <= vwap - 2 * sd THEN 0.5 END::DOUBLE AS vwap, CASE trend WHEN 1 THEN 0.6 WHEN -1 THEN -0.6 END::DOUBLE AS structure, NULL::DOUBLE AS zone, NULL::DOUBLE AS magnet FROM e),
sc AS (SELECT s.instrument, s.bar_us, any_value(up) AS up, coalesce(sum(x * w) / nullif(sum(w) FILTER (x IS NOT NULL), 0), 0) AS score, count_if(x > 0) AS ups, count_if(x < 0) AS downs FROM sg s, (SELECT unnest([{", ".join(f"'{n}'" for n in O.WEIGHTS)}]) AS n, unnest([{", ".join(f"{w}::DOUBLE" for w in O.WEIGHTS.values())}]) AS w) k, LATERAL (SELECT CASE n {" ".join(f"WHEN '{n}' THEN s.{n}" for n in O.WEIGHTS)} END AS x) GROUP BY 1, 2),
ln AS (SELECT *, CASE WHEN score > 0.15 THEN 'up' WHEN score < -0.15 THEN 'down' ELSE 'flat' END AS lean, CASE WHEN score < -0.5 THEN 'strong down' WHEN score < -0.15 THEN 'down' WHEN score < 0.15 THEN 'flat' WHEN score < 0.5 THEN 'up' ELSE 'strong up' END AS band FROM sc),
ag AS (SELECT *, coalesce(CASE lean WHEN 'up' THEN ups WHEN 'down' THEN downs END / nullif(ups + downs, 0), 0.0) AS agreement FROM ln)
"""
)

ORACLE = {
    "candle_signals": SQL + f"SELECT instrument, bar_us, {', '.join(O.WEIGHTS)} FROM sg",
    "candle_read": SQL + f"SELECT instrument, bar_us, score, lean, band, agreement, sqrt({SEEN / BAR}) * greatest(agreement, 0.3) * least(abs(score) / 0.5, 1.0) AS confidence, up FROM ag",
    "candle_calibration": SQL + "SELECT b AS band, count(up) AS n, avg(CAST(up AS INTEGER)) AS up_rate FROM (SELECT unnest(['strong down', 'down', 'flat', 'up', 'strong up']) AS b) LEFT JOIN ag ON band = b GROUP BY b",
    "candle_calibrated": SQL
    + """, k AS (SELECT instrument, bar_us, band, count(*) OVER (PARTITION BY instrument ORDER BY bar_us) - 1 AS samples, count(*) OVER o - 1 AS in_band, count_if(up) OVER o - CAST(up AS INTEGER) AS ups FROM ag WINDOW o AS (PARTITION BY instrument, band ORDER BY bar_us))
SELECT instrument, bar_us, band, samples, in_band, CASE WHEN samples >= 40 AND in_band >= 10 THEN ups / in_band END AS rate FROM k""",
}
