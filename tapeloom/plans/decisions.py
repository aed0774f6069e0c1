"""Queries on runways and proposed trades."""

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import decisions as O
from ..operators import profile as P
from ..sources.fixtures import DEPTH, TAPE, TOUCH, depth, tape, with_
from .bars import bars_sql, hours
from .profile import DAY

DAY_US, BAR = DAY * B.SECOND, 2 * DAY


def entries(s, sf):
    """Both sides of every book, beside the prices that held much of the day before, the turns of the hours before, and a cluster of liquidations."""
    t = tape(s, sf)
    sides = F.explode(F.array(F.lit("long"), F.lit("short"))).alias("side")
    b = depth(t).select("instrument", "seq", "us", "k", "bids", "asks", B.bucket("us", 3600).alias("bar_us"), B.bucket("us", DAY).alias("day_us"), sides)
    held = P.price_profile(t.withColumn("day_us", B.bucket("us", DAY)), ["instrument", "day_us"], 1).withColumnsRenamed({"row": "px", "volume": "total"})
    held = O.walls(held, ["instrument", "day_us"], 0.08).withColumn("day_us", F.col("day_us") + F.lit(DAY_US))
    turns = O.extremes(hours(s, sf)).select("instrument", "bar_us", "swing_high", "swing_low")
    entry = F.when(F.col("side") == "long", F.get("asks", F.lit(0))["px"]).otherwise(F.get("bids", F.lit(0))["px"])
    e = b.join(turns, ["instrument", "bar_us"]).join(held, ["instrument", "day_us"], "left").withColumn("entry", entry)
    return e.withColumns({"cluster_px": F.col("entry") + F.col("k") % 41 - 20, "cluster_size": F.col("k") % 7})


def ahead(s, sf):
    r = O.runway(entries(s, sf), 12.0, 1.6)
    return r.select("instrument", "seq", "side", "entry", "clear_bps", "open_road", "first_kind", F.size("obstacles").alias("n"), F.size(F.filter("obstacles", lambda x: x["kind"] == "liquidation")).alias("n_fuel"))


def read_books(s, sf):
    """Every book with a reading of it: direction and conviction from k, confirmed by the print's side, backed by its size, in bars of two days."""
    t = tape(s, sf)
    b = depth(t).join(t.select("seq", "side", "sz"), "seq").withColumn("bar_us", B.bucket("us", BAR)).withColumnRenamed("side", "print")
    score = (F.col("k") % 21 - 10) / 10
    way = F.when(score > 0.1, "up").when(score < -0.1, "down").otherwise("flat")
    action = F.when(F.col("print") == "B", "up").when(F.col("print") == "A", "down").otherwise("flat")
    b = b.withColumns({"direction": way, "action": action, "conviction": F.abs(score), "samples": 1 + F.col("k") % 40, "backed": F.col("sz") >= 3, "left_s": (F.col("bar_us") + F.lit(BAR * B.SECOND) - F.col("us")) / B.SECOND})
    b = b.withColumn("verdict", F.when(F.col("action") == "flat", "unconfirmed").when(F.col("action") != F.col("direction"), "conflict").otherwise("confirmed"))
    return b.join(O.typical_range(B.time_bars(t, BAR), least=3).select("instrument", "bar_us", "bar_bps"), ["instrument", "bar_us"])


def proposals(s, sf, scalp):
    x = O.suggest(read_books(s, sf), BAR, scalp, notional=100_000.0, fee_bps=0.1, least_samples=3, least_conviction=0.2, least_rr=0.6, most_rate=0.8)
    return x.select("instrument", "seq", "gate", "side", "entry", "tick", "target_px", "stop_px", "target_bps", "risk_bps", "cost_bps", F.col("capped").cast("int").alias("capped"))


QUERIES = {
    "runway_ahead": ahead,
    "suggestions": lambda s, sf: proposals(s, sf, False),
    "suggestions_scalp": lambda s, sf: proposals(s, sf, True),
    "suggestion_gates": lambda s, sf: proposals(s, sf, True).groupBy("instrument", "gate").agg(F.count("*").alias("n")),
}

AHEAD = (
    with_(TAPE, TOUCH, DEPTH, bars_sql(3600))
    + f""", p AS (SELECT instrument, us // {DAY_US} * {DAY_US} + {DAY_US} AS day_us, px_ticks AS px, sum(sz) AS n FROM tape GROUP BY ALL),
wall AS (SELECT instrument, day_us, px FROM p QUALIFY n >= 0.08 * sum(n) OVER (PARTITION BY instrument, day_us)),
turn AS (SELECT instrument, bar_us, CASE WHEN count(*) OVER w >= 3 THEN max(high) OVER w END AS hi, CASE WHEN count(*) OVER w >= 3 THEN min(low) OVER w END AS lo FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
e AS (SELECT instrument, seq, k, us // {DAY_US} * {DAY_US} AS day_us, us // 3600000000 * 3600000000 AS bar_us, side, sign, CASE sign WHEN 1 THEN ask_px ELSE bid_px END AS entry FROM depth, (VALUES ('long', 1), ('short', -1)) v(side, sign) WHERE i = 0),
lv AS (SELECT e.seq, side, CASE sign WHEN 1 THEN ask_px ELSE bid_px END AS px, sz, (CASE sign WHEN 1 THEN ask_px ELSE bid_px END - entry) * sign AS d, entry FROM e JOIN depth d USING (seq)),
near AS (SELECT *, px * sz AS n FROM lv WHERE d > 0 AND d / entry * 1e4 <= 12),
ob AS (
  SELECT seq, side, d / entry * 1e4 AS bps, 'shelf' AS kind FROM near QUALIFY count(*) OVER (PARTITION BY seq, side) >= 3 AND n >= 1.6 * avg(n) OVER (PARTITION BY seq, side)
  UNION ALL SELECT seq, side, abs(px - entry) / entry * 1e4, 'volume' FROM e JOIN wall USING (instrument, day_us) WHERE (px - entry) * sign > 0
  UNION ALL SELECT seq, side, abs(CASE sign WHEN 1 THEN hi ELSE lo END - entry) / entry * 1e4, 'structure' FROM e JOIN turn USING (instrument, bar_us) WHERE (CASE sign WHEN 1 THEN hi ELSE lo END - entry) * sign > 0
  UNION ALL SELECT seq, side, abs(k % 41 - 20) / entry * 1e4, 'liquidation' FROM e WHERE (k % 41 - 20) * sign > 0 AND k % 7 > 0),
g AS (SELECT seq, side, count(*) AS n, count_if(kind = 'liquidation') AS f, min(struct_pack(bps := bps, kind := kind)) FILTER (WHERE kind <> 'liquidation') AS b FROM ob WHERE bps <= 12 GROUP BY ALL)
SELECT instrument, seq, side, entry, coalesce(b.bps, 12.0) AS clear_bps, b IS NULL AS open_road, b.kind AS first_kind, coalesce(n, 0) AS n, coalesce(f, 0) AS n_fuel FROM e LEFT JOIN g USING (seq, side)"""
)


def suggest_sql(scalp: bool) -> str:
    u = BAR * B.SECOND
    aim = (
        """a AS (SELECT *, greatest((cost + hard * (1 - 0.8)) / 0.8, cost / (0.8 * 1.8 - 0.8), least((cost + shelf * (1 - 0.8)) / 0.8, 'inf'::DOUBLE)) AS pays, greatest(1, ceil(cost * 2 / 1e4 * entry)) AS first FROM c),
a2 AS (SELECT *, greatest(first, ceil(pays / 1e4 * entry - 1e-9)) AS steps, greatest(first, floor(left_bps * 0.8 / 1e4 * entry)) AS most FROM a),
t AS (SELECT *, steps / entry * 1e4 AS target, shelf > greatest(2.5 * steps / entry * 1e4, hard, 0.8 * steps / entry * 1e4) AS capped, greatest(hard, 0.8 * steps / entry * 1e4, least(2.5 * steps / entry * 1e4, shelf)) AS risk FROM a2)"""
        if scalp
        else "t AS (SELECT *, greatest(1, round_even(left_bps * 0.5 / 1e4 * entry, 0)) AS steps, steps / entry * 1e4 AS target, false AS capped, greatest(shelf, hard, bar_bps * 0.15) AS risk FROM c)"
    )
    late = "WHEN steps > most THEN 'breakeven' WHEN target > left_bps * 0.8 THEN 'no room' WHEN target < cost * 2 THEN 'cost'" if scalp else "WHEN target > left_bps * 0.8 THEN 'no room' WHEN target < cost * 2 THEN 'cost' WHEN target / risk < 0.6 THEN 'shape'"
    return (
        with_(TAPE, TOUCH, DEPTH, bars_sql(BAR))
        + f""", r AS (SELECT instrument, bar_us, CASE WHEN count(*) OVER w >= 3 THEN median((high - low) / ((high + low) / 2) * 1e4) OVER w END AS bar_bps FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
f AS (SELECT seq, i, bid_px, ask_px, sz, least(greatest(100000 - coalesce(sum(ask_px * sz) OVER p, 0), 0), ask_px * sz) AS ta, least(greatest(100000 - coalesce(sum(bid_px * sz) OVER p, 0), 0), bid_px * sz) AS tb FROM depth WINDOW p AS (PARTITION BY seq ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
w AS (SELECT seq, sum(ta) AS pa, sum(tb) AS pb, sum(ta / ask_px) AS qa, sum(tb / bid_px) AS qb, max(CASE WHEN i > 0 THEN struct_pack(n := bid_px * sz, i := -i, px := bid_px) END) AS own_b, max(CASE WHEN i > 0 THEN struct_pack(n := ask_px * sz, i := -i, px := ask_px) END) AS own_a FROM f GROUP BY seq),
x AS (SELECT t.instrument, t.seq, t.side AS print, t.sz, t.k, bid_px, ask_px, (bid_px + ask_px) / 2 AS mid, (t.k % 21 - 10) / 10 AS score, bar_bps, bar_bps * sqrt(least((bar_us + {u} - t.us) / 1e6 / {BAR}, 1.0)) AS left_bps, (bar_us + {u} - t.us) / 1e6 AS left_s, w.* EXCLUDE (seq)
      FROM tape t JOIN touch USING (seq) JOIN w USING (seq) JOIN r ON r.instrument = t.instrument AND r.bar_us = t.us // {u} * {u}),
y AS (SELECT *, CASE WHEN score > 0.1 THEN 1 WHEN score < -0.1 THEN -1 ELSE 0 END AS s, CASE WHEN score > 0.1 THEN ask_px ELSE bid_px END AS entry, CASE WHEN pa < 100000 * (1 - 1e-12) OR pb < 100000 * (1 - 1e-12) THEN NULL ELSE abs(pa / qa - mid) / mid * 1e4 + abs(pb / qb - mid) / mid * 1e4 + 0.1 END AS cost FROM x),
c AS (SELECT *, abs(entry - CASE s WHEN 1 THEN own_b.px - 1 ELSE own_a.px + 1 END) / entry * 1e4 AS shelf, greatest(3 * (ask_px - bid_px), 2) / entry * 1e4 AS hard FROM y),
{aim},
z AS (SELECT *, CASE WHEN 1 + k % 40 < 3 THEN 'warming' WHEN s = 0 THEN 'flat' WHEN print <> 'N' AND (print = 'B') <> (s = 1) THEN 'conflict' WHEN print = 'N' THEN 'unconfirmed' {"WHEN sz < 3 THEN 'unsettled'" if scalp else ''} WHEN abs(score) < 0.2 THEN 'conviction' WHEN left_s < 20 THEN 'too late' WHEN bar_bps IS NULL OR bar_bps <= 0 THEN 'no range' WHEN cost IS NULL THEN 'depth' {late} END AS gate FROM t),
q AS (SELECT *, gate IS NULL OR gate IN ('depth', 'breakeven', 'no room', 'cost', 'shape') AS priced, gate IS NULL OR gate IN ('no room', 'cost', 'shape') AS aimed FROM z),
sg AS (SELECT instrument, seq, gate, CASE s WHEN 1 THEN 'long' WHEN -1 THEN 'short' END AS side, CASE WHEN priced THEN entry END AS entry, CASE WHEN priced THEN 1 END AS tick, CASE WHEN priced THEN cost END AS cost_bps,
  CASE WHEN aimed THEN entry + s * steps END AS target_px, CASE WHEN aimed THEN entry - s * risk * entry / 1e4 END AS stop_px, CASE WHEN aimed THEN target END AS target_bps, CASE WHEN aimed THEN risk END AS risk_bps, CASE WHEN aimed THEN CAST(capped AS INTEGER) END AS capped FROM q)
"""
    )


ORACLE = {
    "runway_ahead": AHEAD,
    "suggestions": suggest_sql(False) + "SELECT * FROM sg",
    "suggestions_scalp": suggest_sql(True) + "SELECT * FROM sg",
    "suggestion_gates": suggest_sql(True) + "SELECT instrument, gate, count(*) AS n FROM sg GROUP BY ALL",
}
