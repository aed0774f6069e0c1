"""Queries on outcomes."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import outcomes as O
from ..sources.fixtures import TAPE, tape, with_
from .bars import HOUR, bars_sql, hours

H_US = HOUR * B.SECOND
HORIZON = 12 * H_US


def prints(s, sf):
    return tape(s, sf).withColumn("px", F.col("px_ticks"))


def touches(s, sf):
    """Every print sets a level of up to five ticks away."""
    return tape(s, sf).select(F.col("seq").alias("event_id"), "instrument", F.col("us").alias("at_us"), F.col("px_ticks").alias("spot"), (F.col("px_ticks") + F.col("k") % 11 - 5).alias("level"))


def signals(s, sf):
    """Bars of strong delta: a buy where buyers lead by ten, a sell where sellers do."""
    b = hours(s, sf).where("abs(delta) >= 30")
    i = F.dense_rank().over(W.partitionBy("instrument").orderBy("bar_us"))
    return b.select((i * 8 + F.substring("instrument", 2, 1).cast("int")).cast("long").alias("event_id"), "instrument", (F.col("bar_us") + H_US - 1).alias("at_us"), F.signum("delta").cast("int").alias("side"), F.col("close").alias("entry"))


def with_paths(s, sf):
    return O.paths(signals(s, sf), hours(s, sf), 20, 3 * 24 * H_US)


def cells(s, sf):
    return O.grid(with_paths(s, sf), [2, 4, 6], [2, 3], 0.5)


def arms(s, sf):
    e = with_paths(s, sf)
    return O.three_arms(e.withColumn("part", F.when(F.col("at_us") < 1705276800000000, "fit").otherwise("test")), 4, 3)


def board(s, sf):
    call = F.when(F.col("delta") >= 30, 1).when(F.col("delta") <= -30, -1).otherwise(0)
    return O.horizon_board(O.forward(hours(s, sf), [1, 2, 3, 5, 10, 20]), call, 0.5)


QUERIES = {
    "touch_resolve": lambda s, sf: O.first_touch(touches(s, sf), prints(s, sf), HORIZON),
    "triple_barrier": lambda s, sf: O.triple_barrier(signals(s, sf), prints(s, sf), 4, 3, HORIZON),
    "triple_barrier_ambiguous": lambda s, sf: O.triple_barrier(signals(s, sf), prints(s, sf), 2, 1, HORIZON, True).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("net").alias("net")),
    "sweep_grid": cells,
    "bracket_fixed": lambda s, sf: O.brackets(with_paths(s, sf), 6, 3),
    "bracket_breakeven": lambda s, sf: O.brackets(with_paths(s, sf), 6, 3, breakeven=2),
    "bracket_trailing": lambda s, sf: O.brackets(with_paths(s, sf), 8, 3, trail=2, arm=3),
    "sweep_surface": lambda s, sf: O.surface(cells(s, sf), 0.5),
    "reach_test": lambda s, sf: O.reach(O.grid(with_paths(s, sf), [1, 2, 3, 4, 6, 8], [3], 0.0)),
    "excursion_distance": lambda s, sf: O.excursions(with_paths(s, sf)),
    "three_arm_backtest": arms,
    "barcall_scoreboard": board,
}

SIGNALS = f"sig AS (SELECT dense_rank() OVER (PARTITION BY instrument ORDER BY bar_us) * 8 + CAST(substr(instrument, 2, 1) AS INTEGER) AS event_id, instrument, bar_us + {H_US} - 1 AS at_us, CAST(sign(delta) AS INTEGER) AS side, close AS entry FROM bars WHERE abs(delta) >= 30)"
S = with_(TAPE, bars_sql(HOUR), SIGNALS)
PATHS = f""", px AS (SELECT s.*, b.bar_us, b.high AS hi, b.low AS lo, b.close, row_number() OVER (PARTITION BY event_id ORDER BY b.bar_us) AS r FROM sig s JOIN bars b ON b.instrument = s.instrument AND b.bar_us > at_us AND b.bar_us <= at_us + {3 * 24 * H_US}),
path AS (SELECT * FROM px WHERE r <= 20)"""


def grid_sql(targets: list[int], stops: list[int], cost: float, source: str = "path") -> str:
    return f""", g AS (SELECT p.event_id, p.instrument, p.side, target, stop, min(CASE WHEN CASE WHEN side > 0 THEN hi - entry ELSE entry - lo END >= target THEN r END) AS t, min(CASE WHEN CASE WHEN side > 0 THEN entry - lo ELSE hi - entry END >= stop THEN r END) AS s,
  arg_max((p.close - entry) * side, r) AS last FROM {source} p, (SELECT unnest({targets}) AS target) a, (SELECT unnest({stops}) AS stop) b GROUP BY ALL),
cells AS (SELECT *, CASE WHEN s IS NOT NULL AND (t IS NULL OR s <= t) THEN -1 WHEN t IS NOT NULL THEN 1 ELSE 0 END AS hit FROM g),
cell AS (SELECT event_id, instrument, side, target, stop, hit, CAST(CASE hit WHEN 1 THEN target WHEN -1 THEN -stop ELSE last END - {cost} AS DOUBLE) AS net FROM cells)"""


def barrier_sql(target: int, stop: int) -> str:
    return (
        S
        + f""", x AS (SELECT s.*, t.us, t.seq, (px_ticks - entry) * s.side AS gain FROM sig s JOIN tape t ON t.instrument = s.instrument AND t.us > at_us AND t.us <= at_us + {HORIZON}),
y AS (SELECT event_id, instrument, x.side, at_us, min(CASE WHEN gain >= {target} THEN us END) AS t, min(CASE WHEN gain <= -{stop} THEN us END) AS s, arg_max(gain, seq) AS last, max(us) AS fin, max(gain) AS mfe, min(gain) AS mae FROM x GROUP BY ALL)"""
    )


W95 = "((k / n + 1.9207294103470 / n) {s} 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 0.9603647051735 / (n * n))) / (1 + 3.841458820694124 / n)"
LCG2 = "((1103515245 * ((1103515245 * (({x}) % 2147483648) + 12345) % 2147483648) + 12345) % 2147483648)"



def bracket_sql(target: int, line: str) -> str:
    """The first bar at the stop's line or the target; b is the best of the bars before."""
    return f""", bk AS (SELECT *, CASE WHEN side > 0 THEN hi - entry ELSE entry - lo END AS fav, CASE WHEN side > 0 THEN lo - entry ELSE entry - hi END AS adv, (close - entry) * side AS gain FROM px WHERE r <= 20),
bb AS (SELECT *, greatest(coalesce(max(fav) OVER (PARTITION BY event_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS b FROM bk),
bl AS (SELECT *, {line} AS line FROM bb), bo AS (SELECT *, CASE WHEN adv <= line THEN 'STOP' WHEN fav >= {target} THEN 'TARGET' END AS o FROM bl)
SELECT event_id, instrument, side, coalesce(arg_min(o, r) FILTER (o IS NOT NULL), 'OPEN') AS outcome, coalesce(arg_min(CASE o WHEN 'STOP' THEN line ELSE {target} END, r) FILTER (o IS NOT NULL), arg_max(gain, r)) AS net, coalesce(min(r) FILTER (o IS NOT NULL), max(r)) AS bars FROM bo GROUP BY 1, 2, 3"""


ORACLE = {
    "bracket_fixed": S + PATHS + bracket_sql(6, "-3"),
    "bracket_breakeven": S + PATHS + bracket_sql(6, "CASE WHEN b >= 2 THEN 0 ELSE -3 END"),
    "bracket_trailing": S + PATHS + bracket_sql(8, "CASE WHEN b >= 3 THEN greatest(-3, b - 2) ELSE -3 END"),
    "touch_resolve": with_(TAPE)
    + f""", e AS (SELECT seq AS event_id, instrument, us AS at_us, px_ticks AS spot, px_ticks + k % 11 - 5 AS level FROM tape),
x AS (SELECT event_id, min(CASE WHEN CASE WHEN level >= spot THEN px_ticks >= level ELSE px_ticks <= level END THEN us END) AS hit_us, arg_max(px_ticks, seq) AS last_px, count(*) AS prints FROM e JOIN tape t ON t.instrument = e.instrument AND us > at_us AND us <= at_us + {HORIZON} GROUP BY ALL)
SELECT event_id, instrument, spot, level, hit_us IS NOT NULL AS touched, (hit_us - at_us) / 60e6 AS minutes, last_px, coalesce(prints, 0) AS prints FROM e LEFT JOIN x USING (event_id)""",
    "triple_barrier": barrier_sql(4, 3)
    + """, o AS (SELECT *, CASE WHEN s IS NOT NULL AND (t IS NULL OR s <= t) THEN 'STOP' WHEN t IS NOT NULL THEN 'TARGET' ELSE 'TIMEOUT' END AS outcome FROM y)
SELECT event_id, instrument, side, outcome, CASE outcome WHEN 'TARGET' THEN 4 WHEN 'STOP' THEN -3 ELSE last END AS net, (CASE outcome WHEN 'TARGET' THEN t WHEN 'STOP' THEN s ELSE fin END - at_us) / 1e6 AS held_s, mfe, mae FROM o""",
    "triple_barrier_ambiguous": barrier_sql(2, 1)
    + """, o AS (SELECT *, CASE WHEN s = t THEN 'AMBIGUOUS' WHEN s IS NOT NULL AND (t IS NULL OR s <= t) THEN 'STOP' WHEN t IS NOT NULL THEN 'TARGET' ELSE 'TIMEOUT' END AS outcome FROM y)
SELECT outcome, count(*) AS n, CAST(sum(CASE outcome WHEN 'TARGET' THEN 2 WHEN 'STOP' THEN -1 WHEN 'TIMEOUT' THEN last END) AS BIGINT) AS net FROM o GROUP BY outcome""",
    "sweep_grid": S + PATHS + grid_sql([2, 4, 6], [2, 3], 0.5) + " SELECT * FROM cell",
    "sweep_surface": S
    + PATHS
    + grid_sql([2, 4, 6], [2, 3], 0.5)
    + ", r AS (SELECT target, stop, count(*) AS n, count_if(hit = 1) AS wins, count_if(hit = -1) AS losses, avg(net) AS mean_net, stddev_samp(net) / sqrt(count(*)) AS error FROM cell GROUP BY ALL) SELECT *, wins / nullif(wins + losses, 0) AS rate, (stop + 0.5) / (target + stop) AS breakeven FROM r",
    "reach_test": S
    + PATHS
    + grid_sql([1, 2, 3, 4, 6, 8], [3], 0.0)
    + f", r AS (SELECT target, count(*) AS n, count_if(hit = 1) AS k FROM cell GROUP BY target) SELECT target, n, k, k / n AS rate, {W95.format(s='-')} AS lo, {W95.format(s='+')} AS hi FROM r",
    "excursion_distance": S + PATHS + " SELECT event_id, instrument, side, CASE WHEN side > 0 THEN max(hi) - entry ELSE entry - min(lo) END AS mfe, CASE WHEN side > 0 THEN entry - min(lo) ELSE max(hi) - entry END AS mae, (arg_max(close, r) - entry) * side AS close FROM path GROUP BY event_id, instrument, side, entry",
    "three_arm_backtest": S
    + PATHS
    + f""", ar AS (SELECT p.* REPLACE (CASE arm WHEN 'signal' THEN side WHEN 'mirror' THEN -side ELSE CASE WHEN {LCG2.format(x='event_id + 7')} % 1000 < 500 THEN 1 ELSE -1 END END AS side), arm, CASE WHEN at_us < 1705276800000000 THEN 'fit' ELSE 'test' END AS part FROM path p, (SELECT unnest(['signal', 'mirror', 'coin']) AS arm) a),
ag AS (SELECT event_id || arm AS event_id, instrument, side, entry, hi, lo, close, r, arm, part FROM ar)"""
    + grid_sql([4], [3], 0.0, "ag").replace("p.side, target", "p.side, arm, part, target").replace("event_id, instrument, side, target, stop, hit, CAST", "event_id, arm, part, hit, CAST")
    + " SELECT arm, part, count(*) AS n, count_if(hit = 1) AS wins, count_if(hit = -1) AS losses, sum(net) AS net FROM cell GROUP BY ALL",
    "barcall_scoreboard": with_(TAPE, bars_sql(HOUR))
    + """, f AS (SELECT CASE WHEN delta >= 30 THEN 1 WHEN delta <= -30 THEN -1 ELSE 0 END AS call, """
    + ", ".join(f"lead(close, {h}) OVER w - close AS m{h}" for h in (1, 2, 3, 5, 10, 20))
    + """ FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY bar_us)),
m AS ("""
    + " UNION ALL ".join(f"SELECT call, {h} AS horizon, m{h} * call AS x FROM f WHERE call <> 0 AND m{h} IS NOT NULL" for h in (1, 2, 3, 5, 10, 20))
    + """) SELECT call, horizon, count(*) AS n, count_if(x > 0.5) AS "right", count_if(abs(x) <= 0.5) AS flat, count_if(x < -0.5) AS wrong, avg(x) AS mean, quantile_cont(x, 0.5) AS median, max(x) AS best, min(x) AS worst FROM m GROUP BY ALL""",
}
