"""Queries on whether results beat chance."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.market import pit
from ..operators import validation as O
from ..sources.fixtures import LEDGER, ledger, with_
from .bars import BARS, hours
from .ledger import CALLS, states
from .outcomes import LCG2, touches, prints, HORIZON
from ..operators import outcomes as X
from ..sources.fixtures import TAPE


def observed(s, sf):
    """Touches with what a driftless walk expects of their distance, and the block that they belong to."""
    t = X.first_touch(touches(s, sf), prints(s, sf), HORIZON).where("prints > 0")
    d = F.abs(F.col("level") - F.col("spot"))
    return t.select("event_id", "instrument", F.floor(F.col("event_id") / 500).alias("block"), F.col("touched").cast("int").alias("touched"), d.alias("distance"), (1 / (1 + d * 0.5)).alias("expected"), F.when(X.lcg(X.lcg(F.col("event_id") + 17)) % 20 == 0, "placebo").otherwise("real").alias("kind"), "spot", "last_px", "level")


def lifts(s, sf):
    return O.lift(observed(s, sf), [O.bands(F.col("distance").cast("double"), [0, 1, 2, 3, 4, 5, 6]).alias("band")]).where("n >= 10")


def pits(s, sf):
    """Where each bar's move stands among the twenty before."""
    w = W.partitionBy("instrument").orderBy("bar_us").rowsBetween(-20, -1)
    b = hours(s, sf).withColumn("move", F.col("close") - F.col("open")).withColumn("before", F.collect_list("move").over(w))
    return b.select("instrument", "bar_us", pit(F.col("move"), F.col("before")).alias("u")).where("u is not null")


QUERIES = {
    "touch_lift": lambda s, sf: O.lift(observed(s, sf), [F.col("instrument")]),
    "lift_by_distance": lifts,
    "placebo_compare": lambda s, sf: observed(s, sf).groupBy("kind").agg(F.count("*").alias("n"), F.avg("touched").alias("touched"), F.avg("distance").alias("distance")),
    "lift_bootstrap": lambda s, sf: O.block_bootstrap(observed(s, sf), "block", "touched", "expected", 200, 1),
    "permutation_control": lambda s, sf: O.permutation(states(s, sf).withColumn("id", F.col("bar_us") / 3600000000).withColumn("id", F.col("id").cast("long") + F.substring("instrument", 2, 1).cast("long") * 1000003), "move", "side", "id", 100, 3),
    "calibration_pit": lambda s, sf: O.calibration(observed(s, sf), "expected", "touched", 10),
    "pit_histogram": lambda s, sf: O.pit_histogram(pits(s, sf), "u", 10),
    "lead_lag_corr": lambda s, sf: O.lead_lag(hours(s, sf).withColumn("ret", F.col("close") - F.col("open")), "ret", "delta", "bar_us", 5),
    "walk_forward_tune": lambda s, sf: O.walk_forward(ledger(s, sf), ["closed_at"], "net_bps", "mfe_bps", [0.0, 3.0, 6.0, 9.0], 0.6, 40),
    "directional_edge": lambda s, sf: O.mean_table(states(s, sf), ["instrument", "side"], "called"),
}

OBS = f""", e AS (SELECT seq AS event_id, instrument, us AS at_us, px_ticks AS spot, px_ticks + k % 11 - 5 AS level FROM tape),
x AS (SELECT event_id, min(CASE WHEN CASE WHEN level >= spot THEN px_ticks >= level ELSE px_ticks <= level END THEN us END) AS hit_us, arg_max(px_ticks, seq) AS last_px FROM e JOIN tape t ON t.instrument = e.instrument AND us > at_us AND us <= at_us + {HORIZON} GROUP BY ALL),
obs AS (SELECT event_id, instrument, event_id // 500 AS block, CASE WHEN hit_us IS NULL THEN 0 ELSE 1 END AS touched, abs(level - spot) AS distance, 1 / (1 + abs(level - spot) * 0.5) AS expected, CASE WHEN {LCG2.format(x='event_id + 17')} % 20 = 0 THEN 'placebo' ELSE 'real' END AS kind FROM e JOIN x USING (event_id))"""
T = with_(TAPE)

ORACLE = {
    "touch_lift": T + OBS + "SELECT instrument, count(*) AS n, CAST(sum(touched) AS BIGINT) AS observed, sum(expected) AS expected, sum(touched) / sum(expected) AS lift FROM obs GROUP BY instrument",
    "lift_by_distance": T + OBS + "SELECT CAST(distance AS DOUBLE) AS band, count(*) AS n, CAST(sum(touched) AS BIGINT) AS observed, sum(expected) AS expected, sum(touched) / sum(expected) AS lift FROM obs GROUP BY distance HAVING count(*) >= 10",
    "placebo_compare": T + OBS + "SELECT kind, count(*) AS n, avg(touched) AS touched, avg(distance) AS distance FROM obs GROUP BY kind",
    "lift_bootstrap": T
    + OBS
    + f""", b AS (SELECT row_number() OVER (ORDER BY block) - 1 AS i, num, den FROM (SELECT block, sum(touched) AS num, sum(expected) AS den FROM obs GROUP BY block)),
t AS (SELECT count(*) AS n, sum(num) AS a, sum(den) AS b FROM b),
d AS (SELECT draw, n, a, b, unnest(range(n)) AS slot FROM (SELECT unnest(range(200)) AS draw), t),
j AS (SELECT draw, a, b, CAST(floor({LCG2.format(x='draw * 7919 + slot * 104729 + 1')} / 2147483648 * n) AS BIGINT) AS i FROM d),
r AS (SELECT draw, sum(num) / sum(den) AS ratio, any_value(j.a / j.b) AS whole FROM j JOIN b USING (i) GROUP BY draw)
SELECT any_value(whole) AS ratio, quantile_cont(ratio, 0.025) AS lo, quantile_cont(ratio, 0.975) AS hi, count(*) AS draws FROM r""",
    "permutation_control": BARS
    + CALLS
    + f""", i AS (SELECT *, CAST(bar_us / 3600000000 AS BIGINT) + CAST(substr(instrument, 2, 1) AS BIGINT) * 1000003 AS id FROM states),
d AS (SELECT draw, avg(move * CASE WHEN {LCG2.format(x='id * 31 + draw * 65537 + 3')} % 1000 < 500 THEN 1 ELSE -1 END) AS nm, avg(move * side) AS m FROM i, (SELECT unnest(range(100)) AS draw) GROUP BY draw)
SELECT any_value(m) AS mean, avg(CASE WHEN nm >= m THEN 1 ELSE 0 END) AS p, count(*) AS draws FROM d""",
    "calibration_pit": T + OBS + "SELECT CAST(least(floor(expected * 10), 9) AS BIGINT) AS bin, count(*) AS n, avg(expected) AS predicted, avg(touched) AS observed FROM obs GROUP BY ALL",
    "pit_histogram": BARS
    + """, m AS (SELECT *, close - open AS move FROM bars), l AS (SELECT move, list(move) OVER (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS before FROM m),
u AS (SELECT len(list_filter(before, lambda x: x < move)) / len(before) AS u FROM l WHERE len(before) > 0),
h AS (SELECT CAST(least(floor(u * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM u GROUP BY ALL), a AS (SELECT b.bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN h USING (bin)) SELECT bin, n, n * 10 / sum(n) OVER () - 1 AS excess FROM a""",
    "lead_lag_corr": BARS
    + ", s AS (SELECT close - open AS ret, "
    + ", ".join(f"lag(delta, {k}) OVER w AS l{k + 5}" if k >= 0 else f"lead(delta, {-k}) OVER w AS l{k + 5}" for k in range(-5, 6))
    + " FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY bar_us)) "
    + " UNION ALL ".join(f"SELECT {k} AS lag, corr(ret, l{k + 5}) AS corr FROM s" for k in range(-5, 6)),
    "walk_forward_tune": with_(LEDGER)
    + """, p AS (SELECT *, CASE WHEN percent_rank() OVER (ORDER BY closed_at) < 0.6 THEN 'fit' ELSE 'test' END AS part FROM ledger),
g AS (SELECT threshold, count(CASE WHEN part = 'fit' THEN net_bps END) AS fit_n, avg(CASE WHEN part = 'fit' THEN net_bps END) AS fit_mean, count(CASE WHEN part = 'test' THEN net_bps END) AS test_n, avg(CASE WHEN part = 'test' THEN net_bps END) AS test_mean FROM p, (SELECT unnest([0.0, 3.0, 6.0, 9.0]::DOUBLE[]) AS threshold) WHERE mfe_bps >= threshold GROUP BY threshold)
SELECT *, threshold = (SELECT threshold FROM g WHERE fit_n >= 40 ORDER BY fit_mean DESC, threshold DESC LIMIT 1) AS chosen FROM g""",
    "directional_edge": BARS + CALLS + ", g AS (SELECT instrument, side, count(called) AS n, avg(called) AS mean, stddev_samp(called) AS sd FROM states GROUP BY ALL) SELECT *, mean - 1.959963984540054 * sd / sqrt(n) AS lo, mean + 1.959963984540054 * sd / sqrt(n) AS hi FROM g",
}
