"""Queries on zones, unsettled turns, what follows a touch, the effect of size."""

from pyspark.sql import functions as F

from ..operators import outcomes as X
from ..operators import validation as V
from ..operators import zones as O
from ..sources.fixtures import TAPE, tape, with_
from ..sources.scratch import held
from .bars import hours
from .outcomes import HORIZON, LCG2, prints, touches
from .sequential import ordered
from .structure import BARS4, SWINGS, found, fours
from .studies import LV

FOLLOW = 4 * 3600 * 1_000_000


def moves(s, sf):
    return V.after_touch(touches(s, sf), prints(s, sf), HORIZON, FOLLOW).withColumn("block", F.floor(F.col("event_id") / 500))


def after(s, sf):
    """From how often each move comes in a block, held: all that is asked are sums and a median."""
    m = held(moves(s, sf).groupBy("block", "move").agg(F.count("*").alias("n"))).withColumn("total", F.col("move") * F.col("n"))
    n, up = F.coalesce(F.sum("n"), F.lit(0)), F.sum(F.when(F.col("move") > 0, F.col("n")).otherwise(0))
    return V.block_bootstrap(m, "block", "total", "n", 200, 5).crossJoin(m.agg(n.alias("touches"), F.percentile("move", F.lit(0.5), F.col("n")).alias("median"), (up / F.sum("n")).alias("continued")))


def sized(s, sf):
    t = X.first_touch(touches(s, sf), prints(s, sf), HORIZON).where("prints > 0")
    n = tape(s, sf).select(F.col("seq").alias("event_id"), (F.col("sz") * F.col("px_ticks")).alias("notional"))
    d = F.abs(F.col("level") - F.col("spot"))
    t = t.join(n, "event_id").select("event_id", "notional", F.floor(F.col("event_id") / 500).alias("block"), F.col("touched").cast("int").alias("touched"), (1 / (1 + d * 0.5)).alias("expected"))
    return V.size_effect(t, "notional", 3, 100, 7)


def node_touches(s, sf):
    """Touches of the swing levels, and what became of them over two days of hours."""
    from . import studies as T

    t = T.O.rearmed_touches(tape(s, sf), T.levels(s, sf), 1, 5)
    t = t.select((F.col("seq") * 100_000 + F.col("level")).alias("event_id"), "instrument", F.col("us").alias("at_us"), "level", (F.col("side") == "below").alias("up"))
    return O.touch_outcomes(t, hours(s, sf), 48 * 3600 * 1_000_000, 1, 3, 1, 3, 4)


QUERIES = {
    "node_touches": node_touches,
    "node_catalog": lambda s, sf: node_touches(s, sf).groupBy("label").agg(F.count("*").alias("n"), F.avg("mfe").alias("mfe"), F.avg("mae").alias("mae"), F.percentile("took_us", F.lit(0.5)).alias("median_us"), F.avg(F.col("returned").cast("int")).alias("returned")),
    "supply_zones": lambda s, sf: O.zones(fours(s, sf), found(s, sf), 2.0),
    "provisional_turns": lambda s, sf: O.provisional(fours(s, sf), 5, 3),
    "post_touch": after,
    "size_effect": sized,
}


def boot(src: str, name: str, num: str, den: str, draws: int, seed: int) -> str:
    """The bootstrap of a ratio over blocks, as CTEs that end in {name}: ratio, lo, hi, draws."""
    return f"""{name}_b AS (SELECT row_number() OVER (ORDER BY block) - 1 AS i, num, den FROM (SELECT block, sum({num}) AS num, sum({den}) AS den FROM {src} GROUP BY block)),
{name}_t AS (SELECT count(*) AS n, sum(num) AS a, sum(den) AS b FROM {name}_b),
{name}_d AS (SELECT draw, n, a, b, unnest(range(n)) AS slot FROM (SELECT unnest(range({draws})) AS draw), {name}_t),
{name}_j AS (SELECT draw, a, b, CAST(floor({LCG2.format(x=f'draw * 7919 + slot * 104729 + {seed}')} / 2147483648 * n) AS BIGINT) AS i FROM {name}_d),
{name}_r AS (SELECT draw, sum(num) / sum(den) AS ratio, any_value(j.a / j.b) AS whole FROM {name}_j j JOIN {name}_b USING (i) GROUP BY draw),
{name} AS (SELECT any_value(whole) AS ratio, quantile_cont(ratio, 0.025) AS lo, quantile_cont(ratio, 0.975) AS hi, count(*) AS draws FROM {name}_r)"""


EVENTS = f"""ev AS (SELECT seq AS event_id, instrument, us AS at_us, px_ticks AS spot, px_ticks + k % 11 - 5 AS level, sz * px_ticks AS notional FROM tape),
x AS (SELECT event_id, min(CASE WHEN CASE WHEN level >= spot THEN px_ticks >= level ELSE px_ticks <= level END THEN us END) AS hit_us FROM ev JOIN tape t ON t.instrument = ev.instrument AND us > at_us AND us <= at_us + {HORIZON} GROUP BY ALL),
ob AS (SELECT ev.*, hit_us, event_id // 500 AS block, CASE WHEN hit_us IS NULL THEN 0 ELSE 1 END AS touched, 1 / (1 + abs(level - spot) * 0.5) AS expected FROM ev JOIN x USING (event_id))"""

TOUCHED = """, zz AS (SELECT t.instrument, level, seq, us, px_ticks, CASE WHEN abs(px_ticks - level) <= 1 THEN 'in' WHEN abs(px_ticks - level) >= 5 THEN 'out' END AS zone FROM tape t JOIN (SELECT DISTINCT instrument, level FROM lv) USING (instrument)),
pp AS (SELECT *, lag(zone) OVER (PARTITION BY instrument, level ORDER BY seq) AS prev FROM zz WHERE zone IS NOT NULL),
tc AS (SELECT seq * 100000 + level AS event_id, instrument, us AS at_us, level, px_ticks < level AS up FROM pp WHERE zone = 'in' AND (prev IS NULL OR prev = 'out')),
hr AS (SELECT instrument, us // 3600000000 * 3600000000 AS bar_us, max(px_ticks) AS high, min(px_ticks) AS low, arg_max(px_ticks, seq) AS close FROM tape GROUP BY ALL),
w AS (SELECT event_id, at_us, level, up, bar_us, high, low, close, row_number() OVER (PARTITION BY event_id ORDER BY bar_us) AS i, count(*) OVER (PARTITION BY event_id) AS m FROM tc JOIN hr USING (instrument) WHERE bar_us >= at_us AND bar_us <= at_us - 1 + 172800000000),
st AS (SELECT event_id, CAST(0 AS BIGINT) AS i, false AS beyond, false AS lft, false AS ended, CAST(0 AS BIGINT) AS best, CAST(0 AS BIGINT) AS worst, CAST(0 AS BIGINT) AS fav, CAST(0 AS BIGINT) AS adv, CAST(NULL AS VARCHAR) AS label, CAST(NULL AS BIGINT) AS dist, CAST(NULL AS BIGINT) AS took FROM w WHERE i = 1
  UNION ALL SELECT event_id, i, beyond OR label IS NULL AND past >= 1, lft, ended, best, worst, fav, adv, coalesce(label, nw), CASE WHEN label IS NOT NULL THEN dist ELSE CASE nw WHEN 'reject' THEN adv WHEN 'break_fail' THEN best WHEN 'break_go' THEN fav END END, CASE WHEN label IS NOT NULL THEN took WHEN nw IS NOT NULL THEN dt END FROM (
    SELECT *, CASE WHEN NOT beyond THEN CASE WHEN past < 1 AND adv >= 3 THEN 'reject' END WHEN past <= -1 THEN 'break_fail' WHEN fav >= 4 THEN 'break_go' END AS nw FROM (
      SELECT event_id, i, beyond, lft, ended, CASE WHEN ended THEN best ELSE greatest(best, nf) END AS best, CASE WHEN ended THEN worst ELSE greatest(worst, na) END AS worst, CASE WHEN ended THEN fav ELSE nf END AS fav, CASE WHEN ended THEN adv ELSE na END AS adv, label, dist, took, past, dt FROM (
        SELECT w.event_id, w.i, beyond, lft OR abs(close - level) > 3 AS lft, ended OR abs(close - level) <= 3 AND lft AND abs(close - level) <= 1 AS ended, best, worst, fav, adv, label, dist, took, CASE WHEN up THEN close - level ELSE level - close END AS past, CASE WHEN up THEN high - level ELSE level - low END AS nf, CASE WHEN up THEN level - low ELSE high - level END AS na, bar_us - at_us AS dt
        FROM st JOIN w ON w.event_id = st.event_id AND w.i = st.i + 1)))),
tl AS (SELECT event_id, coalesce(label, 'stall') AS label, coalesce(dist, best) AS dist, coalesce(took, 172800000000) AS took_us, best AS mfe, worst AS mae, ended AS returned FROM st JOIN (SELECT DISTINCT event_id, m FROM w) USING (event_id) WHERE i = m)"""

ORACLE = {
    "node_touches": (BARS4 + "," + SWINGS + LV + TOUCHED).replace("WITH ", "WITH RECURSIVE ", 1) + " SELECT * FROM tl",
    "node_catalog": (BARS4 + "," + SWINGS + LV + TOUCHED).replace("WITH ", "WITH RECURSIVE ", 1) + " SELECT label, count(*) AS n, avg(mfe) AS mfe, avg(mae) AS mae, quantile_cont(took_us, 0.5) AS median_us, avg(CASE WHEN returned THEN 1 ELSE 0 END) AS returned FROM tl GROUP BY label",
    "supply_zones": (BARS4 + "," + SWINGS).replace("WITH ", "WITH RECURSIVE ", 1)
    + """, h AS (SELECT b.instrument, b.bar_us, arg_max(s.px, s.bar_us) FILTER (s.kind = 'high') AS sh, arg_max(s.px, s.bar_us) FILTER (s.kind = 'low') AS sl FROM bars b JOIN swings s ON s.instrument = b.instrument AND s.confirmed_us <= b.bar_us GROUP BY ALL),
c AS (SELECT b.*, sh, sl, {'t': bar_us, 'o': open, 'h': high, 'l': low, 'c': close} AS me FROM bars b JOIN h USING (instrument, bar_us)),
cc AS (SELECT b.instrument, b.bar_us, {'t': b.bar_us, 'o': open, 'h': high, 'l': low, 'c': close} AS me, open, close FROM bars b),
pv AS (SELECT instrument, bar_us, last_value(CASE WHEN close > open THEN me END IGNORE NULLS) OVER w AS up, last_value(CASE WHEN close < open THEN me END IGNORE NULLS) OVER w AS dn FROM cc WINDOW w AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING)),
k AS (SELECT c.instrument, c.bar_us AS at_us, CASE WHEN close < sl THEN 'supply' WHEN close > sh THEN 'demand' END AS kind, close, up, dn FROM c JOIN pv USING (instrument, bar_us)),
z AS (SELECT instrument, at_us, kind, close, CASE kind WHEN 'supply' THEN up ELSE dn END AS o FROM k WHERE kind IS NOT NULL),
e AS (SELECT instrument, at_us, kind, close, o.t AS origin_us, CASE kind WHEN 'supply' THEN greatest(o.o, o.c) ELSE o.l END AS a, CASE kind WHEN 'supply' THEN o.h ELSE least(o.o, o.c) END AS b, o.l AS ol, o.h AS oh FROM z WHERE o IS NOT NULL),
f AS (SELECT instrument, at_us, kind, close, origin_us, CASE WHEN b <= a THEN ol ELSE a END AS lo, CASE WHEN b <= a THEN oh ELSE b END AS hi FROM e),
g AS (SELECT *, abs(close - (lo + hi) / 2) / ((lo + hi) / 2) * 10000 AS impulse FROM f WHERE hi > lo), gg AS (SELECT * FROM g WHERE impulse >= 2.0),"""
    + ordered("gg", "at_us", "origin_us DESC, at_us")
    + """, st AS (SELECT instrument, 1::BIGINT AS i, [{'kind': kind, 'lo': lo, 'hi': hi}] AS kept, true AS taken FROM o WHERE i = 1
  UNION ALL SELECT instrument, i, CASE WHEN t THEN list_append(kept, me) ELSE kept END, t FROM (
    SELECT o.instrument, o.i, kept, {'kind': o.kind, 'lo': o.lo, 'hi': o.hi} AS me, len(kept) < 8 AND len(list_filter(kept, lambda q: q.kind = o.kind AND q.lo <= o.hi AND o.lo <= q.hi)) = 0 AS t FROM st JOIN o ON o.instrument = st.instrument AND o.i = st.i + 1)),
w AS (SELECT o.instrument, o.kind, o.origin_us, o.at_us, o.lo, o.hi, o.impulse FROM st JOIN o USING (instrument, i) WHERE taken)
SELECT w.*, (SELECT count(*) FROM bars b WHERE b.instrument = w.instrument AND b.bar_us > w.at_us AND b.low <= w.hi AND b.high >= w.lo) AS tested FROM w""",
    "provisional_turns": BARS4
    + """, p AS (SELECT instrument, bar_us, high, low, row_number() OVER (PARTITION BY instrument ORDER BY bar_us DESC) - 1 AS age, count(*) OVER b = 5 AND max(high) OVER b <= high AND coalesce(max(high) OVER a < high, true) AS ih, count(*) OVER b = 5 AND min(low) OVER b >= low AND coalesce(min(low) OVER a > low, true) AS il FROM bars
  WINDOW b AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT instrument, bar_us, age, 'high' AS kind, high AS px FROM p WHERE age < 3 AND ih UNION ALL SELECT instrument, bar_us, age, 'low', low FROM p WHERE age < 3 AND il""",
    "post_touch": with_(TAPE, EVENTS)
    + f""", m AS (SELECT event_id, block, (arg_max(px_ticks, (us, seq)) - level) * CASE WHEN level >= spot THEN 1 ELSE -1 END AS move FROM ob JOIN tape t ON t.instrument = ob.instrument AND us > hit_us AND us <= hit_us + {FOLLOW} WHERE hit_us IS NOT NULL GROUP BY event_id, block, level, spot),
"""
    + boot("m", "bs", "move", "1", 200, 5)
    + " SELECT bs.*, touches, median, continued FROM bs, (SELECT count(*) AS touches, quantile_cont(move, 0.5) AS median, avg(CASE WHEN move > 0 THEN 1 ELSE 0 END) AS continued FROM m)",
    "size_effect": with_(TAPE, EVENTS)
    + """, q AS (SELECT quantile_cont(notional, 0.0) AS c0, quantile_cont(notional, 1 / 3) AS c1, quantile_cont(notional, 2 / 3) AS c2 FROM ob),
g0 AS (SELECT ob.*, c0 AS cut FROM ob, q WHERE notional >= c0 AND notional < c1), g1 AS (SELECT ob.*, c1 AS cut FROM ob, q WHERE notional >= c1 AND notional < c2), g2 AS (SELECT ob.*, c2 AS cut FROM ob, q WHERE notional >= c2),
"""
    + ",\n".join(boot(f"g{i}", f"b{i}", "touched", "expected", 100, 7 + i) for i in range(3))
    + " UNION ALL ".join(f" SELECT any_value(cut)::DOUBLE AS cut, count(*) AS n, avg(touched) AS observed, avg(expected) AS expected, any_value(b{i}.ratio) AS lift, CASE WHEN count(DISTINCT block) >= 8 THEN any_value(b{i}.lo) END AS lo, CASE WHEN count(DISTINCT block) >= 8 THEN any_value(b{i}.hi) END AS hi FROM g{i}, b{i} HAVING count(*) >= 10" for i in range(3)),
}
