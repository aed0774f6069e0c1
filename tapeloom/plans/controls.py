"""Queries on findings beside their controls."""

from pyspark.sql import functions as F

from ..operators import controls as O
from ..operators import entries as E
from ..operators import zones as Z
from ..sources.fixtures import TAPE, tape, touch, with_
from . import levels as L
from . import studies as T
from .bars import HOUR, hours
from .entries import SLICES
from .outcomes import LCG2
from .structure import BARS4, SWINGS

BAR, MARKS, SEED = 12 * HOUR, [0.25, 0.5, 0.75], 11


def drawn(s, sf):
    span = tape(s, sf).groupBy("instrument").agg(F.min("px_ticks").alias("lo"), F.max("px_ticks").alias("hi"))
    return O.drawn_levels(T.levels(s, sf), span, ["instrument"], SEED)


def controlled(s, sf):
    """What becomes of touches of swing levels against touches of as many drawn ones."""
    t = T.O.rearmed_touches(tape(s, sf), drawn(s, sf), 1, 5)
    t = t.select((F.col("seq") * 100_000 + F.col("level")).alias("event_id"), "instrument", F.col("us").alias("at_us"), "level", (F.col("side") == "below").alias("up"))
    control = Z.touch_outcomes(t, hours(s, sf), 48 * 3600 * 1_000_000, 1, 3, 1, 3, 4)
    return O.against_control(L.node_touches(s, sf), control, "label")


def marks(s, sf):
    return O.checkpoints(tape(s, sf), BAR, MARKS)


def travelled(s, sf):
    t = tape(s, sf)
    state = O.two_line_state(F.col("ofi") / 60.0, F.col("delta") / 6.0, 0.25)
    return O.travel_by_state(E.slices(t, touch(t), HOUR).select("instrument", "at_us", F.col("close").alias("px"), state.alias("state")), HOUR, [1, 2, 4])


QUERIES = {
    "levels_drawn": drawn,
    "node_control": controlled,
    "bar_checkpoints": marks,
    "remaining_calls": lambda s, sf: O.remaining_calls(marks(s, sf), {"momentum": F.col("realised"), "delta": F.col("delta"), "against": -F.col("delta")}, 100),
    "travel_by_state": travelled,
}

LR = T.LV.replace("lv AS", "lr AS")
DRAWN = (
    LR
    + f""", dn AS (SELECT instrument, lo, hi, unnest(range(n)) AS i FROM (SELECT instrument, count(*) AS n FROM lr GROUP BY 1) JOIN (SELECT instrument, min(px_ticks) AS lo, max(px_ticks) AS hi FROM tape GROUP BY 1) USING (instrument) WHERE hi > lo),
dl AS (SELECT instrument, i, lo + CAST(floor((1103515245 * {LCG2.format(x=f"lo * 7919 + hi * 104729 + i * 1299709 + {SEED}")} + 12345) % 2147483648 / 2147483648 * (hi - lo + 1)) AS BIGINT) AS level FROM dn)"""
)
FOUND = BARS4 + "," + SWINGS
_U = BAR * 1_000_000
POINTS = (
    with_(TAPE)
    + f""", br AS (SELECT instrument, us // {_U} * {_U} AS bar_us, arg_min(px_ticks, seq) AS open, arg_max(px_ticks, seq) AS close FROM tape GROUP BY 1, 2),
mk AS (SELECT instrument, us // {_U} * {_U} AS bar_us, mark, arg_max(px_ticks, seq) AS px, sum(CASE side WHEN 'B' THEN sz WHEN 'A' THEN -sz ELSE 0 END)::BIGINT AS delta, sum(sz)::BIGINT AS volume FROM tape, (VALUES {", ".join(f"({m}::DOUBLE)" for m in MARKS)}) v(mark) WHERE us % {_U} < mark * {_U} GROUP BY 1, 2, 3),
cp AS (SELECT instrument, bar_us, mark, px - open AS realised, close - px AS remaining, delta, volume FROM mk JOIN br USING (instrument, bar_us))"""
)
GRADE = "CASE WHEN {z} >= 3 THEN 'real' WHEN {z} >= 2 THEN 'marginal' WHEN {z} IS NOT NULL THEN 'nothing' END AS verdict"
ORACLE = {
    "levels_drawn": FOUND + DRAWN + " SELECT * FROM dl",
    # both sides walk their own recursion
    "node_control": f"""WITH c AS (SELECT label, count_if(own) AS n, count_if(NOT own) AS control_n FROM (
  SELECT label, true AS own FROM ({(FOUND + T.LV + L.TOUCHED).replace("WITH ", "WITH RECURSIVE ", 1)} SELECT label FROM tl)
  UNION ALL SELECT label, false FROM ({(FOUND + DRAWN + ", lv AS (SELECT DISTINCT instrument, level FROM dl)" + L.TOUCHED).replace("WITH ", "WITH RECURSIVE ", 1)} SELECT label FROM tl)) GROUP BY label),
p AS (SELECT *, n / sum(n) OVER () AS share, control_n / sum(control_n) OVER () AS control_share, (n + control_n) / sum(n + control_n) OVER () AS p, 1 / sum(n) OVER () + 1 / sum(control_n) OVER () AS e FROM c)
SELECT label, n, share, control_n, control_share, (share - control_share) / sqrt(p * (1 - p) * e) AS z FROM p""",
    "bar_checkpoints": POINTS + "SELECT * FROM cp",
    "remaining_calls": POINTS
    + f""", r AS (SELECT mark, reading, remaining AS y, CASE reading WHEN 'momentum' THEN realised WHEN 'delta' THEN delta ELSE -delta END AS x FROM cp, (VALUES ('momentum'), ('delta'), ('against')) v(reading) WHERE remaining <> 0),
g AS (SELECT mark, reading, count(*) AS n, count_if(x <> 0) AS used, count_if(x * y > 0) / count_if(x <> 0) AS rate, greatest(count_if(y > 0), count_if(y < 0)) / count(*) AS base, corr(x, y) AS corr FROM r GROUP BY 1, 2 HAVING count_if(x <> 0) >= 100),
h AS (SELECT *, rate - base AS edge, (rate - base) / sqrt(0.25 / used) AS z FROM g) SELECT *, {GRADE.format(z="z")} FROM h""",
    "travel_by_state": SLICES
    + f""", x AS (SELECT *, ofi / 60 AS b, delta / 6 AS t FROM sl),
s AS (SELECT instrument, at_us, close AS px, CASE WHEN b > 0.25 AND t > 0.25 THEN 'both_up' WHEN b < -0.25 AND t < -0.25 THEN 'both_down' WHEN b > 0.25 AND t < -0.25 OR b < -0.25 AND t > 0.25 THEN CASE WHEN abs(b) > abs(t) THEN 'book_leads' ELSE 'tape_leads' END ELSE 'flat' END AS state FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY at_us) AS nth FROM s),
m AS (SELECT k.state AS own, horizon, l.px - k.px AS move FROM k, (VALUES (1::BIGINT), (2), (4)) h(horizon), k l WHERE l.instrument = k.instrument AND l.nth = k.nth + horizon AND l.at_us = k.at_us + horizon * 3600000000),
g AS (SELECT horizon, state, count(*) AS n, count(*) / horizon AS indep, median(move) AS md, avg(move) AS mn, median(abs(move)) AS tr, count_if(move > 0) / count(*) AS u FROM (SELECT horizon, own AS state, move FROM m UNION ALL SELECT horizon, 'all', move FROM m) GROUP BY 1, 2),
j AS (SELECT g.*, CASE WHEN g.state <> 'all' AND g.indep >= 50 THEN (g.u - a.u) / sqrt(greatest(1e-9, a.u * (1 - a.u) / g.indep)) END AS z, g.state = 'all' OR g.indep >= 50 AS enough FROM g JOIN g a ON a.horizon = g.horizon AND a.state = 'all')
SELECT horizon, state, n, indep, CASE WHEN enough THEN md END AS median, CASE WHEN enough THEN mn END AS mean, CASE WHEN enough THEN tr END AS travel, CASE WHEN enough THEN u END AS up, z, {GRADE.format(z="abs(z)")} FROM j""",
}
