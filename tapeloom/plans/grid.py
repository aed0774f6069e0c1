"""Queries on what follows queue events, against a grid of samples."""

from pyspark.sql import functions as F

from ..operators import grid as O
from ..operators import machines as M
from ..sources.fixtures import TAPE, TOUCH, tape, touch
from .machines import INSIDE
from .sequential import ordered, recursive

GRID, HORIZONS, BLOCK, LEAST = 900_000_000, (1800.0, 7200.0, 28800.0), 86_400_000_000, 30


def sided(s, sf):
    """Events at the best bid and, mirrored, the best ask, with the time that their result is known."""
    e = M.inside_events(O.both_sides(touch(tape(s, sf))), 3600.0, 0.34, ("instrument", "side"))
    return e.withColumn("level", F.abs("level"))


def study(s, sf):
    e = sided(s, sf).where("at_us is not null").select("instrument", F.col("at_us").alias("us"), F.concat_ws("_", F.lower("result"), "side").alias("state"))
    return O.against_grid(e, O.samples(touch(tape(s, sf)), GRID), list(HORIZONS), BLOCK, LEAST)


QUERIES = {
    "l1_events_both_sides": sided,
    "grid_samples": lambda s, sf: O.samples(touch(tape(s, sf)), GRID),
    "grid_forward": lambda s, sf: O.forward(O.samples(touch(tape(s, sf)), GRID), list(HORIZONS), BLOCK),
    "l1_study": study,
}

BOTH = "pair AS (SELECT instrument || '|bid' AS instrument, us, seq, bid_px, bid_sz FROM touch UNION ALL SELECT instrument || '|ask', us, seq, -ask_px, ask_sz FROM touch)"
EVENTS = (
    recursive(TAPE, TOUCH, BOTH, ordered("pair"))
    + INSIDE
    + """, ev AS (SELECT split_part(f.instrument, '|', 1) AS instrument, split_part(f.instrument, '|', 2) AS side, f.seq, kind, abs(level) AS level, CASE WHEN late IS NULL AND back IS NULL THEN 'PENDING' WHEN back IS NULL OR late <= back THEN 'PERMANENT' ELSE 'FAILED' END AS result, o.us AS at_us
  FROM f LEFT JOIN o ON o.instrument = f.instrument AND o.i = least(coalesce(late, back), coalesce(back, late)))"""
)
SAMPLES = f""", sp AS (SELECT instrument, min(us) AS us, arg_min(bid_px + ask_px, seq) AS mid2 FROM (SELECT *, (us - min(us) OVER (PARTITION BY instrument)) // {GRID} AS cell FROM touch) GROUP BY instrument, cell),
hz AS (SELECT sp.*, h AS horizon_s, us + CAST(h * 1000000 AS BIGINT) AS until FROM sp, (VALUES {", ".join(f"({h}::DOUBLE)" for h in HORIZONS)}) v(h)),
mv AS (SELECT hz.instrument, hz.us, horizon_s, (n.mid2 - hz.mid2) / 2 AS move FROM hz ASOF JOIN sp n ON n.instrument = hz.instrument AND n.us >= hz.until)"""

ORACLE = {
    "l1_events_both_sides": EVENTS + "SELECT * FROM ev",
    "grid_samples": recursive(TAPE, TOUCH) + SAMPLES + "SELECT * FROM sp",
    "grid_forward": recursive(TAPE, TOUCH) + SAMPLES + "SELECT * FROM mv",
    "l1_study": EVENTS
    + SAMPLES
    + f""", att AS (SELECT e.instrument, lower(result) || '_' || side AS state, n.us FROM ev e ASOF JOIN sp n ON n.instrument = e.instrument AND n.us >= e.at_us),
ct AS (SELECT instrument, horizon_s, count(*) AS n_grid, avg(CAST(move > 0 AS INTEGER)) AS up_grid, avg(move) AS mean_grid FROM mv GROUP BY ALL),
st2 AS (SELECT instrument, horizon_s, state, count(*) AS n, avg(CAST(move > 0 AS INTEGER)) AS up, avg(move) AS mean FROM att JOIN mv USING (instrument, us) GROUP BY ALL),
zz AS (SELECT *, CASE WHEN n >= {LEAST} THEN (up - up_grid) / sqrt(greatest(1e-12, up * (1 - up) / n)) END AS z FROM st2 JOIN ct USING (instrument, horizon_s))
SELECT *, CASE WHEN z IS NULL THEN 'too few' WHEN abs(z) >= 3 THEN 'real' WHEN abs(z) >= 2 THEN 'marginal' ELSE 'nothing' END AS verdict FROM zz""",
}
