"""Queries on who wins each time frame, and the frames against each other."""

from ..operators import contest as O
from ..sources.fixtures import TAPE, tape, with_
from .bars import HOUR, OHLC, bars_sql, hours

FRAMES = [HOUR, 4 * HOUR, 12 * HOUR, 24 * HOUR]


def frames(s, sf):
    return O.judged(O.measured(tape(s, sf), FRAMES, HOUR))


QUERIES = {
    "pressure_measured": frames,
    "pressure_inferred": lambda s, sf: O.judged(O.inferred(hours(s, sf), HOUR)),
    "confrontation": lambda s, sf: O.confronted(frames(s, sf), FRAMES),
}

USUAL = """CASE WHEN count(*) OVER {w} >= 4 THEN median(abs(close - open) / open * 10000.0) OVER {w} END AS typical_bps, CASE WHEN count(*) OVER {w} >= 4 THEN median(volume * close) OVER {w} END AS typical_notional"""

MEASURED = (
    with_(TAPE)
    + f""", st AS (SELECT instrument, us // 3600000000 * 3600000000 AS at_us, {OHLC}, sum(sz) AS v, sum(CASE WHEN side = 'B' THEN px_ticks * sz ELSE 0 END) AS b, sum(CASE WHEN side = 'A' THEN px_ticks * sz ELSE 0 END) AS a, count(*) AS n FROM tape GROUP BY 1, 2),
sf AS (SELECT *, at_us // (seconds * 1000000) * seconds * 1000000 AS bar_us FROM st, (VALUES {", ".join(f"({f}::BIGINT)" for f in FRAMES)}) f(seconds)),
br AS (SELECT instrument, seconds, bar_us, arg_min(open, at_us) AS open, arg_max(close, at_us) AS close, sum(v) AS volume FROM sf GROUP BY 1, 2, 3),
ty AS (SELECT instrument, seconds, bar_us, lag(bar_us) OVER (PARTITION BY instrument, seconds ORDER BY bar_us) IS NOT NULL AS seeded, {USUAL.format(w="w")} FROM br WINDOW w AS (PARTITION BY instrument, seconds ORDER BY bar_us ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
rd AS (SELECT instrument, seconds, at_us, first(open) OVER w AS open, max(high) OVER w AS high, min(low) OVER w AS low, close AS last, sum(b) OVER w AS buy, sum(a) OVER w AS sell, sum(n) OVER w AS trades, true AS measured, 1 AS span, (at_us + 3600000000 - bar_us) / 1000000 AS elapsed_s, typical_bps, typical_notional, seeded
  FROM sf JOIN ty USING (instrument, seconds, bar_us) WINDOW w AS (PARTITION BY instrument, seconds, bar_us ORDER BY at_us))"""
)

INFERRED = (
    with_(TAPE, bars_sql(HOUR))
    + f""", p AS (SELECT *, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS pos FROM bars),
rd AS (SELECT instrument, 3600 AS seconds, bar_us AS at_us, first(open) OVER w AS open, max(high) OVER w AS high, min(low) OVER w AS low, close AS last, sum(volume * close * pos) OVER w AS buy, sum(volume * close * (1 - pos)) OVER w AS sell, sum(prints) OVER w AS trades, false AS measured, count(*) OVER w AS span, 3600 AS elapsed_s, {USUAL.format(w="u")}, true AS seeded
  FROM p WINDOW w AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), u AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 22 PRECEDING AND 3 PRECEDING))"""
)

# bands first, then who presses, then who is paid
JUDGED = """, j1 AS (SELECT *, (last - open) / open * 10000.0 AS move_bps, (high - low) / open * 10000.0 AS range_bps, buy + sell AS total, coalesce(typical_bps > 0, false) AS learned, least(1.0, greatest(0.02, (span - 1 + least(1.0, elapsed_s / seconds)) / span)) AS share, measured AND trades < 3 AS few FROM rd),
j2 AS (SELECT *, CASE WHEN total > 0 THEN (buy - sell) / total ELSE 0.0 END AS lean, greatest(0.05, CASE WHEN learned THEN typical_bps * sqrt(span) ELSE 25.0 * sqrt(seconds * span / 14400) END * 0.35::DOUBLE * sqrt(share)) AS flat_bps, NOT few AND CASE WHEN typical_notional > 0 THEN total >= 0.4::DOUBLE * (typical_notional * span * share) ELSE total > 0 END AS pressing FROM j1),
j3 AS (SELECT *, CASE WHEN abs(lean) < 0.1 THEN 0 ELSE sign(lean) END AS agg, NOT seeded OR few OR range_bps < flat_bps AND NOT pressing AS forming FROM j2),
j4 AS (SELECT *, NOT forming AND agg <> 0 AND pressing AND agg * move_bps <= flat_bps AS absorbing, CASE WHEN forming THEN 0 WHEN agg = 0 THEN CASE WHEN abs(move_bps) < flat_bps THEN 0 ELSE sign(move_bps) END WHEN agg * move_bps > flat_bps THEN agg WHEN pressing THEN -agg ELSE 0 END AS way,
  least(abs(move_bps) / greatest(CASE WHEN learned THEN typical_bps * sqrt(span) * 2.0::DOUBLE ELSE 20.0 END, 0.05), 1.0) AS gone FROM j3),
j5 AS (SELECT *, CASE WHEN forming THEN 0.0 ELSE floor(least((least(abs(lean) / 0.6::DOUBLE, 1.0) * 0.5::DOUBLE + CASE WHEN absorbing THEN 1.0 - gone ELSE gone END * 0.5::DOUBLE) * CASE WHEN measured THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END, 1.0) * 10000 + 0.5) / 10000 END AS strength FROM j4),
jd AS (SELECT instrument, at_us, seconds, move_bps, lean, CASE agg WHEN 1 THEN 'buy' WHEN -1 THEN 'sell' ELSE 'balanced' END AS aggressor, flat_bps, learned, pressing, forming, absorbing, CASE way WHEN 1 THEN 'buyers' WHEN -1 THEN 'sellers' ELSE 'contested' END AS winner, strength, way * strength AS signed FROM j5)
"""

ORACLE = {
    "pressure_measured": MEASURED + JUDGED + "SELECT * FROM jd",
    "pressure_inferred": INFERRED + JUDGED + "SELECT * FROM jd",
    "confrontation": MEASURED
    + JUDGED
    + f""", g AS (SELECT instrument, at_us, count(*) AS readings, arg_max(winner, seconds) AS higher, arg_min(winner, seconds) AS lower, count(DISTINCT winner) FILTER (winner <> 'contested') AS sides, {" + ".join(f"max(CASE WHEN seconds = {f} THEN signed END) * sqrt({f})" for f in reversed(FRAMES))} AS score FROM jd GROUP BY 1, 2)
SELECT instrument, at_us, readings, higher, lower, sides = 1 AS aligned, sides = 2 AS conflicted, score, CASE WHEN abs(score) < 1e-9 THEN 'contested' WHEN score > 0 THEN 'buyers' ELSE 'sellers' END AS consensus,
  CASE WHEN sides = 1 THEN 'aligned' WHEN sides = 2 AND higher <> lower AND 'contested' NOT IN (higher, lower) THEN 'conflict' ELSE 'mixed' END AS shape FROM g""",
}
