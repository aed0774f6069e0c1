"""Queries on exchange sessions."""

from datetime import date

from pyspark.sql import functions as F

from ..operators import sessions as O
from ..operators.sessions import on_levels, session_levels  # noqa: F401
from .bars import BARS, hours

ROLLS = [date(y, m, d) for y, m, d in ((2023, 12, 15), (2024, 3, 15), (2024, 6, 21), (2024, 9, 20))]

#: Bars with session_us and phase, and minutes of the exchange's day.
SESSION_BARS = """lm AS (SELECT *, (make_timestamp(bar_us) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS local FROM bars),
lb AS (SELECT *, datediff('day', DATE '1970-01-01', CAST(local + INTERVAL 6 HOUR AS DATE)) * 86400000000 AS session_us, hour(local) * 60 + minute(local) AS minute,
  CASE WHEN dayofweek(local) = 6 OR dayofweek(local) = 5 AND hour(local) >= 17 OR dayofweek(local) = 0 AND hour(local) < 18 OR hour(local) = 17 THEN 'CLOSED'
       WHEN hour(local) * 60 + minute(local) BETWEEN 570 AND 959 THEN 'RTH' WHEN hour(local) = 16 THEN 'POST' ELSE 'OVERNIGHT' END AS phase FROM lm)"""
LEVELS = (
    SESSION_BARS
    + """,
sd AS (SELECT instrument, session_us, min(bar_us) AS begin_us, min(bar_us) FILTER (phase = 'RTH') AS rth_us, min(bar_us) FILTER (phase = 'RTH' AND minute >= 630) AS ib_us,
  max(high) FILTER (phase = 'RTH') AS rh, min(low) FILTER (phase = 'RTH') AS rl, arg_max(close, bar_us) FILTER (phase = 'RTH') AS rc, max(high) FILTER (phase = 'OVERNIGHT') AS onh, min(low) FILTER (phase = 'OVERNIGHT') AS onl,
  max(high) FILTER (phase = 'RTH' AND minute < 630) AS ibh, min(low) FILTER (phase = 'RTH' AND minute < 630) AS ibl FROM lb GROUP BY ALL),
sp AS (SELECT *, last_value(rh IGNORE NULLS) OVER w AS pdh, last_value(rl IGNORE NULLS) OVER w AS pdl, last_value(rc IGNORE NULLS) OVER w AS pdc FROM sd WINDOW w AS (PARTITION BY instrument ORDER BY session_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT * FROM (SELECT instrument, session_us, 'PDH' AS kind, pdh AS px, begin_us AS set_us FROM sp UNION ALL SELECT instrument, session_us, 'PDL', pdl, begin_us FROM sp UNION ALL SELECT instrument, session_us, 'PDC', pdc, begin_us FROM sp
  UNION ALL SELECT instrument, session_us, 'ONH', onh, rth_us FROM sp UNION ALL SELECT instrument, session_us, 'ONL', onl, rth_us FROM sp UNION ALL SELECT instrument, session_us, 'IBH', ibh, ib_us FROM sp UNION ALL SELECT instrument, session_us, 'IBL', ibl, ib_us FROM sp)
  WHERE px IS NOT NULL AND set_us IS NOT NULL)"""
)

QUERIES = {
    "session_phases": lambda s, sf: O.with_session(hours(s, sf)).groupBy("instrument", "session_us", "phase").agg(F.count("*").alias("bars"), F.sum("volume").alias("volume")),
    "rth_sessions": lambda s, sf: O.sessions(hours(s, sf), 6, ROLLS),
    "key_levels": lambda s, sf: O.session_levels(hours(s, sf)),
}

ORACLE = {
    "session_phases": BARS + "," + SESSION_BARS + " SELECT instrument, session_us, phase, count(*) AS bars, CAST(sum(volume) AS BIGINT) AS volume FROM lb GROUP BY ALL",
    "rth_sessions": BARS
    + ","
    + SESSION_BARS
    + """, d AS (SELECT instrument, session_us, arg_min(open, bar_us) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_us) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS bars FROM lb WHERE phase = 'RTH' GROUP BY ALL),
g AS (SELECT *, open - lag(close) OVER (PARTITION BY instrument ORDER BY session_us) AS gap, CAST(make_timestamp(session_us) AS DATE) AS day FROM d),
r AS (SELECT *, CASE WHEN """
    + " OR ".join(f"abs(datediff('day', DATE '{d}', day)) <= 4" for d in ROLLS)
    + """ THEN 'roll' WHEN abs(gap) > 6 THEN 'gap' END AS reason FROM g)
SELECT instrument, session_us, open, high, low, close, volume, bars, gap, reason IS NOT NULL AS suspect, reason FROM r""",
    "key_levels": BARS + "," + LEVELS + " SELECT * FROM lv",
}
