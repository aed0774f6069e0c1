"""Queries on live footprints: lives of flags, what a bar shows after each print, signals, and the same as a stream."""

from pyspark.sql import functions as F

from ..operators import live as O
from ..sources.fixtures import TAPE, tape, with_
from ..sources.scratch import place
from ..streaming import bars as S
from ..streaming import live as L

DAYS = 2
WIDTH = DAYS * 86_400
RULE, GATES = O.Rule(2.0, 1), O.Gates(2, 2, 3600 * 1_000_000)


def near(events):
    """Trades whose price is read off each event alone, so that a stream has them too."""
    k, ts = F.get_json_object("props", "$.k").cast("long"), F.col("ts").cast("timestamp")
    side = F.when(F.col("event_type").isin("purchase", "signup"), "B").when(F.col("event_type").isin("click", "error"), "A").otherwise("N")
    return events.select(F.col("event_id").alias("seq"), ts.alias("ts"), F.unix_micros(ts).alias("us"), F.concat(F.lit("M"), (F.col("user_id") % 8).cast("string")).alias("instrument"), (20000 + k % 7).alias("px_ticks"), (1 + F.floor(F.col("value") / 10)).cast("long").alias("sz"), side.alias("side"))


def lives(s, sf):
    return O.flags(O.compared(tape(s, sf), WIDTH, RULE), WIDTH)


def pulses(s, sf):
    p = tape(s, sf)
    return O.pulse(p, O.compared(p, WIDTH, RULE), WIDTH, 3600).withColumns({"pressure": O.pressure(F.col("delta"), F.col("bought") + F.col("sold")), "window_pressure": O.pressure(F.col("window_delta"), F.col("window_volume"))})


def log(s, sf):
    return S.drain(L.footprints(near(S.prints_stream(s, sf, "events.parquet")), WIDTH, "1 hour", RULE, GATES), place(s, "stream"))


QUERIES = {
    "live_flags": lives,
    "live_flag_states": lambda s, sf: lives(s, sf).groupBy("side", "state").agg(F.count("*").alias("n"), F.avg((F.col("ended_us") - F.col("first_us")) / 1e6).alias("held_s"), F.avg("updates").alias("updates"), F.max("peak").alias("peak")),
    "live_pulse": pulses,
    "diagonal_delta": lambda s, sf: pulses(s, sf).groupBy("instrument", "bar_us").agg(F.max_by("delta", "seq").alias("delta"), F.max_by("diagonal", "seq").alias("diagonal"), F.max("buy_flags").alias("most_buy_flags"), F.max("sell_flags").alias("most_sell_flags")),
    "execution_signals": lambda s, sf: O.signals(tape(s, sf), WIDTH, RULE, GATES),
    "stream_flags": lambda s, sf: L.settled(log(s, sf)).where("state <> 'unconfirmed'"),
    "stream_signals": lambda s, sf: log(s, sf).where("kind = 'signal'").select("instrument", "seq", F.col("at_us").alias("us"), "side", "from_px", "to_px", "raw", "diagonal"),
}

NEAR = "near AS (SELECT seq, us, instrument, sz, side, 20000 + k % 7 AS px_ticks FROM tape)"


def flags_sql(src: str) -> str:
    """compared() and flags() on a table of prints, as CTEs that end in fl."""
    unit = WIDTH * 1_000_000
    pair = "PARTITION BY instrument, bar_us, side, px ORDER BY seq, n"
    return f"""p AS (SELECT instrument, us // {unit} * {unit} AS bar_us, us, seq, px_ticks AS ap, sz, side = 'B' AS buys, min(px_ticks) OVER u AS low, max(px_ticks) OVER u AS high, min(px_ticks) OVER b AS low0, max(px_ticks) OVER b AS high0 FROM {src} WHERE side <> 'N'
  WINDOW u AS (PARTITION BY instrument, us // {unit} ORDER BY seq), b AS (PARTITION BY instrument, us // {unit} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, 0 AS n, 'buy' AS side, ap AS px, CASE WHEN buys THEN sz ELSE 0 END AS dv, 0 AS da, true AS own FROM p
  UNION ALL SELECT *, 1, 'sell', ap, CASE WHEN buys THEN 0 ELSE sz END, 0, true FROM p
  UNION ALL SELECT *, 2, 'buy', ap + 1, 0, CASE WHEN buys THEN 0 ELSE sz END, false FROM p
  UNION ALL SELECT *, 3, 'sell', ap - 1, 0, CASE WHEN buys THEN sz ELSE 0 END, false FROM p
  UNION ALL SELECT *, 4, 'buy', low0, 0, 0, false FROM p WHERE low < low0
  UNION ALL SELECT *, 5, 'sell', high0, 0, 0, false FROM p WHERE high > high0),
y AS (SELECT *, CAST(sum(dv) OVER w AS BIGINT) AS volume, CAST(sum(da) OVER w AS BIGINT) AS against, bool_or(own) OVER w AS traded FROM x WINDOW w AS ({pair})),
t AS (SELECT *, traded AND px <> CASE side WHEN 'buy' THEN low ELSE high END AND volume >= 1 AND (against = 0 OR volume >= 2 * against) AS holds FROM y),
l AS (SELECT *, sum(CASE WHEN holds THEN 0 ELSE 1 END) OVER ({pair}) AS life FROM t),
g AS (SELECT instrument, bar_us, side, px, life, min(us) AS first_us, count(*) AS updates, arg_max(volume, (seq, n)) AS volume, arg_max(against, (seq, n)) AS against, CASE WHEN min(against) > 0 THEN max(volume / against) END AS peak FROM l WHERE holds GROUP BY ALL),
f AS (SELECT instrument, bar_us, side, px, life - 1 AS life, us AS faded_us FROM l WHERE NOT holds),
e AS (SELECT instrument, max(bar_us) AS last_us FROM t GROUP BY instrument),
fl AS (SELECT instrument, bar_us, side, px, first_us, coalesce(faded_us, CASE WHEN bar_us < last_us THEN bar_us + {unit} END) AS ended_us, updates, volume, against, volume / nullif(against, 0) AS ratio, peak, CASE WHEN faded_us IS NOT NULL THEN 'faded' WHEN bar_us < last_us THEN 'confirmed' ELSE 'unconfirmed' END AS state
  FROM g LEFT JOIN f USING (instrument, bar_us, side, px, life) JOIN e USING (instrument))"""


PULSE = f"""s AS (SELECT instrument, bar_us, seq, side, own AND holds AS lit, CASE WHEN holds THEN 1 ELSE 0 END - coalesce(lag(CASE WHEN holds THEN 1 ELSE 0 END) OVER (PARTITION BY instrument, bar_us, side, px ORDER BY seq, n), 0) AS step FROM t),
q AS (SELECT instrument, bar_us, seq, sum(CASE side WHEN 'buy' THEN step ELSE 0 END) AS b, sum(CASE side WHEN 'sell' THEN step ELSE 0 END) AS a, bool_or(lit) AS lit FROM s GROUP BY ALL),
r AS (SELECT p.*, b, a, lit, CASE WHEN buys THEN sz ELSE -sz END AS sg FROM p JOIN q USING (instrument, bar_us, seq)),
pu AS (SELECT instrument, bar_us, seq, us, first_value(ap) OVER w AS open, high, low, ap AS last, CAST(sum(CASE WHEN buys THEN sz ELSE 0 END) OVER w AS BIGINT) AS bought, CAST(sum(CASE WHEN buys THEN 0 ELSE sz END) OVER w AS BIGINT) AS sold, CAST(sum(sg) OVER w AS BIGINT) AS delta,
  CAST(sum(sg) OVER v AS BIGINT) AS window_delta, CAST(sum(sz) OVER v AS BIGINT) AS window_volume, count(*) OVER w AS prints, CAST(sum(b) OVER w AS BIGINT) AS buy_flags, CAST(sum(a) OVER w AS BIGINT) AS sell_flags, CAST(sum(CASE WHEN lit THEN sg ELSE 0 END) OVER w AS BIGINT) AS diagonal, us - first_value(us) OVER w AS age_us
  FROM r WINDOW w AS (PARTITION BY instrument, bar_us ORDER BY seq), v AS (PARTITION BY instrument, bar_us ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW))"""

ORACLE = {
    "live_flags": with_(TAPE, flags_sql("tape")) + "SELECT * FROM fl",
    "live_flag_states": with_(TAPE, flags_sql("tape")) + "SELECT side, state, count(*) AS n, avg((ended_us - first_us) / 1e6) AS held_s, avg(updates) AS updates, max(peak) AS peak FROM fl GROUP BY ALL",
    "live_pulse": with_(TAPE, flags_sql("tape"), PULSE) + "SELECT *, delta / (bought + sold) AS pressure, window_delta / window_volume AS window_pressure FROM pu",
    "diagonal_delta": with_(TAPE, flags_sql("tape"), PULSE) + "SELECT instrument, bar_us, arg_max(delta, seq) AS delta, arg_max(diagonal, seq) AS diagonal, max(buy_flags) AS most_buy_flags, max(sell_flags) AS most_sell_flags FROM pu GROUP BY ALL",
    "stream_flags": with_(TAPE, NEAR, flags_sql("near"))
    + f"""SELECT instrument, bar_us, side, px, first_us, ended_us AS at_us, state, updates, volume, against, peak FROM (SELECT * REPLACE (coalesce(ended_us, bar_us + {WIDTH * 1_000_000}) AS ended_us, CASE state WHEN 'unconfirmed' THEN 'confirmed' ELSE state END AS state), state AS was FROM fl)
WHERE was <> 'unconfirmed' OR ended_us <= (SELECT max(us) FROM near WHERE side <> 'N') // 1000 * 1000 - 3600000000""",
}
