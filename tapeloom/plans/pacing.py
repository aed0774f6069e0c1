"""Queries on volume pace, clock windows and the shapes of bars."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import pacing as O
from ..sources.fixtures import TAPE, TOUCH, tape, touch, with_
from .bars import HOUR, bars_sql, hours
from .flow import L1
from .profile import DAY_US, area, area_sql

BAR, STEP = 12 * HOUR, 2 * HOUR


def paced(s, sf, unit=None):
    t = tape(s, sf)
    return O.volume_pace(t, BAR, STEP, O.curves(t, BAR, 6, 10, 8, unit))


def learned(s, sf):
    c = O.curves(tape(s, sf), BAR, 6, 10, 8)
    return c.select("instrument", "day", "samples", "normal_volume", "normal_range", *(F.get("shares", F.lit(i)).alias(f"s{i}") for i in range(6)))


def layered(s, sf):
    """Hours with what shapes() reads: volume and move against the 20 hours before, and the value area of the day before as references."""
    before = W.partitionBy("instrument").orderBy("bar_us").rowsBetween(-20, -1)
    b = hours(s, sf).withColumns({"day_us": B.bucket("bar_us", 24 * HOUR), "move": F.col("close") - F.col("open"), "range": F.col("high") - F.col("low")})
    b = b.withColumns({"n": F.count("*").over(before), "v": F.sum("volume").over(before), "m": F.sum(F.abs("move")).over(before), "r": F.sum("range").over(before)})
    prior = area(s, sf).select("instrument", (F.col("bar_us") + F.lit(DAY_US)).alias("day_us"), "val", "vah")
    b = b.join(prior, ["instrument", "day_us"], "left")
    enough = F.col("n") >= 5
    through = F.when((F.col("high") > F.col("vah")) & (F.col("close") < F.col("vah")), "above").when((F.col("low") < F.col("val")) & (F.col("close") > F.col("val")), "below")
    reach = lambda c: (F.col("low") <= F.col(c)) & (F.col(c) <= F.col("high"))
    return b.select(
        "instrument", "bar_us", enough.alias("measured"), F.when(F.col("delta") > 0, "buyers").when(F.col("delta") < 0, "sellers").alias("who"), "move",
        (enough & (F.col("range") >= 0.8 * F.col("r") / F.col("n"))).alias("wide"), F.try_divide(F.col("close") - F.col("low"), "range").alias("position"), F.when(enough, F.col("volume") / (F.col("v") / F.col("n"))).alias("pace"),
        F.when(F.col("m") > 0, F.abs("move") / F.col("volume") / (F.col("m") / F.col("v"))).alias("impact"), through.alias("through"), F.when(reach("vah"), True).when(reach("val"), False).alias("at_above"),
    )


QUERIES = {
    "volume_curves": learned,
    "volume_pace": paced,
    "volume_pace_whole_bars": lambda s, sf: paced(s, sf, 4 * HOUR),
    "clock_windows": lambda s, sf: O.clock_windows(touch(tape(s, sf)), tape(s, sf), HOUR),
    "clock_window_summary": lambda s, sf: O.window_summary(O.clock_windows(touch(tape(s, sf)), tape(s, sf), HOUR)),
    "bar_shapes": lambda s, sf: O.shapes(layered(s, sf)).select("instrument", "bar_us", "shape", "lean", "provisional"),
}


def curve_sql(unit: int | None) -> str:
    u, w = BAR * B.SECOND, BAR * B.SECOND // 6
    keep = f"WHERE units >= {BAR // unit}" if unit else "QUALIFY bar_us > min(bar_us) OVER (PARTITION BY instrument)"
    done = ", ".join(f"sum(CASE WHEN (us - us // {u} * {u}) // {w} <= {i} THEN sz ELSE 0 END) / sum(sz) AS d{i}" for i in range(6))
    mids = ", ".join(f"CASE WHEN count(b.bar_us) >= 8 THEN median(d{i}) END AS s{i}" for i in range(6))
    return (
        with_(TAPE)
        + f""", b0 AS (SELECT instrument, us // {u} * {u} AS bar_us, sum(sz)::DOUBLE AS volume, (max(px_ticks) - min(px_ticks))::DOUBLE AS range, count(DISTINCT us // {(unit or BAR) * B.SECOND}) AS units, {done} FROM tape GROUP BY 1, 2),
b AS (SELECT * FROM b0 {keep}),
dy AS (SELECT DISTINCT instrument, us // {DAY_US} AS day FROM tape),
cv AS (SELECT dy.instrument, dy.day, count(b.bar_us) AS samples, median(volume) AS normal_volume, median(range) AS normal_range, {mids}
       FROM dy LEFT JOIN b ON b.instrument = dy.instrument AND b.bar_us // {DAY_US} BETWEEN dy.day - 10 AND dy.day - 1 GROUP BY 1, 2)"""
    )


def pace_sql(unit: int | None) -> str:
    u, st = BAR * B.SECOND, STEP * B.SECOND
    return (
        curve_sql(unit)
        + f""", p AS (SELECT instrument, us // {u} * {u} AS bar_us, us // {st} * {st} AS at_us, sum(sz) AS v, max(px_ticks) AS h, min(px_ticks) AS l FROM tape GROUP BY ALL),
q AS (SELECT instrument, bar_us, at_us, bar_us // {DAY_US} AS day, sum(v) OVER w AS done, max(h) OVER w - min(l) OVER w AS range, least((at_us + {st} - bar_us) / {u}, 1.0) AS frac FROM p WINDOW w AS (PARTITION BY instrument, bar_us ORDER BY at_us)),
x AS (SELECT *, s0 IS NOT NULL AS learned, greatest(1e-4, CASE WHEN s0 IS NULL THEN frac ELSE [s0, s1, s2, s3, s4, s5][(at_us + {st} - bar_us) // {st}] END) AS share FROM q JOIN cv USING (instrument, day)),
y AS (SELECT *, CASE WHEN normal_volume > 0 THEN done / (normal_volume * share) END AS pace, done / share AS projected, coalesce(normal_range > 0 AND range >= normal_range * sqrt(frac) * 0.8, false) AS wide FROM x)
SELECT instrument, bar_us, at_us, done, range, share, learned, samples, pace, projected, wide, range / pace AS efficiency,
  CASE WHEN pace IS NULL THEN 'unknown' WHEN pace >= 1.5 THEN CASE WHEN wide THEN 'paid_for' ELSE 'absorbed' END WHEN pace <= 0.6 THEN CASE WHEN wide THEN 'thin' ELSE 'no_fuel' END WHEN wide THEN 'paid_for' ELSE 'unknown' END AS state FROM y"""
    )


def way(d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN 'up' WHEN {d} < 0 THEN 'down' ELSE 'flat' END"


CLOCK = (
    with_(TAPE, TOUCH, L1)
    + f""", bk AS (SELECT t.instrument, us // 3600000000 * 3600000000 AS start_us, arg_min(bid_px + ask_px, t.seq) AS mid2_open, max(bid_px + ask_px) AS mid2_high, min(bid_px + ask_px) AS mid2_low, arg_max(bid_px + ask_px, t.seq) AS mid2_close, coalesce(sum(ofi), 0) AS ofi, count(*) AS books FROM touch t JOIN l1 USING (instrument, seq) GROUP BY 1, 2),
tr AS (SELECT instrument, us // 3600000000 * 3600000000 AS start_us, arg_min(px_ticks, seq) AS last_open, max(px_ticks) AS last_high, min(px_ticks) AS last_low, arg_max(px_ticks, seq) AS last_close, sum(CASE side WHEN 'B' THEN sz WHEN 'A' THEN -sz ELSE 0 END) AS cvd, count(*) AS trades, count_if(side = 'N') AS unknown, sum(CASE side WHEN 'N' THEN sz ELSE 0 END) AS unknown_sz FROM tape GROUP BY 1, 2),
j AS (SELECT *, {way('mid2_close - mid2_open')} AS mid_dir, {way('last_close - last_open')} AS last_dir, {way('ofi')} AS ofi_dir, {way('cvd')} AS cvd_dir FROM bk FULL JOIN tr USING (instrument, start_us)),
ag AS (SELECT *, mid_dir <> 'flat' AND mid_dir = ofi_dir AND mid_dir = cvd_dir AS agree, coalesce(ofi_dir <> 'flat' AND ofi_dir <> last_value(nullif(ofi_dir, 'flat') IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY start_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS flip FROM j),
cw AS (SELECT *, flip AND cvd_dir = ofi_dir AS confirmed FROM ag)
"""
)

SHAPES = (
    with_(TAPE, bars_sql(HOUR), area_sql("va", 1)).replace("WITH", "WITH RECURSIVE", 1)
    + f""", h AS (SELECT *, close - open AS move, high - low AS range, count(*) OVER w AS n, sum(volume) OVER w AS v, sum(abs(close - open)) OVER w AS m, sum(high - low) OVER w AS r, row_number() OVER (PARTITION BY instrument ORDER BY bar_us) AS i FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY bar_us ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
l AS (SELECT h.*, val, vah, sign(move) AS now, n >= 5 AND range >= 0.8 * r / n AS wide, (close - low) / nullif(range, 0) AS position, CASE WHEN n >= 5 THEN volume / (v / n) END AS pace, CASE WHEN m > 0 THEN abs(move) / volume / (m / v) END AS impact FROM h LEFT JOIN va ON va.instrument = h.instrument AND va.bar_us = h.bar_us // {DAY_US} * {DAY_US} - {DAY_US}),
f AS (SELECT *, CASE WHEN n < 5 THEN 'unknown' WHEN high > vah AND close < vah THEN 'failed_breakout' WHEN low < val AND close > val THEN 'failed_breakdown' WHEN wide AND low <= vah AND vah <= high AND position <= 0.35 THEN 'rejection down'
  WHEN wide AND low <= val AND val <= high AND NOT coalesce(low <= vah AND vah <= high, false) AND position >= 0.65 THEN 'rejection up' WHEN pace >= 1.5 AND impact < 0.5 THEN CASE WHEN wide THEN 'exhaustion' ELSE 'absorption' END END AS fixed,
  CASE WHEN impact > 2 AND wide THEN 'expansion' WHEN wide AND delta * move > 0 THEN 'continuation' WHEN pace <= 0.6 OR NOT wide THEN 'consolidation' ELSE 'unknown' END AS plain FROM l),
o AS (SELECT *, CASE WHEN fixed IN ('failed_breakout', 'rejection down') THEN -1 WHEN fixed IN ('failed_breakdown', 'rejection up') THEN 1 WHEN fixed IN ('exhaustion', 'absorption') THEN -sign(delta) END AS own FROM f),
st AS (SELECT instrument, i, bar_us, CAST(nullif(CASE WHEN fixed IS NOT NULL THEN own WHEN plain IN ('expansion', 'continuation') THEN now END, 0) AS INTEGER) AS side, coalesce(fixed, plain) AS shape FROM o WHERE i = 1
  UNION ALL SELECT o.instrument, o.i, o.bar_us, CAST(nullif(CASE WHEN fixed IS NOT NULL THEN own WHEN side = -now THEN now WHEN plain IN ('expansion', 'continuation') THEN now END, 0) AS INTEGER), CASE WHEN fixed IS NOT NULL THEN fixed WHEN side = -now THEN 'reversal' ELSE plain END FROM st JOIN o ON o.instrument = st.instrument AND o.i = st.i + 1)
SELECT instrument, bar_us, split_part(shape, ' ', 1) AS shape, CASE side WHEN 1 THEN 'buy' WHEN -1 THEN 'sell' END AS lean, CAST(shape IN ('failed_breakout', 'failed_breakdown', 'exhaustion', 'reversal') AS INTEGER) AS provisional FROM st"""
)

ORACLE = {
    "bar_shapes": SHAPES,
    "volume_curves": curve_sql(None) + "SELECT * FROM cv",
    "volume_pace": pace_sql(None),
    "volume_pace_whole_bars": pace_sql(4 * HOUR),
    "clock_windows": CLOCK + "SELECT * FROM cw",
    "clock_window_summary": CLOCK
    + "SELECT instrument, count(*) AS windows, count_if(mid_dir <> 'flat') AS decided, count_if(agree) AS agreed, count_if(flip) AS flips, count_if(confirmed) AS confirmed, sum(unknown) AS unknown, sum(trades) AS trades, coalesce(count_if(agree) / nullif(count_if(mid_dir <> 'flat'), 0), 0) AS agree_share, count_if(flip) / count(*) AS flips_per_window FROM cw GROUP BY 1",
}
