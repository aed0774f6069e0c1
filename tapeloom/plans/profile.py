"""Queries on volume at price."""

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import profile as O
from ..operators import reads as R
from ..sources.fixtures import TAPE, tape, with_
from .bars import BARS, HOUR, OHLC, bars_sql, hours

DAY = 24 * HOUR
DAY_US = DAY * B.SECOND
FP = f"fp AS (SELECT instrument, us // {DAY_US} * {DAY_US} AS bar_us, px_ticks AS px, CAST(sum(CASE WHEN side = 'A' THEN sz ELSE 0 END) AS BIGINT) AS bid_vol, CAST(sum(CASE WHEN side = 'B' THEN sz ELSE 0 END) AS BIGINT) AS ask_vol, CAST(sum(sz) AS BIGINT) AS total FROM tape GROUP BY ALL)"
FLAGS = """fl AS (SELECT fp.*, px > min(px) OVER b AND ask_vol >= 5 AND ask_vol >= 3.0 * (CASE WHEN lag(px) OVER w = px - 1 THEN lag(bid_vol) OVER w ELSE 0 END) AS buy_flag,
  px < max(px) OVER b AND bid_vol >= 5 AND bid_vol >= 3.0 * (CASE WHEN lead(px) OVER w = px + 1 THEN lead(ask_vol) OVER w ELSE 0 END) AS sell_flag
  FROM fp WINDOW w AS (PARTITION BY instrument, bar_us ORDER BY px), b AS (PARTITION BY instrument, bar_us))"""


def fp(s, sf):
    return O.footprint(tape(s, sf), DAY)


def daily_profile(s, sf, days=1):
    return O.price_profile(tape(s, sf).withColumn("bar_us", B.bucket("us", days * DAY)), ["instrument", "bar_us"], 1)


def area(s, sf, days=1):
    return O.value_area(daily_profile(s, sf, days), ["instrument", "bar_us"], 0.7)


def nested(s, sf):
    inner = area(s, sf).withColumn("week_us", B.bucket("bar_us", 5 * DAY))
    return O.nested(inner, area(s, sf, 5).withColumnRenamed("bar_us", "week_us"), ["instrument", "week_us"], "bar_us", 2.0)


def rolled(profile):
    """The value areas of profiles by bar; volumes in whole thousandths, so that sums don't depend on their order."""
    return O.value_area(profile.withColumn("volume", F.round(F.col("volume") * 1000).cast("long")), ["instrument", "bar_us"], 0.7)


def market(s, sf):
    """Each hour against the profile of the day before."""
    days = daily_profile(s, sf)
    found = O.nodes(days, ["instrument", "bar_us"])
    of = lambda k: F.sort_array(F.collect_list(F.when(F.col("node") == k, F.col("row")))).alias(k)
    p = area(s, sf).join(found.groupBy("instrument", "bar_us").agg(of("hvn"), of("lvn")), ["instrument", "bar_us"], "left")
    none = F.array().cast("array<bigint>")
    p = p.select("instrument", (F.col("bar_us") + DAY_US).alias("day_us"), "poc", "val", "vah", F.coalesce("hvn", none).alias("hvn"), F.coalesce("lvn", none).alias("lvn"))
    return R.market_read(hours(s, sf).withColumn("day_us", B.bucket("bar_us", DAY)), p, "day_us")


QUERIES = {
    "market_state": market,
    "footprint_levels": fp,
    "footprint_imbalance": lambda s, sf: O.imbalances(fp(s, sf), 3.0, 5),
    "footprint_stacked": lambda s, sf: O.stacked(O.imbalances(fp(s, sf), 3.0, 5), 2),
    "footprint_poc": lambda s, sf: O.point_of_control(fp(s, sf), B.time_bars(tape(s, sf), DAY)),
    "profile_rows": lambda s, sf: O.bar_profile(hours(s, sf), ["instrument"], 4).withColumn("volume", F.round("volume", 4)),
    "profile_value_area": area,
    "profile_nodes": lambda s, sf: O.nodes(O.price_profile(tape(s, sf), ["instrument"], 1), ["instrument"]),
    "profile_area_up_first": lambda s, sf: O.value_area(daily_profile(s, sf), ["instrument", "bar_us"], 0.7, True),
    "profile_merge": lambda s, sf: O.merged(daily_profile(s, sf), ["instrument"]),
    "profile_rolling": lambda s, sf: rolled(O.rolling_profile(hours(s, sf), 2 * DAY, 2)),
    "profile_developing": lambda s, sf: rolled(O.developing_profile(hours(s, sf).withColumn("session_us", B.bucket("bar_us", DAY)), "session_us", 2, 3)),
    "nested_state": nested,
}


def area_sql(name: str, days: int) -> str:
    w = days * DAY_US
    return f"{name}_p AS (SELECT instrument, us // {w} * {w} AS bar_us, px_ticks AS row, CAST(sum(sz) AS BIGINT) AS volume FROM tape GROUP BY ALL),\n" + grown_sql(name)


def grown_sql(name: str, up_first: bool = False) -> str:
    """The value area of the profiles {name}_p grown step by step, as recursion."""
    down = f"coalesce(b.volume, -1) {'>' if up_first else '>='} coalesce(a.volume, -1)"
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY instrument, bar_us ORDER BY row) AS i, sum(volume) OVER (PARTITION BY instrument, bar_us) AS total FROM {name}_p),
{name}_s AS (SELECT instrument, bar_us, min_by(i, (-volume, i)) AS pk, any_value(total) AS total FROM {name}_n GROUP BY ALL),
{name}_g AS (
  SELECT s.instrument, s.bar_us, pk, s.total, pk AS lo, pk AS hi, n.volume AS held, 0 AS step FROM {name}_s s JOIN {name}_n n ON n.instrument = s.instrument AND n.bar_us = s.bar_us AND n.i = s.pk
  UNION ALL
  SELECT g.instrument, g.bar_us, pk, g.total, CASE WHEN {down} THEN lo - 1 ELSE lo END, CASE WHEN {down} THEN hi ELSE hi + 1 END, held + greatest(coalesce(b.volume, -1), coalesce(a.volume, -1)), step + 1
  FROM {name}_g g LEFT JOIN {name}_n b ON b.instrument = g.instrument AND b.bar_us = g.bar_us AND b.i = g.lo - 1 LEFT JOIN {name}_n a ON a.instrument = g.instrument AND a.bar_us = g.bar_us AND a.i = g.hi + 1
  WHERE held < 0.7 * g.total AND (a.i IS NOT NULL OR b.i IS NOT NULL)
),
{name}_l AS (SELECT instrument, bar_us, any_value(pk) AS pk, arg_max(lo, step) AS lo, arg_max(hi, step) AS hi, any_value(total) AS total FROM {name}_g GROUP BY ALL),
{name} AS (SELECT l.instrument, l.bar_us, p.row AS poc, v.row AS val, h.row AS vah, CAST(l.total AS DOUBLE) AS total FROM {name}_l l
  JOIN {name}_n p ON p.instrument = l.instrument AND p.bar_us = l.bar_us AND p.i = l.pk JOIN {name}_n v ON v.instrument = l.instrument AND v.bar_us = l.bar_us AND v.i = l.lo JOIN {name}_n h ON h.instrument = l.instrument AND h.bar_us = l.bar_us AND h.i = l.hi)"""


SPREAD = """spread_rows AS (SELECT instrument, bar_us, low, high, volume, unnest(range(CAST(floor(low / 2) AS BIGINT), CAST(floor(high / 2) AS BIGINT) + 1)) AS row FROM bars),
spread AS (SELECT instrument, bar_us, row, volume * CASE WHEN high = low THEN 1.0 ELSE (least(high, (row + 1) * 2) - greatest(low, row * 2)) / (high - low) END AS v FROM spread_rows)"""

ORACLE = {
    "footprint_levels": with_(TAPE, FP) + "SELECT * FROM fp",
    "footprint_imbalance": with_(TAPE, FP, FLAGS) + "SELECT * FROM fl",
    "footprint_stacked": with_(TAPE, FP, FLAGS)
    + """, s AS (SELECT instrument, bar_us, 'buy' AS side, px FROM fl WHERE buy_flag UNION ALL SELECT instrument, bar_us, 'sell', px FROM fl WHERE sell_flag),
i AS (SELECT *, px - row_number() OVER (PARTITION BY instrument, bar_us, side ORDER BY px) AS island FROM s)
SELECT instrument, bar_us, side, min(px) AS from_px, max(px) AS to_px, count(*) AS levels FROM i GROUP BY instrument, bar_us, side, island HAVING count(*) >= 2""",
    "footprint_poc": with_(TAPE, FP)
    + f""", c AS (SELECT instrument, us // {DAY_US} * {DAY_US} AS bar_us, {OHLC} FROM tape GROUP BY ALL),
r AS (SELECT fp.*, row_number() OVER (PARTITION BY instrument, bar_us ORDER BY total DESC, abs(px - close), px) AS rn FROM fp JOIN c USING (instrument, bar_us))
SELECT instrument, bar_us, max(CASE WHEN rn = 1 THEN px END) AS poc, CAST(sum(ask_vol - bid_vol) AS BIGINT) AS delta, count(*) AS levels FROM r GROUP BY ALL""",
    "profile_rows": BARS
    + """, x AS (SELECT instrument, low, high, volume, unnest(range(CAST(floor(low / 4) AS BIGINT), CAST(floor(high / 4) AS BIGINT) + 1)) AS row FROM bars)
SELECT instrument, row, round(sum(volume * CASE WHEN high = low THEN 1.0 ELSE (least(high, (row + 1) * 4) - greatest(low, row * 4)) / (high - low) END), 4) AS volume FROM x GROUP BY ALL""",
    "profile_value_area": with_(TAPE, area_sql("va", 1)).replace("WITH", "WITH RECURSIVE", 1) + "SELECT * FROM va",
    "profile_nodes": with_(TAPE)
    + """, p AS (SELECT instrument, px_ticks AS row, CAST(sum(sz) AS BIGINT) AS volume FROM tape GROUP BY ALL),
n AS (SELECT *, max(volume) OVER (PARTITION BY instrument) AS peak, max(volume) OVER r AS top, min(volume) OVER r AS bottom, coalesce(max(volume) OVER u, 0) AS under, coalesce(max(volume) OVER o, 0) AS ovr FROM p
  WINDOW r AS (PARTITION BY instrument ORDER BY row RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING), u AS (PARTITION BY instrument ORDER BY row RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING), o AS (PARTITION BY instrument ORDER BY row RANGE BETWEEN 1 FOLLOWING AND 12 FOLLOWING)),
k AS (SELECT *, CASE WHEN volume >= 0.7 * peak AND volume >= top THEN 'hvn' WHEN volume <= 0.3 * peak AND volume <= bottom AND least(under, ovr) >= 0.3 * peak THEN 'lvn' END AS node FROM n),
g AS (SELECT *, row - row_number() OVER (PARTITION BY instrument, node ORDER BY row) AS run FROM k WHERE node IS NOT NULL)
SELECT instrument, node, arg_max(row, (volume, -row)) AS row, max(volume) AS volume FROM g GROUP BY instrument, node, run""",
    "profile_area_up_first": with_(TAPE, f"va_p AS (SELECT instrument, us // {DAY_US} * {DAY_US} AS bar_us, px_ticks AS row, CAST(sum(sz) AS BIGINT) AS volume FROM tape GROUP BY ALL)", grown_sql("va", True)).replace("WITH", "WITH RECURSIVE", 1) + "SELECT * FROM va",
    "profile_merge": with_(TAPE) + "SELECT instrument, px_ticks AS row, CAST(sum(sz) AS BIGINT) AS volume FROM tape GROUP BY ALL",
    "profile_rolling": (BARS + ", " + SPREAD).replace("WITH", "WITH RECURSIVE", 1)
    + f""", ats AS (SELECT instrument, bar_us AS at_us, count(*) OVER (PARTITION BY instrument ORDER BY bar_us RANGE BETWEEN {2 * DAY_US} PRECEDING AND CURRENT ROW) AS n FROM bars),
va_p AS (SELECT instrument, at_us AS bar_us, row, CAST(round(sum(v) * 1000) AS BIGINT) AS volume FROM ats JOIN spread s USING (instrument) WHERE n > 10 AND s.bar_us <= at_us AND s.bar_us >= at_us - {2 * DAY_US} GROUP BY ALL),
"""
    + grown_sql("va")
    + " SELECT * FROM va",
    "profile_developing": (BARS + ", " + SPREAD).replace("WITH", "WITH RECURSIVE", 1)
    + f""", ats AS (SELECT instrument, bar_us AS at_us, row_number() OVER (PARTITION BY instrument, bar_us // {DAY_US} ORDER BY bar_us) AS n FROM bars),
va_p AS (SELECT instrument, at_us AS bar_us, row, CAST(round(sum(v) * 1000) AS BIGINT) AS volume FROM ats JOIN spread s USING (instrument) WHERE n >= 3 AND s.bar_us <= at_us AND s.bar_us // {DAY_US} = at_us // {DAY_US} GROUP BY ALL),
"""
    + grown_sql("va")
    + " SELECT * FROM va",
    "nested_state": with_(TAPE, area_sql("va", 1), area_sql("wa", 5)).replace("WITH", "WITH RECURSIVE", 1)
    + f""", i AS (SELECT instrument, bar_us, val, vah + 1 AS vah, poc + 0.5 AS poc, coalesce(poc - lag(poc) OVER w, 0) AS drift, total / lag(total) OVER w AS ratio, bar_us // {5 * DAY_US} * {5 * DAY_US} AS week_us FROM va WINDOW w AS (PARTITION BY instrument ORDER BY bar_us)),
y AS (SELECT i.*, wa.val AS oval, wa.vah + 1 AS ovah, (wa.vah + 1 + wa.val) / 2 AS mid, 0.4 * (wa.vah + 1 - wa.val) / 2 AS edge FROM i JOIN wa ON wa.instrument = i.instrument AND wa.bar_us = i.week_us)
SELECT instrument, bar_us, CASE WHEN val > ovah THEN 'BREAKOUT_UP' WHEN vah < oval THEN 'BREAKOUT_DOWN' WHEN val <= oval AND vah >= ovah THEN 'ENGULFING' WHEN val <= ovah AND ovah <= vah THEN 'TESTING_VAH' WHEN val <= oval AND oval <= vah THEN 'TESTING_VAL'
  WHEN poc - mid >= edge AND drift >= 2 THEN 'MIGRATING_UP' WHEN mid - poc >= edge AND drift <= -2 THEN 'MIGRATING_DOWN' ELSE 'NESTED' END AS state,
  greatest(0.0, least(1.0, (least(vah, ovah) - greatest(val, oval)) / (vah - val))) AS overlap, CAST((poc - oval) / (ovah - oval) AS DOUBLE) AS poc_place, drift, CASE WHEN ratio <= 0.7 THEN 'fading' WHEN ratio >= 1.3 THEN 'building' ELSE 'steady' END AS volume_trend FROM y""",
    "market_state": with_(TAPE, bars_sql(HOUR), area_sql("va", 1)).replace("WITH", "WITH RECURSIVE", 1)
    + f""", nn AS (SELECT *, max(volume) OVER (PARTITION BY instrument, bar_us) AS peak, max(volume) OVER r AS top, min(volume) OVER r AS bottom, coalesce(max(volume) OVER u, 0) AS under, coalesce(max(volume) OVER o, 0) AS ovr FROM va_p
  WINDOW r AS (PARTITION BY instrument, bar_us ORDER BY row RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING), u AS (PARTITION BY instrument, bar_us ORDER BY row RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING), o AS (PARTITION BY instrument, bar_us ORDER BY row RANGE BETWEEN 1 FOLLOWING AND 12 FOLLOWING)),
kk AS (SELECT *, CASE WHEN volume >= 0.7 * peak AND volume >= top THEN 'hvn' WHEN volume <= 0.3 * peak AND volume <= bottom AND least(under, ovr) >= 0.3 * peak THEN 'lvn' END AS node FROM nn),
gg AS (SELECT *, row - row_number() OVER (PARTITION BY instrument, bar_us, node ORDER BY row) AS run FROM kk WHERE node IS NOT NULL),
nd AS (SELECT instrument, bar_us, node, arg_max(row, (volume, -row)) AS row FROM gg GROUP BY instrument, bar_us, node, run),
pf AS (SELECT va.instrument, va.bar_us + {DAY_US} AS day_us, poc, val, vah, coalesce(h, []) AS hvn, coalesce(l, []) AS lvn FROM va LEFT JOIN (SELECT instrument, bar_us, list_sort(list(row) FILTER (node = 'hvn')) AS h, list_sort(list(row) FILTER (node = 'lvn')) AS l FROM nd GROUP BY ALL) USING (instrument, bar_us)),
bb AS (SELECT instrument, bar_us, bar_us // {DAY_US} * {DAY_US} AS day_us, close, list(close) OVER (PARTITION BY instrument, bar_us // {DAY_US} ORDER BY bar_us ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS rc FROM bars),
x AS (SELECT *, [poc, vah, val] || hvn || lvn AS nodes, ['POC', 'VAH', 'VAL'] || list_transform(hvn, lambda q: 'HVN') || list_transform(lvn, lambda q: 'LVN') AS kinds, CASE WHEN len(rc) >= 2 AND rc[-1] > vah AND rc[-2] > vah THEN 'above' WHEN len(rc) >= 2 AND rc[-1] < val AND rc[-2] < val THEN 'below' END AS accepted,
  CASE WHEN close > vah THEN 'above value' WHEN close < val THEN 'below value' ELSE 'inside value' END AS zone FROM bb JOIN pf USING (instrument, day_us)),
y AS (SELECT *, list_position(list_transform(nodes, lambda q: abs(q - close)), list_min(list_transform(nodes, lambda q: abs(q - close)))) AS ix, list_min(list_filter(nodes, lambda q: q > close + 1)) AS up_to, list_max(list_filter(nodes, lambda q: q < close - 1)) AS down_to, close - rc[1] AS moved FROM x),
z AS (SELECT *, CASE WHEN abs(nodes[ix] - close) <= 3 THEN nodes[ix] END AS node, CASE WHEN abs(nodes[ix] - close) <= 3 THEN kinds[ix] END AS at_node, len(list_filter(lvn, lambda q: q > close AND q <= coalesce(up_to, close))) > 0 AS ta, len(list_filter(lvn, lambda q: q < close AND q >= coalesce(down_to, close))) > 0 AS tb FROM y)
SELECT instrument, bar_us, zone, accepted, at_node, node, up_to AS node_above, down_to AS node_below,
  CASE WHEN node IS NOT NULL THEN CASE WHEN len(list_filter(rc, lambda q: (q - node) * (rc[1] - node) < 0)) > 0 THEN 'through' WHEN len(list_filter(rc, lambda q: abs(q - node) <= 3)) >= 3 THEN 'holding' ELSE 'probing' END
       WHEN accepted IS NOT NULL THEN 'leaving' WHEN ta AND moved > 0 OR tb AND moved < 0 THEN 'traversing' WHEN zone = 'inside value' THEN 'rotating' ELSE 'probing' END AS doing FROM z""",
}
