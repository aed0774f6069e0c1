"""Queries on ingest, sinks, calendars, verdicts and pool cycles."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import verdicts as V
from ..operators import graph as G
from ..operators import ledger as L
from ..sources import ingest as I
from ..sources.fixtures import DAILY, LEDGER, TAPE, daily, ledger, table, tape, with_
from .bars import BARS, hours
from .ledger import CALLS, calls, states


def raw(s, sf):
    """Candles as text, some of them bad."""
    o = table(s, sf, "orders").withColumn("px", F.round("o_totalprice").cast("long"))
    k = F.col("o_orderkey")
    return o.select(
        k.alias("line"), F.when(k % 50 == 7, "soon").otherwise((1500000000 + F.floor(k / 3) * 60).cast("string")).alias("Open Time"), F.concat(F.lit("$"), F.col("px").cast("string")).alias("Open"), F.when(k % 40 == 3, "n/a").otherwise((F.col("px") + k % 9).cast("string")).alias("High"),
        (F.col("px") - k % 5).cast("string").alias("Low"), F.when(k % 60 == 11, F.col("px") + 100).otherwise(F.col("px")).cast("string").alias("Close"), F.lit("1,000").alias("Volume"), F.lit("9").alias("Close Time"),
    )


RAW = """raw AS (SELECT o_orderkey AS line, CASE WHEN o_orderkey % 50 = 7 THEN NULL ELSE (1500000000 + o_orderkey // 3 * 60) * 1000000 END AS us, CAST(px AS DOUBLE) AS open, CASE WHEN o_orderkey % 40 = 3 THEN NULL ELSE CAST(px + o_orderkey % 9 AS DOUBLE) END AS high, CAST(px - o_orderkey % 5 AS DOUBLE) AS low,
  CAST(CASE WHEN o_orderkey % 60 = 11 THEN px + 100 ELSE px END AS DOUBLE) AS close, 1000.0::DOUBLE AS volume FROM (SELECT *, CAST(round(o_totalprice) AS BIGINT) AS px FROM orders)),
why AS (SELECT *, CASE WHEN us IS NULL THEN 'bad time' WHEN high IS NULL THEN 'bad price' WHEN least(open, high, low, close) <= 0 THEN 'not positive' WHEN high < low THEN 'high below low' WHEN greatest(open, close) > high OR least(open, close) < low THEN 'out of range' END AS r FROM raw),
clean AS (SELECT line, us, open, high, low, close, volume, CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY us, r IS NULL ORDER BY line) > 1 THEN 'duplicate time' ELSE r END AS reject FROM why)"""


def halves(s, sf):
    d = daily(s, sf)
    return d.where(F.dayofyear("ts") % 3 != 0), d.where(F.dayofyear("ts") % 2 == 0).withColumn("close", F.col("close") + 1)


HALVES = ", a AS (SELECT * FROM daily WHERE dayofyear(ts) % 3 <> 0), b AS (SELECT * REPLACE (close + 1 AS close) FROM daily WHERE dayofyear(ts) % 2 = 0)"


def pools(s, sf):
    """Three pools of each line: its supplier against its part, its part against its order, its order against its supplier."""
    q, line = F.col("l_quantity").cast("long"), F.col("l_orderkey") * 8 + F.col("l_linenumber")
    names = {"s": F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), "p": F.concat(F.lit("P"), F.col("l_partkey").cast("string")), "o": F.concat(F.lit("O"), F.col("l_orderkey").cast("string"))}
    li = table(s, sf, "lineitem").select(line.cast("long").alias("line"), q.alias("q"), (F.col("l_partkey") % 50).alias("r"), *(c.alias(k) for k, c in names.items()))
    three = F.array(*(F.struct(F.col(a).alias("token0"), F.col(b).alias("token1"), F.lit(i).alias("i")) for i, (a, b) in enumerate(("sp", "po", "os"))))
    x = li.withColumn("x", F.explode(three))
    return x.select((F.col("line") * 3 + F.col("x.i")).alias("pool"), "x.token0", "x.token1", (1000 + F.col("q") * (F.col("x.i") + 1)).alias("reserve0"), (1000 + F.col("r") * (3 - F.col("x.i"))).alias("reserve1"), F.lit(3000).alias("fee_ppm"))


POOLS = """li AS (SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS line, CAST(trunc(l_quantity) AS BIGINT) AS q, l_partkey % 50 AS r, 'S' || l_suppkey AS s, 'P' || l_partkey AS p, 'O' || l_orderkey AS o FROM lineitem),
pools AS (SELECT line * 3 AS pool, s AS token0, p AS token1, 1000 + q AS reserve0, 1000 + r * 3 AS reserve1 FROM li UNION ALL SELECT line * 3 + 1, p, o, 1000 + q * 2, 1000 + r * 2 FROM li UNION ALL SELECT line * 3 + 2, o, s, 1000 + q * 3, 1000 + r FROM li),
edges AS MATERIALIZED (SELECT pool, token0 AS a, token1 AS b, reserve1 / reserve0 * (1 - 3000 / 1e6) AS rate FROM pools WHERE token0 <> token1 UNION ALL SELECT pool, token1, token0, reserve0 / reserve1 * (1 - 3000 / 1e6) FROM pools WHERE token0 <> token1)"""


CYCLES2 = """t2 AS (SELECT a, b, max(rate) AS top FROM edges GROUP BY a, b),
c2 AS (SELECT x.a, x.b, x.pool AS p1, y.pool AS p2, x.rate * y.rate AS gain FROM edges x JOIN t2 ON t2.a = x.b AND t2.b = x.a JOIN edges y ON y.a = x.b AND y.b = x.a WHERE x.a < x.b AND x.rate * top >= 1.02 AND x.pool <> y.pool AND x.rate * y.rate >= 1.02)"""
#: Edges that the best ones beside them can't bring to the gain go first.
CYCLES3 = """e3 AS MATERIALIZED (SELECT e.* FROM edges e JOIN (SELECT a, max(rate) AS o FROM edges GROUP BY a) y ON y.a = e.b JOIN (SELECT b, max(rate) AS i FROM edges GROUP BY b) z ON z.b = e.a WHERE rate * o * i >= 1.15 * (1 - 1e-12)),
c3 AS (SELECT x.a, x.b, y.b AS c, x.pool AS p1, y.pool AS p2, z.pool AS p3, x.rate * y.rate * z.rate AS gain FROM e3 x JOIN e3 y ON x.b = y.a JOIN e3 z ON y.b = z.a AND z.b = x.a
  WHERE x.a < x.b AND x.a < y.b AND x.pool <> y.pool AND y.pool <> z.pool AND x.pool <> z.pool AND x.rate * y.rate * z.rate >= 1.15)"""
#: Two pools of constant product: the amount where profit has its top, or the room of both legs if that is less.
ROUTES = """deep AS (SELECT pool, token0 AS a, token1 AS b, CAST(reserve0 AS HUGEINT) * 1000000 AS i, CAST(reserve1 AS HUGEINT) * 1000000 AS o FROM pools UNION ALL SELECT pool, token1, token0, CAST(reserve1 AS HUGEINT) * 1000000, CAST(reserve0 AS HUGEINT) * 1000000 FROM pools),
ring AS (SELECT x.a AS start, [x.pool, y.pool] AS route, x.i AS i1, x.o AS o1, y.i AS i2, y.o AS o2 FROM deep x JOIN deep y ON y.a = x.b AND y.b = x.a AND x.pool <> y.pool WHERE x.a <> x.b AND CAST(x.o AS DOUBLE) / x.i * (1 - 3000 / 1e6) * (CAST(y.o AS DOUBLE) / y.i * (1 - 3000 / 1e6)) >= {least}),
room AS (SELECT *, i1 * 30 // 10000 AS r1, i2 * 30 // 10000 AS m FROM ring),
cap AS (SELECT *, least(r1, ((m + 1) * i1 * 1000000 - 1) // (997000 * (o1 - m - 1))) AS most FROM room),
best AS (SELECT *, greatest(least(most, CAST(floor((sqrt(CAST(o1 AS DOUBLE) * o2 * i1 * i2) * 997000 * 1e6 - CAST(i1 AS DOUBLE) * i2 * 1e12) / (997000.0 * (CAST(o1 AS DOUBLE) * 997000 + CAST(i2 AS DOUBLE) * 1000000))) AS HUGEINT)), 0) AS x FROM cap),
one AS (SELECT start, route, i2, o2, x, x * 997000 * o1 // (i1 * 1000000 + x * 997000) AS y FROM best),
sized AS (SELECT start, route, CAST(x AS DECIMAL(38, 0)) AS amount, CAST(y * 997000 * o2 // (i2 * 1000000 + y * 997000) AS DECIMAL(38, 0)) AS returned FROM one WHERE y * 997000 * o2 // (i2 * 1000000 + y * 997000) > x)"""


def deep(s, sf):
    """The pools with a million times their reserves, so that what a leg has room for are many units."""
    return pools(s, sf).withColumns({c: F.col(c) * 1_000_000 for c in ("reserve0", "reserve1")})


def mixed(s, sf):
    """deep(), every third of them of concentrated liquidity."""
    one = F.expr("79228162514264337593543950336BD")
    near = (F.col("reserve1").cast("decimal(20,0)") / F.col("reserve0").cast("decimal(20,0)")).cast("decimal(10,6)")
    return deep(s, sf).withColumns({"sqrt_price": F.when(F.col("pool") % 9 < 3, F.floor(one.cast("decimal(29,0)") * near.cast("decimal(8,6)")).cast("string")), "liquidity": F.col("reserve0").cast("string")})


def told(sized):
    return sized.withColumn("route", F.array_join(F.col("route").cast("array<string>"), "-"))


def voted(s, sf):
    way = lambda c, t: F.when(c > t, "up").when(c < -t, "down").otherwise("flat")
    b = hours(s, sf)
    legs = {"d": way(F.col("delta"), 20), "p": way(F.col("close") - F.col("open"), 0), "v": way(F.col("buy") - F.col("sell") * 2, 0)}
    b = b.withColumns(legs)
    side, net = V.vote((F.col("d"), F.lit(2.0)), (F.col("p"), F.lit(1.0)), (F.col("v"), F.lit(1.0)))
    return b.select("instrument", "bar_us", side.alias("side"), net.alias("net"), V.grade(F.col("d"), F.col("v"), F.col("p")).alias("grade"))


def suggestions(s, sf):
    t = ledger(s, sf).withColumn("decision", F.when(F.col("agreeing") == 0, "ignored").when(F.col("agreeing") == 1, "undecided").otherwise("taken"))
    return t.groupBy("decision").agg(F.count("*").alias("n"), F.avg((F.col("net_bps") > 0).cast("int")).alias("hit"), F.avg("net_bps").alias("avg_net"), F.sum("net_bps").alias("total_net"), F.sum(F.col("gross_bps") - F.col("net_bps")).alias("drag"), F.count_if(F.col("exit_reason") == "candle_end").alias("open_at_close"))


def read_stats(s, sf):
    x = states(s, sf).withColumn("strength", F.abs("delta") / F.col("volume"))
    band = F.when(F.col("strength") < 0.3, "weak").when(F.col("strength") < 0.6, "middle").otherwise("strong")
    x = x.withColumn("band", band)
    return x.rollup("band").agg(F.count("*").alias("n"), F.avg((F.col("called") > 0).cast("int")).alias("accuracy"), F.avg(F.abs("move")).alias("mean_move"))


def props(s, sf):
    e = table(s, sf, "events").select("event_type", F.from_json("props", "k long").alias("p"), "value")
    return e.groupBy("event_type").agg(F.sum("p.k").alias("k"), F.max("p.k").alias("max_k"), F.count("*").alias("n"))


def snapshot_counts(s, sf):
    return table(s, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("first_us"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last_us"))


def size_bands(s, sf):
    """Trades in three bands of holding time, cut at the thirds of all."""
    t = ledger(s, sf)
    cuts = t.agg(F.percentile("held_s", F.lit(1 / 3)).alias("a"), F.percentile("held_s", F.lit(2 / 3)).alias("b"))
    band = F.when(F.col("held_s") <= cuts.select("a").scalar(), "low").when(F.col("held_s") <= cuts.select("b").scalar(), "middle").otherwise("high")
    return t.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg("net_bps").alias("mean_net"), F.min("held_s").alias("from_s"), F.max("held_s").alias("to_s"))


def by_tape(s, sf):
    """Notional by price step and side, and where the busiest price stands."""
    p = tape(s, sf).groupBy("instrument", (F.floor(F.col("px_ticks") / 4) * 4).alias("step")).agg(F.sum(F.when(F.col("side") == "B", F.col("px_ticks") * F.col("sz")).otherwise(0)).alias("bought"), F.sum(F.when(F.col("side") == "A", F.col("px_ticks") * F.col("sz")).otherwise(0)).alias("sold"))
    return p.withColumn("share", (F.col("bought") + F.col("sold")) / F.sum(F.col("bought") + F.col("sold")).over(W.partitionBy("instrument")))


QUERIES = {
    "ingest_clean": lambda s, sf: I.clean(raw(s, sf)).where("reject is null").drop("reject"),
    "ingest_rejects": lambda s, sf: I.clean(raw(s, sf)).groupBy("reject").agg(F.count("*").alias("n")),
    "upsert_merge": lambda s, sf: I.merge(*halves(s, sf), ["ts"]),
    "insert_ignore": lambda s, sf: I.insert_or_ignore(*halves(s, sf), ["ts"]),
    "prune_latest": lambda s, sf: I.prune(hours(s, sf).select("instrument", "bar_us", "close"), ["instrument"], F.desc("bar_us"), 25),
    "roll_dates": lambda s, sf: C.roll_dates(table(s, sf, "orders"), "o_orderdate").withColumn("expiry", F.col("expiry").cast("string")),
    "front_contracts": lambda s, sf: C.contracts(table(s, sf, "orders"), "o_orderdate").withColumn("day", F.col("day").cast("string")),
    "votes_and_grades": voted,
    "suggestion_stats": suggestions,
    "read_stats": read_stats,
    "json_props": props,
    "snapshot_counts": snapshot_counts,
    "size_bands": size_bands,
    "notional_profile": by_tape,
    "dex_cycles2": lambda s, sf: G.cycles2(G.swaps(pools(s, sf)), 1.02),
    "dex_cycles3": lambda s, sf: G.cycles3(G.swaps(pools(s, sf)), 1.15),
    "route_sizes": lambda s, sf: told(G.route_sizes(G.routes2(deep(s, sf), 1.0))),
    "route_sizes_mixed": lambda s, sf: told(G.route_sizes(G.routes_from(mixed(s, sf), "S1"))),
    "dex_best_routes": lambda s, sf: told(G.ranked(G.route_sizes(G.routes2(deep(s, sf), 1.0)))),
    "callbook_coverage": lambda s, sf: L.callbook(calls(s, sf).withColumn("mark", (F.col("prints") % 3).cast("int")), ["mark"]),
}

EXPIRIES = """WITH y AS (SELECT CAST(y AS INTEGER) AS year, m AS month FROM (SELECT min(year(o_orderdate)) - 1 AS a, max(year(o_orderdate)) + 1 AS b FROM orders), range(a, b + 1) r(y), (SELECT unnest([3, 6, 9, 12]) AS m)),
f AS (SELECT *, make_date(year, month, 1) AS first FROM y),
x AS (SELECT year, month, first + CAST((5 - isodow(first) + 7) % 7 + 14 AS INTEGER) AS expiry, substr('HMUZ', month // 3, 1) || lpad(CAST(year % 100 AS VARCHAR), 2, '0') AS code FROM f)
"""

DV = "d AS (SELECT *, CASE WHEN delta > 20 THEN 'up' WHEN delta < -20 THEN 'down' ELSE 'flat' END AS d, CASE WHEN close > open THEN 'up' WHEN close < open THEN 'down' ELSE 'flat' END AS p, CASE WHEN buy - sell * 2 > 0 THEN 'up' WHEN buy - sell * 2 < 0 THEN 'down' ELSE 'flat' END AS v FROM bars)"

ORACLE = {
    "ingest_clean": with_(RAW) + "SELECT * EXCLUDE (reject) FROM clean WHERE reject IS NULL",
    "ingest_rejects": with_(RAW) + "SELECT reject, count(*) AS n FROM clean GROUP BY reject",
    "upsert_merge": with_(DAILY) + HALVES + " SELECT * FROM b UNION ALL SELECT * FROM a WHERE ts NOT IN (SELECT ts FROM b)",
    "insert_ignore": with_(DAILY) + HALVES + " SELECT * FROM b WHERE ts NOT IN (SELECT ts FROM a)",
    "prune_latest": BARS + "SELECT instrument, bar_us, close FROM bars QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY bar_us DESC) <= 25",
    "roll_dates": EXPIRIES + "SELECT year, month, expiry::VARCHAR AS expiry, code FROM x WHERE year IN (SELECT year(o_orderdate) FROM orders)",
    "front_contracts": EXPIRIES
    + """, d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), n AS (SELECT *, lead(code) OVER (ORDER BY expiry) AS deferred, lag(expiry) OVER (ORDER BY expiry) AS prior FROM x)
SELECT day::VARCHAR AS day, arg_min(code, expiry) AS front, arg_min(deferred, expiry) AS deferred, CAST(min(expiry) - day AS INTEGER) AS days_left, min(expiry) - day <= 4 OR day - arg_min(prior, expiry) <= 4 AS near_roll FROM d JOIN n ON expiry >= day GROUP BY day""",
    "votes_and_grades": BARS
    + ", "
    + DV
    + """, n AS (SELECT *, CASE d WHEN 'up' THEN 2.0 WHEN 'down' THEN -2.0 ELSE 0 END + CASE p WHEN 'up' THEN 1.0 WHEN 'down' THEN -1.0 ELSE 0 END + CASE v WHEN 'up' THEN 1.0 WHEN 'down' THEN -1.0 ELSE 0 END AS net,
  list_distinct(list_filter([d, p, v], lambda x: x <> 'flat')) AS spoken, CASE WHEN d = p THEN 1 ELSE 0 END + CASE WHEN v = p THEN 1 ELSE 0 END AS agree, CASE WHEN d <> p AND d <> 'flat' THEN 1 ELSE 0 END + CASE WHEN v <> p AND v <> 'flat' THEN 1 ELSE 0 END AS against FROM d)
SELECT instrument, bar_us, CASE WHEN net > 0 THEN 'up' WHEN net < 0 THEN 'down' WHEN len(spoken) = 1 THEN spoken[1] ELSE 'flat' END AS side, CAST(net AS DOUBLE) AS net, CASE WHEN p = 'flat' THEN '-' WHEN agree = 0 AND against > 0 THEN 'X' WHEN agree = 2 THEN 'A' WHEN agree = 1 THEN 'B' ELSE 'C' END AS grade FROM n""",
    "suggestion_stats": with_(LEDGER)
    + "SELECT CASE agreeing WHEN 0 THEN 'ignored' WHEN 1 THEN 'undecided' ELSE 'taken' END AS decision, count(*) AS n, avg(CASE WHEN net_bps > 0 THEN 1 ELSE 0 END) AS hit, avg(net_bps) AS avg_net, CAST(sum(net_bps) AS BIGINT) AS total_net, CAST(sum(gross_bps - net_bps) AS BIGINT) AS drag, count_if(exit_reason = 'candle_end') AS open_at_close FROM ledger GROUP BY ALL",
    "read_stats": BARS
    + CALLS.replace("volume FROM bars", "volume, delta FROM bars")
    + ", x AS (SELECT *, CASE WHEN abs(delta) / volume < 0.3 THEN 'weak' WHEN abs(delta) / volume < 0.6 THEN 'middle' ELSE 'strong' END AS band FROM states) SELECT band, count(*) AS n, avg(CASE WHEN called > 0 THEN 1 ELSE 0 END) AS accuracy, avg(abs(move)) AS mean_move FROM x GROUP BY ROLLUP (band)",
    "json_props": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS max_k, count(*) AS n FROM events GROUP BY event_type",
    "snapshot_counts": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events GROUP BY event_type",
    "size_bands": with_(LEDGER)
    + "SELECT CASE WHEN held_s <= (SELECT quantile_cont(held_s, 1 / 3) FROM ledger) THEN 'low' WHEN held_s <= (SELECT quantile_cont(held_s, 2 / 3) FROM ledger) THEN 'middle' ELSE 'high' END AS band, count(*) AS n, avg(net_bps) AS mean_net, min(held_s) AS from_s, max(held_s) AS to_s FROM ledger GROUP BY ALL",
    "notional_profile": with_(TAPE)
    + ", p AS (SELECT instrument, CAST(floor(px_ticks / 4) AS BIGINT) * 4 AS step, CAST(sum(CASE WHEN side = 'B' THEN px_ticks * sz ELSE 0 END) AS BIGINT) AS bought, CAST(sum(CASE WHEN side = 'A' THEN px_ticks * sz ELSE 0 END) AS BIGINT) AS sold FROM tape GROUP BY ALL) SELECT *, (bought + sold) / sum(bought + sold) OVER (PARTITION BY instrument) AS share FROM p",
    "dex_cycles2": with_(POOLS, CYCLES2) + "SELECT * FROM c2",
    "dex_cycles3": with_(POOLS, CYCLES3) + "SELECT * FROM c3",
    "dex_best_routes": with_(POOLS, ROUTES.format(least=1.0))
    + "SELECT start, array_to_string(route, '-') AS route, amount, returned, returned - amount AS gross, CAST(returned - amount AS DOUBLE) / amount * 10000 AS bps FROM sized WHERE CAST(returned - amount AS DOUBLE) / amount * 10000 <= 1000 ORDER BY gross DESC, sized.route LIMIT 10",
    "route_sizes": with_(POOLS, ROUTES.format(least=1.0)) + "SELECT * REPLACE (array_to_string(route, '-') AS route) FROM sized",
    "callbook_coverage": BARS
    + CALLS.replace("volume FROM bars", "volume, CAST(prints % 3 AS INTEGER) AS mark FROM bars")
    + """, g AS (SELECT mark, count(*) AS offered, count_if(side <> 0) AS called, count_if(side <> 0 AND outcome <> 0) AS scored, count_if(side <> 0 AND outcome = side) AS hits, count_if(side <> 0 AND outcome <> 0 AND outcome = naive) AS naive_hits, count_if(side <> 0 AND side = naive) AS agreed FROM calls GROUP BY ALL)
SELECT *, hits / nullif(scored, 0) AS rate, (hits - naive_hits) / nullif(scored, 0) AS edge, called / nullif(offered, 0) AS coverage, agreed / nullif(called, 0) AS agreement FROM g""",
}
