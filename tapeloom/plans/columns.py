"""Queries on JSON readers and on functions of columns."""

from datetime import date

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import market as M
from ..functions import verdicts as V
from ..sources import ingest as I
from ..sources.fixtures import DEPTH, POSITIONS, TAPE, TOUCH, depth, positions, tape, with_
from .bars import BARS, hours

EXPIRIES = [date(2024, 3, 15), date(2024, 6, 21)]
SYMBOLS = ("xyz:GOLD", "EURUSD", "BTC", "xyz:TSLA", "SPX", "WTI", "GBP/JPY", "abc:NDX")


def book_lines(s, sf):
    """Books as JSON lines; every 17th is crossed, every 23rd has one side."""
    k = F.col("k")
    side = lambda c, shift: F.transform(c, lambda x: F.struct((x["px"] + shift).cast("string").alias("px"), x["sz"].cast("string").alias("sz"), F.lit(1).alias("n")))
    crossed, none = F.when(k % 17 == 0, -9).otherwise(0), F.array().cast("array<struct<px:string,sz:string,n:int>>")
    asks = F.when(k % 23 == 0, none).otherwise(side("asks", crossed))
    return depth(tape(s, sf), 3).select(F.to_json(F.struct(F.concat_ws("-", "instrument", "seq").alias("coin"), F.floor(F.col("us") / 1000).alias("time"), F.array(side("bids", 0), asks).alias("levels"))).alias("value"))


def parsed_books(s, sf):
    b = I.parse_books(book_lines(s, sf))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["sz"])
    return b.select("coin", "us", F.get("bids", F.lit(0))["px"].alias("bid"), F.get("asks", F.lit(0))["px"].alias("ask"), F.size("bids").alias("n_bids"), F.size("asks").alias("n_asks"), total("bids").alias("bid_sz"), total("asks").alias("ask_sz"))


def parsed_trades(s, sf):
    t = tape(s, sf).select(F.to_json(F.struct(F.col("instrument").alias("coin"), F.when(F.col("k") % 19 == 0, "bad").otherwise(F.col("px_ticks").cast("string")).alias("px"), F.when(F.col("k") % 29 == 0, "0").otherwise(F.col("sz").cast("string")).alias("sz"), "side", (F.col("us") / 1000).cast("long").alias("time"))).alias("value"))
    return I.parse_trades(t).groupBy("coin", "side").agg(F.count("*").alias("n"), F.sum("sz").alias("sz"), F.sum(F.col("px") * F.col("sz")).alias("notional"), F.max("us").alias("last_us"))


def parsed_accounts(s, sf):
    p = positions(s, sf).where("sweep_id = 1")
    one = F.struct(F.struct("coin", F.col("szi").cast("string").alias("szi"), F.col("entry_px").cast("string").alias("entryPx"), F.when(F.col("wallet") % 5 == 0, None).otherwise(F.col("liquidation_px").cast("string")).alias("liquidationPx"), F.struct(F.lit("cross").alias("type"), F.col("leverage").cast("double").alias("value")).alias("leverage"), F.struct(F.col("funding").cast("string").alias("sinceOpen")).alias("cumFunding")).alias("position"))
    a = p.groupBy("wallet", "account_value").agg(F.collect_list(one).alias("assetPositions"))
    lines = a.select(F.to_json(F.struct(F.col("wallet").cast("string").alias("wallet"), F.struct(F.col("account_value").cast("string").alias("accountValue")).alias("marginSummary"), "assetPositions")).alias("value"))
    return I.parse_accounts(lines)


def verdict_columns(s, sf):
    way = lambda c: F.when(c > 0, "up").when(c < 0, "down").otherwise("flat")
    b = hours(s, sf)
    confirmed = V.confirmation(way(F.col("delta")), way(F.col("close") - F.col("open")), F.col("volume"), (F.col("prints") % 4), 10, 2)
    left = V.exit_reason(("stop", F.col("low") < F.col("open") - 2), ("target", F.col("high") > F.col("open") + 2), ("flip", F.col("delta") < -20))
    symbol = F.element_at(F.array(*map(F.lit, SYMBOLS)), (F.col("volume") % len(SYMBOLS) + 1).cast("int"))
    klass = V.asset_class(symbol)
    return b.select("instrument", "bar_us", confirmed.alias("confirmation"), left.alias("exit"), symbol.alias("symbol"), klass.alias("klass"), V.unit(klass, F.col("prints") % 2).alias("unit"), C.near_roll(F.timestamp_micros("bar_us").cast("date"), EXPIRIES).alias("near_roll"))


def market_columns(s, sf):
    b = hours(s, sf)
    return b.select("instrument", "bar_us", M.drift_from_read(F.col("delta") / 10.0, 0.002, 900.0, 0.5).alias("drift"), M.consumption(F.col("buy").cast("double"), F.col("sell")).alias("consumption"))


QUERIES = {"parsed_books": parsed_books, "parsed_trades": parsed_trades, "parsed_accounts": parsed_accounts, "verdict_columns": verdict_columns, "market_columns": market_columns}

ORACLE = {
    "parsed_books": with_(TAPE, TOUCH, DEPTH)
    + """, d AS (SELECT *, ask_px + CASE WHEN k % 17 = 0 THEN -9 ELSE 0 END AS ap FROM depth WHERE i < 3 AND k % 23 <> 0)
SELECT instrument || '-' || seq AS coin, us // 1000 * 1000 AS us, max(bid_px)::DOUBLE AS bid, min(ap)::DOUBLE AS ask, CAST(count(*) AS INTEGER) AS n_bids, CAST(count(*) AS INTEGER) AS n_asks, sum(sz)::DOUBLE AS bid_sz, sum(sz)::DOUBLE AS ask_sz FROM d GROUP BY instrument, seq, us HAVING max(bid_px) < min(ap)""",
    "parsed_trades": with_(TAPE)
    + "SELECT instrument AS coin, CASE side WHEN 'B' THEN 'B' ELSE 'A' END AS side, count(*) AS n, sum(sz)::DOUBLE AS sz, sum(px_ticks * sz)::DOUBLE AS notional, max(us // 1000 * 1000) AS last_us FROM tape WHERE k % 19 <> 0 AND k % 29 <> 0 GROUP BY ALL",
    "parsed_accounts": with_(POSITIONS)
    + "SELECT CAST(wallet AS VARCHAR) AS wallet, coin, szi, entry_px, CASE WHEN wallet % 5 = 0 THEN NULL ELSE liquidation_px END AS liquidation_px, leverage::DOUBLE AS leverage, funding, account_value::DOUBLE AS account_value FROM positions WHERE sweep_id = 1 AND szi <> 0",
    "verdict_columns": BARS
    + f""", x AS (SELECT *, CASE WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' ELSE 'flat' END AS s, CASE WHEN close > open THEN 'up' WHEN close < open THEN 'down' ELSE 'flat' END AS a, ({list(SYMBOLS)!r})[CAST(volume % {len(SYMBOLS)} + 1 AS INTEGER)] AS symbol FROM bars),
y AS (SELECT *, CASE WHEN symbol = 'xyz:GOLD' THEN 'metals' WHEN symbol = 'WTI' THEN 'energy' WHEN symbol IN ('EURUSD', 'GBP/JPY') THEN 'fx' WHEN symbol IN ('SPX', 'abc:NDX') THEN 'index' WHEN symbol = 'xyz:TSLA' THEN 'equity' ELSE 'crypto' END AS klass FROM x)
SELECT instrument, bar_us, CASE WHEN s = 'flat' THEN 'no signal' WHEN a <> 'flat' AND a <> s THEN 'conflict' WHEN a = s AND volume >= 10 AND prints % 4 <= 2 THEN 'confirmed' ELSE 'unconfirmed' END AS confirmation, CASE WHEN low < open - 2 THEN 'stop' WHEN high > open + 2 THEN 'target' WHEN delta < -20 THEN 'flip' END AS exit,
  symbol, klass, CASE WHEN klass = 'fx' THEN 'pip' WHEN prints % 2 > 0 THEN 'tick' ELSE 'point' END AS unit, {" OR ".join(f"abs(datediff('day', DATE '{d}', CAST(make_timestamp(bar_us) AS DATE))) <= 4" for d in EXPIRIES)} AS near_roll FROM y""",
    "market_columns": BARS + "SELECT instrument, bar_us, 0.5 * tanh(delta / 10.0 / 1.5) * 0.002 * sqrt(900.0) / 900.0 AS drift, CASE WHEN sell <= 0 THEN 999.0 ELSE least(999.0, buy / sell) END AS consumption FROM bars",
}
