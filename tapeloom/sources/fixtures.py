"""Market tables laid over the driver's tables: a trade tape, its top of book, account positions, daily bars, closed trades.

Prices are integer ticks of a quarter point, so sums and comparisons are exact. TAPE, TOUCH and so on are the same tables as
SQL for DuckDB, to be put after WITH.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts, us (epoch microseconds), instrument, px_ticks, sz, side (B, A or N: unknown aggressor), k, value."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    walk = W.partitionBy(F.col("user_id") % 8).orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    side = F.when(F.col("event_type").isin("purchase", "signup"), "B").when(F.col("event_type").isin("click", "error"), "A").otherwise("N")
    return e.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.concat(F.lit("M"), (F.col("user_id") % 8).cast("string")).alias("instrument"), (20000 + F.sum(F.col("k") % 5 - 2).over(walk)).alias("px_ticks"),
        (1 + F.floor(F.col("value") / 10)).cast("long").alias("sz"), side.alias("side"), "k", "value",
    )


TAPE = """tape AS (
  SELECT event_id AS seq, ts, epoch_us(ts) AS us, concat('M', CAST(user_id % 8 AS VARCHAR)) AS instrument,
         CAST(20000 + sum(k % 5 - 2) OVER (PARTITION BY user_id % 8 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS px_ticks,
         1 + CAST(floor(value / 10) AS BIGINT) AS sz,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'B' WHEN event_type IN ('click', 'error') THEN 'A' ELSE 'N' END AS side, k, value
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) e
)"""


def touch(prints: DataFrame) -> DataFrame:
    """Top of book at each print: seq, ts, us, instrument, bid_px, ask_px, bid_sz, ask_sz; never crossed."""
    return prints.select(
        "seq", "ts", "us", "instrument", (F.col("px_ticks") - 1 - F.col("k") % 2).alias("bid_px"), (F.col("px_ticks") + 1 + F.floor(F.col("k") / 2) % 2).alias("ask_px"),
        (1 + F.col("k") % 50).alias("bid_sz"), (1 + F.floor(F.col("value") * 100) % 50).cast("long").alias("ask_sz"),
    )


TOUCH = """touch AS (
  SELECT seq, ts, us, instrument, px_ticks - 1 - k % 2 AS bid_px, px_ticks + 1 + CAST(floor(k / 2) AS BIGINT) % 2 AS ask_px,
         1 + k % 50 AS bid_sz, 1 + CAST(floor(value * 100) AS BIGINT) % 50 AS ask_sz FROM tape
)"""


def depth(prints: DataFrame, levels: int = 10) -> DataFrame:
    """A book of `levels` a side: seq, ts, us, instrument, k, bids and asks as array<struct<px,sz>>, best first."""
    t = prints.withColumns({"bid_px": F.col("px_ticks") - 1 - F.col("k") % 2, "ask_px": F.col("px_ticks") + 1 + F.floor(F.col("k") / 2) % 2})
    side = lambda px, s: F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: F.struct((F.col(px) + s * i).cast("long").alias("px"), (1 + (F.col("k") + 7 * i) % 50).cast("long").alias("sz")))
    return t.select("seq", "ts", "us", "instrument", "k", side("bid_px", -1).alias("bids"), side("ask_px", 1).alias("asks"))


DEPTH = """depth AS (
  SELECT t.seq, t.ts, t.us, t.instrument, p.k, i, bid_px - i AS bid_px, ask_px + i AS ask_px, 1 + (p.k + 7 * i) % 50 AS sz
  FROM touch t JOIN tape p USING (seq), range(10) r(i)
)"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sweeps of accounts: sweep_id, wallet, coin, szi (signed), entry_px, n, account_value, liquidation_px, leverage."""
    o = table(spark, sf_dir, "orders")
    sweep = F.when(F.col("o_orderdate") < F.lit("1998-04-01 00:00:00").cast("timestamp_ntz"), 1).otherwise(2)
    signed = F.when(F.col("o_orderstatus") == "F", -1).otherwise(1) * F.round(F.col("o_totalprice")).cast("long")
    p = o.groupBy(sweep.alias("sweep_id"), F.col("o_custkey").alias("wallet"), F.concat(F.lit("C"), (F.col("o_orderkey") % 4).cast("string")).alias("coin")).agg(
        (F.sum(signed) / 1000).alias("szi"), (100 + F.sum(F.round(F.col("o_totalprice")).cast("long")) / F.count("*") / 10000).alias("entry_px"), F.count("*").alias("n")
    )
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("wallet"), F.col("c_acctbal").alias("account_value"), "c_mktsegment")
    liq = F.col("entry_px") * (1 - 0.1 * F.signum("szi") / (1 + F.col("wallet") % 5))
    return p.join(c, "wallet").withColumn("liquidation_px", liq).withColumn("leverage", 1 + F.col("wallet") % 20).withColumn("funding", (F.col("wallet") % 7 - 3).cast("double")).withColumns({"margin_used": F.abs("szi") * F.col("entry_px") / F.col("leverage"), "isolated": F.col("wallet") % 3 == 0})


POSITIONS = """positions AS (
  SELECT p.*, c_acctbal AS account_value, c_mktsegment, entry_px * (1 - 0.1 * sign(szi) / (1 + wallet % 5)) AS liquidation_px,
         1 + wallet % 20 AS leverage, CAST(wallet % 7 - 3 AS DOUBLE) AS funding, abs(szi) * entry_px / (1 + wallet % 20) AS margin_used, wallet % 3 = 0 AS isolated
  FROM (
    SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-04-01 00:00:00' THEN 1 ELSE 2 END AS sweep_id, o_custkey AS wallet, concat('C', CAST(o_orderkey % 4 AS VARCHAR)) AS coin,
           sum(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * CAST(round(o_totalprice) AS BIGINT)) / 1000 AS szi,
           100 + sum(CAST(round(o_totalprice) AS BIGINT)) / count(*) / 10000 AS entry_px, count(*) AS n
    FROM orders GROUP BY ALL
  ) p JOIN customer ON c_custkey = wallet
)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of orders: ts, open, high, low, close (whole units), volume."""
    o = table(spark, sf_dir, "orders").withColumn("px", F.round("o_totalprice").cast("long"))
    return o.groupBy(F.col("o_orderdate").alias("ts")).agg(F.min_by("px", "o_orderkey").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "o_orderkey").alias("close"), F.count("*").alias("volume"))


DAILY = """daily AS (
  SELECT o_orderdate AS ts, arg_min(px, o_orderkey) AS open, max(px) AS high, min(px) AS low, arg_max(px, o_orderkey) AS close, count(*) AS volume
  FROM (SELECT *, CAST(round(o_totalprice) AS BIGINT) AS px FROM orders) GROUP BY o_orderdate
)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades: grade, interval_name, coin, exit_reason, source, net_bps, gross_bps (whole), held_s, mae_bps, mfe_bps, closed_at."""
    q, li = F.col("l_quantity").cast("long"), table(spark, sf_dir, "lineitem")
    net = F.round((F.col("l_discount") - F.col("l_tax")) * 1000).cast("long")
    return li.select(
        F.col("l_returnflag").alias("grade"), F.col("l_linestatus").alias("interval_name"), F.concat(F.lit("S"), (F.col("l_suppkey") % 5).cast("string")).alias("coin"),
        F.when(q % 3 == 0, "target").when(q % 3 == 1, "stop").otherwise("candle_end").alias("exit_reason"), F.when(F.col("l_partkey") % 2 == 0, "auto").otherwise("manual").alias("source"),
        net.alias("net_bps"), (net + 2).alias("gross_bps"), (q * 60).alias("held_s"), (-(q % 11)).alias("mae_bps"), (q % 13).alias("mfe_bps"), (F.col("l_partkey") % 4).alias("agreeing"),
        F.col("l_shipdate").alias("closed_at"), F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("supp"),
    )


LEDGER = """ledger AS (
  SELECT l_returnflag AS grade, l_linestatus AS interval_name, concat('S', CAST(l_suppkey % 5 AS VARCHAR)) AS coin,
         CASE q % 3 WHEN 0 THEN 'target' WHEN 1 THEN 'stop' ELSE 'candle_end' END AS exit_reason, CASE WHEN l_partkey % 2 = 0 THEN 'auto' ELSE 'manual' END AS source,
         CAST(round((l_discount - l_tax) * 1000) AS BIGINT) AS net_bps, CAST(round((l_discount - l_tax) * 1000) AS BIGINT) + 2 AS gross_bps, q * 60 AS held_s, -(q % 11) AS mae_bps, q % 13 AS mfe_bps,
         l_partkey % 4 AS agreeing, l_shipdate AS closed_at, l_orderkey AS order_id, l_suppkey AS supp
  FROM (SELECT *, CAST(trunc(l_quantity) AS BIGINT) AS q FROM lineitem)
)"""


def with_(*tables: str) -> str:
    """WITH ... for a query on these tables."""
    return "WITH " + ",\n".join(tables) + "\n"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of book and trade records as a vendor sends them: instrument, us, seq, sequence, contract, action (T trade, A add, C cancel, N nothing,
    R clear), side, price and level prices in 1e-9 units (2^63 - 1: undefined), size, levels as array<struct<bid_px,bid_sz,ask_px,ask_sz>>."""
    nth = F.row_number().over(W.partitionBy("instrument").orderBy("seq"))
    t = tape(spark, sf_dir).withColumn("nth", nth)
    k, unit = F.col("k"), 250_000_000
    action = F.when(k % 97 == 0, "N").when(k % 89 == 0, "R").when((F.col("side") != "N") & (k % 3 != 0), "T").when(k % 5 == 0, "C").otherwise("A")
    bid, ask = F.col("px_ticks") - 1 - k % 2, F.when(k % 67 == 0, F.col("px_ticks") - 1 - k % 2).otherwise(F.col("px_ticks") + 1 + F.floor(k / 2) % 2)
    level = lambda i: F.struct(((bid - i) * unit).alias("bid_px"), ((k + 7 * i) % 50).alias("bid_sz"), ((ask + i) * unit).alias("ask_px"), ((k + 11 * i) % 40 + 1).alias("ask_sz"))
    none = F.array().cast("array<struct<bid_px:bigint,bid_sz:bigint,ask_px:bigint,ask_sz:bigint>>")
    levels = F.when(k % 83 == 0, none).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")), level))
    return t.select(
        "instrument", "us", "seq", (F.col("nth") + F.floor(F.col("nth") / 40)).cast("long").alias("sequence"), (1 + F.floor(F.col("us") / (9 * 86_400_000_000)) % 2).cast("int").alias("contract"), action.alias("action"), "side",
        F.when(k % 59 == 0, F.lit(2**63 - 1)).otherwise(F.col("px_ticks") * unit).alias("price"), F.when(k % 53 == 0, 0).otherwise(F.col("sz")).cast("long").alias("size"), levels.alias("levels"),
    )


RECORDS = """records AS (
  SELECT instrument, us, seq, nth + nth // 40 AS sequence, CAST(1 + us // (9 * 86400000000) % 2 AS INTEGER) AS contract,
         CASE WHEN k % 97 = 0 THEN 'N' WHEN k % 89 = 0 THEN 'R' WHEN side <> 'N' AND k % 3 <> 0 THEN 'T' WHEN k % 5 = 0 THEN 'C' ELSE 'A' END AS action, side,
         CASE WHEN k % 59 = 0 THEN 9223372036854775807 ELSE px_ticks * 250000000 END AS price, CASE WHEN k % 53 = 0 THEN 0 ELSE sz END AS size,
         CASE WHEN k % 83 = 0 THEN [] ELSE list_transform([0, 1, 2], lambda i: {'bid_px': (px_ticks - 1 - k % 2 - i) * 250000000, 'bid_sz': (k + 7 * i) % 50, 'ask_px': (CASE WHEN k % 67 = 0 THEN px_ticks - 1 - k % 2 ELSE px_ticks + 1 + k // 2 % 2 END + i) * 250000000, 'ask_sz': (k + 11 * i) % 40 + 1}) END AS levels
  FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY seq) AS nth FROM tape)
)"""
