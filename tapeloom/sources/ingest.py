"""Reading market data as it comes: candles as CSV or JSON under any header, books, trades and accounts as JSON; and keyed sinks.

Headers are resolved on the driver from the names alone; values are cleaned by expressions, so a file of any size is read by Spark's own readers.
What is refused is counted by reason.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts of a header that say what it holds, and those that say it holds something else than a bar's own value.
_PARTS = re.compile("open|high|low|close|vol|time|date")
_OTHER = re.compile("quote|taker|count|number|adj|turnover")


def role(header: str) -> tuple[str, int] | None:
    """The field that a header stands for, and how many letters it has besides; null for none. A time is the bar's own if no price but the
    open goes with it; a single letter is a field's initial."""
    plain = re.sub("[^a-z0-9]", "", header.lower())
    parts = _PARTS.findall(plain)
    prices = [x for x in parts if x in ("open", "high", "low", "close")]
    if _OTHER.search(plain):
        return None
    if "time" in parts or "date" in parts or plain == "ts":
        return ("ts", len(plain)) if prices in ([], ["open"]) else None
    if "vol" in parts:
        return "volume", len(plain)
    if len(prices) == 1:
        return prices[0], len(plain)
    return next(((f, 1) for f in ("ts", "open", "high", "low", "close", "volume") if plain == f[0]), None)


def map_columns(header: list[str]) -> dict[str, str]:
    """Which header stands for which field: of several the shortest, then the first."""
    found: dict[str, tuple[int, str]] = {}
    for h in header:
        if (r := role(h)) and (r[0] not in found or r[1] < found[r[0]][0]):
            found[r[0]] = (r[1], h)
    return {field: h for field, (_, h) in found.items()}


def to_number(c: Column) -> Column:
    """A lenient number: `,` and `$` go; what isn't a finite number is null."""
    x = F.regexp_replace(F.trim(c.cast("string")), "[,$]", "").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def to_timestamp_us(c: Column) -> Column:
    """Epoch microseconds from seconds, milli-, micro- or nanoseconds by size, or from text taken as UTC: ISO, or a date with or
    without a time, year, day or month first."""
    n = F.trim(c.cast("string")).try_cast("double")
    scale = F.when(n >= 1e17, n / 1e3).when(n >= 1e14, n).when(n >= 1e11, n * 1e3).otherwise(n * 1e6)
    text = F.trim(c.cast("string"))
    # year first as ISO has it; then day or, where that can't be, month first
    forms = [F.try_to_timestamp(text), *(F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd-MM-yyyy HH:mm", "MM-dd-yyyy HH:mm"))]
    return F.coalesce(F.round(scale).cast("long"), F.unix_micros(F.coalesce(*forms)))


def clean(raw: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """All rows with us, open .. volume and `reject`, null where the row is good. Of rows of the same time the first stays; raw may
    carry line, its order, else rows are taken as they come."""
    columns = columns or map_columns([c for c in raw.columns if c != "line"])
    line = F.col("line") if "line" in raw.columns else F.monotonically_increasing_id()
    rows = raw.select(line.alias("line"), to_timestamp_us(F.col(columns["ts"])).alias("us"), *(to_number(F.col(columns[f])).alias(f) for f in ("open", "high", "low", "close")), (to_number(F.col(columns["volume"])) if "volume" in columns else F.lit(None).cast("double")).alias("volume"))
    prices = [F.col(f) for f in ("open", "high", "low", "close")]
    missing = prices[0].isNull() | prices[1].isNull() | prices[2].isNull() | prices[3].isNull()
    why = (
        F.when(F.col("us").isNull(), "bad time").when(missing, "bad price").when(F.least(*prices) <= 0, "not positive")
        .when(F.col("high") < F.col("low"), "high below low").when((F.greatest("open", "close") > F.col("high")) | (F.least("open", "close") < F.col("low")), "out of range")
    )
    rows = rows.withColumn("reject", why)
    first = F.row_number().over(W.partitionBy("us", F.col("reject").isNull()).orderBy("line"))
    return rows.withColumn("reject", F.when(F.col("reject").isNull() & (first > 1), "duplicate time").otherwise(F.col("reject")))


def read_candles(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Candles from CSV (sep: `,`, tab, `;` or `|`, found from the header if not given) or, where path ends in json, JSON lines."""
    if path.rstrip("/").endswith(("json", "jsonl")):
        return clean(spark.read.json(path))
    if sep is None:
        head = (spark.read.text(path).first() or [""])[0]
        sep = max(",\t;|", key=head.count)
    return clean(spark.read.option("header", True).option("sep", sep).csv(path))


BOOK = "struct<coin:string,time:bigint,levels:array<array<struct<px:string,sz:string,n:int>>>>"


def parse_books(lines: DataFrame, value: str = "value") -> DataFrame:
    """coin, us, bids, asks from JSON lines; crossed and one-sided books and empty levels go."""
    j = lines.select(F.from_json(value, BOOK).alias("j")).where("j is not null and size(j.levels) = 2")
    side = lambda i: F.filter(F.transform(F.col("j.levels")[i], lambda x: F.struct(x["px"].try_cast("double").alias("px"), x["sz"].try_cast("double").alias("sz"))), lambda x: (x["px"] > 0) & (x["sz"] > 0))
    b = j.select("j.coin", (F.col("j.time") * 1000).alias("us"), F.reverse(F.array_sort(side(0))).alias("bids"), F.array_sort(side(1)).alias("asks")).where("size(bids) > 0 and size(asks) > 0")
    return b.where(F.col("bids")[0]["px"] < F.col("asks")[0]["px"])


def parse_trades(lines: DataFrame, value: str = "value", buys: tuple[str, ...] = ("B", "buy", "bid")) -> DataFrame:
    """coin, us, px, sz, side from JSON lines; prices and sizes must be positive."""
    t = lines.select(F.from_json(value, "struct<coin:string,px:string,sz:string,side:string,time:bigint>").alias("j")).select("j.coin", (F.col("j.time") * 1000).alias("us"), F.col("j.px").try_cast("double").alias("px"), F.col("j.sz").try_cast("double").alias("sz"), F.when(F.col("j.side").isin(*buys), "B").otherwise("A").alias("side"))
    return t.where("px > 0 and sz > 0 and us is not null")


ACCOUNT = "struct<wallet:string,marginSummary:struct<accountValue:string>,assetPositions:array<struct<position:struct<coin:string,szi:string,entryPx:string,liquidationPx:string,leverage:struct<type:string,value:double>,cumFunding:struct<sinceOpen:string>>>>>"


def parse_accounts(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row per open position of each account: wallet, coin, szi, entry_px, liquidation_px (may be null), leverage, funding, account_value."""
    a = lines.select(F.from_json(value, ACCOUNT).alias("a")).select("a.wallet", F.col("a.marginSummary.accountValue").try_cast("double").alias("account_value"), F.explode("a.assetPositions.position").alias("p"))
    number = lambda c: F.col(c).try_cast("double")
    p = a.select("wallet", "p.coin", number("p.szi").alias("szi"), number("p.entryPx").alias("entry_px"), number("p.liquidationPx").alias("liquidation_px"), F.col("p.leverage.value").alias("leverage"), number("p.cumFunding.sinceOpen").alias("funding"), "account_value")
    return p.where("szi <> 0")


def insert_or_ignore(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of new whose key isn't there yet, one for each key: what to append."""
    return new.dropDuplicates(key).join(existing.select(*key).distinct(), key, "left_anti")


def merge(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Both by key, the new row where both have one."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("_new")))
    return both.withColumn("_r", last).where("_r = 1").drop("_r", "_new")


def prune(rows: DataFrame, key: list[str], order: Column, keep: int) -> DataFrame:
    """The first `keep` rows of each key by order."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(order))).where(F.col("_r") <= keep).drop("_r")
