"""Order books as arrays of (px, sz), best first: microprice, imbalance, depth, walking, shelves, ladder changes; and audits of the
aggressor convention. Book arithmetic stays within a row (higher-order functions), so none of it shuffles but the audits' counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _sum(levels: Column, f) -> Column:
    return F.aggregate(levels, F.lit(0).cast("double"), lambda a, x: a + f(x).cast("double"))


def mid() -> Column:
    return (F.element_at("bids", 1)["px"] + F.element_at("asks", 1)["px"]) / 2


def microprice(books: DataFrame) -> DataFrame:
    """Size-weighted mid and its tilt, from -1 to 1."""
    b, a = F.element_at("bids", 1), F.element_at("asks", 1)
    micro = (b["px"] * a["sz"] + a["px"] * b["sz"]) / (a["sz"] + b["sz"])
    return books.select("instrument", "seq", micro.alias("microprice"), ((micro - mid()) / ((a["px"] - b["px"]) / 2)).alias("tilt"))


def depth(books: DataFrame, ticks: float) -> DataFrame:
    """Notional within `ticks` of the mid by side, and (bid - ask) / (bid + ask)."""
    m = mid()
    near = lambda side: _sum(F.filter(side, lambda x: F.abs(x["px"] - m) <= ticks), lambda x: x["px"] * x["sz"])
    b = books.select("instrument", "seq", near("bids").alias("bid"), near("asks").alias("ask"))
    return b.withColumn("imbalance", F.try_divide(F.col("bid") - F.col("ask"), F.col("bid") + F.col("ask")))


def walk(books: DataFrame, size: int, side: str = "asks") -> DataFrame:
    """Filling `size` against one side: filled, average price, worst price, levels used, slippage in ticks from the mid."""
    start = F.struct(F.lit(0).cast("long").alias("filled"), F.lit(0).cast("long").alias("cost"), F.lit(None).cast("long").alias("worst"), F.lit(0).alias("levels"))

    def step(a: Column, x: Column) -> Column:
        take = F.least(x["sz"], size - a["filled"])
        go = take > 0
        return F.struct((a["filled"] + F.greatest(take, F.lit(0))).cast("long").alias("filled"), (a["cost"] + F.greatest(take, F.lit(0)) * x["px"]).cast("long").alias("cost"), F.when(go, x["px"]).otherwise(a["worst"]).cast("long").alias("worst"), (a["levels"] + go.cast("int")).alias("levels"))

    b = books.withColumn("w", F.aggregate(side, start, step))
    avg = F.try_divide(F.col("w.cost"), F.col("w.filled"))
    return b.select("instrument", "seq", "w.filled", avg.alias("avg_px"), F.col("w.worst"), F.col("w.levels"), F.abs(avg - mid()).alias("slippage"), (F.col("w.filled") < size).alias("exhausted"))


def shelves(books: DataFrame, multiple: float, top: int) -> DataFrame:
    """Levels of at least `multiple` times their side's median size, the `top` largest of a book (ties: nearer price first)."""
    sides = F.array(F.struct(F.lit("bid").alias("side"), F.col("bids").alias("levels")), F.struct(F.lit("ask").alias("side"), F.col("asks").alias("levels")))
    s = books.select("instrument", "seq", F.explode(sides).alias("s")).select("instrument", "seq", "s.side", "s.levels")
    sizes = F.array_sort(F.transform("levels", lambda x: x["sz"]))
    n = F.size(sizes)
    median = (F.element_at(sizes, F.floor((n + 1) / 2).cast("int")) + F.element_at(sizes, F.floor(n / 2 + 1).cast("int"))) / 2
    s = s.where(F.size("levels") >= 3).withColumn("median", median)
    x = s.select("instrument", "seq", "side", "median", F.posexplode("levels").alias("i", "l")).where(F.col("l.sz") >= F.col("median") * multiple)
    rank = F.row_number().over(W.partitionBy("instrument", "seq").orderBy(F.desc("l.sz"), "i", "side"))
    return x.select("instrument", "seq", "side", F.col("l.px").alias("px"), F.col("l.sz").alias("sz"), rank.alias("rank")).where(F.col("rank") <= top)


def ladder_changes(books: DataFrame) -> DataFrame:
    """By book, what was added to and lost from the bid ladder at prices that both this book and the one before span."""
    order = W.partitionBy("instrument").orderBy("seq")
    b = books.select("instrument", "seq", "bids", F.lag("bids").over(order).alias("old")).where("old is not null")
    lo, hi = F.greatest(F.array_min(F.transform("bids", lambda x: x["px"])), F.array_min(F.transform("old", lambda x: x["px"]))), F.least(F.element_at("bids", 1)["px"], F.element_at("old", 1)["px"])
    b = b.withColumns({"lo": lo, "hi": hi})
    px = F.sequence("lo", "hi")
    size = lambda side, p: F.coalesce(F.get(F.filter(side, lambda x: x["px"] == p), F.lit(0))["sz"], F.lit(0))
    change = F.transform(px, lambda p: size("bids", p) - size("old", p))
    b = b.where("lo <= hi").withColumn("change", change)
    return b.select("instrument", "seq", _sum(F.col("change"), lambda x: F.greatest(x, F.lit(0))).alias("added"), _sum(F.col("change"), lambda x: F.greatest(-x, F.lit(0))).alias("lost"), F.size("change").alias("levels"))


def side_convention(prints: DataFrame, touches: DataFrame, high: float, low: float) -> DataFrame:
    """Share of prints above the mid of the touch before, by side code: high and more is BUY, low and less SELL."""
    order = W.partitionBy("instrument").orderBy("seq")
    mids = touches.select("instrument", "seq", F.lag(F.col("bid_px") + F.col("ask_px")).over(order).alias("mid2"))
    p = prints.join(mids, ["instrument", "seq"]).where(F.col("mid2").isNotNull() & (2 * F.col("px_ticks") != F.col("mid2")))
    s = p.groupBy("side").agg(F.count("*").alias("n"), F.avg((2 * F.col("px_ticks") > F.col("mid2")).cast("int")).alias("share"))
    return s.withColumn("reads", F.when(F.col("share") >= high, "BUY").when(F.col("share") <= low, "SELL").otherwise("ambiguous"))


def fills(touches: DataFrame, max_spread: int) -> DataFrame:
    """Where a buy and a sell would fill: across the spread if the quote is usable, else at nothing, with the reason."""
    spread = F.col("ask_px") - F.col("bid_px")
    why = F.when((F.col("bid_px") <= 0) | (F.col("ask_px") <= 0), "empty").when(spread <= 0, "crossed").when(spread > max_spread, "wide").otherwise("ok")
    t = touches.withColumn("reason", why)
    return t.select("instrument", "seq", "reason", F.when(F.col("reason") == "ok", F.col("ask_px")).alias("buy_px"), F.when(F.col("reason") == "ok", F.col("bid_px")).alias("sell_px"))


def band_flow(touches: DataFrame, noise: float) -> DataFrame:
    """Size eaten from and put back to the best bid while its price stands, changes within `noise` of the size left out."""
    order = W.partitionBy("instrument").orderBy("seq")
    d = F.when(F.col("bid_px") == F.lag("bid_px").over(order), F.col("bid_sz") - F.lag("bid_sz").over(order))
    t = touches.withColumn("d", d).withColumn("big", F.abs("d") > F.lit(noise) * F.lag("bid_sz").over(order)).where("big")
    t = t.withColumn("refill", (F.col("d") > 0) & (F.lag("d").over(order) < 0))
    return t.groupBy("instrument").agg(F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("consumed"), F.sum(F.greatest("d", F.lit(0))).alias("replenished"), F.count_if("refill").alias("refills"))
