"""Order flow: level-1 and multi-level order-flow imbalance, its race z-score, velocity, kinetic push, slope, VWAP bands, divergence.

Windows are partitioned by instrument and ordered by the unique seq; trailing time frames are ranges of microseconds, whose peers of
the same time count together. Spark adds a sliding range up anew for each row, so sums over long ones are differences of running sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bars import SECOND, running_sum

def order():
    """Prints of an instrument in their order."""
    return W.partitionBy("instrument").orderBy("seq")


def trailing(seconds: int):
    return W.partitionBy("instrument").orderBy("us").rangeBetween(-seconds * SECOND, 0)


def trailing_sum(value: Column, seconds: int, key: tuple[str, ...] = ("instrument",)) -> Column:
    """The sum of whole numbers over the trailing seconds, 0 where there are none: the running sum less what it was before, so that the work doesn't grow with the rows in the window."""
    w = W.partitionBy(*key).orderBy("us")
    total = lambda end: F.coalesce(F.sum(value).over(w.rangeBetween(W.unboundedPreceding, end)), F.lit(0))
    return total(0) - total(-seconds * SECOND - 1)


def _side_flow(px: Column, sz: Column, px0: Column, sz0: Column, better: bool) -> Column:
    """Change of resting size on one side: all new size at a better price, all old size lost at a worse one."""
    gained, lost = (px > px0, px < px0) if better else (px < px0, px > px0)
    return F.when(gained, sz).when(lost, -sz0).otherwise(sz - sz0)


def level1_ofi(touches: DataFrame) -> DataFrame:
    """touches with ofi: bid flow less ask flow since the touch before; null at an instrument's first."""
    lag = lambda c: F.lag(c).over(order())
    bid = _side_flow(F.col("bid_px"), F.col("bid_sz"), lag("bid_px"), lag("bid_sz"), True)
    ask = _side_flow(F.col("ask_px"), F.col("ask_sz"), lag("ask_px"), lag("ask_sz"), False)
    return touches.withColumn("ofi", F.when(lag("seq").isNotNull(), bid - ask))


def level_weight(i: Column, depth: int, floor: float = 0.1) -> Column:
    """The weight of level i from 0 on: 1 at the touch, floor at the last of `depth` levels, whatever levels a book has."""
    return F.lit(1.0) - i * ((1 - floor) / max(depth - 1, 1))


def multilevel_ofi(books: DataFrame, depth: int = 10, floor: float = 0.1) -> DataFrame:
    """seq, instrument, ofi: the sum over the first `depth` levels that a book and the one before have of level OFI, weighed by level_weight()."""
    b = books.withColumn("b0", F.lag("bids").over(order())).withColumn("a0", F.lag("asks").over(order())).where("b0 is not null")
    n = F.least(F.size("bids"), F.size("b0"), F.size("asks"), F.size("a0"), F.lit(depth))

    def level(i: Column) -> Column:
        at = lambda c: F.element_at(c, i + 1)
        bid = _side_flow(at("bids")["px"], at("bids")["sz"], at("b0")["px"], at("b0")["sz"], True)
        ask = _side_flow(at("asks")["px"], at("asks")["sz"], at("a0")["px"], at("a0")["sz"], False)
        return (bid - ask) * level_weight(i, depth, floor)

    levels = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(F.transform(levels, level), F.lit(0.0), lambda a, x: a + x)
    return b.select("seq", "instrument", total.alias("ofi"))


def race(ofi: DataFrame, window: int, baseline: int) -> DataFrame:
    """race, the sum of the last `window` OFIs, and z among the last `baseline` races (population deviation), once full. OFIs are whole numbers, so running
    sums of races and of their squares, less those `baseline` rows back, give both exactly, with the same work for any length."""
    so_far = order().rowsBetween(W.unboundedPreceding, 0)
    back = lambda c, k: F.lag(c, k, 0).over(order())
    r = ofi.where("ofi is not null").withColumns({"i": F.row_number().over(order()), "total": F.sum(F.col("ofi").cast("long")).over(so_far)})
    r = r.withColumn("race", F.when(F.col("i") >= window, F.col("total") - back("total", window)))
    r = r.withColumns({"s": F.coalesce(F.sum("race").over(so_far), F.lit(0)), "q": F.coalesce(F.sum(F.col("race") * F.col("race")).over(so_far), F.lit(0))})
    r = r.withColumns({"s": F.col("s") - back("s", baseline), "q": F.col("q") - back("q", baseline)})
    spread = F.col("q") * baseline - F.col("s") * F.col("s")  # baseline^2 times the variance
    full = F.col("i") >= window + baseline - 1
    return r.select("instrument", "seq", "race", F.when(full & (spread > 0), (F.col("race") * baseline - F.col("s")) / F.sqrt(spread)).alias("z"))


def book_cvd(touches: DataFrame) -> DataFrame:
    """Running sum of bid size change less ask size change; a change of price counts nothing."""
    lag = lambda c: F.lag(c).over(order())
    same = (F.col("bid_px") == lag("bid_px")) & (F.col("ask_px") == lag("ask_px"))
    t = touches.withColumn("step", F.when(same, F.col("bid_sz") - lag("bid_sz") - F.col("ask_sz") + lag("ask_sz")).otherwise(0))
    return running_sum(t, "step", "cvd", ["instrument"]).select("instrument", "seq", "cvd")


def delta_window(prints: DataFrame, seconds: int) -> DataFrame:
    """Buy, sell, delta and lean of the trailing seconds at each print."""
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("sz")).otherwise(0)).over(trailing(seconds))
    p = prints.select("instrument", "seq", "us", side("B").alias("buy"), side("A").alias("sell"))
    return p.select("instrument", "seq", "buy", "sell", (F.col("buy") - F.col("sell")).alias("delta"), F.try_divide(F.col("buy") - F.col("sell"), F.col("buy") + F.col("sell")).alias("lean"))


def divergence(bars: DataFrame, window: int) -> DataFrame:
    """Bars whose price and running delta moved apart over `window` bars: bullish (price down, delta up) or bearish."""
    by_bar = W.partitionBy("instrument").orderBy("bar_us")
    b = bars.withColumn("cvd", F.sum("delta").over(by_bar.rowsBetween(W.unboundedPreceding, 0)))
    b = b.withColumn("dp", F.col("close") - F.lag("close", window).over(by_bar)).withColumn("dc", F.col("cvd") - F.lag("cvd", window).over(by_bar))
    kind = F.when((F.col("dp") < 0) & (F.col("dc") > 0), "bullish").when((F.col("dp") > 0) & (F.col("dc") < 0), "bearish")
    return b.select("instrument", "bar_us", "dp", "dc", kind.alias("kind")).where("kind is not null")


def velocity(prints: DataFrame, burst: int, base: int, least: int) -> DataFrame:
    """Prints a second of the trailing burst over those of the trailing base; null with under `least` prints in the base."""
    n1, n2 = trailing_sum(F.lit(1), burst), trailing_sum(F.lit(1), base)
    p = prints.select("instrument", "seq", n1.alias("n_burst"), n2.alias("n_base"))
    return p.withColumn("ratio", F.when(F.col("n_base") >= least, (F.col("n_burst") / burst) / (F.col("n_base") / base)))


def kinetic(prints: DataFrame, seconds: int) -> DataFrame:
    """Efficiency (sum of price change * signed volume over volume) and push ratio of the trailing seconds; prints of an unknown
    aggressor move the previous price but do no work."""
    dp = F.col("px_ticks") - F.lag("px_ticks").over(order())
    signed = F.when(F.col("side") == "B", F.col("sz")).when(F.col("side") == "A", -F.col("sz"))
    p = prints.withColumn("work", F.coalesce(dp * signed, F.lit(0))).withColumn("signed", signed).withColumn("known", F.when(signed.isNotNull(), F.col("sz")))
    add = lambda c: trailing_sum(F.col(c), seconds)
    some = trailing_sum(F.col("signed").isNotNull().cast("int"), seconds) > 0
    p = p.select("instrument", "seq", add("work").alias("work"), F.when(some, add("signed")).alias("signed"), F.when(some, add("known")).alias("volume"))
    quadrant = F.concat(F.when(F.col("signed") > 0, "buy").otherwise("sell"), F.when(F.col("work") >= 0, "-pushing").otherwise("-absorbed"))
    return p.withColumns({"efficiency": F.try_divide("work", "volume"), "push": F.try_divide("signed", "volume"), "quadrant": F.when(F.col("volume") > 0, quadrant)})


def with_sessions(prints: DataFrame, gap_seconds: int) -> DataFrame:
    """prints with session: one ends where no print follows for gap_seconds."""
    fresh = F.when(F.col("us") - F.lag("us").over(order()) > gap_seconds * SECOND, 1).otherwise(0)
    return prints.withColumn("_fresh", fresh).withColumn("session", F.sum("_fresh").over(order().rowsBetween(W.unboundedPreceding, 0))).drop("_fresh")


def dscore(prints: DataFrame, slope_seconds: int, gap_seconds: int) -> DataFrame:
    """Slope of price over the trailing seconds (ticks a minute, three prints at least) and distance from the session's VWAP."""
    p = with_sessions(prints, gap_seconds)
    run = W.partitionBy("instrument", "session").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    p = p.withColumn("u", F.col("us") - F.first("us").over(run))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    add = lambda c: trailing_sum(c, slope_seconds, ("instrument", "session"))
    vwap = F.sum(F.col("px_ticks") * F.col("sz")).over(run) / F.sum("sz").over(run)
    sums = {"n": F.lit(1).cast("long"), "su": whole("u"), "sp": F.col("px_ticks").cast("long"), "suu": whole("u") * whole("u"), "sup": whole("u") * whole("px_ticks")}
    p = p.select("instrument", "seq", "session", "u", "px_ticks", (F.col("px_ticks") - vwap).alias("vwap_distance"), *(add(c).alias(k) for k, c in sums.items()))
    # sums of the distances from this print, in time and price, are exact and small
    u, px, n = whole("u"), whole("px_ticks"), whole("n")
    du, dp = F.col("su") - n * u, F.col("sp") - F.col("n") * F.col("px_ticks")
    duu, dup = F.col("suu") - 2 * u * F.col("su") + n * u * u, F.col("sup") - u * F.col("sp").cast("decimal(19,0)") - px * F.col("su") + n * u * px
    double = lambda c: c.cast("double")
    count = double(F.col("n"))
    over, under = count * double(dup) - double(du) * double(dp), count * double(duu) - double(du) * double(du)
    slope = F.when((F.col("n") >= 3) & (under > 0), over / under * (60 * SECOND))
    return p.select("instrument", "seq", "session", slope.alias("slope"), "vwap_distance")


def vwap_bands(bars: DataFrame) -> DataFrame:
    """VWAP from an instrument's first bar on, of the typical price, with its volume-weighted deviation."""
    run = W.partitionBy("instrument").orderBy("bar_us").rowsBetween(W.unboundedPreceding, 0)
    b = bars.withColumn("tp", F.col("high") + F.col("low") + F.col("close"))  # thrice the typical price, whole
    v, pv, ppv = F.sum("volume").over(run), F.sum(F.col("tp") * F.col("volume")).over(run), F.sum(F.col("tp") * F.col("tp") * F.col("volume")).over(run)
    b = b.select("instrument", "bar_us", v.alias("v"), pv.alias("pv"), ppv.alias("ppv"))
    mean = F.col("pv") / F.col("v") / 3
    var = F.greatest((F.col("ppv").cast("double") * F.col("v") - F.col("pv").cast("double") * F.col("pv")) / F.col("v") / F.col("v") / 9, F.lit(0.0))
    b = b.select("instrument", "bar_us", mean.alias("vwap"), F.sqrt(var).alias("sd"))
    return b.withColumns({f"{n}{i}": F.col("vwap") + s * i * F.col("sd") for i in (1, 2) for n, s in (("upper", 1), ("lower", -1))})


def atr(bars: DataFrame, period: int) -> DataFrame:
    """Mean true range of the last `period` bars, once there are as many."""
    by_bar = W.partitionBy("instrument").orderBy("bar_us")
    before = F.lag("close").over(by_bar)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    b, last = bars.withColumn("tr", tr), by_bar.rowsBetween(-period + 1, 0)
    return b.select("instrument", "bar_us", "tr", F.when(F.count("*").over(last) == period, F.avg("tr").over(last)).alias("atr"))


def schmitt(df: DataFrame, x: str, enter: float, leave: float) -> DataFrame:
    """df with direction: up once x exceeds enter, until it falls to leave or below; likewise down; else flat.

    No state is needed: between leave and enter the direction is up exactly if the last row outside that zone was up.
    """
    v = F.col(x)
    zone = F.when(v > enter, "up").when(v < -enter, "down").when(v > leave, "mid+").when(v < -leave, "mid-").otherwise("flat")
    d = df.withColumn("_zone", zone)
    run = order().rowsBetween(W.unboundedPreceding, 0)
    other = lambda mid: F.last(F.when(F.col("_zone") != mid, F.col("_zone")), ignorenulls=True).over(run)
    way = F.when(F.col("_zone").isin("up", "down", "flat"), F.col("_zone")).when((F.col("_zone") == "mid+") & (other("mid+") == "up"), "up").when((F.col("_zone") == "mid-") & (other("mid-") == "down"), "down").otherwise("flat")
    return d.withColumn("direction", way).drop("_zone")


def refusals(touches: DataFrame, max_gap: int) -> DataFrame:
    """Counts of records by why an OFI step is refused: first, gap (of seq over max_gap), crossed, or accepted (ok)."""
    before = F.lag("seq").over(order())
    why = F.when(before.isNull(), "first").when(F.col("bid_px") >= F.col("ask_px"), "crossed").when(F.col("seq") - before > max_gap, "gap").otherwise("ok")
    return touches.withColumn("reason", why).groupBy("instrument", "reason").agg(F.count("*").alias("n"))


def message_rate(records: DataFrame, seconds: int) -> DataFrame:
    """Messages of the trailing seconds, and cancels over adds among them; null without an add, as there is nothing to compare with."""
    n = lambda a: trailing_sum(F.when(F.col("action") == a, 1).otherwise(0), seconds)
    return records.select("instrument", "seq", trailing_sum(F.lit(1), seconds).alias("messages"), F.try_divide(n("C"), n("A")).alias("cancel_add"))


def rolling_stats(bars: DataFrame, x: str, window: int, current: bool, population: bool, least: int) -> DataFrame:
    """Rolling mean, deviation and z-score in the variants in use: with or without the current row, population or sample."""
    by_bar = W.partitionBy("instrument").orderBy("bar_us")
    w = by_bar.rowsBetween(-window + 1, 0) if current else by_bar.rowsBetween(-window, -1)
    sd = (F.stddev_pop if population else F.stddev_samp)(x).over(w)
    b = bars.select("instrument", "bar_us", F.col(x).alias("x"), F.avg(x).over(w).alias("mean"), sd.alias("sd"), F.count(x).over(w).alias("n"))
    full = F.col("n") >= least
    return b.select("instrument", "bar_us", "x", F.when(full, F.col("mean")).alias("mean"), F.when(full, F.col("sd")).alias("sd"), F.when(full & (F.col("sd") > 0), (F.col("x") - F.col("mean")) / F.col("sd")).alias("z"))


def flips(bars: DataFrame, window: int) -> DataFrame:
    """Sign changes of delta within the last `window` bars, and whether this bar is one."""
    by_bar = W.partitionBy("instrument").orderBy("bar_us")
    b = bars.withColumn("sign", F.signum("delta")).withColumn("flip", F.coalesce((F.signum("delta") * F.lag(F.signum("delta")).over(by_bar) < 0).cast("int"), F.lit(0)))
    return b.select("instrument", "bar_us", "flip", F.sum("flip").over(by_bar.rowsBetween(-window + 1, 0)).alias("flips"))
