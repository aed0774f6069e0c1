"""Price structure on bars: swings, pivots, trend, shifts, level touches, session levels, candle shapes.

Bars carry a key, bar_us and open, high, low, close. Swings and pivots are row frames of fixed width, so they hold with a lag of that width: a swing
may be used from confirmed_us on, and whatever looks back at swings joins on that time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_bar(key: str = "instrument"):
    return W.partitionBy(key).orderBy("bar_us")


def swings(bars: DataFrame, reach: int) -> DataFrame:
    """Swing highs and lows: the leftmost extreme within `reach` bars on both sides; known `reach` bars later."""
    w = by_bar()
    n = F.count("*").over(w.rowsBetween(-reach, reach)) == 2 * reach + 1
    high = (F.col("high") > F.max("high").over(w.rowsBetween(-reach, -1))) & (F.col("high") >= F.max("high").over(w.rowsBetween(1, reach)))
    low = (F.col("low") < F.min("low").over(w.rowsBetween(-reach, -1))) & (F.col("low") <= F.min("low").over(w.rowsBetween(1, reach)))
    b = bars.withColumns({"is_high": n & high, "is_low": n & low, "confirmed_us": F.lead("bar_us", reach).over(w)})
    kinds = F.array_compact(F.array(F.when(F.col("is_high"), F.struct(F.lit("high").alias("kind"), F.col("high").alias("px"))), F.when(F.col("is_low"), F.struct(F.lit("low").alias("kind"), F.col("low").alias("px")))))
    return b.select("instrument", "bar_us", "confirmed_us", F.explode(kinds).alias("s")).select("instrument", "bar_us", "confirmed_us", "s.kind", "s.px")


def pivots(bars: DataFrame, left: int, right: int) -> DataFrame:
    """Asymmetric pivots: ties to the left are allowed, ties to the right aren't."""
    w = by_bar()
    lo, hi = w.rowsBetween(-left, -1), w.rowsBetween(1, right)
    full = (F.count("*").over(lo) == left) & (F.count("*").over(hi) == right)
    b = bars.select("instrument", "bar_us", "high", "low", (full & (F.col("high") >= F.max("high").over(lo)) & (F.col("high") > F.max("high").over(hi))).alias("pivot_high"), (full & (F.col("low") <= F.min("low").over(lo)) & (F.col("low") < F.min("low").over(hi))).alias("pivot_low"))
    return b.where("pivot_high or pivot_low")


def trend(found: DataFrame) -> DataFrame:
    """At each swing, the trend by the last two highs and lows: up (both higher), down (both lower) or range."""
    w = W.partitionBy("instrument").orderBy("bar_us", "kind")
    same = W.partitionBy("instrument", "kind").orderBy("bar_us")
    s = found.withColumn("before", F.lag("px").over(same))
    run = w.rowsBetween(W.unboundedPreceding, 0)
    step = lambda kind: F.last(F.when((F.col("kind") == kind) & F.col("before").isNotNull(), F.signum(F.col("px") - F.col("before"))), ignorenulls=True).over(run)
    s = s.withColumns({"highs": step("high"), "lows": step("low")})
    way = F.when((F.col("highs") > 0) & (F.col("lows") > 0), "up").when((F.col("highs") < 0) & (F.col("lows") < 0), "down").otherwise("range")
    return s.select("instrument", "bar_us", "kind", "px", way.alias("trend"))


def breaks(bars: DataFrame, found: DataFrame) -> DataFrame:
    """Closes beyond the last swing known at the time: up or down, with the level; an as-of join by union and last value."""
    known = found.select("instrument", F.col("confirmed_us").alias("bar_us"), F.lit(0).alias("o"), F.lit(None).cast("long").alias("close"), F.when(F.col("kind") == "high", F.col("px")).alias("h"), F.when(F.col("kind") == "low", F.col("px")).alias("l"), F.col("bar_us").alias("from_us"))
    b = bars.select("instrument", "bar_us", F.lit(1).alias("o"), "close", F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("l"), F.lit(None).cast("long").alias("from_us"))
    run = W.partitionBy("instrument").orderBy("bar_us", "o", "from_us").rowsBetween(W.unboundedPreceding, 0)
    u = known.unionByName(b).withColumns({"last_high": F.last("h", ignorenulls=True).over(run), "last_low": F.last("l", ignorenulls=True).over(run)}).where("o = 1")
    order = by_bar()
    up = (F.col("close") > F.col("last_high")) & ~F.coalesce(F.lag("close").over(order) > F.col("last_high"), F.lit(False))
    down = (F.col("close") < F.col("last_low")) & ~F.coalesce(F.lag("close").over(order) < F.col("last_low"), F.lit(False))
    u = u.withColumn("side", F.when(up, "up").when(down, "down"))
    return u.where("side is not null").select("instrument", "bar_us", "side", "close", F.when(F.col("side") == "up", F.col("last_high")).otherwise(F.col("last_low")).alias("level"))


def level_touches(bars: DataFrame, levels: DataFrame, tolerance: int, step: int = 8) -> DataFrame:
    """Tests of each level (instrument, level_us, px) by later bars: bars that come within tolerance, runs of them, closes through.

    Only bars that reach a level meet it: both are dealt to price rows of `step` ticks, a bar to the few that its range spans."""
    numbered = bars.withColumn("nth", F.row_number().over(by_bar()))
    reach = F.sequence(F.floor((F.col("low") - tolerance) / step), F.floor((F.col("high") + tolerance) / step))
    b = numbered.select("instrument", "bar_us", "nth", "open", "high", "low", "close", F.explode(reach).alias("_row"))
    x = b.join(levels.withColumn("_row", F.floor(F.col("px") / step)), ["instrument", "_row"]).where((F.col("bar_us") > F.col("level_us")) & (F.col("low") <= F.col("px") + tolerance) & (F.col("high") >= F.col("px") - tolerance))
    before = F.lag("nth").over(W.partitionBy("instrument", "level_us", "px").orderBy("bar_us"))
    x = x.withColumn("fresh", before.isNull() | (before < F.col("nth") - 1))
    g = x.groupBy("instrument", "level_us", "px").agg(F.count("*").alias("bars"), F.count_if("fresh").alias("tests"), F.min("bar_us").alias("first_us"), F.count_if(F.signum(F.col("close") - F.col("px")) * F.signum(F.col("open") - F.col("px")) < 0).alias("through"))
    last = bars.groupBy("instrument").agg(F.max("bar_us").alias("_end"))
    every = levels.join(last, "instrument").where(F.col("_end") > F.col("level_us")).select("instrument", "level_us", "px").distinct()
    return every.join(g, ["instrument", "level_us", "px"], "left").na.fill(0, ["bars", "tests", "through"])


def session_levels(bars: DataFrame, day_us: int) -> DataFrame:
    """High, low and close of the trade date before, beside each bar, and where its close stands."""
    d = bars.groupBy("instrument", (F.floor(F.col("bar_us") / day_us) * day_us).alias("day_us")).agg(F.max("high").alias("pdh"), F.min("low").alias("pdl"), F.max_by("close", "bar_us").alias("pdc"))
    w = W.partitionBy("instrument").orderBy("day_us")
    d = d.select("instrument", "day_us", *(F.lag(c).over(w).alias(c) for c in ("pdh", "pdl", "pdc")))
    b = bars.select("instrument", "bar_us", "close", (F.floor(F.col("bar_us") / day_us) * day_us).alias("day_us"))
    where = F.when(F.col("close") > F.col("pdh"), "above").when(F.col("close") < F.col("pdl"), "below").when(F.col("pdh").isNotNull(), "inside")
    return b.join(d, ["instrument", "day_us"]).select("instrument", "bar_us", "pdh", "pdl", "pdc", where.alias("stands"))


def balance(bars: DataFrame, levels: DataFrame, accept: int) -> DataFrame:
    """IMBALANCE_UP or _DOWN where the last `accept` closes are all beyond the value area of the day before, else BALANCE."""
    x = bars.join(levels, ["instrument", "day_us"])
    last = by_bar().rowsBetween(-accept + 1, 0)
    full = F.count("*").over(last) == accept
    state = F.when(full & (F.min("close").over(last) > F.col("vah")), "IMBALANCE_UP").when(full & (F.max("close").over(last) < F.col("val")), "IMBALANCE_DOWN").otherwise("BALANCE")
    return x.select("instrument", "bar_us", state.alias("state"))


def price_action(bars: DataFrame, lookback: int = 12) -> DataFrame:
    """Rejection, sweep and acceptance of each bar with two before it, from -1 to 1, beside the lookback - 1 bars before.

    Rejection: a wick of more than 45 % of the range that is over 1.5 times the other one; its share, below zero for an upper wick. Sweep: an extreme
    of the bars before taken out and the close back inside; 0.4 and more by its depth in basis points. Acceptance: the close beyond that extreme, without a sweep.
    """
    w = by_bar()
    prior = w.rowsBetween(-max(3, lookback) + 1, -1)
    span = F.col("high") - F.col("low")
    up, down = F.col("high") - F.greatest("open", "close"), F.least("open", "close") - F.col("low")
    b = bars.withColumns({"ph": F.max("high").over(prior), "pl": F.min("low").over(prior), "n": F.count("*").over(w.rowsBetween(-2, 0))})
    rejection = F.when(span <= 0, 0.0).when((up / span > 0.45) & (up > down * 1.5), -F.least(up / span, F.lit(1.0))).when((down / span > 0.45) & (down > up * 1.5), F.least(down / span, F.lit(1.0))).otherwise(0.0)
    swept_up, swept_down = (F.col("high") > F.col("ph")) & (F.col("close") < F.col("ph")), (F.col("low") < F.col("pl")) & (F.col("close") > F.col("pl"))
    depth = lambda far, level: F.least(F.lit(1.0), 0.4 + far / level * 10_000 / 25)
    sweep = F.when(swept_up, -depth(F.col("high") - F.col("ph"), F.col("ph"))).when(swept_down, depth(F.col("pl") - F.col("low"), F.col("pl"))).otherwise(0.0)
    acceptance = F.when(swept_up | swept_down, 0.0).when(F.col("close") > F.col("ph"), 1.0).when(F.col("close") < F.col("pl"), -1.0).otherwise(0.0)
    seen = lambda c: F.when(F.col("n") == 3, c).otherwise(0.0)
    return b.select("instrument", "bar_us", seen(rejection).alias("rejection"), seen(sweep).alias("sweep"), seen(acceptance).alias("acceptance"))


def efficiency(bars: DataFrame, window: int) -> DataFrame:
    """Kaufman's ratio: the move over `window` bars by the sum of moves within."""
    w = by_bar()
    b = bars.withColumn("step", F.abs(F.col("close") - F.lag("close").over(w)))
    last = w.rowsBetween(-window + 1, 0)
    return b.select("instrument", "bar_us", F.when(F.count("step").over(last) == window, F.try_divide(F.abs(F.col("close") - F.lag("close", window).over(w)), F.sum("step").over(last))).alias("efficiency"))
