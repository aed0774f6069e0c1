"""Effort and result of a bar under way: volume against what bars have done by that point, clock windows of books and prints, and the shape of a bar."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bars import SECOND, bucket
from .flow import level1_ofi

LEAST_SHARE = 1e-4


def _median(values: Column) -> Column:
    """Of a sorted array."""
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2


def curves(prints: DataFrame, bar_s: int, slices: int, back_days: int, least: int, unit_s: int | None = None) -> DataFrame:
    """By instrument and day, what bars of the back_days before did: shares (median share of its volume that a bar has done by the end of each slice),
    normal_volume and normal_range (medians; the range in ticks) and samples. Fewer than `least` bars: shares are null, the rest stands.

    A day's state is a list of one row for each of its bars, so days merge by being put together, and a day never sees itself. With unit_s a bar counts only
    where each of its units of time has a print; without, the bar that the instrument's first print is in doesn't, as it may have begun before. Bars without volume
    don't count. bar_s must divide a day."""
    width = bar_s * SECOND // slices
    p = prints.where("sz > 0").withColumn("bar_us", bucket("us", bar_s))
    into = F.col("us") - F.col("bar_us")
    p = p.groupBy("instrument", "bar_us", F.least(F.floor(into / width), F.lit(slices - 1)).cast("int").alias("slice")).agg(
        F.sum("sz").alias("volume"), F.max("px_ticks").alias("high"), F.min("px_ticks").alias("low"), F.collect_set(F.floor(into / ((unit_s or bar_s) * SECOND))).alias("units")
    )
    b = p.groupBy("instrument", "bar_us").agg(
        F.sum("volume").cast("double").alias("volume"), (F.max("high") - F.min("low")).cast("double").alias("range"), F.size(F.array_distinct(F.flatten(F.collect_list("units")))).alias("units"),
        *(F.sum(F.when(F.col("slice") <= i, F.col("volume")).otherwise(0)).alias(f"_{i}") for i in range(slices)),
    )
    if unit_s:
        b = b.where(F.col("units") >= bar_s // unit_s)
    else:
        b = b.withColumn("_first", F.min("bar_us").over(W.partitionBy("instrument"))).where("bar_us > _first")
    day = F.floor(F.col("bar_us") / (86_400 * SECOND)).cast("long")
    state = b.groupBy("instrument", day.alias("day")).agg(F.collect_list(F.struct("volume", "range", F.array(*((F.col(f"_{i}") / F.col("volume")) for i in range(slices))).alias("done"))).alias("bars"))
    days = prints.select("instrument", F.floor(F.col("us") / (86_400 * SECOND)).cast("long").alias("day")).distinct()
    before = W.partitionBy("instrument").orderBy("day").rangeBetween(-back_days, -1)
    d = days.join(state, ["instrument", "day"], "left").withColumn("seen", F.flatten(F.collect_list("bars").over(before)))
    of = lambda f: _median(F.array_sort(F.transform("seen", f)))
    share = lambda i: of(lambda x: F.get(x["done"], F.lit(i)))
    shares = F.array(*(share(i) for i in range(slices)))
    n = F.size("seen")
    return d.select("instrument", "day", F.when(n >= least, shares).alias("shares"), of(lambda x: x["volume"]).alias("normal_volume"), of(lambda x: x["range"]).alias("normal_range"), n.alias("samples"))


def volume_pace(prints: DataFrame, bar_s: int, step_s: int, curve: DataFrame, heavy: float = 1.5, quiet: float = 0.6, wide: float = 0.8) -> DataFrame:
    """After each step of time in which a bar has prints: volume done, its share of a bar by the day's curve (even where that has no shares), pace against what is
    normal by then, where the volume will end, range, whether that is wide for the time (by the root of it), and the state: paid_for, absorbed, thin, no_fuel or
    unknown (without a normal volume, or neither heavy, quiet nor wide)."""
    p = prints.where("sz > 0").groupBy("instrument", bucket("us", bar_s).alias("bar_us"), bucket("us", step_s).alias("at_us")).agg(F.sum("sz").alias("volume"), F.max("px_ticks").alias("high"), F.min("px_ticks").alias("low"))
    run = W.partitionBy("instrument", "bar_us").orderBy("at_us").rowsBetween(W.unboundedPreceding, 0)
    p = p.select("instrument", "bar_us", "at_us", F.sum("volume").over(run).alias("done"), (F.max("high").over(run) - F.min("low").over(run)).alias("range"))
    p = p.withColumns({"day": F.floor(F.col("bar_us") / (86_400 * SECOND)).cast("long"), "frac": F.least((F.col("at_us") + step_s * SECOND - F.col("bar_us")) / (bar_s * SECOND), F.lit(1.0))})
    p = p.join(curve, ["instrument", "day"])
    pos = F.col("frac") * F.size("shares")
    i = F.floor(pos).cast("int")
    lo, hi = F.when(i > 0, F.get("shares", i - 1)).otherwise(0.0), F.get("shares", i)
    learned = F.when(i >= F.size("shares"), 1.0).otherwise(lo + (hi - lo) * (pos - i))
    p = p.withColumn("share", F.greatest(F.lit(LEAST_SHARE), F.when(F.col("shares").isNotNull(), learned).otherwise(F.col("frac"))))
    known = F.coalesce(F.col("normal_volume") > 0, F.lit(False))
    p = p.withColumns({
        "learned": F.col("shares").isNotNull(), "pace": F.when(known, F.col("done") / (F.col("normal_volume") * F.col("share"))), "projected": F.col("done") / F.col("share"),
        "wide": F.coalesce((F.col("normal_range") > 0) & (F.col("range") >= F.col("normal_range") * F.sqrt(F.greatest(F.col("frac"), F.lit(0.02))) * wide), F.lit(False)),
    })
    fast, slow = F.col("pace") >= heavy, F.col("pace") <= quiet
    state = F.when(F.col("pace").isNull(), "unknown").when(fast, F.when(F.col("wide"), "paid_for").otherwise("absorbed")).when(slow, F.when(F.col("wide"), "thin").otherwise("no_fuel")).when(F.col("wide"), "paid_for").otherwise("unknown")
    return p.select("instrument", "bar_us", "at_us", "done", "range", "share", "learned", "samples", "pace", "projected", "wide", (F.col("range") / F.col("pace")).alias("efficiency"), state.alias("state"))


def clock_windows(touches: DataFrame, prints: DataFrame, seconds: int) -> DataFrame:
    """Books and prints on the same clock: by instrument and window the candle of mids (twice their price, as mid2_) and of prints (last_), net OFI and CVD, counts, volume of unknown
    side, the direction of each, whether mid, OFI and CVD agree, and, where OFI's direction is another than that of the last window that had one, flip and
    whether CVD confirms it. Touches without both prices and sizes or crossed don't count; the first touch of a window is measured against the last of the one before."""
    t = touches.where("bid_px > 0 AND ask_px > 0 AND bid_sz > 0 AND ask_sz > 0 AND bid_px < ask_px")
    t = level1_ofi(t).select("instrument", "us", "seq", F.lit(True).alias("book"), (F.col("bid_px") + F.col("ask_px")).alias("px"), F.coalesce("ofi", F.lit(0)).cast("long").alias("ofi"), F.lit(None).cast("long").alias("sz"), F.lit(None).cast("string").alias("side"))
    p = prints.select("instrument", "us", "seq", F.lit(False).alias("book"), F.col("px_ticks").alias("px"), F.lit(0).cast("long").alias("ofi"), F.greatest("sz", F.lit(0)).cast("long").alias("sz"), "side")
    at = F.struct("us", "seq")
    only = lambda book: F.when(F.col("book") == book, F.col("px"))
    when = lambda book: F.when(F.col("book") == book, at)
    of = lambda s: F.sum(F.when(~F.col("book") & s, F.col("sz")).otherwise(0))
    candle = lambda book, a: [F.min_by("px", when(book)).alias(f"{a}open"), F.max(only(book)).alias(f"{a}high"), F.min(only(book)).alias(f"{a}low"), F.max_by("px", when(book)).alias(f"{a}close")]
    known = F.coalesce(F.col("side").isin("A", "B"), F.lit(False))
    w = t.union(p).groupBy("instrument", bucket("us", seconds).alias("start_us")).agg(
        *candle(True, "mid2_"), *candle(False, "last_"), F.sum("ofi").alias("ofi"), (of(F.col("side") == "B") - of(F.col("side") == "A")).alias("cvd"), F.count_if("book").alias("books"),
        F.count_if(~F.col("book")).alias("trades"), F.count_if(~F.col("book") & ~known & (F.col("sz") > 0)).alias("unknown"), of(~known).alias("unknown_sz"),
    )
    way = lambda d: F.when(d > 0, "up").when(d < 0, "down").otherwise("flat")
    w = w.withColumns({"mid_dir": way(F.col("mid2_close") - F.col("mid2_open")), "last_dir": way(F.col("last_close") - F.col("last_open")), "ofi_dir": way(F.col("ofi")), "cvd_dir": way(F.col("cvd"))})
    before = F.last(F.when(F.col("ofi_dir") != "flat", F.col("ofi_dir")), ignorenulls=True).over(W.partitionBy("instrument").orderBy("start_us").rowsBetween(W.unboundedPreceding, -1))
    w = w.withColumns({"agree": (F.col("mid_dir") != "flat") & (F.col("mid_dir") == F.col("ofi_dir")) & (F.col("mid_dir") == F.col("cvd_dir")), "flip": F.coalesce((F.col("ofi_dir") != "flat") & (F.col("ofi_dir") != before), F.lit(False))})
    return w.withColumn("confirmed", F.col("flip") & (F.col("cvd_dir") == F.col("ofi_dir")))


def window_summary(windows: DataFrame) -> DataFrame:
    """By instrument: windows, those whose mid moved, those that agree and their share, flips, confirmed flips, flips a window."""
    g = windows.groupBy("instrument").agg(F.count("*").alias("windows"), F.count_if(F.col("mid_dir") != "flat").alias("decided"), F.count_if("agree").alias("agreed"), F.count_if("flip").alias("flips"), F.count_if("confirmed").alias("confirmed"), F.sum("unknown").alias("unknown"), F.sum("trades").alias("trades"))
    return g.withColumns({"agree_share": F.coalesce(F.try_divide("agreed", "decided"), F.lit(0.0)), "flips_per_window": F.col("flips") / F.col("windows")})


def shapes(bars: DataFrame, heavy: float = 1.5, quiet: float = 0.6, low: float = 0.5, high: float = 2.0, back: float = 0.35, key: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """bars with shape, lean (buy, sell or null) and provisional: what a bar is by the first of these that holds. It traded through a reference and is back; it reached
    one and turned; heavy volume that moves price little (exhaustion where it has gone far, else absorption); it goes against the side of the bar before
    (reversal); price goes further than its volume moves it (expansion); it goes with those who cross (continuation); little happens (consolidation).

    bars: key, bar_us, measured, who (buyers, sellers or else), move, wide, position (of the close in the range, 0 to 1), pace (of volume; null: not known), impact (move for
    its volume against what is normal; null: not known), through (above, below or null: the reference that it is back from), at_above (whether the reference that it is at is above; null: at none).

    Only a reversal reads the bar before, and that bar's side may come of a reversal. Bars whose side the one before can't change begin a run; within a run, a bar has
    a side only while each bar has gone against the one before it. So sides are two running windows, and no bar waits for another's result."""
    both = lambda *c: F.coalesce(reduce(and_, c), F.lit(False))
    wide = F.coalesce(F.col("wide"), F.lit(False))
    now = F.when(F.col("move") > 0, 1).when(F.col("move") < 0, -1)
    away = F.when(F.col("who") == "buyers", -1).when(F.col("who") == "sellers", 1)
    stuck = both(F.col("pace") >= heavy, F.col("impact") < low)
    fixed = (
        F.when(~F.coalesce(F.col("measured"), F.lit(False)), "unknown").when(F.col("through") == "above", "failed_breakout").when(F.col("through") == "below", "failed_breakdown")
        .when(both(wide, F.col("at_above"), F.col("position") <= back), "rejection").when(both(wide, ~F.col("at_above"), F.col("position") >= 1 - back), "rejection")
        .when(stuck & wide, "exhaustion").when(stuck, "absorption")
    )
    side = F.when(F.col("_fixed") == "failed_breakout", -1).when(F.col("_fixed") == "failed_breakdown", 1).when(F.col("_fixed") == "rejection", F.when(F.col("at_above"), -1).otherwise(1)).when(F.col("_fixed").isin("exhaustion", "absorption"), away)
    paid = both(wide, F.when(F.col("who") == "buyers", F.col("move") > 0).when(F.col("who") == "sellers", F.col("move") < 0))
    plain = F.when(both(F.col("impact") > high, wide), "expansion").when(paid, "continuation").when(both(F.col("pace") <= quiet) | ~wide, "consolidation").otherwise("unknown")
    b = bars.withColumns({"_fixed": fixed, "_now": now}).withColumns({"_own": side, "_plain": plain})
    lone = F.when(F.col("_fixed").isNotNull(), F.col("_own")).when(F.col("_plain").isin("expansion", "continuation"), F.col("_now"))
    b = b.withColumns({"_lone": lone, "_begins": F.col("_fixed").isNotNull() | F.col("_now").isNull() | lone.isNotNull()})
    order = W.partitionBy(*key).orderBy("bar_us")
    b = b.withColumns({"_run": F.sum(F.col("_begins").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)), "_way": F.when(F.col("_begins"), F.col("_lone")).otherwise(F.col("_now"))})
    turned = F.coalesce(F.col("_way") == -F.lag("_way").over(order), F.lit(False))
    b = b.withColumn("_turned", turned)
    inside = W.partitionBy(*key, "_run").orderBy("bar_us").rowsBetween(W.unboundedPreceding, 0)
    held = F.max((~F.col("_begins") & ~F.col("_turned")).cast("int")).over(inside) == 0
    b = b.withColumn("_side", F.when(F.col("_begins"), F.col("_lone")).when(held, F.col("_now")))
    before = F.lag("_side").over(order)
    b = b.withColumn("_reversal", F.coalesce(F.col("_fixed").isNull() & (before == -F.col("_now")), F.lit(False)))
    shape = F.coalesce("_fixed", F.when(F.col("_reversal"), "reversal").otherwise(F.col("_plain")))
    b = b.withColumn("shape", shape)
    out = b.withColumns({"lean": F.when(F.col("_side") > 0, "buy").when(F.col("_side") < 0, "sell"), "provisional": F.col("shape").isin("failed_breakout", "failed_breakdown", "exhaustion", "reversal").cast("int")})
    return out.drop("_fixed", "_now", "_own", "_plain", "_lone", "_begins", "_run", "_way", "_turned", "_side", "_reversal")
