"""Bar builders: by time, prints, volume; sessions, resampling, rolling votes, VPIN.

All are native. Prints carry (instrument, us, seq, px, sz, side); seq is unique and breaks ties of time. Bars that only need
their key are hash aggregates with partial sums (min_by/max_by give open and close without a sort); what needs the order of prints uses
one window per instrument, or per instrument and session where the operator starts anew with each session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SECOND = 1_000_000


def bucket(us: str, seconds: int) -> Column:
    """The left edge of a time bucket, in epoch microseconds."""
    return F.floor(F.col(us) / (seconds * SECOND)).cast("long") * (seconds * SECOND)


def running_sum(prints: DataFrame, value: str, out: str, key: list[str], day_seconds: int = 86_400) -> DataFrame:
    """prints with the running sum of value by key in the order of seq, this row included. It runs within a day and is shifted by the totals of
    the days before, so a task holds one day of a key, not its whole history. us must not fall as seq rises."""
    day = bucket("us", day_seconds)
    p = prints.withColumn("_day", day)
    days = p.groupBy(*key, "_day").agg(F.sum(value).alias("_t"))
    shift = F.coalesce(F.sum("_t").over(W.partitionBy(*key).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    days = days.select(*key, "_day", shift.alias("_shift"))
    inside = F.sum(value).over(W.partitionBy(*key, "_day").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    return p.withColumn("_in", inside).join(days, [*key, "_day"]).withColumn(out, F.col("_in") + F.col("_shift")).drop("_in", "_day", "_shift")


def _ohlc(px: str = "px_ticks") -> list[Column]:
    at = F.struct("us", "seq")
    return [F.min_by(px, at).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, at).alias("close")]


def _flow() -> list[Column]:
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("sz")).otherwise(0))
    return [F.sum("sz").alias("volume"), side("B").alias("buy"), side("A").alias("sell"), (side("B") - side("A")).alias("delta"), F.count("*").alias("prints")]


def time_bars(prints: DataFrame, seconds: int) -> DataFrame:
    """OHLC, volume, buy and sell volume, delta and prints by instrument and time; empty buckets give no bar. Prints of an
    unknown aggressor count in the volume alone."""
    return prints.groupBy("instrument", bucket("us", seconds).alias("bar_us")).agg(*_ohlc(), *_flow())


def resample(bars: DataFrame, seconds: int) -> DataFrame:
    """Coarser time bars from finer ones."""
    at = bucket("bar_us", seconds)
    return bars.groupBy("instrument", at.alias("at")).agg(F.min_by("open", "bar_us").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_us").alias("close"), F.sum("volume").alias("volume"), F.sum("delta").alias("delta")).withColumnRenamed("at", "bar_us")


def cumulative_delta(bars: DataFrame, window: int) -> DataFrame:
    """bars with cvd, the running delta, and z, its rolling z-score (sample deviation, current row included, full windows only)."""
    run = W.partitionBy("instrument").orderBy("bar_us")
    bars = bars.withColumn("cvd", F.sum("delta").over(run.rowsBetween(W.unboundedPreceding, 0)))
    last = run.rowsBetween(-window + 1, 0)
    mean, sd, n = F.avg("cvd").over(last), F.stddev_samp("cvd").over(last), F.count("cvd").over(last)
    return bars.withColumn("z", F.when((n == window) & (sd > 0), (F.col("cvd") - mean) / sd))


def tick_bars(prints: DataFrame, per_bar: int) -> DataFrame:
    """Bars of per_bar prints; votes are prints above less prints below the print before."""
    order = W.partitionBy("instrument").orderBy("seq")
    p = running_sum(prints.withColumn("_one", F.lit(1)), "_one", "_n", ["instrument"]).withColumn("bar", F.floor((F.col("_n") - 1) / per_bar)).withColumn("step", F.signum(F.col("px_ticks") - F.lag("px_ticks").over(order)))
    votes = [F.count_if(F.col("step") > 0).alias("up_votes"), F.count_if(F.col("step") < 0).alias("down_votes"), F.count_if(F.col("side") == "N").alias("unknown")]
    return p.groupBy("instrument", "bar").agg(*_ohlc(), *_flow(), *votes, F.min("us").alias("open_us"), F.max("us").alias("close_us"))


def volume_pieces(prints: DataFrame, size: int, key: list[str] | None = None) -> DataFrame:
    """prints with bar and piece: each print is split where a bar of `size` contracts is full."""
    p = running_sum(prints.where("sz > 0"), "sz", "c1", key or ["instrument"]).withColumn("c0", F.col("c1") - F.col("sz"))
    p = p.withColumn("bar", F.explode(F.expr(f"sequence(c0 div {size}, (c1 - 1) div {size})")))
    return p.withColumn("piece", F.least(F.col("c1"), (F.col("bar") + 1) * size) - F.greatest(F.col("c0"), F.col("bar") * size))


def volume_bars(prints: DataFrame, size: int) -> DataFrame:
    """Bars of `size` contracts, prints split across their ends; the last bar may be part full."""
    p = volume_pieces(prints, size).withColumn("sz", F.col("piece"))
    return p.groupBy("instrument", "bar").agg(*_ohlc(), *_flow())


def vpin(prints: DataFrame, size: int, window: int) -> DataFrame:
    """Share of one-sided volume over the last `window` full buckets of `size` contracts with a known aggressor."""
    p = volume_pieces(prints.where(F.col("side") != "N"), size)
    b = p.groupBy("instrument", "bar").agg(F.sum("piece").alias("volume"), F.abs(F.sum(F.when(F.col("side") == "B", F.col("piece")).otherwise(-F.col("piece")))).alias("gap"))
    last = W.partitionBy("instrument").orderBy("bar").rowsBetween(-window + 1, 0)
    return b.where(F.col("volume") == size).withColumn("vpin", F.when(F.count("*").over(last) == window, F.avg(F.col("gap") / size).over(last)))


def rolling_votes(prints: DataFrame, window: int, warm: int, band: float) -> DataFrame:
    """Direction of the last `window` prints: up, down or flat by the share of up among changed prices; null until warm."""
    order = W.partitionBy("instrument").orderBy("seq")
    p = prints.withColumn("step", F.signum(F.col("px_ticks") - F.lag("px_ticks").over(order)))
    last = order.rowsBetween(-window + 1, 0)
    up, down = F.count_if(F.col("step") > 0).over(last), F.count_if(F.col("step") < 0).over(last)
    p = p.withColumns({"up": up, "down": down})
    share = F.try_divide(F.col("up"), F.col("up") + F.col("down"))
    way = F.when(share > 0.5 + band, "up").when(share < 0.5 - band, "down").otherwise("flat")
    return p.select("instrument", "seq", "up", "down", F.when(F.col("up") + F.col("down") >= warm, way).alias("direction"))


def sessions(bars: DataFrame, day_seconds: int, gap_ticks: int) -> DataFrame:
    """One row per instrument and trade date, suspect where it opens more than gap_ticks from the close before."""
    s = resample(bars, day_seconds)
    before = F.lag("close").over(W.partitionBy("instrument").orderBy("bar_us"))
    return s.withColumn("gap", F.col("open") - before).withColumn("suspect", F.coalesce(F.abs("gap") > gap_ticks, F.lit(False)))


def book_cvd_bars(touches: DataFrame, seconds: int, window: int) -> DataFrame:
    """Per bar the open-to-close path of book CVD, which starts at 0 in each bar, and its close against the `window` bars before."""
    order = W.partitionBy("instrument").orderBy("seq")
    same = (F.col("bid_px") == F.lag("bid_px").over(order)) & (F.col("ask_px") == F.lag("ask_px").over(order))
    step = F.when(same, (F.col("bid_sz") - F.lag("bid_sz").over(order)) - (F.col("ask_sz") - F.lag("ask_sz").over(order))).otherwise(0)
    t = touches.withColumn("step", step).withColumn("bar_us", bucket("us", seconds))
    t = t.withColumn("cvd", F.sum("step").over(W.partitionBy("instrument", "bar_us").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)))
    b = t.groupBy("instrument", "bar_us").agg(F.max("cvd").alias("high"), F.min("cvd").alias("low"), F.max_by("cvd", "seq").alias("close"))
    before = W.partitionBy("instrument").orderBy("bar_us").rowsBetween(-window, -1)
    mean, sd, n = F.avg("close").over(before), F.stddev_samp("close").over(before), F.count("close").over(before)
    return b.withColumn("z", F.when((n == window) & (sd > 0), (F.col("close") - mean) / sd))


def gaps(bars: DataFrame, seconds: int) -> DataFrame:
    """Missing bars by instrument, and the median distance of bars."""
    d = F.col("bar_us") - F.lag("bar_us").over(W.partitionBy("instrument").orderBy("bar_us"))
    b = bars.withColumn("d", d)
    missing = F.greatest(F.bround(F.col("d") / (seconds * SECOND)) - 1, F.lit(0))
    return b.groupBy("instrument").agg(F.sum(missing).cast("long").alias("missing"), F.percentile("d", F.lit(0.5)).alias("interval_us"), F.count("*").alias("bars"))


def typical(bars: DataFrame, back: int, least: int) -> DataFrame:
    """Median absolute move and volume of the `back` bars before, from `least` bars on."""
    before = W.partitionBy("instrument").orderBy("bar_us").rowsBetween(-back, -1)
    full = F.count("*").over(before) >= least
    b = bars.withColumn("move", F.abs(F.col("close") - F.col("open")))
    return b.select("instrument", "bar_us", F.when(full, F.percentile("move", F.lit(0.5)).over(before)).alias("typical_move"), F.when(full, F.percentile("volume", F.lit(0.5)).over(before)).alias("typical_volume"))
