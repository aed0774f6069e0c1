"""Does it beat chance: lifts, bands, placebos, block bootstrap, permutation, calibration, lead and lag, walk-forward tuning.

Resampling never touches the rows again: they are first summed to blocks, and the draws, one row per (draw, block), join the sums on the block's
number. Draws come from a 31-bit congruential generator, so any engine repeats them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import Z95, corr
from ..sources.scratch import held
from .outcomes import first_touch, lcg


def lift(rows: DataFrame, by: list[Column], touched: str = "touched", expected: str = "expected") -> DataFrame:
    """Observed over expected, a ratio of sums."""
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(touched).cast("int")).alias("observed"), F.sum(expected).alias("expected"))
    return g.withColumn("lift", F.try_divide("observed", "expected"))


def bands(x: Column, edges: list[float]) -> Column:
    """The lower edge of the band [lo, hi) that holds x; null outside."""
    out = F.lit(None).cast("double")
    for lo, hi in zip(edges, edges[1:]):
        out = F.when((x >= lo) & (x < hi), F.lit(float(lo))).otherwise(out)
    return out


def resampled_blocks(sums: DataFrame, by: list[str], block: str, draws: int, seed: Column) -> DataFrame:
    """For each group and draw the sums of num, den over as many blocks as the group has, drawn with replacement: by, draw, num, den. sums: by, block, num, den."""
    w = W.partitionBy(*by)
    sums = sums.withColumns({"_i": F.row_number().over(w.orderBy(block)) - 1, "_n": F.count("*").over(w)})
    slots = sums.where("_i = 0").select(*by, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))).alias("draw")).select(*by, "_n", "draw", F.explode(F.expr("sequence(0L, _n - 1)")).alias("_slot"))
    slots = slots.withColumn("_i", F.floor(lcg(lcg(F.col("draw") * 7919 + F.col("_slot") * 104729 + seed)) / 2147483648 * F.col("_n")).cast("int"))
    return slots.select(*by, "draw", "_i").join(sums.select(*by, "_i", "num", "den"), [*by, "_i"]).groupBy(*by, "draw").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))


def block_bootstrap(rows: DataFrame, block: str, num: str, den: str, draws: int, seed: int) -> DataFrame:
    """The ratio sum(num) / sum(den) with the 2.5% and 97.5% points of `draws` resamplings of whole blocks."""
    sums = rows.groupBy(F.lit(0).alias("_g"), block).agg(F.sum(num).alias("num"), F.sum(den).alias("den"))
    r = resampled_blocks(sums, ["_g"], block, draws, F.lit(seed)).withColumn("ratio", F.col("num") / F.col("den"))
    ends = r.groupBy("_g").agg(F.percentile("ratio", F.lit(0.025)).alias("lo"), F.percentile("ratio", F.lit(0.975)).alias("hi"), F.count("*").alias("draws"))
    return sums.groupBy("_g").agg((F.sum("num") / F.sum("den")).alias("ratio")).join(ends, "_g").drop("_g")


def permutation(rows: DataFrame, value: str, sign: str, key: str, draws: int, seed: int) -> DataFrame:
    """The mean of value * sign against `draws` random sign flips: the share of draws at least as large. One pass with a sum for each draw; no row is copied."""
    flip = lambda d: F.when(lcg(lcg(F.col(key) * 31 + F.lit(d * 65537) + seed)) % 1000 < 500, F.col(value)).otherwise(-F.col(value))
    x = rows.select(value, sign, key).where(F.col(key).isNotNull())
    d = x.agg(F.avg(F.col(value) * F.col(sign)).alias("mean"), *(F.avg(flip(i)).alias(f"d{i}") for i in range(draws))).where("mean is not null")
    hits = sum((F.when(F.col(f"d{i}") >= F.col("mean"), 1).otherwise(0) for i in range(draws)), F.lit(0))
    return d.select("mean", (hits / draws).alias("p"), F.lit(draws).cast("long").alias("draws"))


def calibration(rows: DataFrame, p: str, y: str, bins: int) -> DataFrame:
    """By bin of predicted probability: count, mean prediction, observed rate."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(y).cast("int")).alias("observed"))


def pit_histogram(rows: DataFrame, u: str, bins: int) -> DataFrame:
    """Probability integral transform: counts by bin, empty bins included, and each one's deviation from uniform."""
    counts = rows.groupBy(F.least(F.floor(F.col(u) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(bins).select(F.col("id").alias("bin"))
    h = every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))
    return h.withColumn("excess", F.try_divide(F.col("n") * bins, total) - 1)


def lead_lag(series: DataFrame, a: str, b: str, order: str, lags: int) -> DataFrame:
    """Correlation of a with b shifted by each lag from -lags to lags, within an instrument."""
    w = W.partitionBy("instrument").orderBy(order)
    shifted = lambda k: F.lag(b, k).over(w) if k >= 0 else F.lead(b, -k).over(w)
    x = series.select("instrument", a, *(shifted(k).alias(f"b{k + lags}") for k in range(-lags, lags + 1)))
    row = x.agg(*(corr(a, f"b{k + lags}").alias(f"c{k + lags}") for k in range(-lags, lags + 1)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"c{k + lags}").alias("corr")) for k in range(-lags, lags + 1)))).alias("x")).select("x.lag", "x.corr")


def walk_forward(trades: DataFrame, order: list[str], value: str, score: str, thresholds: list[float], share: float, least: int) -> DataFrame:
    """For each threshold on score: trades and mean value in the first `share` of the time and in the rest; the threshold that is best in the
    first part, of those that keep `least` trades there, is marked chosen."""
    # the rank of a time is the number of trades before it: sums by time, so no task orders the trades themselves
    times = trades.groupBy(*order).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    times = times.withColumn("_before", before).withColumn("_all", F.sum("_n").over(W.partitionBy()))
    part = F.when(F.coalesce(F.try_divide("_before", F.col("_all") - 1), F.lit(0.0)) < share, "fit").otherwise("test")
    trades = trades.join(times.withColumn("part", part).select(*order, "part"), order)
    t = trades.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where(F.col(score) >= F.col("threshold"))
    g = t.groupBy("threshold").agg(*(f(F.when(F.col("part") == p, F.col(value))).alias(f"{p}_{n}") for p in ("fit", "test") for f, n in ((F.count, "n"), (F.avg, "mean"))))
    best = F.max(F.when(F.col("fit_n") >= least, F.struct("fit_mean", "threshold"))).over(W.partitionBy(F.lit(1)))
    return g.withColumn("chosen", F.coalesce(best["threshold"] == F.col("threshold"), F.lit(False)))


def mean_table(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, deviation and 95% interval of value by group."""
    g = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    e = F.lit(Z95) * F.col("sd") / F.sqrt("n")
    return g.withColumns({"lo": F.col("mean") - e, "hi": F.col("mean") + e})


def after_touch(events: DataFrame, prints: DataFrame, horizon_us: int, follow_us: int) -> DataFrame:
    """event_id, move: of the events whose level is touched, how far price is beyond it, in the direction that led there, at the last print of the
    follow_us after the touch. events: event_id, instrument, at_us, spot, level."""
    t = first_touch(events, prints, horizon_us).where("touched").select("event_id", "minutes")
    hit = events.join(t, "event_id").select("event_id", "instrument", "spot", "level", (F.col("at_us") + F.round(F.col("minutes") * 60e6).cast("long")).alias("at_us"))
    x = first_touch(hit, prints, follow_us).where("prints > 0")
    return x.select("event_id", ((F.col("last_px") - F.col("level")) * F.when(F.col("level") >= F.col("spot"), 1).otherwise(-1)).alias("move"))


def size_effect(rows: DataFrame, size: str, groups: int, draws: int, seed: int, least: int = 20, least_band: int = 10, least_blocks: int = 8) -> DataFrame:
    """The lift of touches by bands of size of equal numbers, each with its bootstrapped interval: whether bands differ is what is asked. rows: size, touched,
    expected, block. Fewer than `least` rows for each band give nothing, bands of fewer than least_band go, and there is no interval below `least_blocks` blocks."""
    rows = held(rows.select(size, "touched", "expected", "block"))
    cuts = rows.agg(*(F.percentile(size, F.lit(i / groups)).alias(f"c{i}") for i in range(groups)), F.count("*").alias("n")).first()
    known = [] if cuts["n"] < least * groups else [float(c) for c in cuts[:groups]]
    band = sum((F.when(F.col(size) >= c, 1).otherwise(0) for c in known), F.lit(-1))
    sums = rows.withColumn("band", band).where("band >= 0").groupBy("band", "block").agg(F.count("*").alias("n"), F.sum("touched").alias("num"), F.sum("expected").alias("den"))
    drawn = resampled_blocks(sums, ["band"], "block", draws, F.lit(seed) + F.col("band")).withColumn("ratio", F.col("num") / F.col("den"))
    ends = drawn.groupBy("band").agg(F.percentile("ratio", F.lit(0.025)).alias("lo"), F.percentile("ratio", F.lit(0.975)).alias("hi"))
    told = sums.groupBy("band").agg(F.sum("n").alias("n"), F.sum("num").alias("num"), F.sum("den").alias("den"), F.count("*").alias("blocks"))
    enough = lambda c: F.when(F.col("blocks") >= least_blocks, c)
    cut = F.element_at(F.array(*map(F.lit, known or [0.0])), F.col("band") + 1)
    return told.where(F.col("n") >= least_band).join(ends, "band").select(cut.alias("cut"), "n", (F.col("num") / F.col("n")).alias("observed"), (F.col("den") / F.col("n")).alias("expected"), (F.col("num") / F.col("den")).alias("lift"), enough(F.col("lo")).alias("lo"), enough(F.col("hi")).alias("hi"))
