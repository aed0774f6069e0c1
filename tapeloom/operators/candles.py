"""A candle read while it runs: signals from -1 to 1, their weighted mean as a lean, and what became of earlier candles that read alike.

A signal is null where its source says nothing, and then has no weight. signals() makes them from what was measured by the moment of the read, so any of
these columns may be null; score() weighs them; calibrated() sets each read beside the outcomes of the candles that had closed before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The weight of each signal; the edges of the bands of scores; reads before a rate of any band counts, and of the band itself.
WEIGHTS = {"flow": 1.0, "position": 0.8, "imbalance": 0.5, "absorption": 1.4, "price_action": 1.2, "vwap": 0.25, "structure": 1.0, "zone": 0.9, "magnet": 0.7}
BANDS = ((-1.01, -0.5, "strong down"), (-0.5, -0.15, "down"), (-0.15, 0.15, "flat"), (0.15, 0.5, "up"), (0.5, 1.01, "strong up"))
READY, OWN = 40, 10


def _beyond(x: Column, dead: float) -> Column:
    """x between -1 and 1, or 0 where it is not beyond `dead` either way."""
    return F.when(F.abs(x) > dead, F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))).when(x.isNotNull(), 0.0)


def signals(rows: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """rows with a struct `signals` of one number for each of `weights`.

    Read from: open, high, low, last; buy, sell; imbalance (of the book near the touch, -1 to 1); impact_ratio, impact_confident, aggressor_up and
    aggression (how far flow moves price against usual: below 0.5 is absorbed, above 2 is a thin book); pa (price action, -1 to 1); vwap, vwap_sd;
    trend ('up', 'down'); zone ('supply', 'demand': the zone that price is in) and zone_fresh; magnet_bps, magnet_notional.

    flow beyond 5 % counts by its share, but for nothing while it is absorbed, which then speaks against it; the place in the range beyond a tenth,
    and 0.4 of it while absorbed; the book beyond a tenth; stretch beyond two deviations of VWAP against the move; a zone against the way into it."""
    c, pushed = F.col, F.when(F.col("aggressor_up"), 1.0).otherwise(-1.0)
    sure = F.coalesce(c("impact_confident") & (c("aggression") > 0), F.lit(False))
    absorbed, thin = sure & (c("impact_ratio") < 0.5), sure & (c("impact_ratio") > 2.0)
    far = 2 * F.coalesce("vwap_sd", F.lit(0.0))
    pull = F.when((c("magnet_notional") > 0) & (c("magnet_bps") != 0), F.least(c("magnet_notional") / 5e7, F.lit(1.0)) * F.exp(-F.abs("magnet_bps") / 50.0))
    made = {
        "flow": F.when(c("buy") + c("sell") > 0, F.when(absorbed, 0.0).otherwise(_beyond((c("buy") - c("sell")) / (c("buy") + c("sell")), 0.05))),
        "position": F.when(c("high") > c("low"), _beyond(((c("last") - c("low")) / (c("high") - c("low")) - 0.5) * 2.0, 0.1) * F.when(absorbed, 0.4).otherwise(1.0)),
        "imbalance": _beyond(c("imbalance"), 0.1),
        "absorption": F.when(absorbed, -pushed * F.least(1.0 - F.greatest("impact_ratio", F.lit(0.0)), F.lit(1.0))).when(thin, pushed * F.least((c("impact_ratio") - 1.0) / 3.0, F.lit(1.0))),
        "price_action": F.when(c("pa") != 0, F.least(F.greatest(c("pa"), F.lit(-1.0)), F.lit(1.0))),
        "vwap": F.when((c("vwap") > 0) & (c("last") >= c("vwap") + far), F.when(c("last") > c("vwap"), -0.5).otherwise(0.5)).when((c("vwap") > 0) & (c("last") <= c("vwap") - far), 0.5),
        "structure": F.when(c("trend") == "up", 0.6).when(c("trend") == "down", -0.6),
        "zone": F.when(c("zone").isNotNull(), F.when(c("zone") == "supply", -1.0).otherwise(1.0) * F.when(c("zone_fresh"), 0.8).otherwise(0.35)),
        "magnet": F.when(pull > 0.05, pull * F.signum("magnet_bps")),
    }
    return rows.withColumn("signals", F.struct(*(made[n].cast("double").alias(n) for n in weights)))


def band(score: Column) -> Column:
    out = F.lit("flat")
    for lo, hi, name in BANDS:
        out = F.when((score >= lo) & (score < hi), name).otherwise(out)
    return out


def score(rows: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """rows with score (weighted mean of the signals that are there; 0 without any), lean (beyond 0.15), agreement (the share of the signals with a side that
    have the lean's; 0 while flat), confidence (the root of elapsed times at least 0.3 of agreement times |score| up to a half) and band. rows hold signals and elapsed (0 to 1)."""
    total, weighed, up, down = F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0)
    for n, w in weights.items():
        x = F.col(f"signals.{n}")
        total, weighed = total + F.when(x.isNotNull(), w).otherwise(0.0), weighed + F.coalesce(x * w, F.lit(0.0))
        up, down = up + F.coalesce((x > 0).cast("int"), F.lit(0)), down + F.coalesce((x < 0).cast("int"), F.lit(0))
    r = rows.withColumn("score", F.when(total > 0, weighed / total).otherwise(0.0))
    lean = F.when(F.col("score") > 0.15, "up").when(F.col("score") < -0.15, "down").otherwise("flat")
    r = r.withColumns({"lean": lean, "band": band(F.col("score"))})
    same = F.when(F.col("lean") == "up", up).when(F.col("lean") == "down", down)
    r = r.withColumn("agreement", F.coalesce(F.try_divide(same, up + down), F.lit(0.0)))
    return r.withColumn("confidence", F.sqrt("elapsed") * F.greatest("agreement", F.lit(0.3)) * F.least(F.abs("score") / 0.5, F.lit(1.0)))


def calibration(reads: DataFrame) -> DataFrame:
    """By band of scores: candles read and the share that closed up; every band is there, those without a candle with a null rate. reads: band, up (null: still open, not counted)."""
    every = reads.sparkSession.createDataFrame([(n,) for *_, n in BANDS], "band string")
    g = reads.where("up is not null").groupBy("band").agg(F.count("*").alias("n"), F.avg(F.col("up").cast("int")).alias("up_rate"))
    return every.join(F.broadcast(g), "band", "left").select("band", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "up_rate")


def calibrated(reads: DataFrame, key: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Each read with the candles of its key that had closed before its own, those in its band and the share of these that closed up. rate is null until READY
    candles, OWN of them in the band, are known: a lean isn't a probability before. One read a candle; reads: key, bar_us, band, up."""
    before = W.partitionBy(*key).orderBy("bar_us").rowsBetween(W.unboundedPreceding, -1)
    own = W.partitionBy(*key, "band").orderBy("bar_us").rowsBetween(W.unboundedPreceding, -1)
    r = reads.withColumns({"samples": F.count("up").over(before), "in_band": F.count("up").over(own), "went_up": F.count_if("up").over(own)})
    known = (F.col("samples") >= READY) & (F.col("in_band") >= OWN)
    return r.withColumn("rate", F.when(known, F.col("went_up") / F.col("in_band"))).drop("went_up")
