"""Who is winning: the side that gets the price it wants, on each time frame, and the frames set against each other.

A reading is one row (instrument, at_us, seconds) with open, high, low, last, buy, sell, trades, measured, span, elapsed_s, typical_bps and
typical_notional (null: not learned), coverage and seeded (the open was seen). measured() counts buys and sells from prints at each step of a
running bar; inferred() splits closed bars by where they closed in their range. judged() reads both alike, in column expressions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import held
from .bars import SECOND, bucket

# One-sided from this share on; a usual move in basis points, of a bar of so many seconds, where none is learned; the share of a
# usual move that is still flat, and the least of it; the share of usual business that presses; the fewest prints; bars to learn from, and the fewest.
BALANCED, PRIOR_BPS, PRIOR_S, FLAT_SHARE, FLAT_BPS, PRESSING, FEWEST = 0.10, 25.0, 14_400, 0.35, 0.05, 0.40, 3
BACK, LEAST = 20, 4
# Bars of at most this many seconds are read one at a time.
ALONE_S = 300


def usual(key: tuple[str, ...], skip: int = 1) -> dict[str, Column]:
    """Median |move| in basis points and notional of the BACK bars before, the last `skip` - 1 of them left out; null below LEAST bars."""
    w = W.partitionBy(*key).orderBy("bar_us").rowsBetween(-BACK - skip + 1, -skip)
    bps = F.when(F.col("open") > 0, F.abs(F.col("close") - F.col("open")) / F.col("open") * 10_000.0)
    notional = F.when(F.col("open") > 0, F.when(F.col("close") > 0, F.col("volume") * F.col("close")).otherwise(F.col("volume")))
    enough = F.count(bps).over(w) >= LEAST
    half = F.lit(0.5)
    return {"typical_bps": F.when(enough, F.percentile(bps, half).over(w)), "typical_notional": F.when(enough, F.percentile(notional, half).over(w))}


def measured(prints: DataFrame, frames: list[int], step: int) -> DataFrame:
    """A reading at the end of each step with a print, for each frame of `frames` (seconds, multiples of step). Prints are summed by step once and held; a
    frame runs over the steps of its bar. Prints of an unknown aggressor count as trades alone. An instrument's first bar of a frame isn't seeded."""
    at, side = F.struct("us", "seq"), lambda s: F.sum(F.when(F.col("side") == s, F.col("px_ticks") * F.col("sz")).otherwise(0))
    s = prints.groupBy("instrument", bucket("us", step).alias("at_us")).agg(
        F.min_by("px_ticks", at).alias("o"), F.max("px_ticks").alias("h"), F.min("px_ticks").alias("l"), F.max_by("px_ticks", at).alias("last"), F.sum("sz").alias("v"), side("B").alias("b"), side("A").alias("a"), F.count("*").alias("n")
    )
    s = held(s).withColumn("seconds", F.explode(F.array(*(F.lit(f).cast("long") for f in frames))))
    s = s.withColumn("bar_us", F.floor(F.col("at_us") / (F.col("seconds") * SECOND)).cast("long") * F.col("seconds") * SECOND)
    bar = ["instrument", "seconds", "bar_us"]
    bars = s.groupBy(*bar).agg(F.min_by("o", "at_us").alias("open"), F.max_by("last", "at_us").alias("close"), F.sum("v").alias("volume"))
    learned = bars.select(*bar, *(c.alias(n) for n, c in usual(("instrument", "seconds")).items()), F.lag("bar_us").over(W.partitionBy("instrument", "seconds").orderBy("bar_us")).isNotNull().alias("seeded"))
    so_far = W.partitionBy(*bar).orderBy("at_us").rowsBetween(W.unboundedPreceding, 0)
    run = s.select(
        *bar, "at_us", "last", F.first("o").over(so_far).alias("open"), F.max("h").over(so_far).alias("high"), F.min("l").over(so_far).alias("low"), F.sum("b").over(so_far).alias("buy"), F.sum("a").over(so_far).alias("sell"), F.sum("n").over(so_far).alias("trades"),
    )
    elapsed = (F.col("at_us") + step * SECOND - F.col("bar_us")) / SECOND
    return run.join(learned, bar).withColumns({"elapsed_s": elapsed, "measured": F.lit(True), "span": F.lit(1).cast("long"), "coverage": F.lit(1.0)}).drop("bar_us")


def inferred(bars: DataFrame, seconds: int, span: int | None = None) -> DataFrame:
    """A reading at each closed bar over the last `span` bars (three, one for bars of at most ALONE_S seconds), the split taken from where each of them
    closed in its range; what is usual comes from the bars before these."""
    span = span or (1 if seconds <= ALONE_S else 3)
    w = W.partitionBy("instrument").orderBy("bar_us").rowsBetween(-span + 1, 0)
    share = F.coalesce(F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5))
    notional = F.when(F.col("close") > 0, F.col("volume") * F.col("close")).otherwise(F.col("volume"))
    return bars.select(
        "instrument", F.col("bar_us").alias("at_us"), F.lit(seconds).cast("long").alias("seconds"), F.first("open").over(w).alias("open"), F.max("high").over(w).alias("high"), F.min("low").over(w).alias("low"), F.col("close").alias("last"),
        F.sum(notional * share).over(w).alias("buy"), F.sum(notional * (1 - share)).over(w).alias("sell"), F.sum("prints").over(w).alias("trades"), F.lit(False).alias("measured"), F.count("*").over(w).alias("span"),
        F.lit(float(seconds)).alias("elapsed_s"), *(c.alias(n) for n, c in usual(("instrument",), span).items()), F.lit(1.0).alias("coverage"), F.lit(True).alias("seeded"),
    )


def judged(readings: DataFrame) -> DataFrame:
    """Each reading with who wins it. An aggressor who gets the move that he pays for wins; who presses and isn't paid is absorbed and loses; without an
    aggressor the move decides. What is flat goes with the usual move of such bars and the root of the time run. A bar whose open wasn't seen, of too few
    prints, or narrow and quiet is forming: contested. strength is from 0 to 1, signed above 0 where buyers win.

    Nulls: a reading without buy and sell has no aggressor; one whose typical_bps or typical_notional is null stands on the priors (learned is false)."""
    c, span = F.col, F.greatest(F.col("span"), F.lit(1))
    r = readings.withColumns({
        "move_bps": F.when(c("open") > 0, (c("last") - c("open")) / c("open") * 10_000.0).otherwise(0.0), "range_bps": F.when(c("open") > 0, (c("high") - c("low")) / c("open") * 10_000.0).otherwise(0.0),
        "total": F.coalesce(c("buy") + c("sell"), F.lit(0)), "learned": F.coalesce(c("typical_bps") > 0, F.lit(False)),
        "share": F.least(F.lit(1.0), F.greatest(F.lit(0.02), (span - 1 + F.least(F.lit(1.0), c("elapsed_s") / c("seconds"))) / span)),
    })
    normal = F.when(c("learned"), c("typical_bps") * F.sqrt(span)).otherwise(PRIOR_BPS * F.sqrt(c("seconds") * span / PRIOR_S))
    few = c("measured") & (c("trades") < FEWEST)
    expected = c("typical_notional") * span * c("share")
    r = r.withColumns({
        "lean": F.coalesce(F.try_divide(c("buy") - c("sell"), c("total")), F.lit(0.0)), "flat_bps": F.greatest(F.lit(FLAT_BPS), normal * FLAT_SHARE * F.sqrt("share")),
        "pressing": ~few & F.when(c("typical_notional") > 0, c("total") >= PRESSING * expected).otherwise(c("total") > 0),
    })
    by = F.when(F.abs("lean") < BALANCED, 0).otherwise(F.signum("lean")).cast("int")
    r = r.withColumns({"by": by, "forming": ~c("seeded") | few | ((c("range_bps") < c("flat_bps")) & ~c("pressing"))})
    paid = c("by") * c("move_bps") > c("flat_bps")
    moved = F.when(F.abs("move_bps") >= c("flat_bps"), F.signum("move_bps")).otherwise(0)
    r = r.withColumns({
        "absorbing": ~c("forming") & (c("by") != 0) & c("pressing") & ~paid,
        "side": F.when(c("forming"), 0).when(c("by") == 0, moved).when(paid, c("by")).when(c("pressing"), -c("by")).otherwise(0).cast("int"),
    })
    large = F.when(c("learned"), c("typical_bps") * F.sqrt(span) * 2.0).otherwise(20.0)
    gone = F.least(F.abs("move_bps") / F.greatest(large, F.lit(FLAT_BPS)), F.lit(1.0))
    one_sided = F.least(F.abs("lean") / 0.6, F.lit(1.0))
    base = (one_sided * 0.5 + F.when(c("absorbing"), 1.0 - gone).otherwise(gone) * 0.5) * F.when(c("measured"), 1.0).otherwise(0.6)
    strength = F.when(c("forming"), 0.0).otherwise(F.floor(F.least(base * F.greatest("coverage", F.lit(0.25)), F.lit(1.0)) * 10_000 + 0.5) / 10_000)
    r = r.withColumn("strength", strength)
    name = F.when(c("side") > 0, "buyers").when(c("side") < 0, "sellers").otherwise("contested")
    aggressor = F.when(c("by") > 0, "buy").when(c("by") < 0, "sell").otherwise("balanced")
    return r.select("instrument", "at_us", "seconds", "move_bps", "lean", aggressor.alias("aggressor"), "flat_bps", "learned", "pressing", "forming", "absorbing", name.alias("winner"), "strength", (c("side") * c("strength")).alias("signed"))


def confronted(judged_: DataFrame, frames: list[int]) -> DataFrame:
    """The frames of an instant against each other, one hash aggregate by (instrument, at_us): the winners of the slowest and the fastest frame, and whose
    the instant is, each frame's signed strength weighing by the root of its length. shape: aligned (one side wins wherever one does), conflict (the
    slowest and the fastest belong to different sides), mixed, or single where there is one frame. Frames without a reading don't count."""
    g = judged_.groupBy("instrument", "at_us").agg(
        F.count("*").alias("readings"), F.max_by("winner", "seconds").alias("higher"), F.min_by("winner", "seconds").alias("lower"), F.bool_or(F.col("winner") == "buyers").alias("_b"), F.bool_or(F.col("winner") == "sellers").alias("_s"),
        *(F.max(F.when(F.col("seconds") == f, F.col("signed"))).alias(f"_{f}") for f in frames),
    )
    # added from the slowest to the fastest, so reruns agree to the last bit
    score = F.lit(0.0)
    for f in sorted(frames, reverse=True):
        score = score + F.coalesce(F.col(f"_{f}"), F.lit(0.0)) * float(f) ** 0.5
    g = g.withColumns({"score": score, "aligned": F.col("_b") != F.col("_s"), "conflicted": F.col("_b") & F.col("_s")})
    consensus = F.when(F.abs("score") < 1e-9, "contested").when(F.col("score") > 0, "buyers").otherwise("sellers")
    against = F.col("conflicted") & (F.col("higher") != F.col("lower")) & (F.col("higher") != "contested") & (F.col("lower") != "contested")
    shape = F.when(F.col("readings") < 2, "single").when(F.col("aligned"), "aligned").when(against, "conflict").otherwise("mixed")
    return g.select("instrument", "at_us", "readings", "higher", "lower", "aligned", "conflicted", "score", consensus.alias("consensus"), shape.alias("shape"))
