"""What follows events, against what follows any time: moves of the mid from samples on a time grid.

The grid isn't written out: a cell's sample is its first touch, so cells without one have none, and sampling is a hash aggregate with partial sums. The first
sample at or after a time is looked up within a block of time, and beyond it by one row a block, so no window spans the history of an instrument but that over blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bars import SECOND


def both_sides(touches: DataFrame) -> DataFrame:
    """touches as bids of either side: the asks are mirrored (prices negative), so what holds of a bid that falls holds of an ask that rises."""
    keep = ["instrument", "us", "seq"]
    b = touches.select(*keep, F.lit("bid").alias("side"), "bid_px", "bid_sz")
    return b.union(touches.select(*keep, F.lit("ask").alias("side"), -F.col("ask_px"), "ask_sz"))


def samples(touches: DataFrame, grid_us: int) -> DataFrame:
    """instrument, us, mid2 (bid + ask): the first touch of each cell of a grid that starts at an instrument's first touch. Touches without a price on both sides don't count."""
    t = touches.where("bid_px > 0 AND ask_px > 0").select("instrument", "us", "seq", (F.col("bid_px") + F.col("ask_px")).alias("mid2"))
    start = t.groupBy("instrument").agg(F.min("us").alias("_start"))
    cell = F.floor((F.col("us") - F.col("_start")) / grid_us)
    return t.join(start, "instrument").groupBy("instrument", cell.alias("_cell")).agg(F.min_by(F.struct("us", "mid2"), F.struct("us", "seq")).alias("s")).select("instrument", "s.us", "s.mid2")


def at_or_after(asks: DataFrame, at: str, sampled: DataFrame, block_us: int) -> DataFrame:
    """asks with then (us, mid2 of the instrument's first sample at or after `at`), null where there is none. asks may hold any further columns."""
    block = lambda c: F.floor(F.col(c) / block_us)
    s = sampled.select("instrument", block("us").alias("_block"), F.col("us").alias("_t"), F.lit(1).alias("_kind"), F.struct("us", "mid2").alias("_s"))
    a = asks.withColumns({"_block": block(at), "_t": F.col(at), "_kind": F.lit(0)})
    x = a.unionByName(s, allowMissingColumns=True)
    later = W.partitionBy("instrument", "_block").orderBy(F.desc("_t"), F.desc("_kind")).rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("_near", F.last("_s", ignorenulls=True).over(later)).where("_kind = 0").drop("_s", "_t", "_kind")

    firsts = s.groupBy("instrument", "_block").agg(F.min_by("_s", "_t").alias("_f"))
    gaps = x.select("instrument", "_block").distinct().join(firsts, ["instrument", "_block"], "full")
    beyond = W.partitionBy("instrument").orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    gaps = gaps.select("instrument", "_block", F.last("_f", ignorenulls=True).over(beyond).alias("_far"))
    return x.join(gaps, ["instrument", "_block"], "left").withColumn("then", F.coalesce("_near", "_far")).drop("_block", "_near", "_far")


def forward(sampled: DataFrame, horizons_s: list[float], block_us: int) -> DataFrame:
    """For every sample and horizon, the move of the mid in ticks to the first sample at or after its end; samples without one are left out."""
    ends = F.explode(F.array(*(F.lit(float(h)) for h in horizons_s))).alias("horizon_s")
    a = sampled.select("instrument", "us", "mid2", ends).withColumn("_end", F.col("us") + F.rint(F.col("horizon_s") * SECOND).cast("long"))
    a = at_or_after(a, "_end", sampled, block_us).where(F.col("then").isNotNull())
    return a.select("instrument", "us", "horizon_s", ((F.col("then.mid2") - F.col("mid2")) / 2).alias("move"))


def against_grid(events: DataFrame, sampled: DataFrame, horizons_s: list[float], block_us: int, least: int = 100) -> DataFrame:
    """By instrument, horizon and state: n, up (share of moves above 0), mean move, the same over all samples (n_grid, up_grid, mean_grid), z of up against the grid's by the
    events' own error, and the verdict: real from 3, marginal from 2, nothing, or too few below `least`.

    events: instrument, us, state; each counts from the first sample at or after it, and not where there is none or its horizon ends after the last sample."""
    moves = forward(sampled, horizons_s, block_us)
    told = [F.count("*").alias("n"), F.avg((F.col("move") > 0).cast("double")).alias("up"), F.avg("move").alias("mean")]
    grid = moves.groupBy("instrument", "horizon_s").agg(*told).withColumnsRenamed({"n": "n_grid", "up": "up_grid", "mean": "mean_grid"})
    e = at_or_after(events.select("instrument", "us", "state"), "us", sampled, block_us).where(F.col("then").isNotNull())
    e = e.select("instrument", F.col("then.us").alias("us"), "state").groupBy("instrument", "us", "state").agg(F.count("*").alias("_k"))
    k, up = F.col("_k"), (F.col("move") > 0).cast("long")
    g = e.join(moves, ["instrument", "us"]).groupBy("instrument", "horizon_s", "state").agg(F.sum(k).alias("n"), (F.sum(up * k) / F.sum(k)).alias("up"), (F.sum(F.col("move") * k) / F.sum(k)).alias("mean"))
    g = g.join(grid, ["instrument", "horizon_s"])
    z = (F.col("up") - F.col("up_grid")) / F.sqrt(F.greatest(F.lit(1e-12), F.col("up") * (1 - F.col("up")) / F.col("n")))
    g = g.withColumn("z", F.when(F.col("n") >= least, z))
    verdict = F.when(F.col("n") < least, "too few").when(F.abs("z") >= 3, "real").when(F.abs("z") >= 2, "marginal").otherwise("nothing")
    return g.withColumn("verdict", verdict)
