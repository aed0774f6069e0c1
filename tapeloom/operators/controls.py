"""Findings beside what they would be by chance: levels drawn at random, what is left of a bar against its base rate and its momentum, travel from a
state against travel from anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import corr
from ..sources.scratch import held
from .bars import SECOND, bucket
from .outcomes import lcg

# Standard errors from which on a rate is real or marginal.
REAL, MARGINAL = 3.0, 2.0


def verdict(z: Column) -> Column:
    return F.when(z >= REAL, "real").when(z >= MARGINAL, "marginal").when(z.isNotNull(), "nothing")


def drawn_levels(levels: DataFrame, ranges: DataFrame, key: list[str], seed: int) -> DataFrame:
    """As many levels for each key as `levels` has there, each at a tick drawn between the key's lo and hi (both included) of `ranges`: the key, i (from 0), level.

    A draw depends on seed, lo, hi and i alone, so reruns agree; repeated draws stay. Keys without a range, or with one of no width, give none."""
    n = levels.groupBy(*key).agg(F.count("*").alias("n"))
    r = n.join(ranges.select(*key, "lo", "hi").where("hi > lo"), key).withColumn("i", F.explode(F.expr("sequence(0L, n - 1)")))
    x = lcg(lcg(lcg(F.col("lo") * 7919 + F.col("hi") * 104729 + F.col("i") * 1299709 + seed)))
    return r.select(*key, "i", (F.col("lo") + F.floor(x / 2147483648 * (F.col("hi") - F.col("lo") + 1))).cast("long").alias("level"))


def against_control(found: DataFrame, control: DataFrame, label: str) -> DataFrame:
    """For each label its count and share in both, and z of the shares' difference by the pooled share: label, n, share, control_n, control_share, z. A label
    that only one of them has counts 0 in the other."""
    both = found.select(label, F.lit(1).alias("own")).unionByName(control.select(label, F.lit(0).alias("own"))).groupBy(label).agg(F.sum("own").alias("n"), F.sum(1 - F.col("own")).alias("control_n"))
    # labels are few: one row for each
    w = W.partitionBy(F.lit(0))
    t = both.withColumns({"_a": F.sum("n").over(w), "_b": F.sum("control_n").over(w)})
    t = t.withColumns({"share": F.try_divide("n", "_a"), "control_share": F.try_divide("control_n", "_b")})
    pooled = (F.col("n") + F.col("control_n")) / (F.col("_a") + F.col("_b"))
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("_a")) + F.try_divide(F.lit(1.0), F.col("_b"))))
    return t.withColumn("z", F.try_divide(F.col("share") - F.col("control_share"), error)).select(label, "n", "share", "control_n", "control_share", "z")


def checkpoints(prints: DataFrame, bar_s: int, marks: list[float]) -> DataFrame:
    """A row for each bar and mark (share of the bar) with a print before it: instrument, bar_us, mark, realised (move from the bar's open to the mark), remaining
    (from there to its close), delta and volume by the mark. Each mark is a conditional aggregate of one grouping."""
    at, into = F.struct("us", "seq"), F.col("us") - bucket("us", bar_s)
    aggs = [F.min_by("px_ticks", at).alias("open"), F.max_by("px_ticks", at).alias("close")]
    signed = F.when(F.col("side") == "B", F.col("sz")).when(F.col("side") == "A", -F.col("sz")).otherwise(0)
    for i, m in enumerate(marks):
        by = into < m * bar_s * SECOND
        aggs.append(F.struct(F.lit(m).alias("mark"), F.max_by(F.when(by, F.col("px_ticks")), F.when(by, at)).alias("px"), F.sum(F.when(by, signed)).alias("delta"), F.sum(F.when(by, F.col("sz"))).alias("volume")).alias(f"m{i}"))
    b = prints.groupBy("instrument", bucket("us", bar_s).alias("bar_us")).agg(*aggs)
    x = b.select("instrument", "bar_us", "open", "close", F.explode(F.array(*(f"m{i}" for i in range(len(marks))))).alias("m")).where("m.px is not null")
    return x.select("instrument", "bar_us", "m.mark", (F.col("m.px") - F.col("open")).alias("realised"), (F.col("close") - F.col("m.px")).alias("remaining"), "m.delta", "m.volume")


def remaining_calls(rows: DataFrame, readings: dict[str, Column], least: int) -> DataFrame:
    """How well the sign of each reading at a mark calls the sign of what remains of the bar: mark, reading, n (rows with a remainder), used (of them with a
    side), rate, base (the better of always calling one way), edge, z of the edge, corr of reading and remainder, verdict. Realised moves should be among
    the readings: momentum is free. Marks or readings below `least` rows give none; null readings have no side."""
    name = F.explode(F.array(*(F.struct(F.lit(n).alias("reading"), c.cast("double").alias("x")) for n, c in readings.items())))
    r = rows.where("remaining <> 0").select("mark", "remaining", name.alias("r")).select("mark", "r.reading", F.coalesce("r.x", F.lit(0.0)).alias("x"), F.col("remaining").cast("double").alias("y"))
    g = r.groupBy("mark", "reading").agg(F.count("*").alias("n"), F.avg((F.col("y") > 0).cast("int")).alias("up"), F.count_if(F.col("x") != 0).alias("used"), F.count_if(F.col("x") * F.col("y") > 0).alias("hits"), corr("x", "y").alias("corr"))
    g = g.where((F.col("n") >= least) & (F.col("used") >= least)).withColumns({"rate": F.col("hits") / F.col("used"), "base": F.greatest(F.col("up"), 1 - F.col("up"))})
    g = g.withColumn("edge", F.col("rate") - F.col("base")).withColumn("z", F.col("edge") / F.sqrt(F.lit(0.25) / F.col("used")))
    return g.select("mark", "reading", "n", "used", "rate", "base", "edge", "z", "corr", verdict(F.col("z")).alias("verdict"))


def two_line_state(book: Column, tape: Column, dead: float) -> Column:
    """both_up, both_down, book_leads or tape_leads (they disagree, and that one is the larger), else flat."""
    clear = lambda x: F.when(x > dead, 1).when(x < -dead, -1).otherwise(0)
    b, t = clear(book), clear(tape)
    return F.when((b == 1) & (t == 1), "both_up").when((b == -1) & (t == -1), "both_down").when(b * t == -1, F.when(F.abs(book) > F.abs(tape), "book_leads").otherwise("tape_leads")).otherwise("flat")


def travel_by_state(samples: DataFrame, step_s: int, horizons: list[int], least: int = 50) -> DataFrame:
    """How far price goes within each horizon (in samples) from each state, and from all: horizon, state, n, indep (n by the horizon, as windows overlap), median,
    mean, travel (median of the move without its sign), up, z of up against all's, verdict. States below `least` independent windows give no median,
    mean, travel, up or z. samples: instrument, at_us, px, state, step_s apart; a move over a gap in them doesn't count, and none crosses instruments."""
    w = W.partitionBy("instrument").orderBy("at_us")
    m = samples.select("state", *(F.struct(F.lit(h).cast("long").alias("horizon"), F.when(F.lead("at_us", h).over(w) - F.col("at_us") == h * step_s * SECOND, F.lead("px", h).over(w) - F.col("px")).alias("move")).alias(f"a{h}") for h in horizons))
    m = m.select("state", F.explode(F.array(*(f"a{h}" for h in horizons))).alias("a")).select("state", "a.*").where("move is not null")
    # counts by state and move: the medians of both levels are then taken over distinct moves, weighed
    c = held(m.groupBy("horizon", "state", "move").agg(F.count("*").alias("k")))
    sides = c.withColumn("state", F.explode(F.array(F.lit("all"), "state")))
    half = F.lit(0.5)
    g = sides.groupBy("horizon", "state").agg(
        F.sum("k").alias("n"), F.percentile("move", half, F.col("k")).alias("median"), (F.sum(F.col("move") * F.col("k")) / F.sum("k")).alias("mean"), F.percentile(F.abs("move"), half, F.col("k")).alias("travel"), (F.sum(F.when(F.col("move") > 0, F.col("k")).otherwise(0)) / F.sum("k")).alias("up")
    )
    every = g.where("state = 'all'").select("horizon", F.col("up").alias("_base"))
    g = g.join(F.broadcast(every), "horizon").withColumn("indep", F.col("n") / F.col("horizon"))
    z = F.when(F.col("state") != "all", (F.col("up") - F.col("_base")) / F.sqrt(F.greatest(F.lit(1e-9), F.col("_base") * (1 - F.col("_base")) / F.col("indep"))))
    enough = (F.col("state") == "all") | (F.col("indep") >= least)
    g = g.withColumn("z", z).select("horizon", "state", "n", "indep", *(F.when(enough, F.col(c)).alias(c) for c in ("median", "mean", "travel", "up", "z")))
    return g.withColumn("verdict", verdict(F.abs("z")))
