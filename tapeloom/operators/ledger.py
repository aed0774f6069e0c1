"""Scorecards of closed trades: by one dimension or many at once, audits, callbooks, slices, expectancy.

Many dimensions are one pass: grouping sets expand a row to its sets before a single partial aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import wilson


def scores() -> list[Column]:
    win = F.col("net_bps") > 0
    return [
        F.count("*").alias("n"), F.avg(win.cast("int")).alias("hit"), F.avg("net_bps").alias("mean_net"), F.stddev_samp("net_bps").alias("sd_net"), F.avg("gross_bps").alias("mean_gross"),
        F.avg("mae_bps").alias("mae"), F.avg("mfe_bps").alias("mfe"), F.avg("held_s").alias("held_s"),
    ]


def verdict(n: Column, mean: Column, sd: Column) -> Column:
    error = 1.96 * sd / F.sqrt(n)
    return F.when(n < 30, "too few").when(mean - error > 0, "pays").when(mean + error < 0, "loses").when(n < 100, "early").otherwise("unclear")


def scorecard(trades: DataFrame, dims: list[str]) -> DataFrame:
    """The same scores by each dimension and over all: dimension, value and the scores."""
    sets = [[F.col(d)] for d in dims] + [[]]
    g = trades.groupingSets(sets, *map(F.col, dims)).agg(*scores(), *(F.grouping(d).alias(f"_{d}") for d in dims))
    name = F.coalesce(*(F.when(F.col(f"_{d}") == 0, F.lit(d)) for d in dims), F.lit("all"))
    value = F.coalesce(*(F.when(F.col(f"_{d}") == 0, F.col(d).cast("string")) for d in dims))
    return g.select(name.alias("dimension"), value.alias("value"), "n", "hit", "mean_net", "sd_net", "mean_gross", "mae", "mfe", "held_s", verdict(F.col("n"), F.col("mean_net"), F.col("sd_net")).alias("verdict"))


def exit_audit(trades: DataFrame) -> DataFrame:
    """Net, gross and what costs took by exit reason, and stops that had been half way to the target."""
    return trades.groupBy("exit_reason").agg(F.count("*").alias("n"), F.sum("net_bps").alias("net"), F.sum("gross_bps").alias("gross"), F.sum(F.col("gross_bps") - F.col("net_bps")).alias("cost"), F.count_if((F.col("exit_reason") == "stop") & (F.col("mfe_bps") >= 6)).alias("turned"))


def gate_audit(decisions: DataFrame, gates: list[tuple[str, Column]]) -> DataFrame:
    """Decisions by the first gate that refuses them, or taken."""
    why = F.lit("taken")
    for name, refused in reversed(gates):
        why = F.when(refused, name).otherwise(why)
    return decisions.groupBy(why.alias("gate")).agg(F.count("*").alias("n"))


def callbook(calls: DataFrame, by: list[str]) -> DataFrame:
    """Offered, called, scored, hits and naive hits: rate, edge over the naive call, coverage, agreement."""
    g = calls.groupBy(*by).agg(
        F.count("*").alias("offered"), F.count_if(F.col("side") != 0).alias("called"), F.count_if((F.col("side") != 0) & (F.col("outcome") != 0)).alias("scored"),
        F.count_if((F.col("side") != 0) & (F.col("outcome") == F.col("side"))).alias("hits"), F.count_if((F.col("side") != 0) & (F.col("outcome") != 0) & (F.col("outcome") == F.col("naive"))).alias("naive_hits"), F.count_if((F.col("side") != 0) & (F.col("side") == F.col("naive"))).alias("agreed"),
    )
    return g.withColumns({"rate": F.try_divide("hits", "scored"), "edge": F.try_divide(F.col("hits") - F.col("naive_hits"), F.col("scored")), "coverage": F.try_divide("called", "offered"), "agreement": F.try_divide("agreed", "called")})


def agreement_table(states: DataFrame, memberships: list[tuple[str, Column]]) -> DataFrame:
    """Overlapping conditions, a row of each: count, share of all, mean and median called move, hit rate."""
    names = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in memberships), F.lit("all")), lambda x: x.isNotNull())
    x = states.withColumn("condition", F.explode(names))
    g = x.groupBy("condition").agg(F.count("*").alias("n"), F.avg("called").alias("mean"), F.percentile("called", F.lit(0.5)).alias("median"), F.avg((F.col("called") > 0).cast("int")).alias("hit"))
    from pyspark.sql import Window as W

    return g.withColumn("share", F.col("n") / F.max("n").over(W.partitionBy(F.lit(1))))


def feature_slice(rows: DataFrame, feature: Column, edges: list[float], value: str) -> DataFrame:
    """Count, mean and hit rate of value by bands of a feature."""
    from .validation import bands

    x = rows.withColumn("band", bands(feature, edges)).where("band is not null")
    return x.groupBy("band").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.avg((F.col(value) > 0).cast("int")).alias("hit"))


def summary(trades: DataFrame, by: list[str], scratch: float) -> DataFrame:
    """Wins, losses and scratches by group, with the Wilson interval of the wins among the decided, and the upper median."""
    from ..functions.stats import upper_median

    g = trades.groupBy(*by).agg(F.count_if(F.col("net_bps") > scratch).alias("wins"), F.count_if(F.col("net_bps") < -scratch).alias("losses"), F.count_if(F.abs("net_bps") <= scratch).alias("scratches"), F.sum("net_bps").alias("net"), upper_median(F.collect_list("net_bps")).alias("median"))
    lo, hi = wilson(F.col("wins"), F.col("wins") + F.col("losses"))
    return g.withColumns({"lo": lo, "hi": hi})


def expectancy(trades: DataFrame, target: float, stop: float, cost: float) -> DataFrame:
    """Mean result a trade: the target, the stop, or what the clock left, after cost."""
    net = F.when(F.col("exit_reason") == "target", target).when(F.col("exit_reason") == "stop", -stop).otherwise(F.col("gross_bps")) - cost
    return trades.groupBy("coin").agg(F.count("*").alias("n"), F.avg(net).alias("expectancy"))


def census(trades: DataFrame) -> DataFrame:
    """Exit reasons as columns, by coin."""
    reasons = ["target", "stop", "candle_end"]
    return trades.groupBy("coin").pivot("exit_reason", reasons).agg(F.count(F.lit(1))).na.fill(0, reasons)


def histogram(df: DataFrame, x: str, lo: float, hi: float, buckets: int) -> DataFrame:
    """Equal-width counts: what is over falls in the last bucket, what is under is dropped."""
    b = F.least(F.floor((F.col(x) - lo) / ((hi - lo) / buckets)), F.lit(buckets - 1))
    return df.where(F.col(x) >= lo).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


def equity(trades: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Running total by group after each day, and the drawdown from its peak."""
    from pyspark.sql import Window as W

    d = trades.groupBy(by, *order).agg(F.sum("net_bps").alias("day_net"))
    run = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("total", F.sum("day_net").over(run))
    return d.withColumn("drawdown", F.greatest(F.max("total").over(run), F.lit(0)) - F.col("total"))


def counts(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """what, n: how many rows of each table its condition holds for."""
    return reduce(DataFrame.union, (df.agg(F.lit(name).alias("what"), F.count_if(c).alias("n")) for name, (df, c) in tables.items()))


def suspect(trades: DataFrame, most: float) -> DataFrame:
    """Trades whose result can't be true: of more than `most` either way."""
    return trades.where(F.abs(F.coalesce("net_bps", F.lit(0))) > most)


def regime_tally(bars: DataFrame, least: int) -> DataFrame:
    """By regime, what the reads of its bars came to: n with a read of up or down, right, wrong and flat, and from `least` decided ones on the share
    that was right. bars: regime, read, outcome (up, down or null)."""
    b = bars.where(F.col("regime").isNotNull() & F.col("read").isin("up", "down"))
    g = b.groupBy("regime").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == F.col("read")).alias("right"), F.count_if(F.col("outcome").isNotNull() & (F.col("outcome") != F.col("read"))).alias("wrong"), F.count_if(F.col("outcome").isNull()).alias("flat"))
    decided = F.col("right") + F.col("wrong")
    return g.withColumns({"enough": decided >= least, "share": F.when(decided >= least, F.col("right") / decided)})


def first_looks(projections: DataFrame, key: list[str], elapsed: str) -> DataFrame:
    """One projection of each bar, the earliest: ten looks at one bar are one observation, not ten."""
    return projections.groupBy(*key).agg(F.min_by(F.struct(*(c for c in projections.columns if c not in key)), elapsed).alias("_p")).select(*key, "_p.*")


def recent(changes: DataFrame, kinds: list[str], order: list[Column], top: int) -> DataFrame:
    """A report of the `top` changes of these kinds, by order."""
    return changes.where(F.col("kind").isin(*kinds)).orderBy(*order).limit(top)
