"""Studies over bars, prints and levels: spells, timeframes, volume curves, fills, trailing stops, thresholds, rotation floors, top-k.

Native throughout. Studies that compare each event with later rows use outcomes.range_join; those over levels start from swings or pivots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import corr
from .bars import SECOND, bucket
from .outcomes import range_join


def by_bar(*more: str):
    return W.partitionBy("instrument", *more).orderBy("bar_us")


def spells(states: DataFrame, state: str) -> DataFrame:
    """Runs of one state: state, from_us, to_us, rows. states: instrument, bar_us and the state."""
    change = F.coalesce((F.col(state) != F.lag(state).over(by_bar())).cast("int"), F.lit(1))
    s = states.withColumn("_c", change).withColumn("_i", F.sum("_c").over(by_bar().rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy("instrument", F.col(state).alias("state"), "_i").agg(F.min("bar_us").alias("from_us"), F.max("bar_us").alias("to_us"), F.count("*").alias("rows")).drop("_i")


def realised_sigma(bars: DataFrame, lookback: int, interval_s: int) -> DataFrame:
    """Deviation of close-to-close moves in bps over `lookback` bars, a root second."""
    b = bars.withColumn("r", (F.col("close") / F.lag("close").over(by_bar()) - 1) * 1e4)
    last = by_bar().rowsBetween(-lookback + 1, 0)
    return b.select("instrument", "bar_us", F.when(F.count("r").over(last) == lookback, F.stddev_samp("r").over(last) / F.sqrt(F.lit(float(interval_s)))).alias("sigma"))


def rungs(prints: DataFrame, timeframes: list[int]) -> DataFrame:
    """Volume, delta and prints of every timeframe at once: each print counts in one bar of each."""
    p = prints.withColumn("seconds", F.explode(F.array(*(F.lit(t).cast("long") for t in timeframes))))
    at = F.floor(F.col("us") / (F.col("seconds") * SECOND)) * F.col("seconds") * SECOND
    signed = F.when(F.col("side") == "B", F.col("sz")).when(F.col("side") == "A", -F.col("sz")).otherwise(0)
    return p.groupBy("instrument", "seconds", at.cast("long").alias("bar_us")).agg(F.sum("sz").alias("volume"), F.sum(signed).alias("delta"), F.count("*").alias("prints"))


def stack_read(ladder: DataFrame, base: int) -> DataFrame:
    """At the base timeframe's bars, whether the finer timeframes' last bars agree: TREND, PULLBACK or MIXED, NO_COMMIT without a base."""
    way = ladder.withColumn("way", F.signum("delta")).withColumn("base_us", bucket("bar_us", base))
    last = way.groupBy("instrument", "base_us", "seconds").agg(F.max_by("way", "bar_us").alias("way"))
    r = last.groupBy("instrument", "base_us").agg(F.max(F.when(F.col("seconds") == base, F.col("way"))).alias("base"), F.min(F.when(F.col("seconds") < base, F.col("way"))).alias("lo"), F.max(F.when(F.col("seconds") < base, F.col("way"))).alias("hi"))
    state = F.when(F.col("base") == 0, "NO_COMMIT").when((F.col("lo") == F.col("base")) & (F.col("hi") == F.col("base")), "TREND").when((F.col("lo") == -F.col("base")) | (F.col("hi") == -F.col("base")), "PULLBACK").otherwise("MIXED")
    return r.select("instrument", "base_us", state.alias("state"))


def stride_hits(bars: DataFrame, side: Column, horizon: int, stride: int) -> DataFrame:
    """Hits of a side against the move of `horizon` bars, on every stride-th bar, so that horizons don't overlap."""
    i = F.row_number().over(by_bar())
    b = bars.withColumns({"side": side, "i": i, "move": F.lead("close", horizon).over(by_bar()) - F.col("close")}).where((F.col("i") % stride == 0) & F.col("move").isNotNull() & (F.col("side") != 0))
    return b.groupBy("instrument").agg(F.count("*").alias("n"), F.count_if(F.signum("move") == F.col("side")).alias("hits"), F.count_if(F.col("move") == 0).alias("flat"))


def volume_curve(prints: DataFrame, bar_s: int, slices: int, least: int) -> DataFrame:
    """The median share of a bar's volume that is done by each slice of it, over bars of at least `least` prints."""
    p = prints.withColumns({"bar_us": bucket("us", bar_s)}).withColumn("slice", F.floor((F.col("us") - F.col("bar_us")) * slices / (bar_s * SECOND)))
    per = p.groupBy("instrument", "bar_us").pivot("slice", list(range(slices))).agg(F.sum("sz")).na.fill(0)
    full = p.groupBy("instrument", "bar_us").agg(F.count("*").alias("prints"), F.sum("sz").alias("all"))
    done, x = F.lit(0), per.join(full, ["instrument", "bar_us"]).where(F.col("prints") >= least)
    points = []
    for k in range(slices):
        done = done + F.col(str(k))
        points.append(F.struct(F.lit(k).alias("slice"), (done / F.col("all")).alias("share")))
    x = x.select("instrument", F.explode(F.array(*points)).alias("p"))
    return x.groupBy("instrument", F.col("p.slice").alias("slice")).agg(F.percentile("p.share", F.lit(0.5)).alias("share"), F.count("*").alias("bars"))


def book_diagonal(touches: DataFrame, bar_s: int, cap_s: int) -> DataFrame:
    """By bar, imbalance of size at the touch weighted by how long each touch stood (cap_s at most)."""
    w = W.partitionBy("instrument").orderBy("seq")
    dt = F.least(F.coalesce(F.lead("us").over(w) - F.col("us"), F.lit(0)), F.lit(cap_s * SECOND))
    t = touches.withColumn("dt", dt).withColumn("bar_us", bucket("us", bar_s))
    g = t.groupBy("instrument", "bar_us").agg(F.sum(F.col("bid_sz") * F.col("dt")).alias("bid"), F.sum(F.col("ask_sz") * F.col("dt")).alias("ask"), F.sum("dt").alias("stood"))
    return g.withColumn("imbalance", F.try_divide(F.col("bid") - F.col("ask"), F.col("bid") + F.col("ask")))


def developing_poc(prints: DataFrame, day_s: int, step_s: int) -> DataFrame:
    """The busiest price of the day so far at each step (ties: lower), from sums by (day, step, price) made cumulative per price."""
    p = prints.withColumns({"day_us": bucket("us", day_s), "step_us": bucket("us", step_s)})
    v = p.groupBy("instrument", "day_us", "step_us", F.col("px_ticks").alias("px")).agg(F.sum("sz").alias("v"))
    steps = v.select("instrument", "day_us", F.col("step_us").alias("at_us")).distinct()
    x = steps.join(v, ["instrument", "day_us"]).where("step_us <= at_us").groupBy("instrument", "day_us", "at_us", "px").agg(F.sum("v").alias("v"))
    return x.groupBy("instrument", "day_us", "at_us").agg(F.max_by("px", F.struct("v", -F.col("px"))).alias("poc"), F.sum("v").alias("volume"))


def rearmed_touches(prints: DataFrame, levels: DataFrame, touch: int, rearm: int) -> DataFrame:
    """Touches of each level (instrument, level): a touch within `touch` ticks counts once, again only after price was `rearm` away.

    A print meets a level only where it is within touch of it, or comes to be rearm away from it: both are equal prices, so levels are looked up and no
    print is held against all."""
    before = F.lag("px_ticks").over(W.partitionBy("instrument").orderBy("seq"))
    p = prints.select("instrument", "seq", "us", "px_ticks", before.alias("px0"))
    near = p.select("*", F.explode(F.sequence(F.col("px_ticks") - touch, F.col("px_ticks") + touch)).alias("level"), F.lit("in").alias("zone"))
    up, down = F.sequence(F.col("px0") - rearm + 1, F.col("px_ticks") - rearm), F.sequence(F.col("px_ticks") + rearm, F.col("px0") + rearm - 1)
    away = p.where("px0 <> px_ticks").select("*", F.explode(F.when(F.col("px_ticks") > F.col("px0"), up).otherwise(down)).alias("level"), F.lit("out").alias("zone"))
    x = near.union(away).join(levels.select("instrument", "level").distinct(), ["instrument", "level"])
    x = x.withColumn("prev", F.lag("zone").over(W.partitionBy("instrument", "level").orderBy("seq")))
    side = F.when(F.col("px_ticks") >= F.col("level"), "above").otherwise("below")
    return x.where("zone = 'in' and (prev is null or prev = 'out')").select("instrument", "level", "seq", "us", side.alias("side"))


def swing_pick(found: DataFrame, keep: int) -> DataFrame:
    """Of swings of the same kind and price the first, and of those the last `keep` of each kind."""
    first = F.row_number().over(W.partitionBy("instrument", "kind", "px").orderBy("bar_us"))
    s = found.withColumn("_f", first).where("_f = 1")
    last = F.row_number().over(W.partitionBy("instrument", "kind").orderBy(F.desc("bar_us")))
    return s.withColumn("rank", last).where(F.col("rank") <= keep).select("instrument", "kind", "px", "bar_us", "rank")


def nearest_level(bars: DataFrame, levels: DataFrame) -> DataFrame:
    """The nearest level above and below each bar's close: bars and levels in the order of price, each bar looking at the level before it."""
    b = bars.select("instrument", "bar_us", "close", F.col("close").alias("px"), F.lit(None).cast("long").alias("level"))
    rows = b.unionByName(levels.select("instrument", F.lit(None).cast("long").alias("bar_us"), F.lit(None).cast(bars.schema["close"].dataType).alias("close"), F.col("level").alias("px"), F.col("level").cast("long").alias("level")))
    # at the same price bars come first, as a level at the close is neither above nor below
    first = F.col("level").isNotNull()
    seen = lambda way: F.last("level", ignorenulls=True).over(W.partitionBy("instrument").orderBy(way, first).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumns({"above": seen(F.desc("px")), "below": seen(F.asc("px"))}).where("bar_us is not null").select("instrument", "bar_us", "close", "above", "below")


def resting_fills(orders: DataFrame, prints: DataFrame, horizon_us: int) -> DataFrame:
    """Limit orders (event_id, instrument, at_us, side, price, ahead): filled once price trades through, or once what trades at it
    has used up what stood ahead; and when they were first touched."""
    x = range_join(orders, prints.withColumn("px", F.struct("px_ticks", "sz")), horizon_us)
    through = F.when(F.col("side") > 0, F.col("px.px_ticks") < F.col("price")).otherwise(F.col("px.px_ticks") > F.col("price"))
    at = F.col("px.px_ticks") == F.col("price")
    used = F.sum(F.when(at, F.col("px.sz")).otherwise(0)).over(W.partitionBy("event_id").orderBy("us", "seq").rowsBetween(W.unboundedPreceding, 0))
    x = x.withColumns({"used": used, "hit": through, "touch": through | at})
    g = x.groupBy("event_id").agg(F.min(F.when(F.col("hit") | (F.col("used") >= F.col("ahead")), F.col("us"))).alias("fill_us"), F.min(F.when(F.col("touch"), F.col("us"))).alias("touch_us"))
    return orders.select("event_id", "instrument", "side", "price").join(g, "event_id", "left").select("event_id", "instrument", "side", "price", F.col("fill_us").isNotNull().alias("filled"), F.col("touch_us").isNotNull().alias("touched"))


def trailing_stop(events: DataFrame, prints: DataFrame, stop: int, trail: int, horizon_us: int) -> DataFrame:
    """events (event_id, instrument, at_us, side, entry): out at the stop, or `trail` below the best gain of the prints before, or at the end."""
    x = range_join(events, prints, horizon_us).withColumn("gain", (F.col("px") - F.col("entry")) * F.col("side"))
    order = W.partitionBy("event_id").orderBy("us", "seq")
    best = F.coalesce(F.max("gain").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("line", F.greatest(F.lit(-stop), F.greatest(best, F.lit(0)) - trail))
    g = x.groupBy("event_id").agg(F.min_by("gain", F.when(F.col("gain") <= F.col("line"), F.struct("us", "seq"))).alias("out"), F.min(F.when(F.col("gain") <= F.col("line"), F.col("us"))).alias("out_us"), F.max_by("gain", F.struct("us", "seq")).alias("last"))
    return events.select("event_id", "instrument", "side").join(g, "event_id").select("event_id", "instrument", "side", F.coalesce(F.when(F.col("out_us").isNotNull(), F.col("out")), F.col("last")).alias("net"), F.col("out_us").isNotNull().alias("stopped"))


def threshold_curve(rows: DataFrame, score: Column, outcome: Column, thresholds: list[float]) -> DataFrame:
    """Accuracy and coverage of calls whose |score| reaches each threshold."""
    x = rows.select(score.alias("s"), outcome.alias("y")).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    called = F.abs("s") >= F.col("threshold")
    g = x.groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(called).alias("called"), F.count_if(called & (F.signum("s") == F.signum("y"))).alias("right"))
    return g.withColumns({"accuracy": F.try_divide("right", "called"), "coverage": F.try_divide("called", "n")})


def rotation_floor(series: DataFrame, a: str, b: str, shifts: list[int]) -> DataFrame:
    """Correlation of a with b rotated by each shift within its instrument: what noise alone gives."""
    i = F.row_number().over(by_bar()) - 1
    s = series.withColumns({"i": i, "m": F.count("*").over(W.partitionBy("instrument"))})
    x = s.select("instrument", "i", "m", F.col(a).alias("a")).withColumn("shift", F.explode(F.array(*map(F.lit, shifts)))).withColumn("j", (F.col("i") + F.col("shift")) % F.col("m"))
    y = s.select("instrument", F.col("i").alias("j"), F.col(b).alias("b"))
    return x.join(y, ["instrument", "j"]).groupBy("shift").agg(corr("a", "b").alias("corr"), F.count("*").alias("n"))


def bar_separation(prints: DataFrame, bar_s: int, marks: list[int]) -> DataFrame:
    """The median running delta at shares of a bar's time, for bars that then closed up and down."""
    p = prints.withColumn("bar_us", bucket("us", bar_s))
    done = (F.col("us") - F.col("bar_us")) * 100 / (bar_s * SECOND)
    signed = F.when(F.col("side") == "B", F.col("sz")).when(F.col("side") == "A", -F.col("sz")).otherwise(0)
    g = p.groupBy("instrument", "bar_us").agg(F.min_by("px_ticks", "seq").alias("open"), F.max_by("px_ticks", "seq").alias("close"), *(F.sum(F.when(done <= m, signed).otherwise(0)).alias(f"m{m}") for m in marks))
    x = g.where("close <> open").select(F.when(F.col("close") > F.col("open"), "up").otherwise("down").alias("bar"), F.explode(F.array(*(F.struct(F.lit(m).alias("mark"), F.col(f"m{m}").alias("delta")) for m in marks))).alias("x"))
    return x.groupBy("bar", F.col("x.mark").alias("mark")).agg(F.percentile("x.delta", F.lit(0.5)).alias("median"), F.count("*").alias("n"))


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows by order: a top-k report."""
    return df.orderBy(*order).limit(n)


def confirmed_signals(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Signals (instrument, at_us, bar_us, side) by how their bar closed: CONFIRMED or WITHDRAWN, with the share confirmed."""
    b = bars.select("instrument", "bar_us", F.signum(F.col("close") - F.col("open")).alias("colour"))
    s = signals.join(b, ["instrument", "bar_us"]).withColumn("state", F.when(F.col("colour") == F.col("side"), "CONFIRMED").otherwise("WITHDRAWN"))
    return s.groupBy("instrument").agg(F.count("*").alias("n"), F.avg((F.col("state") == "CONFIRMED").cast("int")).alias("survival"))


def tune_weights(samples: DataFrame, features: list[str], outcome: str, grid: list[float], rounds: int) -> DataFrame:
    """Coordinate ascent of the weights of a vote for accuracy: each step tries every value of one weight in one pass over samples."""
    weights = dict.fromkeys(features, 1.0)
    history = []
    for r in range(rounds):
        for f in features:
            trial = lambda g: sum((F.col(k) * (g if k == f else w) for k, w in weights.items()), F.lit(0.0))
            hits = samples.agg(*(F.avg((F.signum(trial(g)) == F.signum(outcome)).cast("int")).alias(f"g{i}") for i, g in enumerate(grid))).first()
            best = max(range(len(grid)), key=lambda i: (hits[i] or 0.0, -abs(grid[i] - weights[f]), -i))
            weights[f] = grid[best]
            history.append((r, f, float(weights[f]), float(hits[best] or 0.0)))
    return samples.sparkSession.createDataFrame(history, "round int, feature string, weight double, accuracy double")
