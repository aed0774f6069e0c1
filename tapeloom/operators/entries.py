"""Where composite rules would have entered, and the setups that a footprint's flags make.

A rule gives each slice of time a side (1, -1, or 0 where it abstains); an entry needs every rule that is asked on the same side, and some seconds since the
entry before. Slices are hash aggregates of prints and books; frames, sums and z are windows; only the cooldown is walked in order, over the slices
that the rules agree on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import held
from .bars import SECOND, bucket, time_bars
from .flow import level1_ofi, race
from .sequential import in_order


def slices(prints: DataFrame, touches: DataFrame, seconds: int) -> DataFrame:
    """instrument, at_us, open, high, low, close, volume, delta, prints, ofi, bid_sz, ask_sz: a row for each slice with a print. ofi is the sum of its touches'
    and 0 without any; the sizes are those of its last touch, null without one."""
    b = level1_ofi(touches).groupBy("instrument", bucket("us", seconds).alias("bar_us")).agg(F.coalesce(F.sum("ofi"), F.lit(0)).cast("long").alias("ofi"), F.max_by("bid_sz", "seq").alias("bid_sz"), F.max_by("ask_sz", "seq").alias("ask_sz"))
    p = time_bars(prints, seconds).select("instrument", "bar_us", "open", "high", "low", "close", "volume", "delta", "prints")
    return p.join(b, ["instrument", "bar_us"], "left").withColumn("ofi", F.coalesce("ofi", F.lit(0))).withColumnRenamed("bar_us", "at_us")


def frame_side(frames: list[int]) -> Column:
    """The side that a slice's close is on of the first close in its bar of every frame (seconds); 0 where one differs or doesn't move. Bars still forming count."""
    ways = []
    for f in frames:
        bar = F.floor(F.col("at_us") / (f * SECOND))
        ways.append(F.signum(F.col("close") - F.first("close").over(W.partitionBy("instrument", bar).orderBy("at_us").rowsBetween(W.unboundedPreceding, 0))).cast("int"))
    same = F.lit(True)
    for w in ways[1:]:
        same = same & (w == ways[0])
    return F.when(same, ways[0]).otherwise(0)


def book_side(ratio: float) -> Column:
    """The side of the touch that holds `ratio` times the other's size; 0 without a book."""
    b, a = F.col("bid_sz"), F.col("ask_sz")
    return F.when((b > 0) & (a > 0), F.when(b >= a * ratio, 1).when(a >= b * ratio, -1).otherwise(0)).otherwise(0)


def delta_side(window: int) -> Column:
    """The sign of the delta of the last `window` slices; 0 before there are as many."""
    w = W.partitionBy("instrument").orderBy("at_us").rowsBetween(-window + 1, 0)
    return F.when(F.count("*").over(w) == window, F.signum(F.sum("delta").over(w))).otherwise(0).cast("int")


def sided(slices_: DataFrame, frames: list[int], window: int, baseline: int, enter: float, ratio: float, delta_window: int) -> DataFrame:
    """slices with z and a column for each rule: ofi (z of the last `window` slices' OFI among `baseline` of them, `enter` or more), agree, book, delta."""
    slices_ = held(slices_)
    z = race(slices_.select("instrument", F.col("at_us").alias("seq"), "ofi"), window, baseline).select("instrument", F.col("seq").alias("at_us"), "z")
    ofi = F.when(F.abs("z") >= enter, F.signum("z")).otherwise(0).cast("int")
    s = slices_.drop("ofi").join(z, ["instrument", "at_us"], "left")
    return s.withColumns({"ofi": ofi, "agree": frame_side(frames), "book": book_side(ratio), "delta": delta_side(delta_window)})


def entries(sided_: DataFrame, rules: list[str], cooldown_s: float, key: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """at_us, close, side and z of each entry: all of `rules` on one side, at least cooldown_s after the entry before, whatever its side. An unknown rule raises."""
    if unknown := set(rules) - {"ofi", "agree", "book", "delta"}:
        raise ValueError(f"no such rule: {', '.join(sorted(unknown))}")
    one = F.col(rules[0]) != 0
    for r in rules[1:]:
        one = one & (F.col(r) == F.col(rules[0]))

    def step(rows):
        free = None
        for at, close, side, z in rows:
            if free is None or at >= free:
                yield at, close, side, z
                free = at + cooldown_s * SECOND

    return in_order(sided_.where(one).select(*key, "at_us", "close", F.col(rules[0]).alias("side"), "z"), step, "at_us long, close long, side int, z double", key, ("at_us",))


def setups(flags: DataFrame, bars: DataFrame, seconds: int, run: int = 3, within: int = 1) -> DataFrame:
    """What a bar whose flags are all of one side offers, at most one of each kind: single (its flag of most volume), stacked (its longest run of flagged
    prices next to each other, the lowest of equal ones, of `run` and more) and extreme (a stack that comes within `within` ticks of the bar's low where
    it buys, of its high where it sells). entry_px is the bar's close, at_us its end.

    flags: instrument, bar_us, px, bid_vol, ask_vol, buy_flag, sell_flag; bars: instrument, bar_us, high, low, close. A price flagged both ways, as flags of both
    sides in a bar, is no direction."""
    bar = ["instrument", "bar_us"]
    f = flags.where("buy_flag or sell_flag").select(*bar, "px", F.explode(F.filter(F.array(F.when(F.col("buy_flag"), F.lit(1)), F.when(F.col("sell_flag"), F.lit(-1))), lambda x: x.isNotNull())).alias("side"), "bid_vol", "ask_vol")
    f = f.withColumns({"v": F.when(F.col("side") > 0, F.col("ask_vol")).otherwise(F.col("bid_vol")), "island": F.col("px") - F.row_number().over(W.partitionBy(*bar, "side").orderBy("px"))})
    runs = f.groupBy(*bar, "side", "island").agg(F.min("px").alias("lo"), F.max("px").alias("hi"), F.count("*").alias("n"), F.sum("v").alias("v"), F.max(F.struct("v", (-F.col("px")).alias("px"))).alias("top"))
    b = runs.groupBy(*bar).agg(F.min("side").alias("side"), F.max("side").alias("other"), F.max(F.struct("n", (-F.col("lo")).alias("lo"), "hi", "v")).alias("r"), F.max("top").alias("top")).where("side = other")
    b = b.join(bars.select(*bar, "high", "low", "close"), bar)
    stack, buys = F.col("r.n") >= run, F.col("side") > 0
    edge = F.when(buys, -F.col("r.lo") <= F.col("low") + within).otherwise(F.col("r.hi") >= F.col("high") - within)
    of = lambda kind, px, n, v: F.struct(F.lit(kind).alias("kind"), px.cast("long").alias("flag_px"), n.cast("long").alias("run"), v.cast("long").alias("volume"))
    far = F.when(buys, -F.col("r.lo")).otherwise(F.col("r.hi"))
    kinds = F.array(of("single", -F.col("top.px"), F.lit(1), F.col("top.v")), F.when(stack, of("stacked", far, F.col("r.n"), F.col("r.v"))), F.when(stack & edge, of("extreme", far, F.col("r.n"), F.col("r.v"))))
    x = b.select(*bar, "side", F.col("close").alias("entry_px"), F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
    return x.select(*bar, (F.col("bar_us") + seconds * SECOND).alias("at_us"), "side", "entry_px", "k.*")
