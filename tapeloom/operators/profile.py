"""Volume at price: footprints, imbalances and stacks, point of control, value area, nodes, nesting of profiles.

Profiles are long tables (key, px, volume). Levels are aggregated with partial sums; runs of levels are islands (px less row number); only
the value area, whose greedy growth depends on each step, walks the levels of one profile in an array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bars import bucket


def footprint(prints: DataFrame, seconds: int) -> DataFrame:
    """instrument, bar_us, px, bid_vol (sold into the bid), ask_vol, total: prints of unknown aggressor count in the total alone."""
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("sz")).otherwise(0))
    return prints.groupBy("instrument", bucket("us", seconds).alias("bar_us"), F.col("px_ticks").alias("px")).agg(side("A").alias("bid_vol"), side("B").alias("ask_vol"), F.sum("sz").alias("total"))


def imbalances(levels: DataFrame, ratio: float, least: int) -> DataFrame:
    """levels with buy_flag (ask volume against the bid volume a tick below) and sell_flag (bid volume against the ask volume a
    tick above); a diagonal without volume flags, the bar's edges don't."""
    w = W.partitionBy("instrument", "bar_us").orderBy("px")
    below = F.when(F.lag("px").over(w) == F.col("px") - 1, F.lag("bid_vol").over(w)).otherwise(0)
    above = F.when(F.lead("px").over(w) == F.col("px") + 1, F.lead("ask_vol").over(w)).otherwise(0)
    whole = W.partitionBy("instrument", "bar_us")
    lo, hi = F.min("px").over(whole), F.max("px").over(whole)
    buy = (F.col("px") > lo) & (F.col("ask_vol") >= least) & (F.col("ask_vol") >= F.lit(ratio) * below)
    sell = (F.col("px") < hi) & (F.col("bid_vol") >= least) & (F.col("bid_vol") >= F.lit(ratio) * above)
    return levels.withColumns({"buy_flag": buy, "sell_flag": sell})


def stacked(flags: DataFrame, run: int) -> DataFrame:
    """Runs of `run` and more flagged prices next to each other: side, from_px, to_px, levels."""
    sides = [flags.where(f"{s}_flag").select("instrument", "bar_us", F.lit(s).alias("side"), "px") for s in ("buy", "sell")]
    f = sides[0].unionByName(sides[1])
    f = f.withColumn("island", F.col("px") - F.row_number().over(W.partitionBy("instrument", "bar_us", "side").orderBy("px")))
    g = f.groupBy("instrument", "bar_us", "side", "island").agg(F.min("px").alias("from_px"), F.max("px").alias("to_px"), F.count("*").alias("levels"))
    return g.where(F.col("levels") >= run).drop("island")


def point_of_control(levels: DataFrame, closes: DataFrame) -> DataFrame:
    """The price of most volume by bar (ties: nearest the close, then lower), and the bar's delta."""
    x = levels.join(closes.select("instrument", "bar_us", "close"), ["instrument", "bar_us"])
    key = F.struct(F.col("total"), -F.abs(F.col("px") - F.col("close")), -F.col("px"))
    return x.groupBy("instrument", "bar_us").agg(F.max_by("px", key).alias("poc"), F.sum(F.col("ask_vol") - F.col("bid_vol")).alias("delta"), F.count("*").alias("levels"))


def bar_profile(bars: DataFrame, key: list[str], rows_ticks: int) -> DataFrame:
    """Bar volume dealt over the price rows that the bar spans, by overlap with [low, high]; a bar without range is one row's."""
    lo, hi = F.floor(F.col("low") / rows_ticks), F.floor(F.col("high") / rows_ticks)
    b = bars.select(*key, "low", "high", "volume", F.explode(F.sequence(lo, hi)).alias("row"))
    overlap = F.least(F.col("high"), (F.col("row") + 1) * rows_ticks) - F.greatest(F.col("low"), F.col("row") * rows_ticks)
    part = F.when(F.col("high") == F.col("low"), F.lit(1.0)).otherwise(overlap / (F.col("high") - F.col("low")))
    return b.groupBy(*key, "row").agg(F.sum(F.col("volume") * part).alias("volume"))


def price_profile(prints: DataFrame, key: list[str], step: int) -> DataFrame:
    """Volume by rounded price: key, row, volume."""
    return prints.groupBy(*key, F.floor(F.col("px_ticks") / step).alias("row")).agg(F.sum("sz").alias("volume"))


def value_area(profile: DataFrame, key: list[str], share: float, up_first: bool = False) -> DataFrame:
    """key, poc (lowest row of most volume), val, vah, total: rows are added on the larger side, below on ties or, with up_first, above, until
    `share` of the volume is inside."""
    rows = profile.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("row", "volume"))).alias("rows"))
    rows = rows.withColumn("total", F.aggregate("rows", F.lit(0).cast("double"), lambda a, x: a + x["volume"]))
    top = F.array_max(F.transform("rows", lambda x: x["volume"]))
    rows = rows.withColumn("at", F.array_position(F.transform("rows", lambda x: x["volume"]), top).cast("int"))
    start = F.struct(F.col("at").alias("lo"), F.col("at").alias("hi"), F.element_at("rows", F.col("at"))["volume"].cast("double").alias("held"))
    volume = lambda i: F.coalesce(F.try_element_at("rows", i)["volume"], F.lit(-1)).cast("double")

    def grow(a, _):
        below = F.when(a["lo"] > 1, volume(F.greatest(a["lo"] - 1, F.lit(1)))).otherwise(F.lit(-1.0))
        above = volume(a["hi"] + 1)
        done = (a["held"] >= F.lit(share) * F.col("total")) | ((below < 0) & (above < 0))
        down = below > above if up_first else below >= above
        return F.struct((a["lo"] - F.when(~done & down, 1).otherwise(0)).alias("lo"), (a["hi"] + F.when(~done & ~down, 1).otherwise(0)).alias("hi"), (a["held"] + F.when(done, F.lit(0.0)).when(down, below).otherwise(above)).alias("held"))

    rows = rows.withColumn("area", F.aggregate("rows", start, grow))
    row = lambda c: F.element_at("rows", F.col(c))["row"]
    return rows.select(*key, row("at").alias("poc"), row("area.lo").alias("val"), row("area.hi").alias("vah"), "total")


def nodes(profile: DataFrame, key: list[str], high: float = 0.7, low: float = 0.3, reach: int = 4, valley: int = 12) -> DataFrame:
    """High and low volume nodes: rows of at least `high` of the peak's volume that none within `reach` rows exceeds, and traded rows of at most `low`
    of it that none within reach falls below, with `low` of the peak reached within `valley` rows on both sides. Of adjacent rows the heaviest stands for all."""
    w = W.partitionBy(*key).orderBy("row")
    peak = F.max("volume").over(W.partitionBy(*key))
    side = lambda a, b: F.coalesce(F.max("volume").over(w.rangeBetween(a, b)), F.lit(0))
    p = profile.where("volume > 0").withColumns({"peak": peak, "top": F.max("volume").over(w.rangeBetween(-reach, reach)), "bottom": F.min("volume").over(w.rangeBetween(-reach, reach)), "under": side(-valley, -1), "over": side(1, valley)})
    hvn = (F.col("volume") >= F.lit(high) * F.col("peak")) & (F.col("volume") >= F.col("top"))
    lvn = (F.col("volume") <= F.lit(low) * F.col("peak")) & (F.col("volume") <= F.col("bottom")) & (F.least("under", "over") >= F.lit(low) * F.col("peak"))
    n = p.withColumn("node", F.when(hvn, "hvn").when(lvn, "lvn")).where("node is not null")
    n = n.withColumn("run", F.col("row") - F.row_number().over(W.partitionBy(*key, "node").orderBy("row")))
    best = F.max_by(F.struct("row", "volume"), F.struct("volume", -F.col("row")))
    return n.groupBy(*key, "node", "run").agg(best.alias("b")).select(*key, "node", "b.row", "b.volume")


def nested(inner: DataFrame, outer: DataFrame, on: list[str], order: str, migrate: float = 4.0) -> DataFrame:
    """How an inner profile's value lies in an outer one's: wholly outside (BREAKOUT_), containing it (ENGULFING), over an edge (TESTING_), inside and moving
    towards an edge (MIGRATING_, when its POC has moved by `migrate` rows since the inner profile before and is in the outer fifths beyond), else NESTED.
    With the overlap, the place of the POC in outer value, the drift, and the volume against the profile before. inner, outer: value_area()."""
    o = outer.select(*on, F.col("val").alias("oval"), (F.col("vah") + 1).alias("ovah"))
    before = W.partitionBy("instrument").orderBy(order)
    i = inner.withColumns({"vah": F.col("vah") + 1, "drift": F.coalesce(F.col("poc") - F.lag("poc").over(before), F.lit(0)), "ratio": F.col("total") / F.lag("total").over(before), "poc": F.col("poc") + F.lit(0.5)})
    x = i.join(o, on)
    width, mid = F.col("ovah") - F.col("oval"), (F.col("ovah") + F.col("oval")) / 2
    overlap = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.least("vah", "ovah") - F.greatest("val", "oval")) / (F.col("vah") - F.col("val"))))
    edge = 0.4 * width / 2
    state = (
        F.when(F.col("val") > F.col("ovah"), "BREAKOUT_UP").when(F.col("vah") < F.col("oval"), "BREAKOUT_DOWN").when((F.col("val") <= F.col("oval")) & (F.col("vah") >= F.col("ovah")), "ENGULFING")
        .when((F.col("val") <= F.col("ovah")) & (F.col("ovah") <= F.col("vah")), "TESTING_VAH").when((F.col("val") <= F.col("oval")) & (F.col("oval") <= F.col("vah")), "TESTING_VAL")
        .when((F.col("poc") - mid >= edge) & (F.col("drift") >= migrate), "MIGRATING_UP").when((mid - F.col("poc") >= edge) & (F.col("drift") <= -migrate), "MIGRATING_DOWN").otherwise("NESTED")
    )
    trend = F.when(F.col("ratio") <= 0.7, "fading").when(F.col("ratio") >= 1.3, "building").otherwise("steady")
    return x.select("instrument", order, state.alias("state"), overlap.alias("overlap"), ((F.col("poc") - F.col("oval")) / width).alias("poc_place"), F.col("drift"), trend.alias("volume_trend"))


def rolling_profile(bars: DataFrame, seconds: int, rows_ticks: int, least: int = 10) -> DataFrame:
    """instrument, bar_us, row, volume: at each bar the profile of the bars of the trailing `seconds`, itself included, where they are more than `least`.
    Each bar's rows are copied to the bars that they serve by an equi-join on time buckets."""
    width = seconds * 1_000_000
    one = bar_profile(bars, ["instrument", "bar_us"], rows_ticks).withColumn("b", F.explode(F.array(F.floor(F.col("bar_us") / width), F.floor(F.col("bar_us") / width) + 1)))
    n = F.count("*").over(W.partitionBy("instrument").orderBy("bar_us").rangeBetween(-width, 0))
    at = bars.select("instrument", F.col("bar_us").alias("at_us"), n.alias("n"), F.floor(F.col("bar_us") / width).alias("b")).where(F.col("n") > least)
    x = at.join(one, ["instrument", "b"]).where((F.col("bar_us") <= F.col("at_us")) & (F.col("bar_us") >= F.col("at_us") - width))
    return x.groupBy("instrument", F.col("at_us").alias("bar_us"), "row").agg(F.sum("volume").alias("volume"))


def developing_profile(bars: DataFrame, session: str, rows_ticks: int, warmup: int) -> DataFrame:
    """instrument, bar_us, row, volume: at each bar the profile of its session's bars so far, from the warmup-th on. A session's bars are few, so they meet by it."""
    one = bar_profile(bars, ["instrument", session, "bar_us"], rows_ticks)
    nth = F.row_number().over(W.partitionBy("instrument", session).orderBy("bar_us"))
    at = bars.withColumn("nth", nth).where(F.col("nth") >= warmup).select("instrument", session, F.col("bar_us").alias("at_us"))
    x = at.join(one, ["instrument", session]).where(F.col("bar_us") <= F.col("at_us"))
    return x.groupBy("instrument", F.col("at_us").alias("bar_us"), "row").agg(F.sum("volume").alias("volume"))


def merged(profiles: DataFrame, key: list[str]) -> DataFrame:
    """Profiles added up to a coarser key: sums of sums."""
    return profiles.groupBy(*key, "row").agg(F.sum("volume").alias("volume"))
