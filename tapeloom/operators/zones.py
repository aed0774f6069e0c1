"""Supply and demand zones, and turns that aren't settled yet.

Zones are found by windows and one pass over each instrument's candidates, newest first, that keeps a few; only what is kept meets the bars again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .outcomes import range_join
from .sequential import in_order


def by_bar():
    return W.partitionBy("instrument").orderBy("bar_us")


def candidates(bars: DataFrame, swings: DataFrame, impulse_bps: float, back: int = 11) -> DataFrame:
    """instrument, at_us, kind, origin_us, lo, hi, impulse: where a close is beyond the last known swing, the last candle of the other colour within `back`
    bars before: its body's far edge to its far end. swings: instrument, bar_us, confirmed_us, kind, px."""
    known = swings.select("instrument", F.col("confirmed_us").alias("bar_us"), *(F.when(F.col("kind") == k, F.struct(F.col("bar_us").alias("at"), "px")).alias(k) for k in ("high", "low")))
    known = known.groupBy("instrument", "bar_us").agg(F.max("high").alias("new_high"), F.max("low").alias("new_low"))
    w = by_bar().rowsBetween(W.unboundedPreceding, 0)
    b = bars.join(known, ["instrument", "bar_us"], "left")
    # of the swings known, the latest by their own bar
    b = b.withColumns({"sh": F.max("new_high").over(w), "sl": F.max("new_low").over(w)})
    candle = F.struct("bar_us", "open", "high", "low", "close")
    prior = by_bar().rowsBetween(-back, -1)
    b = b.withColumns({"up": F.last(F.when(F.col("close") > F.col("open"), candle), ignorenulls=True).over(prior), "down": F.last(F.when(F.col("close") < F.col("open"), candle), ignorenulls=True).over(prior)})
    b = b.withColumn("kind", F.when(F.col("close") < F.col("sl.px"), "supply").when(F.col("close") > F.col("sh.px"), "demand")).where("kind is not null")
    supply = F.col("kind") == "supply"
    b = b.withColumn("o", F.when(supply, F.col("up")).otherwise(F.col("down"))).where("o is not null")
    lo, hi = F.when(supply, F.greatest("o.open", "o.close")).otherwise(F.col("o.low")), F.when(supply, F.col("o.high")).otherwise(F.least("o.open", "o.close"))
    flat = hi <= lo
    b = b.select("instrument", F.col("bar_us").alias("at_us"), "kind", F.col("o.bar_us").alias("origin_us"), F.when(flat, F.col("o.low")).otherwise(lo).alias("lo"), F.when(flat, F.col("o.high")).otherwise(hi).alias("hi"), "close").where("hi > lo")
    impulse = F.abs(F.col("close") - (F.col("lo") + F.col("hi")) / 2) / ((F.col("lo") + F.col("hi")) / 2) * 10_000
    return b.withColumn("impulse", impulse).where(F.col("impulse") >= impulse_bps).drop("close")


def zones(bars: DataFrame, swings: DataFrame, impulse_bps: float, limit: int = 8) -> DataFrame:
    """The newest zones of each instrument that overlap none newer of their kind, `limit` at most, and how many bars since have traded in them."""

    def step(rows):
        kept: list[tuple] = []
        for _, _, kind, origin, at, lo, hi, impulse in rows:
            if len(kept) < limit and not any(k == kind and a <= hi and lo <= z for k, a, z in kept):
                kept.append((kind, lo, hi))
                yield kind, origin, at, lo, hi, impulse

    # newest origin first; of one origin the first break
    found = candidates(bars, swings, impulse_bps).select("instrument", (-F.col("origin_us")).alias("o1"), F.col("at_us").alias("o2"), "kind", "origin_us", "at_us", "lo", "hi", "impulse")
    kept = in_order(found, step, "kind string, origin_us long, at_us long, lo long, hi long, impulse double", order=("o1", "o2"))
    later = bars.select("instrument", "bar_us", "high", "low").join(kept, "instrument").where((F.col("bar_us") > F.col("at_us")) & (F.col("low") <= F.col("hi")) & (F.col("high") >= F.col("lo")))
    tested = later.groupBy("instrument", "kind", "origin_us").agg(F.count("*").alias("tested"))
    return kept.join(tested, ["instrument", "kind", "origin_us"], "left").withColumn("tested", F.coalesce("tested", F.lit(0)))


def provisional(bars: DataFrame, left: int, right: int) -> DataFrame:
    """Turns among the last `right` bars, which no pivot can be confirmed in: extremes against `left` bars before and whatever has come since."""
    w = by_bar()
    last = F.row_number().over(W.partitionBy("instrument").orderBy(F.desc("bar_us")))
    before, after = w.rowsBetween(-left, -1), w.rowsBetween(1, W.unboundedFollowing)
    full = F.count("*").over(before) == left
    b = bars.withColumns({"age": last - 1, "is_high": full & (F.max("high").over(before) <= F.col("high")) & F.coalesce(F.max("high").over(after) < F.col("high"), F.lit(True)), "is_low": full & (F.min("low").over(before) >= F.col("low")) & F.coalesce(F.min("low").over(after) > F.col("low"), F.lit(True))})
    kinds = F.explode(F.filter(F.array(F.when(F.col("is_high"), F.struct(F.lit("high").alias("kind"), F.col("high").alias("px"))), F.when(F.col("is_low"), F.struct(F.lit("low").alias("kind"), F.col("low").alias("px")))), lambda x: x.isNotNull()))
    return b.where(F.col("age") < right).select("instrument", "bar_us", F.col("age").cast("long").alias("age"), kinds.alias("k")).select("instrument", "bar_us", "age", "k.*")


def touch_outcomes(touches: DataFrame, bars: DataFrame, horizon_us: int, touch: int, rearm: int, through: int, reject: int, go: int) -> DataFrame:
    """What became of each touch of a price (event_id, instrument, at_us, level, up: whether it was come to from below) over the bars that begin within
    horizon_us.

    A leg lasts until a close that has been over `rearm` away is back within `touch`; mfe and mae are its excursions, and a bar after it stands for the leg's last
    one. reject: `reject` ticks back before any close `through` ticks beyond; break_fail: after such a close, one as far back; break_go: after such a
    close, `go` ticks, if no close back came before or with it; else stall. Each is the first bar of its kind in the touch's path."""
    b = bars.select("instrument", F.col("bar_us").alias("us"), F.col("bar_us").alias("seq"), F.struct("bar_us", "high", "low", "close").alias("px"))
    x = range_join(touches.withColumn("at_us", F.col("at_us") - 1), b, horizon_us).groupBy("event_id").agg(F.first(F.struct((F.col("at_us") + 1).alias("at"), "level", "up")).alias("t"), F.array_sort(F.collect_list("px")).alias("bars"))
    level, up = F.col("t.level"), F.col("t.up")
    ahead = lambda b: F.struct(F.when(up, b["high"] - level).otherwise(level - b["low"]).alias("fav"), F.when(up, level - b["low"]).otherwise(b["high"] - level).alias("adv"), F.when(up, b["close"] - level).otherwise(level - b["close"]).alias("past"), b["bar_us"].alias("us"))
    first = lambda rule: F.array_position(F.transform("path", lambda b, i: F.coalesce(rule(b, i + 1), F.lit(False))), True)  # noqa: E731  from 1 on; 0: none
    x = x.select("event_id", F.col("t.at").alias("at"), F.transform("bars", ahead).alias("path"))
    x = x.withColumn("left", first(lambda b, i: F.abs(b["past"]) > rearm)).withColumn("through", first(lambda b, i: b["past"] >= through))
    x = x.withColumn("end", first(lambda b, i: (F.col("left") > 0) & (i > F.col("left")) & (F.abs(b["past"]) <= touch)))
    x = x.withColumn("leg", F.when(F.col("end") > 0, F.col("end") - 1).otherwise(F.size("path")).cast("int"))
    of_leg = lambda i: F.element_at("path", F.least(i.cast("int"), F.col("leg")))
    best = lambda of, n: F.greatest(F.lit(0), F.array_max(F.transform(F.slice("path", F.lit(1), F.least(n.cast("int"), F.col("leg"))), lambda b: b[of])))
    broken = F.col("through") > 0
    x = x.withColumn("reject", first(lambda b, i: (of_leg(i)["adv"] >= reject) & (~broken | (i < F.col("through")))))
    x = x.withColumn("back", first(lambda b, i: broken & (i > F.col("through")) & (b["past"] <= -through))).withColumn("go", first(lambda b, i: broken & (i > F.col("through")) & (of_leg(i)["fav"] >= go)))
    failed = (F.col("back") > 0) & ((F.col("go") == 0) | (F.col("back") <= F.col("go")))
    label = F.when(F.col("reject") > 0, "reject").when(failed, "break_fail").when(F.col("go") > 0, "break_go").otherwise("stall")
    x = x.withColumns({"label": label, "mfe": best("fav", F.col("leg")), "mae": best("adv", F.col("leg"))})
    at = F.when(F.col("label") == "reject", F.col("reject")).when(F.col("label") == "break_fail", F.col("back")).when(F.col("label") == "break_go", F.col("go")).cast("int")
    x = x.withColumn("n", at)
    one = F.greatest("n", F.lit(1))
    dist = F.when(F.col("label") == "reject", of_leg(one)["adv"]).when(F.col("label") == "break_fail", best("fav", one)).when(F.col("label") == "break_go", of_leg(one)["fav"]).otherwise(F.col("mfe"))
    took = F.when(F.col("n").isNull(), F.lit(horizon_us)).otherwise(F.element_at("path", one)["us"] - F.col("at"))
    return x.select("event_id", "label", dist.cast("long").alias("dist"), took.cast("long").alias("took_us"), F.col("mfe").cast("long").alias("mfe"), F.col("mae").cast("long").alias("mae"), (F.col("end") > 0).alias("returned"))
