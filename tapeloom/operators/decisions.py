"""What lies ahead of an entry, and whether a trade is proposed there or which gate refuses it.

Each is columns within a row: a book is an array of its levels, a profile brings only the few prices that hold a stated share of it, so no entry meets a
level by a join. Proposals need no search for the smallest target that pays: the rate it must win falls as the target grows, so it has a closed form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.verdicts import exit_reason

OBSTACLE = "array<struct<bps:double,kind:string,px:double,size:double>>"


def walls(profile: DataFrame, key: list[str], share: float = 0.12) -> DataFrame:
    """By key, the prices that hold at least `share` of its volume, as walls: array<struct<px,size>>; at most 1 / share of them. profile: key, px, total."""
    whole = profile.groupBy(*key).agg(F.sum("total").alias("_whole"))
    p = profile.join(whole, key).where((F.col("_whole") > 0) & (F.col("total") >= F.col("_whole") * share))
    return p.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("px", F.col("total").alias("size")))).alias("walls"))


def extremes(bars: DataFrame, back: int = 20, least: int = 3) -> DataFrame:
    """bars with swing_high and swing_low of the `back` bars before, null where these are fewer than `least`."""
    before = W.partitionBy("instrument").orderBy("bar_us").rowsBetween(-back, -1)
    enough = F.count("*").over(before) >= least
    return bars.withColumns({"swing_high": F.when(enough, F.max("high").over(before)), "swing_low": F.when(enough, F.min("low").over(before))})


def runway(entries: DataFrame, reach_bps: float = 200.0, multiple: float = 3.0) -> DataFrame:
    """entries with obstacles (ahead and within reach_bps, nearest first), clear_bps (way to the first that blocks, else reach_bps), open_road and first_kind.

    entries: side (long, short), entry, bids, asks (array<struct<px,sz>>), walls (array<struct<px,size>>), swing_high, swing_low, cluster_px, cluster_size; each
    may be null. A resting level is a shelf from `multiple` times the mean notional of the levels ahead, where these are three or more. Forced
    liquidations (cluster) are told but don't block. An entry that is null or not above 0 has no obstacle and a clear way of 0."""
    long, entry = F.col("side") == "long", F.col("entry").cast("double")
    bps = lambda px: F.abs(px - entry) / entry * 1e4
    near = lambda px: F.coalesce((entry > 0) & F.when(long, px > entry).otherwise(px < entry) & (bps(px) <= reach_bps), F.lit(False))
    one = lambda kind, px, size: F.struct(bps(px).alias("bps"), F.lit(kind).alias("kind"), px.cast("double").alias("px"), size.cast("double").alias("size"))
    none = F.array().cast(OBSTACLE)

    levels = F.filter(F.when(long, F.col("asks")).otherwise(F.col("bids")), lambda x: near(x["px"]))
    e = entries.withColumn("_ahead", F.transform(levels, lambda x: F.struct(x["px"].alias("px"), (x["px"] * x["sz"]).cast("double").alias("size"))))
    sizes = F.filter("_ahead", lambda x: x["size"] > 0)
    mean = F.try_divide(F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x["size"]), F.size(sizes))
    e = e.withColumn("_mean", F.when(F.size("_ahead") >= 3, mean))
    shelves = F.transform(F.filter("_ahead", lambda x: F.coalesce(x["size"] >= F.col("_mean") * multiple, F.lit(False))), lambda x: one("shelf", x["px"], x["size"]))
    heavy = F.transform(F.filter("walls", lambda x: near(x["px"])), lambda x: one("volume", x["px"], x["size"]))
    swing = F.when(long, F.col("swing_high")).otherwise(F.col("swing_low"))
    turn = F.when(near(swing), F.array(one("structure", swing, F.lit(0.0)))).otherwise(none)
    forced = F.when(near(F.col("cluster_px")) & (F.col("cluster_size") > 0), F.array(one("liquidation", F.col("cluster_px"), F.col("cluster_size")))).otherwise(none)

    e = e.withColumn("obstacles", F.array_sort(F.concat(*(F.coalesce(x.cast(OBSTACLE), none) for x in (shelves, heavy, turn, forced)))))
    first = F.get(F.filter("obstacles", lambda x: x["kind"] != "liquidation"), F.lit(0))
    stands = F.coalesce(entry > 0, F.lit(False))
    return e.withColumns({
        "clear_bps": F.when(stands, F.coalesce(first["bps"], F.lit(reach_bps))).otherwise(0.0), "open_road": stands & first.isNull(), "first_kind": first["kind"],
    }).drop("_ahead", "_mean")


def typical_range(bars: DataFrame, back: int = 20, least: int = 5) -> DataFrame:
    """bars with bar_bps, the median range of the `back` bars before in basis points of their middle; null where fewer than `least` have one."""
    before = W.partitionBy("instrument").orderBy("bar_us").rowsBetween(-back, -1)
    b = bars.withColumn("_r", F.when((F.col("low") > 0) & (F.col("high") >= F.col("low")), (F.col("high") - F.col("low")) / ((F.col("high") + F.col("low")) / 2) * 1e4))
    return b.withColumn("bar_bps", F.when(F.count("_r").over(before) >= least, F.percentile("_r", F.lit(0.5)).over(before))).drop("_r")


def _slip(levels: Column, mid: Column, notional: float) -> Column:
    """Basis points from the mid to the average price of filling `notional`; null where the levels don't hold it."""
    start = F.struct(F.lit(0.0).alias("paid"), F.lit(0.0).alias("got"))

    def fill(a: Column, x: Column) -> Column:
        take = F.greatest(F.least((x["px"] * x["sz"]).cast("double"), notional - a["paid"]), F.lit(0.0))
        return F.struct((a["paid"] + take).alias("paid"), (a["got"] + F.coalesce(F.try_divide(take, x["px"]), F.lit(0.0))).alias("got"))

    done = F.aggregate(levels, start, fill)
    return F.when(done["paid"] >= notional * (1 - 1e-12), F.abs(done["paid"] / done["got"] - mid) / mid * 1e4)


def rate_needed(target: Column, risk: Column, cost: Column) -> Column:
    """The share of wins that pays for the losses and the cost."""
    return F.when(target + risk > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (risk + cost) / (target + risk)))).otherwise(1.0)


def suggest(
    entries: DataFrame, bar_s: float, scalp: bool = False, notional: float = 10_000.0, fee_bps: float = 0.0, least_samples: int = 5, least_conviction: float = 0.45,
    least_left_s: float = 20.0, least_cost_x: float = 2.0, least_rr: float = 1.5, most_rate: float = 0.7, capture: float = 0.5, most_range: float = 0.8,
    bar_risk: float = 0.15, scalp_risk: float = 0.8, most_risk_x: float = 2.5,
) -> DataFrame:
    """entries with gate (the first check that refuses, null where a trade is proposed), side, entry, tick, target_px, stop_px, target_bps, risk_bps, cost_bps and capped.

    entries: samples, bids, asks (array<struct<px,sz>>, best first), direction (up, down, flat), verdict (conflict, unconfirmed or confirmed), backed,
    conviction, left_s (seconds left of the bar), bar_bps (typical_range). A null fails the check that reads it. The prices of a refused row are null from the first
    gate that they need.

    A range trade aims for `capture` of what the bar has left, by the root of time, and stops behind the largest resting level of its own side or further. A scalp
    aims for the nearest tick that pays: the rate it needs falls with the target for each of the stops it may have, fixed or in proportion, and its stop is
    max(floor, scalp_risk * target, min(most_risk_x * target, shelf)), so the least target is a max and a min of one bound for each."""
    px = lambda side, i: F.get(side, F.lit(i))["px"].cast("double")
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    gaps = lambda c: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), lambda i: F.abs(F.get(c, i)["px"] - F.get(c, i - 1)["px"]).cast("double")), lambda x: x > 0)
    long = F.col("direction") == "up"
    e = entries.withColumns({"_bid": px("bids", 0), "_ask": px("asks", 0), "side": F.when(long, "long").when(F.col("direction") == "down", "short")})
    e = e.withColumns({
        "entry": F.when(long, F.col("_ask")).otherwise(F.col("_bid")), "_spread": F.greatest(F.col("_ask") - F.col("_bid"), F.lit(0.0)), "_mid": (F.col("_ask") + F.col("_bid")) / 2,
        "tick": F.coalesce(F.array_min(F.concat(gaps("bids"), gaps("asks"))), F.col("_ask") - F.col("_bid")), "_own": F.when(long, F.col("bids")).otherwise(F.col("asks")),
        "_left_bps": F.col("bar_bps") * F.sqrt(F.least(F.col("left_s") / bar_s, F.lit(1.0))),
    })
    body = F.when(F.size("_own") > 1, F.slice("_own", 2, F.greatest(F.size("_own") - 1, F.lit(1)))).otherwise(F.col("_own"))
    big = F.array_max(F.transform(body, lambda x, i: F.struct((x["px"] * x["sz"]).cast("double").alias("n"), (-i).alias("i"), x["px"].cast("double").alias("px"))))["px"]
    e = e.withColumns({
        "_shelf": F.abs(F.col("entry") - (big - F.when(long, F.col("tick")).otherwise(-F.col("tick")))), "_hard": F.greatest(3 * F.col("_spread"), 2 * F.col("tick")),
        "cost_bps": _slip(F.col("asks"), F.col("_mid"), notional) + _slip(F.col("bids"), F.col("_mid"), notional) + max(fee_bps, 0.0),
    })
    entry, tick, cost, left = F.col("entry"), F.col("tick"), F.col("cost_bps"), F.col("_left_bps")
    to_bps = lambda d: d / entry * 1e4
    ticks = lambda b: b / 1e4 * entry / tick
    if scalp:
        hard, shelf = to_bps(F.col("_hard")), to_bps(F.col("_shelf"))
        fixed = lambda r: (cost + r * (1 - most_rate)) / most_rate

        def part(x: float) -> Column:
            d = most_rate * (1 + x) - x
            return cost / d if d > 0 else F.lit(float("inf"))

        pays = F.greatest(fixed(hard), part(scalp_risk), F.least(fixed(shelf), part(most_risk_x)))
        first = F.greatest(F.lit(1.0), F.ceil(ticks(cost * least_cost_x)).cast("double"))
        steps = F.greatest(first, F.when(pays < 1e12, F.ceil(ticks(pays) - 1e-9).cast("double")))
        e = e.withColumns({"_steps": F.when(pays < 1e12, steps), "_most": F.greatest(first, F.floor(ticks(left * most_range)).cast("double"))})
        e = e.withColumn("target_bps", F.col("_steps") * tick / entry * 1e4)
        floor = F.greatest(F.col("_hard"), entry * F.col("target_bps") * scalp_risk / 1e4)
        cap = entry * F.col("target_bps") * most_risk_x / 1e4
        e = e.withColumns({"capped": F.col("_shelf") > F.greatest(cap, floor), "_risk": F.greatest(floor, F.least(cap, F.col("_shelf")))})
        too_much = F.col("_steps").isNull() | (F.col("_steps") > F.col("_most"))
    else:
        e = e.withColumn("_steps", F.greatest(F.lit(1.0), F.rint(ticks(left * capture)))).withColumn("target_bps", F.col("_steps") * tick / entry * 1e4)
        e = e.withColumns({"capped": F.lit(False), "_risk": F.greatest(F.col("_shelf"), F.col("_hard"), entry * F.col("bar_bps") * bar_risk / 1e4)})
        too_much = F.lit(False)
    sign = F.when(long, 1.0).otherwise(-1.0)
    e = e.withColumns({"target_px": entry + sign * F.col("_steps") * tick, "stop_px": entry - sign * F.col("_risk"), "risk_bps": to_bps(F.col("_risk"))})

    fails = lambda holds: ~F.coalesce(holds, F.lit(False))
    gate = exit_reason(
        ("warming", fails(F.col("samples") >= least_samples)), ("no book", (count("bids") < 1) & (count("asks") < 1)), ("one sided", (count("bids") < 1) | (count("asks") < 1)),
        ("no book", fails((F.col("_bid") > 0) & (F.col("_ask") > 0))), ("locked", F.col("_ask") <= F.col("_bid")), ("flat", F.col("side").isNull()), ("conflict", F.col("verdict") == "conflict"),
        ("unconfirmed", fails(F.col("verdict") == "confirmed")), ("unsettled", F.lit(scalp) & fails(F.col("backed"))), ("conviction", fails(F.col("conviction") >= least_conviction)),
        ("too late", fails(F.col("left_s") >= least_left_s)), ("no range", fails(F.col("bar_bps") > 0)), ("no tick", fails(tick > 0)), ("depth", cost.isNull()), ("no cost", fails(cost > 0)),
        ("breakeven", too_much), ("no target", fails((F.col("target_px") > 0) & (F.col("stop_px") > 0))), ("no room", F.col("target_bps") > left * most_range), ("cost", F.col("target_bps") < cost * least_cost_x),
        ("shape", F.lit(not scalp) & (F.col("target_bps") / F.col("risk_bps") < least_rr)),
    )
    e = e.withColumn("gate", gate)
    early = ("warming", "no book", "one sided", "locked", "flat", "conflict", "unconfirmed", "unsettled", "conviction", "too late", "no range", "no tick")
    priced = F.col("gate").isNull() | ~F.col("gate").isin(*early)
    aimed = F.col("gate").isNull() | ~F.col("gate").isin(*early, "depth", "no cost", "breakeven")
    e = e.withColumns({c: F.when(priced, F.col(c)) for c in ("entry", "tick", "cost_bps")} | {c: F.when(aimed, F.col(c)) for c in ("target_px", "stop_px", "target_bps", "risk_bps", "capped")})
    return e.drop(*(c for c in e.columns if c in ("_bid", "_ask", "_spread", "_mid", "_own", "_left_bps", "_shelf", "_hard", "_steps", "_most", "_risk")))
