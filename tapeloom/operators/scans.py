"""Reads that put several others together: agreement of three time frames, what was knowable at each bar, auction patterns, levels proposed from older signals and judged on newer
ones, and the price step of an instrument.

Each looks back alone: cutting off later bars changes no row (replay's `least` apart, which asks for a history). Conditions are columns over windows; only what depends
on what fired before, the re-arming of auction patterns, walks a session's rows in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.market import break_even
from ..functions.stats import Z95
from .bars import SECOND, bucket
from .sequential import in_order
from .structure import swings
from .zones import candidates


def price_step(bars: DataFrame, least: int = 20, floor: float = 1e-9) -> DataFrame:
    """instrument, tick: the smallest gap between prices that its bars have shown. Below `least` distinct prices a ten-thousandth of the price, to a power of ten."""
    px = bars.select("instrument", F.explode(F.array("open", "high", "low", "close")).alias("px")).where("px > 0").select("instrument", F.round("px", 10).alias("px")).distinct()
    gap = F.col("px") - F.lag("px").over(W.partitionBy("instrument").orderBy("px"))
    g = px.withColumn("gap", gap).groupBy("instrument").agg(F.count("*").alias("n"), F.min(F.when(F.col("gap") > floor, F.col("gap"))).alias("gap"), ((F.min("px") + F.max("px")) / 2).alias("mid"))
    relative = F.pow(F.lit(10.0), F.floor(F.log10(F.col("mid") * 1e-4)))
    return g.select("instrument", F.when(F.col("n") < least, relative).otherwise(F.coalesce("gap", F.lit(floor))).alias("tick"))


def row_height(bars: DataFrame, rows: int = 400, least: int = 20) -> DataFrame:
    """instrument, tick, height: a whole number of ticks, so that about `rows` rows span what was traded."""
    span = bars.groupBy("instrument").agg((F.max("high") - F.min("low")).alias("span"))
    steps = F.greatest(F.lit(1), F.floor(F.col("span") / rows / F.col("tick") + 0.999999))
    return span.join(price_step(bars, least), "instrument").select("instrument", "tick", (steps * F.col("tick")).alias("height"))


def agreement(bars: DataFrame, block_s: int, trade_s: int, buffer: float, hold: int, target: float, cost: float, skip: int = 1, least_stop: float = 1.0, hour_s: int | None = None, most_in_s: float | None = None) -> DataFrame:
    """Signals on trigger bars (instrument, bar_us, open, high, low, close): the block leans one way, the trade candle under way is of its colour, and the bar has
    a higher high and higher low than the one before (or both lower). One for each candle and side, the first.

    A block leans once `hold` closes in a row have been `buffer` from its open, until as many are on the other side. The first `skip` candles of a block and a key's first candle
    are left out. The stop is the candle's open, `least_stop` away at least. hour_s: a shorter block that must lean alike; most_in_s: how far into its candle a trigger may
    come. status: whether the candle closed in its colour; provisional while it is the last."""
    w = W.partitionBy("instrument").orderBy("bar_us")
    b = bars.withColumns({"block": bucket("bar_us", block_s), "candle": bucket("bar_us", trade_s), "high0": F.lag("high").over(w), "low0": F.lag("low").over(w), "first": F.min(bucket("bar_us", trade_s)).over(W.partitionBy("instrument"))})
    for name, size in (("lean", block_s), *((("hour_lean", hour_s),) if hour_s else ())):
        inside = W.partitionBy("instrument", "_k").orderBy("bar_us")
        b = b.withColumn("_k", bucket("bar_us", size)).withColumn("_o", F.first("open").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        side = F.when(F.col("close") - F.col("_o") >= buffer, 1).when(F.col("close") - F.col("_o") <= -buffer, -1).otherwise(0)
        b = b.withColumn("_s", side).withColumn("_new", F.when(F.coalesce(F.lag("_s").over(inside) == F.col("_s"), F.lit(False)), 0).otherwise(1))
        b = b.withColumn("_run", F.sum("_new").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        nth = F.row_number().over(W.partitionBy("instrument", "_k", "_run").orderBy("bar_us"))
        b = b.withColumn("_held", F.when((nth >= hold) & (F.col("_s") != 0), F.col("_s"))).withColumn(name, F.last("_held", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0))).drop("_k", "_o", "_s", "_new", "_run", "_held")
    b = b.withColumn("candle_open", F.first("open").over(W.partitionBy("instrument", "candle").orderBy("bar_us").rowsBetween(W.unboundedPreceding, 0)))
    up, down = (F.col("high") > F.col("high0")) & (F.col("low") > F.col("low0")), (F.col("high") < F.col("high0")) & (F.col("low") < F.col("low0"))
    long_, short = (F.col("lean") == 1) & (F.col("close") > F.col("candle_open")) & up, (F.col("lean") == -1) & (F.col("close") < F.col("candle_open")) & down
    nth, in_us = F.floor((F.col("bar_us") - F.col("block")) / (trade_s * SECOND)), F.col("bar_us") - F.col("candle")
    b = b.withColumns({"side": F.when(long_, "long").when(short, "short"), "nth": nth, "in_us": in_us, "stop_ticks": F.abs(F.col("close") - F.col("candle_open"))})
    b = b.where(F.col("side").isNotNull() & (F.col("nth") >= skip) & (F.col("candle") > F.col("first")) & (F.col("stop_ticks") >= least_stop))
    if hour_s:
        b = b.where("hour_lean = lean")
    if most_in_s is not None:
        b = b.where(F.col("in_us") <= most_in_s * SECOND)
    order = W.partitionBy("instrument", "candle", "side").orderBy("bar_us")
    b = b.withColumn("r", F.row_number().over(order)).where("r = 1")
    ends = bars.groupBy("instrument", bucket("bar_us", trade_s).alias("candle")).agg(F.max_by("close", "bar_us").alias("end"))
    last = bars.groupBy("instrument").agg(F.max("bar_us").alias("last_us"))
    held = F.when(F.col("side") == "long", F.col("end") > F.col("candle_open")).otherwise(F.col("end") < F.col("candle_open"))
    status = F.when(F.col("last_us") < F.col("candle") + trade_s * SECOND, "provisional").when(held, "confirmed").otherwise("withdrawn")
    s = F.when(F.col("side") == "long", 1).otherwise(-1)
    stop = F.col("stop_ticks").cast("double")
    return b.join(ends, ["instrument", "candle"]).join(last, "instrument").select(
        "instrument", "bar_us", "side", F.col("close").alias("entry"), (F.col("close") + s * target).alias("target"), F.col("candle_open").alias("stop"), "candle", F.col("nth").cast("long").alias("nth"), "in_us",
        (stop / (stop + target)).alias("driftless"), break_even(F.lit(float(target)), stop, F.lit(float(cost))).alias("breakeven"), status.alias("status"),
    )


def replay(bars: DataFrame, reach: int = 3, impulse_bps: float = 30.0, least: int = 80, step: int = 8) -> DataFrame:
    """What was knowable at each bar's close, and what the next bar did: instrument, bar_us, position, structure, zone, vwap (null where it says nothing, from -1 to 1), up, move_bps.

    position: where the close is in the bar; structure: the last two known highs and lows both rose or fell; zone: the newest supply or demand zone that holds the
    close, 0.8 while untested and 0.35 after (bars test a zone once a newer one is there); vwap: the close against the running average and two deviations about it.
    Instruments of fewer than `least` bars go."""
    w = W.partitionBy("instrument").orderBy("bar_us")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    sw = swings(bars, reach)
    sw = sw.withColumn("before", F.lag("px").over(W.partitionBy("instrument", "kind").orderBy("bar_us"))).where("confirmed_us is not null")
    news = sw.groupBy("instrument", F.col("confirmed_us").alias("bar_us")).agg(*(F.max(F.when(F.col("kind") == k, F.struct("px", "before"))).alias(k[0]) for k in ("high", "low")))
    x, v = F.col("high") + F.col("low") + F.col("close"), F.col("volume")  # three times the typical price
    b = bars.join(news, ["instrument", "bar_us"], "left").withColumns({
        "h": F.last("h", ignorenulls=True).over(so_far), "l": F.last("l", ignorenulls=True).over(so_far), "n": F.count("*").over(W.partitionBy("instrument")),
        "v0": F.sum(v).over(so_far), "v1": F.sum(x * v).over(so_far), "v2": F.sum(x * x * v).over(so_far), "next_open": F.lead("open").over(w), "next_close": F.lead("close").over(w),
    })
    # zones are born where both a high and a low are known
    both = b.where("h is not null and l is not null").select("instrument", F.col("bar_us").alias("at_us"))
    zones = candidates(bars, sw.drop("before"), impulse_bps).join(both, ["instrument", "at_us"], "left_semi").select("instrument", "at_us", "kind", "lo", "hi")
    zones = zones.withColumn("next_us", F.lead("at_us").over(W.partitionBy("instrument").orderBy("at_us"))).withColumn("_row", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor(F.col("hi") / step))))
    spans = bars.select("instrument", "bar_us", "high", "low", F.explode(F.sequence(F.floor(F.col("low") / step), F.floor(F.col("high") / step))).alias("_row"))
    tests = zones.join(spans, ["instrument", "_row"]).where("bar_us >= next_us and low <= hi and high >= lo").groupBy("instrument", "at_us").agg(F.min("bar_us").alias("tested_us"))
    held = b.select("instrument", "bar_us", "close", F.floor(F.col("close") / step).alias("_row")).join(zones, ["instrument", "_row"]).where("at_us <= bar_us and lo <= close and close <= hi")
    held = held.groupBy("instrument", "bar_us").agg(F.max(F.struct("at_us", "kind")).alias("z")).select("instrument", "bar_us", "z.at_us", F.col("z.kind").alias("zone_kind")).join(tests, ["instrument", "at_us"], "left")
    b = b.join(held, ["instrument", "bar_us"], "left")
    span = F.col("high") - F.col("low")
    off = (F.col("close") - F.col("low")) / span * 2 - 1
    rose, fell = (F.col("h.px") > F.col("h.before")) & (F.col("l.px") > F.col("l.before")), (F.col("h.px") < F.col("h.before")) & (F.col("l.px") < F.col("l.before"))
    mean = F.col("v1") / F.col("v0") / 3
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    sd = F.sqrt((exact("v2") * exact("v0") - exact("v1") * exact("v1")).cast("double")) / F.col("v0") / 3
    far = (F.col("close") - mean) / mean * 10_000
    strength = F.when(F.col("tested_us") <= F.col("bar_us"), 0.35).otherwise(0.8)
    b = b.where((F.col("n") >= least) & F.col("next_open").isNotNull()).select(
        "instrument", "bar_us", F.when((span > 0) & (F.abs(off) > 0.1), off).alias("position"), F.when(rose, 0.6).when(fell, -0.6).alias("structure"),
        F.when(F.col("zone_kind") == "supply", -strength).when(F.col("zone_kind") == "demand", strength).alias("zone"),
        F.when((F.col("v0") > 0) & (sd > 0), F.when(F.col("close") >= mean + 2 * sd, -0.7).when(F.col("close") <= mean - 2 * sd, 0.7).when(far > 5, 0.35).when(far < -5, -0.35)).alias("vwap"),
        (F.col("next_close") > F.col("next_open")).alias("up"), ((F.col("next_close") - F.col("next_open")) / F.col("next_open") * 10_000).alias("move_bps"),
    )
    return b.where("position is not null or structure is not null or zone is not null or vwap is not null")


def propose(cells: DataFrame, events: DataFrame, now: tuple[int, int], share: float = 0.6, least_fit: int = 60, least_test: int = 40, gain: float = 1.0) -> DataFrame:
    """One row: the target and stop that pay most a trade on the first `share` of the events, what they and those of `now` pay on the rest, with a 95 % interval, and why they aren't
    proposed (null if they are): few, same, small gain, interval. cells: outcomes.grid(); events: event_id, at_us. Equal pays go to the smaller target, then stop."""
    times = events.groupBy("at_us").agg(F.count("*").alias("c"))
    before, total = F.coalesce(F.sum("c").over(W.orderBy("at_us").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), F.sum("c").over(W.partitionBy())
    part = times.select("at_us", (before < F.floor(total * share)).alias("fit"))
    x = cells.join(events.select("event_id", "at_us"), "event_id").join(part, "at_us")
    g = x.groupBy("target", "stop").agg(*(f(F.when(F.col("fit") == p, F.col("net"))).alias(f"{q}_{n}") for p, q in ((True, "fit"), (False, "test")) for f, n in ((F.count, "n"), (F.avg, "pay"), (F.stddev_samp, "sd"))))
    e = Z95 * F.col("test_sd") / F.sqrt("test_n")
    one = F.struct("target", "stop", "fit_n", "fit_pay", "test_n", "test_pay", (F.col("test_pay") - e).alias("lo"), (F.col("test_pay") + e).alias("hi"))
    running = (F.col("target") == now[0]) & (F.col("stop") == now[1])
    r = g.agg(F.max_by(one, F.struct("fit_pay", -F.col("target"), -F.col("stop"))).alias("b"), F.max(F.when(running, F.col("test_pay"))).alias("now_pay")).select("b.*", "now_pay").where("target is not null")
    better = F.col("test_pay") - F.col("now_pay")
    why = F.when((F.col("fit_n") < least_fit) | (F.col("test_n") < least_test), "few").when((F.col("target") == now[0]) & (F.col("stop") == now[1]), "same").when(better < gain, "small gain").when(F.col("lo").isNull() | (F.col("lo") <= 0), "interval")
    return r.select("*", better.alias("gain"), why.alias("refused"))


#: Names of the patterns by side, in the order in which they are looked for.
LONG = ("VA_Breakout_Up", "LVN_Traversal_Up", "HVN_Rejection_Up", "Failed_Auction_Down", "POC_Reclaim")
SHORT = ("VA_Breakdown", "LVN_Traversal_Down", "HVN_Rejection_Down", "Failed_Auction_Up", "POC_Rejection")


def auction(bars: DataFrame, memory: int = 12, accept: int = 2, near: int = 2, rotation: int = 4, confirm: int = 12, rearm: int = 8) -> DataFrame:
    """bar_us, pattern, side, kind, node, entry, stop, target: at most one at each close, longs first, from bars (instrument, day_us, bar_us, open, high, low, close in ticks) beside the levels of
    the session before (val, vah, poc, hvn and lvn: ascending arrays).

    Breakout: balance until the bar before, now `accept` closes in a row beyond value, within `confirm` of its edge. Traversal: in imbalance, through a low-volume node.
    Rejection: a high-volume node tested within `near` and left. Failed auction: a close beyond value within `memory` bars, never accepted, now back inside; once an excursion.
    Reclaim: in balance, a close `rotation` beyond the POC, now as far on the other side. Shorts are the same with prices negated. A pattern comes again once price has been
    `rearm` from where it came last, or, a failed auction, after a close beyond the edge. Stop and target must lie on their sides of the entry."""
    day = W.partitionBy("instrument", "day_us").orderBy("bar_us")
    recent, tail = day.rowsBetween(-memory + 1, 0), day.rowsBetween(-accept + 1, 0)
    value = F.col("vah") > F.col("val")
    full = F.count("*").over(tail) == accept
    above, below = full & (F.min("close").over(tail) > F.col("vah")), full & (F.max("close").over(tail) < F.col("val"))
    b = bars.withColumns({"above": above, "below": below}).withColumn("state", F.when(value & F.col("above"), 1).when(value & F.col("below"), -1).otherwise(0))
    b = b.withColumn("was", F.coalesce(F.lag("state").over(day), F.lit(0)))

    def look(s: int, names: tuple[str, ...]) -> tuple[Column, Column]:
        """The first pattern that is there, with the failed auction and without; s is -1 for shorts."""
        m = lambda c: F.col(c) * s
        all_ = lambda c: F.transform(c, lambda y: y * s)
        c, poc = m("close"), m("poc")
        top, bottom = (m("vah"), m("val")) if s > 0 else (m("val"), m("vah"))
        low, high = (m("low"), m("high")) if s > 0 else (m("high"), m("low"))
        hvn, lvn = all_("hvn"), all_("lvn")
        hit = lambda i, kind, node, stop, target: F.struct(F.lit(names[i]).alias("pattern"), F.lit(kind).alias("kind"), (node * s).alias("node"), (stop * s).alias("stop"), (target * s).alias("target"))
        over = F.array_min(F.filter(F.concat(hvn, F.array(poc, top)), lambda y: y > c + 1))
        accepted_up, accepted_down = (F.col("above"), F.col("below")) if s > 0 else (F.col("below"), F.col("above"))
        edge, other = ("VAH", "VAL") if s > 0 else ("VAL", "VAH")
        one = F.when((F.col("was") == 0) & accepted_up & (c <= top + confirm), hit(0, edge, top, top - 1, F.coalesce(over, top + (top - bottom))))
        from_ = lambda n: F.coalesce(F.array_max(F.filter(hvn, lambda y: y < n)), F.when(bottom < n, bottom))
        across = lambda n: F.coalesce(F.array_min(F.filter(hvn, lambda y: y > n)), F.when(top > n, top))
        thin = F.filter(lvn, lambda n: ((F.abs(c - n) <= near) | ((low <= n) & (n <= high))) & (c > n) & from_(n).isNotNull() & (across(n) > c))
        two = F.when((F.col("state") == s) & (F.size(thin) > 0), hit(1, "LVN", F.get(thin, F.lit(0)), from_(F.get(thin, F.lit(0))) - 1, across(F.get(thin, F.lit(0)))))
        target = F.coalesce(over, top)
        thick = F.filter(hvn, lambda n: (n < c) & (low <= n + near) & (c > n + 1) & (target > c))
        three = F.when(F.size(thick) > 0, hit(2, "HVN", F.get(thick, F.lit(0)), F.get(thick, F.lit(0)) - 1, target))
        broke = F.min(F.when(c < bottom, low)).over(recent)
        inside = F.when(poc > c, poc).otherwise(top)
        four = F.when(~accepted_down & (bottom < c) & (c <= bottom + confirm) & (broke < bottom) & (inside > c), hit(3, other, bottom, broke - 1, inside))
        dipped = F.min(c).over(recent) <= poc - rotation
        five = F.when((F.col("state") == 0) & dipped & c.between(poc + rotation, poc + confirm) & (top > c), hit(4, "POC", poc, poc - 1, top))
        return F.coalesce(one, two, three, four, five), F.coalesce(one, two, three, five)

    (lw, lo), (sw, so) = look(1, LONG), look(-1, SHORT)
    rows = b.select("instrument", "day_us", "bar_us", "close", "val", "vah", lw.alias("lw"), lo.alias("lo"), sw.alias("sw"), so.alias("so"))

    def step(rows):
        came: dict[str, int] = {}
        settled: set[str] = set()
        for at, close, val, vah, *found in rows:
            for name, beyond in ((LONG[3], close < val), (SHORT[3], close > vah)):
                if beyond:
                    came.pop(name, None)
                    settled.discard(name)
            for side, names, (first, rest) in (("long", LONG, found[:2]), ("short", SHORT, found[2:])):
                x = rest if names[3] in settled else first
                if x and abs(close - came.get(x["pattern"], close + rearm)) >= rearm and min(x["stop"], x["target"]) < close < max(x["stop"], x["target"]) and (x["stop"] < close) == (side == "long"):
                    came[x["pattern"]] = close
                    if x["pattern"] == names[3]:
                        settled.add(names[3])
                    yield at, x["pattern"], side, x["kind"], x["node"], close, x["stop"], x["target"]
                    break

    return in_order(rows, step, "bar_us long, pattern string, side string, kind string, node long, entry long, stop long, target long", ("instrument", "day_us"), ("bar_us",))
