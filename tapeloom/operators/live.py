"""The footprint of a bar as it fills: imbalances that come and go, what is confirmed when the bar closes, and signals from runs of them.

A flag is a price and a side whose volume outweighs the other side's a tick beyond it. A print at P can change four of these comparisons (both sides at P, the buyers
at P + 1, the sellers at P - 1) and, where it widens the bar's range, the one at the old edge, which wasn't judged before. So the whole life of all flags is a
table of comparisons, a few rows a print, with running sums per (bar, price, side): no bar is built anew for a print, and a hot instrument is dealt over its
bars and prices. A run of comparisons that hold is a flag's life.

signals() and the stream (streaming.live) walk prints with Bar, which keeps a bar's flags and the runs of adjacent ones up to date as flags come and go. Prints
without an aggressor take no part.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bars import SECOND, bucket
from .sequential import in_order

BAR, PAIR = ("instrument", "bar_us"), ("instrument", "bar_us", "side", "px")


@dataclass(frozen=True)
class Rule:
    """When a price is flagged: `ratio` times the volume opposite, `least` volume itself; empty: whether nothing opposite flags; edges: whether the bar's
    highest and lowest price, whose diagonal is outside it, are judged too."""

    ratio: float = 4.0
    least: int = 0
    empty: bool = True
    edges: bool = False


def compared(prints: DataFrame, seconds: int, rule: Rule = Rule()) -> DataFrame:
    """instrument, bar_us, us, seq, n, side (buy, sell), px, volume, against, own (whether it is of the print's own price), holds: each comparison that each
    print changes, in the order of seq and n, with the bar's sums up to it."""
    p = prints.where(F.col("side").isin("B", "A")).select("instrument", bucket("us", seconds).alias("bar_us"), "us", "seq", F.col("px_ticks").alias("at"), "sz", (F.col("side") == "B").alias("buys"))
    so_far = W.partitionBy(*BAR).orderBy("seq")
    upto, before = so_far.rowsBetween(W.unboundedPreceding, 0), so_far.rowsBetween(W.unboundedPreceding, -1)
    p = p.withColumns({"low": F.min("at").over(upto), "high": F.max("at").over(upto), "low0": F.min("at").over(before), "high0": F.max("at").over(before)})
    buys, zero = F.col("buys"), F.lit(0).cast("long")
    row = lambda side, px, volume, against, own: F.struct(F.lit(side).alias("side"), px.alias("px"), volume.alias("dv"), against.alias("da"), F.lit(own).alias("own"))
    bought, sold = F.when(buys, F.col("sz")).otherwise(zero), F.when(buys, zero).otherwise(F.col("sz"))
    rows = F.array(
        row("buy", F.col("at"), bought, zero, True), row("sell", F.col("at"), sold, zero, True), row("buy", F.col("at") + 1, zero, sold, False), row("sell", F.col("at") - 1, zero, bought, False),
        F.when(F.col("low") < F.col("low0"), row("buy", F.col("low0"), zero, zero, False)), F.when(F.col("high") > F.col("high0"), row("sell", F.col("high0"), zero, zero, False)),
    )
    t = p.select(*BAR, "us", "seq", "low", "high", F.posexplode(rows).alias("n", "x")).where("x is not null").select(*BAR, "us", "seq", "n", "low", "high", "x.*")
    w = W.partitionBy(*PAIR).orderBy("seq", "n").rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumns({"volume": F.sum("dv").over(w), "against": F.sum("da").over(w), "traded": F.max("own").over(w)})
    edge = F.lit(False) if rule.edges else F.when(F.col("side") == "buy", F.col("px") == F.col("low")).otherwise(F.col("px") == F.col("high"))
    beats = F.when(F.col("against") > 0, F.col("volume") >= rule.ratio * F.col("against")).otherwise(F.lit(rule.empty))
    holds = F.col("traded") & ~edge & (F.col("volume") > 0) & (F.col("volume") >= rule.least) & beats
    return t.select(*BAR, "us", "seq", "n", "side", "px", "volume", "against", "own", holds.alias("holds"))


def flags(tests: DataFrame, seconds: int) -> DataFrame:
    """The life of each flag: instrument, bar_us, side, px, first_us, ended_us, updates (comparisons that it has held in), volume, against, ratio and peak (null once
    there was nothing opposite), state: faded at ended_us, confirmed at the bar's end, or unconfirmed in an instrument's last bar. tests: compared()."""
    w = W.partitionBy(*PAIR).orderBy("seq", "n").rowsBetween(W.unboundedPreceding, 0)
    t = tests.withColumn("life", F.sum(F.when(F.col("holds"), 0).otherwise(1)).over(w))
    at, ratio = F.struct("seq", "n"), F.try_divide(F.col("volume"), F.col("against"))
    lives = t.where("holds").groupBy(*PAIR, "life").agg(F.min("us").alias("first_us"), F.count("*").alias("updates"), F.max_by("volume", at).alias("volume"), F.max_by("against", at).alias("against"), F.max(ratio).alias("peak"), F.count_if(ratio.isNull()).alias("bare"))
    fades = t.where("not holds").groupBy(*PAIR, F.col("life").alias("next")).agg(F.min("us").alias("faded_us"))
    last = tests.groupBy("instrument").agg(F.max("bar_us").alias("last_us"))
    x = lives.withColumn("next", F.col("life") + 1).join(fades, [*PAIR, "next"], "left").join(last, "instrument")
    state = F.when(F.col("faded_us").isNotNull(), "faded").when(F.col("bar_us") < F.col("last_us"), "confirmed").otherwise("unconfirmed")
    ended = F.coalesce("faded_us", F.when(F.col("bar_us") < F.col("last_us"), F.col("bar_us") + seconds * SECOND))
    return x.select(*PAIR, "first_us", ended.alias("ended_us"), "updates", "volume", "against", F.try_divide("volume", "against").alias("ratio"), F.when(F.col("bare") == 0, F.col("peak")).alias("peak"), state.alias("state"))


def pulse(prints: DataFrame, tests: DataFrame, seconds: int, window_s: int = 30) -> DataFrame:
    """What a bar shows after each print: prices, volume bought and sold, delta, delta and volume of the last window_s of the bar (prints of one time together), live
    flags by side, and diagonal: the delta of prints at prices that are flagged once the print is in."""
    w = W.partitionBy(*PAIR).orderBy("seq", "n")
    live = F.when(F.col("holds"), 1).otherwise(0)
    t = tests.withColumn("step", live - F.coalesce(F.lag(live).over(w), F.lit(0)))
    steps = t.groupBy(*BAR, "seq").agg(*(F.sum(F.when(F.col("side") == s, F.col("step")).otherwise(0)).alias(f"{s}_step") for s in ("buy", "sell")), F.max(F.col("own") & F.col("holds")).alias("on"))
    p = prints.where(F.col("side").isin("B", "A")).withColumn("bar_us", bucket("us", seconds)).join(steps, [*BAR, "seq"])
    bar = W.partitionBy(*BAR).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    near = W.partitionBy(*BAR).orderBy("us").rangeBetween(-window_s * SECOND, 0)
    signed = F.when(F.col("side") == "B", F.col("sz")).otherwise(-F.col("sz"))
    total = lambda c: F.sum(c).over(bar)
    return p.select(
        *BAR, "seq", "us", F.first("px_ticks").over(bar).alias("open"), F.max("px_ticks").over(bar).alias("high"), F.min("px_ticks").over(bar).alias("low"), F.col("px_ticks").alias("last"),
        total(F.when(F.col("side") == "B", F.col("sz")).otherwise(0)).alias("bought"), total(F.when(F.col("side") == "A", F.col("sz")).otherwise(0)).alias("sold"), total(signed).alias("delta"),
        F.sum(signed).over(near).alias("window_delta"), F.sum("sz").over(near).alias("window_volume"), F.count("*").over(bar).alias("prints"), total("buy_step").alias("buy_flags"), total("sell_step").alias("sell_flags"),
        total(F.when(F.col("on"), signed).otherwise(0)).alias("diagonal"), (F.col("us") - F.first("us").over(bar)).alias("age_us"),
    )


def pressure(delta: Column, volume: Column) -> Column:
    """Delta from -1 to 1; 0 where nothing traded."""
    return F.coalesce(F.try_divide(delta, volume), F.lit(0.0))


class Runs:
    """Prices next to each other, kept as runs while prices come and go: each run's ends point to one another."""

    def __init__(self) -> None:
        self.to: dict[int, int] = {}  # from a run's first price to its last
        self.back: dict[int, int] = {}

    def _put(self, a: int, b: int) -> None:
        if a <= b:
            self.to[a], self.back[b] = b, a

    def add(self, px: int) -> None:
        a, b = self.back.pop(px - 1, px), self.to.pop(px + 1, px)
        self._put(a, b)

    def remove(self, px: int) -> None:
        a = px if px in self.to else max(k for k, v in self.to.items() if k <= px <= v)
        b = self.to.pop(a)
        del self.back[b]
        self._put(a, px - 1)
        self._put(px + 1, b)


@dataclass
class Bar:
    """A bar under way: volume by price, live flags, their runs, and its deltas. flags: (side, px) to [first_us, first_seq, updates, volume, against, peak]."""

    rule: Rule
    low: int | None = None
    high: int | None = None
    raw: int = 0
    diagonal: int = 0
    start: int = 0
    levels: dict = field(default_factory=dict)
    flags: dict = field(default_factory=dict)
    runs: dict = field(default_factory=lambda: {"buy": Runs(), "sell": Runs()})

    def _holds(self, side: str, px: int) -> tuple[bool, int, int]:
        if px not in self.levels:
            return False, 0, 0
        up = side == "buy"
        volume, against = self.levels[px][0 if up else 1], self.levels.get(px - 1 if up else px + 1, (0, 0))[1 if up else 0]
        judged = self.rule.edges or px != (self.low if up else self.high)
        return judged and volume > 0 and volume >= self.rule.least and (volume >= self.rule.ratio * against if against else self.rule.empty), volume, against

    def _compare(self, side: str, px: int, us: int, seq: int):
        """The flag that this ends, if it does."""
        holds, volume, against = self._holds(side, px)
        flag = self.flags.get((side, px))
        if not holds:
            if flag:
                self.runs[side].remove(px)
                return self.flags.pop((side, px))
            return None
        ratio = volume / against if against else None
        if not flag:
            flag = self.flags[side, px] = [us, seq, 0, 0, 0, 0.0]
            self.runs[side].add(px)
        flag[2:] = [flag[2] + 1, volume, against, None if ratio is None or flag[5] is None else max(flag[5], ratio)]
        return None

    def add(self, us: int, seq: int, px: int, sz: int, buys: bool) -> list[tuple]:
        """Takes a print in; (side, px, flag) of what it ends."""
        low, high = self.low, self.high
        if low is None:
            self.start = us
        self.low, self.high = (px, px) if low is None else (min(low, px), max(high, px))
        bought, sold = self.levels.get(px, (0, 0))
        self.levels[px] = (bought + sz, sold) if buys else (bought, sold + sz)
        pairs = [("buy", px), ("sell", px), ("buy", px + 1), ("sell", px - 1)]
        pairs += [("buy", low)] * (low is not None and px < low) + [("sell", high)] * (high is not None and px > high)
        ended = [(*pair, flag) for pair in pairs if (flag := self._compare(*pair, us, seq))]
        signed = sz if buys else -sz
        self.raw += signed
        if ("buy", px) in self.flags or ("sell", px) in self.flags:
            self.diagonal += signed
        return ended

    def stacked(self, least: int) -> tuple[str, int, int] | None:
        """Side, first and last price of the longest run of `least` flags or more; of equals the side with the oldest flag, then the lowest."""
        found = [(b - a + 1, side, a, b) for side, runs in self.runs.items() for a, b in runs.to.items() if b - a + 1 >= least]
        if not found:
            return None
        oldest = {side: min((f[1], i) for i, ((s, _), f) in enumerate(self.flags.items()) if s == side) for side in {x[1] for x in found}}
        _, side, a, b = min(found, key=lambda x: (-x[0], oldest[x[1]], x[2]))
        return side, a, b


@dataclass(frozen=True)
class Gates:
    """A signal needs a run of `run` flags, one flag of its side's runs compared `updates` times, and cooldown_us since the last of its side."""

    run: int = 3
    updates: int = 1
    cooldown_us: int = 5 * SECOND


def fired(bar: Bar, gates: Gates, us: int, last: dict) -> tuple | None:
    """side, from, to, flags by side of the signal that the bar gives now; last: when each side gave one."""
    top = bar.stacked(gates.run)
    if not top:
        return None
    side, a, b = top
    if bar.diagonal * (1 if side == "buy" else -1) <= 0 or us - last.get(side, -(1 << 62)) < gates.cooldown_us:
        return None
    if not any(bar.flags[side, px][2] >= gates.updates for x, y in bar.runs[side].to.items() if y - x + 1 >= gates.run for px in range(x, y + 1)):
        return None
    buys = sum(s == "buy" for s, _ in bar.flags)
    return side, a, b, buys, len(bar.flags) - buys


def signals(prints: DataFrame, seconds: int, rule: Rule = Rule(), gates: Gates = Gates()) -> DataFrame:
    """seq, us, side, px, from_px, to_px, run, raw, diagonal, buy_flags, sell_flags, age_us of each signal: the longest run of flags, with which the bar's diagonal delta
    agrees. The cooldown carries over bars."""

    def step(rows):
        last: dict[str, int] = {}
        now, bar = None, Bar(rule)
        for us, seq, px, sz, side in rows:
            if us // (seconds * SECOND) != now:
                now, bar = us // (seconds * SECOND), Bar(rule)
            bar.add(us, seq, px, sz, side == "B")
            found = fired(bar, gates, us, last)
            if found:
                way, a, b, buys, sells = found
                last[way] = us
                yield seq, us, way, px, a, b, b - a + 1, bar.raw, bar.diagonal, buys, sells, us - bar.start

    rows = prints.where(F.col("side").isin("B", "A")).select("instrument", "us", "seq", "px_ticks", "sz", "side")
    return in_order(rows, step, "seq long, us long, side string, px long, from_px long, to_px long, run long, raw long, diagonal long, buy_flags long, sell_flags long, age_us long")
