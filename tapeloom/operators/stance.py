"""A stance (flat, long or short) from prints and books together: prices in a row that one side has won, volume there that bursts, and what rests in the way.

Each print must meet three conditions for a side. Stack: `run` prices next to each other whose signed volume so far is on that side. Burst: volume of the last
burst_us at those prices of at least `burst` times the median volume of the last `candles` candles, which roll by themselves, candle_us after the print that opened the last one.
Way: volume of the burst over `over` times what rests within `radius` on the other side of the book, or nothing resting there; without a book none.
All three for a side turn the stance to it; stack and burst of the other side alone end it.

The state of an instrument is a map of prices, a deque of recent prints with their volume by price, a few candles and the last book; a print costs the runs that it touches
and a few sums, not its history, nor the prints of the burst or the runs that there are.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .live import Runs
from .sequential import in_order


@dataclass(frozen=True)
class Conditions:
    run: int = 3
    burst_us: int = 100_000
    burst: float = 1.5
    candles: int = 20
    candle_us: int = 1_000_000
    radius: float = 16
    over: float = 1.2


class Longest(Runs):
    """Runs of which the longest, of equals the lowest, is at hand. Runs that are gone stay in the heap until they come up or outnumber those that are there."""

    def __init__(self) -> None:
        super().__init__()
        self.firsts: list[int] = []
        self.heap: list[tuple[int, int]] = []

    def _put(self, a: int, b: int) -> None:
        if a > b:
            return
        super()._put(a, b)
        i = bisect_left(self.firsts, a)
        if i == len(self.firsts) or self.firsts[i] != a:
            self.firsts.insert(i, a)
        heappush(self.heap, (a - b, a))
        if len(self.heap) > 64 + 4 * len(self.to):
            self.heap = [(a - b, a) for a, b in self.to.items()]
            heapify(self.heap)

    def _gone(self, a: int) -> None:
        del self.firsts[bisect_left(self.firsts, a)]

    def add(self, px: int) -> None:
        if px + 1 in self.to:
            self._gone(px + 1)
        super().add(px)

    def remove(self, px: int) -> None:
        a = self.firsts[bisect_right(self.firsts, px) - 1]
        self._gone(a)
        b = self.to.pop(a)
        del self.back[b]
        self._put(a, px - 1)
        self._put(px + 1, b)

    def longest(self) -> tuple[int, int] | None:
        """First and last price."""
        while self.heap:
            short, a = self.heap[0]
            if self.to.get(a) == a - short:
                return a, a - short
            heappop(self.heap)
        return None


class Volumes:
    """Volume by price, and its sum over any range of prices: sums of 2, 4, 8 and so on neighbours are kept up to 2^DEEP of them."""

    DEEP = 12

    def __init__(self) -> None:
        self.sums: list[dict] = [{} for _ in range(self.DEEP + 1)]

    def add(self, px: int, volume: int) -> None:
        for sums in self.sums:
            new = sums.get(px, 0) + volume
            if new:
                sums[px] = new
            else:
                sums.pop(px, None)
            px >>= 1

    def between(self, a: int, b: int) -> int:
        total = 0
        for sums in self.sums[:-1]:
            if a > b:
                return total
            if a & 1:
                total += sums.get(a, 0)
                a += 1
            if not b & 1:
                total += sums.get(b, 0)
                b -= 1
            a, b = a >> 1, b >> 1
        return total + sum(v for k, v in self.sums[-1].items() if a <= k <= b)


@dataclass
class Stance:
    """The state of an instrument."""

    rule: Conditions
    stance: int = 0
    opened: int | None = None
    volume: int = 0
    levels: dict = field(default_factory=dict)
    runs: dict = field(default_factory=lambda: {1: Longest(), -1: Longest()})
    recent: deque = field(default_factory=deque)
    volumes: Volumes = field(default_factory=Volumes)
    candles: deque = field(default_factory=deque)
    ordered: list = field(default_factory=list)
    bids: list = field(default_factory=list)
    asks: list = field(default_factory=list)

    def book(self, bids, asks) -> None:
        """The book from now on, (price, size) of each level."""
        self.bids, self.asks = list(bids or ()), list(asks or ())

    def candle(self, volume: int) -> None:
        self.candles.append(volume)
        insort(self.ordered, volume)
        if len(self.candles) > self.rule.candles:
            del self.ordered[bisect_left(self.ordered, self.candles.popleft())]

    def level(self, px: int, signed: int) -> None:
        """Adds to a price; it joins and leaves the runs of a side as its sign changes."""
        old = self.levels.get(px, 0)
        new = self.levels[px] = old + signed
        before, after = (old > 0) - (old < 0), (new > 0) - (new < 0)
        if before != after:
            if before:
                self.runs[before].remove(px)
            if after:
                self.runs[after].add(px)

    def _stack(self, side: int) -> tuple[int, int] | None:
        """The longest run of a side, of equals the lowest; None below the rule's."""
        found = self.runs[side].longest()
        return found if found and found[1] - found[0] + 1 >= self.rule.run else None

    def remember(self, us: int, px: int, sz: int) -> None:
        """A print of the burst."""
        self.recent.append((us, px, sz))
        self.volumes.add(px, sz)

    def _median(self) -> float:
        n = len(self.ordered)
        return (self.ordered[(n - 1) // 2] + self.ordered[n // 2]) / 2 if n else 0.0

    def add(self, us: int, px: int, sz: int, buys: bool) -> tuple | None:
        """Takes a print in. Where the stance changes: old, new, run, burst, median, resting."""
        rule = self.rule
        if self.opened is None or us - self.opened >= rule.candle_us:
            if self.opened is not None:
                self.candle(self.volume)
            self.opened, self.volume = us, 0
        self.volume += sz
        self.level(px, sz if buys else -sz)
        self.remember(us, px, sz)
        while self.recent[0][0] < us - rule.burst_us:
            _, old, gone = self.recent.popleft()
            self.volumes.add(old, -gone)
        median, met = self._median(), {}
        for side, facing in ((1, self.asks), (-1, self.bids)):
            stack = self._stack(side)
            burst = self.volumes.between(*stack) if stack else 0
            if not stack or median <= 0 or burst < rule.burst * median:
                continue
            rests = sum(s for p, s in facing if abs(p - px) <= rule.radius)
            met[side] = (bool(self.bids or self.asks) and (rests <= 0 or burst > rule.over * rests), stack[1] - stack[0] + 1, burst, rests)
        turn = next((side for side in (1, -1) if side in met and met[side][0]), 0)
        if turn and turn != self.stance:
            new, seen = turn, met[turn]
        elif self.stance and not turn and -self.stance in met:
            new, seen = 0, met[-self.stance]
        else:
            return None
        old, self.stance = self.stance, new
        return old, new, seen[1], seen[2], median, seen[3]


FIELDS = "seq long, us long, px long, old string, new string, run long, burst long, median double, resting long"
NAMES = {0: "flat", 1: "long", -1: "short"}


def told(seq: int, us: int, px: int, change: tuple) -> tuple:
    old, new, run, burst, median, rests = change
    return seq, us, px, NAMES[old], NAMES[new], run, burst, median, rests


def feed(prints: DataFrame, books: DataFrame) -> DataFrame:
    """Prints (instrument, us, seq, px_ticks, sz, side) and books (instrument, us, seq, bids, asks as array<struct<px,sz>>) as one feed: instrument, us, seq, o (0 a book,
    1 a print of the same us and seq after it), px, sz, buys, bids, asks. Prints without an aggressor or size take no part."""
    none = F.lit(None).cast("array<struct<px:bigint,sz:bigint>>")
    levels = lambda c: F.transform(c, lambda x: F.struct(x["px"].cast("long").alias("px"), x["sz"].cast("long").alias("sz")))
    p = prints.where(F.col("side").isin("B", "A") & (F.col("sz") > 0)).select("instrument", "us", "seq", F.lit(1).alias("o"), F.col("px_ticks").alias("px"), "sz", (F.col("side") == "B").alias("buys"), none.alias("bids"), none.alias("asks"))
    nothing = F.lit(None).cast("long")
    return p.unionByName(books.select("instrument", "us", "seq", F.lit(0).alias("o"), nothing.alias("px"), nothing.alias("sz"), F.lit(None).cast("boolean").alias("buys"), levels("bids").alias("bids"), levels("asks").alias("asks")))


def plain(rows: DataFrame) -> DataFrame:
    """feed() with the levels of a book as plain arrays, which cost less to hand to Python than structs."""
    return rows.select("instrument", "us", "seq", "o", "px", "sz", "buys", *(F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("bids", "asks") for c in ("px", "sz")))


def transitions(prints: DataFrame, books: DataFrame, rule: Conditions = Conditions()) -> DataFrame:
    """Each change of stance: instrument, seq, us, px, old, new, run, burst, median, resting."""

    def step(rows):
        state = Stance(rule)
        pairs = lambda px, sz: zip(px or (), sz or ())
        for us, seq, _, px, sz, buys, bid_px, bid_sz, ask_px, ask_sz in rows:
            if px is None:
                state.book(pairs(bid_px, bid_sz), pairs(ask_px, ask_sz))
            elif change := state.add(us, px, sz, buys):
                yield told(seq, us, px, change)

    return in_order(plain(feed(prints, books)), step, FIELDS, order=("us", "seq", "o"))
