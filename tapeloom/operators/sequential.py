"""Operators whose next step depends on their own last decision: threshold bars, zigzags, averages over uneven time, thinning, walks.

No window can express them. in_order() deals the rows by key, sorts them within the partitions, and lets a generator walk each key's rows as Arrow
batches stream by: its state is its local variables, carried over days for as long as the key lasts, and a task holds one batch, not a key's history. Where an
operator starts anew at a boundary (a session, a contract), that is part of the key. The same generators would serve a stream's state.

A key is one task, since each step waits for the one before; more instruments or sessions make more tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bars import SECOND

#: Rows that a generator gives are sent on in batches of this many.
BATCH = 10_000


def in_order(df: DataFrame, step: Callable[[Iterable[tuple]], Iterable[tuple]], schema: str, key: tuple[str, ...] = ("instrument",), order: tuple[str, ...] = ("us", "seq")) -> DataFrame:
    """step(rows of one key, in order, as tuples of the columns that aren't the key) -> rows of schema."""
    rest = [c for c in df.columns if c not in key]
    kinds = [f"{k} {df.schema[k].dataType.simpleString()}" for k in key]
    fields = [f.strip().split(" ") for f in [*kinds, *schema.split(",")]]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        arrow = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def batch_of(out: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, arrow[t]) for c, (_, t) in zip(zip(*out), fields)], [n for n, _ in fields])

        out: list[tuple] = []
        for k, group in groupby(rows(), key=lambda r: r[: len(key)]):
            for r in step(r[len(key) :] for r in group):
                out.append((*k, *r))
                if len(out) == BATCH:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    return df.select(*key, *rest).repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in fields))


def delta_bars(prints: DataFrame, threshold: int, key: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Bars that close when |buys - sells| reaches threshold; the last bar of a key may be open."""

    def step(rows):
        bar = first = open_ = high = low = close = volume = delta = 0
        fresh = True
        for _, seq, px, sz, side in rows:
            if fresh:
                first, open_, high, low, volume, delta, fresh = seq, px, px, px, 0, 0, False
            high, low, close, volume = max(high, px), min(low, px), px, volume + sz
            delta += sz if side == "B" else -sz if side == "A" else 0
            if abs(delta) >= threshold:
                yield bar, first, open_, high, low, close, volume, delta, True
                bar, fresh = bar + 1, True
        if not fresh:
            yield bar, first, open_, high, low, close, volume, delta, False

    cols = ("us", "seq", "px_ticks", "sz", "side")
    return in_order(prints.select(*key, *cols), step, "bar long, first_seq long, open long, high long, low long, close long, volume long, delta long, closed boolean", key)


def ofi_bars(flow: DataFrame, threshold: int, max_s: int, min_updates: int, key: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Bars on the mid that close GREEN or RED when the sum of OFI reaches +-threshold, or CHOP after max_s seconds with min_updates
    records; the next bar opens at the closing mid, and the last one is OPEN. Prices are twice the mid, so that they are whole."""

    def step(rows):
        bar = acc = n = path = 0
        start = opened = high = low = before = None
        for us, seq, bid, ask, ofi in rows:
            mid = bid + ask
            if opened is None:
                start, opened, high, low, before = us, mid, mid, mid, mid
            path += abs(mid - before)
            high, low, before, last = max(high, mid), min(low, mid), mid, seq
            acc, n = acc + int(ofi or 0), n + 1
            colour = "GREEN" if acc >= threshold else "RED" if acc <= -threshold else "CHOP" if us - start >= max_s * SECOND and n >= min_updates else None
            if colour:
                yield bar, seq, colour, opened, high, low, mid, acc, n, path
                bar, acc, n, start, opened, high, low, path = bar + 1, 0, 0, us, mid, mid, mid, 0
        if n:
            yield bar, last, "OPEN", opened, high, low, before, acc, n, path

    cols = ("us", "seq", "bid_px", "ask_px", "ofi")
    return in_order(flow.select(*key, *cols), step, "bar long, last_seq long, colour string, open2 long, high2 long, low2 long, close2 long, ofi long, updates long, path2 long", key)


def fused_bars(flow: DataFrame, prints: int, ofi: int, max_s: int, key: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Bars that close when they have `prints` records and |sum of OFI| of `ofi`, or after max_s seconds; the last one is open."""

    def step(rows):
        bar = acc = n = 0
        start = None
        for us, seq, flow_ in rows:
            start = us if start is None else start
            acc, n, last = acc + int(flow_ or 0), n + 1, seq
            both, late = n >= prints and abs(acc) >= ofi, us - start >= max_s * SECOND
            if both or late:
                yield bar, seq, "both" if both else "time", acc, n
                bar, acc, n, start = bar + 1, 0, 0, us
        if n:
            yield bar, last, "open", acc, n

    return in_order(flow.select(*key, "us", "seq", "ofi"), step, "bar long, last_seq long, trigger string, ofi long, n long", key)


def zigzag(prints: DataFrame, reversal: int, key: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Legs between extremes: a leg ends at its extreme once price turns by `reversal` ticks from it. The leg under way is given last, not done.

    way 0 is the time before the first turn: the leg then starts at the first print."""

    def step(rows):
        way, at, hi, lo = 0, None, None, None
        for _, seq, px in rows:
            here = (px, seq)
            if at is None:
                at = hi = lo = here
                continue
            hi, lo = hi if hi[0] >= px else here, lo if lo[0] <= px else here
            if way >= 0 and hi[0] - px >= reversal:
                if way > 0 or hi[0] > at[0]:
                    yield at[1], hi[1], 1, hi[0] - at[0], True
                    at = hi
                way, lo = -1, here
            elif way <= 0 and px - lo[0] >= reversal:
                if way < 0 or lo[0] < at[0]:
                    yield at[1], lo[1], -1, lo[0] - at[0], True
                    at = lo
                way, hi = 1, here
        if way:
            end = hi if way > 0 else lo
            yield at[1], end[1], way, end[0] - at[0], False

    return in_order(prints.select(*key, "us", "seq", "px_ticks"), step, "from_seq long, to_seq long, way int, ticks long, done boolean", key)


def ema(bars: DataFrame, x: str, length: int, key: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Exponential average of weight 2 / (length + 1), seeded with the key's first value; nulls leave it as it is."""

    def step(rows):
        v = None
        for at, y in rows:
            if y is not None and not math.isnan(y):
                v = y if v is None else v + 2 / (length + 1) * (y - v)
            yield at, v

    return in_order(bars.select(*key, "bar_us", F.col(x).cast("double").alias("x")), step, "bar_us long, ema double", key, ("bar_us",))


def ema_time(prints: DataFrame, tau_s: float, key: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Average over uneven time: a step of dt seconds weighs 1 - exp(-dt / tau)."""

    def step(rows):
        v = before = None
        for us, seq, px in rows:
            v = float(px) if v is None else v + (1 - math.exp(-(us - before) / SECOND / tau_s)) * (px - v)
            before = us
            yield seq, v

    return in_order(prints.select(*key, "us", "seq", "px_ticks"), step, "seq long, ema double", key)


def thin(df: DataFrame, stride_s: float, key: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Rows at least stride_s after the last one kept; the first of a key is kept."""

    def step(rows):
        last = None
        for us, seq in rows:
            if last is None or us - last >= stride_s * SECOND:
                yield seq, us
                last = us

    return in_order(df.select(*key, "us", "seq"), step, "seq long, us long", key)


def walk(trades: DataFrame, key: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Trades that can be taken one at a time: each next one starts when or after the last one taken has ended.
    trades: instrument, at_us, end_us, event_id, net."""

    def step(rows):
        free = None
        for at, end, event, net in rows:
            if free is None or at >= free:
                yield event, at, int(net)
                free = end

    return in_order(trades.select(*key, "at_us", "end_us", "event_id", "net"), step, "event_id long, at_us long, net long", key, ("at_us", "event_id"))


def vpin_prorata(prints: DataFrame, size: int, window: int, key: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Buckets of `size` contracts filled in proportion: what overflows carries its bucket's mix over; signed share and its mean size
    over the last `window` buckets."""

    def step(rows):
        buy = sell = 0.0
        bucket, gaps = 0, []
        for _, seq, sz, side in rows:
            if side == "N":
                continue
            buy, sell = buy + (sz if side == "B" else 0), sell + (sz if side == "A" else 0)
            while buy + sell >= size:
                share = size / (buy + sell)
                gaps = [*gaps[-window + 1 :], (buy - sell) * share / size]
                yield bucket, seq, gaps[-1], sum(map(abs, gaps)) / len(gaps) if len(gaps) == window else None
                buy, sell, bucket = buy * (1 - share), sell * (1 - share), bucket + 1

    return in_order(prints.select(*key, "us", "seq", "sz", "side"), step, "bucket long, last_seq long, taking double, vpin double", key)


def ppo(bars: DataFrame, deviation: int, clamp: float, signal: int, weight: float) -> DataFrame:
    """Money flow and signed volume over their rolling deviations, mixed, clamped, smoothed; histogram against its signal line.

    The deviations are windows; only the average runs in order.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy("instrument").orderBy("bar_us")
    span = F.col("high") - F.col("low")
    flow = F.when(span > 0, (2 * F.col("close") - F.col("high") - F.col("low")) / span * F.col("volume")).otherwise(0.0)
    b = bars.withColumns({"flow": flow, "mom": F.signum(F.col("close") - F.lag("close").over(w)) * F.col("volume")})
    last = w.rowsBetween(-deviation + 1, 0)
    unit = lambda c: F.when((F.count(c).over(last) == deviation) & (F.stddev_pop(c).over(last) > 0), F.greatest(F.lit(-clamp), F.least(F.lit(clamp), F.col(c) / F.stddev_pop(c).over(last))))
    b = b.select("instrument", "bar_us", (F.lit(weight) * unit("flow") + F.lit(1 - weight) * unit("mom")).alias("mix"))
    e = ema(b, "mix", signal).select("instrument", "bar_us", F.col("ema").alias("signal"))
    return b.join(e, ["instrument", "bar_us"]).select("instrument", "bar_us", "mix", "signal", (F.col("mix") - F.col("signal")).alias("histogram"))
