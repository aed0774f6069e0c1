"""State machines over prints and bars: level life cycles, inside-level events, direction with reversal and silence, cooldowns, positions.

As in `sequential`, a generator walks each key's rows in order and keeps its state in local variables; the key says where a machine starts anew. What
is still open at the end is given with its status.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from .bars import SECOND
from .sequential import in_order


def level_life(bars: DataFrame, expire: int, away: int, key: tuple[str, ...] = ("instrument", "kind", "session_us")) -> DataFrame:
    """What bars do to the level of their session: TOUCHED when one trades through and closes back, BROKEN_ABOVE or _BELOW on a close beyond it, from the side
    that the first open stood on, RECLAIMED on a close back, EXPIRED after `expire` bars more than `away` ticks off. A row for each change.

    bars: the key, bar_us, open, high, low, close, px (the level)."""

    def step(rows):
        state, above, clear = "SET", None, 0
        for at, open_, high, low, close, px in rows:
            if state == "EXPIRED":
                continue
            above = open_ > px if above is None else above
            through, back = (close < px, close > px) if above else (close > px, close < px)
            new = state
            if state.startswith("BROKEN"):
                new = "RECLAIMED" if back else state
            elif through:
                new = "BROKEN_BELOW" if above else "BROKEN_ABOVE"
            elif low <= px <= high:
                new = "TOUCHED"
            if new != state:
                yield at, px, state, new
            state = new
            near = abs(high - px) <= away or abs(low - px) <= away or low <= px <= high
            clear = 0 if near else clear + 1
            if clear >= expire:
                yield at, px, state, "EXPIRED"
                state = "EXPIRED"

    cols = ("bar_us", "open", "high", "low", "close", "px")
    return in_order(bars.select(*key, *cols), step, "at_us long, level long, old string, new string", key, ("bar_us",))


def inside_events(touches: DataFrame, window_s: float, drain: float, key: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Events at the best bid: VACATED when its price falls, DRAINED when its size falls to `drain` of its peak at that price; each is FAILED if the bid
    is back (price or two thirds of the peak) within window_s, else PERMANENT, or PENDING where the rows end before. at_us: when that is known."""

    def step(rows):
        open_, peak, before = [], 0, None
        for us, seq, px, sz in rows:
            if before is None:
                before, peak = (px, sz), sz
                continue
            still = []
            for kind, at, level, need, s in open_:
                back = px > level or (px == level and (kind == "VACATED" or sz >= need))
                if us - at > window_s * SECOND:
                    yield s, kind, level, "PERMANENT", us
                elif back:
                    yield s, kind, level, "FAILED", us
                else:
                    still.append((kind, at, level, need, s))
            open_ = still
            if px < before[0]:
                open_.append(("VACATED", us, before[0], 0, seq))
            elif px == before[0] and sz <= drain * peak < before[1]:
                open_.append(("DRAINED", us, px, peak * 2 / 3, seq))
            peak = max(peak, sz) if px == before[0] else sz
            before = (px, sz)
        for kind, _, level, _, s in open_:
            yield s, kind, level, "PENDING", None

    return in_order(touches.select(*key, "us", "seq", "bid_px", "bid_sz"), step, "seq long, kind string, level long, result string, at_us long", key)


def price_direction(prints: DataFrame, reverse: int, flat_s: float, key: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """up or down once price is `reverse` ticks off the last extreme, flat after flat_s without a new extreme; a row per change."""

    def step(rows):
        way, hi, lo, moved = "flat", None, None, None
        for us, seq, px in rows:
            if hi is None:
                hi = lo = px
                moved = us
                continue
            if px > hi or px < lo:
                moved = us
            hi, lo = max(hi, px), min(lo, px)
            new = way
            if px - lo >= reverse and way != "up":
                new, hi = "up", px
            elif hi - px >= reverse and way != "down":
                new, lo = "down", px
            elif us - moved > flat_s * SECOND and way != "flat":
                new, hi, lo = "flat", px, px
            if new != way:
                yield seq, way, new
                moved = us
            way = new
            if way == "up":
                lo = max(lo, hi - reverse)
            elif way == "down":
                hi = min(hi, lo + reverse)

    return in_order(prints.select(*key, "us", "seq", "px_ticks"), step, "seq long, old string, new string", key)


def cooldown(signals: DataFrame, seconds: float, key: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Signals (instrument, us, seq, side) at least `seconds` after the last one taken of the same side."""

    def step(rows):
        last: dict[str, int] = {}
        for us, seq, side in rows:
            if side not in last or us - last[side] >= seconds * SECOND:
                yield seq, side
                last[side] = us

    return in_order(signals.select(*key, "us", "seq", "side"), step, "seq long, side string", key)


def autopilot(bars: DataFrame, enter: int, leave: int, target: int, stop: int, max_bars: int, key: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """A position at a time: in when |delta| of a bar reaches enter, out at the stop, the target, a delta of `leave` against it, or after max_bars.

    Stops and targets are checked on a bar's low and high, the stop first. One row per position; that of the end is open, at its last close.
    """

    def step(rows):
        side = entry = since = 0
        i = -1
        for at, hi, lo, close, delta in rows:
            i += 1
            if side:
                worst, best = (lo - entry, hi - entry) if side > 0 else (entry - hi, entry - lo)
                why = "stop" if worst <= -stop else "target" if best >= target else "flip" if delta * side <= -leave else "time" if i - since >= max_bars else None
                if why:
                    yield at, side, entry, why, -stop if why == "stop" else target if why == "target" else (close - entry) * side
                    side = 0
                    continue
            if not side and abs(delta) >= enter:
                side, entry, since = (1 if delta > 0 else -1), close, i
        if side:
            yield at, side, entry, "open", (close - entry) * side

    return in_order(bars.select(*key, "bar_us", "high", "low", "close", "delta"), step, "at_us long, side int, entry long, reason string, net long", key, ("bar_us",))


def pace(prints: DataFrame, tau_s: float, key: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Exponentially decayed volume rates of buyers and sellers at each print, and the lead of the faster side."""

    def step(rows):
        b = s = 0.0
        before = None
        for us, seq, sz, side in rows:
            decay = 1.0 if before is None else math.exp(-(us - before) / SECOND / tau_s)
            b, s, before = b * decay + (sz if side == "B" else 0), s * decay + (sz if side == "A" else 0), us
            yield seq, b / tau_s, s / tau_s, (b - s) / (b + s) if b + s else None

    return in_order(prints.select(*key, "us", "seq", "sz", "side"), step, "seq long, buy_rate double, sell_rate double, lead double", key)


def journal(looks: DataFrame, take: int, cut: int, most: int = 2, key: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """What to do at each look at the market: seq, action (open, close or none), why, side held after it (1, -1, 0) and the net of a close. One action a look.

    looks: key, us, seq, px, agree and price (up, down, else silent), disagreed, candle. An open position ends at the stop, then the target (0: none), then where the signal is
    of the other side, where the reads disagree, or where price itself points the other way; silence holds it. A candle opens each side once and `most` positions in all;
    a look whose candle is null opens nothing and leaves the candle before as it is. Without a price above 0 nothing is done."""
    ways = {"up": 1, "down": -1}

    def close(side, move, agree, price, disagreed):
        checks = (("sl", cut and move <= -cut), ("tp", take and move >= take), ("flip", ways.get(agree) == -side), ("disagree", disagreed), ("diverge", ways.get(price) == -side))
        return next((name for name, holds in checks if holds), None)

    def refusal(agree, candle, taken):
        if agree not in ways:
            return "no signal"
        return "no candle" if candle is None else "side taken" if ways[agree] in taken else "candle full" if len(taken) >= most else None

    def step(rows):
        side = entry = 0
        now, taken = None, set()
        for _, seq, px, agree, price, disagreed, candle in rows:
            if candle is not None and candle != now:
                now, taken = candle, set()
            if px is None or px <= 0:
                yield seq, "none", "no price", side, None
            elif side:
                move = (px - entry) * side
                why = close(side, move, agree, price, disagreed)
                side = 0 if why else side
                yield seq, "close" if why else "none", why or "held", side, move if why else None
            else:
                why = refusal(agree, candle, taken)
                if why is None:
                    side, entry = ways[agree], px
                    taken.add(side)
                yield seq, "none" if why else "open", why or agree, side, None

    cols = ("us", "seq", "px", "agree", "price", "disagreed", "candle")
    return in_order(looks.select(*key, *cols), step, "seq long, action string, why string, side int, net long", key)
