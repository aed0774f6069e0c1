"""Truth tables of verdicts as columns: votes, grades, confirmations, exits, asset classes. Each is one CASE, evaluated within a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vote(*legs: tuple[Column, Column]) -> tuple[Column, Column]:
    """Side and net of (direction, strength) votes; without a net the one direction that all who speak share, else flat."""
    net = sum((F.when(d == "up", s).when(d == "down", -s).otherwise(0.0) for d, s in legs), F.lit(0.0))
    spoken = F.array_distinct(F.filter(F.array(*(d for d, _ in legs)), lambda x: x != "flat"))
    return F.when(net > 0, "up").when(net < 0, "down").when(F.size(spoken) == 1, F.get(spoken, F.lit(0))).otherwise("flat"), net


def grade(book: Column, delta: Column, price: Column) -> Column:
    """A: book and delta both go with price, B: one does, whatever the other says, X: none does and one or both oppose, C: price goes alone, -: price is flat,
    so there is nothing to trade."""
    agree = (book == price).cast("int") + (delta == price).cast("int")
    against = ((book != price) & (book != "flat")).cast("int") + ((delta != price) & (delta != "flat")).cast("int")
    return F.when(price == "flat", "-").when((agree == 0) & (against > 0), "X").when(agree == 2, "A").when(agree == 1, "B").otherwise("C")


def confirmation(signal: Column, action: Column, held_s: Column, flips: Column, min_held: float, max_flips: int) -> Column:
    """No signal, conflict, confirmed (held long enough with few flips) or unconfirmed."""
    return F.when(signal == "flat", "no signal").when((action != "flat") & (action != signal), "conflict").when((action == signal) & (held_s >= min_held) & (flips <= max_flips), "confirmed").otherwise("unconfirmed")


def exit_reason(*checks: tuple[str, Column]) -> Column:
    """The first check that holds; null where none does."""
    return F.coalesce(*(F.when(c, F.lit(n)) for n, c in checks))


def asset_class(symbol: Column) -> Column:
    """From the symbol alone: a dex prefix goes, then sets of names, then the shape of a currency pair."""
    s = F.upper(F.element_at(F.split(symbol, ":"), -1))
    fx = "^(USD|EUR|GBP|JPY|CHF|AUD|CAD|NZD)/?(USD|EUR|GBP|JPY|CHF|AUD|CAD|NZD)$"
    return F.when(s.isin("GOLD", "SILVER", "XAU", "XAG", "COPPER", "PLATINUM"), "metals").when(s.isin("OIL", "WTI", "BRENT", "NATGAS"), "energy").when(s.rlike(fx), "fx").when(s.isin("SPX", "NDX", "DJI", "VIX", "US500", "US100"), "index").when(F.instr(symbol, ":") > 0, "equity").otherwise("crypto")


def unit(klass: Column, tick: Column) -> Column:
    """What a move is told in: pips for currencies, ticks where the tick is known, else points."""
    return F.when(klass == "fx", "pip").when(tick > 0, "tick").otherwise("point")


def entry_signal(read: Column, cvd: Column, backed: Column, *stack: Column) -> tuple[Column, Column]:
    """The side to enter and, where it is withheld, why: cvd-side (what traded in the bar isn't of the book's side), cvd (nothing traded behind the book's last
    turn), stack (every slower read opposes; a silent one doesn't). No side and no reason where the book has no side; nulls are silent."""
    side = F.when(read.isin("up", "down"), read)
    opposed = F.lit(bool(stack))
    for s in stack:
        opposed &= F.coalesce(s == F.when(side == "up", "down").otherwise("up"), F.lit(False))
    blocked = F.when(side.isNull(), None).when(~F.coalesce(cvd == side, F.lit(False)), "cvd-side").when(~F.coalesce(backed, F.lit(False)), "cvd").when(opposed, "stack")
    return F.when(blocked.isNull(), side), blocked
