"""Market mathematics as columns: barrier hits, distances, carry, break-evens, names of intervals, ways, marks; exact pool quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import normal_cdf

SPECS = {"ES": (0.25, 12.5, 4.0), "MES": (0.25, 1.25, 1.2), "NQ": (0.25, 5.0, 4.0), "EQUITY": (0.01, 0.01, 0.0)}  # tick, value of a tick, cost


def distance_in_sigmas(spot: Column, barrier: Column, minutes: float, sigma: float) -> Column:
    return F.log(barrier / spot) / (F.lit(sigma) * F.sqrt(F.lit(float(minutes))))


def hit_probability(spot: Column, barrier: Column, minutes: float, sigma: float) -> Column:
    """Chance that a lognormal walk (no drift of the price itself) touches the barrier in time; 1 where it starts there."""
    mu, s = -0.5 * sigma * sigma, sigma * minutes**0.5
    a = F.abs(F.log(barrier / spot))
    m = F.when(barrier >= spot, F.lit(mu)).otherwise(F.lit(-mu))
    p = normal_cdf((-a + m * minutes) / s) + F.exp(2 * m * a / (sigma * sigma)) * normal_cdf((-a - m * minutes) / s)
    return F.when(a < 1e-12, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))


def survivability(sigmas: Column, commitment: Column, carry: Column, cross: Column) -> Column:
    """How well a position can sit through an adverse move, from 0 to 1: its distance to liquidation in sigmas, less for margin committed (a share
    of the account) and for funding paid (a share of the position a year), somewhat more for funding earned and for cross margin; 0 at liquidation."""
    carried = F.when(carry > 0, 1 / (1 + carry)).otherwise(1 + F.least(F.lit(0.15), F.abs(carry) * 0.3))
    s = (1 - F.exp(-sigmas / 2)) / (1 + 2 * F.greatest(F.lit(0.0), commitment)) * carried * F.when(cross, 1.15).otherwise(1.0)
    return F.when(sigmas <= 0, 0.0).otherwise(F.least(F.lit(1.0), s))


def break_even(reward: Column, risk: Column, cost: Column) -> Column:
    """Hit rate at which a trade pays nothing, within 0 and 1; null without reward and risk."""
    rate = F.try_divide(risk + cost, reward + risk)
    return F.when(rate.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), rate)))


def expectancy(rate: Column, take: Column, stop: Column, cost: Column) -> Column:
    return rate * (take - cost) - (1 - rate) * (stop + cost)


def drift_from_read(net: Column, sigma: float, seconds: float, k: float) -> Column:
    return F.lit(k) * F.tanh(net / 1.5) * sigma * seconds**0.5 / seconds


def pit(actual: Column, samples: Column) -> Column:
    """Share of the samples below what came; null without samples."""
    return F.try_divide(F.size(F.filter(samples, lambda x: x < actual)), F.nullif(F.size(samples), F.lit(0)))


def consumption(trade: Column, resting: Column) -> Column:
    return F.when(resting <= 0, 999.0).otherwise(F.least(F.lit(999.0), trade / F.nullif(resting, F.lit(0))))


def seconds_of(name: Column) -> Column:
    """`15m` is 900; also s, h, d, w. Null for another form."""
    n, unit = F.regexp_extract(name, "^([0-9]+)([smhdw])$", 1), F.regexp_extract(name, "^([0-9]+)([smhdw])$", 2)
    scale = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 604800)
    return n.try_cast("int") * scale


def parse_ticks(name: Column) -> tuple[Column, Column]:
    """`5000t+2000`: prints and, where given, OFI."""
    form = r"^([0-9]+)t(?:\+([0-9]+))?$"
    return F.regexp_extract(name, form, 1).try_cast("int"), F.regexp_extract(name, form, 2).try_cast("int")


def way_of(px: Column, open_px: Column, flat_bps: float) -> Column:
    move = (px / open_px - 1) * 1e4
    return F.when(move > flat_bps, "up").when(move < -flat_bps, "down").otherwise("flat")


def mark_for(elapsed: Column, interval: Column) -> Column:
    """The largest of 25, 50 and 75 that the elapsed share has reached; null before."""
    return F.array_max(F.filter(F.array(F.lit(25), F.lit(50), F.lit(75)), lambda m: elapsed * 100 >= m * interval))


def quote_v3(amount_in: int, sqrt_price_x96: int, liquidity: int, zero_for_one: bool, fee_ppm: int) -> int:
    """Output of a swap that stays within one range of a concentrated-liquidity pool, in whole units; every division rounds down. 0 where there is
    nothing to swap, no liquidity or price, or the price wouldn't move."""
    q96 = 1 << 96
    if min(amount_in, liquidity, sqrt_price_x96) <= 0:
        return 0
    net = amount_in * (1_000_000 - fee_ppm) // 1_000_000
    if net <= 0:
        return 0
    if zero_for_one:
        after = liquidity * q96 * sqrt_price_x96 // (liquidity * q96 + net * sqrt_price_x96)
        return liquidity * (sqrt_price_x96 - after) // q96 if 0 < after < sqrt_price_x96 else 0
    after = sqrt_price_x96 + net * q96 // liquidity
    return liquidity * q96 * (after - sqrt_price_x96) // (after * sqrt_price_x96) if after > sqrt_price_x96 else 0


def quote_v2(amount_in: int, reserve_in: int, reserve_out: int, fee_ppm: int) -> int:
    """What a constant-product pool gives for an amount, in whole units; 0 where there is nothing to swap or the pool would be empty."""
    if min(amount_in, reserve_in, reserve_out) <= 0:
        return 0
    net = amount_in * (1_000_000 - fee_ppm)
    out = net * reserve_out // (reserve_in * 1_000_000 + net)
    return out if out < reserve_out else 0
