"""Account positions: liquidation map, concentration, sweep differences, conviction, consensus, strength, cohorts.

Everything is a hash aggregate or an equi-join on (wallet, coin), keys of high cardinality; maps are small afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.market import survivability


def notional() -> Column:
    return F.abs("szi") * F.col("entry_px")


def liquidation_map(positions: DataFrame, spot: float, bucket_bps: float, reach: float, least: float) -> DataFrame:
    """Notional that liquidates by distance bucket from spot: sane positions (longs below, shorts above) within reach."""
    d = (F.col("liquidation_px") - spot) / (spot * bucket_bps / 1e4)
    p = positions.withColumn("notional", notional()).where(F.col("liquidation_px").isNotNull() & (F.abs(F.col("liquidation_px") / spot - 1) <= reach) & (F.col("notional") >= least))
    p = p.where(F.when(F.col("szi") > 0, F.col("liquidation_px") <= spot).otherwise(F.col("liquidation_px") >= spot))
    side = lambda c: F.sum(F.when(c, F.col("notional")).otherwise(0.0))
    return p.groupBy("coin", F.floor(d).alias("bucket")).agg(side(F.col("szi") > 0).alias("long_notional"), side(F.col("szi") < 0).alias("short_notional"), F.count("*").alias("n"), F.countDistinct("wallet").alias("wallets"))


def pressure_map(strengths: DataFrame, positions: DataFrame, spot: float, bucket_bps: float, reach: float, least: float) -> DataFrame:
    """liquidation_map() with each position's notional weighted by its fragility: what can be forced out, not what is there."""
    w = strengths.select("sweep_id", "wallet", "coin", "fragility")
    p = positions.join(w, ["sweep_id", "wallet", "coin"]).withColumn("entry_px", F.col("entry_px") * F.col("fragility"))
    return liquidation_map(p, spot, bucket_bps, reach, least)


def concentration(map_: DataFrame, top: int) -> DataFrame:
    """Share of the `top` largest buckets of each coin."""
    m = map_.withColumn("total", F.col("long_notional") + F.col("short_notional"))
    rank = F.row_number().over(W.partitionBy("coin").orderBy(F.desc("total"), "bucket"))
    return m.withColumn("rank", rank).groupBy("coin").agg((F.sum(F.when(F.col("rank") <= top, F.col("total"))) / F.sum("total")).alias("share"), F.count("*").alias("buckets"))


def diff(before: DataFrame, after: DataFrame, spot: float, size_tol: float, liq_tol: float, near: float) -> DataFrame:
    """What each (wallet, coin) did between two sweeps: a full outer join and a chain of conditions. Sizes are compared without their sign. Where
    the size is held, margin moves the liquidation price away from the side held before (DEFENDED) or towards it (WEAKENED)."""
    cols = ("szi", "entry_px", "liquidation_px")
    b = before.select("wallet", "coin", *(F.col(c).alias(f"{c}_0") for c in cols))
    a = after.select("wallet", "coin", *(F.col(c).alias(f"{c}_1") for c in cols))
    x = b.join(a, ["wallet", "coin"], "full_outer").where("szi_0 is null or szi_1 is null or szi_0 <> 0")
    s0, s1, l0, l1 = F.abs("szi_0"), F.abs("szi_1"), F.col("liquidation_px_0"), F.col("liquidation_px_1")
    gone, new = F.col("szi_1").isNull(), F.col("szi_0").isNull()
    size = F.when(gone, -1.0).when(new, 1.0).otherwise((s1 - s0) / s0)
    held = ~gone & ~new & (size <= size_tol) & (size >= -size_tol) & (l0 > 0) & l1.isNotNull()
    move = F.when(held, (l1 - l0) / l0).otherwise(0.0)
    away = F.when(F.col("szi_0") > 0, -move).otherwise(move)
    kind = (
        F.when(new, "OPENED").when(gone, F.when(F.coalesce(F.abs(F.lit(spot) - l0) / spot <= near, F.lit(False)), "LIQUIDATED").otherwise("CLOSED"))
        .when(size > size_tol, "ADDED").when(size < -size_tol, "REDUCED").when(away > liq_tol, "DEFENDED").when(away < -liq_tol, "WEAKENED").otherwise("HELD")
    )
    n = lambda i: F.coalesce(F.abs(f"szi_{i}") * F.col(f"entry_px_{i}"), F.lit(0.0))
    return x.select("wallet", "coin", kind.alias("kind"), size.alias("size_change"), move.alias("liq_move"), n(0).alias("notional_0"), n(1).alias("notional_1"))


def conviction(changes: DataFrame) -> DataFrame:
    """By kind: count and the larger notional of the two sweeps; liquidations aren't a choice and stay out."""
    c = changes.where("kind <> 'LIQUIDATED'").groupBy("coin", "kind").agg(F.count("*").alias("n"), F.sum(F.greatest("notional_0", "notional_1")).alias("notional"))
    way = F.when(F.col("kind").isin("OPENED", "ADDED", "DEFENDED"), 1).when(F.col("kind").isin("CLOSED", "REDUCED", "WEAKENED"), -1).otherwise(0)
    return c.withColumn("net_of_coin", F.sum(F.col("notional") * way).over(W.partitionBy("coin")))


def strength(positions: DataFrame, spot: float, sigma: float, minutes: float = 240.0, held_hours: float = 24.0) -> DataFrame:
    """For each position: the distance to liquidation in sigmas of `minutes` and as a share of spot (infinite without a liquidation price), margin over
    account, funding a year over notional (had it run for held_hours), unrealised profit over notional, notional over account, and from these
    survivability and fragility."""
    size, account, liq = F.coalesce(F.nullif(notional(), F.lit(0.0)), F.lit(1.0)), F.col("account_value"), F.col("liquidation_px")
    known, never = (liq > 0) & F.lit(spot > 0), F.lit(float("inf"))
    p = positions.withColumns({
        "notional": notional(), "sigmas": F.when(known, F.abs(F.log(liq / spot)) / (sigma * max(minutes, 1e-9) ** 0.5)).otherwise(never), "distance": F.when(known, F.abs(liq - spot) / spot).otherwise(never),
        "commitment": F.when(account > 0, F.col("margin_used") / account).otherwise(0.0), "effective_leverage": F.when(account > 0, size / account).otherwise(0.0),
        "carry": F.col("funding") / size * (24 * 365 / held_hours), "maturity": F.col("szi") * (F.lit(spot) - F.col("entry_px")) / size,
    })
    p = p.withColumn("survivability", survivability(F.col("sigmas"), F.col("commitment"), F.col("carry"), ~F.col("isolated")))
    fragile = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("survivability")))
    return p.select("sweep_id", "wallet", "coin", "szi", "entry_px", "notional", "account_value", "sigmas", "distance", "commitment", "carry", "maturity", "effective_leverage", "survivability", fragile.alias("fragility"))


def cohorts(strengths: DataFrame) -> DataFrame:
    """By coin: positions, notional of longs and shorts, raw and weighted by fragility, the net of the weighted, mean survivability, share that pays funding."""
    side = lambda c, x: F.sum(F.when(c, x).otherwise(0.0))
    long, weighted = F.col("szi") > 0, F.col("notional") * F.col("fragility")
    g = strengths.groupBy("coin").agg(F.count("*").alias("n"), side(long, F.col("notional")).alias("longs"), side(~long, F.col("notional")).alias("shorts"), side(long, weighted).alias("fragile_longs"), side(~long, weighted).alias("fragile_shorts"), F.avg("survivability").alias("survivability"), F.avg((F.col("carry") > 0).cast("int")).alias("paying"))
    return g.withColumn("net_fragile", F.col("fragile_longs") - F.col("fragile_shorts"))


def consensus(strengths: DataFrame, spot: float, least: float) -> DataFrame:
    """The side of the winners' notional (of all, where nobody wins) by coin, and of those on that side: the mean entry by notional, how much worse spot
    is than it, and the median distance to liquidation in sigmas. Late where the gap is over 2 %, crowded from 75 % agreement with under 1.5 sigmas."""
    s = strengths.where((F.col("notional") >= least) & (F.col("szi") != 0)).withColumn("wins", F.col("maturity") > 0)
    any_win = F.max(F.col("wins").cast("int")).over(W.partitionBy("coin"))
    s = s.withColumn("counts", F.col("wins") | (any_win == 0))
    total = lambda c: F.sum(F.when(c, F.col("notional")).otherwise(0.0))
    long = F.col("szi") > 0
    g = s.groupBy("coin").agg(F.count("*").alias("n"), F.count_if("wins").alias("winning"), F.count_if(F.col("maturity") < 0).alias("losing"), total(long).alias("longs"), total(~long).alias("shorts"), total(long & F.col("counts")).alias("winning_longs"), total(~long & F.col("counts")).alias("winning_shorts"))
    g = g.withColumn("direction", F.when(F.col("winning_longs") >= F.col("winning_shorts"), "long").otherwise("short"))
    same = s.where("counts").join(g.select("coin", "direction"), "coin").where(long == (F.col("direction") == "long"))
    of = same.groupBy("coin").agg((F.sum(F.col("entry_px") * F.col("notional")) / F.sum("notional")).alias("entry"), F.percentile("sigmas", F.lit(0.5)).alias("room"))
    raw = (F.lit(spot) - F.col("entry")) / F.col("entry")
    g = g.join(of, "coin").withColumns({"strength": F.greatest("winning_longs", "winning_shorts") / (F.col("winning_longs") + F.col("winning_shorts")), "entry_gap": F.when(F.col("direction") == "long", raw).otherwise(-raw)})
    return g.withColumns({"late": F.col("entry_gap") > 0.02, "crowded": (F.col("strength") >= 0.75) & (F.col("room") < 1.5)})


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last by order: an upsert on read."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def unresolved(found: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Rows without an outcome yet."""
    return found.join(outcomes, key, "left_anti")
