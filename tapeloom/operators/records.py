"""Vendor records to books and trades: prices in fixed units, what a record may be used for, and whether the side labels mean what they say.

Records carry instrument (the feed), us, seq, sequence (the vendor's number), contract, action, side, price, size and levels. Whether a record's order-flow
step may be taken depends on the record with a book before it, so that is one window by feed; the rest is within a row or a hash aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .flow import _side_flow, level_weight

UNIT = 1e-9
UNDEFINED = 2**63 - 1


def price(c: Column) -> Column:
    """A price of the feed; 0 where it is undefined."""
    return F.when(c.isNull() | (c == UNDEFINED), 0.0).otherwise(c * F.lit(UNIT))


def books(records: DataFrame, depth: int = 10) -> DataFrame:
    """instrument, us, seq, bids and asks as array<struct<px,sz>> of records with levels: of the first `depth` levels those that have a price and a
    size, since a zero price would stand at the top of the asks."""
    top = F.slice("levels", 1, depth)
    side = lambda s: F.filter(F.transform(top, lambda x: F.struct(price(x[f"{s}_px"]).alias("px"), x[f"{s}_sz"].alias("sz"))), lambda x: (x["px"] > 0) & (x["sz"] > 0))
    return records.where(F.size("levels") > 0).select("instrument", "us", "seq", side("bid").alias("bids"), side("ask").alias("asks"))


def trades(records: DataFrame, flip: bool = False) -> DataFrame:
    """instrument, us, seq, px, sz, aggressor of the records that are trades or fills with a price, a size and a side; flip turns the sides around."""
    t = records.withColumn("px", price(F.col("price"))).where(F.col("action").isin("T", "F") & (F.col("px") > 0) & (F.col("size") > 0) & F.col("side").isin("A", "B"))
    return t.select("instrument", "us", "seq", "px", F.col("size").alias("sz"), F.when((F.col("side") == "B") != F.lit(flip), "buy").otherwise("sell").alias("aggressor"))


def stream(records: DataFrame, flip: bool = False) -> DataFrame:
    """instrument, seq, part, kind: what a reader is shown, in the order of seq and part. A record's trade comes before its book, which already shows what
    the trade took; a clear comes alone."""
    t = trades(records, flip).select("instrument", "seq", F.lit(0).alias("part"), F.lit("trade").alias("kind"))
    rest = records.where("action <> 'R'")
    t = t.join(rest.select("instrument", "seq"), ["instrument", "seq"], "left_semi")
    b = rest.where(F.size("levels") > 0).select("instrument", "seq", F.lit(1).alias("part"), F.lit("book").alias("kind"))
    return t.union(b).union(records.where("action = 'R'").select("instrument", "seq", F.lit(0), F.lit("clear")))


def admissible(records: DataFrame, check_sequence: bool = True, depth: int = 10) -> DataFrame:
    """instrument, seq, reason, ofi, ofi_levels: the order-flow step of each record, or why there is none.

    boundary: nothing happened, or a clear, after which nothing is known; no_book: a record without levels, which leaves what is known as it is; roll:
    another contract; first: nothing known; gap: a number is missing before it; invalid: a touch without price or size; crossed. The record becomes what is
    known in each of the last five, so the step after is measured from it. ofi_levels weighs the levels by flow.level_weight() of `depth`.
    """
    feed = W.partitionBy("instrument").orderBy("seq")
    r = records.withColumn("clears", F.count_if(F.col("action") == "R").over(feed.rowsBetween(W.unboundedPreceding, 0)))
    skipped = F.when(F.col("action").isin("N", "R"), "boundary").when(F.size("levels") == 0, "no_book")
    r = r.withColumn("skipped", skipped)
    seen = r.where("skipped is null")
    part = W.partitionBy("instrument", "clears").orderBy("seq")
    seen = seen.withColumns({"contract0": F.lag("contract").over(feed), "sequence0": F.lag("sequence").over(part), "levels0": F.lag("levels").over(part)})
    touch = lambda c: F.element_at(c, 1)
    valid = lambda x: (x["bid_px"] > 0) & (x["ask_px"] > 0) & (x["bid_px"] != UNDEFINED) & (x["ask_px"] != UNDEFINED) & (x["bid_sz"] > 0) & (x["ask_sz"] > 0)
    crossed = lambda x: x["bid_px"] >= x["ask_px"]
    now, old = touch("levels"), touch("levels0")
    reason = (
        F.when(F.col("contract0").isNotNull() & (F.col("contract0") != F.col("contract")), "roll").when(F.col("levels0").isNull(), "first")
        .when(F.lit(check_sequence) & (F.col("sequence") != 0) & (F.col("sequence") != F.col("sequence0") + 1), "gap")
        .when(~(valid(old) & valid(now)), "invalid").when(crossed(old) | crossed(now), "crossed").otherwise("ok")
    )
    seen = seen.withColumn("reason", reason)

    def step(a: Column, b: Column) -> Column:
        return _side_flow(b["bid_px"], b["bid_sz"], a["bid_px"], a["bid_sz"], True) - _side_flow(b["ask_px"], b["ask_sz"], a["ask_px"], a["ask_sz"], False)

    both = F.least(F.size("levels"), F.size("levels0"), F.lit(depth))

    def weighed(i: Column) -> Column:
        a, b = F.element_at("levels0", i + 1), F.element_at("levels", i + 1)
        return F.when(valid(a) & valid(b), step(a, b) * level_weight(i, depth)).otherwise(0.0)

    ok = F.col("reason") == "ok"
    total = F.aggregate(F.transform(F.sequence(F.lit(0), both - 1), weighed), F.lit(0.0), lambda a, x: a + x)
    done = seen.select("instrument", "seq", "reason", F.when(ok, step(old, now)).alias("ofi"), F.when(ok, total).alias("ofi_levels"))
    return done.union(r.where("skipped is not null").select("instrument", "seq", "skipped", F.lit(None).cast("long"), F.lit(None).cast("double")))


def convention(records: DataFrame, least: int = 40, clear: float = 0.8) -> DataFrame:
    """By feed, what its side labels mean: prints seen, unlabelled, with a usable book before them and off its mid; of the labelled ones how many of each
    label printed above it; and the verdict. A label is the buyer's if at least `clear` of its prints are above and at most 1 - clear of the other's."""
    feed = W.partitionBy("instrument").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    before = F.last(F.when(F.size("levels") > 0, F.element_at("levels", 1)), ignorenulls=True).over(feed)
    p = records.withColumn("book", before).where(F.col("action").isin("T", "F", "A") & (price(F.col("price")) > 0))
    quotable = F.coalesce((F.col("book.bid_px") > 0) & (F.col("book.ask_px") > 0) & (F.col("book.bid_px") != UNDEFINED) & (F.col("book.ask_px") != UNDEFINED) & (F.col("book.ask_px") >= F.col("book.bid_px")), F.lit(False))
    p = p.withColumns({"quotable": quotable, "mid2": F.col("book.bid_px") + F.col("book.ask_px"), "px2": 2 * F.col("price")})
    p = p.withColumn("off", F.col("quotable") & (F.col("px2") != F.col("mid2"))).withColumn("above", F.col("off") & (F.col("px2") > F.col("mid2")))
    of = lambda s, c: F.count_if((F.col("side") == s) & F.col(c))
    g = p.groupBy("instrument").agg(F.count("*").alias("seen"), F.count_if(~F.col("side").isin("A", "B")).alias("unlabelled"), F.count_if("quotable").alias("quotable"), F.count_if("off").alias("off_mid"), of("B", "off").alias("b_total"), of("B", "above").alias("b_above"), of("A", "off").alias("a_total"), of("A", "above").alias("a_above"))
    b, a = F.try_divide("b_above", "b_total"), F.try_divide("a_above", "a_total")
    verdict = (
        F.when(F.col("unlabelled") == F.col("seen"), "no label").when((F.col("b_total") + F.col("a_total") < least) | (F.col("b_total") == 0) | (F.col("a_total") == 0), "not enough samples")
        .when((b >= clear) & (a <= 1 - clear), "b is buyer").when((a >= clear) & (b <= 1 - clear), "a is buyer").otherwise("unclear")
    )
    return g.withColumns({"assignable": F.coalesce(F.try_divide("off_mid", "quotable"), F.lit(0.0)), "verdict": verdict})
