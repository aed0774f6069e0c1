"""Exchange sessions: trade dates, regular hours, rolls, and the levels that a session publishes.

A trade date begins at 18:00 in New York, so a key of (instrument, session) is one evening, night and day; operators that start anew with it
take it as their key. Times are read in the session time zone UTC. Everything is a hash aggregate or a window by instrument over sessions, which are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import near_roll, phase, trade_date
from .bars import SECOND

DAY = 86_400 * SECOND


def session_us(us: str) -> Column:
    """The trade date as the epoch microseconds of its midnight."""
    return F.datediff(trade_date(F.timestamp_micros(us)), F.lit("1970-01-01").cast("date")).cast("long") * DAY


def with_session(bars: DataFrame, us: str = "bar_us") -> DataFrame:
    """bars with session_us and phase."""
    return bars.withColumns({"session_us": session_us(us), "phase": phase(F.timestamp_micros(us))})


def sessions(bars: DataFrame, gap_ticks: int, expiries: list, window: int = 4, rth_only: bool = True) -> DataFrame:
    """A bar for each trade date, of the regular hours alone unless told otherwise. suspect where it is near a roll, or opens more than
    gap_ticks from the close before; reason says which."""
    b = with_session(bars)
    b = b.where(F.col("phase") == "RTH") if rth_only else b
    d = b.groupBy("instrument", "session_us").agg(F.min_by("open", "bar_us").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_us").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("bars"))
    gap = F.col("open") - F.lag("close").over(W.partitionBy("instrument").orderBy("session_us"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), (F.col("session_us") / DAY).cast("int"))
    reason = F.when(near_roll(day, expiries, window), "roll").when(F.abs(gap) > gap_ticks, "gap")
    return d.select("*", gap.alias("gap"), reason.isNotNull().alias("suspect"), reason.alias("reason"))


def session_levels(bars: DataFrame, balance_s: int = 3600) -> DataFrame:
    """instrument, session_us, kind, px, set_us: the levels of each session, from the bar on that completes what defines them. High, low and close of
    the last regular hours before (PDH, PDL, PDC) from the session's first bar; those of the night (ONH, ONL) from the first regular bar; of the first
    hour (IBH, IBL) from the first bar after it."""
    b = with_session(bars)
    rth, night = F.col("phase") == "RTH", F.col("phase") == "OVERNIGHT"
    local = F.from_utc_timestamp(F.timestamp_micros("bar_us"), "America/New_York")
    since_open = (F.hour(local) * 60 + F.minute(local) - 570) * 60
    first_hour = rth & (since_open < balance_s)
    at = lambda c: F.min(F.when(c, F.col("bar_us")))
    of = lambda f, c, x: f(F.when(c, F.col(x)))
    d = b.groupBy("instrument", "session_us").agg(
        F.min("bar_us").alias("begin"), at(rth).alias("rth_us"), at(rth & (since_open >= balance_s)).alias("ib_us"),
        of(F.max, rth, "high").alias("rh"), of(F.min, rth, "low").alias("rl"), F.max_by(F.when(rth, F.col("close")), F.when(rth, F.col("bar_us"))).alias("rc"),
        of(F.max, night, "high").alias("ONH"), of(F.min, night, "low").alias("ONL"), of(F.max, first_hour, "high").alias("IBH"), of(F.min, first_hour, "low").alias("IBL"),
    )
    before = W.partitionBy("instrument").orderBy("session_us").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumns({k: F.last(c, ignorenulls=True).over(before) for k, c in (("PDH", "rh"), ("PDL", "rl"), ("PDC", "rc"))})
    when = {"PDH": "begin", "PDL": "begin", "PDC": "begin", "ONH": "rth_us", "ONL": "rth_us", "IBH": "ib_us", "IBL": "ib_us"}
    all_ = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("px"), F.col(t).alias("set_us")) for k, t in when.items())))
    return d.select("instrument", "session_us", all_.alias("l")).select("instrument", "session_us", "l.*").where("px is not null and set_us is not null")


def on_levels(bars: DataFrame, levels: DataFrame) -> DataFrame:
    """Each bar beside the levels of its session that are set: at most seven rows a bar."""
    b = bars.withColumn("session_us", session_us("bar_us"))
    return b.join(levels, ["instrument", "session_us"]).where(F.col("bar_us") >= F.col("set_us"))
