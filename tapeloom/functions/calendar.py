"""Sessions and contract calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXCHANGE = "America/New_York"


def trade_date(ts: Column) -> Column:
    """The exchange's date; from 18:00 on a print belongs to the next one."""
    return F.to_date(F.from_utc_timestamp(ts, EXCHANGE) + F.expr("interval 6 hours"))


def phase(ts: Column) -> Column:
    """RTH 9:30-16:00, POST to 17:00, CLOSED to 18:00 and at weekends, else OVERNIGHT; daylight saving as in New York."""
    local = F.from_utc_timestamp(ts, EXCHANGE)
    minute, day = F.hour(local) * 60 + F.minute(local), F.dayofweek(local)
    closed = (day == 7) | ((day == 6) & (minute >= 1020)) | ((day == 1) & (minute < 1080)) | minute.between(1020, 1079)
    return F.when(closed, "CLOSED").when(minute.between(570, 959), "RTH").when(minute.between(960, 1019), "POST").otherwise("OVERNIGHT")


def third_friday(year: Column, month: Column) -> Column:
    first = F.make_date(year, month, F.lit(1))
    return F.date_add(F.next_day(F.date_sub(first, 1), "FRI"), 14)


def contract_code(expiry: Column) -> Column:
    """H, M, U or Z and the year's last two digits."""
    return F.concat(F.element_at(F.array(*map(F.lit, "HMUZ")), (F.month(expiry) / 3).cast("int")), F.lpad((F.year(expiry) % 100).cast("string"), 2, "0"))


def roll_dates(days: DataFrame, day: str) -> DataFrame:
    """Expiries of the quarterly contracts, with their codes, of all years that the dates of a column fall in."""
    y = days.select(F.year(day).alias("year")).where("year is not null").distinct().select("year", F.explode(F.array(*map(F.lit, (3, 6, 9, 12)))).alias("month"))
    expiry = third_friday(F.col("year"), F.col("month"))
    return y.select("year", "month", expiry.alias("expiry"), contract_code(expiry).alias("code"))


def quarter_expiry(day: Column) -> Column:
    """The first quarterly expiry on or after a day."""
    own = third_friday(F.year(day), (F.quarter(day) * 3).cast("int"))
    after = F.add_months(F.trunc(day, "quarter"), 3)
    return F.when(day <= own, own).otherwise(third_friday(F.year(after), (F.quarter(after) * 3).cast("int")))


def contracts(days: DataFrame, day: str, window: int = 4) -> DataFrame:
    """Each date once, with the front contract (the first that hasn't expired), the one after it, the days to expiry, and whether the roll is near."""
    d = days.select(F.to_date(day).alias("day")).where("day is not null").distinct()
    d = d.withColumn("expiry", quarter_expiry(F.col("day"))).withColumn("next", quarter_expiry(F.date_add("expiry", 1)))
    left = F.datediff("expiry", "day")
    before = third_friday(F.year(F.add_months("expiry", -3)), F.month(F.add_months("expiry", -3)))
    return d.select("day", contract_code(F.col("expiry")).alias("front"), contract_code(F.col("next")).alias("deferred"), left.alias("days_left"), ((left <= window) | (F.datediff("day", before) <= window)).alias("near_roll"))


def near_roll(day: Column, expiries: list, window: int = 4) -> Column:
    """Within `window` days of an expiry."""
    out = F.lit(False)
    for e in expiries:
        out = out | (F.abs(F.datediff(day, F.lit(e))) <= window)
    return out
