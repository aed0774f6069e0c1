"""Queries on what is stored: observations, changes, counts, tallies, and the sinks read back."""

from pyspark.sql import functions as F

from ..functions.market import pit
from ..operators import ledger as O
from ..operators import outcomes as X
from ..sources import sinks as S
from ..sources.fixtures import LEDGER, POSITIONS, TAPE, daily, ledger, positions, table, tape, with_
from ..sources.scratch import place
from .bars import BARS, hours
from .levels import EVENTS
from .outcomes import HORIZON, prints, touches
from .positions import DIFF, SPOT, diff


def observations(s, sf):
    """Resolved touches beside the snapshot (500 events) and the size that they belong to."""
    t = X.first_touch(touches(s, sf), prints(s, sf), HORIZON).where("prints > 0").select("event_id", "touched", "minutes")
    c = touches(s, sf).join(tape(s, sf).select(F.col("seq").alias("event_id"), (F.col("sz") * F.col("px_ticks")).alias("notional")), "event_id")
    return c.join(t, "event_id").select("event_id", F.floor(F.col("event_id") / 500).alias("snapshot"), "instrument", "spot", "level", "notional", F.when(F.col("level") >= F.col("spot"), "above").otherwise("below").alias("side"), "touched", F.round(F.col("minutes") * 60e6).cast("long").alias("wait_us"))


def tally(s, sf):
    b = hours(s, sf)
    regime = F.when(F.col("volume") >= 40, "busy").when(F.col("volume") >= 15, "normal").when(F.col("volume") >= 5, "quiet")
    way = lambda c: F.when(c > 0, "up").when(c < 0, "down")
    return O.regime_tally(b.select(regime.alias("regime"), way(F.col("delta")).alias("read"), way(F.col("close") - F.col("open")).alias("outcome")), 20)


def looks(s, sf):
    """Each print is a look at its four-hour bar; its PIT is the share of ten points around the bar's open below its close."""
    p = tape(s, sf).withColumns({"bar_us": F.floor(F.col("us") / 14_400_000_000) * 14_400_000_000, "slot": F.floor((F.col("us") % 14_400_000_000) / 1_440_000_000)})
    b = hours(s, sf).withColumn("bar_us", F.floor(F.col("bar_us") / 14_400_000_000) * 14_400_000_000).groupBy("instrument", "bar_us").agg(F.max("close").alias("c"))
    u = pit(F.col("c"), F.transform(F.sequence(F.lit(-4), F.lit(5)), lambda i: F.col("px_ticks") + i))
    return p.join(b, ["instrument", "bar_us"]).select("instrument", "bar_us", "seq", "slot", u.alias("u"))


def snapshot_sink(s, sf):
    """Two runs over overlapping sweeps leave what one run over both would."""
    folder = place(s, "store")
    p = positions(s, sf).select("sweep_id", "wallet", "coin", "szi")
    for sweeps in ([1], [1, 2]):
        some = p.where(F.col("sweep_id").isin(*sweeps))
        S.save_snapshot(folder, some.groupBy("sweep_id").agg(F.count("*").alias("n")), some, "sweep_id", ["sweep_id", "wallet", "coin"])
    parts, snaps = (s.read.parquet(f"{folder}/{t}") for t in ("parts", "snapshots"))
    return parts.join(snaps, "sweep_id").groupBy("sweep_id", "n").agg(F.count("*").alias("rows"), F.sum("szi").alias("szi")).withColumn("szi", F.round("szi", 3))


def dataset_sink(s, sf):
    """Daily bars saved twice by their day, the second time with new days among old ones."""
    folder = place(s, "store") + "/daily"
    d = daily(s, sf).withColumn("year", F.year("ts"))
    S.append_new(folder, d.where(F.dayofyear("ts") % 3 != 0), ["ts"], "year")
    S.append_new(folder, d.withColumn("close", F.col("close") + 1), ["ts"], "year")
    return s.read.parquet(folder).select("ts", "open", "close", "volume")


def exported(s, sf):
    folder = place(s, "store") + "/trades.csv"
    t = ledger(s, sf).select("order_id", "supp", "coin", "net_bps", "exit_reason")
    S.export_csv(t, folder, ["order_id", "supp", "net_bps"])
    return s.read.option("header", True).schema(t.schema).csv(folder).groupBy("coin", "exit_reason").agg(F.count("*").alias("n"), F.sum("net_bps").alias("net_bps"))


QUERIES = {
    "observation_rows": observations,
    "recent_changes": lambda s, sf: O.recent(diff(s, sf), ["ADDED", "DEFENDED"], [F.desc("size_change"), F.col("wallet"), F.col("coin")], 40).select("wallet", "coin", "kind", "size_change"),
    "ledger_counts": lambda s, sf: O.counts({"trades": (ledger(s, sf), F.lit(True)), "stopped": (ledger(s, sf), F.col("exit_reason") == "stop"), "automatic": (ledger(s, sf), F.col("source") == "auto"), "orders": (table(s, sf, "orders"), F.lit(True))}),
    "suspect_trades": lambda s, sf: O.suspect(ledger(s, sf), 80.0).select("order_id", "supp", "coin", "net_bps", "held_s"),
    "regime_tally": tally,
    "first_looks": lambda s, sf: O.first_looks(looks(s, sf), ["instrument", "bar_us"], "seq"),
    "looks_by_slot": lambda s, sf: looks(s, sf).groupBy("slot").agg(F.count("*").alias("n"), F.avg("u").alias("mean")),
    "sink_snapshot": snapshot_sink,
    "sink_dataset": dataset_sink,
    "export_csv": exported,
}

LOOKS = """, b AS (SELECT instrument, bar_us // 14400000000 * 14400000000 AS bar_us, max(close) AS c FROM bars GROUP BY ALL),
lk AS (SELECT t.instrument, b.bar_us, seq, us % 14400000000 // 1440000000 AS slot, len(list_filter(range(-4, 6), lambda i: px_ticks + i < c)) / 10 AS u FROM tape t JOIN b ON b.instrument = t.instrument AND b.bar_us = t.us // 14400000000 * 14400000000)"""

ORACLE = {
    "observation_rows": with_(TAPE, EVENTS)
    + " SELECT event_id, block AS snapshot, instrument, spot, level, notional, CASE WHEN level >= spot THEN 'above' ELSE 'below' END AS side, touched = 1 AS touched, hit_us - at_us AS wait_us FROM ob",
    "recent_changes": with_(POSITIONS) + DIFF + " SELECT wallet, coin, kind, size_change FROM d WHERE kind IN ('ADDED', 'DEFENDED') ORDER BY size_change DESC, wallet, coin LIMIT 40",
    "ledger_counts": with_(LEDGER) + "SELECT 'trades' AS what, count(*) AS n FROM ledger UNION ALL SELECT 'stopped', count_if(exit_reason = 'stop') FROM ledger UNION ALL SELECT 'automatic', count_if(source = 'auto') FROM ledger UNION ALL SELECT 'orders', count(*) FROM orders",
    "suspect_trades": with_(LEDGER) + "SELECT order_id, supp, coin, net_bps, held_s FROM ledger WHERE abs(net_bps) > 80",
    "regime_tally": BARS
    + """, x AS (SELECT CASE WHEN volume >= 40 THEN 'busy' WHEN volume >= 15 THEN 'normal' WHEN volume >= 5 THEN 'quiet' END AS regime, CASE WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' END AS rd, CASE WHEN close > open THEN 'up' WHEN close < open THEN 'down' END AS oc FROM bars),
g AS (SELECT regime, count(*) AS n, count(*) FILTER (oc = rd) AS r, count(*) FILTER (oc <> rd) AS w, count(*) FILTER (oc IS NULL) AS f FROM x WHERE regime IS NOT NULL AND rd IS NOT NULL GROUP BY regime)
SELECT regime, n, r AS "right", w AS wrong, f AS flat, r + w >= 20 AS enough, CASE WHEN r + w >= 20 THEN r / (r + w) END AS share FROM g""",
    "first_looks": BARS + LOOKS + " SELECT instrument, bar_us, min(seq) AS seq, arg_min(slot, seq) AS slot, arg_min(u, seq) AS u FROM lk GROUP BY ALL",
    "looks_by_slot": BARS + LOOKS + " SELECT slot, count(*) AS n, avg(u) AS mean FROM lk GROUP BY slot",
    "sink_snapshot": with_(POSITIONS) + "SELECT sweep_id, count(*) AS n, count(*) AS rows, round(sum(szi), 3) AS szi FROM positions GROUP BY sweep_id",
    "sink_dataset": "WITH d AS (SELECT o_orderdate AS ts, arg_min(px, o_orderkey) AS open, arg_max(px, o_orderkey) AS close, count(*) AS volume FROM (SELECT *, CAST(round(o_totalprice) AS BIGINT) AS px FROM orders) GROUP BY o_orderdate) SELECT ts, open, close + CASE WHEN dayofyear(ts) % 3 = 0 THEN 1 ELSE 0 END AS close, volume FROM d",
    "export_csv": with_(LEDGER) + "SELECT coin, exit_reason, count(*) AS n, CAST(sum(net_bps) AS BIGINT) AS net_bps FROM ledger GROUP BY ALL",
}
