"""The batch operators on live prints, as Structured Streaming.

Time bars are windowed aggregates with a watermark: a bar is given once the watermark has passed its end, later prints of it are dropped. Threshold
bars keep a few numbers of state per instrument (applyInPandasWithState) and restart from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prints_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of trades from the Parquet files of a folder that are called `name`."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def events_as_prints(events: DataFrame) -> DataFrame:
    """seq, ts, instrument, sz, side of the driver's events."""
    side = F.when(F.col("event_type").isin("purchase", "signup"), "B").when(F.col("event_type").isin("click", "error"), "A").otherwise("N")
    return events.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("M"), (F.col("user_id") % 8).cast("string")).alias("instrument"), (1 + F.floor(F.col("value") / 10)).cast("long").alias("sz"), side.alias("side"))


def time_bars(prints: DataFrame, width: str, late: str) -> DataFrame:
    """Volume, delta and prints by instrument and window; prints later than `late` behind the newest are dropped."""
    signed = F.when(F.col("side") == "B", F.col("sz")).when(F.col("side") == "A", -F.col("sz")).otherwise(0)
    g = prints.withWatermark("ts", late).groupBy("instrument", F.window("ts", width).alias("w"))
    return g.agg(F.sum("sz").alias("volume"), F.sum(signed).alias("delta"), F.count("*").alias("prints")).select("instrument", F.unix_micros("w.start").alias("bar_us"), "volume", "delta", "prints")


def session_activity(prints: DataFrame, gap: str, late: str) -> DataFrame:
    """Volume and prints by instrument and session; a session ends where no print follows within `gap`."""
    g = prints.withWatermark("ts", late).groupBy("instrument", F.session_window("ts", gap).alias("w"))
    return g.agg(F.sum("sz").alias("volume"), F.count("*").alias("prints")).select("instrument", F.unix_micros("w.start").alias("start_us"), "volume", "prints")


def delta_bars(prints: DataFrame, threshold: int) -> DataFrame:
    """Bars that close when |buys - sells| reaches threshold: instrument, bar, first_seq, last_seq, volume, delta. State: the open bar."""

    def run(key, frames: Iterator, state) -> Iterator:
        import pandas as pd

        bar, first, volume, delta = state.get if state.exists else (0, -1, 0, 0)
        out = []
        pdf = pd.concat(list(frames)).sort_values("seq")
        for seq, sz, side in zip(pdf["seq"], pdf["sz"], pdf["side"]):
            first = int(seq) if first < 0 else first
            volume, delta = volume + int(sz), delta + (int(sz) if side == "B" else -int(sz) if side == "A" else 0)
            if abs(delta) >= threshold:
                out.append((key[0], bar, first, int(seq), volume, delta))
                bar, first, volume, delta = bar + 1, -1, 0, 0
        state.update((bar, first, volume, delta))
        yield pd.DataFrame(out, columns=["instrument", "bar", "first_seq", "last_seq", "volume", "delta"])

    return prints.groupBy("instrument").applyInPandasWithState(run, "instrument string, bar long, first_seq long, last_seq long, volume long, delta long", "bar long, first long, volume long, delta long", "append", "NoTimeout")


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that is there now, appending to a Parquet table in folder, and reads the table."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def events_as_touches(events: DataFrame) -> DataFrame:
    """seq, ts, us, instrument, bid_px, ask_px, bid_sz, ask_sz: a top of book read off each of the driver's events alone."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.concat(F.lit("M"), (F.col("user_id") % 8).cast("string")).alias("instrument"), (20000 + k % 7).alias("bid_px"), (20001 + k % 7 + k % 3).alias("ask_px"), (1 + k % 50).alias("bid_sz"), (1 + k % 37).alias("ask_sz"))


def ofi_bars(touches: DataFrame, threshold: int, max_s: int, min_updates: int) -> DataFrame:
    """operators.sequential.ofi_bars live: a bar is given when it closes. State: the open bar and the touch before, by instrument."""
    fields = ("seen", "bid_px", "ask_px", "bid_sz", "ask_sz", "bar", "acc", "n", "start", "opened", "high", "low", "before", "path")

    def run(key, frames: Iterator, state) -> Iterator:
        import pandas as pd

        s = dict(zip(fields, state.get if state.exists else [0] * len(fields)))
        out = []
        for us, seq, bid, ask, bsz, asz in pd.concat(list(frames)).sort_values("seq")[["us", "seq", "bid_px", "ask_px", "bid_sz", "ask_sz"]].itertuples(index=False, name=None):
            mid, ofi = bid + ask, 0
            if s["seen"]:
                ofi = (bsz if bid > s["bid_px"] else -s["bid_sz"] if bid < s["bid_px"] else bsz - s["bid_sz"]) - (asz if ask < s["ask_px"] else -s["ask_sz"] if ask > s["ask_px"] else asz - s["ask_sz"])
            else:
                s.update(start=us, opened=mid, high=mid, low=mid, before=mid)
            s.update(seen=1, bid_px=bid, ask_px=ask, bid_sz=bsz, ask_sz=asz, path=s["path"] + abs(mid - s["before"]), high=max(s["high"], mid), low=min(s["low"], mid), before=mid, acc=s["acc"] + ofi, n=s["n"] + 1)
            colour = "GREEN" if s["acc"] >= threshold else "RED" if s["acc"] <= -threshold else "CHOP" if us - s["start"] >= max_s * 1_000_000 and s["n"] >= min_updates else None
            if colour:
                out.append((key[0], s["bar"], seq, colour, s["opened"], s["high"], s["low"], mid, s["acc"], s["n"], s["path"]))
                s.update(bar=s["bar"] + 1, acc=0, n=0, start=us, opened=mid, high=mid, low=mid, path=0)
        state.update(tuple(int(s[f]) for f in fields))
        yield pd.DataFrame(out, columns=["instrument", "bar", "last_seq", "colour", "open2", "high2", "low2", "close2", "ofi", "updates", "path2"])

    out = "instrument string, bar long, last_seq long, colour string, open2 long, high2 long, low2 long, close2 long, ofi long, updates long, path2 long"
    return touches.groupBy("instrument").applyInPandasWithState(run, out, ", ".join(f"{f} long" for f in fields), "append", "NoTimeout")


def stance(prints: DataFrame, tau_s: float, enter: float, leave: float) -> DataFrame:
    """The side that decayed signed volume stands on: long above enter, flat again below leave, short likewise; a row for each change. State: the
    decayed sum, the time before and the stance, by instrument."""

    def run(key, frames: Iterator, state) -> Iterator:
        import math

        import pandas as pd

        lean, before, side = state.get if state.exists else (0.0, -1, "flat")
        out = []
        for us, seq, sz, way in pd.concat(list(frames)).sort_values("seq")[["us", "seq", "sz", "side"]].itertuples(index=False, name=None):
            lean *= 1.0 if before < 0 else math.exp(-(us - before) / 1e6 / tau_s)
            lean, before = lean + (sz if way == "B" else -sz if way == "A" else 0), us
            fresh = "long" if lean > enter else "short" if lean < -enter else "flat"
            new = side if (side == "long" and lean >= leave) or (side == "short" and lean <= -leave) else fresh
            if new != side:
                out.append((key[0], seq, side, new))
            side = new
        state.update((float(lean), int(before), side))
        yield pd.DataFrame(out, columns=["instrument", "seq", "old", "new"])

    return prints.withColumn("us", F.unix_micros("ts")).groupBy("instrument").applyInPandasWithState(run, "instrument string, seq long, old string, new string", "lean double, before long, side string", "append", "NoTimeout")
