"""Live footprints: flags that are revised from unconfirmed to faded or confirmed, and the signals of operators.live, as keyed state with timers.

State of an instrument: the bar under way (range, deltas), a map from price to its volumes, a map from side and price to its flag, and when each side gave its last signal. A bar
closes when a print of a later one comes, or by a timer once the watermark has passed its end. State is read once for a batch of rows and what changed is written
back, so a batch costs what it touches. The log of revisions is append-only: the last row of (bar, side, price, first_us) holds.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.bars import SECOND
from ..operators.live import Bar, Gates, Rule, fired

REVISIONS = "instrument string, kind string, bar_us long, side string, px long, first_us long, at_us long, state string, updates long, volume long, against long, peak double, seq long, from_px long, to_px long, raw long, diagonal long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Footprints(StatefulProcessor):
    """See the module. kind: flag or signal."""

    def __init__(self, seconds: int, rule: Rule, gates: Gates) -> None:
        self.width, self.rule, self.gates = seconds * SECOND, rule, gates

    def init(self, handle) -> None:
        self.handle = handle
        self.bar = handle.getValueState("bar", "bar_us long, low long, high long, raw long, diagonal long, start long")
        self.levels = handle.getMapState("levels", "px long", "bought long, sold long")
        self.flags = handle.getMapState("flags", "side string, px long", "first_us long, first_seq long, updates long, volume long, against long, peak double, nth long")
        self.fired = handle.getMapState("fired", "side string", "us long")

    def _load(self) -> tuple[int | None, Bar, dict]:
        bar = Bar(self.rule)
        if not self.bar.exists():
            return None, bar, {}
        bar_us, bar.low, bar.high, bar.raw, bar.diagonal, bar.start = self.bar.get()
        bar.levels = {k[0]: tuple(v) for k, v in self.levels.iterator()}
        for k, v in sorted(self.flags.iterator(), key=lambda x: x[1][6]):
            bar.flags[k[0], k[1]] = [*v[:5], v[5]]
            bar.runs[k[0]].add(k[1])
        return bar_us, bar, {k[0]: v[0] for k, v in self.fired.iterator()}

    def _save(self, bar_us: int, bar: Bar, last: dict, old: Bar, old_us: int | None) -> None:
        """Writes what differs from the state that was loaded."""
        if bar_us != old_us:
            self.levels.clear()
            self.flags.clear()
            old = Bar(self.rule)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((bar_us + self.width) // 1000)
        self.bar.update((bar_us, bar.low, bar.high, bar.raw, bar.diagonal, bar.start))
        for px, v in bar.levels.items():
            if old.levels.get(px) != v:
                self.levels.updateValue((px,), v)
        for key in old.flags.keys() - bar.flags.keys():
            self.flags.removeKey(key)
        for nth, (key, v) in enumerate(bar.flags.items()):
            self.flags.updateValue(key, (*v, nth))
        for side, us in last.items():
            self.fired.updateValue((side,), (us,))

    def _row(self, key, bar_us, side, px, flag, at, state) -> tuple:
        return key[0], "flag", bar_us, side, px, flag[0], at, state, flag[2], flag[3], flag[4], flag[5], None, None, None, None, None

    def _closed(self, key, bar_us, bar: Bar) -> list[tuple]:
        return [self._row(key, bar_us, side, px, f, bar_us + self.width, "confirmed") for (side, px), f in sorted(bar.flags.items())]

    def _frame(self, rows: list[tuple]):
        import pandas as pd

        frame = pd.DataFrame(rows, columns=[f.split()[0] for f in REVISIONS.split(", ")])
        whole = ("px", "first_us", "updates", "volume", "against", "seq", "from_px", "to_px", "raw", "diagonal")
        return frame.astype(dict.fromkeys(whole, "Int64") | {"peak": "float64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import copy

        import pandas as pd

        bar_us, bar, last = self._load()
        old_us, old, out = bar_us, copy.deepcopy(bar), []
        for us, seq, px, sz, side in pd.concat(list(rows)).sort_values("seq")[["us", "seq", "px_ticks", "sz", "side"]].itertuples(index=False, name=None):
            at = us // self.width * self.width
            if at != bar_us:
                if bar_us is not None:
                    out += self._closed(key, bar_us, bar)
                bar_us, bar = at, Bar(self.rule)
            known = set(bar.flags)
            out += [self._row(key, bar_us, s, p, f, us, "faded") for s, p, f in bar.add(us, seq, px, sz, side == "B")]
            out += [self._row(key, bar_us, s, p, bar.flags[s, p], us, "unconfirmed") for s, p in bar.flags.keys() - known]
            found = fired(bar, self.gates, us, last)
            if found:
                last[found[0]] = us
                out.append((key[0], "signal", bar_us, found[0], px, None, us, None, None, None, None, None, seq, found[1], found[2], bar.raw, bar.diagonal))
        self._save(bar_us, bar, last, old, old_us)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        bar_us, bar, _ = self._load()
        if bar_us is None or expiredTimerInfo.getExpiryTimeInMs() * 1000 < bar_us + self.width:
            return
        out = self._closed(key, bar_us, bar)
        self.bar.clear()
        self.levels.clear()
        self.flags.clear()
        yield self._frame(out)

    def close(self) -> None:
        pass


def footprints(prints: DataFrame, seconds: int, late: str, rule: Rule = Rule(), gates: Gates = Gates()) -> DataFrame:
    """The log of flags and signals of live prints (seq, ts, us, instrument, px_ticks, sz, side). Prints later than `late` behind the newest are dropped. Sets the
    session's state store to the one that keyed state with timers needs."""
    prints.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = prints.where(F.col("side").isin("B", "A")).withWatermark("ts", late)
    return rows.groupBy("instrument").transformWithStateInPandas(Footprints(seconds, rule, gates), REVISIONS, "Append", "EventTime")


def settled(log: DataFrame) -> DataFrame:
    """The last revision of each flag of a log."""
    last = F.max_by(F.struct("at_us", "state", "updates", "volume", "against", "peak"), F.struct("at_us", F.when(F.col("state") == "unconfirmed", 0).otherwise(1)))
    return log.where("kind = 'flag'").groupBy("instrument", "bar_us", "side", "px", "first_us").agg(last.alias("x")).select("instrument", "bar_us", "side", "px", "first_us", "x.*")
