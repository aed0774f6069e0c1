"""operators.stance live: prints and books, two inputs, in one keyed state. A change of stance is given when it comes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from ..operators.stance import FIELDS, Conditions, Stance, plain, told
from .live import STORE


class Stances(StatefulProcessor):
    """State of an instrument: what stands now, signed volume by price, recent prints, candles, the book."""

    def __init__(self, rule: Conditions) -> None:
        self.rule = rule

    def init(self, handle) -> None:
        self.now = handle.getValueState("now", "stance int, opened long, volume long")
        self.levels = handle.getMapState("levels", "px long", "signed long")
        self.recent = handle.getListState("recent", "us long, px long, sz long")
        self.candles = handle.getListState("candles", "volume long")
        self.resting = handle.getListState("resting", "bid boolean, px long, sz long")

    def _load(self) -> Stance:
        state = Stance(self.rule)
        if self.now.exists():
            state.stance, state.opened, state.volume = self.now.get()
            for k, v in self.levels.iterator():
                state.level(k[0], v[0])
            for print_ in self.recent.get():
                state.remember(*print_)
            for (volume,) in self.candles.get():
                state.candle(volume)
            book = list(self.resting.get())
            state.book([(p, s) for bid, p, s in book if bid], [(p, s) for bid, p, s in book if not bid])
        return state

    def _save(self, state: Stance, touched: set) -> None:
        self.now.update((state.stance, state.opened, state.volume))
        for px in touched:
            self.levels.updateValue((px,), (state.levels[px],))
        for kept, rows in ((self.recent, list(state.recent)), (self.candles, [(v,) for v in state.candles]), (self.resting, [(True, *x) for x in state.bids] + [(False, *x) for x in state.asks])):
            if rows:
                kept.put(rows)
            else:
                kept.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        state, touched, out = self._load(), set(), []
        whole = pd.concat(list(rows)).sort_values(["us", "seq", "o"])
        pairs = lambda px, sz: () if px is None else zip(map(int, px), map(int, sz))
        for us, seq, o, px, sz, buys, bid_px, bid_sz, ask_px, ask_sz in whole[["us", "seq", "o", "px", "sz", "buys", "bids_px", "bids_sz", "asks_px", "asks_sz"]].itertuples(index=False, name=None):
            if not o:
                state.book(pairs(bid_px, bid_sz), pairs(ask_px, ask_sz))
                continue
            touched.add(int(px))
            if change := state.add(us, int(px), int(sz), bool(buys)):
                out.append((key[0], *told(seq, us, int(px), change)))
        self._save(state, touched)
        yield pd.DataFrame(out, columns=["instrument", *(f.split()[0] for f in FIELDS.split(", "))])

    def close(self) -> None:
        pass


def transitions(rows: DataFrame, rule: Conditions = Conditions()) -> DataFrame:
    """rows: operators.stance.feed() of two streams, or of one."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return plain(rows).groupBy("instrument").transformWithStateInPandas(Stances(rule), f"instrument string, {FIELDS}", "Append", "None")
