"""Queries on the stance from prints and books."""

from pyspark.sql import functions as F

from ..operators import stance as O
from ..sources.fixtures import depth, tape
from ..sources.scratch import place
from ..streaming import bars as S
from ..streaming import stances as L
from .live import near

HOUR = 3_600_000_000
RULE = O.Conditions(2, 12 * HOUR, 0.4, 5, 24 * HOUR, 4, 0.2)


def live(s, sf):
    """Prints and books read off each event, the book of an event before its print."""
    events = S.prints_stream(s, sf, "events.parquet")
    touches = S.events_as_touches(events)
    level = lambda px, sz: F.array(F.struct(F.col(px).alias("px"), F.col(sz).alias("sz")))
    books = touches.select("instrument", "us", "seq", level("bid_px", "bid_sz").alias("bids"), level("ask_px", "ask_sz").alias("asks"))
    return S.drain(L.transitions(O.feed(near(events), books), RULE), place(s, "stream"))


QUERIES = {"stance_transitions": lambda s, sf: O.transitions(tape(s, sf), depth(tape(s, sf)), RULE), "stream_transitions": live}

ORACLE: dict[str, str] = {}
