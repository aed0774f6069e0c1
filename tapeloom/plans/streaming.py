"""Queries that run as streams over the driver's events until all is read."""

from ..sources.fixtures import TAPE, with_
from ..sources.scratch import place
from ..streaming import bars as S
from .flow import L1
from .sequential import JOIN, OFI_BARS, ordered, recursive


def prints(s, sf):
    return S.events_as_prints(S.prints_stream(s, sf, "events.parquet"))


QUERIES = {
    "stream_bars": lambda s, sf: S.drain(S.time_bars(prints(s, sf), "4 hours", "1 hour"), place(s, "stream")),
    "stream_sessions": lambda s, sf: S.drain(S.session_activity(prints(s, sf), "2 hours", "1 hour"), place(s, "stream")),
    "stream_delta_bars": lambda s, sf: S.drain(S.delta_bars(prints(s, sf), 100), place(s, "stream")),
    "stream_ofi_bars": lambda s, sf: S.drain(S.ofi_bars(S.events_as_touches(S.prints_stream(s, sf, "events.parquet")), 100, 6 * 3600, 5), place(s, "stream")),
    "stream_stance": lambda s, sf: S.drain(S.stance(prints(s, sf), 6 * 3600.0, 12.0, 5.0), place(s, "stream")),
}

ORACLE = {
    "stream_bars": with_(TAPE)
    + """, b AS (SELECT instrument, us // 14400000000 * 14400000000 AS bar_us, CAST(sum(sz) AS BIGINT) AS volume, CAST(sum(CASE side WHEN 'B' THEN sz WHEN 'A' THEN -sz ELSE 0 END) AS BIGINT) AS delta, count(*) AS prints FROM tape GROUP BY ALL)
SELECT * FROM b WHERE bar_us + 14400000000 <= (SELECT max(us) FROM tape) // 1000 * 1000 - 3600000000""",
    "stream_sessions": with_(TAPE)
    + """, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY instrument ORDER BY us) < 7200000000 THEN 0 ELSE 1 END AS f FROM tape),
s AS (SELECT *, sum(f) OVER (PARTITION BY instrument ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM g)
SELECT instrument, min(us) AS start_us, CAST(sum(sz) AS BIGINT) AS volume, count(*) AS prints FROM s GROUP BY instrument, session HAVING max(us) + 7200000000 <= (SELECT max(us) FROM tape) // 1000 * 1000 - 3600000000""",
    "stream_delta_bars": with_(TAPE, "o AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY seq) AS i FROM tape)").replace("WITH ", "WITH RECURSIVE ", 1)
    + """, st AS (SELECT instrument, i, seq, seq AS first_seq, sz AS volume, CASE side WHEN 'B' THEN sz WHEN 'A' THEN -sz ELSE 0 END AS delta, 0 AS bar FROM o WHERE i = 1
  UNION ALL SELECT o.instrument, o.i, o.seq, CASE WHEN abs(delta) >= 100 THEN o.seq ELSE first_seq END, CASE WHEN abs(delta) >= 100 THEN 0 ELSE volume END + o.sz, CASE WHEN abs(delta) >= 100 THEN 0 ELSE delta END + CASE side WHEN 'B' THEN sz WHEN 'A' THEN -sz ELSE 0 END, CASE WHEN abs(delta) >= 100 THEN bar + 1 ELSE bar END FROM st JOIN o ON o.instrument = st.instrument AND o.i = st.i + 1)
SELECT instrument, CAST(bar AS BIGINT) AS bar, first_seq, seq AS last_seq, volume, delta FROM st WHERE abs(delta) >= 100""",
    "stream_ofi_bars": recursive(
        TAPE,
        "touch AS (SELECT seq, us, instrument, 20000 + k % 7 AS bid_px, 20001 + k % 7 + k % 3 AS ask_px, 1 + k % 50 AS bid_sz, 1 + k % 37 AS ask_sz FROM tape)",
        L1,
        "lt AS (SELECT t.*, coalesce(l.ofi, 0) AS ofi FROM touch t JOIN l1 l USING (instrument, seq))",
        ordered("lt"),
    )
    + OFI_BARS
    + "SELECT * FROM ob WHERE colour <> 'OPEN'",
    "stream_stance": recursive(TAPE, ordered("tape"))
    + f""", st AS (SELECT instrument, i, seq, us, CASE side WHEN 'B' THEN sz WHEN 'A' THEN -sz ELSE 0 END::DOUBLE AS lean, 'flat' AS old, CASE WHEN CASE side WHEN 'B' THEN sz WHEN 'A' THEN -sz ELSE 0 END > 12 THEN 'long' WHEN CASE side WHEN 'B' THEN sz WHEN 'A' THEN -sz ELSE 0 END < -12 THEN 'short' ELSE 'flat' END AS stance FROM o WHERE i = 1
  UNION ALL SELECT instrument, i, seq, us, lean, stance, CASE WHEN stance = 'long' AND lean >= 5 OR stance = 'short' AND lean <= -5 THEN stance WHEN lean > 12 THEN 'long' WHEN lean < -12 THEN 'short' ELSE 'flat' END FROM (
    SELECT o.instrument, o.i, o.seq, o.us, lean * exp(-(o.us - st.us) / 1e6 / 21600) + CASE side WHEN 'B' THEN sz WHEN 'A' THEN -sz ELSE 0 END AS lean, stance FROM st {JOIN}))
SELECT instrument, seq, old, stance AS new FROM st WHERE old <> stance""",
}
