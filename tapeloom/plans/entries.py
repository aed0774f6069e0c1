"""Queries on composite entries and on setups of footprints."""

from ..operators import entries as O
from ..operators import profile as P
from ..sources.fixtures import TAPE, TOUCH, tape, touch, with_
from .bars import FLOW, HOUR, OHLC, bars_sql
from .flow import L1
from .profile import DAY_US, FLAGS, FP

FRAMES, FOUR = [4 * HOUR, 12 * HOUR, 24 * HOUR], 4 * HOUR


def sided(s, sf):
    t = tape(s, sf)
    return O.sided(O.slices(t, touch(t), HOUR), FRAMES, 6, 40, 1.0, 1.5, 4)


def entered(rules: str):
    return lambda s, sf: O.entries(sided(s, sf), rules.split(" "), 6 * HOUR)


def setups(s, sf):
    t = tape(s, sf)
    return O.setups(P.imbalances(P.footprint(t, FOUR), 3.0, 5), O.time_bars(t, FOUR), FOUR, 2, 1)


RULES = {"entries_ofi_agree": "ofi agree", "entries_book_delta": "book delta", "entries_all": "ofi agree book delta"}
QUERIES = {
    "tape_slices": lambda s, sf: O.slices(tape(s, sf), touch(tape(s, sf)), HOUR),
    "rule_sides": lambda s, sf: sided(s, sf).select("instrument", "at_us", "z", "ofi", "agree", "book", "delta"),
    "footprint_setups": setups,
    **{name: entered(rules) for name, rules in RULES.items()},
}

SLICES = with_(
    TAPE,
    TOUCH,
    L1,
    f"""sp AS (SELECT instrument, us // 3600000000 * 3600000000 AS at_us, {OHLC}, {FLOW.format(s="sz")} FROM tape GROUP BY 1, 2),
sb AS (SELECT t.instrument, us // 3600000000 * 3600000000 AS at_us, coalesce(sum(ofi), 0)::BIGINT AS ofi, arg_max(bid_sz, t.seq) AS bid_sz, arg_max(ask_sz, t.seq) AS ask_sz FROM touch t JOIN l1 USING (instrument, seq) GROUP BY 1, 2),
sl AS (SELECT instrument, at_us, open, high, low, close, volume, delta, prints, ofi, bid_sz, ask_sz FROM sp JOIN sb USING (instrument, at_us))""",
)
_WAYS = ", ".join(f"sign(close - first(close) OVER (PARTITION BY instrument, at_us // {f * 1_000_000} ORDER BY at_us)) AS w{i}" for i, f in enumerate(FRAMES))
SIDED = (
    SLICES
    + f""", r1 AS (SELECT *, CASE WHEN count(*) OVER w = 6 THEN sum(ofi) OVER w END AS race, count(*) OVER d = 4 AS full4, sum(delta) OVER d AS d4, {_WAYS} FROM sl WINDOW w AS (PARTITION BY instrument ORDER BY at_us ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), d AS (PARTITION BY instrument ORDER BY at_us ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
r2 AS (SELECT *, CASE WHEN count(race) OVER w = 40 AND stddev_pop(race) OVER w > 0 THEN (race - avg(race) OVER w) / stddev_pop(race) OVER w END AS z FROM r1 WINDOW w AS (PARTITION BY instrument ORDER BY at_us ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)),
sd AS (SELECT instrument, at_us, close, z, CAST(CASE WHEN abs(z) >= 1 THEN sign(z) ELSE 0 END AS INTEGER) AS ofi, CAST(CASE WHEN w0 = w1 AND w1 = w2 THEN w0 ELSE 0 END AS INTEGER) AS agree, CASE WHEN bid_sz >= ask_sz * 1.5 THEN 1 WHEN ask_sz >= bid_sz * 1.5 THEN -1 ELSE 0 END AS book, CAST(CASE WHEN full4 THEN sign(d4) ELSE 0 END AS INTEGER) AS delta FROM r2)"""
)


def entries_sql(rules: str) -> str:
    first, *rest = rules.split(" ")
    same = " AND ".join([f"{first} <> 0", *(f"{r} = {first}" for r in rest)])
    return (
        SIDED.replace("WITH ", "WITH RECURSIVE ", 1)
        + f""", cd AS (SELECT instrument, at_us, close, {first} AS side, z, row_number() OVER (PARTITION BY instrument ORDER BY at_us) AS i FROM sd WHERE {same}),
en AS (SELECT *, at_us AS taken FROM cd WHERE i = 1
  UNION ALL SELECT cd.instrument, cd.at_us, cd.close, cd.side, cd.z, cd.i, CASE WHEN cd.at_us >= en.taken + {6 * HOUR * 1_000_000} THEN cd.at_us ELSE en.taken END FROM en JOIN cd ON cd.instrument = en.instrument AND cd.i = en.i + 1)
SELECT instrument, at_us, close, side, z FROM en WHERE taken = at_us"""
    )


ORACLE = {
    "tape_slices": SLICES + "SELECT * FROM sl",
    "rule_sides": SIDED + "SELECT instrument, at_us, z, ofi, agree, book, delta FROM sd",
    "footprint_setups": with_(TAPE, bars_sql(FOUR), FP.replace(str(DAY_US), str(FOUR * 1_000_000)), FLAGS)
    + f""", f AS (SELECT instrument, bar_us, px, side, CASE side WHEN 1 THEN ask_vol ELSE bid_vol END AS v FROM fl, (VALUES (1), (-1)) s(side) WHERE CASE side WHEN 1 THEN buy_flag ELSE sell_flag END),
i AS (SELECT *, px - row_number() OVER (PARTITION BY instrument, bar_us, side ORDER BY px) AS isl FROM f),
g AS (SELECT instrument, bar_us, side, isl, min(px) AS lo, max(px) AS hi, count(*) AS n, sum(v) AS v FROM i GROUP BY 1, 2, 3, 4),
r AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY instrument, bar_us, side ORDER BY n DESC, lo) = 1 AND count(*) OVER (PARTITION BY instrument, bar_us, side) = count(*) OVER (PARTITION BY instrument, bar_us)),
o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY instrument, bar_us, side ORDER BY v DESC, px) = 1),
b AS (SELECT r.*, o.px, o.v AS ov, high, low, close FROM r JOIN o USING (instrument, bar_us, side) JOIN bars USING (instrument, bar_us))
SELECT instrument, bar_us, bar_us + {FOUR * 1_000_000} AS at_us, side, close AS entry_px, kind, CASE WHEN kind = 'single' THEN px WHEN side = 1 THEN lo ELSE hi END AS flag_px, CASE kind WHEN 'single' THEN 1 ELSE n END AS run, CASE kind WHEN 'single' THEN ov ELSE v END AS volume
FROM b, (VALUES ('single'), ('stacked'), ('extreme')) k(kind) WHERE kind = 'single' OR n >= 2 AND (kind = 'stacked' OR CASE side WHEN 1 THEN lo <= low + 1 ELSE hi >= high - 1 END)""",
    **{name: entries_sql(rules) for name, rules in RULES.items()},
}
