"""The stance against a state built anew for every print, its table of turns, and the stream against the batch."""

import random
import statistics
import tempfile

import pytest

from tapeloom.operators import stance as O
from tapeloom.streaming import bars as S
from tapeloom.streaming import stances as L

PRINTS = "instrument string, us long, seq long, px_ticks long, sz long, side string"
BOOKS = "instrument string, us long, seq long, bids array<struct<px:long,sz:long>>, asks array<struct<px:long,sz:long>>"
RULE = O.Conditions(run=2, burst_us=4000, burst=0.4, candles=5, candle_us=3000, radius=3, over=1.1)


def market(n, seed):
    rng, px, us, prints, books = random.Random(seed), 100, 0, [], []
    for i in range(n):
        us += rng.randrange(1, 1500)
        px += rng.choice([-1, 0, 0, 1])
        m = f"M{rng.randrange(2)}"
        if rng.random() < 0.4:
            side = lambda s: [{"px": px + s * (j + 1), "sz": rng.randrange(0, 12)} for j in range(rng.randrange(0, 4))]  # noqa: B023, E731
            books.append((m, us, i, side(-1), side(1)))
        else:
            prints.append((m, us, i, px, rng.randrange(1, 15), rng.choice("BBAAN")))
    return prints, books


def anew(prints, books, rule):
    out = []
    for m in {x[0] for x in prints}:
        own, stance = sorted(x for x in prints if x[0] == m and x[5] != "N"), 0
        candles, opened, volume = [], None, 0
        for i, (_, us, seq, px, sz, _) in enumerate(own):
            if opened is not None and us - opened >= rule.candle_us:
                candles.append(volume)
                opened = None
            opened, volume = (us, sz) if opened is None else (opened, volume + sz)
            levels = {}
            for _, _, _, p, s, side in own[: i + 1]:
                levels[p] = levels.get(p, 0) + (s if side == "B" else -s)
            book = max((b for b in books if b[0] == m and (b[1], b[2]) <= (us, seq)), key=lambda b: b[1:3], default=None)
            median = statistics.median(candles[-rule.candles :]) if candles else 0
            met = {}
            for way in (1, -1):
                right = lambda p: levels.get(p, 0) * way > 0  # noqa: B023, E731
                runs = [(p, next(q for q in range(p, 999) if not right(q + 1))) for p in levels if right(p) and not right(p - 1)]
                runs = [r for r in runs if r[1] - r[0] + 1 >= rule.run]
                if not runs:
                    continue
                a, b = min(runs, key=lambda r: (r[0] - r[1], r[0]))
                burst = sum(s for _, t, _, p, s, _ in own[: i + 1] if t >= us - rule.burst_us and a <= p <= b)
                if median <= 0 or burst < rule.burst * median:
                    continue
                rests = sum(x["sz"] for x in (book[4] if way > 0 else book[3]) if abs(x["px"] - px) <= rule.radius) if book else 0
                met[way] = (bool(book and (book[3] or book[4])) and (rests <= 0 or burst > rule.over * rests), b - a + 1, burst, rests)
            turn = 1 if met.get(1, (False,))[0] else -1 if met.get(-1, (False,))[0] else 0
            new = turn if turn and turn != stance else 0 if stance and not turn and -stance in met else stance
            if new != stance:
                seen = met[new] if new else met[-stance]
                out.append((m, seq, us, px, O.NAMES[stance], O.NAMES[new], seen[1], seen[2], float(median), seen[3]))
                stance = new
    return out


def found(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_state_built_anew(spark, seed):
    prints, books = market(900, seed)
    want = anew(prints, books, RULE)
    assert found(O.transitions(spark.createDataFrame(prints, PRINTS), spark.createDataFrame(books, BOOKS), RULE)) == sorted(want)
    turns = {(x[4], x[5]) for x in want}
    assert len(want) > 10 and len(turns) >= 4 and {x[5] for x in want} == {"flat", "long", "short"}, turns


def stacked(book, rule=RULE, candle=10):
    s = O.Stance(rule)
    s.candle(candle)
    s.book(*book)
    return s


def test_table_of_turns():
    wall, clear, none = ([(99, 500)], [(103, 500)]), ([(99, 1)], [(103, 1)]), ((), ())
    for book, want in ((clear, 1), (wall, 0), (none, 0), (([(99, 5)], [(200, 500)]), 1)):
        s = stacked(book)
        s.add(0, 100, 10, True)
        s.add(1, 101, 10, True)
        assert s.stance == want
    s = stacked(clear)
    assert s.add(0, 100, 10, True) is None  # one price is no stack
    assert s.add(1, 101, 10, True)[:2] == (0, 1) and s.add(2, 101, 10, True) is None
    s.book(*wall)  # sellers stack and burst against a wall of bids: the stance ends, and doesn't turn
    assert s.add(3, 100, 40, False) is None and s.add(4, 101, 60, False)[:2] == (1, 0)
    s.book(*clear)
    assert s.add(5, 101, 1, False)[:2] == (0, -1)  # now the way is clear
    assert stacked(clear, candle=1000).add(0, 100, 10, True) is None
    quiet = O.Stance(RULE)
    quiet.book(*clear)
    assert quiet.add(0, 100, 10, True) is None and quiet.add(1, 101, 10, True) is None  # no candle, no median


def test_no_rows(spark):
    assert O.transitions(spark.createDataFrame([], PRINTS), spark.createDataFrame([], BOOKS)).count() == 0


def test_the_stream_of_two_inputs_is_the_batch(spark):
    folder, (prints, books) = tempfile.mkdtemp(prefix="spark-"), market(700, 5)

    def live():
        rows = O.feed(spark.createDataFrame([], PRINTS), spark.createDataFrame([], BOOKS))
        return L.transitions(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), RULE)

    whole = O.feed(spark.createDataFrame(prints, PRINTS), spark.createDataFrame(books, BOOKS))
    for a, b in ((0, 200), (200, 333), (333, 700)):
        whole.where(f"seq >= {a} and seq < {b}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if b == 333:
            S.drain(live(), folder)  # goes on from the checkpoint afterwards
    assert found(S.drain(live(), folder)) == sorted(anew(prints, books, RULE))
