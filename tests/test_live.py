"""Live footprints against bars built anew for every print, and the stream against the batch over files and a restart."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import live as O
from tapeloom.streaming import bars as S
from tapeloom.streaming import live as L

TAPE = "instrument string, us long, seq long, px_ticks long, sz long, side string, ts timestamp"
SECOND = 1_000_000


def rows(n, seed, spread=3):
    rng, px, us, out = random.Random(seed), 100, 0, []
    for i in range(n):
        px += rng.choice([-spread, -1, -1, 0, 0, 1, 1, spread])
        us += rng.randrange(1, 4 * SECOND)
        out.append((f"M{rng.randrange(2)}", us, i, px, rng.randrange(1, 9), rng.choice("BABAN")))
    return out


def frame(spark, data):
    return spark.createDataFrame([(*r, None) for r in data], TAPE).withColumn("ts", F.timestamp_micros("us"))


def held(levels, low, high, rule):
    """Flags of a bar's volume by price, from nothing."""
    out = {}
    for px, (b, s) in levels.items():
        for side, volume, against, edge in (("buy", b, levels.get(px - 1, (0, 0))[1], px == low), ("sell", s, levels.get(px + 1, (0, 0))[0], px == high)):
            if (rule.edges or not edge) and volume > 0 and volume >= rule.least and (volume >= rule.ratio * against if against else rule.empty):
                out[side, px] = (volume, against)
    return out


def replay(data, seconds, rule):
    """For each print (instrument, bar_us, seq): the flags of its bar, the deltas, and the bar's first time."""
    bars, out = {}, []
    for m, us, seq, px, sz, side in data:
        if side == "N":
            continue
        bar = bars.setdefault((m, us // (seconds * SECOND) * seconds * SECOND), {"levels": {}, "raw": 0, "diagonal": 0, "start": us})
        b, s = bar["levels"].get(px, (0, 0))
        bar["levels"][px] = (b + sz, s) if side == "B" else (b, s + sz)
        flags = held(bar["levels"], min(bar["levels"]), max(bar["levels"]), rule)
        signed = sz if side == "B" else -sz
        bar["raw"] += signed
        bar["diagonal"] += signed if any(p == px for _, p in flags) else 0
        out.append((m, us // (seconds * SECOND) * seconds * SECOND, seq, us, px, flags, bar["raw"], bar["diagonal"], bar["start"]))
    return out


@pytest.mark.parametrize("rule", [O.Rule(2.0, 1), O.Rule(3.0, 4, empty=False), O.Rule(1.5, 2, edges=True)])
def test_flags_after_each_print_are_those_of_a_bar_built_anew(spark, rule):
    data = rows(700, 1)
    prints, want = frame(spark, data), replay(data, 120, rule)
    tests = O.compared(prints, 120, rule)
    got = {r.seq: (r.buy_flags, r.sell_flags, r.delta, r.diagonal) for r in O.pulse(prints, tests, 120).collect()}
    assert got == {seq: (sum(s == "buy" for s, _ in f), sum(s == "sell" for s, _ in f), raw, dd) for _, _, seq, _, _, f, raw, dd, _ in want}
    lives, on, last = [], {}, {}
    for m, bar, _, us, _, flags, *_ in want:
        known = on.setdefault((m, bar), {})
        last[m] = bar
        for key in list(known):
            if key not in flags:
                lives.append((m, bar, *key, known.pop(key)[0], us, "faded"))
        for key, v in flags.items():
            known[key] = (known.get(key, (us,))[0], *v)
    for (m, bar), known in on.items():
        lives += [(m, bar, *key, v[0], bar + 120 * SECOND if bar < last[m] else None, "confirmed" if bar < last[m] else "unconfirmed") for key, v in known.items()]
    found = O.flags(tests, 120).collect()
    assert sorted(map(str, ((r.instrument, r.bar_us, r.side, r.px, r.first_us, r.ended_us, r.state) for r in found))) == sorted(map(str, lives)) and len({x[-1] for x in lives}) == 3
    standing = {(m, bar, *key): v[1:] for (m, bar), known in on.items() for key, v in known.items()}
    assert {(r.instrument, r.bar_us, r.side, r.px): (r.volume, r.against) for r in found if r.state != "faded"} == standing


def test_bar_and_comparisons_count_alike(spark):
    """Bar, which signals and the stream use, against the table: lives, updates, peaks."""
    data, rule = rows(500, 4, spread=5), O.Rule(2.0, 2)
    found = O.flags(O.compared(frame(spark, data), 10**6, rule), 10**6).collect()
    bars, ended = {}, []
    for m, us, seq, px, sz, side in data:
        if side != "N":
            ended += [(m, *x[:2], x[2][0], "faded", x[2][2], x[2][5]) for x in bars.setdefault(m, O.Bar(rule)).add(us, seq, px, sz, side == "B")]
    ended += [(m, *k, f[0], "unconfirmed", f[2], f[5]) for m, bar in bars.items() for k, f in bar.flags.items()]
    assert sorted(map(str, ended)) == sorted(str((r.instrument, r.side, r.px, r.first_us, r.state, r.updates, r.peak)) for r in found)


def test_runs_merge_and_split():
    rng, runs, held_ = random.Random(3), O.Runs(), set()
    for _ in range(3000):
        px = rng.randrange(30)
        (runs.remove if px in held_ else runs.add)(px)
        held_ ^= {px}
        want = {a: next(b for b in range(a, 40) if b + 1 not in held_) for a in held_ if a - 1 not in held_}
        assert runs.to == want and runs.back == {b: a for a, b in want.items()}


@pytest.mark.parametrize("gates", [O.Gates(2, 1, 0), O.Gates(3, 3, 60 * SECOND)])
def test_signals_against_a_rebuild_for_each_print(spark, gates):
    data, rule = rows(900, 7), O.Rule(2.0, 1)
    got = [(r.instrument, r.seq, r.side, r.from_px, r.to_px, r.raw, r.diagonal, r.buy_flags, r.sell_flags, r.age_us) for r in O.signals(frame(spark, data), 300, rule, gates).collect()]
    updates = {}
    for r in O.compared(frame(spark, data), 300, rule).orderBy("seq", "n").collect():
        key = (r.instrument, r.bar_us, r.side, r.px)
        n, first = updates.get((key, "now"), (0, None))
        updates[key, "now"] = (n + 1, first or (r.seq, r.n)) if r.holds else (0, None)
        updates[key, r.seq] = updates[key, "now"]
    want, last = [], {}
    state = {}
    for m, bar, seq, us, _, flags, raw, dd, start in replay(data, 300, rule):
        for side in ("buy", "sell"):
            for px in range(0, 400):
                if (((m, bar, side, px)), seq) in updates:
                    state[m, bar, side, px] = updates[(m, bar, side, px), seq]
        runs = [(side, a, next(b for b in range(a, 999) if (side, b + 1) not in flags)) for side, a in flags if (side, a - 1) not in flags]
        runs = [r for r in runs if r[2] - r[1] + 1 >= gates.run]
        if not runs:
            continue
        oldest = {s: min(state[m, bar, s, p][1] for t, p in flags if t == s) for s in ("buy", "sell") if any(t == s for t, _ in flags)}
        side, a, b = min(runs, key=lambda r: (-(r[2] - r[1]), oldest[r[0]], r[1]))
        mature = any(state[m, bar, side, p][0] >= gates.updates for s, x, y in runs if s == side for p in range(x, y + 1))
        if dd * (1 if side == "buy" else -1) > 0 and mature and us - last.get((m, side), -(10**18)) >= gates.cooldown_us:
            last[m, side] = us
            n = sum(s == "buy" for s, _ in flags)
            want.append((m, seq, side, a, b, raw, dd, n, len(flags) - n, us - start))
    assert sorted(got) == sorted(want) and len(want) > 5


def test_no_prints(spark):
    none = frame(spark, [])
    assert O.flags(O.compared(none, 60), 60).count() == O.signals(none, 60).count() == O.pulse(none, O.compared(none, 60), 60).count() == 0


def test_the_stream_is_the_batch_over_files_and_a_restart_within_a_bar(spark):
    folder, data, rule, gates = tempfile.mkdtemp(prefix="spark-"), rows(600, 5), O.Rule(2.0, 1), O.Gates(2, 2, 5 * SECOND)
    put = lambda part: frame(spark, part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    live = lambda: L.footprints(spark.readStream.schema(frame(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), 120, "10 seconds", rule, gates)
    put(data[:200])
    put(data[200:333])
    S.drain(live(), folder)
    put(data[333:])  # the bar of the 333rd print goes on from the checkpoint
    log = S.drain(live(), folder)
    end = max(r[1] for r in data if r[5] != "N") // 1000 * 1000 - 10 * SECOND
    want = {}
    for r in O.flags(O.compared(frame(spark, data), 120, rule), 120).collect():
        over = r.bar_us + 120 * SECOND
        state, at = (r.state, r.ended_us) if r.state != "unconfirmed" else ("confirmed", over) if over <= end else ("unconfirmed", None)
        want[r.instrument, r.bar_us, r.side, r.px, r.first_us] = (state, at, *((r.updates, r.volume, r.against, r.peak) if at else ()))
    got = {(r.instrument, r.bar_us, r.side, r.px, r.first_us): (r.state, r.at_us, r.updates, r.volume, r.against, r.peak) if r.state != "unconfirmed" else ("unconfirmed", None) for r in L.settled(log).collect()}
    assert got == want and {v[0] for v in want.values()} >= {"faded", "confirmed"}
    signals = [(r.instrument, r.seq, r.side, r.from_px, r.to_px, r.raw, r.diagonal) for r in O.signals(frame(spark, data), 120, rule, gates).collect()]
    assert sorted(signals) == sorted((r.instrument, r.seq, r.side, r.from_px, r.to_px, r.raw, r.diagonal) for r in log.where("kind = 'signal'").collect()) and len(signals) > 5
