import hashlib
import random
import re

from tapeloom.llm import mixing


def brute(rows, block, most=3):
    """Targets by repeated resharing; takes by laying each source's stream out word by word."""
    size = lambda t: len(re.findall(r"[^ \t-\r]+", t or ""))
    by = {}
    for d, t, s in rows:
        by.setdefault(s, []).append((hashlib.md5(f"mix:{'' if d is None else d}".encode()).hexdigest(), size(t), d))
    names = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    cap = {s: most * sum(x[1] for x in by[s]) for s in names}
    left, free, target = sum(cap.values()) / most, set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if cap[s] <= left * weight[s] / total]
        if not full:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in full:
            target[s] = cap[s]
        left -= sum(cap[s] for s in full)
        free -= set(full)
    out = []
    for s in names:
        words = min(int(target[s] + 0.5), cap[s])
        docs = sorted(by[s])
        whole = cap[s] // most
        at = 0
        for _, n, d in docs:
            taken = (words // whole * n + max(0, min(at + n, words % whole) - at)) if whole else 0
            out.append((str(d), n, whole, round(target[s], 6), taken))
            at += n
    return sorted(out)


def rows_of(df):
    return sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect())


def test_against_brute_force(spark, docs):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(0, 60), None, rng.choice(["a", "a", "a", "b", "c", "dé", None])) for i in range(400)]
    rows += [(1000, "tiny", None, "z")]
    for block in (7, 64, 4096):
        got = mixing.mix(docs(rows), block=block)
        assert rows_of(got) == brute([(d, t, s) for d, t, _, s in rows], block)


def test_schedule_holds_the_weights_at_any_time(spark, docs):
    rows = [(i, "w " * 50, None, "abc"[i % 3]) for i in range(600)]
    by = mixing.targets(mixing.sizes(docs(rows)), block=10)
    slots = sorted(((r["at"], r.source) for r in mixing.schedule(by, block=10).collect()))
    share = {r.source: r.target for r in by.collect()}
    total = sum(share.values())
    first = slots[: len(slots) // 2]
    for s, t in share.items():
        assert abs(sum(x == s for _, x in first) / len(first) - t / total) < 0.02


def test_odd_rows_and_reruns(spark, docs, odd):
    got = mixing.mix(docs(odd))
    assert rows_of(got) == brute([(d, t, s) for d, t, _, s in odd], 4096)
    assert rows_of(mixing.mix(docs(odd).repartition(3))) == rows_of(got)
    assert mixing.mix(docs([])).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(docs([(1, None, None, "a"), (2, "", None, "b")])).collect())


def test_slots_and_times(spark, docs):
    """What mix() says of each document is what a plain walk through the schedule finds."""
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(0, 90), None, rng.choice("aaab")) for i in range(120)]
    given, block = docs(rows), 32
    slots = mixing.schedule(mixing.targets(mixing.sizes(given), block), block).collect()
    want = {}
    for s in "ab":
        at = 0
        for _, n, d in sorted((hashlib.md5(f"mix:{d}".encode()).hexdigest(), len(t.split()), d) for d, t, _, x in rows if x == s):
            hits = [x["at"] for x in slots if x.source == s and min(at + n, x.block * block + x.words) > max(at, x.block * block)]
            want[d] = (len(hits), min(hits, default=None))
            at += n
    assert {r.doc_id: (r["slots"], r.first_at) for r in mixing.mix(given, block).collect()} == want


def test_in_order_any_beginning_is_near_the_weights(spark, docs):
    rows = [(i, "w " * (20 + i % 7), None, "abcd"[min(3, i % 6)]) for i in range(900)]
    given = docs(rows)
    got = [(r.source, r.size) for r in mixing.in_order(given.withColumn("size", mixing.F.size(mixing.F.split("text", " ")) - 1), block=50).collect()]
    share = {r.source: r.target for r in mixing.targets(mixing.sizes(given), 50).collect()}
    total = sum(share.values())
    for part in (0.25, 0.5, 0.75, 1.0):
        some = got[: int(len(got) * part)]
        words = sum(n for _, n in some)
        for s, t in share.items():
            assert abs(sum(n for x, n in some if x == s) / words - t / total) < 0.03, (part, s)
    assert given.columns == mixing.in_order(given).columns
