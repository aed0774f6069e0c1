import random

import pytest

from tapeloom.llm import ngram_jaccard as nj


def words(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ")


def shingles(text):
    w = [x for x in words(text) if x]
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        first[r] = min((x for x in (first.get(r), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), first[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def edited(rng, base, n):
    w = list(base)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return w


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_near_copies_against_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(nj, "RARE", 3)
    passage = [f"p{i}" for i in range(60)]
    rows, vocab = [], [f"w{i}" for i in range(300)]
    for size, copies in ((40, 60), (120, 60), (420, 40), (7, 10), (30, 5)):
        base = [rng.choice(vocab) for _ in range(size)]
        rows += [edited(rng, base, rng.randrange(0, max(2, size // 20))) for _ in range(copies)]
    rows += [[rng.choice(vocab) for _ in range(rng.randrange(1, 90))] + passage for _ in range(60)]
    rows += [[rng.choice("ab") for _ in range(rng.randrange(0, 9))] for _ in range(40)]
    rng.shuffle(rows)
    docs = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = nj.join(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(docs)


def test_nulls_ties_and_repeated_rows(spark):
    docs = [(5, None), (4, ""), (3, "A b C d e"), (3, "a B c d e"), (None, "a b c d e"), (2, "x y"), (1, "x  y\n"), (7, "other words that are alone here"), (8, "z " * 30_000)]
    docs = [(d, t, d) for d, t in docs]
    got = nj.join(spark.createDataFrame(docs, "doc_id long, text string, sig long"))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute([r[:2] for r in docs])
    assert nj.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
