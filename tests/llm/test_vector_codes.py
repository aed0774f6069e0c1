import math
import random
from hashlib import sha256

import duckdb
import pytest

from tapeloom.llm import vector_codes as vc


def brute(rows, parts, entries, rounds, scale):
    """Lloyd's rounds with all sums taken anew; rows: (vec_id, vector, label) of unique ids and one length."""
    kept = sorted((i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : p * w + w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, v, _ in kept:
                own[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*found)] if found else book for found, book in zip(own, books[p])]
    coded, by = [], {}
    for i, v, label in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        coded.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
        by[label] = by.get(label, 0) + coded[-1][2]
    digest = sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(i, code, error, by[label], digest) for i, code, error, label in coded]


@pytest.mark.parametrize(("size", "rounds", "held"), [(300, 3, 1 << 22), (300, 0, 64), (5, 2, 64)])
def test_against_brute_force(spark, size, rounds, held, monkeypatch):
    monkeypatch.setattr(vc, "HELD", held)
    rng = random.Random(3)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.5, -0.5]) for _ in range(8)], rng.choice([None, "a", "b"])) for i in range(size)]
    rows += [(i, list(rows[1][1]), None) for i in range(size, size + 20)]  # equal vectors: ties and unused entries
    rows += [(901, None, "a"), (902, [1.0, None] * 4, "a"), (903, [float("nan")] * 8, "a"), (904, [float("inf")] * 8, "b")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, label string, code int, error int, v int")
    got = vc.compressed(df, parts=4, entries=12, rounds=rounds, scale=64)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 12, rounds, 64)


def test_running_sums_equal_sums_taken_anew(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)], 0) for i in range(200)], "vec_id long, embedding array<double>, label int")
    coded, books = vc.lloyd(rows, parts=2, entries=8, rounds=4, scale=100)
    full = vc.deltas(coded.selectExpr("v", "was as code", "cast(null as binary) as was"), books).groupBy("part", "entry", "i").sum("total").collect()
    sums = {(r.part, r.entry, r.i): r[3] for r in full}
    assert all(books.entries[p][e][i] == sums[p, e, i] // sums[p, e, -1] for p, e, i in sums if i >= 0)
    assert 0 < coded.where("was <> code").count() < 200  # the last round moves some parts, and only these would be shuffled


def test_odd_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    empty = vc.compressed(make([]), parts=2)
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = {r.vec_id: r for r in vc.compressed(make([(1, [1.0, 2.0], 1), (2, [1.0], 1), (None, [9.0, 9.0], None), (3, [1.0, 2.0], 1), (4, None, 1)]), parts=2, entries=2, rounds=1).collect()}
    assert len(got) == 4 and got[2].code is None and got[2].error is None and got[1].code == got[3].code == "0101" and got[1].label_error == 0
    assert got[None].code == "0000" and got[None].error == got[None].label_error > 0
    with pytest.raises(ValueError, match="divide"):
        vc.compressed(make([(1, [1.0, 2.0, 3.0], 1)]), parts=2)
    big = vc.compressed(make([(1, [2.0**24, 0.0], 1), (2, [0.0, 2.0**23], 1)]), parts=1, entries=1, rounds=0, scale=4)
    assert {r.vec_id: r.error for r in big.collect()} == {1: 0, 2: 2**52 + 2**50}


def test_a_hot_label_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(vc, "if_light", lambda df: df)
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0], None if i % 3 else i) for i in range(900)], "vec_id long, embedding array<double>, label int")
    got = vc.compressed(rows, parts=1, entries=3, rounds=1).collect()
    assert len(got) == 900 and len({r.label_error for r in got if r.vec_id % 3}) == 1 and sum(r.error for r in got if r.vec_id % 3) in {r.label_error for r in got}


def test_the_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    names = "vec_id, code, error, label_error, codebooks_sha256"
    assert sorted(map(tuple, vc.query(spark, sf).select(*names.split(", ")).collect())) == sorted(con.sql(f"SELECT {names} FROM ({vc._sql()})").fetchall())
