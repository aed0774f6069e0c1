import math
import random

from pyspark.sql import functions as F

from tapeloom.llm import vector_topk as v


def brute(rows, k):
    ok = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, a in ok:
        if q % 100 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.5, -0.5, 0.0]) for _ in range(8)]) for i in range(700)]
    rows += [(i, list(rows[3][1])) for i in range(700, 760)]  # many equal vectors: ties
    rows += [(801, None), (802, [1.0, None] * 4), (803, [float("nan")] * 8), (804, [float("inf")] * 8), (None, [1.0] * 8), (805, [1e12] * 8), (900, [1.0] * 3), (901, [2.0] * 3)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, shard int, d int")
    for shard_rows, block_rows in ((64, 2), (16_384, 512)):
        got = v.top_k(df, F.col("vec_id") % 100 == 0, shard_rows=shard_rows, block_rows=block_rows)
        assert sorted(map(tuple, got.collect())) == brute(rows, 10)


def test_few_and_none(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert v.top_k(df([]), F.col("vec_id") % 100 == 0).count() == 0
    assert v.top_k(df([(0, [1.0])]), F.col("vec_id") % 100 == 0).count() == 0
    assert [tuple(r) for r in v.top_k(df([(0, [1.0]), (1, [2.0])]), F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 2048 * 1024)]
