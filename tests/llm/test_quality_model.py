import math

import numpy as np
from pyspark.sql import functions as F

from tapeloom.llm import quality_model as q


def test_held_out_accuracy(spark, sf):
    """The query learns from four fifths of the labels; on the others it is right, of either kind."""
    folder = f"{sf}/../sf0.1"
    got = q.query(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("quality", "predicted", "score").collect()
    for kind in (0, 1):
        own = [r for r in got if r.quality == kind]
        assert len(own) > 80 and sum(r.predicted == kind for r in own) >= 0.97 * len(own)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_weights_minimise_the_loss_of_the_pairs():
    rng = np.random.default_rng(1)
    good, bad = rng.random((40, 5)) + [0.3, 0, 0, -0.2, 0], rng.random((25, 5))
    w = q.fit(good, bad, pairs=4)
    n = 40
    x = np.array([good[i % 40] - bad[(i + k * 6) % 25] for k in range(4) for i in range(n)])
    loss = lambda v: np.log1p(np.exp(-x @ v)).sum() + 0.5 * (v @ v)
    assert w[0] > 0 > w[3] and all(loss(w) <= loss(w + d) for d in np.vstack([np.eye(5), -np.eye(5)]) * 1e-3)


def test_the_threshold_is_the_best_quantile(spark):
    rng = np.random.default_rng(2)
    y = rng.random(400) < 0.7
    s = np.where(y, 1.0, -1.0) + rng.normal(0, 0.8, 400)
    rows = spark.createDataFrame([(int(a), float(b).hex().encode()) for a, b in zip(y, s)], "y int, f binary")
    at = q.parted(rows, lambda found: np.array([float.fromhex(x.decode()) for x in found]))
    right = lambda t: int(((s >= t) == y).sum())
    best = max(right(t) for t in [*s, s.max() + 1])
    assert right(at) >= best - 1


def test_only_labels_that_may_teach_do(spark, docs):
    """Labels of held-out rows change nothing, and neither do lang, source and ids."""
    text = lambda i: "LOUD!! NOISE### " * (1 + i % 5) if i % 3 == 0 else f"quiet prose of the kind number {i} that people write "
    rows = [(i, text(i), None, "a") for i in range(200)]
    found = q.described(docs(rows))
    make = lambda x: spark.createDataFrame(x, "doc_id long, quality int")
    labels = make([(i, int(i % 3 != 0)) for i in range(200)] + [(None, 0), (7, None), (999, 0)])
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    one = q.learn(found, labels.where(~part))
    got = {r.doc_id: (r.score, r.predicted) for r in q.predict(found, one).collect()}
    assert all(p == int(i % 3 != 0) for i, (_, p) in got.items())
    moved = q.described(docs([(i + 1000, t, "xx", "other") for i, t, *_ in rows]))
    assert {r.doc_id - 1000: (r.score, r.predicted) for r in q.predict(moved, one).collect()} == got
    again = q.learn(q.described(docs(rows * 2)), labels.union(labels).where(~part))
    assert again.weights == one.weights and again.threshold == one.threshold


def test_one_kind_or_no_labels(spark, docs, odd):
    found = q.described(docs(odd))
    make = lambda x: spark.createDataFrame(x, "doc_id long, quality int")
    for labels, score in ((make([]), 0.5), (make([(1, 1), (5, 1)]), 1.0), (make([(1, 0), (77, 1)]), 0.0)):
        got = q.predict(found, q.learn(found, labels)).collect()
        assert len(got) == len(odd) and {r.score for r in got} == {score}
    both = q.predict(found, q.learn(found, make([(1, 0), (5, 1), (None, 1)]))).collect()
    assert len(both) == len(odd) and all(0 <= r.score <= 1 for r in both)
    assert q.predict(q.described(docs([])), q.learn(found, make([]))).count() == 0


def test_features_of_a_text():
    assert q.features("") == q.features(" \n\t") == bytes(q.WIDTH)
    loud, calm = q.features("BUY!! NOW!! " * 40), q.features("we walked to the old mill and sat by the water until noon " * 2)
    assert loud[1] > calm[1] and loud[4] == q.BINS - 1 > calm[4] == 0
    part = q.features("we walked to the old mill and sat by the water until noon then home again\n" * 20 + "BUY!! NOW!! CHEAP!! " * 60)
    assert part[4] < part[12] == q.BINS - 1  # the worst stretch tells what the whole text hides
    assert len(q.features("x" * 3_000_000)) == q.WIDTH and all(b < q.BINS for b in loud + calm) and math.isfinite(q.steps([loud]).sum())
