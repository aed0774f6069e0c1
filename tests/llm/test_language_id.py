import math
import random
import zlib

from pyspark.sql import functions as F

from tapeloom.llm import language_id as lid


def phrases(text, sample):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i, n = max(j - 1, i + 1), n + 1
    return n


def brute(text, samples):
    """The prediction by plain search of substrings."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    plain = lid.normal(text)
    cost = {k: phrases(plain, lid.normal(s)) * math.log2(len(lid.normal(s))) / len(plain) for k, s in samples.items()}
    best, *rest = sorted(cost, key=lambda k: (cost[k], k))
    return best, (cost[rest[0]] - cost[best]) / cost[rest[0]] if rest else 1.0


def test_phrases_against_brute_force(monkeypatch):
    import numpy as np

    rng = random.Random(5)
    samples = {"a": "".join(rng.choice("abcde ") for _ in range(400)), "b": "".join(rng.choice("aabbx ") for _ in range(300)), "c": "ab" * 150}
    texts = ["".join(rng.choice("abcdexyz 1.") for _ in range(rng.randrange(1, 900))) for _ in range(60)] + ["zzz", "a", " ", "az" * 40, "ab" * 500, "a" * 700]
    # phrases of hundreds of characters, over many windows
    texts += [samples["a"] * 2, "x" + samples["b"][3:] * 3, samples["c"] * 4, "z" + samples["c"]]
    plain = [lid.normal(t) for t in texts]
    want = [[phrases(t, lid.normal(samples[k])) for t in plain] for k in "abc"]
    codes = np.concatenate([np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in plain])
    sizes = np.array([len(t) for t in plain], np.int64)
    starts = np.cumsum(sizes) - sizes
    for k, row in zip("abc", want):
        made = lid.Automaton(samples[k])
        for window in (1, 3, 7, 64, 512, 5000):
            assert lid.parallel_phrases(made.column[codes].astype("int32"), starts, sizes, made.table, window) == row, (k, window)
    monkeypatch.setattr(lid, "CELLS", 0)
    assert [lid.Automaton(samples[k]).count(codes, starts, sizes) for k in "abc"] == want


def test_predictions_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") < 700)
    samples = lid.learn(docs.where(~lid.held_out(F.col("doc_id"))), rows=6)
    got = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in lid.predict(docs, samples).collect()}
    want = {r.doc_id: brute(r.text, samples) for r in docs.collect()}
    assert len(got) > 30 and got == {d: (k, round(s, 9)) for d, (k, s) in want.items()}


def test_learning_takes_whole_texts(spark, docs):
    rows = [(i, f"text {'abcdefghij'[i % 10]} " + "word " * (i * 10), "en", "a") for i in range(1, 40)] + [(99, "lang " * 9000, "xx", "a")]
    got = lid.learn(docs(rows), rows=4, longest=1000)
    assert set(got["en"].split("\n")) <= {r[1] for r in rows if len(r[1]) <= 1000} and 1 <= len(got["en"].split("\n")) <= 4
    assert got["xx"] == rows[-1][1]


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    got = lid.query(spark, f"{sf}/../sf0.01").join(docs, "doc_id").where("held_out and lang is not null")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert r[1] > 100 and r[0] >= 0.95


def test_odd_rows(spark, docs, odd):
    samples = lid.learn(docs([(1, "the cat and the hat", "en", "a"), (2, "der hund und die katze", "de", "a"), (3, "ignored", None, "a")]))
    assert set(samples) == {"de", "en"}
    got = {str(r.doc_id): (r.lang_pred, r.score) for r in lid.predict(docs(odd), samples).collect()}
    assert got["1"] == got["2"] == got["3"] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r.lang_pred for r in lid.predict(docs(odd), {}).collect()} == {"und"}
    assert lid.predict(docs([]), samples).count() == 0
    again = lid.predict(lid.predict(docs(odd), samples).withColumn("text", F.lit("der hund")), samples)
    assert again.columns.count("lang_pred") == 1 and {r.lang_pred for r in again.collect()} == {"de"}
    keys = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "doc_id long").select("doc_id", lid.held_out(F.col("doc_id")).alias("h"))
    assert all(r.h == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2) for r in keys.collect())
