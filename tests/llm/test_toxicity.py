from pyspark.sql import functions as F

from tapeloom.llm import toxicity as tox


def test_held_out_accuracy(spark, sf):
    """Labels of two thirds of the documents teach; the others are predicted."""
    folder = f"{sf}/../sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    chain = tox.learn(docs, labels.where(~part), {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    got = tox.predict(docs.select("doc_id", "text"), chain).join(labels.where(part), "doc_id").select("toxic", (F.col("p_toxic") >= 0.5).alias("said")).collect()
    hits, toxic = sum(r.said and r.toxic == 1 for r in got), sum(r.toxic == 1 for r in got)
    false = sum(r.said and r.toxic == 0 for r in got)
    assert toxic > 50 and hits >= 0.85 * toxic and false <= 0.01 * len(got)


def test_the_chain_feeds_earlier_probabilities(spark, docs):
    rows = [(i, f"{'bad worse' if i % 3 == 0 else 'fine'} text number{i}", None, "a") for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 == 0)) for i in range(240)], "doc_id long, first int, second int")
    chain = tox.learn(docs(rows), labels, {"first": F.col("first"), "second": F.col("second")})
    assert chain.models[0].dense.shape == (0,) and chain.models[1].dense.shape == (1,) and chain.models[1].dense[0] > 0
    got = {r.doc_id: (r.p_first, r.p_second) for r in tox.predict(docs(rows), chain).collect()}
    assert all((p > 0.5) == (i % 3 == 0) for i, ps in got.items() for p in ps)


def test_odd_rows(spark, docs, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, None, None), (5, 1, 0), (77, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        chain = tox.learn(docs(odd), labels, {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic")})
        got = tox.predict(docs(odd), chain)
        assert got.count() == len(odd) and all(0 <= r.p_toxic <= 1 for r in got.collect())
    assert tox.predict(docs([]), chain).count() == 0


def test_repeated_labels_and_documents_count_once(spark, docs):
    rows = [(i, f"{'bad' if i % 2 else 'fine'} w{i}", None, "a") for i in range(60)]
    labels = [(i, i % 2) for i in range(60)]
    make = lambda x: spark.createDataFrame(x, "doc_id long, bad int")
    one, two = (tox.learn(docs(r), make(x), {"bad": F.col("bad")}) for r, x in ((rows, labels), (rows * 3, labels * 2)))
    assert one.tables() == two.tables() and one.models[0].intercept == two.models[0].intercept
    again = tox.predict(docs(rows).withColumn("p_bad", F.lit("x")), one)
    assert again.columns.count("p_bad") == 1 and dict(again.dtypes)["p_bad"] == "double"


def test_a_probability_is_what_the_models_say(spark, docs):
    """predict() against the sum over the text's places, written out."""
    import math

    rows = [(i, f"{'awful nasty' if i % 3 == 0 else 'nice'} word{i % 7} x{i}", None, "a") for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 6 == 0)) for i in range(90)], "doc_id long, a int, b int")
    chain = tox.learn(docs(rows), labels, {"a": F.col("a"), "b": F.col("b")})
    for r in tox.predict(docs(rows).withColumn("t", F.col("text")), chain).collect():
        at, before = {p for w in tox.items(r.t) for p in tox.word_places(w)}, []
        for m, table in zip(chain.models, chain.tables()):
            s = m.intercept + sum(sum(table.get(p, 0.0) for p in tox.word_places(w)) for w in tox.items(r.t)) + sum(d * p for d, p in zip(m.dense, before))
            before.append(1 / (1 + math.exp(-s)))
        assert at and abs(r.p_a - before[0]) < 1e-9 and abs(r.p_b - before[1]) < 1e-9
