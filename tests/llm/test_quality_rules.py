import random

from pyspark.sql import functions as F

from tapeloom.llm import quality_rules as q


def test_base_counts():
    assert q.measure(None) == (0, 0, 0, 0, 0)
    assert q.measure("a b c a b c") == (6, 6, 0, 0, 6)
    assert q.measure("a b c x a b c y") == (8, 8, 0, 0, 6)
    assert q.measure("l #1\n\nl #1\n \nl #1") == (6, 9, 3, 2, 6)


def brute(rows, limit, least_words, least_share):
    held, first = {}, {}
    for d, t, s in rows:
        for line in q.lines_of(t):
            k = (s, line)
            held[k] = held.get(k, 0) + 1
            first[k] = None if d is None else (d if k not in first else first[k] if first[k] is None else min(first[k], d))
    out = []
    for d, t, s in rows:
        n, chars, symbols, dup, rep = q.measure(t)
        gone = sum(w for line, w in q.lines_of(t).items() if held[s, line] > limit and d != first[s, line])
        failed = n < 50 or 100 * rep > 50 * n
        depleted = gone > 0 and (n - gone < least_words or n - gone < n * least_share)
        out.append((str(d), n, chars, symbols, dup, rep, failed, not failed and not depleted))
    return sorted(out)


def test_against_brute_force(spark, docs):
    rng = random.Random(2)
    common = [" ".join(f"c{i}w{j}" for j in range(20)) for i in range(6)]
    rows = []
    for i in range(150):
        lines = rng.sample(common, rng.randrange(0, 5)) + [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(0, 4))]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), None, rng.choice(["a", "a", "b", None])))
    rows += [(200 + i, rows[0][1], None, rows[0][3]) for i in range(30)]
    got = q.judge(docs(rows), limit=10)
    assert sorted((str(r.doc_id), *(r[c] for c in q.BASE.names), r.base_failed, r.kept) for r in got.collect()) == brute([(d, t, s) for d, t, _, s in rows], 10, 50, 0.5)


def test_odd_rows(spark, docs, odd):
    got = q.judge(docs(odd))
    assert sorted((str(r.doc_id), *(r[c] for c in q.BASE.names), r.base_failed, r.kept) for r in got.collect()) == brute([(d, t, s) for d, t, _, s in odd], 20, 50, 0.5)
    assert q.judge(docs([])).count() == 0


def test_a_passage_of_all_documents_stays_once(spark, docs):
    line = " ".join(f"common{i}" for i in range(60))
    rows = [(i, f"{line}\nown{i}", None, "a") for i in range(100)]
    kept = [r.doc_id for r in q.judge(docs(rows)).where("kept").collect()]
    assert kept == [0]


def brute_cleaned(rows, limit, least_words, least_share):
    """(key, text) of the kept documents; keys are distinct."""
    norm = lambda x: " ".join(q._word(x)).translate(q._plain)
    held, first = {}, {}
    for d, t, s in rows:
        for line in {norm(x) for x in t.split("\n")} - {""}:
            held[s, line] = held.get((s, line), 0) + 1
            first[s, line] = min(d, first.get((s, line), d))
    kept = {r[0] for r in brute(rows, limit, least_words, least_share) if r[-1]}
    goes = lambda d, s, x: x and held[s, x] > limit and d != first[s, x]
    return sorted((d, "\n".join(x for x in t.split("\n") if not goes(d, s, norm(x)))) for d, t, s in rows if str(d) in kept)


def test_lines_above_the_limit_are_taken_out(spark, docs):
    rng = random.Random(5)
    common = [" ".join(f"C{i}w{j}" for j in range(6)) for i in range(5)]
    rows = []
    for i in range(120):
        lines = [*rng.sample(common, rng.randrange(0, 4)), "", *(" ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) for _ in range(rng.randrange(1, 5)))]
        lines += [f" {x.lower()}\t" for x in lines[:1]]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), None, rng.choice(["a", "a", "b", None])))
    rows += [(200 + i, rows[0][1], None, rows[0][3]) for i in range(5)]
    given = docs(rows)
    got = q.cleaned(given, limit=10)
    want = brute_cleaned([(d, t, s) for d, t, _, s in rows], 10, 50, 0.5)
    assert got.columns == given.columns and sorted((r.doc_id, r.text) for r in got.collect()) == want
    assert dict(want) != {d: t for d, t, _, _ in rows if d in dict(want)}


def test_the_pipeline_takes_lines_out(spark, docs, sf):
    import corpus_pipeline as cp

    line = " ".join(f"common{i}" for i in range(5))
    rows = [(i, f"{line}\n" + " ".join(f"d{i}w{j}" for j in range(60)), None, "a") for i in range(30)]
    got = {r.doc_id: r for r in cp.quality(spark, docs(rows), sf).collect()}
    assert len(got) == 30 and [d for d, r in got.items() if line in r.text] == [0]
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_cleaned_with_repeated_and_null_keys(spark, docs, odd):
    assert q.cleaned(docs(odd)).count() == 0 and q.cleaned(docs([])).count() == 0
    text = " ".join(f"own{i}" for i in range(60))
    assert sorted((str(r.doc_id), r.text) for r in q.cleaned(docs([(None, text, None, "a"), (1, text, None, "a"), (1, text, None, None)])).collect()) == [("1", text), ("1", text), ("None", text)]


def test_the_limit_is_the_same_in_a_host_of_many_documents(spark, sf):
    """A line of 21 among 60,000 documents is above the limit, one of 20 isn't, and the first document keeps it."""
    import corpus_pipeline as cp

    n = F.col("id")
    own = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("d"), n.cast("string"), F.lit("w"), F.char(F.lit(97) + i / 10), F.char(F.lit(97) + i % 10))))
    # digits are masked, so the number is spelt in letters
    own = F.translate(own, "0123456789", "klmnopqrst")
    text = F.concat(own, F.when(n < 21, "\nhot line of the host").when(n < 41, "\nline of fewer documents").otherwise(""))
    df = spark.range(60_000).select(n.alias("doc_id"), text.alias("text"), F.lit("a").alias("source"), F.length(text).cast("long").alias("n_chars"))
    got = {r.t: r.n for r in cp.quality(spark, df, sf).groupBy(F.substring_index("text", "\n", -1).alias("t")).agg(F.count("*").alias("n")).where("t like '%line of%'").collect()}
    assert got == {"hot line of the host": 1, "line of fewer documents": 20}
    assert q.judge(df).where("removed_words > 0").count() == 20


def test_copies_deplete_each_other_and_the_method_decides(spark, docs, sf):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(i, text, None, "a") for i in range(25)] + [(100 + i, f"{text} " + "abcdefghijklmnopqrstuvwxyz"[i], None, "a") for i in range(25)]
    got = q.judge(docs(rows)).collect()
    assert not any(r.base_failed for r in got) and {r.doc_id for r in got if r.kept} == {0, *range(100, 125)}
    query = q.query(spark, sf.replace("sf0.001", "sf0.1"))
    assert query.where("kept = base_failed").count() > 0
