import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import importance as im


def grams(text, lo, hi):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(table))
    return len(words), Counter(" ".join(words[i : i + n]) for n in range(lo, hi + 1) for i in range(len(words) - n + 1))


def brute(rows, target, lo, hi, buckets, least, percent, seed):
    """doc_id, n_features, weight, score, rank of (doc_id, text), of unique ids."""
    place = lambda g: zlib.crc32(g.encode()) % buckets
    s, t, docs = Counter(), Counter(), []
    for i, text in rows:
        n, found = grams(text, lo, hi)
        docs.append((i, n, found))
        for g, c in found.items():
            s[place(g)] += c
    for text in target:
        for g, c in grams(text, lo, hi)[1].items():
            t[place(g)] += c
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (total_s + buckets) / ((s[b] + 1.0) * (total_t + buckets))))
    out, some = {}, []
    for i, n, found in docs:
        weight = sum(c * gain(place(g)) for g, c in found.items())
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out[i] = [i, sum(found.values()), weight, score, None]
        if n >= least:
            some.append((-score, i is None, i or 0, i))
    for r, (*_, i) in enumerate(sorted(some)[: percent * len(some) // 100]):
        out[i][4] = r + 1
    return sorted(map(tuple, out.values()), key=str)


TEXTS = [f"{'Alpha beta' if i % 4 == 0 else 'gamma'} the the w{i % 13} É{i % 7}x {i} the-end " * (i % 9) for i in range(120)]


@pytest.mark.parametrize(("lo", "hi", "block_words"), [(1, 1, 1 << 21), (1, 1, 40), (1, 2, 100), (2, 3, 1)])
def test_against_brute_force(spark, lo, hi, block_words):
    rows = [*enumerate(TEXTS), (None, "beta the gamma " * 9), (900, None), (901, ""), (902, " ,;! "), (903, "ß🙂 Ünï x " * 30)]
    target = ["alpha BETA the", None, "", "beta w3 the the", "only here"]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, rid int, block int, weight int, rank int")
    aim = spark.createDataFrame([(i, x, 1) for i, x in enumerate(target)], "item_id long, text string, total int")
    got = im.resampled(docs, aim, lo, hi, 97, 5, 30, 7, block_words=block_words)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, target, lo, hi, 97, 5, 30, 7)


def test_the_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    names = "doc_id, n_features, weight, score, rank"
    assert sorted(map(tuple, im.query(spark, sf).select(*names.split(", ")).collect())) == sorted(con.sql(f"SELECT {names} FROM ({im.SQL})").fetchall())


def test_odd_rows(spark, docs, odd):
    none = spark.createDataFrame([], "text string")
    got = im.resampled(docs(odd), none).collect()
    assert len(got) == len(odd) and {r.doc_id: r.n_features for r in got}[4] == 40_000
    assert im.resampled(docs([]), none).count() == 0
    assert im.resampled(docs([]), none).columns == ["doc_id", "n_features", "weight", "score", "rank"]
    twice = im.drawn(im.weights(docs([(5, "a b " * 30, None, None)] * 4), none), percent=50).orderBy("rid").collect()
    assert sorted(r["rank"] or 0 for r in twice) == [0, 0, 1, 2] and len({r.score for r in twice}) == 1  # repeated rows are rows of their own


def test_each_distinct_tuple_is_hashed_once(spark):
    docs = spark.createDataFrame([(i, "a b a b c") for i in range(50)], "doc_id long, text string")
    blocks = im.stored(im.encoded(docs, 1, 2, "text", "doc_id", 20), "t").where("rid is null").select(F.lit(False).alias("target"), "block", "words", "grams", "totals")
    numbers = im.stored(im.numbered_words(blocks), "t")
    names = numbers.where("word is not null").select("id", "word")
    assert sorted(bytes(r.word) for r in names.collect()) == [b"a", b"b", b"c"] and numbers.count() > 3
    rows = im.hashed(im.tuples(blocks, numbers), names, 2, 1 << 30).collect()
    assert sorted(r.s for r in rows) == [50, 50, 50, 100, 100, 100] and {r.bucket for r in rows} == {zlib.crc32(g) % (1 << 30) for g in (b"a", b"b", b"c", b"a b", b"b a", b"b c")}
