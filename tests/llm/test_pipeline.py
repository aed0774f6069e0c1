import hashlib
import math
import random
import re

import tiktoken

import corpus_pipeline as cp
from tapeloom.llm import bpe, mixing, pii, quality_rules

from .test_bpe import ids
from .test_mixing import brute as mix_brute
from .test_ngram_jaccard import brute as near_brute
from .test_quality_rules import brute as quality_brute


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    at = {c: i for i, c in enumerate(docs.columns)}
    pick = lambda r, *cs: tuple(r[at[c]] for c in cs)

    kept = {x[0] for x in quality_brute([pick(r, "doc_id", "text", "source") for r in rows], quality_rules.LIMIT, quality_rules.LEAST_WORDS, quality_rules.LEAST_SHARE) if x[-1]}
    rows = [r for r in rows if str(r[at["doc_id"]]) in kept]
    out = cp.quality(spark, docs, sf)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=str) == sorted(rows, key=str)

    first = {d for d, n, c in near_brute([pick(r, "doc_id", "text") for r in rows]) if d == c}
    rows = [r for r in rows if r[at["doc_id"]] in first]
    docs = cp.near_duplicates(spark, out, sf)
    assert sorted(map(tuple, docs.collect()), key=str) == sorted(rows, key=str)

    spans = {r.doc_id: r.spans for r in pii.find(docs).collect()}

    def redacted(d, t):
        for s in sorted(spans[d], reverse=True):
            t = t[: s.start] + f"[{pii.KINDS[s.kind].upper()}]" + t[s.end :]
        return t

    want = sorted((r[at["doc_id"]], redacted(*pick(r, "doc_id", "text"))) for r in rows)
    out = cp.redaction(spark, docs, sf)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == want and all(r.n_chars == len(r.text) for r in out.collect())

    rows = [(r.doc_id, r.text, r.source) for r in out.collect()]
    times = {d: math.ceil(taken / size) for d, size, _, _, taken in mix_brute(rows, mixing.BLOCK) if taken}
    want = sorted(d for d, _, _ in rows for _ in range(times.get(str(d), 0)))
    out = cp.mix(spark, out, sf)
    assert sorted(r.doc_id for r in out.collect()) == want and out.columns == docs.columns

    codec = bpe.Codec(bpe.read_ranks(bpe.public_vocabulary()[0]), bpe.public_vocabulary()[1])
    got = cp.encoding(spark, out, sf)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert all(r.n_tokens == len(ids(codec.encode(texts[r.doc_id]))) for r in got.collect()) and got.count() == len(want)

    # run() gives what the stages, each held to a plain version above, give one after the other
    sha = lambda b: hashlib.sha256(b).hexdigest()
    plain = tiktoken.Encoding("own", pat_str=bpe.public_vocabulary()[1], mergeable_ranks=bpe.read_ranks(bpe.public_vocabulary()[0]), special_tokens={})
    packed = {d: b"".join(i.to_bytes(4, "little") for i in plain.encode_ordinary(texts[d])) for d in set(want)}
    whole = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in cp.run(spark, sf).collect()]
    assert sorted(whole) == sorted((d, len(packed[d]) // 4, sha(packed[d]), sha(texts[d].encode())) for d in want)


def test_run_and_odd_rows(spark, docs, odd, sf):
    assert len(cp.STAGES) == 5 and cp.run(spark, sf).count() > 0
    df = docs([*odd, (9, "many words " + " ".join(f"w{i}" for i in range(80)) + " mail a@b.cd", "en", "a")])
    for _, stage in cp.STAGES[:-1]:
        df = stage(spark, df, sf)
        assert df.columns == docs([]).columns
        df = spark.createDataFrame(df.collect(), df.schema)
    assert [re.search(r"\[EMAIL\]$", r.text) is not None for r in df.collect()].count(True) >= 1
    for _, stage in cp.STAGES:
        assert stage(spark, docs([]), sf).count() == 0


def test_near_duplicates_take_five_words_and_four_fifths(spark, docs, sf):
    """One edit leaves (n - 5) / (n + 5) of n shingles of five words and (n - 3) / (n + 5) of those of four in common."""
    rng = random.Random(4)
    rows = []
    for i, n in enumerate((43, 44, 45, 46, 47, 48, 49, 50, 51, 52, 53, 54, 60)):
        words = [f"d{i}w{j}" for j in range(n + 4)]
        rows.append((2 * i, " ".join(words), "en", "a"))
        words[rng.randrange(5, n - 5)] = "edited"
        rows.append((2 * i + 1, " ".join(words), "en", "a"))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t, _, _ in rows)]
    gone = {i for i in range(1, len(rows), 2) if 100 * len(sets[i] & sets[i - 1]) >= 80 * len(sets[i] | sets[i - 1])}
    assert 1 not in gone and 5 in gone
    assert {r.doc_id for r in cp.near_duplicates(spark, docs(rows), sf).collect()} == set(range(len(rows))) - gone
    assert gone - {d for d, _, c in near_brute([r[:2] for r in rows]) if d != c}
