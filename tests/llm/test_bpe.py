import random
import sys

import pytest

from tapeloom.llm import bpe

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def codec():
    path, pattern = bpe.public_vocabulary()
    ranks = bpe.read_ranks(path)
    return bpe.Codec(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return list(memoryview(packed).cast("I"))


def test_same_ids_as_tiktoken(codec):
    own, known = codec
    rng = random.Random(3)
    texts = ["", " ", "a", "<|endoftext|>", "it's  \n\n x", "a" * 20_000, "ab" * 5_000 + "é" * 999, "日本語テキスト🙂" * 300, "\x00\x01", "=" * 3001]
    texts += ["".join(rng.choice("etaoin shrdlu\n'€é1,") for _ in range(rng.randrange(400))) for _ in range(300)]
    for t in texts:
        assert ids(own.encode(t)) == known.encode_ordinary(t)
        assert own.decode(own.encode(t)) == t.encode()


def test_ranks_that_fall_again():
    """A merge can give a pair of a lower rank than those already done."""
    ranks = {bytes([c]): 100 + i for i, c in enumerate(b"abc")} | {b"ab": 5, b"abc": 2, b"ca": 9, b"cab": 1}
    assert bpe.encode_piece(b"abcab", ranks) == [2, 5]


def test_one_queue_for_many_pieces():
    """Pairs don't cross pre-tokens, and a rank that falls in one of them holds for the others."""
    ranks = {bytes([c]): 100 + i for i, c in enumerate(b"abc")} | {b"ab": 5, b"abc": 2, b"ca": 9, b"cab": 1, b"aa": 7, b"abab": 3}
    pieces = [b"abcab", b"", b"ab", b"aaaaa", b"cabab", b"abababab", b"ccab", b"c", b"abcab"]
    packed = bpe.encode_pieces(pieces, ranks)
    assert [ids(p) for p in packed] == [bpe.encode_piece(p, ranks) for p in pieces] == [[2, 5], [], [5], [7, 7, 100], [1, 5], [3, 3], [102, 1], [102], [2, 5]]
    assert bpe.encode_pieces([], ranks) == []


def test_the_bitmap_is_looked_at_by_bucket(codec):
    """Once for what many pre-tokens merge at a rank, not once a merge: the count of looks doesn't depend on the machine."""
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(8, 14))) for _ in range(2000))
    own, looks = bpe.Codec(codec[0].ranks, bpe.public_vocabulary()[1]), []

    def seen(frame, event, arg):
        if event == "c_call" and arg.__name__ == "bit_length":
            looks.append(1)

    sys.setprofile(seen)
    try:
        packed = own.encode(text)
    finally:
        sys.setprofile(None)
    assert ids(packed) == codec[1].encode_ordinary(text)
    assert len(looks) < (len(text) - len(packed) // 4) / 2


def test_texts_together(codec, monkeypatch):
    """Whatever is remembered or forgotten on the way, and however texts are put together."""
    monkeypatch.setattr(bpe, "CACHE", 50)
    monkeypatch.setattr(bpe, "PIECES", 200)
    monkeypatch.setattr(bpe, "JOINT", 60)
    own, rng = bpe.Codec(codec[0].ranks, bpe.public_vocabulary()[1]), random.Random(6)
    texts = ["", "a" * 500, *("".join(rng.choice("etaoin  shrdlu\n'€é1,") for _ in range(rng.randrange(900))) for _ in range(60)), "a" * 500, ""]
    assert [ids(p) for p in own.encode_all(texts)] == [codec[1].encode_ordinary(t) for t in texts]
    assert [ids(p) for p in own.encode_all(texts[::-1])] == [codec[1].encode_ordinary(t) for t in texts[::-1]]
    assert all(len(piece) <= 64 for piece in [*own.known, *own.old]) and list(own.encode_all([])) == []
    assert ids(own.encode("é" * 99)) == codec[1].encode_ordinary("é" * 99) and "é" * 99 not in own.known


def test_operators_round_trip(spark, docs, odd):
    path, pattern = bpe.public_vocabulary()
    encoded = bpe.encode(docs(odd), path, pattern)
    back = bpe.decode(encoded, path)
    for r in back.collect():
        assert bytes(r.decoded).decode() == (r.text or "")
    got = bpe.round_trip(docs(odd), path, pattern).collect()
    assert len(got) == len(odd) and all(r.n_tokens == 0 for r in got if r.doc_id in (1, 2))
    assert bpe.round_trip(docs([]), path, pattern).count() == 0


def test_the_query_against_tiktoken(spark, codec, sf):
    import hashlib

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = bpe.query(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        packed = b"".join(i.to_bytes(4, "little") for i in codec[1].encode_ordinary(texts[r.doc_id]))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_columns_of_the_outputs_names(spark):
    path, pattern = bpe.public_vocabulary()
    df = spark.createDataFrame([("hello", 1, "x")], "text string, ids int, decoded string")
    got = bpe.decode(bpe.encode(df, path, pattern), path).first()
    assert bytes(got.decoded) == b"hello" and len(got) == 3
