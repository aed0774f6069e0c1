"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The queue has one bucket per merge rank; a bucket holds the positions (linked-list nodes) whose pair with their right
neighbour merges at that rank, leftmost first. A two-level bitmap marks the buckets in use, so that find-first-set gives
the next rank in two steps whatever the length of the text. A position whose pair has changed since it was
queued is stale and skipped. Each merge queues at most two pairs: a pre-token of n bytes costs O(n log n) at worst,
where scanning for the lowest rank costs O(n^2).

One queue serves many pre-tokens, laid end to end, whose pairs never cross: what is first in the queue is also first in its own
pre-token. So the bitmap is looked at once for a bucket of all of them, not once for a merge.

Cases: null texts count as empty; empty texts have no tokens; null ids decode to nothing. Repeated rows give repeated results and null keys pass.
A very long text is encoded in one piece, in memory of some hundred times its longest pre-token and of all its pre-tokens. encode() replaces a column named ids, decode()
one named decoded; other columns pass through, an empty table gives an empty result. Of pairs of the same rank the leftmost merges first.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load, others, parts

#: Encoded pre-tokens that a Python worker remembers in each of two generations: when the young one is full it becomes the old one,
#: and what is found in the old one is young again.
CACHE = 250_000

#: Pre-tokens of texts that are looked up together, and characters of those that go through one queue, but for longer single ones.
PIECES, JOINT = 100_000, 50_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line. The size of a vocabulary doesn't follow the data."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token."""
    return list(memoryview(encode_pieces([piece], ranks)[0]).cast("I"))


def encode_pieces(pieces: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    """The packed ids of each pre-token, from one queue for all of them.

    `top` marks the groups of 256 ranks in use and `low` the ranks within each; x & -x finds the first bit set. `buckets`
    holds a heap of positions for each rank in use. A bucket is emptied at once, unless a merge queues a lower rank, which then
    goes first. The queue is written out here, not as a class: calls would take half of the time.
    """
    import numpy as np

    get = ranks.get
    found = [b"" if not piece else None if whole is None else whole.to_bytes(4, "little") for piece, whole in zip(pieces, map(get, pieces))]
    split = [piece for piece, ids in zip(pieces, found) if ids is None]
    data = b"".join(split)
    n = len(data)
    if not n:
        return found
    stops = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
    edge = np.zeros(n + 1, np.uint8)  # 1 where a pre-token begins, and at the end
    edge[0] = edge[stops] = 1
    ends = list(range(1, n + 1))  # node i spans data[i:ends[i]]; the next node starts where it ends
    prev = list(range(-1, n))
    single = {c: ranks[bytes([c])] for c in set(data)}
    ids = list(map(single.__getitem__, data))  # of each node: a merge's rank is the id of what it makes; -1 once the node before has taken it in
    due = [-1] * n  # the rank at which a node merges with the next
    codes = np.frombuffer(data, np.uint8).astype(np.uint16)
    codes = codes[:-1] << 8 | codes[1:]  # the two bytes from each position
    order = np.argsort(codes, kind="stable")
    order = order[edge[order + 1] == 0]
    top, low, buckets = 0, {}, {}
    if len(order):
        for same in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
            same = same.tolist()  # positions rise: a sorted list is a heap
            rank = get(data[same[0] : same[0] + 2])
            if rank is not None:
                buckets[rank] = same
                a = rank >> 8
                top |= 1 << a
                low[a] = low.get(a, 0) | 1 << (rank & 255)
                for i in same:
                    due[i] = rank
    edge = edge.tobytes()
    while top:
        a = (top & -top).bit_length() - 1
        word = low[a]
        first = word & -word
        now = least = a << 8 | first.bit_length() - 1
        bucket = buckets[now]
        while bucket and least == now:
            i = heappop(bucket)
            if due[i] != now:
                continue  # stale
            j = ends[i]
            due[j] = ids[j] = -1
            ids[i] = now
            end = ends[i] = ends[j]
            if edge[end]:
                due[i] = -1
            else:
                prev[end] = i
                rank = get(data[i : ends[end]])
                if rank is None:
                    due[i] = -1
                else:
                    due[i] = rank
                    if rank in buckets:
                        heappush(buckets[rank], i)
                    else:
                        buckets[rank] = [i]
                        a = rank >> 8
                        top |= 1 << a
                        low[a] = low.get(a, 0) | 1 << (rank & 255)
                        if rank < least:
                            least = rank
            if not edge[i]:
                p = prev[i]
                rank = get(data[p:end])
                if rank is None:
                    due[p] = -1
                else:
                    due[p] = rank
                    if rank in buckets:
                        heappush(buckets[rank], p)
                    else:
                        buckets[rank] = [p]
                        a = rank >> 8
                        top |= 1 << a
                        low[a] = low.get(a, 0) | 1 << (rank & 255)
                        if rank < least:
                            least = rank
        if not bucket:
            del buckets[now]
            a = now >> 8
            low[a] ^= first
            if not low[a]:
                top ^= 1 << a
    left = np.array(ids, np.int64)
    packed = left[left >= 0].astype("<u4").tobytes()
    lo, his = 0, iter((4 * np.cumsum(left >= 0)[stops - 1]).tolist())
    for k, whole in enumerate(found):
        if whole is None:
            hi = next(his)
            found[k] = packed[lo:hi]
            lo = hi
    return found


class Codec:
    """Splits a text by the pattern, encodes each match separately, and decodes ids. Ids travel packed, four bytes each."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tokens = {rank: token for token, rank in ranks.items()}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """encode() of each text, in order. What isn't remembered is encoded together for texts of PIECES pre-tokens."""
        split, n = [], 0
        for text in texts:
            split.append(self.find(text))
            n += len(split[-1])
            if n >= PIECES:
                yield from self._ids(split)
                split, n = [], 0
        yield from self._ids(split)

    def _ids(self, split: list[list[str]]) -> list[bytes]:
        """The packed ids of texts that are split into pre-tokens."""
        need = set().union(*split)
        new = need.difference(self.known)
        if new and len(self.known) + len(new) > CACHE:
            self.old, self.known, new = self.known, {}, need
        known, old = self.known, self.old
        some, size = [], 0
        for piece in new:
            ids = old.get(piece)
            if ids is not None:
                known[piece] = ids
                continue
            some.append(piece)
            size += len(piece)
            if size >= JOINT:
                self._learn(some)
                some, size = [], 0
        self._learn(some)
        packed = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        for piece in new:
            if len(piece) > 64:
                del known[piece]
        return packed

    def _learn(self, pieces: list[str]) -> None:
        self.known.update(zip(pieces, encode_pieces([piece.encode() for piece in pieces], self.ranks)))

    def decode(self, packed: bytes) -> bytes:
        ids = array("I")
        ids.frombytes(packed)
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[tuple[int, str], Codec] = {}


def _codec(ranks, pattern: str) -> Codec:
    """One codec for each worker process."""
    key = (ranks.id if hasattr(ranks, "id") else id(ranks), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks.value, pattern)
    return _CODECS[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with ids, array<int>. The vocabulary is read by the driver and broadcast; its size is fixed."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        codec = _codec(ranks, pattern)
        for pdf in batches:
            pdf["ids"] = [np.frombuffer(packed, dtype="<i4") for packed in codec.encode_all(t or "" for t in pdf[text].array)]
            yield pdf[[f.name for f in out.fields]]

    out = T.StructType([*others(docs, "ids"), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.mapInPandas(run, out)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """encoded with decoded, binary: the bytes of the ids; null ids count as none."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        codec = _codec(ranks, "")
        for pdf in batches:
            pdf["decoded"] = [codec.decode(np.asarray([] if x is None else x, dtype="<u4").tobytes()) for x in pdf[ids].array]
            yield pdf[[f.name for f in out.fields]]

    out = T.StructType([*others(encoded, "decoded"), T.StructField("decoded", T.BinaryType())])
    return encoded.mapInPandas(run, out)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_tokens, ids_sha256 and decoded_sha256, the ids having been encoded and decoded in the same task
    by the same codec as encode() and decode(); the ids themselves don't leave it."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    schema = T.StructType([docs.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = _codec(ranks, pattern)
        for batch in parts(batches):
            n, ids, back = [], [], []
            for packed in codec.encode_all(t.as_py() or "" for t in batch.column(text)):
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(codec.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(run, schema)


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_vocabulary()
    return round_trip(load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), path, pattern)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_byte_bpe": query}
ORACLE: dict[str, str] = {}
