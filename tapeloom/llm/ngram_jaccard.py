"""N-gram Jaccard join by token-combination prefixes.

A document's set is its distinct word shingles (words of A-Z lower-cased; with fewer words than a shingle, the whole sequence is one);
two documents link when 100 * intersection >= percent * union. Shingles are 64-bit hashes.

Steps, each exact:
 1. Equal sets fall together by a 128-bit hash of the set; one document stands for them from step 3 on.
 2. In the order of the hashes, two linked sets hold their first k common shingles within their first n - least + k each,
    n being the size and least the smallest intersection. So a set is out unless k of these are held by another.
 3. The whole sets of the rest: shingles held once go, the others get a key that sorts by frequency class (log2) and hash.
    A set with less than `percent` of its shingles left is out.
 4. Prefixes in the order of the keys, extended by g + 1: two linked sets share g + 1 keys in them at least. Rare
    classes are indexed by single keys. Frequent ones (over 2^RARE sets) are dealt over g groups, and the pairs within each group are
    indexed: of g + 1 shared keys one is rare or two are of the same group. g grows with the size of the set; sets near
    a limit are indexed for both sides.
 5. The members of an index entry are verified against one of them, the one with the fewest unshared shingles. What
    links falls into a component. An entry whose members are then of one component is done; in the others every pair of
    different components is verified, too. Either way a pair is left to its other entries if what both have from this
    one on in the order can't make a link (for pairs of keys: and the g keys that may come before, of the frequent ones
    alone, as sets with a rare key in common meet there).
 6. Components of the links, by label propagation with pointer jumping.
So no link between different components is missed, and the pairs of a group of copies aren't spelt out.

Frequent shingles never gather: counts are partial before the shuffle, and joins on them are between two shuffled sides, which
adaptive execution splits. Rows of one hub, component or group of copies are dealt over tasks by spread_join().

Cases: a null text, or one without words, has an empty set and links with nothing; repeated rows link by their equal sets; null ids
stand after all others (component_id is null only if all of a component are); one long text is hashed in one piece; an
empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_ROWS, cut, if_small, load, parts, spread_join, stored, with_unique_key

PERCENT, WIDTH = 85, 4
#: Of a set's first shingles in the order of hashes, this percentage of its size counts as k in step 2.
FIRST = 8
RARE = 6
#: (from this size on, groups of frequent keys): with sets ten times as large come eight times the groups, so the pairs of a set, some
#: (0.15 n)^2 / 2g, grow little faster than the set.
GROUPS = ((0, 2), *((200 * 10**i, 16 * 8**i) for i in range(8)))
#: Bytes of text that are hashed together.
CHUNK = 150_000


def mixed(x):
    """A finaliser for 64-bit hashes."""
    import numpy as np

    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """The shingle sets of texts, as sorted arrays of 64-bit hashes.

    The hash of a word is a polynomial of its bytes modulo 2^64, had for all words at once from the running sum of
    byte * P^place; that of a shingle is one of its words' hashes.
    """

    P = 0x9E3779B97F4A7C15

    def __init__(self, width: int = WIDTH) -> None:
        import numpy as np

        self.width = width
        self.up = self.down = np.ones(1, np.uint64)
        self.byte = mixed(np.arange(1, 257, dtype=np.uint64))

    def powers(self, n: int) -> None:
        import numpy as np

        if len(self.up) < n:
            n = max(n, CHUNK)
            inverse = pow(self.P, -1, 2**64)
            for name, p in (("up", self.P), ("down", inverse)):
                a = np.full(n, p, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))

    def sets(self, texts: list[str]) -> list:
        out, some, size = [], [], 0
        for t in texts:
            b = t.encode()
            some.append(b)
            size += len(b) + 1
            if size >= CHUNK:
                out += self._sets(some)
                some, size = [], 0
        return out + self._sets(some) if some else out

    def _sets(self, texts: list[bytes]) -> list:
        import numpy as np

        b = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.powers(len(b) + 1)
        b = np.where((b >= 65) & (b <= 90), b + 32, b)
        gap = (b == 32) | ((b >= 9) & (b <= 13))
        edge = np.diff(gap.view(np.int8), prepend=np.int8(1))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.byte[b] * self.up[: len(b)])])
        word = mixed((total[last] - total[first]) * self.down[first])
        sizes = np.array([len(t) + 1 for t in texts])
        starts = np.cumsum(sizes) - sizes
        lo = np.searchsorted(first, starts)
        hi = np.append(lo[1:], len(first))
        n = len(word) - self.width + 1
        run = np.zeros(max(n, 0), np.uint64)
        for i in range(self.width):
            run = mixed(run + word[i : i + len(run)] + np.uint64(i + 1))
        out = []
        for a, z in zip(lo, hi):
            if z - a >= self.width:
                out.append(np.unique(run[a : z - self.width + 1]))
            else:
                x = np.zeros(min(1, z - a), np.uint64)
                for i in range(a, z):
                    x = mixed(x + word[i] + np.uint64(i - a + 1))
                out.append(mixed(x + np.uint64(z - a)))
        return out


_SHINGLERS: dict[int, Shingler] = {}


def _shingler(width: int) -> Shingler:
    return _SHINGLERS.setdefault(width, Shingler(width))


def least(n, percent: int):
    """The smallest intersection of a set of n with a linked one; n may be an array."""
    return -(-percent * n // 100)


def set_hash(s) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def _head_and_rows(heads: dict, name: str, arrays: list):
    """An Arrow batch of a row for each of heads, then a row for each value of arrays, which have rid and name alone. Plain columns
    are read and written in small vectors, where arrays of a batch's documents would be one large one."""
    import numpy as np
    import pyarrow as pa

    sizes = [len(x) for x in arrays]
    rid = np.asarray(heads["rid"], np.int64)
    n = sum(sizes)
    cols = {"rid": pa.array(np.concatenate([rid, np.repeat(rid, sizes)]), pa.int64())}
    for k, v in heads.items():
        if k != "rid":
            cols[k] = pa.concat_arrays([v, pa.nulls(n, v.type)])
    cols[name] = pa.concat_arrays([pa.nulls(len(rid), pa.int64()), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64))])
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def numbered(docs: DataFrame) -> DataFrame:
    """rid, doc_id, text: rid is the id where ids are whole numbers, none null or repeated, otherwise a row number of a stored copy."""
    if isinstance(docs.schema["doc_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        docs, own = with_unique_key(docs)
        return docs.select(F.col(own).cast("long").alias("rid"), "doc_id", "text")
    return stored(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "rows")


def prepared(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """For each document a row with rid, doc_id, n and sig, the size and the 128-bit hash of its set (null if empty), and rows with rid and token
    for the set's first hashes, for step 2. docs: rid, doc_id, text."""
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("token", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in parts(batches):
            sets = _shingler(width).sets([t.as_py() or "" for t in batch.column("text")])
            low = [s[: len(s) - least(len(s), percent) + max(1, FIRST * len(s) // 100)] for s in sets]
            heads = {"rid": batch.column("rid").to_numpy(), "doc_id": batch.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()), "sig": pa.array([set_hash(s) if len(s) else None for s in sets], pa.binary())}
            yield _head_and_rows(heads, "token", low)

    return docs.mapInArrow(run, schema)


def whole_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """For each document in wanted (rid) a row with rid and n, and rows with rid and token for its whole set."""
    rows = docs.join(if_small(wanted.select(F.col("rid").alias("r"))), F.col("rid") == F.col("r"), "left_semi").select("rid", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in parts(batches):
            sets = _shingler(width).sets([t.as_py() or "" for t in batch.column("text")])
            yield _head_and_rows({"rid": batch.column("rid").to_numpy(), "n": pa.array([len(s) for s in sets], pa.int64())}, "token", sets)

    return rows.mapInArrow(run, "rid long, n long, token long")


def signatures(n: int, keys, percent: int):
    """The index entries of a set of n with these keys in order: 64-bit hashes of single keys and pairs, and for each the
    most that the set can have in common with one that it first meets there."""
    import numpy as np

    sigs, most = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, (lo, g) in enumerate(GROUPS):
        hi = GROUPS[i + 1][0] if i + 1 < len(GROUPS) else 1 << 62
        if n < least(lo, percent) or least(n, percent) >= hi:
            continue
        # shingles that no other set has come first in the order
        first = keys[: max(0, n - least(n, percent) + g + 1 - (n - len(keys)))]
        left = len(keys) - np.arange(len(first))
        rare = (first >> np.uint64(56)) <= RARE
        # nothing common comes before the first common key, if that is a rare one
        sigs.append(mixed(first[rare] + np.uint64(i)))
        most.append(left[rare])
        often, left = first[~rare], left[~rare]
        # a pair of sets with a rare key in common meets there; others have frequent keys alone in common
        frequent = int(np.sum((keys >> np.uint64(56)) > RARE))
        group = (often % np.uint64(g)).astype(np.int64)
        for k in np.flatnonzero(np.bincount(group, minlength=g) > 1):
            own, own_left = often[group == k], left[group == k]
            a, b = np.triu_indices(len(own), 1)
            sigs.append(mixed(mixed(own[a] + np.uint64(i)) + own[b]))
            # of the first g + 1 common keys two are of one group, and g at most come before the first of these
            most.append(np.minimum(own_left[a] + g, frequent))
    return np.concatenate(sigs), np.concatenate(most)


def index(nodes: DataFrame, percent: int) -> DataFrame:
    """sig, rid, n, lost, most: nodes by index entry; lost is the number of shingles that no other set has."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in parts(batches):
            keys = batch.column("keys")
            values, at = keys.values.to_numpy(zero_copy_only=False).view(np.uint64), keys.offsets.to_numpy()
            n = batch.column("n").to_numpy(zero_copy_only=False)
            out = [signatures(int(n[i]), values[at[i] : at[i + 1]], percent) for i in range(len(n))]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x, _ in out])]).astype(np.int32))
            sigs = np.concatenate([*(x for x, _ in out), np.zeros(0, np.uint64)]).view(np.int64)
            most = np.concatenate([*(m for _, m in out), np.zeros(0, np.int64)])
            lost = n - np.diff(at)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("n"), pa.array(lost, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(sigs)), pa.ListArray.from_arrays(offsets, pa.array(most))], names=["rid", "n", "lost", "sigs", "most"])

    entries = nodes.mapInArrow(run, "rid long, n long, lost long, sigs array<long>, most array<long>")
    return entries.select("rid", "n", "lost", F.explode(F.arrays_zip("sigs", "most")).alias("e")).select(F.col("e.sigs").alias("sig"), "rid", "n", "lost", F.col("e.most").alias("most"))


def linked(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    side = lambda x: nodes.select(F.col("rid").alias(x), F.col("n").alias(f"n_{x}"), F.col("keys").alias(f"keys_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.withColumn("common", F.size(F.array_intersect("keys_a", "keys_b")))
    return both.where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the least node that each node of the edges (a, b) is joined to. A node of very many edges, or that very many
    point to, is dealt over several tasks."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    hubs = cut(both.groupBy("b").agg(F.count("*").alias("rows")).where(F.col("rows") >= HOT_ROWS))
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = spread_join(both, label.select(F.col("node").alias("b"), "comp"), "b", "a", hubs).groupBy("a").agg(F.min("comp").alias("near"))
        moved = cut(label.join(near, label["node"] == near["a"]).select("node", F.least("comp", "near").alias("to"), (F.col("near") < F.col("comp")).alias("moved")))
        jump = moved.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        label = cut(spread_join(moved, jump, "to", "node").select("node", F.least("to", "to2").alias("comp"), "moved", (F.col("to2") < F.col("to")).alias("jumped")))
        if label.where("moved or jumped").isEmpty():
            return label.select("node", "comp")
        label = label.select("node", "comp")


def join(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: rid, doc_id, n_shingles, component_id."""
    docs = numbered(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    both = stored(prepared(docs, percent, width), "sets")
    rows = cut(both.where("n is not null").drop("token"))
    copies = cut(rows.where("n > 0").groupBy("sig").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("first"), F.max("n").alias("n"), F.count("*").alias("rows")))

    # step 2
    low = both.where("token is not null").select("rid", "token")
    held = cut(low.groupBy("token").count().where("count > 1").select("token"))
    hits = low.join(held, "token").groupBy("rid").count()
    need = F.greatest(F.lit(1), F.floor(FIRST * F.ceil(percent * F.col("n") / 100) / 100))
    wanted = cut(copies.join(hits, "rid").where(F.col("count") >= need).select("rid"))

    # step 3
    sets = stored(whole_sets(docs, wanted, width), "tokens")
    tokens = sets.where("token is not null").select("rid", "token")
    # the class is in the top byte, from 1 up: keys are positive longs and sort as such
    often = tokens.groupBy("token").count().where("count > 1")
    key_of = F.shiftleft(F.floor(F.log2("count")).cast("long"), 56).bitwiseOR(F.col("token").bitwiseAND(F.lit((1 << 56) - 1)))
    often = stored(often.select("token", key_of.alias("key")), "often")
    keys = tokens.join(often, "token").groupBy("rid").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    nodes = stored(sets.where("n is not null").select("rid", "n").join(keys, "rid").where(100 * F.size("keys") >= percent * F.col("n")), "nodes")

    # step 4
    entries = stored(index(nodes, percent), "index")
    groups = cut(entries.groupBy("sig").agg(F.count("*").alias("rows"), F.min(F.struct("lost", "rid", "n", "most")).alias("best")).where("rows > 1").select("sig", "rows", F.col("best.rid").alias("b"), F.col("best.n").alias("n2"), F.col("best.most").alias("most2")))
    common = F.least("most", "most2")
    may = 100 * common >= percent * (F.col("n") + F.col("n2") - common)
    met = spread_join(entries.drop("lost"), groups.drop("rows"), "sig", "rid", groups.where(F.col("rows") >= HOT_ROWS))
    met = stored(met.select("sig", "rid", "n", "most", F.when((F.col("rid") != F.col("b")) & may, F.col("b")).alias("b")), "met")
    stars = cut(met.where("b is not null").select(F.col("rid").alias("a"), "b").distinct())
    links = cut(linked(stars, nodes, percent))
    label = components(links)

    # step 5
    labelled = lambda entries: entries.drop("b").join(label, F.col("rid") == F.col("node"), "left").select("sig", "rid", "n", "most", F.coalesce("comp", "rid").alias("comp"))
    mixed_groups = cut(labelled(met).groupBy("sig").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("sig"))
    x = stored(labelled(met.join(mixed_groups, "sig", "left_semi")), "open")
    y = x.select("sig", *(F.col(c).alias(f"{c}2") for c in ("rid", "n", "most", "comp")))
    may = may & (F.col("rid") < F.col("rid2")) & (F.col("comp") != F.col("comp2"))
    pairs = x.join(y, "sig").where(may).select(F.col("rid").alias("a"), F.col("rid2").alias("b")).distinct()
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = cut(linked(cut(pairs.join(done, ["a", "b"], "left_anti")), nodes, percent))
    if not more.isEmpty():
        label = components(links.union(more))

    # step 6
    whole = copies.select("sig", "rid", "first").join(label.select(F.col("node").alias("rid"), "comp"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    whole = cut(whole.select("sig", "comp", "first"))
    least_id = cut(whole.groupBy("comp").agg(F.min("first").alias("component_id")))
    known = cut(spread_join(whole.select("sig", "comp"), least_id, "comp", "sig").select("sig", "component_id"))
    out = spread_join(rows, known, "sig", "rid", copies.where(F.col("rows") >= HOT_ROWS), "left")
    return out.select("rid", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 4 THEN unnest(list_transform(range(1, len(w) - 2), lambda i: md5(array_to_string(w[i:i + 3], ' '))))
             ELSE unnest([md5(len(w) || ' ' || array_to_string(w, ' '))]) END AS x FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 85 * (na.n + nb.n - o)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""

QUERIES = {"op7_ngram_jaccard": query}
ORACLE = {"op7_ngram_jaccard": SQL}
