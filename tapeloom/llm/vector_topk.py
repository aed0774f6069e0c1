"""Exact top-k search by vector-approximation files.

Layout, written once. `vectors` holds the exact vectors as whole numbers; `codes` holds a byte for each dimension, the cell of the component
among `cells` of equal whole width between the dimension's least and largest value of all vectors. Of equal vectors only the rows of the
k + 1 smallest ids are kept: none of the others can be among any query's k best.

Scan. Queries, in blocks, meet the codes, in shards; the exact vectors aren't touched. As all cells of a dimension are as wide, one matrix
product of codes and scaled query gives both bounds of every inner product: their distance is the same for all vectors. What can't reach the kth lower
bound of its shard is out, then what can't reach the kth of all shards: the survivors.

Reading. Exact vectors are read for survivors alone, in the order of their upper bounds (of a distance, lower ones would come first): the k first of
each query, then those whose bound still reaches the kth exact score found. After that no bound left reaches it, so the result is certain.

A task holds `shard_rows` codes and `block_rows` queries, whatever the size of the table. Codes, an eighth of the vectors' bytes, are copied for each
block of queries, and queries for each shard; exact vectors are not.

Scores are exact integers of at most 64 bits (others raise an error). Ties go to the smaller id. Vectors that are null or hold null or
non-finite components take no part. Vectors of another length than the query's aren't compared with it. A query's own row is left out by its id, so
repeated rows of a query's id are neither found by it, and find together; repeated rows of other ids are each found. Null ids take no part.
Where k candidates aren't there, all are returned; empty vectors score 0; empty tables give an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, if_small, load, stored

K, CELLS, SHARD_ROWS, BLOCK_ROWS = 10, 256, 65_536, 4096
#: Bounds that are held at once while a block scans a shard.
HELD = 4_000_000


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id, v: the vectors that take part, as floor(scale * x)."""
    whole = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(whole).select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def matrix(column):
    """An Arrow column of lists of the same length as a matrix."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def ranges(vectors: DataFrame) -> dict[int, tuple[list[float], list[float]]]:
    """For each length of vectors, the least and the largest value of each dimension. Two numbers a dimension come to the driver."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        seen: dict[int, tuple] = {}
        for batch in batches:
            d = pc.list_value_length(batch.column("v"))
            for n in pc.unique(d).to_pylist():
                m = matrix(batch.column("v").filter(pc.equal(d, n)))
                lo, hi = (m.min(axis=0), m.max(axis=0)) if n else (np.zeros(0), np.zeros(0))
                seen[n] = (np.minimum(seen[n][0], lo), np.maximum(seen[n][1], hi)) if n in seen else (lo, hi)
        rows = [(n, i, lo[i], hi[i]) for n, (lo, hi) in seen.items() for i in range(n)] + [(n, -1, 0.0, 0.0) for n in seen]
        cols = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())], names=["d", "i", "lo", "hi"])

    found = vectors.select("v").mapInArrow(run, "d int, i int, lo double, hi double").groupBy("d", "i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    out: dict[int, tuple[list[float], list[float]]] = {}
    for r in sorted(found.collect()):
        lo, hi = out.setdefault(r.d, ([], []))
        if r.i >= 0:
            lo.append(r.lo)
            hi.append(r.hi)
    return out


def widths(known, cells: int):
    """Bottoms and widths of the cells: whole numbers, so that a cell reaches from its bottom to bottom + width - 1."""
    import numpy as np

    lo, hi = (np.asarray(x, np.float64) for x in known)
    return lo, np.floor((hi - lo) / cells) + 1


def coded(vectors: DataFrame, known: dict, cells: int) -> DataFrame:
    """rid, vec_id, d, code. vectors: rid, vec_id, v."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            d = pc.list_value_length(batch.column("v"))
            for n in pc.unique(d).to_pylist():
                part = batch.filter(pc.equal(d, n))
                lo, width = widths(known[n], cells)
                code = np.minimum((matrix(part.column("v")) - lo) // width, cells - 1).astype(np.uint8) if n else np.zeros((part.num_rows, 0), np.uint8)
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("vec_id"), pa.array([n] * part.num_rows, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], names=["rid", "vec_id", "d", "code"])

    return vectors.select("rid", "vec_id", "v").mapInArrow(run, "rid long, vec_id long, d int, code binary")


def bounds(q, lo, width, code):
    """The lower bounds of the inner products of queries and coded vectors, and for each query how far above the upper ones are. Rounding
    is added to that distance."""
    import numpy as np

    scaled, slack = q * width, q * (width - 1)
    low = (scaled @ code.T.astype(np.float64)) + (q @ lo + np.minimum(slack, 0).sum(axis=1))[:, None]
    rounding = 1e-9 * (np.abs(q * lo).sum(axis=1) + 256 * np.abs(scaled).sum(axis=1))
    return low - rounding[:, None], np.abs(slack).sum(axis=1) + 2 * rounding


def scanned(asked: DataFrame, codes: DataFrame, known: dict, k: int, cells: int) -> DataFrame:
    """qrid, query_id, rid, vec_id, low, high: the pairs that may be among the k best of their shard. asked: rid, vec_id, v, d, shard, block;
    codes: rid, vec_id, code, d, shard, block."""

    def run(q, c) -> Iterator:
        import numpy as np
        import pandas as pd

        none = pd.DataFrame({n: pd.Series(dtype=t) for n, t in (("qrid", "int64"), ("query_id", "int64"), ("rid", "int64"), ("vec_id", "int64"), ("low", "float64"), ("high", "float64"))})
        if not len(q) or not len(c):
            return none
        lo, width = widths(known[int(q["d"].iloc[0])], cells)
        code = np.frombuffer(b"".join(c["code"]), np.uint8).reshape(len(c), len(lo))
        vectors = np.array(q["v"].tolist(), np.float64).reshape(len(q), len(lo))
        q_rids, q_ids, rids, ids = (x.to_numpy() for x in (q["rid"], q["vec_id"], c["rid"], c["vec_id"]))
        step, out = max(1, HELD // len(c)), [none]
        for a in range(0, len(q), step):
            low, reach = bounds(vectors[a : a + step], lo, width, code)
            for i, row in enumerate(low):
                row[ids == q_ids[a + i]] = -np.inf
                floor = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                at = np.flatnonzero((row + reach[i] >= floor) & (row > -np.inf))
                out.append(pd.DataFrame({"qrid": q_rids[a + i], "query_id": q_ids[a + i], "rid": rids[at], "vec_id": ids[at], "low": row[at], "high": row[at] + reach[i]}))
        return pd.concat([x for x in out if len(x)] or [none])

    keys = ("d", "shard", "block")
    return asked.groupBy(*keys).cogroup(codes.groupBy(*keys)).applyInPandas(run, "qrid long, query_id long, rid long, vec_id long, low double, high double")


def survivors(found: DataFrame, k: int) -> DataFrame:
    """The pairs of scanned() whose upper bound reaches the kth lower bound of their query."""
    order = W.partitionBy("query_id").orderBy(F.desc("low"))
    kth = found.select("query_id", "low").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    kth = kth.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("low")).alias("floor"))
    return found.join(if_small(cut(kth)), "query_id").where("floor is null or high >= floor").select("qrid", "query_id", "rid", "vec_id", "high")


def scored(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, vec_id, score: pairs with the exact vectors read."""
    pairs = if_small(stored(pairs, "pairs"))
    q, v = vectors.select(F.col("rid").alias("qrid"), F.col("v").alias("q")), vectors.select("rid", "v")
    both = pairs.join(v, "rid").join(q, "qrid").select("query_id", "vec_id", "q", "v")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            a, b = batch.column("q"), batch.column("v")
            most = [float(np.abs(x.flatten().to_numpy(zero_copy_only=False)).max(initial=0)) for x in (a, b)]
            longest = pc.max(pc.list_value_length(a)).as_py() or 0
            if most[0] * most[1] * longest < 2**53:
                product = a.flatten().to_numpy(zero_copy_only=False) * b.flatten().to_numpy(zero_copy_only=False)
                sums = np.concatenate([[0.0], np.cumsum(product)]) if float(np.abs(product).sum()) < 2**53 else None
                ends = np.cumsum(pc.list_value_length(a).to_numpy(zero_copy_only=False))
                score = (sums[ends] - sums[np.concatenate([[0], ends[:-1]]).astype(int)]).astype(np.int64) if sums is not None else [int(np.dot(x, y)) for x, y in zip(a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False))]
            else:
                score = [sum(int(x) * int(y) for x, y in zip(m, n)) for m, n in zip(a.to_pylist(), b.to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

    return both.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "embedding", scale: int = 1024, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products with all other rows."""
    return best_of(*candidates(vectors, is_query, k, key, vector, scale, shard_rows, block_rows, cells), k)


def candidates(vectors: DataFrame, is_query: Column, k: int, key: str, vector: str, scale: int, shard_rows: int, block_rows: int, cells: int) -> tuple[DataFrame, DataFrame]:
    """The survivors of the scan, and the exact vectors (rid, vec_id, v, asked)."""
    rows = usable(vectors, key, vector, scale).withColumn("asked", is_query)
    alike = F.dense_rank().over(W.partitionBy("v").orderBy("vec_id"))
    # a query stays whatever its rank
    exact = rows.withColumn("n", alike).where((F.col("n") <= k + 1) | F.col("asked")).select(F.monotonically_increasing_id().alias("rid"), "vec_id", "v", "asked")
    exact = stored(exact, "vectors")
    known = ranges(exact)
    codes = stored(coded(exact, known, cells), "codes")
    counted = exact.agg(F.count("*"), F.count_if("asked")).first()
    shards, blocks = max(1, -(-counted[0] // shard_rows)), max(1, -(-counted[1] // block_rows))
    deal = lambda n: F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    scan = codes.select("rid", "vec_id", "code", "d", deal(shards).alias("shard"), each(blocks).alias("block"))
    asked = exact.where("asked").select("rid", "vec_id", "v", F.size("v").alias("d"), each(shards).alias("shard"), deal(blocks).alias("block"))
    return stored(survivors(stored(scanned(asked, scan, known, k, cells), "bounds"), k), "survivors"), exact


def best_of(left: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """The k best by exact scores, read in the order of the upper bounds."""
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("high"), "vec_id", "qrid", "rid"))
    left = stored(left.withColumn("n", order), "ordered")
    first = cut(scored(left.where(F.col("n") <= k), exact))
    kth = cut(first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("floor")))
    rest = left.where(F.col("n") > k).join(if_small(kth), "query_id").where("floor is null or high >= floor").drop("floor")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return first.union(scored(rest, exact)).select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

QUERIES = {"op8_vector_topk": query}
ORACLE = {"op8_vector_topk": SQL}
