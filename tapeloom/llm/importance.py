"""Target-distribution importance resampling with an integer word dictionary.

Two corpora are described by counts of hashed n-grams; a document's weight is the sum of its n-grams' log ratios, and a Gumbel draw keeps the best.

Blocks. One pass over the texts writes, for each block of some `block_words` words, the block's own dictionary of words, its distinct n-grams as
tuples of places in that dictionary with their counts, and for each document the places of its n-grams in that list with counts. From there on
a word or n-gram travels once a block, not once a document.

Dictionary. The words of all blocks, sorted, get integer ids. A block's tuples become tuples of ids, equal ones are summed over the blocks, and the
bytes of each distinct tuple are put together from the dictionary and hashed once. What the hash says (its bucket's gain) is joined back to the
blocks by tuple, and to the documents by block.

Skew. No word or tuple has more rows than there are blocks; tuples that share a word are dealt over tasks. A block is bounded by its words; a document
that is longer is a block of its own. Gains are one row for each bucket. Ranks come from ranges of scores, shifted by the sizes of the ranges before.

Cases: null texts have no words; a document without features weighs 0; documents under `least` words are never drawn, and have a weight and
score all the same; null ids are hashed as an empty string and come last among equal scores; repeated rows are rows of their own; an empty
table gives an empty result, an empty target none but prior counts; other columns aren't read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, load, parts, spread_join, stored

BLOCK_WORDS, BUCKETS, LEAST, PERCENT, SEED = 1 << 21, 10_000, 20, 10, 2024


def lowered() -> bytes:
    """For each byte what it becomes: letters in lower case, digits and bytes over 127 as they are, all others a space."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def numbered() -> defaultdict:
    """A dictionary that gives each new key the next number."""
    found: defaultdict = defaultdict()
    found.default_factory = found.__len__
    return found


def encoded(docs: DataFrame, shortest: int, longest: int, text: str, key: str, block_words: int) -> DataFrame:
    """A row for each document (rid, key, n_words, n_features, at, n: the places of its n-grams in its block's list, each as the distance from the one before, and how often each) and, with
    rid null, for each block (words, grams, totals)."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    small, large = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    fields = {"block": T.LongType(), "rid": T.LongType(), "doc_id": rows.schema["doc_id"].dataType, "n_words": T.LongType(), "n_features": T.LongType(), "at": small, "n": small, "words": T.ArrayType(T.BinaryType()), "grams": T.ArrayType(small), "totals": large}
    table = lowered()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        schema = None
        block, held = TaskContext.get().partitionId() << 32, 0
        words, grams, seen = numbered(), numbered(), []

        def lists(values, dtype):
            ends = np.cumsum([0, *map(len, values)])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*values, np.zeros(0, dtype)])))

        def whole(columns: dict, rows: int):
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

        def closed():
            at, n = (np.concatenate([*(x[i] for x in seen), np.zeros(0, np.int32)]) for i in (0, 1))
            totals = np.bincount(at, n, len(grams)).astype(np.int64)
            tuples = lists([np.asarray(g, np.int32) for g in grams], np.int32)
            return whole({"block": pa.array([block], pa.int64()), "words": pa.array([list(words)], pa.list_(pa.binary())), "grams": pa.ListArray.from_arrays(pa.array([0, len(tuples)], pa.int32()), tuples), "totals": lists([totals], np.int64)}, 1)

        for batch in parts(batches):
            if schema is None:
                kinds = {"at": pa.list_(pa.int32()), "n": pa.list_(pa.int32()), "words": pa.list_(pa.binary()), "grams": pa.list_(pa.list_(pa.int32())), "totals": pa.list_(pa.int64()), "doc_id": batch.schema.field("doc_id").type}
                schema = pa.schema([(f, kinds.get(f, pa.int64())) for f in fields])
            done = []
            blocks = []
            for t in batch.column("text"):
                own = (t.as_py() or b"").translate(table).split()
                if held and held + len(own) > block_words:
                    yield closed()
                    block, held = block + 1, 0
                    words, grams, seen = numbered(), numbered(), []
                ids = list(map(words.__getitem__, own))
                found = [g for n in range(shortest, longest + 1) for g in map(grams.__getitem__, zip(*(ids[k:] for k in range(n))))]
                at, n = np.unique(np.asarray(found, np.int32), return_counts=True)
                seen.append((at, n := n.astype(np.int32)))
                done.append((len(own), len(found), np.diff(at, prepend=np.int32(0)), n))
                blocks.append(block)
                held += len(own)
            yield whole({"block": pa.array(blocks, pa.int64()), "rid": batch.column("rid"), "doc_id": batch.column("doc_id"), "n_words": pa.array([x[0] for x in done], pa.int64()), "n_features": pa.array([x[1] for x in done], pa.int64()), "at": lists([x[2] for x in done], np.int32), "n": lists([x[3] for x in done], np.int32)}, batch.num_rows)
        if seen:
            yield closed()

    return rows.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields.items()]))


def numbered_words(blocks: DataFrame) -> DataFrame:
    """target, block, p, id, word: the id of each word of each block; the word itself stands at one row of each id. Rows are dealt and sorted by word, so
    equal words follow one another, and a task counts them as they stream by."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        id_, before = (TaskContext.get().partitionId() << 40) - 1, None
        for batch in batches:
            word = batch.column("word")
            if not len(word):
                continue
            fresh = np.ones(len(word), bool)
            fresh[0] = word[0].as_py() != before
            fresh[1:] = pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False)
            ids = id_ + np.cumsum(fresh)
            id_, before = int(ids[-1]), word[len(word) - 1].as_py()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("target", "block", "p")), pa.array(ids, pa.int64()), pc.if_else(pa.array(fresh), word, pa.scalar(None, word.type))], names=["target", "block", "p", "id", "word"])

    rows = blocks.select("target", "block", F.posexplode("words").alias("p", "word"))
    return rows.repartition("word").sortWithinPartitions("word").mapInArrow(run, "target boolean, block long, p int, id long, word binary")


def tuples(blocks: DataFrame, numbers: DataFrame) -> DataFrame:
    """target, block, j, gram, total: the blocks' n-grams as tuples of the dictionary's ids. numbers: numbered_words()."""
    ids = numbers.groupBy("target", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "id"))), lambda x: x["id"]).alias("ids"))
    own = blocks.select("target", "block", "grams", "totals").join(ids, ["target", "block"])
    named = F.transform("grams", lambda g: F.transform(g, lambda i: F.get("ids", i)))
    return own.select("target", "block", named.alias("g"), "totals").select("target", "block", F.posexplode(F.arrays_zip("g", "totals")).alias("j", "x")).select("target", "block", "j", F.col("x.g").alias("gram"), F.col("x.totals").alias("total"))


def hashed(found: DataFrame, dictionary: DataFrame, longest: int, buckets: int) -> DataFrame:
    """gram, s, t, bucket: each distinct tuple with its counts in both corpora, and the bucket of its bytes, put together and hashed once."""
    both = found.groupBy("gram").agg(*(F.sum(F.when(F.col("target") == side, F.col("total")).otherwise(0)).alias(n) for n, side in (("s", False), ("t", True))))
    whole: Column = F.lit(b"")
    for p in range(longest):
        names = dictionary.select(F.col("id").alias("_id"), F.col("word").alias(f"_w{p}"))
        both = both.withColumn("_id", F.get("gram", F.lit(p)))
        both = (both.join(names, "_id", "left") if longest == 1 else spread_join(both, names, "_id", "gram", how="left")).drop("_id")
        word = F.col(f"_w{p}")
        whole = word if not p else F.when(word.isNull(), whole).otherwise(F.concat(whole, F.lit(b" "), word))
    return both.select("gram", "s", "t", (F.crc32(whole) % buckets).cast("int").alias("bucket"))


def gains(counted: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain: floor(1000 ln) of the buckets' smoothed shares in target and source. At most `buckets` rows."""
    rows = cut(counted.groupBy(F.col("bucket").alias("b")).agg(F.sum("s").alias("bs"), F.sum("t").alias("bt")))
    s, t = rows.agg(F.coalesce(F.sum("bs"), F.lit(0)), F.coalesce(F.sum("bt"), F.lit(0))).first()
    ratio = ((F.col("bt") + 1).cast("double") * float(s + buckets)) / ((F.col("bs") + 1).cast("double") * float(t + buckets))
    return rows.select("b", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(docs: DataFrame, target: DataFrame, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS, text: str = "text", key: str = "doc_id", target_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """rid, doc_id, n_words, n_features, weight of each document."""
    source = stored(encoded(docs, shortest, longest, text, key, block_words), "encoded")
    aim = stored(encoded(target.select(F.col(target_text).alias("text"), F.lit(0).alias("id")), shortest, longest, "text", "id", block_words), "target")
    of = lambda rows, side: rows.where("rid is null").select(F.lit(side).alias("target"), "block", "words", "grams", "totals")
    blocks = of(source, False).union(of(aim, True))
    numbers = stored(numbered_words(blocks), "dictionary")
    dictionary = numbers.where("word is not null").select("id", "word")
    found = stored(tuples(blocks, numbers), "tuples")
    counted = stored(hashed(found, dictionary, longest, buckets), "hashed")
    gain = counted.join(F.broadcast(gains(counted, buckets)), F.col("bucket") == F.col("b")).select("gram", "gain")
    back = found.where(~F.col("target")).select("block", "j", "gram").join(gain, "gram").select("block", "j", "gain")

    def run(own, known):
        import numpy as np
        import pyarrow as pa

        steps, by = own.column("at").combine_chunks(), np.zeros(known.num_rows, np.int64)
        by[known.column("j").to_numpy()] = known.column("gain").to_numpy()
        sizes = steps.value_lengths().to_numpy()
        ends = np.cumsum([0, *sizes])
        run_on = np.concatenate([[0], np.cumsum(steps.flatten().to_numpy().astype(np.int64))])
        at = run_on[1:] - np.repeat(run_on[ends[:-1]], sizes)
        each = by[at] * own.column("n").combine_chunks().flatten().to_numpy()
        sums = np.concatenate([[0], np.cumsum(each)])
        return pa.table([*(own.column(c) for c in ("rid", "doc_id", "n_words", "n_features")), pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())], names=["rid", "doc_id", "n_words", "n_features", "weight"])

    rows = source.where("rid is not null").select("block", "rid", "doc_id", "n_words", "n_features", "at", "n")
    schema = T.StructType([*(rows.schema[c] for c in ("rid", "doc_id", "n_words", "n_features")), T.StructField("weight", T.LongType())])
    return rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, schema)


def drawn(weighed: DataFrame, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """weighed with score and rank: weight and Gumbel noise by a hash of seed and id; the `percent` of documents of `least` words with the highest scores,
    ranked from 1."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32))))
    rows = stored(weighed.withColumn("score", F.col("weight") + noise), "weights")
    some = rows.where(F.col("n_words") >= least)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("rid")]
    ranges = stored(some.select("score", "doc_id", "rid").repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = sorted(map(tuple, ranges.groupBy("range").count().collect()))
    total = sum(n for _, n in sizes)
    before, at = [], 0
    for r, n in sizes:
        before.append((r, at))
        at += n
    most = percent * total // 100
    shift = rows.sparkSession.createDataFrame([x for x in before if x[1] < most], "r int, shift long")
    place = F.row_number().over(W.partitionBy("range").orderBy(*order)) + F.col("shift")
    best = ranges.join(F.broadcast(shift), F.col("range") == F.col("r"))
    best = best.select(F.col("rid").alias("k"), place.cast("long").alias("rank")).where(F.col("rank") <= most)
    return rows.join(best, F.col("rid") == F.col("k"), "left").drop("k")


def resampled(docs: DataFrame, target: DataFrame, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED, **more) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null where it isn't drawn."""
    return drawn(weights(docs, target, shortest, longest, buckets, **more), least, percent, seed).select("doc_id", "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


#: DuckDB has no crc32: its table comes from the polynomial, and a word's bytes go through it one by one.
SQL = r"""
WITH RECURSIVE bits AS (
  SELECT n, CAST(n AS UBIGINT) AS c, 0 AS k FROM range(256) t(n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY n) AS tab FROM bits WHERE k = 8), words AS (
  SELECT 0 AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 1, NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), counted AS (SELECT side, doc_id, w, count(*) AS n FROM words GROUP BY ALL),
bytes AS (SELECT w, list_transform(range(CAST(length(hex(w)) / 2 AS BIGINT)), lambda i: CAST(concat('0x', substr(hex(w), 2 * i + 1, 2)) AS UBIGINT)) AS b FROM (SELECT DISTINCT w FROM counted)),
hashed AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), b), lambda c, x: xor(c >> 8, tab[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc),
buckets AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM counted JOIN hashed USING (w) GROUP BY bucket),
totals AS (SELECT sum(s) AS ts, sum(t) AS tt FROM buckets),
gains AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST(ts + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(tt + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM buckets, totals),
weighed AS (SELECT doc_id, sum(n) AS n, sum(n * gain) AS weight FROM counted JOIN hashed USING (w) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
drawn AS (SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(CAST(concat('0x', substr(sha256(concat('2024:', CAST(d.doc_id AS VARCHAR))), 1, 8)) AS UBIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weighed USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS total FROM drawn WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (10 * total) // 100 THEN r END AS rank FROM drawn LEFT JOIN ranked USING (doc_id)
"""

QUERIES = {"op11_importance_resampling": query}
ORACLE = {"op11_importance_resampling": SQL}
