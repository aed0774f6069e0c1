"""Mixing sources to target weights by a low-discrepancy schedule.

Targets. Sources, by code point with null last, weigh 1, 2, 3, 1, 2, 3, ...; they share all words by weight, none above
`most` times its own words; the excess is shared again by weight until none is above. That end is found in one step: with
sources by cap/weight, those at the front are held at their caps for as long as the cap is at most their share of what
the earlier ones leave.

Schedule. A source's documents, shuffled by hash, form a stream of words that is cut into blocks of `block` words, the
last one shorter; a target of several times the source is several passes over them. Each of n slots in total owns an
equal share of [0, 1), source after source in proportion to their slots. The van der Corput points 0 .. N-1 in base 2
(N a power of two, 2n at least) are mapped through these cumulative weights: the point whose reversed bits fall in a
source's interval is a slot of that source at that time. Any dyadic cell holds one point, so each source surely gets all
the slots that it needs, and any stretch of the schedule holds the sources near their weights. Slots are ranked within
their source and the rank picks pass and block; ranks beyond what the source needs are left out.

Everything is integer arithmetic and SQL expressions: reruns agree. Ranks and running sums are taken in buckets within a
source (prefix_sums), so a hot source is dealt over many tasks. One row per source is all that meets in one task.

Cases: null texts and texts without a word have size 0 and are never taken; the null source is a source of its own;
repeated rows are rows of their own; a null doc_id is allowed; documents of the same place in the shuffle go by size, then by row; a very long
text is several blocks, each taken at its own time; an empty table gives an empty result; other columns are not read, and in_order()
passes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, if_small, load, prefix_sums, stored, unused

BLOCK = 4096
MOST = 3
#: Rows of a source's stream, and points of the schedule, that are ranked together.
RUN, STRETCH = 1024, 8192


def sizes(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """rid, doc_id, source, size, h: the words of each document and its place in the shuffle."""
    return docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(key).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("h"),
    )


def targets(sized: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """One row per source: source, n_docs, source_size, weight, target, words (target as an integer), blocks, slots."""
    by = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1).withColumn("cap", F.col("source_size") * most)
    # by cap/weight; ties need no order: they are held or not together
    first = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_rows = first.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    by = by.withColumn("left", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    by = by.withColumn("left_weight", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # the first that isn't held fixes the level for all after it
    by = by.withColumn("free", F.col("cap") * F.col("left_weight") > F.col("left") * F.col("weight"))
    now = first.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = [F.first(F.when(F.col("free"), F.col(c)), ignorenulls=True).over(now) for c in ("left", "left_weight")]
    by = by.withColumns({"level": level[0], "level_weight": level[1], "is_free": F.max("free").over(first.rowsBetween(W.unboundedPreceding, 0))})
    by = by.withColumn("target", F.when(F.col("is_free"), F.col("level") * F.col("weight") / F.col("level_weight")).otherwise(F.col("cap").cast("double")))
    by = by.withColumn("words", F.least(F.floor(F.col("target") + 0.5), F.col("cap")))
    by = by.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    by = by.withColumn("slots", F.expr(f"if(source_size = 0, 0L, words div source_size * blocks + (words % source_size + {block - 1}) div {block})"))
    by = by.withColumn("first_slot", F.coalesce(F.sum("slots").over(W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return by.select("source", "n_docs", "source_size", "weight", "target", "words", "blocks", "slots", "first_slot")


def schedule(by: DataFrame, block: int = BLOCK) -> DataFrame:
    """source, at (the time), rank, pass, block, words: the slots of the mix, in the order of `at`.

    by: targets(), whose one row per source is read once to learn n, the number of slots.
    """
    n = by.agg(F.sum("slots")).first()[0] or 0
    bits = max(1, (2 * n - 1).bit_length())
    points = 1 << bits
    # a source's cells of [0, N), in stretches that any task can take
    cells = by.where("slots > 0").selectExpr("source", "source_size", "words as all_words", "blocks", "slots", f"cast(ceil(cast(first_slot as decimal(38,0)) * {points} / {max(n, 1)}) as bigint) as lo", f"cast(ceil(cast(first_slot + slots as decimal(38,0)) * {points} / {max(n, 1)}) as bigint) as hi")
    cells = cells.withColumn("s", F.explode(F.expr(f"sequence(lo div {STRETCH}, (hi - 1) div {STRETCH})"))).repartition("source", "s")
    cells = cells.withColumn("v", F.explode(F.expr(f"sequence(greatest(lo, s * {STRETCH}), least(hi, (s + 1) * {STRETCH}) - 1)")))
    slots = cells.withColumn("at", F.conv(F.reverse(F.lpad(F.bin("v"), bits, "0")), 2, 10).cast("long"))
    slots = slots.withColumn("stretch", F.expr(f"at div {STRETCH}")).withColumn("one", F.lit(1))
    slots = prefix_sums(slots, ["source"], "stretch", [F.col("at")], "one", "rank").where("rank < slots")
    slots = slots.withColumn("pass", F.expr("rank div blocks")).withColumn("block", F.expr("rank % blocks"))
    # a pass ends with the source or, the last one, with the target
    end = F.least(F.col("source_size"), F.col("all_words") - F.col("pass") * F.col("source_size"))
    return slots.select("source", "at", "rank", "pass", "block", F.least(F.lit(block), end - F.col("block") * block).alias("words"))


def pieces(sized: DataFrame, by: DataFrame, block: int = BLOCK) -> DataFrame:
    """sized with source_size, target and a row for each block that a document has words in: block, lo and hi, the words'
    places in the block. A document of size 0 has one empty piece."""
    known = by.select(F.col("source").alias("s"), "n_docs", "source_size", "target")
    # one row per source: a hot source's rows are split by adaptive execution
    docs = sized.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    place = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    docs = docs.withColumn("run", F.shiftright(place * F.expr(f"(n_docs + {RUN - 1}) div {RUN}"), 32))
    docs = prefix_sums(docs, ["source"], "run", [F.col("h"), F.col("size"), F.col("rid")], "size", "start")
    cuts = docs.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, greatest(start, start + size - 1) div {block})")))
    return cuts.withColumn("lo", F.expr(f"greatest(start - block * {block}, 0)")).withColumn("hi", F.expr(f"least(start + size - block * {block}, {block})"))


def taken_pieces(docs: DataFrame, block: int, most: int, text: str, key: str, source: str) -> DataFrame:
    """pieces() with a row for each slot that takes words of one: pass, at, got (the words); null where no slot does."""
    sized = cut(sizes(docs, text, key, source))
    by = cut(targets(sized, block, most))
    cuts, slots = pieces(sized, by, block), schedule(by, block).select(F.col("source").alias("s"), F.col("block").alias("b"), "pass", "at", "words")
    found = cuts.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    got = F.greatest(F.lit(0), F.least(F.col("hi"), F.col("words")) - F.col("lo"))
    return found.withColumn("got", F.when(F.col("words").isNotNull(), F.nullif(got, F.lit(0))))


def mix(docs: DataFrame, block: int = BLOCK, most: int = MOST, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """Per document: rid, doc_id, source, size, source_size, target, taken (words that the mix takes, repeats counted), slots (that take some of
    them) and first_at (the time of the first of these; null if none)."""
    found = taken_pieces(docs, block, most, text, key, source).groupBy("rid", "doc_id", "source", "size", "source_size", "target")
    first = F.min(F.when(F.col("got").isNotNull(), F.col("at")))
    return found.agg(F.coalesce(F.sum("got"), F.lit(0)).cast("long").alias("taken"), F.count("got").alias("slots"), first.alias("first_at"))


def in_order(docs: DataFrame, block: int = BLOCK, most: int = MOST, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The documents as the mix takes them: one row for each pass over its source that takes a document's words, in the order of the slots. A
    document that a slot cuts comes whole, at the first of its slots. key tells the rows of docs apart.

    The rows are sorted by ranges of the time, so that what is written or read in order holds the sources near their weights at any length."""
    found = taken_pieces(docs, block, most, text, key, source).where("got is not null")
    times = found.groupBy("doc_id", "pass").agg(F.min(F.struct("at", "lo")).alias("place"))
    own, at = unused(docs, "_of"), unused(docs, "_at")
    times = stored(times.select(F.col("doc_id").alias(own), F.col("place").alias(at)), "times")
    return docs.join(if_small(times), F.col(key) == F.col(own)).orderBy(at, key).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "slots", "first_at")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS cap,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest_weight
  FROM s WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lev AS (
  SELECT rest, rest_weight FROM o WHERE cap * rest_weight > rest * weight ORDER BY cap / weight, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size,
         CASE WHEN l.rest IS NOT NULL AND o.cap * l.rest_weight > l.rest * o.weight
              THEN CAST(l.rest * o.weight AS DOUBLE) / CAST(l.rest_weight AS DOUBLE) ELSE CAST(cap AS DOUBLE) END AS target, cap
  FROM o LEFT JOIN lev l ON true
), p AS (
  SELECT d.*, t.source_size, t.target, least(CAST(floor(t.target + 0.5) AS BIGINT), t.cap) AS words,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), b AS (
  SELECT DISTINCT source, source_size, words, (source_size + 4095) // 4096 AS blocks,
         CASE WHEN source_size = 0 THEN 0 ELSE words // source_size * ((source_size + 4095) // 4096) + (words % source_size + 4095) // 4096 END AS slots FROM p
), c AS (
  SELECT *, coalesce(sum(slots) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_slot, sum(slots) OVER () AS n,
         greatest(1, length(bin(CAST(greatest(2 * sum(slots) OVER () - 1, 0) AS BIGINT)))) AS bits FROM b
), v AS (
  SELECT *, unnest(range(CAST((first_slot * (1::BIGINT << bits) + n - 1) // n AS BIGINT), CAST(((first_slot + slots) * (1::BIGINT << bits) + n - 1) // n AS BIGINT))) AS v FROM c WHERE slots > 0
), timed AS (
  SELECT *, list_sum(list_transform(range(bits), lambda i: ((v >> i) & 1) << (bits - 1 - i))) AS tm FROM v
), rk AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY tm) - 1 AS rank FROM timed
), sl AS (
  SELECT source, tm, rank % blocks AS block, least(4096, least(source_size, words - rank // blocks * source_size) - rank % blocks * 4096) AS words FROM rk WHERE rank < slots
), pc AS (
  SELECT p.*, unnest(range(start // 4096, greatest(start, start + size - 1) // 4096 + 1)) AS block FROM p
), g AS (
  SELECT pc.doc_id, pc.h, pc.size, pc.source_size, pc.target, pc.source, sl.tm,
         CASE WHEN sl.words IS NOT NULL THEN greatest(0, least(start + size - pc.block * 4096, 4096, sl.words) - greatest(start - pc.block * 4096, 0)) END AS got
  FROM pc LEFT JOIN sl ON pc.source IS NOT DISTINCT FROM sl.source AND pc.block = sl.block
)
SELECT doc_id, size, source_size, target, CAST(coalesce(sum(got), 0) AS BIGINT) AS taken, count(*) FILTER (got > 0) AS slots, CAST(min(tm) FILTER (got > 0) AS BIGINT) AS first_at
FROM g GROUP BY doc_id, size, source_size, target
"""

QUERIES = {"op1_mix_sources": query}
ORACLE = {"op1_mix_sources": SQL}
