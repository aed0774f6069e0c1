"""Quality rules: line frequency across the documents of a host.

Each document's lines are normalised (A-Z lower-cased, digits as 0, runs of white space as one space, ends trimmed) and
hashed; for each (host, line) the distinct documents are counted. A line in more than `limit` of them is above the limit, however large the
host: a share of a hot host would let boilerplate of thousands of documents pass. cleaned() removes it from all of them but the
first (the smallest key), so that a passage is never lost altogether; judge() counts what goes. A document is rejected when what is
left of it has fewer than `least_words` words (with the base's least of 50 it wouldn't pass the base), or less than `least_share`
of the words that it had: it is depleted.

The hot lines never gather: counts are partial before the shuffle, and only lines above the limit go back to the
documents, in a join that adaptive execution can split. Whole texts are read; hashes of 64 bits stand for lines.

Cases: a null text has no words and fails the base; empty lines aren't counted; the null host is a host of its own;
repeated rows and copies are documents of their own, and those of the smallest key, or of the null key, which comes first, all keep their lines
(cleaned() numbers such rows and keeps the lines of one); an empty table gives an empty result; other columns pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import if_small, load, others, parts, stored, unused, with_unique_key

LIMIT, LEAST_WORDS, LEAST_SHARE = 20, 50, 0.5
#: Documents whose lines to remove may be broadcast: a key and a few hashes each.
BROADCAST_DOCS = 200_000

_word = re.compile(r"[^ \t-\r]+").findall
_symbols = str.maketrans("", "", "#*$%&|<>")
_plain = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")

BASE = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
LINES = T.StructType([T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(T.IntegerType()))])


def repeated_words(words: list[str]) -> int:
    """Words within windows of three words that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    n = covered = 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            n += i + 3 - max(i, covered)
            covered = i + 3
    return n


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """The base counts of one text."""
    text = text or ""
    words = _word(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif _word(line):
            seen.add(line)
    return len(words), sum(map(len, words)), len(text) - len(text.translate(_symbols)), dup, repeated_words(words)


def normal(words: list[str]) -> str:
    """The normalised line of these words."""
    return " ".join(words).translate(_plain)


def line_hash(line: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(line.encode()) - 2**63


def without(text: str, gone: set[int]) -> str:
    """The text without the lines of these hashes, wherever they stand in it."""
    return "\n".join(line for line in text.split("\n") if not ((words := _word(line)) and line_hash(normal(words)) in gone))


def lines_of(text: str | None) -> dict[str, int]:
    """The words of each distinct normalised line, all its occurrences counted."""
    out: dict[str, int] = {}
    for line in (text or "").split("\n"):
        if words := _word(line):
            key = normal(words)
            out[key] = out.get(key, 0) + len(words)
    return out


def measured(docs: DataFrame, text: str = "text", with_lines: bool = True) -> DataFrame:
    """docs without the text, with the base counts and, with_lines, the hashes and words of the distinct lines."""
    rest = others(docs, text, *BASE.names, *LINES.names)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in parts(batches):
            base, hashes, counts = [], [], []
            for t in batch.column(text):
                t = t.as_py()
                base.append(measure(t))
                if with_lines:
                    found = lines_of(t)
                    hashes.append([line_hash(x) for x in found])
                    counts.append(list(found.values()))
            cols = [batch.column(f.name) for f in rest] + [pa.array([b[i] for b in base], pa.int64()) for i in range(5)]
            if with_lines:
                cols += [pa.array(hashes, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in out.fields])

    out = T.StructType([*rest, *BASE.fields, *(LINES.fields if with_lines else [])])
    return docs.mapInArrow(run, out)


def above_limit(docs: DataFrame, text: str, key: str, host: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """The measured rows (rid, key, host, the base counts and lines), and rid, key, line and words of each line that is to go."""
    rows = stored(measured(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), F.col(host).alias("host"), F.col(text).alias("text"))), "quality")
    lines = rows.select("rid", "key", "host", F.explode(F.arrays_zip("hashes", "words")).alias("l")).select("rid", "key", "host", F.col("l.hashes").alias("line"), F.col("l.words").alias("words"))
    held = lines.groupBy("host", "line").agg(F.count("*").alias("n"), F.min("key").alias("first"), F.max(F.col("key").isNull()).alias("null_first")).where(F.col("n") > limit)
    above = held.select(F.col("host").alias("h"), F.col("line").alias("x"), "first", "null_first")
    gone = lines.join(above, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("x"))).where(F.when(F.col("null_first"), F.col("key").isNotNull()).otherwise(F.col("key") != F.col("first")))
    return rows, gone.select("rid", "key", "line", "words")


def verdicts(rows: DataFrame, gone: DataFrame, key: str, least_words: int, least_share: float) -> DataFrame:
    gone = gone.groupBy(F.col("rid").alias("r")).agg(F.sum("words").alias("removed"))
    out = rows.select("rid", "key", *BASE.names).join(gone, F.col("rid") == F.col("r"), "left").withColumn("removed_words", F.coalesce("removed", F.lit(0)))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < least_words) | (left < F.col("n_words") * least_share))
    return out.select("rid", F.col("key").alias(key), *BASE.names, "removed_words", "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"))


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", limit: int = LIMIT, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """Per document: rid, key, the base counts, removed_words, base_failed, kept."""
    return verdicts(*above_limit(docs, text, key, host, limit), key, least_words, least_share)


def cleaned(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", limit: int = LIMIT, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """The documents that are kept, all their columns, without the lines above the limit."""
    names = docs.columns
    docs, key = with_unique_key(docs, key)
    rows, gone = above_limit(docs, text, key, host, limit)
    own, lost = unused(docs, "_k"), unused(docs, "_gone")
    gone = stored(gone, "gone-lines")
    rejected = verdicts(rows, gone, key, least_words, least_share).where(~F.col("kept")).select(F.col(key).alias(own))
    kept = docs.join(if_small(stored(rejected, "gone")), F.col(key) == F.col(own), "left_anti")
    lines = if_small(stored(gone.groupBy(F.col("key").alias(own)).agg(F.collect_set("line").alias(lost)), "gone-sets"), BROADCAST_DOCS)
    same = kept.join(lines, F.col(key) == F.col(own), "left_anti").select(*names)
    change = kept.join(lines, F.col(key) == F.col(own)).select(*names, lost)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in parts(batches):
            old = batch.column(text)
            texts = [without(t.as_py(), set(g.as_py())) for t, g in zip(old, batch.column(lost))]
            yield pa.RecordBatch.from_arrays([pa.array(texts, old.type) if n == text else batch.column(n) for n in names], names=names)

    return same.union(change.mapInArrow(run, change.select(*names).schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "documents")).select("doc_id", *BASE.names, "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT rid, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT rid, i, w2 IS NOT NULL AND count(*) OVER (PARTITION BY rid, w, w1, w2) > 1 AS twice, w FROM g),
r AS (SELECT rid, length(w) AS chars, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS repeated FROM c WINDOW o AS (PARTITION BY rid ORDER BY i)),
words AS (SELECT rid, count(*) AS n_words, sum(chars) AS word_chars, count_if(repeated) AS n_repeat_words FROM r GROUP BY rid),
l AS (SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
ln AS (SELECT rid, doc_id, source, line, len(ws) AS n,
       translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS x FROM lw WHERE len(ws) > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln GROUP BY rid),
above AS (SELECT source, x, min(doc_id) AS first, bool_or(doc_id IS NULL) AS null_first FROM ln GROUP BY source, x HAVING count(DISTINCT rid) > 20),
gone AS (SELECT rid, sum(ln.n) AS removed FROM ln JOIN above a ON ln.source IS NOT DISTINCT FROM a.source AND ln.x = a.x
         WHERE CASE WHEN a.null_first THEN doc_id IS NOT NULL ELSE doc_id <> first END GROUP BY rid),
o AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
       length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
       coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed, 0) AS removed
      FROM d LEFT JOIN words USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM o)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (removed > 0 AND (n_words - removed < 50 OR n_words - removed < n_words * 0.5)) AS kept
FROM b
"""

QUERIES = {"op5_quality_rules": query}
ORACLE = {"op5_quality_rules": SQL}
