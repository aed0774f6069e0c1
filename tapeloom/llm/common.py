"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one with a local master, and an error on a cluster, whose machines
    don't share a local folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tapeloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: columnar and compressed, for the larger ones."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tapeloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that may be broadcast where a row is a key and a number: some 24 MB.
BROADCAST_ROWS = 1_000_000


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it is known to have few rows; otherwise joins with it shuffle both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bytes, written out as JSON, that may be broadcast.
BROADCAST_BYTES = 32 << 20


def if_light(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if its rows have few bytes written out as JSON, whatever they hold; else df itself. df should be stored: it is read to be measured."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


#: Rows of one key from which on spread_join() deals them.
HOT_ROWS = 256


def spread_join(many: DataFrame, one: DataFrame, key: str, by: str, hot: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """many joined with one on key, of which one has a row for each value at most and many may have any number: the rows of a value with n of
    them are dealt by the column `by` over n / HOT_ROWS tasks, which its row in one is copied to.

    hot: key and the number of rows, for the values with HOT_ROWS or more; counted if not given. There are at most as many as rows / HOT_ROWS."""
    if hot is None:
        hot = cut(many.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") >= HOT_ROWS))
    hot = if_small(hot.select(F.col(key).alias("_hot"), F.expr(f"cast(1 + rows div {HOT_ROWS} as int)").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    left = many.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.pmod(F.xxhash64(by), F.when(F.col(key).isNull(), HOT_ROWS).otherwise(salts)).cast("int")).drop("_hot", "_salts")
    right = one.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_hot", "_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def with_unique_key(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, str]:
    """docs and a column that tells its rows apart: the key, or where that is null or repeated, a row number of a stored
    copy of docs."""
    if docs.where(F.col(key).isNull()).isEmpty() and docs.groupBy(key).count().where("count > 1").isEmpty():
        return docs, key
    return stored(docs.withColumn("_row", F.monotonically_increasing_id()), "rows"), "_row"


def small_batches(spark: SparkSession) -> None:
    """For sessions that send texts to Python: where the session has Spark's usual 10000 rows to an Arrow batch, 500 are set, as texts are long.
    The registered queries and the pipeline call it; operators leave the session as it is."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000" and not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, "500")


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def others(df: DataFrame, *names: str) -> list:
    """The fields of df but for those of these names, which an operator reads or makes anew."""
    return [f for f in df.schema.fields if f.name.lower() not in {n.lower() for n in names}]


def parts(batches: Iterator, rows: int = 300) -> Iterator:
    """Arrow batches in smaller slices: what Python makes of one is short-lived and bounds a worker's memory. After the last one what Arrow
    has kept for more is given back, since idle workers stay."""
    import pyarrow as pa

    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
    pa.default_memory_pool().release_unused()


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def prefix_sums(df: DataFrame, key: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """df with out: the sum of value over the rows of the same key that come before, by bucket and then by order.

    The running sum is taken within (key, bucket) and shifted by the totals of the buckets before, so that a key with
    a third of all rows is still dealt over many tasks: no task holds more than one bucket, or one row per bucket.
    """
    from pyspark.sql import Window as W

    totals = df.groupBy(*key, bucket).agg(F.sum(value).alias("_t"))
    before = W.partitionBy(*key).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col(bucket).alias("_b"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy(*key, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("_w", F.coalesce(F.sum(value).over(within), F.lit(0)))
    on = F.col(bucket) == F.col("_b")
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(totals, on).withColumn(out, F.col("_w") + F.col("_before")).drop("_w", "_b", "_before", *(f"_k{i}" for i in range(len(key))))
