"""Keyed Parquet tables: what is new is appended, what is there stays; exports as CSV.

A table is a folder of Parquet files, partitioned by a column of few values if named. Keys are compared by a join, so a table of any size is written by as many
tasks as there is new data for; nothing passes the driver.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .ingest import insert_or_ignore


def read_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at path; empty, with the columns of `like`, where there is none yet."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException:
        return like.limit(0)


def append_new(path: str, rows: DataFrame, key: list[str], partition: str | None = None) -> None:
    """Appends the rows whose key isn't in the table yet, one for each key. Appending the same rows again adds none."""
    fresh = insert_or_ignore(read_table(rows.sparkSession, path, rows), rows, key)
    writer = fresh.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def save_snapshot(folder: str, snapshots: DataFrame, parts: DataFrame, key: str, part_key: list[str]) -> None:
    """Snapshots (one row for each key) and their parts, in two tables; the parts of snapshots that are there already are left out, so a snapshot is
    never half old and half new. Parts go first, by their own key: a run that is broken off can be run again, and no snapshot counts before its parts are there."""
    known = read_table(snapshots.sparkSession, f"{folder}/snapshots", snapshots).select(key).distinct()
    new = snapshots.dropDuplicates([key]).join(known, key, "left_anti")
    append_new(f"{folder}/parts", parts.join(new.select(key), key, "left_semi"), part_key)
    append_new(f"{folder}/snapshots", new, [key])


def export_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """Rows as CSV with a header, sorted by ranges, so the files of the folder are in order."""
    rows.orderBy(*order).write.mode("errorifexists").option("header", True).csv(path)
