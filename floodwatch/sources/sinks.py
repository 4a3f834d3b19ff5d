"""Ledger tables on disk: appends, upserts by key, archive moves, command outbox.

Every write is named by a batch id, so a batch that is run again after a failure
replaces its own files and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodwatch.operators.ledger import latest_state, split_archive


def append_table(df: DataFrame, path: str, batch_id: int | str, *, ts: str = "timestamp") -> None:
    """Append partitioned by batch and day; readers prune by day."""
    (df.withColumn("day", F.date_format(ts, "yyyy-MM-dd")).write.mode("overwrite")
       .partitionBy("day").parquet(f"{path.rstrip('/')}/batch={batch_id}"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """All batches of a table; columns added later are filled with nulls in older ones."""
    return spark.read.option("basePath", path).option("mergeSchema", "true").parquet(f"{path.rstrip('/')}/batch=*")


def upsert_table(changes: DataFrame, path: str, version: int, *, order: list[str], deleted: str | None = None) -> DataFrame:
    """Merge changes into version ``version - 1`` of a keyed table and write ``version``.

    Tombstones stay in the table until read through :func:`live_rows`, so a late
    older write cannot bring a deleted key back.
    """
    spark = changes.sparkSession
    merged = changes
    if version > 0:
        merged = spark.read.parquet(f"{path.rstrip('/')}/v={version - 1}").unionByName(changes, allowMissingColumns=True)
    out = f"{path.rstrip('/')}/v={version}"
    latest_state(merged, order=order).write.mode("overwrite").parquet(out)
    result = spark.read.parquet(out)
    return result.filter(~F.col(deleted)).drop(deleted) if deleted else result


def archive_table(events: DataFrame, hot_path: str, archive_path: str, cutoff: Column, batch_id: int | str) -> None:
    """Move rows before the cutoff to the archive.

    The archive part is written first and the hot part of this batch second;
    running the batch again gives the same two tables.
    """
    hot, old = split_archive(events, cutoff)
    append_table(old, archive_path, batch_id)
    append_table(hot, hot_path, batch_id)
