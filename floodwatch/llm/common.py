"""What the text operators share: staged tables, bounded batches, string buffers and hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodwatch.plans.stage import shared_dir

#: Text bytes that one piece of work in a Python worker covers.
PIECE_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the table: it is computed once and outlives executors."""
    path = f"{staged_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one; ``floodwatch.plans.stage.drop_staged`` removes it."""
    return f"{shared_dir(spark)}/floodwatch-{spark.sparkContext.applicationId}"


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of these names renamed, and the new names with the old ones, for :func:`put_back`."""
    back = {}
    for c in docs.columns:
        if c.lower() in names:
            back[free_name(docs, f"_own{c}")] = c
            docs = docs.withColumnRenamed(c, free_name(docs, f"_own{c}"))
    return docs, back


def put_back(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.withColumnsRenamed(names) if names else docs


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send fewer rows at once to Python: texts are long, and a batch is held several times over on its way."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_bytes(df: DataFrame, text: str) -> int:
    return df.agg(F.sum(F.octet_length(F.col(text).cast("string"))).alias("n")).first()["n"] or 0


def bucketed(df: DataFrame, keys: list[str | Column], buckets: int, name: str) -> DataFrame:
    """Add an int column that deals rows to ``buckets`` parts by the hash of ``keys``."""
    return df.withColumn(name, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of text, or one row; empty batches go."""
    for batch in batches:
        yield from split_batch(batch, text, limit)


def split_batch(batch, text: str, limit: int = PIECE_BYTES) -> Iterator:
    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(lengths(batch.column(text)))
    start = 0
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def lengths(column) -> np.ndarray:
    import pyarrow.compute as pc
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def buffer_of(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, nulls as empty, and the rows' offsets into them (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        import pyarrow.compute as pc
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0]


def with_columns(batch: pa.RecordBatch, extra: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *extra.values()], names=[*batch.schema.names, *extra])


def schema_with(df: DataFrame, extra: str) -> str:
    """DDL of ``df`` plus columns, for the Arrow operators."""
    return ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema), extra])


def mix(a: np.ndarray) -> np.ndarray:
    """Finalise 64-bit words so that every bit depends on all (the 64-bit finaliser of MurmurHash3)."""
    a = a ^ (a >> np.uint64(33))
    a = a * np.uint64(0xFF51AFD7ED558CCD)
    a = a ^ (a >> np.uint64(33))
    a = a * np.uint64(0xC4CEB9FE1A85EC53)
    return a ^ (a >> np.uint64(33))


def ranges_of(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[k], starts[k]+1, .. (counts[k] of them), for all k one after another."""
    if not len(counts) or not counts.sum():
        return np.empty(0, np.int64)
    counts = counts.astype(np.int64)
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts.astype(np.int64), counts)
