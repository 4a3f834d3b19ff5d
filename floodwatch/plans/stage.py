"""Stage boundaries: write an expensive intermediate once, read it back pruned."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. On one machine, where none is named, one under /tmp/checkpoints."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return "file:///tmp/checkpoints"
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/floodwatch-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from it.

    Scans such as :func:`floodwatch.plans.slices.prefix` read their input twice,
    so a chain of them over a costly input repeats it. A written table also
    survives lost executors and keeps column pruning, which a cached or
    checkpointed RDD does not. :func:`drop_staged` removes the tables.
    """
    path = f"{_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Remove the tables this application has staged, once the results that read them are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
