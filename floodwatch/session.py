"""Session settings every job of this package relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "floodwatch", master: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or get) a session; the cluster's own settings win over ours."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **(extra or {}),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_settings(spark: SparkSession) -> SparkSession:
    """Pin the one runtime setting results depend on: times are UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Shared folder for lineage cuts and streaming state.

    The cluster names it in ``spark.checkpoint.dir``. A fallback is accepted
    only where that is unset, as in tests on one machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    path = path or fallback or os.environ.get("FLOODWATCH_TEST_CHECKPOINT")
    if not path:
        raise ValueError("spark.checkpoint.dir is not set and no fallback was given")
    return path
