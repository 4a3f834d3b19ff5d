"""Entropy and exact-median building blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodwatch.plans.stage import cut


def entropy_of(weights: Column) -> Column:
    """Shannon entropy in bits of an array of weights; non-positive weights add nothing."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    terms = F.aggregate(weights, F.lit(0.0), lambda a, w: a + F.when(
        (w > 0) & (total != 0), -(w / total) * F.log2(w / total)).otherwise(0.0))
    return F.when(total == 0, 0.0).otherwise(terms)


def shannon_entropy(df: DataFrame, keys: Sequence[str], category: str, weight: Column | None = None) -> DataFrame:
    """Entropy of ``category`` per key, closed form log2(T) - sum(w log2 w) / T.

    Two aggregates with map-side combine; the second sees one row per category.
    """
    w = weight if weight is not None else F.lit(1.0)
    parts = df.groupBy(*keys, category).agg(F.sum(w).cast("double").alias("_w"))
    positive = F.when(F.col("_w") > 0, F.col("_w") * F.log2("_w"))
    total = F.sum("_w")
    return parts.groupBy(*keys).agg(
        F.when(total > 0, F.log2(total) - F.coalesce(F.sum(positive), F.lit(0.0)) / total)
         .otherwise(0.0).alias("entropy"))


def binned_medians(df: DataFrame, keys: Sequence[str], values: Sequence[str], bin_width: float = 1 / 1024, written: bool = True) -> DataFrame:
    """Exact medians per key without gathering a key's values in one task.

    Values are counted per narrow bin first (map-side combined). A window over
    the bins, whose number depends on the value range and not on the rows, finds
    the bins holding the middle ranks; only distinct values of those bins are
    then counted and ranked. The middle bins, at most two per key and value, are
    written as a table: where it is small, Spark sends it to the rows, which are not shuffled.
    The table is written when the query is built; with ``written`` false nothing runs before the result is read.
    """
    keys = list(keys)
    long = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("_m"), F.col(v).alias("_x")) for i, v in enumerate(values)])))
    long = long.withColumn("_bin", F.floor(F.col("_x") / F.lit(bin_width)))
    group = [*keys, "_m"]
    bins = long.groupBy(*group, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    everything = Window.partitionBy(*group)
    upto = everything.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (bins.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(everything))
              .withColumn("_r1", F.floor((F.col("_all") - 1) / 2)).withColumn("_r2", F.floor(F.col("_all") / 2))
              .withColumn("_before", F.col("_upto") - F.col("_n")))
    holds = ((F.col("_r1") >= F.col("_before")) & (F.col("_r1") < F.col("_upto"))
             | (F.col("_r2") >= F.col("_before")) & (F.col("_r2") < F.col("_upto")))
    middle = ranked.filter(holds).select(*group, "_bin", "_before", "_r1", "_r2")
    middle = cut(middle, "middle_bins") if written else middle
    inside = (long.join(middle, [*group, "_bin"])
              .groupBy(*group, "_bin", "_before", "_r1", "_r2", "_x").agg(F.count(F.lit(1)).alias("_k")))
    order = Window.partitionBy(*group, "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    pos = inside.withColumn("_to", F.col("_before") + F.sum("_k").over(order)) \
                .withColumn("_from", F.col("_to") - F.col("_k"))
    at = lambda r: F.max(F.when((F.col(r) >= F.col("_from")) & (F.col(r) < F.col("_to")), F.col("_x")))
    med = pos.groupBy(*group).agg(((at("_r1") + at("_r2")) / 2).alias("_med"))
    return med.groupBy(*keys).agg(*[F.max(F.when(F.col("_m") == i, F.col("_med"))).alias(f"med_{v}") for i, v in enumerate(values)])


def exact_medians(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Exact medians with the built-in aggregate, for groups of modest size."""
    return df.groupBy(*keys).agg(*[F.percentile(v, F.lit(0.5)).alias(f"med_{v}") for v in values])
