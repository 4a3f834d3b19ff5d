"""Offence history: half-life reputation, bans, priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodwatch import config as C
from floodwatch.operators.features import lookup
from floodwatch.plans.slices import micros, null_safe_join, prefix


def _decay(elapsed_us: Column, half_life_s: float) -> Column:
    return F.pow(F.lit(0.5), elapsed_us / F.lit(half_life_s * 1e6))


def capped(score: Column) -> Column:
    return F.least(F.round(score, 4), F.lit(C.REPUTATION_CAP))


def reputation(history: DataFrame, now: Column, half_life_s: float = C.HALF_LIFE_S) -> DataFrame:
    """Decayed offence score per source at ``now``; one map-side combined sum."""
    weight = F.lit(C.OFFENCE_WEIGHT) * _decay(micros(now) - micros("unblocked_at"), half_life_s)
    return history.groupBy("src_ip").agg(capped(F.sum(weight)).alias("reputation"))


#: Half-lives in one block of time: two to this power, times any number of offences, is far inside a double's range.
BLOCK = 500


def _running_weight(rows: DataFrame, is_offence: Column, half_life_s: float, slice_s: float) -> DataFrame:
    """Add ``_weight``: decayed offences of the source up to each row, ties included.

    An offence counts 2 ** (time since the block's start in half-lives), so a plain
    running sum, decayed by the row's own time, is the decayed sum: a scan over
    slices of any length. Blocks of 500 half-lives keep the exponents small. A block takes over
    what the block before left; what lies further back is below 2 ** -500 of
    an offence, which no result of four decimals can show.
    """
    half_us = half_life_s * 1e6
    rows = rows.withColumn("_us", micros("_ts")).withColumn("_block", F.floor(F.col("_us") / F.lit(half_us * BLOCK)).cast("long"))
    age = (F.col("_us") - F.col("_block") * F.lit(half_us * BLOCK)) / F.lit(half_us)
    scaled = F.when(is_offence, C.OFFENCE_WEIGHT * F.pow(F.lit(2.0), age)).otherwise(0.0)
    before = Window.partitionBy("src_ip").orderBy("_block")
    left = (rows.withColumn("_scaled", scaled).groupBy("src_ip", "_block").agg(F.sum("_scaled").alias("_sum"))
            .withColumn("_gap", (F.col("_block") - F.lag("_block").over(before)) * F.lit(float(BLOCK)))
            .select("src_ip", "_block", F.coalesce(F.lag("_sum").over(before) * F.pow(F.lit(0.5), F.col("_gap")), F.lit(0.0)).alias("_came")))
    out = prefix(rows, ["src_ip", "_block"], ["_us"], ts="_ts", width_s=slice_s, sums={"_inside": scaled}, ties=True)
    return (null_safe_join(out, left, ["src_ip", "_block"])
            .withColumn("_weight", (F.col("_inside") + F.col("_came")) * F.pow(F.lit(0.5), age)).drop("_inside", "_came", "_block"))


def attach_reputation(rows: DataFrame, history: DataFrame, *, ts: str = "ts",
                      half_life_s: float = C.HALF_LIFE_S, slice_s: float = 86_400.0) -> DataFrame:
    """Reputation of each row's source from its offences at or before the row.

    Offences and rows are united and scanned, never paired, so the work is
    linear in both even for one source with many of each.
    """
    left = rows.withColumn("_ts", F.col(ts)).withColumn("_side", F.lit(1))
    right = history.select("src_ip", F.col("unblocked_at").alias("_ts"), F.lit(0).alias("_side"))
    both = left.unionByName(right, allowMissingColumns=True)
    out = _running_weight(both, F.col("_side") == 0, half_life_s, slice_s)
    return (out.filter("_side = 1").withColumn("reputation", capped(F.col("_weight")))
            .select(*rows.columns, "reputation"))


def running_reputation(history: DataFrame, *, half_life_s: float = C.HALF_LIFE_S,
                       slice_s: float = 86_400.0) -> DataFrame:
    """Reputation right after each offence (offences at the same time included)."""
    rows = history.withColumn("_ts", F.col("unblocked_at"))
    out = _running_weight(rows, F.lit(True), half_life_s, slice_s)
    return out.withColumn("reputation", capped(F.col("_weight"))).select(*history.columns, "reputation")


def prior_ban(history: DataFrame) -> DataFrame:
    """Latest ban level and offence count, and the highest ban level, per source."""
    return history.groupBy("src_ip").agg(
        F.max_by("ban_level", "id").alias("last_ban_level"),
        F.max_by("offence_count", "id").alias("last_offence_count"),
        F.max("ban_level").alias("max_ban_level"))


def offence_totals(history: DataFrame) -> DataFrame:
    return history.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("offences"), F.max("ban_level").alias("max_ban_level"),
        F.lit(True).alias("known_offender"))


def priority_score(*, score: Column, confidence: Column, attack_class: Column, pps: Column,
                   reputation: Column) -> Column:
    severity = lookup(attack_class, C.VECTOR_SEVERITY, F.lit(C.DEFAULT_SEVERITY))
    volume = F.when(pps > 10, F.least(F.lit(0.15), F.log10(pps / 10) * 0.05)).otherwise(0.0)
    standing = F.least(F.lit(0.2), reputation * 0.02)
    return F.least(F.lit(1.0), score * confidence + (severity - 0.5) * 0.5 + volume + standing)


def priority_tier(composite: Column) -> Column:
    tier = None
    for name, bound in C.PRIORITY_TIERS:
        tier = F.when(composite >= bound, name) if tier is None else tier.when(composite >= bound, name)
    return tier.otherwise("Low")


def with_priority(df: DataFrame) -> DataFrame:
    """Add ``priority_score`` and ``priority`` from score, confidence, class, pps, reputation."""
    composite = priority_score(score=F.col("if_score"), confidence=F.col("confidence"),
                               attack_class=F.col("attack_class"), pps=F.col("pps"),
                               reputation=F.coalesce(F.col("reputation"), F.lit(0.0)))
    return (df.withColumn("priority_score", composite)
            .withColumn("priority", priority_tier(F.col("priority_score"))))


def entropy_fast_track(priority: Column, attack: Column, confidence: Column) -> Column:
    """Raise a logged Low or Medium priority when the traffic verdict is a sure attack."""
    return F.when(attack & (confidence == "high") & priority.isin("Low", "Medium"), "High").otherwise(priority)
