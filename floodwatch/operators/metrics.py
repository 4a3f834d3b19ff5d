"""Counters and quality metrics: traffic summary, confusion, accuracy, latency, load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodwatch.operators.fusion import TRUE_TYPES
from floodwatch.plans.slices import micros

PAIRS = [(a.lower(), b.lower()) for a in TRUE_TYPES for b in TRUE_TYPES if a != b]

# The thirty-six counters of a summary row.
COUNTERS = (
    "total", "threats", "true_neg", "fp", "tp", "tn", "fn",
    "if_tp", "if_fp", "if_tn", "if_fn", "rf_tp", "rf_fp", "rf_tn", "rf_fn",
    "rf_tp_syn", "rf_fp_syn", "rf_tn_syn", "rf_fn_syn",
    "rf_tp_icmp", "rf_fp_icmp", "rf_tn_icmp", "rf_fn_icmp",
    "rf_tp_udp", "rf_fp_udp", "rf_tn_udp", "rf_fn_udp",
    "rf_syn_as_icmp", "rf_syn_as_udp", "rf_icmp_as_syn", "rf_icmp_as_udp",
    "rf_udp_as_syn", "rf_udp_as_icmp", "held", "rescored", "expired_unscored",
)


def window_start(ts: str, width_s: float, ntz: bool = True) -> Column:
    us = int(round(width_s * 1e6))
    start = F.timestamp_micros(F.floor(micros(ts) / F.lit(float(us))).cast("long") * us)
    return start.cast("timestamp_ntz") if ntz else start


HOLD_COUNTERS = ("held", "rescored", "expired_unscored")


def traffic_summary(decisions: DataFrame, *, ts: str = "ts", width_s: float = 5.0, holds: DataFrame | None = None) -> DataFrame:
    """Sums of the counters per flush window; windows of zeros are not written.

    ``holds`` are outcomes of held sources (``ts`` and the counters held, rescored and expired_unscored), as
    :func:`floodwatch.operators.lifecycle.hold_outcomes` gives them; they fall into the windows of their own time.
    """
    have = set(decisions.columns)
    ntz = dict(decisions.dtypes)[ts] == "timestamp_ntz"
    if holds is not None:
        outcomes = holds.select(F.col("ts").cast(dict(decisions.dtypes)[ts]).alias(ts), *HOLD_COUNTERS)
        decisions = decisions.select(ts, *[c for c in COUNTERS if c in have and c not in HOLD_COUNTERS]).unionByName(outcomes, allowMissingColumns=True)
        have |= set(HOLD_COUNTERS)
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) if c in have else F.lit(0).cast("long").alias(c) for c in COUNTERS]
    out = decisions.groupBy(window_start(ts, width_s, ntz).alias("timestamp")).agg(*sums)
    any_count = F.greatest(*[F.col(c) for c in COUNTERS])
    return out.filter(any_count > 0)


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1.0))


def metric_columns(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall, F1, accuracy and rates in percent, to two places."""
    p, r = _share(tp, tp + fp), _share(tp, tp + fn)
    values = {
        "precision": p, "recall": r, "f1": 2 * p * r / F.greatest(p + r, F.lit(1e-9)),
        "accuracy": _share(tp + tn, tp + fp + tn + fn), "fpr": _share(fp, fp + tn),
        "fnr": _share(fn, fn + tp), "tpr": r, "tnr": _share(tn, tn + fp),
    }
    return {n: F.round(v * 100, 2) for n, v in values.items()}


def in_days(rows: DataFrame, start: str, end: str, ts: str = "timestamp") -> DataFrame:
    """Rows from the start day to the end day inclusive; a range filter that reaches the scan."""
    return rows.filter((F.col(ts) >= F.lit(f"{start} 00:00:00").cast("timestamp_ntz"))
                       & (F.col(ts) <= F.lit(f"{end} 23:59:59").cast("timestamp_ntz")))


def binary_metrics(summary: DataFrame, family: str = "if_") -> DataFrame:
    """Metrics over summary rows; families: "" (overall, false positives as ``fp``) or "if_"."""
    names = ("tp", "fp", "tn", "fn")
    sums = summary.agg(*[F.coalesce(F.sum(family + n), F.lit(0)).cast("double").alias(n) for n in names])
    cols = metric_columns(*[F.col(n) for n in names])
    return sums.select(*[F.col(n).cast("long").alias(n) for n in names], *[c.alias(n) for n, c in cols.items()])


def class_metrics(summary: DataFrame) -> DataFrame:
    """Metrics of each class, one row per class, from one pass over the counters."""
    names = ("tp", "fp", "tn", "fn")
    types = [t.lower() for t in TRUE_TYPES]
    one = summary.agg(*[F.coalesce(F.sum(f"rf_{n}_{t}"), F.lit(0)).cast("double").alias(f"{n}_{t}")
                        for t in types for n in names])
    per = one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("attack_type"), *[F.col(f"{n}_{t}").alias(n) for n in names])
                                         for t in types])).alias("r")).select("r.*")
    cols = metric_columns(*[F.col(n) for n in names])
    return per.select("attack_type", *[F.col(n).cast("long").alias(n) for n in names], *[c.alias(n) for n, c in cols.items()])


def confusion_3x3(summary: DataFrame) -> DataFrame:
    """The nine cells plus the micro average over classified rows."""
    cells = {f"{t.lower()}_as_{t.lower()}": f"rf_tp_{t.lower()}" for t in TRUE_TYPES}
    cells |= {f"{a}_as_{b}": f"rf_{a}_as_{b}" for a, b in PAIRS}
    out = summary.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in cells.items()])
    right = sum((F.col(f"{t.lower()}_as_{t.lower()}") for t in TRUE_TYPES), F.lit(0))
    everything = sum((F.col(n) for n in cells), F.lit(0))
    return out.withColumn("micro", F.round(right / F.greatest(everything, F.lit(1)) * 100, 2))


def confusion_pivot(labelled: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Actual x predicted counts straight from decisions."""
    return (labelled.groupBy(actual).pivot(predicted, list(TRUE_TYPES)).agg(F.count(F.lit(1)))
            .select(actual, *[F.coalesce(F.col(t), F.lit(0)).alias(t.lower()) for t in TRUE_TYPES]))


def model_accuracy(summary: DataFrame) -> DataFrame:
    """All-time accuracy of both stages in percent; null without data."""
    s = lambda *cs: sum((F.coalesce(F.sum(c), F.lit(0)) for c in cs), F.lit(0))
    hits = [f"rf_tp_{t.lower()}" for t in TRUE_TYPES]
    misses = [f"rf_{a}_as_{b}" for a, b in PAIRS]
    return summary.agg(s("if_tp", "if_tn").alias("_a"), s("if_tp", "if_tn", "if_fp", "if_fn").alias("_b"),
                       s(*hits).alias("_c"), s(*hits, *misses).alias("_d")).select(
        F.when(F.col("_b") > 0, F.round(F.col("_a") / F.col("_b") * 100, 1)).alias("if_accuracy"),
        F.when(F.col("_d") > 0, F.round(F.col("_c") / F.col("_d") * 100, 1)).alias("rf_accuracy"))


def session_stats(decisions: DataFrame, drops: DataFrame, active: DataFrame, latency_ms: str) -> DataFrame:
    """Headline counters; real drops win over decided ones when there are any.

    Each input is one aggregate; drops and active sources enter as scalar subqueries.
    """
    anomalous = F.col("is_anomaly") == 1
    d = decisions.agg(
        F.coalesce(F.sum(F.when(anomalous, F.col("total"))), F.lit(0)).alias("_decided"),
        F.coalesce(F.sum(F.when(~anomalous, F.col("total"))), F.lit(0)).alias("normal_packets"),
        F.coalesce(F.sum("fp"), F.lit(0)).alias("_fp"), F.count(F.lit(1)).alias("_n"),
        F.coalesce(F.avg(F.when(anomalous, F.col(latency_ms))), F.lit(0.0)).alias("_lat"))
    real = drops.agg(F.coalesce(F.sum("delta"), F.lit(0))).scalar()
    threats = active.agg(F.count(F.lit(1))).scalar()
    dropped = F.when(F.col("_real") > 0, F.col("_real")).otherwise(F.col("_decided"))
    return (d.withColumn("_real", real).withColumn("active_threats", threats)
            .select((dropped + F.col("normal_packets")).cast("long").alias("total_packets"),
                    dropped.cast("long").alias("malicious_dropped"), F.col("normal_packets").cast("long"),
                    "active_threats",
                    F.round(F.col("_fp") / F.greatest("_n", F.lit(1)) * 100, 2).alias("fp_rate"),
                    F.round("_lat", 1).alias("avg_latency_ms")))


def latency_avg(events: DataFrame) -> DataFrame:
    both = events.filter(F.col("detection_ms").isNotNull() & F.col("mitigation_ms").isNotNull())
    return both.agg(F.round(F.coalesce(F.avg("detection_ms"), F.lit(0.0)), 2).alias("detection_ms"),
                    F.round(F.coalesce(F.avg("mitigation_ms"), F.lit(0.0)), 2).alias("mitigation_ms"))


def latency_percentiles(samples: DataFrame, value: str, order: Sequence[str], last: int = 500) -> DataFrame:
    """p50, p95 and p99 of the newest ``last`` samples, linearly interpolated."""
    newest = samples.filter(F.col(value).isNotNull()).orderBy(*[F.col(c).desc() for c in order]).limit(last)
    p = lambda q: F.round(F.coalesce(F.percentile(value, F.lit(q)), F.lit(0.0)), 1)
    return newest.agg(p(0.5).alias("p50_ms"), p(0.95).alias("p95_ms"), p(0.99).alias("p99_ms"),
                      F.count(F.lit(1)).alias("samples"))


def system_metrics_avg(metrics: DataFrame) -> DataFrame:
    a = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 2)
    return metrics.agg(a("cpu_percent").alias("avg_cpu"), a("mem_mb").alias("avg_mem"), a("pps_processed").alias("avg_pps"))


def system_metrics_by_condition(metrics: DataFrame) -> DataFrame:
    """Controller load under attack, at baseline and while mitigating, in one pass."""
    a = lambda cond: F.round(F.coalesce(F.avg(F.when(cond, F.col("ctrl_cpu_percent"))), F.lit(0.0)), 2)
    return metrics.agg(a(F.col("is_attack") == 1).alias("attack_ctrl_cpu"),
                       a(F.col("is_attack") == 0).alias("baseline_ctrl_cpu"),
                       a(F.col("is_mitigating") == 1).alias("mitigation_ctrl_cpu"))


def system_metrics_latest(metrics: DataFrame) -> DataFrame:
    cols = ("cpu_percent", "mem_mb", "ctrl_cpu_percent", "ctrl_mem_mb")
    row = metrics.agg(F.max_by(F.struct(*cols), "id").alias("r"))
    return row.select(*[F.round(F.col(f"r.{c}"), 2).alias(c) for c in cols])


def score_distribution(results: DataFrame, order: Sequence[str], threshold: float, last: int = 200) -> DataFrame:
    newest = results.orderBy(*[F.col(c).desc() for c in order]).limit(last)
    return newest.agg(F.count(F.when(F.col("if_score") < threshold, 1)).alias("normal"),
                      F.count(F.when(F.col("if_score") >= threshold, 1)).alias("anomaly"),
                      F.round(F.max("if_score"), 4).alias("max_score"))


def class_distribution(results: DataFrame, order: Sequence[str], last: int = 50) -> DataFrame:
    newest = results.orderBy(*[F.col(c).desc() for c in order]).limit(last)
    total = newest.agg(F.count(F.lit(1))).scalar()
    return (newest.groupBy("attack_class").agg(F.count(F.lit(1)).alias("n"))
            .select("attack_class", "n", F.round(F.col("n") / total * 100, 2).alias("share_pct")))


def graph_history(summary: DataFrame, start: str, end: str, buckets: int = 60) -> DataFrame:
    """Per-second rates in equal buckets over [start, end]; empty buckets are kept."""
    spark = summary.sparkSession
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    seconds = F.greatest((micros(hi) - micros(lo)) / F.lit(1e6), F.lit(1.0))
    size = seconds / buckets
    rows = summary.filter((F.col("timestamp") >= lo) & (F.col("timestamp") <= hi))
    index = F.least(F.floor((micros("timestamp") - micros(lo)) / F.lit(1e6) / size), F.lit(buckets - 1)).cast("long")
    sums = rows.groupBy(index.alias("bucket")).agg(
        F.sum("total").alias("_i"), F.sum("threats").alias("_b"), F.sum("true_neg").alias("_f"))
    rate = lambda c: F.round(F.coalesce(F.col(c), F.lit(0)) / size, 2)
    return (spark.range(buckets).withColumnRenamed("id", "bucket").join(sums, "bucket", "left")
            .select("bucket", rate("_i").alias("incoming"), rate("_b").alias("blocked"), rate("_f").alias("forwarded")))
