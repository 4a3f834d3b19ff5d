"""Dossiers, host status, report sections."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodwatch.operators.behavior import offence_totals, reputation
from floodwatch.operators.features import format_duration, format_percent, live_view_features, phase_number
from floodwatch.operators.ledger import first_per

LATEST_FEATURES = ("packet_count", "byte_count", "packet_count_per_second", "byte_count_per_second",
                   "flow_duration_sec", "flow_count_per_src", "tp_src", "tp_dst", "ip_proto")


def validate_report_range(start: str, end: str, today: dt.date | None = None) -> tuple[str, str]:
    """Check the dates of a report request; raises ValueError with the reason."""
    today = today or dt.date.today()
    try:
        a, b = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    except (TypeError, ValueError) as exc:
        raise ValueError("Invalid date format. Use YYYY-MM-DD.") from exc
    if b < a:
        raise ValueError("End date must be >= start date.")
    if b > today:
        raise ValueError("End date cannot be in the future.")
    return start, end


def report_range_error(start: Column, end: Column, today: Column) -> Column:
    """The same rule for columns of dates as text: the reason why a request is refused, or null."""
    a, b = (F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(c, "yyyy-MM-dd")) for c in (start, end))
    return (F.when(a.isNull() | b.isNull(), "Invalid date format. Use YYYY-MM-DD.").when(b < a, "End date must be >= start date.")
            .when(b > today, "End date cannot be in the future."))


def latest_by(df: DataFrame, order: list[str], cols: list[str]) -> DataFrame:
    return df.groupBy("src_ip").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r")).select("src_ip", "r.*")


def ip_dossier(hot: DataFrame, archive: DataFrame, detections: DataFrame, history: DataFrame,
               now: Column, src_ip: str | None = None) -> DataFrame:
    """Everything known about each source: latest event, features, offences, reputation.

    Every part is one map-side combined aggregate per source before the joins.
    A hot event beats any archived one.
    """
    if src_ip is not None:
        hot, archive, detections, history = (d.filter(F.col("src_ip") == src_ip)
                                             for d in (hot, archive, detections, history))
    ev_cols = ["timestamp", "predicted_class", "attack_vector", "confidence", "if_score", "phase", "priority", "action_taken"]
    events = (hot.withColumn("_rank", F.lit(1)).unionByName(archive.withColumn("_rank", F.lit(0)), allowMissingColumns=True))
    event = latest_by(events, ["_rank", "timestamp", "id"], ev_cols)
    feats = latest_by(detections, ["ts", "_seq"], list(LATEST_FEATURES))
    hist = latest_by(history.withColumnRenamed("priority", "h_priority"), ["unblocked_at", "id"],
                     ["ban_level", "phase_reached", "first_seen", "unblocked_at", "h_priority"])
    out = (event.join(live_view_features(feats), "src_ip", "left").join(hist, "src_ip", "left")
           .join(reputation(history, now), "src_ip", "left")
           .join(offence_totals(history).select("src_ip", "offences"), "src_ip", "left"))
    number = phase_number(F.col("phase"))
    pct = F.when(F.col("confidence") <= 1.0, F.col("confidence") * 100).otherwise(F.col("confidence"))
    return (out.withColumn("phase_no", F.when(number > 0, number).otherwise(F.coalesce("phase_reached", F.lit(0))).cast("long"))
            .withColumn("confidence_pct", F.round(pct, 1))
            .withColumn("last_seen", F.col("unblocked_at"))
            .withColumn("priority", F.coalesce("priority", "h_priority"))
            .withColumn("ban_level", F.coalesce("ban_level", F.lit(0)))
            .withColumn("reputation", F.coalesce("reputation", F.lit(0.0)))
            .withColumn("offences", F.coalesce("offences", F.lit(0)))
            .drop("unblocked_at", "h_priority"))


def phase_history(hot: DataFrame, archive: DataFrame) -> DataFrame:
    """First time each (phase, action) was seen per source; archived rows only when none are hot."""
    has_hot = hot.select("src_ip").distinct()
    rows = hot.unionByName(archive.join(has_hot, "src_ip", "left_anti"), allowMissingColumns=True)
    rows = rows.withColumn("phase", F.coalesce("phase", F.lit("")))
    return first_per(rows.select("src_ip", "phase", "action_taken", "timestamp", "id", "attack_vector", "event_type"),
                     ["src_ip", "phase", "action_taken"], ["timestamp", "id"])


def host_status(hosts: DataFrame, mitigations: DataFrame, attacking: DataFrame) -> DataFrame:
    """Status line per host: attacking, mitigated, possible false positive or standby."""
    out = (hosts.join(mitigations.select("src_ip", F.col("action_taken").alias("mitigation")), "src_ip", "left")
           .join(attacking.select("src_ip", F.lit(True).alias("attacking")), "src_ip", "left"))
    mit, on = F.col("mitigation").isNotNull(), F.coalesce("attacking", F.lit(False))
    tag = F.concat(F.lit("["), F.col("mitigation"), F.lit("]"))
    attacker = (F.when(on & mit, F.concat(F.lit("ATTACKING -> "), tag)).when(on, F.lit("ATTACKING"))
                .when(mit, F.concat(F.lit("MITIGATED "), tag)).otherwise("standby"))
    legit = F.when(mit, F.concat(F.lit("FP? MITIGATED "), tag)).otherwise("standby")
    return (out.withColumn("status", F.when(F.col("role") == "attacker", attacker)
                           .when(F.col("role") == "legit", legit).otherwise(F.col("role")))
            .drop("attacking", "mitigation"))


def offences_summary(history: DataFrame) -> DataFrame:
    return (history.groupBy("src_ip").agg(
                F.count(F.lit(1)).alias("sessions"), F.max("offence_count").alias("max_offences"),
                F.max("ban_level").alias("max_ban"), F.max("phase_reached").alias("max_phase"),
                F.min("first_seen").alias("first_seen"), F.max("unblocked_at").alias("last_seen"),
                F.max_by("attack_vector", F.struct("unblocked_at", "id")).alias("attack_vector"))
            .orderBy(F.col("max_offences").desc(), F.col("sessions").desc(), "src_ip"))


def report_rows(events: DataFrame) -> DataFrame:
    """First row per (source, action): what the report counts."""
    return first_per(events.select("src_ip", "action_taken", "timestamp", "id", "predicted_class", "attack_vector",
                                   "confidence", "priority", "is_manual"), ["src_ip", "action_taken"], ["timestamp", "id"])


def executive_summary(rows: DataFrame) -> DataFrame:
    """Counts by vector and by action plus totals, from one pass with grouping sets."""
    kind = (F.when(F.col("action_taken").startswith("Time Ban"), "Time Ban").otherwise(F.col("action_taken")))
    manual = F.col("is_manual") == 1
    base = rows.select(F.coalesce("attack_vector", F.lit("Uncertain")).alias("vector"), kind.alias("action"),
                       (F.lower("priority") == "high").cast("int").alias("_high"),
                       (manual & F.col("action_taken").contains("Release")).cast("int").alias("_rel"),
                       (manual & F.col("action_taken").contains("Block")).cast("int").alias("_blk"))
    out = base.groupingSets([[F.col("vector")], [F.col("action")], []], F.col("vector"), F.col("action")).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("threats"), F.sum("_high").alias("high"),
        F.sum("_rel").alias("manual_release"), F.sum("_blk").alias("manual_block"))
    section = F.when(F.col("_g") == 1, "vector").when(F.col("_g") == 2, "action").otherwise("total")
    return out.select(section.alias("section"), F.coalesce("vector", "action", F.lit("all")).alias("name"), "threats",
                      "high", (F.col("threats") - F.col("high")).alias("low"), "manual_release", "manual_block")


def summary_totals(summary: DataFrame) -> DataFrame:
    """Flows, true negatives, false positives and the false positive rate in percent of the report's days."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = summary.agg(total("total").alias("total_flows"), total("true_neg").alias("true_negatives"),
                      total("fp").alias("false_positives"), total("if_fp").alias("_fp"), total("if_tn").alias("_tn"))
    rate = F.col("_fp") / F.greatest(F.col("_fp") + F.col("_tn"), F.lit(1)) * 100
    return out.select("total_flows", "true_negatives", "false_positives", F.round(rate, 2).alias("fp_rate"))


def chronological_log(rows: DataFrame) -> DataFrame:
    conf = F.when(F.coalesce("confidence", F.lit(0.0)) != 0, format_percent(F.col("confidence"))).otherwise("-")
    return (rows.select("timestamp", "src_ip", "predicted_class", F.coalesce("attack_vector", F.lit("-")).alias("attack_vector"),
                        conf.alias("confidence"), F.coalesce("priority", F.lit("-")).alias("priority"), "action_taken")
            .orderBy("timestamp", "src_ip", "action_taken"))


def history_report(history: DataFrame) -> DataFrame:
    conf = F.when(F.coalesce("confidence", F.lit(0.0)) != 0, format_percent(F.col("confidence"))).otherwise("-")
    offences = F.when(F.coalesce("offence_count", F.lit(0)) == 0, 1).otherwise(F.col("offence_count"))
    return (history.orderBy(F.col("unblocked_at").desc(), "id")
            .select("id", "src_ip", "attack_vector", F.format_string("%.4f", "if_score").alias("if_score"),
                    conf.alias("confidence"), "priority",
                    F.concat(F.lit("Phase "), F.col("phase_reached").cast("string")).alias("phase"),
                    offences.cast("long").alias("offences"), format_duration(F.col("duration_sec")).alias("duration"),
                    "unblocked_at", "unblock_reason"))


def history_dates(history: DataFrame) -> DataFrame:
    return history.select(F.date_format("unblocked_at", "yyyy-MM-dd").alias("d")).distinct().orderBy("d")


