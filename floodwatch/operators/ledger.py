"""Ledger tables: appends, upserts, dedup, archive, feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodwatch.operators.features import format_percent
from floodwatch.plans.slices import greedy_spacing, prefix

EVENT_COLUMNS = ("timestamp", "src_ip", "predicted_class", "attack_vector", "confidence", "priority",
                 "action_taken", "if_score", "phase", "is_manual", "event_type", "reason",
                 "detection_ms", "mitigation_ms", "session_id")


def ttl_dedupe(events: DataFrame, *, ttl_s: float = 10.0, slice_s: float = 3600.0) -> DataFrame:
    """Drop repeats of (source, score to 4 places, action, phase) within ``ttl_s`` of the last kept one."""
    keyed = events.withColumn("_score4", F.round(F.coalesce("if_score", F.lit(0.0)), 4)) \
                  .withColumn("_phase", F.coalesce("phase", F.lit("")))
    keyed = keyed.withColumn("_key", F.concat_ws("|", "src_ip", F.format_number("_score4", 4), "action_taken", "_phase"))
    kept = greedy_spacing(keyed, ["_key"], ["timestamp", "id"], ts="timestamp", gap_s=ttl_s,
                          width_s=slice_s, strict=True)
    return kept.filter("is_kept").select(*events.columns)


def feed_dedupe(events: DataFrame, *, force: Column, ttl_s: float = 5.0, slice_s: float = 3600.0) -> DataFrame:
    """Live feed: at most one event per source in ``ttl_s``; forced events always pass and restart it."""
    kept = greedy_spacing(events, ["src_ip"], ["timestamp", "id"], ts="timestamp", gap_s=ttl_s,
                          width_s=slice_s, strict=False, force=force)
    return kept.filter("is_kept").select(*events.columns)


def mitigation_rows(events: DataFrame) -> DataFrame:
    """Shape events for the ledger: defaults for event type and manual flag."""
    have = set(events.columns)
    cols = {c: (F.col(c) if c in have else F.lit(None)) for c in EVENT_COLUMNS}
    cols["event_type"] = F.coalesce(F.when(cols["event_type"] != "", cols["event_type"]), F.lit("transition"))
    cols["is_manual"] = F.coalesce(cols["is_manual"].cast("long"), F.lit(0)).cast("long")
    return events.select(*(["id"] if "id" in have else []), *[c.alias(n) for n, c in cols.items()])


def append_mitigation_events(events: DataFrame, **dedupe) -> DataFrame:
    """Rows that reach the ledger: deduplicated, with defaults filled in."""
    return mitigation_rows(ttl_dedupe(events, **dedupe))


def manual_action_rows(actions: DataFrame) -> DataFrame:
    """Manual operator actions: never deduplicated, action in title case."""
    return mitigation_rows(actions.withColumn("predicted_class", F.lit("DDoS"))
                           .withColumn("action_taken", F.initcap(F.replace("action", F.lit("_"), F.lit(" "))))
                           .withColumn("is_manual", F.lit(1)).withColumn("event_type", F.lit("manual")))


def latest_state(changes: DataFrame, *, order: Sequence[str], deleted: str | None = None) -> DataFrame:
    """Last write per source wins; tombstones remove it. A map-side combined max."""
    rest = [c for c in changes.columns if c != "src_ip"]
    out = (changes.groupBy("src_ip").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
           .select("src_ip", "r.*"))
    return out.filter(~F.col(deleted)).drop(deleted) if deleted else out


def restore_states(states: DataFrame, as_of: Column) -> DataFrame:
    """What a restart does with each persisted state: purge, expire or restore."""
    gone = F.col("block_expires_at").isNotNull() & (F.col("block_expires_at") <= as_of)
    outcome = F.when(F.col("permanent") == 0, "purged").when(gone, "expired").otherwise("restored")
    command = F.when(outcome != "restored", "clear").when(F.col("phase") == 3, "block").otherwise("rate_limit")
    left = (F.unix_micros(F.col("block_expires_at").cast("timestamp"))
            - F.unix_micros(as_of.cast("timestamp"))) / F.lit(1e6)
    ttl = F.when((outcome == "restored") & F.col("block_expires_at").isNotNull(), F.floor(left).cast("long"))
    return states.withColumn("outcome", outcome).withColumn("command", command).withColumn("ttl", ttl)


def history_rows(episodes: DataFrame) -> DataFrame:
    """Finished episodes with whole-second duration and rounded scores."""
    seconds = (F.unix_micros(F.col("unblocked_at").cast("timestamp"))
               - F.unix_micros(F.col("first_seen").cast("timestamp"))) / F.lit(1e6)
    return (episodes.withColumn("duration_sec", F.coalesce(F.floor(seconds).cast("long"), F.lit(0)))
            .withColumn("if_score", F.round("if_score", 6)).withColumn("confidence", F.round("confidence", 6)))


def metrics_rows(samples: DataFrame) -> DataFrame:
    rounded = ("cpu_percent", "mem_mb", "pps_processed", "ctrl_cpu_percent", "ctrl_mem_mb")
    return samples.select(*[F.round(c, 2).alias(c) if c in rounded else F.col(c) for c in samples.columns])


def split_archive(events: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(hot, archive): rows from the cutoff on, and rows before it."""
    return events.filter(F.col("timestamp") >= cutoff), events.filter(F.col("timestamp") < cutoff)


def with_archive(hot: DataFrame, archive: DataFrame) -> DataFrame:
    return hot.unionByName(archive, allowMissingColumns=True)


def first_per(events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key. A map-side combined min, so a hot key shuffles one row per task."""
    rest = [c for c in events.columns if c not in keys]
    return (events.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
            .select(*keys, "r.*"))


def first_detection_per_phase(detections: DataFrame) -> DataFrame:
    """One 'detected' row per (source, phase entry)."""
    return first_per(detections, ["src_ip", "phase_entered"], ["timestamp", "id"])


def incident_collapse(events: DataFrame, *, slice_s: float) -> DataFrame:
    """Latest row per (source, event type) and incident; a release closes the incident."""
    release = ((F.col("event_type") == "released")
               | ((F.col("event_type") == "manual") & F.lower("action_taken").contains("release")))
    keys, order = ["src_ip", "event_type"], ["timestamp", "id"]
    rows = prefix(events.withColumn("_r", release.cast("int")), keys, order, ts="timestamp",
                  width_s=slice_s, sums={"_upto": F.col("_r")})
    rows = rows.withColumn("incident_no", (F.col("_upto") - F.col("_r")).cast("long")).drop("_upto", "_r")
    group = [*keys, "incident_no"]
    rest = [c for c in rows.columns if c not in group]
    return (rows.groupBy(*group).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"),
                                     F.count(F.lit(1)).alias("updates")).select(*group, "updates", "r.*"))


FEED_COLUMNS = ("timestamp", "src_ip", "predicted_class", "attack_vector", "confidence", "priority",
                "action_taken", "event_type", "reason", "session_id")


def recent_events(events: DataFrame, limit: int = 100, since: Column | None = None) -> DataFrame:
    """The newest ``limit`` rows strictly after ``since``, oldest first; a distributed top-k. Pages of the feed ask for up to 500."""
    rows = events.filter(F.col("timestamp") > since) if since is not None else events
    newest = rows.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(limit)
    out = newest.withColumn("confidence", F.coalesce(format_percent(F.col("confidence")), F.lit("---")))
    return out.orderBy("timestamp", "id").select("id", *FEED_COLUMNS)


def scan_log(results: DataFrame, order: Sequence[str], limit: int = 200) -> DataFrame:
    """Newest scored flows with display rounding; a distributed top-k."""
    hit = F.col("is_anomaly") == 1
    return (results.orderBy(*[F.col(c).desc() for c in order]).limit(limit)
            .withColumn("attack_class", F.when(hit, F.col("attack_class")).otherwise("Normal"))
            .withColumn("confidence", F.when(hit, format_percent(F.col("confidence"))).otherwise("-"))
            .withColumn("pps", F.round("pps", 1)).withColumn("if_score", F.round("if_score", 4)))


def active_list(states: DataFrame, sinkholed: DataFrame) -> DataFrame:
    """Tracked sources by score, with sinkholed ones as phase 0 of low priority."""
    low = sinkholed.withColumn("phase", F.lit(0).cast("long")).withColumn("priority", F.lit("Low"))
    return states.unionByName(low, allowMissingColumns=True).orderBy(F.col("if_score").desc(), "src_ip")
