"""Every operator as a query over the test tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodwatch.operators import packets as P
from floodwatch.operators import prefilter as X
from floodwatch.sources import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
DAY = A.DAY_S
SLICE_D = 10 * DAY       # packets cover 30 days
SLICE_FLOW = 180 * DAY   # flows cover seven years
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(name: str, alias: str | None = None):
    return F.round(F.col(name), 6).alias(alias or name)


# --- packets and the flood prefilter ----------------------------------------


@query
def classify_packet(spark, d):
    return P.classify_packet(A.packets(spark, d)).select(
        "event_id", "src_ip", F.coalesce("flood_proto", F.lit("none")).alias("flood_proto"))


@query
def filter_scoreable(spark, d):
    return P.filter_scoreable(A.packets(spark, d)).select("event_id", "src_ip")


@query
def flood_windows(spark, d):
    return X.flood_windows(A.packets(spark, d), A.FLOOD_RULES).select(
        "event_id", "src_ip", "flood_proto", "n_window", "n_burst_short", "n_burst_long",
        F.col("active_protocols").cast("int").alias("active_protocols"))


TRIP_COLUMNS = ["src_ip", "flood_proto", "episode_start", "trip_ts", "reason", "correlated"]


@query
def flood_trips(spark, d):
    return X.flood_trips(A.packets(spark, d), A.FLOOD_RULES).select(*TRIP_COLUMNS)


@query
def multi_vector(spark, d):
    return X.multi_vector(A.packets(spark, d), A.FLOOD_RULES)


@query
def flag_intervals(spark, d):
    return X.flag_intervals(A.packets(spark, d), A.FLOOD_RULES)


@query
def flag_intervals_with_acks(spark, d):
    return X.flag_intervals(A.packets(spark, d), A.FLOOD_RULES, pop_acks=True).select("src_ip", "episode_start", "flag_from", "flag_to")


@query
def prefilter_breakdown(spark, d):
    return X.prefilter_breakdown(X.flood_trips(A.packets(spark, d), A.FLOOD_RULES))


@query
def ack_popback(spark, d):
    return X.ack_popback(A.packets(spark, d), A.FLOOD_RULES).select(
        "src_ip", "event_id", "n_window", "n_burst_short", "n_burst_long")


@query
def flood_trips_with_acks(spark, d):
    return X.flood_trips(A.packets(spark, d), A.FLOOD_RULES, pop_acks=True).select(*TRIP_COLUMNS)


@query
def packet_rate_limiter(spark, d):
    # one rule second is one day here, so a switch may send 30 packets a day
    out = P.packet_rate_limiter(A.packets(spark, d), limit=30, window_s=DAY, slice_s=SLICE_D)
    return out.select("event_id", "dpid", "in_window", "throttled")


@query
def packet_rate_tumbling(spark, d):
    return P.packet_rate_tumbling(A.packets(spark, d), limit=30, window_s=DAY).select(
        "dpid", "slot", "packets", "over_limit")


# --- address caches, flow gates and deltas ----------------------------------

from floodwatch import config as C  # noqa: E402
from floodwatch.operators import features as FT  # noqa: E402
from floodwatch.operators import flows as FL  # noqa: E402

SEQ = ["l_orderkey", "l_linenumber", "l_partkey"]
FLOW_ID = ["src_ip", "poll_id", *SEQ]


def partial_flows(spark, d):
    """Packets seen as samples, a quarter of them with a protocol of their own."""
    num = P.proto_number(F.col("proto"))
    return A.packets(spark, d).select(
        "event_id", "ts", "dpid", "src_ip", F.when(F.col("event_id") % 4 == 0, num).otherwise(0).cast("long").alias("ip_proto"))


@query
def resolve_protocol(spark, d):
    out = P.resolve_protocol(partial_flows(spark, d), A.packets(spark, d), slice_s=SLICE_D)
    return out.select("event_id", "ip_proto", "resolved_proto")


@query
def resolve_ports(spark, d):
    pk = A.packets(spark, d).withColumn("tp_src", F.col("event_id") % 65536).withColumn("tp_dst", F.col("event_id") % 1024)
    return P.resolve_ports(partial_flows(spark, d), pk, slice_s=SLICE_D).select("event_id", "port_src", "port_dst")


@query
def flow_rates(spark, d):
    return A.flows(spark, d).select(*FLOW_ID, r6("packet_count_per_second"), r6("byte_count_per_second"),
                                    F.round(F.col("packet_count_per_nsecond") * 1e9, 6).alias("pps_from_ns"),
                                    F.round(F.col("byte_count_per_nsecond") * 1e9, 6).alias("bps_from_ns"))


@query
def young_flow_gate(spark, d):
    f = A.flows(spark, d).withColumn("flow_duration_sec", F.col("flow_duration_sec") - 1)
    return FL.young_flow_gate(f).select(*FLOW_ID)


@query
def low_rate_gate(spark, d):
    f = A.flows(spark, d).withColumn("base", F.col("flow_duration_sec") * 8).withColumn("flag", F.col("ip_proto") == 6)
    return FL.low_rate_gate(f, baseline="base", flagged="flag").select(*FLOW_ID, "low_rate")


@query
def staleness_gate(spark, d):
    f = A.flows(spark, d).withColumn("flag", F.col("ip_proto") == 6)
    return FL.staleness_gate(f, wait_s="flow_duration_sec", flagged="flag").select(*FLOW_ID, "route")


@query
def estimate_pkt_count(spark, d):
    seen = F.when(F.col("ip_proto") != 6, F.col("packet_count"))
    return A.flows(spark, d).select(*FLOW_ID, FL.estimate_pkt_count(seen, F.col("packet_count_per_second")).alias("pkts"))


@query
def flow_delta(spark, d):
    out = FL.flow_delta(A.flows(spark, d), A.FLOW_ORDER, slice_s=SLICE_FLOW)
    return out.select(*FLOW_ID, "delta_packets")


@query
def flow_count_per_src(spark, d):
    out = FL.flow_count_per_src(A.flows(spark, d), SEQ, chunk=F.floor(F.col("l_orderkey") / 100000))
    return out.select(*FLOW_ID, "flow_count_per_src")


def poll_stats(spark, d):
    return FL.switch_poll_stats(A.flows(spark, d))


@query
def switch_poll_stats(spark, d):
    f = A.flows(spark, d)
    came = f.filter("ip_proto = 6").select("dpid", "poll_id")   # the first packet of a connection comes to the controller
    out = FL.switch_poll_stats(f, came, interval_s=DAY)
    return out.select("dpid", "poll_id", "disp_pakt", "disp_byte", "gfe", "g_usip", "avg_flow_dst", "active_ports", F.round("rate_pkt_in", 9).alias("rate_pkt_in"),
                                       "dominant_proto", "rfip", r6("mean_pkt"), r6("mean_byte"), r6("avg_durat"))


@query
def switch_delta_pps(spark, d):
    f = A.flows(spark, d)
    stats = FL.switch_poll_stats(f, f.filter("ip_proto = 6").select("dpid", "poll_id"), interval_s=0.01)
    out = FL.switch_delta_pps(stats, ts="poll_id", rate_in="rate_pkt_in")
    return out.select("dpid", "poll_id", r6("switch_delta_pps"))


@query
def drop_delta(spark, d):
    rule = F.element_at(F.array(*[F.lit(x) for x in (100, 90, 80, 50, 10)]), (F.col("poll_id") % 5 + 1).cast("int"))
    f = A.flows(spark, d).withColumn("rule_priority", rule)
    return FL.drop_delta(f, [*A.FLOW_ORDER, "l_suppkey"], slice_s=SLICE_FLOW).select(*FLOW_ID, "drop_key", "delta")


@query
def merge_switch_flow(spark, d):
    stats = poll_stats(spark, d).select("dpid", "poll_id", "disp_pakt", "gfe", F.col("dominant_proto").alias("ip_proto"))
    f = A.flows(spark, d).withColumn("ip_proto", F.when(F.col("l_partkey") % 3 == 0, 0).otherwise(F.col("ip_proto")))
    return FL.merge_switch_flow(f, stats).select(*FLOW_ID, "ip_proto", "disp_pakt", "gfe")


@query
def latest_flow_per_src(spark, d):
    out = FL.latest_flow_per_src(A.flows(spark, d), [*A.FLOW_ORDER, "l_suppkey"], cap=50)
    return out.select(*FLOW_ID, "packet_count", "byte_count")


@query
def live_deltas(spark, d):
    f = A.flows(spark, d)
    bad = F.col("ip_proto") == 6
    polls = f.groupBy("poll_id").agg(F.sum(F.when(bad, F.col("packet_count")).otherwise(0)).alias("m"),
                                     F.sum(F.when(~bad, F.col("packet_count")).otherwise(0)).alias("n"))
    polls = polls.withColumn("t", F.col("m") + F.col("n"))
    out = FL.live_deltas(polls, order="poll_id", malicious="m", normal="n", total="t")
    return out.select("poll_id", "delta_malicious", "delta_normal", "delta_total", r6("pct_change"))


@query
def flatten_flow_stats(spark, d):
    from floodwatch.sources import telemetry as S
    return S.flatten_flow_stats(S.nest_flows(A.flows(spark, d))).select(
        *FLOW_ID, "packet_count", "byte_count", "idle_timeout", r6("byte_count_per_second"))


@query
def ground_truth_intervals(spark, d):
    from floodwatch.sources import telemetry as S
    e = A.packets(spark, d).filter(F.col("proto") != "OTHER")
    calls = e.select("src_ip", "ts", "event_id", F.when(F.col("proto") == "UDP", "stop").otherwise("start").alias("call"),
                     F.when(F.col("proto") == "ICMP", "ICMP").otherwise("SYN").alias("attack_type"))
    return S.ground_truth_intervals(calls, slice_s=SLICE_D).select("src_ip", "attack_type", "start_ts", "end_ts")


# --- features ---------------------------------------------------------------


def counted_flows(spark, d):
    """The rates follow from the counters, so they are added after the shuffle."""
    bare = A.flows(spark, d).drop(*FL.RATES)
    return FL.flow_rates(FL.flow_count_per_src(bare, SEQ, chunk=F.floor(F.col("l_orderkey") / 100000)))


@query
def if_features(spark, d):
    return FT.if_features(counted_flows(spark, d)).select(*FLOW_ID, *[r6(f"if_{n}") for n in C.IF_FEATURES])


@query
def rf_features(spark, d):
    return FT.rf_features(counted_flows(spark, d)).select(*FLOW_ID, *[r6(f"rf_{n}") for n in C.RF_FEATURES])


LEDGER = ("flow_duration_total_ns", "bytes_per_packet", "pkt_byte_rate_ratio", "flow_intensity", "port_entropy",
          "bytes_per_duration", "pkt_size_uniformity", "flow_src_intensity")


@query
def ledger_features(spark, d):
    out = FT.ledger_features(counted_flows(spark, d))
    return out.select(*FLOW_ID, *[F.round(n, 9 if n == "port_entropy" else 4).alias(n) for n in LEDGER],
                      F.round(F.col("duration_pkt_ratio") / 1e9, 6).alias("duration_pkt_ratio_e9"),
                      F.round(F.col("pkt_rate_per_duration") * 1e9, 4).alias("pkt_rate_per_duration_e9"))


@query
def live_view_features(spark, d):
    out = FT.live_view_features(A.flows(spark, d).withColumn("flow_count_per_src", F.lit(1)))
    return out.select(*FLOW_ID, "bytes_per_packet", "flow_intensity", "flow_src_intensity", "port_entropy", "bytes_per_duration", "pkt_byte_rate_ratio", "pkt_size_uniformity")


@query
def class_one_hot(spark, d):
    return FT.class_one_hot(A.results(spark, d)).select(*FLOW_ID, "flag_syn_flood", "flag_icmp_flood", "flag_udp_flood", "flag_normal")


@query
def impute_nonfinite(spark, d):
    inf = F.lit(float("inf"))
    bad = (F.when(F.col("l_partkey") % 11 == 0, F.lit(float("nan"))).when(F.col("l_partkey") % 13 == 0, inf)
           .when(F.col("l_partkey") % 17 == 0, F.lit(None)).otherwise(F.col("packet_count").cast("double")))
    f = A.flows(spark, d).withColumn("x", bad)
    return FT.impute_nonfinite(f, ["x"]).select(*FLOW_ID, r6("x"))


@query
def map_labels(spark, d):
    return FT.map_labels(A.results(spark, d)).select(
        *FLOW_ID, "predicted_class", F.coalesce("short_class", F.lit("-")).alias("short_class"),
        F.coalesce("class_protocol", F.lit(0)).alias("class_protocol"))


@query
def signal_alerts(spark, d):
    r = A.results(spark, d)
    bpp = F.col("byte_count") / F.col("packet_count")
    f = r.select(*FLOW_ID, "attack_class", (F.col("pps") * 40).alias("pps"), F.col("byte_count_per_second").alias("byte_rate"),
                 (bpp / 20).alias("bpp"), (F.col("packet_count") * 400).alias("pkt_count"), (F.col("byte_count") * 20).alias("byte_count"),
                 (F.col("tp_src") / (F.col("tp_dst") + 1)).alias("port_entropy"),
                 F.log1p(bpp / (F.col("byte_count_per_second") + 1)).alias("pkt_size_uniformity"))
    return FT.signal_alerts(f, FLOW_ID).select(*FLOW_ID, "attack_class", "feature", F.round("value", 9).alias("value"))


@query
def score_band(spark, d):
    r = A.results(spark, d)
    return r.select(*FLOW_ID, FT.score_band(F.col("if_score")).alias("band"),
                    FT.fp_rate_band(F.col("l_discount") * 100 + 0.5).alias("fp_band"))


@query
def format_fields(spark, d):
    r = A.results(spark, d)
    return r.select(*FLOW_ID, FT.format_percent(F.round("l_tax", 2)).alias("pct"),
                    FT.format_duration(F.col("l_orderkey") % 7200).alias("duration"),
                    FT.format_ban(F.col("packet_count") * 10).alias("ban"),
                    FT.protocol_name(F.col("ip_proto")).alias("protocol"),
                    FT.format_byte_rate((F.col("byte_count") * 250 + 1).cast("double")).alias("rate"))


# --- temporal entropy analysis ----------------------------------------------

from floodwatch.functions import entropy as EN  # noqa: E402
from floodwatch.operators import fusion as FU  # noqa: E402
from floodwatch.operators import tea as TE  # noqa: E402


def snapshots(spark, d, **settings):
    return TE.tea_snapshot(A.flows(spark, d), tick_s=DAY, **settings)


@query
def tea_snapshot(spark, d):
    return snapshots(spark, d).select("tick_ts", *[r6(m) for m in TE.METRICS], "unique_ips")


@query
def tea_snapshot_per_switch(spark, d):
    out = TE.tea_snapshot(A.flows(spark, d), tick_s=DAY, scope=F.col("dpid").cast("string"))
    return out.select("scope", "tick_ts", *[r6(m) for m in TE.METRICS], "unique_ips")


@query
def shannon_entropy(spark, d):
    return EN.shannon_entropy(A.flows(spark, d), ["src_ip"], "ip_proto", F.col("packet_count")).select("src_ip", r6("entropy"))


@query
def uniform_share(spark, d):
    f = TE.flow_shape(TE.with_tick(A.flows(spark, d), DAY))
    return TE.uniform_share(f).select("tick_ts", r6("uniform_share"))


@query
def adaptive_baseline(spark, d):
    return TE.adaptive_baseline(snapshots(spark, d)).select("tick_ts", "metric", "learned", r6("baseline_mean"), r6("baseline_var"))


def verdicts(spark, d, **settings):
    return TE.tea_verdict(snapshots(spark, d, **settings))


@query
def tea_verdict(spark, d):
    return verdicts(spark, d).select("tick_ts", "is_learned", "is_attack_pattern", "mechanized_cluster", "size_surge", "intensity_surge",
                                     "confidence", *[r6(n) for n in ("size_zscore", "intensity_zscore", "proto_zscore",
                                                                     "uniform_share_zscore", "baseline_mean_size", "size_delta")])


@query
def ip_profile_verdict(spark, d):
    out = TE.ip_profile_verdict(A.flows(spark, d), A.FLOW_ORDER, slice_s=SLICE_FLOW)
    return out.select(*FLOW_ID, "samples", "ip_verdict")


@query
def ip_trend(spark, d):
    out = TE.ip_profile_verdict(A.flows(spark, d), A.FLOW_ORDER, slice_s=SLICE_FLOW)
    return out.select(*FLOW_ID, r6("ip_trend"))


@query
def attach_tea(spark, d):
    f = A.flows(spark, d).withColumn("scope", F.lit("all"))
    return FU.attach_tea(f, verdicts(spark, d), slice_s=30 * DAY).select(*FLOW_ID, "tea_attack_pattern", "tea_confidence", "tea_is_learned")


@query
def attach_tea_by_source(spark, d):
    """The verdict as a source gets it: its own profile may force an attack, a ban makes it neutral."""
    f = TE.ip_profile_verdict(A.flows(spark, d), A.FLOW_ORDER, slice_s=SLICE_FLOW).withColumns({"scope": F.lit("all"), "phase": (F.col("l_orderkey") % 5).cast("int")})
    out = FU.attach_tea(f, verdicts(spark, d).filter("is_learned"), slice_s=30 * DAY, profile="ip_verdict", phase="phase")
    return out.select(*FLOW_ID, "tea_attack_pattern", "tea_confidence", "tea_is_learned")


@query
def mitigation_advisory(spark, d):
    f = TE.with_tick(A.flows(spark, d), DAY).withColumn("flagged", F.col("ip_proto") == 6)
    out = TE.mitigation_advisory(FU.attach_tea_by_tick(f, verdicts(spark, d)))
    return out.groupBy("src_ip").agg(F.count(F.when(F.col("would_block"), 1)).alias("would_block"), F.count(F.lit(1)).alias("scored"))


# --- decision fusion --------------------------------------------------------

from floodwatch.operators import behavior as BE  # noqa: E402
from floodwatch.operators import ledger as LE  # noqa: E402
from floodwatch.operators import metrics as ME  # noqa: E402
from floodwatch.operators import reports as RE  # noqa: E402

NOW = "1999-06-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def labelled(spark, d):
    return FU.label_with_ground_truth(A.results(spark, d), A.gt_intervals(spark, d), slice_s=SLICE_FLOW)


def decisions(spark, d):
    return FU.score_decisions(labelled(spark, d))


@query
def label_with_ground_truth(spark, d):
    return labelled(spark, d).select(*FLOW_ID, F.coalesce("attack_type", F.lit("-")).alias("attack_type"), "is_attacker")


@query
def attach_prefilter_flag(spark, d):
    pk = A.packets(spark, d)
    return FU.attach_prefilter_flag(pk, X.flag_intervals(pk, A.FLOOD_RULES), slice_s=SLICE_D).select("event_id", "src_ip", "flagged")


@query
def confidence_lock(spark, d):
    return FU.confidence_lock(A.results(spark, d), A.FLOW_ORDER, slice_s=SLICE_FLOW).select(*FLOW_ID, r6("locked_confidence"), "locked_class")


@query
def carry_prior_class(spark, d):
    r = A.results(spark, d).groupBy("src_ip", "ts").agg(
        F.max("is_anomaly").alias("is_anomaly"), F.max("confidence").alias("c"),
        F.max_by("attack_class", F.struct("confidence", "attack_class")).alias("k"))
    r = r.select("src_ip", "ts", "is_anomaly", F.col("k").alias("attack_class"), F.col("c").alias("confidence"))
    out = FU.carry_prior_class(r, ttl_s=10 * DAY, slice_s=100 * DAY)
    return out.select("src_ip", "ts", "carried_class", r6("carried_confidence"))


@query
def gate_confidence(spark, d):
    r = A.results(spark, d)
    top = F.when(F.col("ip_proto") == 6, "SYN Flood").when(F.col("ip_proto") == 1, "ICMP Flood").otherwise("UDP Flood")
    return r.select(*FLOW_ID, FU.gate_confidence(top, F.col("confidence")).alias("attack_class"))


@query
def score_decisions(spark, d):
    cols = [c for c in ME.COUNTERS if c not in ("held", "rescored", "expired_unscored")]
    return decisions(spark, d).select(*FLOW_ID, *cols)


@query
def baseline_lock(spark, d):
    r = A.results(spark, d).withColumn("scope", F.col("dpid").cast("string"))
    out = FU.baseline_lock(r, [*A.FLOW_ORDER, "l_suppkey"], slice_s=SLICE_FLOW, streak=3)
    return out.select(*FLOW_ID, "locked_after")


@query
def reputation(spark, d):
    h = A.attack_history(spark, d).filter(F.col("unblocked_at") <= now())
    return BE.reputation(h, now(), half_life_s=90 * DAY).select("src_ip", "reputation")


def offence_detections(spark, d):
    """Detections a week after each order of the same sources."""
    h = A.attack_history(spark, d)
    return h.select("id", "src_ip", (F.col("unblocked_at") + F.expr("make_dt_interval(7)")).alias("ts"))


@query
def attach_reputation(spark, d):
    out = BE.attach_reputation(offence_detections(spark, d), A.attack_history(spark, d), half_life_s=90 * DAY)
    return out.select("id", "src_ip", "reputation")


@query
def running_reputation(spark, d):
    out = BE.running_reputation(A.attack_history(spark, d), half_life_s=90 * DAY)
    return out.select("id", "src_ip", "reputation")


@query
def prior_ban(spark, d):
    return BE.prior_ban(A.attack_history(spark, d))


@query
def offence_totals(spark, d):
    return BE.offence_totals(A.attack_history(spark, d))


@query
def priority(spark, d):
    r = A.results(spark, d).withColumn("pps", F.col("pps") * 10).withColumn("reputation", F.col("l_partkey") % 11 * 1.0)
    return BE.with_priority(r).select(*FLOW_ID, r6("priority_score"), "priority")


@query
def entropy_fast_track(spark, d):
    r = A.results(spark, d).withColumn("reputation", F.lit(0.0))
    out = BE.with_priority(r).withColumn("logged_priority", BE.entropy_fast_track(
        F.col("priority"), F.col("l_partkey") % 2 == 0, F.when(F.col("l_partkey") % 3 == 0, "high").otherwise("moderate")))
    return out.select(*FLOW_ID, "priority", "logged_priority")


# --- ledger -----------------------------------------------------------------

from floodwatch.operators import guard as GU  # noqa: E402
from floodwatch.operators import policy as PO  # noqa: E402


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def few_scores(spark, d):
    """Ledger events with three distinct scores, so repeats of a key occur."""
    return A.mitigation_events(spark, d).withColumn("if_score", F.lit(0.4) + (F.col("id") % 3) / 100.0)


@query
def append_mitigation_events(spark, d):
    out = LE.append_mitigation_events(few_scores(spark, d), ttl_s=10 * DAY, slice_s=10 * DAY)
    return out.select("id", "src_ip", "action_taken", "event_type", "is_manual")


@query
def ttl_dedupe(spark, d):
    return LE.ttl_dedupe(few_scores(spark, d), ttl_s=3 * DAY, slice_s=5 * DAY).select("id", "src_ip")


@query
def feed_dedupe(spark, d):
    urgent = F.col("action_taken").startswith("Time Ban") | (F.col("action_taken") == "Blackhole")
    return LE.feed_dedupe(A.mitigation_events(spark, d), force=urgent, ttl_s=DAY / 2, slice_s=5 * DAY).select("id", "src_ip")


@query
def append_manual_action(spark, d):
    m = A.mitigation_events(spark, d).filter("is_manual = 1")
    m = m.withColumn("action", F.when(F.col("id") % 100 == 0, "manual_release").otherwise("manual_block"))
    return LE.manual_action_rows(m).select("id", "src_ip", "predicted_class", "action_taken", "is_manual", "event_type")


def state_changes(spark, d):
    m = A.mitigation_events(spark, d)
    hours = F.expr("make_dt_interval(0, cast(id % 200 as int))")
    return m.select("id", "src_ip", "timestamp", "if_score", "action_taken", "attack_vector",
                    (F.col("action_taken") == "Released").alias("deleted"),
                    FT.phase_number(F.col("phase")).cast("long").alias("phase"),
                    (F.col("id") % 3 != 0).cast("long").alias("permanent"),
                    F.when(F.col("id") % 5 != 0, F.col("timestamp") + hours).alias("block_expires_at"))


@query
def upsert_quarantine_state(spark, d):
    out = LE.latest_state(state_changes(spark, d), order=["timestamp", "id"], deleted="deleted")
    return out.select("src_ip", "id", "action_taken", r6("if_score"))


@query
def restore_states(spark, d):
    s = LE.latest_state(state_changes(spark, d), order=["timestamp", "id"], deleted="deleted")
    out = LE.restore_states(s, ntz("2024-01-31 12:00:00"))
    return out.select("src_ip", "outcome", "command", F.coalesce("ttl", F.lit(-1)).alias("ttl"))


@query
def archive_events(spark, d):
    hot, old = LE.split_archive(A.mitigation_events(spark, d), ntz("2024-01-20 00:00:00"))
    tag = lambda df, name: df.select("id", "src_ip", F.lit(name).alias("store"), "session_id", r6("mitigation_ms"))
    return LE.with_archive(tag(hot, "hot"), tag(old, "archive"))


@query
def append_attack_history(spark, d):
    return LE.history_rows(A.attack_history(spark, d)).select("id", "src_ip", "duration_sec", "if_score", "confidence", "unblock_reason")


@query
def append_system_metrics(spark, d):
    return LE.metrics_rows(A.system_metrics(spark, d))


@query
def dedupe_first(spark, d):
    return RE.report_rows(A.mitigation_events(spark, d)).select("src_ip", "action_taken", "id", "timestamp", "priority")


@query
def phase_history(spark, d):
    hot, old = LE.split_archive(A.mitigation_events(spark, d), ntz("2024-01-29 00:00:00"))
    return RE.phase_history(hot, old).select("src_ip", "phase", "action_taken", "timestamp", "id")


@query
def first_detection_per_phase(spark, d):
    m = A.mitigation_events(spark, d).withColumn("phase_entered", F.floor(F.col("id") / 500).cast("long"))
    return LE.first_detection_per_phase(m).select("src_ip", "phase_entered", "id", "timestamp")


@query
def incident_collapse(spark, d):
    m = A.mitigation_events(spark, d)
    m = (m.withColumn("event_type", F.when(F.col("id") % 4 == 0, "manual").otherwise(F.col("event_type")))
         .withColumn("action_taken", F.when((F.col("event_type") == "manual") & (F.col("id") % 12 == 0), "Manual Release")
                     .otherwise(F.col("action_taken"))))
    return LE.incident_collapse(m, slice_s=SLICE_D).select("src_ip", "event_type", "incident_no", "updates", "id", "action_taken")


@query
def recent_events(spark, d):
    return LE.recent_events(A.mitigation_events(spark, d), limit=500, since=ntz("2024-01-15 00:00:00")).select(
        "id", "timestamp", "src_ip", "confidence", "action_taken", "event_type")


@query
def scan_log(spark, d):
    out = LE.scan_log(A.results(spark, d), [*A.FLOW_ORDER, "l_suppkey"])
    return out.select(*FLOW_ID, "attack_class", "if_score", "is_anomaly")


@query
def active_list(spark, d):
    s = LE.latest_state(state_changes(spark, d), order=["timestamp", "id"], deleted="deleted").withColumn("priority", F.lit("High"))
    cols = ["src_ip", "phase", "if_score", "attack_vector"]
    out = LE.active_list(s.filter("phase > 0").select(*cols, "priority"), s.filter("phase = 0").select(*cols))
    return out.select("src_ip", "phase", r6("if_score"), "priority")


# --- counters and metrics ---------------------------------------------------


def summary(spark, d):
    return ME.traffic_summary(decisions(spark, d), width_s=5 * DAY)


@query
def traffic_summary(spark, d):
    return summary(spark, d)


@query
def traffic_summary_with_holds(spark, d):
    """Sources held for waiting too long, some scored later and some never, next to the decisions."""
    late = A.flows(spark, d).filter("flow_duration_sec > 3 AND ip_proto = 6")
    bit = lambda k: (F.col("l_orderkey") % 3 == k).cast("long")
    holds = late.select((F.col("ts") + F.expr("make_dt_interval(cast(l_orderkey % 4 as int))")).alias("ts"), F.lit(1).cast("long").alias("held"),
                        bit(1).alias("rescored"), bit(2).alias("expired_unscored"))
    return ME.traffic_summary(decisions(spark, d), width_s=5 * DAY, holds=holds)


@query
def if_metrics(spark, d):
    return ME.binary_metrics(ME.in_days(summary(spark, d), "1996-02-01", "1999-12-31"), "if_")


@query
def ml_metrics(spark, d):
    return ME.binary_metrics(ME.in_days(summary(spark, d), "1996-02-01", "1999-12-31"), "")


@query
def class_metrics(spark, d):
    return ME.class_metrics(summary(spark, d))


@query
def confusion_3x3(spark, d):
    return ME.confusion_3x3(summary(spark, d))


@query
def confusion_pivot(spark, d):
    rows = labelled(spark, d).filter((F.col("is_anomaly") == 1) & F.col("expected_class").isNotNull())
    rows = rows.withColumn("predicted", FT.lookup(F.col("attack_class"), FT.SHORT_CLASS)).filter(F.col("predicted").isNotNull())
    return ME.confusion_pivot(rows, "expected_class", "predicted")


@query
def model_accuracy(spark, d):
    return ME.model_accuracy(summary(spark, d))


@query
def session_stats(spark, d):
    rule = F.when(F.col("ip_proto") == 6, 100).otherwise(10)
    drops = FL.drop_delta(A.flows(spark, d).withColumn("rule_priority", rule), [*A.FLOW_ORDER, "l_suppkey"], slice_s=SLICE_FLOW)
    active = LE.latest_state(state_changes(spark, d), order=["timestamp", "id"], deleted="deleted")
    return ME.session_stats(decisions(spark, d), drops, active, "packet_count")


@query
def latency_avg(spark, d):
    return ME.latency_avg(ME.in_days(A.mitigation_events(spark, d), "2024-01-03", "2024-01-27"))


@query
def latency_percentiles(spark, d):
    return ME.latency_percentiles(A.mitigation_events(spark, d), "detection_ms", ["timestamp", "id"])


@query
def system_metrics_avg(spark, d):
    return ME.system_metrics_avg(ME.in_days(A.system_metrics(spark, d), "2024-01-02", "2024-01-20"))


@query
def system_metrics_by_condition(spark, d):
    return ME.system_metrics_by_condition(ME.in_days(A.system_metrics(spark, d), "2024-01-02", "2024-01-20"))


@query
def system_metrics_latest(spark, d):
    return ME.system_metrics_latest(A.system_metrics(spark, d))


@query
def score_distribution(spark, d):
    return ME.score_distribution(A.results(spark, d), [*A.FLOW_ORDER, "l_suppkey"], C.IF_THRESHOLD)


@query
def class_distribution(spark, d):
    return ME.class_distribution(A.results(spark, d), [*A.FLOW_ORDER, "l_suppkey"])


@query
def graph_history(spark, d):
    return ME.graph_history(summary(spark, d), "1996-01-01 00:00:00", "1999-01-01 00:00:00")


# --- reports ----------------------------------------------------------------


@query
def executive_summary(spark, d):
    hot, old = LE.split_archive(A.mitigation_events(spark, d), ntz("2024-01-20 00:00:00"))
    return RE.executive_summary(RE.report_rows(ME.in_days(LE.with_archive(hot, old), "2024-01-05", "2024-01-25")))


@query
def summary_totals(spark, d):
    return RE.summary_totals(ME.in_days(summary(spark, d), "1996-02-01", "1999-12-31"))


@query
def offences_summary(spark, d):
    return RE.offences_summary(ME.in_days(A.attack_history(spark, d), "1996-01-01", "1998-12-31", ts="unblocked_at"))


@query
def chronological_log(spark, d):
    return RE.chronological_log(RE.report_rows(ME.in_days(A.mitigation_events(spark, d), "2024-01-05", "2024-01-25"))).select(
        "timestamp", "src_ip", "attack_vector", "priority", "action_taken")


@query
def history_report(spark, d):
    h = LE.history_rows(ME.in_days(A.attack_history(spark, d), "1996-01-01", "1998-12-31", ts="unblocked_at"))
    return RE.history_report(h).select("id", "src_ip", "if_score", "phase", "offences", "duration", "unblocked_at", "unblock_reason")


@query
def history_dates(spark, d):
    return RE.history_dates(A.attack_history(spark, d))


def as_user_ip(df: DataFrame) -> DataFrame:
    return df.withColumn("src_ip", F.concat(F.lit("10.0"), F.substring("src_ip", 5, 20)))


@query
def ip_dossier(spark, d):
    hot, old = LE.split_archive(A.mitigation_events(spark, d), ntz("2024-01-29 00:00:00"))
    det = as_user_ip(A.flows(spark, d)).withColumn("_seq", F.struct(*SEQ)).withColumn("flow_count_per_src", F.lit(1))
    h = as_user_ip(A.attack_history(spark, d))
    out = RE.ip_dossier(hot, old, det, h, ntz("2002-01-01 00:00:00"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("src_ip", "timestamp", "action_taken", "attack_vector", "phase_no", "priority", zero("packet_count"), zero("byte_count"),
                      "ban_level", "offences", F.round("reputation", 4).alias("reputation"), F.round(F.col("confidence_pct"), 1).alias("confidence_pct"))


@query
def host_status(spark, d):
    m = A.mitigation_events(spark, d)
    hosts = m.groupBy("src_ip").agg(F.min("id").alias("n")).select("src_ip", F.element_at(
        F.array(*[F.lit(r) for r in ("attacker", "legit", "server")]), (F.col("n") % 3 + 1).cast("int")).alias("role"))
    mit = LE.latest_state(state_changes(spark, d), order=["timestamp", "id"], deleted="deleted")
    on = m.filter((F.col("action_taken") == "Blackhole") & (F.col("timestamp") >= ntz("2024-01-30 12:00:00"))).select("src_ip").distinct()
    return RE.host_status(hosts, mit, on)


# --- switch rules and controller load ---------------------------------------


def rule_commands(spark, d):
    e = A.mitigation_events(spark, d)
    action = (F.when(F.col("action_taken") == "Quarantined", "rate_limit").when(F.col("action_taken").startswith("Time"), "block")
              .when(F.col("action_taken") == "Blackhole", "quarantine").when(F.col("action_taken") == "Released", "clear").otherwise("redirect"))
    return e.select("id", "src_ip", F.col("timestamp").alias("ts"), action.alias("action"),
                    F.when(action == "block", 2).cast("long").alias("ttl"))


@query
def resolve_policy(spark, d):
    pk = A.packets(spark, d)
    blocks = pk.select("proto", "ts", (F.col("event_id") % 3 == 0).alias("on"))
    out = PO.resolve_policy(pk, rule_commands(spark, d), slice_s=SLICE_D, unit_s=DAY, proto_blocks=blocks)
    return out.select("event_id", "src_ip", "rule", "outcome")


@query
def resolve_policy_per_switch(spark, d):
    pk = A.packets(spark, d)
    aimed = PO.command_targets(rule_commands(spark, d), pk, slice_s=SLICE_D)
    return PO.resolve_policy(pk, aimed, slice_s=SLICE_D, unit_s=DAY).select("event_id", "src_ip", "rule", "outcome")


@query
def policy_counts(spark, d):
    return PO.policy_counts(PO.resolve_policy(A.packets(spark, d), rule_commands(spark, d), slice_s=SLICE_D, unit_s=DAY))


@query
def command_targets(spark, d):
    return PO.command_targets(rule_commands(spark, d), A.packets(spark, d), slice_s=SLICE_D).select("id", "action", "target_dpid")


def load_readings(spark, d):
    e = A.packets(spark, d)
    m = A.system_metrics(spark, d)
    tier = GU.resource_tier(F.col("ctrl_cpu_percent"), GU.memory_percent(F.col("ctrl_mem_mb")))
    klass = (F.when(F.col("proto") == "ICMP", "ICMP Flood").when(F.col("proto") == "UDP", "UDP Flood"))
    return (m.join(e.select(F.col("event_id").alias("id"), "dpid", "proto"), "id")
            .select(F.col("dpid").alias("controller"), F.col("timestamp").alias("ts"), "id", tier.alias("tier"), klass.alias("attack_class")))


@query
def resource_tier(spark, d):
    return load_readings(spark, d).select("id", "tier")


@query
def guard_transitions(spark, d):
    out = GU.guard_transitions(load_readings(spark, d))
    return out.select("controller", "id", "tier", "consecutive", "throttle_s", "rules_active", F.coalesce("command", F.lit("-")).alias("command"))


# --- mitigation lifecycle ---------------------------------------------------

from floodwatch.operators import lifecycle as LC  # noqa: E402

# one rule second is 1/20 day; reputation halves every 20 days
LIFE_RULES = C.LifecycleRules(unit_s=DAY / 20, half_life_s=400.0)


def lifecycle_input(spark, d):
    """Results with the confidence lock applied, flood trips, stale flows held back, and the operators' actions."""
    r = A.results(spark, d).withColumn("id", F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey") % 100000)
    scored = FU.confidence_lock(r, A.FLOW_ORDER, slice_s=SLICE_FLOW)
    scored = scored.withColumn("attack_class", F.col("locked_class")).withColumn("confidence", F.col("locked_confidence"))
    trips = as_flow_ip(X.flood_trips(A.packets(spark, d), A.FLOOD_RULES).select("src_ip", F.col("trip_ts").alias("ts"), F.col("trip_event_id").alias("id"), "correlated"))
    holds = FL.staleness_gate(r.withColumn("flag", F.col("ip_proto") == 6), wait_s="flow_duration_sec", flagged="flag").filter("route = 'hold'").select("src_ip", "ts", "id")
    manual = as_flow_ip(A.mitigation_events(spark, d).filter("is_manual = 1").select(
        "src_ip", F.col("timestamp").alias("ts"), "id", F.when(F.col("id") % 100 == 0, "release").otherwise("block").alias("action")))
    return (LC.result_events(scored).unionByName(LC.trip_events(trips, "ts"))
            .unionByName(LC.hold_events(holds)).unionByName(LC.manual_events(manual)))


def lifecycle_rows(spark, d):
    return LC.mitigation_lifecycle(lifecycle_input(spark, d), LIFE_RULES)


LIFE_COLUMNS = ["src_ip", "seq", "row", "from_phase", "to_phase", "action", "event_type", "reason", "command", "priority",
                "ban_level", "offence_count", "session_id", "offence_recorded"]


@query
def mitigation_lifecycle(spark, d):
    return lifecycle_rows(spark, d).select(LC.when().alias("ts"), *LIFE_COLUMNS)


@query
def sinkhole_observation(spark, d):
    rows = lifecycle_rows(spark, d)
    return rows.filter((F.col("from_phase") == "Sinkhole") | (F.col("to_phase") == "Sinkhole")).select(
        LC.when().alias("ts"), "src_ip", "seq", "from_phase", "to_phase", "action", "reason")


@query
def compact_results(spark, d):
    return LC.compact_results(lifecycle_input(spark, d), LIFE_RULES).select("src_ip", "us", "rank", "id", "kind", "anomalies")


@query
def emit_commands(spark, d):
    return LC.commands(lifecycle_rows(spark, d))


@query
def lifecycle_ledger(spark, d):
    return LC.ledger_rows(lifecycle_rows(spark, d)).select("src_ip", "timestamp", "id", "action_taken", "phase", "event_type", "session_id")


@query
def lifecycle_offences(spark, d):
    return LE.history_rows(LC.offence_rows(lifecycle_rows(spark, d))).select(
        "src_ip", "id", "phase_reached", "ban_level", "offence_count", "duration_sec", "unblock_reason")


@query
def hold_stats(spark, d):
    return LC.hold_stats(lifecycle_rows(spark, d))


# --- models and end-to-end plans --------------------------------------------

from floodwatch.models import iforest as IFO  # noqa: E402
from floodwatch.models import scaling as SC  # noqa: E402
from floodwatch.models.rf import ClassTrees  # noqa: E402
from floodwatch.plans import detect as DE  # noqa: E402
from floodwatch.plans.stage import cut  # noqa: E402

FLOW_KEY = ["src_ip", "l_orderkey", "l_linenumber", "l_partkey"]


def labelled_flows(spark, d):
    """Every flow with its count and whether an attack was on, written once and narrow: all passes of a fit, and the scoring after it, read these rows."""
    f = FU.label_with_ground_truth(counted_flows(spark, d), A.gt_intervals(spark, d), slice_s=SLICE_FLOW)
    return FL.flow_rates(cut(f.select(*FLOW_KEY, "is_attacker", *FT.INPUTS), "training"))


def split_training(labelled):
    """Flows outside and inside ground-truth attacks; the protocol gives the class."""
    klass = F.when(F.col("ip_proto") == 6, "SYN Flood").when(F.col("ip_proto") == 1, "ICMP Flood").otherwise("UDP Flood")
    return labelled.filter("NOT is_attacker"), labelled.filter("is_attacker").withColumn("attack_class", klass)


def training(spark, d):
    return split_training(labelled_flows(spark, d))


TRAINED: dict[tuple[str, str], DE.Models] = {}


def models_and_flows(spark, d):
    """Models, trained once per session and table set like any model, and the counted flows to score: after a training the rows it has written."""
    key = (spark.sparkContext.applicationId, d)
    if key in TRAINED:
        return TRAINED[key], counted_flows(spark, d)
    rows = labelled_flows(spark, d)
    normal, attacks = split_training(rows)
    TRAINED[key] = DE.train(normal, attacks, FLOW_KEY, trees=50, quantile=0.9)
    return TRAINED[key], rows


@query
def fit_apply_scaling(spark, d):
    normal, _ = training(spark, d)
    x = DE.with_features(normal)
    return SC.apply_scaling(x, SC.fit_scaling(x, DE.IF_COLUMNS)).select(*FLOW_KEY, "scaled")


FIXED_COLUMNS = ("packet_count", "byte_count", "tp_dst")


def fixed_scaling():
    """A hand-written map: packets 1-50, bytes 0-100000, ports 0-1000, straight between three points."""
    centre, scale = np.array([25.0, 50000.0, 500.0]), np.array([25.0, 50000.0, 500.0])
    return SC.Scaling(FIXED_COLUMNS, centre, scale, np.array([[-1.0] * 3, [0.0] * 3, [1.0] * 3]))


def fixed_forest():
    """Two hand-written trees over the scaled columns, as if grown from 256 rows."""
    a = lambda *x: np.array(x)
    return IFO.Forest(FIXED_COLUMNS, fixed_scaling(), 256, [a(0, -1, 1, -1, -1), a(2, 0, -1, -1, -1)],
                      [a(0.5, 0.0, 0.9, 0.0, 0.0), a(0.3, 0.8, 0.0, 0.0, 0.0)], [a(1, -1, 3, -1, -1), a(1, 3, -1, -1, -1)],
                      [a(2, -1, 4, -1, -1), a(2, 4, -1, -1, -1)], [a(0.0, 9.5, 0.0, 7.25, 3.0), a(0.0, 0.0, 8.0, 10.0, 2.5)])


@query
def apply_scaling(spark, d):
    out = SC.apply_scaling(A.flows(spark, d), fixed_scaling())
    return out.select(*FLOW_KEY, *[F.round(F.col("scaled")[k], 6).alias(f"scaled_{c}") for k, c in enumerate(FIXED_COLUMNS)])


@query
def forest_score(spark, d):
    """A forest that SQL can follow; the trained one is scored by isolation_forest_score."""
    out = IFO.score_forest(A.flows(spark, d), fixed_forest(), 0.6)
    return out.select(*FLOW_KEY, r6("if_score"), "is_anomaly")


@query
def isolation_forest_score(spark, d):
    m, flows = models_and_flows(spark, d)
    out = IFO.score_forest(DE.with_features(flows, m.means), m.forest, m.threshold)
    return out.select(*FLOW_KEY, "if_score", "is_anomaly")


@query
def cascade(spark, d):
    from floodwatch.models.rf import cascade as run
    m, flows = models_and_flows(spark, d)
    out = run(DE.with_features(flows, m.means), m.forest, m.classes, threshold=m.threshold, keep=FLOW_KEY)
    return out.select(*FLOW_KEY, "if_score", "is_anomaly", "attack_class", "confidence")


def fixed_classes():
    """Three hand-written trees: two by protocol, one by packet size."""
    by_proto = ("rf_ip_proto", 3.0, (0.9, 0.05, 0.05), ("rf_ip_proto", 10.0, (0.05, 0.85, 0.1), (0.0, 0.0, 1.0)))
    by_size = ("rf_avg_bytes_per_pkt", 1500.0, (0.1, 0.8, 0.05), (0.7, 0.1, 0.2))
    return ClassTrees((by_proto, by_proto, by_size))


def fixed_models():
    return DE.Models(fixed_forest(), fixed_classes(), 0.58, {})


def sampled_flows(spark, d):
    """Flow samples as a switch sends them: a third without protocol and ports, some young, some that waited too long."""
    bare = F.col("l_partkey") % 3 == 0
    return (counted_flows(spark, d).drop(*FL.RATES, "l_suppkey", "l_discount", "l_tax")
            .withColumns({"flow_duration_sec": F.col("flow_duration_sec") - 1, "wait_s": (F.col("l_orderkey") % 5).cast("double"),
                          **{c: F.when(bare, 0).otherwise(F.col(c)).cast("long") for c in ("ip_proto", "tp_src", "tp_dst")}}))


def known_phases(spark, d):
    return A.flows(spark, d).filter("l_partkey % 40 = 0").select("src_ip", "ts", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_orderkey") % 4).cast("int").alias("phase"))


def came_packets(spark, d):
    return as_flow_ip(A.packets(spark, d)).withColumns({"tp_src": F.col("event_id") % 65536, "tp_dst": F.col("event_id") % 1024})


def detection_parts(spark, d):
    return DE.detect_parts(sampled_flows(spark, d), came_packets(spark, d), fixed_models(), order=A.FLOW_ORDER, states=known_phases(spark, d), wait="wait_s",
                           poll_of=F.datediff("ts", F.lit("1995-01-01")).cast("long"), poll_s=0.01, tick_s=DAY, slice_s=SLICE_FLOW, unit_s=3 * DAY,
                           flood=A.FLOOD_RULES, streak=3, low_floor=2.0, whitelist=("10.1.0.7",))


def detections(spark, d):
    return detection_parts(spark, d)["detections"]


def as_flow_ip(df: DataFrame) -> DataFrame:
    """Packets of users as packets of the sources that carry flows, 8400 days earlier, in the flows' period."""
    return (df.withColumn("src_ip", F.concat(F.lit("10.1"), F.substring("src_ip", 5, 20)))
            .withColumn("ts", F.col("ts") - F.expr("make_dt_interval(8400)")))


@query
def detect(spark, d):
    return detections(spark, d).select(*FLOW_KEY, "ts", "flagged", "low_rate", r6("if_score"), "is_anomaly", "attack_class", r6("confidence"), "ip_proto", "disp_pakt",
                                       r6("switch_delta_pps"), "ip_verdict", F.coalesce("phase", F.lit(-1)).alias("phase"), "tea_attack_pattern", "tea_confidence",
                                       "tea_is_learned", "priority", "logged_priority")


@query
def tick_locks(spark, d):
    """Which ticks begin with locked baselines, by given scores."""
    r = TE.with_tick(A.results(spark, d), DAY)
    return FU.tick_locks(r.filter("l_partkey % 50 = 0"), r.select("scope", "tick_ts"), [*A.FLOW_ORDER, "l_suppkey"], streak=3).select("tick_ts", "locked")


@query
def cascade_literal(spark, d):
    """The two stages with models that SQL can follow."""
    from floodwatch.models.rf import cascade as run
    slow = FL.low_rate_gate(FT.rf_features(counted_flows(spark, d)), floor=2.0)
    out = run(slow, fixed_forest(), fixed_classes(), threshold=0.58, low_rate="low_rate", keep=[*FLOW_KEY, "flow_count_per_src"])
    return out.select(*FLOW_KEY, r6("if_score"), "is_anomaly", "attack_class", r6("confidence"))


@query
def respond(spark, d):
    det = detections(spark, d).withColumn("id", F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey") % 100000)
    trips = X.flood_trips(as_flow_ip(A.packets(spark, d)), A.FLOOD_RULES).withColumn("id", F.col("trip_event_id"))
    return DE.respond(det, trips, rules=LIFE_RULES).select(LC.when().alias("ts"), *LIFE_COLUMNS)


@query
def evaluate(spark, d):
    out = DE.evaluate(A.results(spark, d), A.gt_intervals(spark, d), slice_s=SLICE_FLOW, width_s=5 * DAY)
    return out["confusion"].drop("micro")


def _evaluated(section: str, *drop: str):
    def run(spark, d):
        return DE.evaluate(A.results(spark, d), A.gt_intervals(spark, d), slice_s=SLICE_FLOW, width_s=5 * DAY)[section].drop(*drop)
    run.__name__ = f"evaluate_{section}"
    return query(run)


for _section in ("traffic_summary", "class_metrics", "accuracy"):
    _evaluated(_section)


@query
def evaluate_decisions(spark, d):
    out = DE.evaluate(A.results(spark, d), A.gt_intervals(spark, d), slice_s=SLICE_FLOW, width_s=5 * DAY)["decisions"]
    return out.select(*FLOW_ID, *[c for c in ME.COUNTERS if c not in ME.HOLD_COUNTERS])


@query
def evaluate_if_metrics(spark, d):
    return DE.evaluate(A.results(spark, d), A.gt_intervals(spark, d), slice_s=SLICE_FLOW, width_s=5 * DAY)["if_metrics"]


@query
def report_ranges(spark, d):
    """Requests for reports, judged: some malformed, some reversed, some in the future."""
    day = lambda shift: F.date_format(F.col("ts") + F.expr(f"make_dt_interval(cast({shift} as int))"), "yyyy-MM-dd")
    e = A.packets(spark, d)
    asked = e.select("event_id", F.when(F.col("event_id") % 11 == 0, F.concat(day("0"), F.lit("x"))).otherwise(day("0")).alias("start"), day("event_id % 7 - 2").alias("end"))
    return asked.select("event_id", "start", "end", F.coalesce(RE.report_range_error(F.col("start"), F.col("end"), F.lit("2024-01-25").cast("date")), F.lit("ok")).alias("answer"))


@query
def incident_report(spark, d):
    hot, old = LE.split_archive(A.mitigation_events(spark, d), ntz("2024-01-20 00:00:00"))
    out = DE.incident_report("2024-01-05", "2024-01-25", events=hot, archive=old, summary=summary(spark, d),
                             system=A.system_metrics(spark, d), history=A.attack_history(spark, d))
    return out["log"].select("timestamp", "src_ip", "action_taken", "attack_vector")


@query
def snapshot_states(spark, d):
    """One section of the live view; what the others need is planned, and runs for whoever reads them."""
    rows = lifecycle_rows(spark, d)
    out = DE.snapshot(ntz(NOW), results=A.results(spark, d), order=[*A.FLOW_ORDER, "l_suppkey"],
                      trips=X.flood_trips(A.packets(spark, d), A.FLOOD_RULES), verdicts=verdicts(spark, d, written=False), lifecycle_rows=rows,
                      latencies=A.mitigation_events(spark, d), latency_col="detection_ms", latency_order=["timestamp", "id"])
    return out["states"]


@query
def choose_threshold(spark, d):
    return IFO.score_quantile(A.results(spark, d).filter("is_anomaly = 0"), 0.95).select(r6("threshold"))


@query
def parse_telemetry(spark, d):
    """Packets as JSON messages between malformed lines, parsed and split again."""
    from floodwatch.sources import telemetry as S
    pk = A.packets(spark, d).withColumn("type", F.lit("packet_in")).withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    text = F.to_json(F.struct("type", "ts", "dpid", "src_ip", "dst_ip", "proto", "tcp_flags_syn", "tcp_flags_ack"))
    lines = pk.select(F.explode(F.array(text, F.concat(F.lit("{"), F.col("src_ip")))).alias("value"))
    return S.split_telemetry(S.parse_telemetry(lines))["packet_in"].drop("ts")


@query
def parse_telemetry_types(spark, d):
    """All four message types as JSON between malformed lines, parsed and split, with their times."""
    from floodwatch.sources import telemetry as S
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts")
    pk, fl = A.packets(spark, d), A.flows(spark, d)
    texts = [
        pk.select(F.to_json(F.struct(F.lit("packet_in").alias("type"), seconds, "dpid", "src_ip", "dst_ip", "proto", "tcp_flags_syn", "tcp_flags_ack")).alias("value")),
        S.nest_flows(fl).select(F.to_json(F.struct(F.lit("flow_stats").alias("type"), seconds, "dpid", "src_ip", "flow_stats")).alias("value")),
        fl.select(F.to_json(F.struct(F.lit("dropped_delta").alias("type"), seconds, "src_ip", (F.col("packet_count") - 25).alias("delta"))).alias("value")),
        fl.groupBy("ts").agg(F.countDistinct("dpid").alias("connected")).select(F.to_json(F.struct(F.lit("switch_count").alias("type"), seconds, "connected")).alias("value"))]
    lines = reduce(DataFrame.unionByName, texts).select(F.explode(F.array("value", F.concat(F.lit("{"), F.col("value")), F.lit('{"type": "unheard_of"}'))).alias("value"))
    # four tables are split from the messages: written, so that each line is parsed once
    parts = S.split_telemetry(cut(S.parse_telemetry(lines), "messages"))
    none = F.lit("-")
    same = {"packet_in": ("src_ip", F.lit(0)), "flow_stats": ("src_ip", F.col("flow_stats.packet_count")), "dropped_delta": ("src_ip", F.col("delta")), "switch_count": (none, F.col("connected"))}
    return reduce(DataFrame.unionByName, [parts[k].select(F.lit(k).alias("type"), F.col("ts").cast("timestamp_ntz").alias("ts"), (F.col(src) if isinstance(src, str) else src).alias("src_ip"),
                                                           n.cast("long").alias("n")) for k, (src, n) in same.items()])
