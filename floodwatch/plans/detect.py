"""End to end: detect, respond, evaluate, report, snapshot."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodwatch import config as C
from floodwatch.models.iforest import Forest, choose_threshold, fit_forest, score_forest
from floodwatch.models.rf import ClassTrees, fit_classes, predict_classes, split_by_score
from floodwatch.models.scaling import fit_scaling
from floodwatch.plans.slices import SLICE, asof_join, with_slice
from floodwatch.plans.stage import cut
from floodwatch.sources.telemetry import load_contract
from floodwatch.operators import (behavior, features, flows as flow_ops, fusion, ledger, lifecycle, metrics,
                                  packets as packet_ops, prefilter, reports, tea)

IF_COLUMNS = tuple(f"if_{n}" for n in C.IF_FEATURES)
RF_COLUMNS = tuple(f"rf_{n}" for n in C.RF_FEATURES)


@dataclass
class Models:
    forest: Forest
    classes: PipelineModel | ClassTrees
    threshold: float
    means: dict[str, float]
    gate: float = C.RF_CONFIDENCE_GATE


def check_contract(contract: dict) -> dict:
    """The contract a model is fitted to; its features must be the ones computed here, in this order."""
    for names, ours in (("if_features", C.IF_FEATURES), ("rf_features", C.RF_FEATURES), ("class_names", C.CLASS_NAMES)):
        if list(contract[names]) != list(ours):
            raise ValueError(f"{names} of the contract are not those computed here")
    return contract


def with_features(flows: DataFrame, means: dict[str, float] | None = None) -> DataFrame:
    """Both models' features; gaps are filled by fitted means, or by the table's own while fitting."""
    rows = features.if_features(flows)
    return features.rf_features(features.impute_with(rows, means) if means else features.impute_nonfinite(rows, IF_COLUMNS))


def train(normal: DataFrame, attacks: DataFrame, ids: Sequence[str], *, trees: int = 100, sample: int = 256,
          quantile: float = 0.99, seed: int = 7, contract: str | None = None) -> Models:
    """Fit scaling and forest on normal flows, classes on labelled attacks, threshold on normal scores.

    The features are cheap beside the space they take, so each pass computes them anew:
    give written tables (:func:`floodwatch.plans.stage.cut`) where flows are costly.
    ``contract`` names a JSON file of feature order, classes, threshold and gate; its threshold and gate are then used.
    """
    terms = check_contract(load_contract(contract))
    means = features.fit_means(features.if_features(normal), IF_COLUMNS)
    calm = with_features(normal, means)
    forest = fit_forest(calm, IF_COLUMNS, ids, trees=trees, sample=sample, seed=seed, scaling=fit_scaling(calm, IF_COLUMNS))
    threshold = float(terms["threshold"]) if contract else choose_threshold(score_forest(calm, forest, 1.0), quantile)
    return Models(forest, fit_classes(features.rf_features(attacks), RF_COLUMNS, trees=30, seed=seed), threshold, means, float(terms["confidence_gate"]))


def gate(flows: DataFrame, packets: DataFrame, *, order: Sequence[str], states: DataFrame | None = None, wait: str | None = None,
         tick_s: float = C.TICK_S, slice_s: float = 3600.0, flood: C.FloodRules = C.FloodRules(), stale_s: float = C.STALE_S) -> DataFrame:
    """Flow samples as the scorer meets them, every source still there.

    Young flows go. Protocol and ports that a flow does not know come from the
    packets (ports where the packets carry them). Added: rates, ``scope`` and ``tick_ts``, ``flagged`` (the source is in a
    flagged episode), the source's own profile (``ip_verdict``), its ``phase`` (latest of ``states``: src_ip, ts, id, phase; else null),
    and ``route``: score, hold or drop, by the seconds in ``wait``.

    Addresses, flags, profiles and phases are scans of the same slices of a source: the flows are shuffled once, for the first of them.
    """
    known = {"tp_src", "tp_dst"} <= set(packets.columns)
    f = flow_ops.young_flow_gate(flows.filter("packet_count > 0"))
    if "flow_count_per_src" not in f.columns:
        f = flow_ops.flow_count_per_src(f, order)
    f = packet_ops.resolve_addresses(with_slice(f, "ts", slice_s), packets, slice_s=slice_s, ports=known)
    f = f.withColumn("ip_proto", F.col("resolved_proto"))
    if known:
        f = f.withColumns({own: F.coalesce(F.when(F.col(own) != 0, F.col(own)), F.col(seen)) for own, seen in (("tp_src", "port_src"), ("tp_dst", "port_dst"))})
    f = tea.with_tick(flow_ops.flow_rates(f.drop("resolved_proto", "port_src", "port_dst")), tick_s)
    # a few rows from a long plan: written, so that the scan below, which reads both sides twice, does not repeat it
    flags = cut(prefilter.flag_intervals(packets, flood, pop_acks=True), "flags")
    f = fusion.attach_prefilter_flag(f, flags, slice_s=slice_s, dealt=True)
    f = tea.ip_profile_verdict(f, list(order), slice_s=slice_s, dealt=True)
    if states is not None:
        f = asof_join(f, states.withColumnRenamed("ts", "_since"), ["src_ip"], left_ts="ts", right_ts="_since", cols=["phase"], width_s=slice_s, right_tie="id", dealt=True)
    else:
        f = f.withColumn("phase", F.lit(None).cast("int"))
    f = f.drop(SLICE)
    return flow_ops.staleness_gate(f, wait_s=wait, flagged="flagged", limit_s=stale_s) if wait else f.withColumn("route", F.lit("score"))


def switch_statistics(gated: DataFrame, packets: DataFrame, poll_of: Column | None = None, *, poll_s: float = 1.0) -> DataFrame:
    """Per (switch, poll) totals and packet rate; ``poll_of`` tells a packet's poll, and packets per second bound the rate from below."""
    came = packets.select("dpid", poll_of.alias("poll_id")) if poll_of is not None else None
    stats = flow_ops.switch_poll_stats(gated, came, poll_s)
    stats = flow_ops.switch_delta_pps(stats, ts="poll_id", rate_in="rate_pkt_in" if came is not None else None)
    return stats.withColumnRenamed("dominant_proto", "ip_proto")


def detect_parts(flows: DataFrame, packets: DataFrame, models: Models, *, order: Sequence[str], history: DataFrame | None = None,
                 states: DataFrame | None = None, wait: str | None = None, poll_of: Column | None = None, poll_s: float = 1.0,
                 tick_s: float = C.TICK_S, slice_s: float = 3600.0, unit_s: float = 1.0, flood: C.FloodRules = C.FloodRules(),
                 half_life_s: float = C.HALF_LIFE_S, stale_s: float = C.STALE_S, streak: int = C.UNLOCK_STREAK,
                 low_floor: float = C.LOW_RATE_FLOOR, whitelist=C.WHITELIST) -> dict[str, DataFrame]:
    """``detections``, ``held`` flows (flagged and stale) and the ticks' ``verdicts``.

    Scores do not depend on verdicts, so the feedback is acyclic: score, tell per
    tick whether the anomalies so far lock the baselines, then fold the ticks.
    Written are the flagged episodes, the gated flows (read for snapshots, switches and
    scoring) and the scores, both without what follows from their other columns (rates, features), and two small tables,
    polls of the switches and verdicts, which are joined to the flows: where they are small no flow is shuffled for them.
    What is carried and locked concerns the anomalous rows alone, which are shuffled once for both.
    """
    gated = gate(flows, packets, order=order, states=states, wait=wait, tick_s=tick_s, slice_s=slice_s, flood=flood, stale_s=stale_s)
    gated = flow_ops.flow_rates(cut(gated.drop(*flow_ops.RATES), "gated"))
    usable = packet_ops.filter_scoreable(gated, whitelist)
    rows = flow_ops.low_rate_gate(usable.filter("route = 'score'"), floor=low_floor, flagged="flagged")

    def anomaly_features(df: DataFrame) -> DataFrame:
        """By the flow's own protocol, whatever its switch says."""
        df = features.if_features(df.withColumns({"_merged_proto": F.col("ip_proto"), "ip_proto": F.col("_own_proto")}))
        df = features.impute_with(df, models.means) if models.means else features.impute_nonfinite(df, IF_COLUMNS, of=features.if_features(rows))
        return df.withColumn("ip_proto", F.col("_merged_proto")).drop("_merged_proto")

    stats = cut(switch_statistics(gated, packets, poll_of, poll_s=poll_s), "switches")
    merged = flow_ops.merge_switch_flow(rows.withColumn("_own_proto", F.col("ip_proto")), stats)
    keep = [c for c in merged.columns if c not in flow_ops.RATES]
    hits, calm = (flow_ops.flow_rates(part) for part in split_by_score(anomaly_features(merged), models.forest, threshold=models.threshold, low_rate="low_rate", keep=keep))
    named = predict_classes(features.rf_features(hits), models.classes, models.gate).drop(*RF_COLUMNS)
    named = fusion.carry_prior_class(named, ttl_s=C.INFERENCE_TTL_S * unit_s, slice_s=slice_s, keep_slice=True)
    named = named.drop("attack_class", "confidence").withColumnsRenamed({"carried_class": "attack_class", "carried_confidence": "confidence"})
    named = fusion.confidence_lock(named, order, slice_s=slice_s, dealt=True).drop(SLICE)
    named = named.drop("attack_class", "confidence").withColumnsRenamed({"locked_class": "attack_class", "locked_confidence": "confidence"})
    fed = calm.filter("NOT low_rate").select("scope", "tick_ts", *order, "is_anomaly").unionByName(hits.select("scope", "tick_ts", *order, "is_anomaly"))
    locks = fusion.tick_locks(fed, gated.select("scope", "tick_ts"), order, streak=streak)
    verdicts = cut(tea.tea_verdict(tea.tea_snapshot(gated, tick_s=tick_s), locks), "verdicts")
    out = fusion.attach_tea_by_tick(named.unionByName(calm), verdicts, profile="ip_verdict", phase="phase").withColumn("pps", F.col("packet_count_per_second"))
    out = behavior.attach_reputation(out, history, half_life_s=half_life_s) if history is not None else out.withColumn("reputation", F.lit(0.0))
    out = behavior.with_priority(out)
    out = out.withColumn("logged_priority", behavior.entropy_fast_track(F.col("priority"), F.col("tea_attack_pattern"), F.col("tea_confidence")))
    # the features of the anomalous rows, computed where they are read
    out = features.rf_features(anomaly_features(out)).drop("_own_proto")
    out = out.withColumns({c: F.when(F.col("is_anomaly") == 1, F.col(c)) for c in (*IF_COLUMNS, *RF_COLUMNS)})
    return {"detections": out, "held": usable.filter("route = 'hold'"), "verdicts": verdicts}


def detect(flows: DataFrame, packets: DataFrame, models: Models, **settings) -> DataFrame:
    """Flow samples and packets to scored, classified and prioritised results; settings as in :func:`detect_parts`.

    ``order`` lists the columns that order a source's samples, time first.
    """
    return detect_parts(flows, packets, models, **settings)["detections"]


def respond(detections: DataFrame, trips: DataFrame | None = None, *, rules: C.LifecycleRules = C.LifecycleRules(),
            holds: DataFrame | None = None, manual: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """Drive every source's mitigation from detections, trips and operator actions."""
    events = lifecycle.result_events(detections)
    for df, make in ((trips, lifecycle.trip_events), (holds, lifecycle.hold_events),
                     (manual, lifecycle.manual_events), (history, lifecycle.history_events)):
        if df is not None:
            events = events.unionByName(make(df))
    return lifecycle.mitigation_lifecycle(events, rules)


def evaluate(detections: DataFrame, intervals: DataFrame, *, slice_s: float = 3600.0, width_s: float = 5.0) -> dict[str, DataFrame]:
    """Score detections against ground truth."""
    scored = fusion.score_decisions(fusion.label_with_ground_truth(detections, intervals, slice_s=slice_s))
    summary = metrics.traffic_summary(scored, width_s=width_s)
    return {"decisions": scored, "traffic_summary": summary, "if_metrics": metrics.binary_metrics(summary, "if_"),
            "class_metrics": metrics.class_metrics(summary), "confusion": metrics.confusion_3x3(summary),
            "accuracy": metrics.model_accuracy(summary)}


def incident_report(start: str, end: str, *, events: DataFrame, archive: DataFrame, summary: DataFrame,
                    system: DataFrame, history: DataFrame) -> dict[str, DataFrame]:
    """The report's sections as named tables."""
    start, end = reports.validate_report_range(start, end)
    in_range = metrics.in_days(ledger.with_archive(events, archive), start, end)
    rows = reports.report_rows(in_range)
    window = metrics.in_days(summary, start, end)
    past = metrics.in_days(history, start, end, ts="unblocked_at")
    return {
        "executive_summary": reports.executive_summary(rows), "if_metrics": metrics.binary_metrics(window, "if_"),
        "traffic_totals": window.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("total", "true_neg", "fp")]),
        "class_metrics": metrics.class_metrics(window), "confusion": metrics.confusion_3x3(window),
        "latency": metrics.latency_avg(metrics.in_days(events, start, end)),
        "controller_load": metrics.system_metrics_by_condition(metrics.in_days(system, start, end)),
        "offences": reports.offences_summary(past), "log": reports.chronological_log(rows),
        "history": reports.history_report(ledger.history_rows(past)),
    }


def snapshot(as_of: Column, *, results: DataFrame, order: Sequence[str], trips: DataFrame, verdicts: DataFrame,
             lifecycle_rows: DataFrame, latencies: DataFrame, latency_col: str, latency_order: Sequence[str]) -> dict[str, DataFrame]:
    """The live view at a moment: latency, distributions, prefilter, verdict, states, holds."""
    seen = results.filter(F.col("ts") <= as_of)
    rows = lifecycle_rows.filter(lifecycle.when() <= as_of)
    newest = F.max_by(F.struct("tick_ts", "is_learned", "is_attack_pattern", "confidence", "size_zscore"), "tick_ts")
    # the last transition of each source says where it is
    states = (rows.filter(F.col("row").isin("event", "detected")).groupBy("src_ip")
              .agg(F.max_by(F.struct("to_phase", "action", "priority", "if_score", "ban_level"), "seq").alias("s"))
              .select("src_ip", "s.*").filter(F.col("to_phase") != "None"))
    return {
        "latency": metrics.latency_percentiles(latencies, latency_col, latency_order),
        "scores": metrics.score_distribution(seen, order, C.IF_THRESHOLD), "classes": metrics.class_distribution(seen, order),
        "prefilter": prefilter.prefilter_breakdown(trips.filter(F.col("trip_ts") <= as_of)),
        "verdict": verdicts.filter(F.col("tick_ts") <= as_of).groupBy("scope").agg(newest.alias("v")).select("scope", "v.*"),
        "states": states, "holds": lifecycle.hold_stats(rows),
    }
