"""Flood prefilter: sliding counts, trips, latched episodes, multi-vector sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodwatch import config as C
from floodwatch.operators.ack_replay import count_remembered
from floodwatch.operators.packets import classify_packet, filter_scoreable
from floodwatch.plans.slices import (OWN, SLICE, asof_join, micros, null_safe_join, sliding_counts,
                                     with_halo, with_slice)


def counted_packets(packets: DataFrame) -> DataFrame:
    """Packets the prefilter remembers: pure SYN, ICMP, UDP from scoreable sources."""
    return (filter_scoreable(classify_packet(packets))
            .filter(F.col("flood_proto").isin(*C.FLOOD_PROTOCOLS)))


def _per_protocol(values: dict) -> Column:
    out = F.when(F.col("flood_proto") == C.FLOOD_PROTOCOLS[0], values[C.FLOOD_PROTOCOLS[0]])
    for p in C.FLOOD_PROTOCOLS[1:]:
        out = out.when(F.col("flood_proto") == p, values[p])
    return out


def _sliced_windows(packets: DataFrame, rules: C.FloodRules) -> DataFrame:
    """:func:`flood_windows` with the slice kept, clustered by (source, slice)."""
    width = max(rules.slice_s, rules.window_s)
    rows = with_halo(counted_packets(packets).withColumn("_us", micros("ts")), "ts", rules.window_s, width)
    spans = {"window": rules.window_s, "short": rules.burst_windows_s[0], "long": rules.burst_windows_s[1]}
    counts = {f"_{name}_{p}": (F.col("flood_proto") == p, seconds)
              for name, seconds in spans.items() for p in C.FLOOD_PROTOCOLS}
    out = sliding_counts(rows, ["src_ip"], "_us", counts, width).filter(OWN)
    own = lambda name: _per_protocol({p: F.col(f"_{name}_{p}") for p in C.FLOOD_PROTOCOLS})
    active = [(F.col(f"_window_{p}") > 0).cast("int") for p in C.FLOOD_PROTOCOLS]
    return (out.withColumn("n_window", own("window")).withColumn("n_burst_short", own("short"))
            .withColumn("n_burst_long", own("long")).withColumn("active_protocols", sum(active[1:], active[0]))
            .withColumn("_syn_active", active[C.FLOOD_PROTOCOLS.index("SYN")])
            .drop(OWN, *counts))


def flood_windows(packets: DataFrame, rules: C.FloodRules = C.FloodRules()) -> DataFrame:
    """Counts of the packet's own protocol in the window and both burst windows.

    Also ``active_protocols``: protocols of the source with a packet inside the
    window. Bounds are inclusive; packets with equal times see each other.
    Counts look back one window, so each time slice of a source is counted on
    its own with a one-window halo.
    """
    return _sliced_windows(packets, rules).drop(SLICE, "_us", "_syn_active")


def flood_episodes(sliced: DataFrame, rules: C.FloodRules) -> DataFrame:
    """Add ``episode_start``: a source's run of packets with no idle gap over the limit.

    ``sliced`` carries ``_slice`` and ``_us``. Gaps inside a slice are found
    there; the first row of a slice looks at the slices before through one
    summary row per (source, slice).
    """
    idle_us = int(round(rules.idle_s * 1e6))
    here = Window.partitionBy("src_ip", SLICE).orderBy("ts", "event_id")
    gap = F.col("_us") - F.lag("_us").over(here)
    rows = sliced.withColumn("_start", F.when(gap > idle_us, F.col("ts")))
    summary = rows.groupBy("src_ip", SLICE).agg(
        F.min("_us").alias("_lo"), F.max("_us").alias("_hi"), F.min("ts").alias("_first"),
        F.max("_start").alias("_inner"))
    slices = Window.partitionBy("src_ip").orderBy(SLICE)
    fresh = F.col("_lo") - F.lag("_hi").over(slices)
    summary = summary.withColumn("_head", F.when(fresh.isNull() | (fresh > idle_us), F.col("_first")))
    before = slices.rowsBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce("_head", F.last(F.coalesce("_inner", "_head"), ignorenulls=True).over(before))
    summary = summary.select("src_ip", SLICE, carried.alias("_carried"))
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    return (null_safe_join(rows, summary, ["src_ip", SLICE])
            .withColumn("episode_start", F.coalesce(
                F.last("_start", ignorenulls=True).over(upto), F.col("_carried")))
            .drop("_start", "_carried"))


def _reason(rules: C.FloodRules) -> Column:
    limit = _per_protocol(rules.limits)
    burst = _per_protocol({p: rules.burst_limit(p) for p in C.FLOOD_PROTOCOLS})
    short, long_ = rules.burst_windows_s

    def text(kind: str, count: str, bound: Column, seconds: float) -> Column:
        return F.concat(F.lit(f"{kind}="), F.col(count).cast("string"), F.lit(">="),
                        bound.cast("string"), F.lit(f" in {seconds}s"))

    return (F.when(F.col("n_window") >= limit, text("limit", "n_window", limit, rules.window_s))
            .when(F.col("n_burst_short") >= burst, text("burst", "n_burst_short", burst, short))
            .when(F.col("n_burst_long") >= burst, text("burst", "n_burst_long", burst, long_)))


def _latch(rows: DataFrame) -> DataFrame:
    """First trip and first multi-vector sighting per (source, protocol, episode).

    A sighting counts from the trip on. Each slice reports its first trip, its
    first sighting and its first sighting from its own trip on; a window over
    those few reports finds the slice that latched the flag.
    """
    at = F.struct("ts", "event_id")
    unit = ["src_ip", "flood_proto", "episode_start"]
    here = (Window.partitionBy(*unit, SLICE).orderBy("ts", "event_id")
            .rowsBetween(Window.unboundedPreceding, 0))
    multi = F.col("active_protocols") >= C.MULTI_VECTOR_PROTOCOLS
    tripped = F.max(F.col("reason").isNotNull()).over(here)
    reports = (rows.withColumn("_tripped", tripped)
               .groupBy(*unit, SLICE)
               .agg(F.min(F.when(F.col("reason").isNotNull(),
                                 F.struct("ts", "event_id", "reason", "dpid"))).alias("_trip"),
                    F.min(F.when(multi, at)).alias("_any"),
                    F.min(F.when(multi & F.col("_tripped"), at)).alias("_after")))
    before = Window.partitionBy(*unit).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    latched = F.max(F.col("_trip").isNotNull()).over(before)
    return (reports.withColumn("_seen", F.when(latched, F.col("_any")).otherwise(F.col("_after")))
            .groupBy(*unit).agg(F.min("_trip").alias("t"), F.min("_seen").alias("_seen"))
            .filter(F.col("t").isNotNull())
            .select(*unit, F.col("t.ts").alias("trip_ts"), F.col("t.event_id").alias("trip_event_id"),
                    F.col("t.reason").alias("reason"), F.col("t.dpid").alias("dpid"), "_seen"))


def _reasoned(packets: DataFrame, rules: C.FloodRules, pop_acks: bool) -> DataFrame:
    """Counted packets with their episode and the reason for which they trip, if any."""
    rows = (flood_episodes(_sliced_windows(packets, rules), rules)
            .withColumn("reason", _reason(rules)))
    if pop_acks:
        syn = (remembered_syns(packets, rules).withColumn("reason", _reason(rules))
               .select("src_ip", "event_id", F.struct("reason", "syn_active").alias("_syn")))
        rows = (null_safe_join(rows, syn, ["src_ip", "event_id"], "left")
                .withColumn("reason", F.when(F.col("flood_proto") == "SYN", F.col("_syn.reason"))
                            .otherwise(F.col("reason")))
                .withColumn("active_protocols", F.col("active_protocols") - F.col("_syn_active")
                            + F.coalesce(F.col("_syn.syn_active"), F.lit(0))).drop("_syn"))
    return rows


def flood_trips(packets: DataFrame, rules: C.FloodRules = C.FloodRules(), *,
                pop_acks: bool = False) -> DataFrame:
    """First trip of each (source, protocol) per episode, with reason and correlation.

    With ``pop_acks`` SYN counts, and whether SYN is active at a packet of
    another protocol, come from :func:`remembered_syns`.
    """
    rows = _reasoned(packets, rules, pop_acks)
    # at most one row per protocol and episode from here on
    episode = Window.partitionBy("src_ip", "episode_start")
    return (_latch(rows)
            .withColumn("_first", F.min("_seen").over(episode))
            .withColumn("multi_vector_ts", F.col("_first.ts"))
            .withColumn("correlated", F.coalesce(
                F.col("_first") <= F.struct(F.col("trip_ts").alias("ts"),
                                            F.col("trip_event_id").alias("event_id")), F.lit(False)))
            .drop("_seen", "_first"))


def multi_vector(packets: DataFrame, rules: C.FloodRules = C.FloodRules()) -> DataFrame:
    """Sources active on two protocols at a trip or later in a flagged episode."""
    trips = flood_trips(packets, rules)
    return (trips.filter(F.col("multi_vector_ts").isNotNull())
            .groupBy("src_ip", "episode_start").agg(F.min("multi_vector_ts").alias("multi_vector_ts")))


def flag_intervals(packets: DataFrame, rules: C.FloodRules = C.FloodRules(), *, pop_acks: bool = False) -> DataFrame:
    """[first trip, last packet + idle limit] per flagged episode of a source; ``pop_acks`` as in :func:`flood_trips`."""
    rows = _reasoned(packets, rules, pop_acks)
    span = (rows.groupBy("src_ip", "episode_start")
            .agg(F.min(F.when(F.col("reason").isNotNull(), F.col("ts"))).alias("flag_from"),
                 F.max("ts").alias("_last")))
    idle = F.expr(f"make_dt_interval(0, 0, 0, {rules.idle_s})")
    return (span.filter(F.col("flag_from").isNotNull())
            .select("src_ip", "episode_start", "flag_from", (F.col("_last") + idle).alias("flag_to")))


def prefilter_breakdown(trips: DataFrame) -> DataFrame:
    """Flagged (source, episode) pairs per protocol, split by reason, plus correlated ones."""
    burst = F.col("reason").startswith("burst")
    return (trips.groupBy("flood_proto")
            .agg(F.count(F.lit(1)).alias("flagged"),
                 F.count(F.when(burst, 1)).alias("by_burst"),
                 F.count(F.when(~burst, 1)).alias("by_limit"),
                 F.count(F.when(F.col("multi_vector_ts").isNotNull(), 1)).alias("correlated")))


def ack_popback(packets: DataFrame, rules: C.FloodRules = C.FloodRules()) -> DataFrame:
    """Window and burst counts of every SYN packet when each ACK forgets the oldest remembered SYN."""
    return remembered_syns(packets, rules).filter("flood_proto = 'SYN'").drop("syn_active")


def remembered_syns(packets: DataFrame, rules: C.FloodRules = C.FloodRules()) -> DataFrame:
    """Counts of remembered SYNs at every counted packet, and ``syn_active``: 1 if any lies in the window.

    Everything resets after an idle gap, so the unit is an episode; it is replayed slice by slice
    (:mod:`floodwatch.operators.ack_replay`). A packet without a time has no window and is left out.
    """
    tracked = (filter_scoreable(classify_packet(packets))
               .filter(F.col("flood_proto").isin(*C.FLOOD_PROTOCOLS, "ACK")))
    # an ACK belongs to the episode of the packet before it and does not prolong it
    idle_us = int(round(rules.idle_s * 1e6))
    counted = with_slice(counted_packets(packets).withColumn("_us", micros("ts")), "ts", rules.slice_s)
    episodes = (flood_episodes(counted, rules).groupBy("src_ip", "episode_start")
                .agg(F.max("_us").alias("_until")))
    rows = asof_join(tracked, episodes.withColumn("_from", F.col("episode_start")), ["src_ip"],
                     left_ts="ts", right_ts="_from", cols=["episode_start", "_until"],
                     width_s=rules.slice_s)
    rows = (rows.withColumn("_us", micros("ts"))
            .filter((F.col("flood_proto") != "ACK")
                    | (F.col("episode_start").isNotNull() & (F.col("_us") - F.col("_until") <= idle_us))))

    return count_remembered(rows, ["src_ip", "episode_start", "ts", "event_id", "dpid", "flood_proto"], rules)
