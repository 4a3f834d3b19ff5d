"""Flow samples and switch polls: rates, gates, deltas and per-poll statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodwatch import config as C
from floodwatch.plans.slices import prefix
from floodwatch.plans.stage import cut


RATES = ("packet_count_per_second", "packet_count_per_nsecond", "byte_count_per_second", "byte_count_per_nsecond")


def flow_rates(flows: DataFrame) -> DataFrame:
    """Packets and bytes per second and per nanosecond over the flow's lifetime."""
    total = F.greatest(F.col("flow_duration_sec") + F.col("flow_duration_nsec") / F.lit(1e9), F.lit(1e-9))
    return (flows.withColumn("packet_count_per_second", F.col("packet_count") / total)
            .withColumn("packet_count_per_nsecond", F.col("packet_count") / total / F.lit(1e9))
            .withColumn("byte_count_per_second", F.col("byte_count") / total)
            .withColumn("byte_count_per_nsecond", F.col("byte_count") / total / F.lit(1e9)))


def first_polls(flows: DataFrame) -> DataFrame:
    """Each switch's first poll time; a map-side combined min, one row per switch."""
    return flows.groupBy("dpid").agg(F.min("ts").alias("first_poll_ts"))


def young_flow_gate(flows: DataFrame, min_ns: int = C.YOUNG_FLOW_NS) -> DataFrame:
    """Drop flows younger than ``min_ns`` except on a switch's first poll.

    The first polls, one row per switch, are written as a table: a switch holds very many flows,
    which are not shuffled by switch where Spark finds that table small.
    """
    young = (F.col("flow_duration_sec") == 0) & (F.col("flow_duration_nsec") < min_ns)
    return (flows.join(cut(first_polls(flows), "first_polls"), "dpid")
            .filter(~young | (F.col("ts") == F.col("first_poll_ts"))).drop("first_poll_ts"))


def low_rate_gate(flows: DataFrame, *, floor: float = C.LOW_RATE_FLOOR,
                  baseline: str | None = None, flagged: str | None = None) -> DataFrame:
    """Add ``low_rate``: too slow to be an attack, counted normal without scoring.

    ``baseline`` names a column holding the learned mean of an earlier tick;
    without it the floor applies.
    """
    bound: Column = F.lit(floor)
    if baseline:
        bound = F.greatest(bound, F.coalesce(F.col(baseline), F.lit(0.0)) * C.LOW_RATE_FRACTION)
    slow = F.col("packet_count_per_second") < bound
    if flagged:
        slow = slow & ~F.coalesce(F.col(flagged), F.lit(False))
    return flows.withColumn("low_rate", slow)


def staleness_gate(flows: DataFrame, *, wait_s: str, flagged: str, limit_s: float = C.STALE_S) -> DataFrame:
    """Add ``route``: score, hold (flagged and stale) or drop (unflagged and stale)."""
    stale = F.col(wait_s) > limit_s
    return flows.withColumn("route", F.when(~stale, "score").when(F.col(flagged), "hold").otherwise("drop"))


def estimate_pkt_count(packet_count: Column, pps: Column) -> Column:
    return F.greatest(F.coalesce(packet_count, F.rint(pps).cast("long")).cast("long"), F.lit(1))


def flow_delta(flows: DataFrame, order: Sequence[str], *, slice_s: float) -> DataFrame:
    """New packets since the source's previous sample on the switch."""
    out = prefix(flows, ["src_ip", "dpid"], order, ts="ts", width_s=slice_s,
                 lag={"_prev": F.col("packet_count")})
    return out.withColumn("delta_packets", F.greatest(
        F.col("packet_count") - F.coalesce("_prev", F.lit(0)), F.lit(0))).drop("_prev")


def flow_count_per_src(flows: DataFrame, order: Sequence[str], *, chunk: Column | None = None) -> DataFrame:
    """Running number of a source's flows within one poll of one switch.

    ``chunk`` is an expression that does not decrease along ``order``; a poll
    with very many flows of one source is then numbered chunk by chunk.
    """
    from floodwatch.plans.slices import SLICE
    if chunk is None:
        w = Window.partitionBy("dpid", "poll_id", "src_ip").orderBy(*order)
        return flows.withColumn("flow_count_per_src", F.row_number().over(w).cast("long"))
    return prefix(flows.withColumn(SLICE, chunk.cast("long")), ["dpid", "poll_id", "src_ip"], order,
                  sums={"flow_count_per_src": F.lit(1).cast("long")})


def switch_poll_stats(flows: DataFrame, packets_in: DataFrame | None = None, interval_s: float = 1.0) -> DataFrame:
    """Totals, means, distinct addresses and active ports per (switch, poll), and packet-ins per second.

    Sums and protocol counts are combined map-side. Only what is counted distinct is shuffled value by value:
    nearly each flow has a source of its own, so grouping the flows first would shuffle them all once more.
    """
    micro = F.col("flow_duration_sec") * 1e6 + F.col("flow_duration_nsec") / 1000
    keys = ["dpid", "poll_id"]
    totals = flows.groupBy(*keys).agg(
        F.sum("packet_count").alias("disp_pakt"), F.sum("byte_count").alias("disp_byte"), F.count(F.lit(1)).alias("gfe"),
        F.sum(micro).alias("_d"), F.countDistinct("src_ip").alias("g_usip"),
        F.countDistinct("dst_ip").alias("avg_flow_dst"), F.countDistinct("tp_dst").alias("active_ports"))
    proto = (flows.groupBy(*keys, "ip_proto").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys)
             .agg(F.max_by("ip_proto", F.struct("_n", "ip_proto")).alias("dominant_proto")))
    out = (totals.join(proto, keys)
           .withColumn("mean_pkt", F.col("disp_pakt") / F.col("gfe"))
           .withColumn("mean_byte", F.col("disp_byte") / F.col("gfe"))
           .withColumn("avg_durat", F.col("_d") / F.col("gfe"))
           .withColumn("rfip", F.when(F.col("g_usip") > 0, F.greatest(F.col("avg_flow_dst") - 1, F.lit(0)))
                       .otherwise(F.lit(0)))
           .drop("_d"))
    if packets_in is not None:
        rate = packets_in.groupBy(*keys).agg(F.count(F.lit(1)).alias("_in"))
        out = out.join(rate, keys, "left").withColumn("rate_pkt_in", F.coalesce("_in", F.lit(0)) / F.lit(max(float(interval_s), 0.001))).drop("_in")
    return out


def switch_delta_pps(polls: DataFrame, *, ts: str, total: str = "disp_pakt",
                     rate_in: str | None = None, unit_s: float = 1.0) -> DataFrame:
    """Per-switch packet rate between polls; the first poll reports 0."""
    from floodwatch.plans.slices import micros
    w = Window.partitionBy("dpid").orderBy(ts)
    us = micros(ts) if dict(polls.dtypes)[ts].startswith("timestamp") else F.col(ts) * F.lit(1e6)
    prev = F.lag(total).over(w)
    seconds = (us - F.lag(us).over(w)) / F.lit(1e6 * unit_s)
    rate = F.greatest(F.col(total) - prev, F.lit(0)) / F.greatest(seconds, F.lit(0.1))
    floor = F.col(rate_in) if rate_in else F.lit(0.0)
    return polls.withColumn("switch_delta_pps", F.when(prev.isNull(), 0.0).otherwise(F.greatest(rate, floor)))


DROP_PRIORITIES_BY_SOURCE = (80, 90, 100)   # fixed values: rule priorities keyed by source
DROP_PRIORITY_PROTOCOL = 50                 # fixed value: protocol-wide drop rule


def drop_delta(counters: DataFrame, order: Sequence[str], *, slice_s: float) -> DataFrame:
    """Positive packet deltas of drop rules, keyed by source or ``__proto__``."""
    key = (F.when(F.col("rule_priority").isin(*DROP_PRIORITIES_BY_SOURCE), F.col("src_ip"))
           .when(F.col("rule_priority") == DROP_PRIORITY_PROTOCOL, "__proto__"))
    keyed = counters.withColumn("drop_key", key).filter(F.col("drop_key").isNotNull())
    out = prefix(keyed, ["drop_key"], order, ts="ts", width_s=slice_s,
                 lag={"_prev": F.col("packet_count")})
    return (out.withColumn("delta", F.greatest(
                F.col("packet_count") - F.coalesce("_prev", F.lit(0)), F.lit(0)))
            .filter("delta > 0").drop("_prev"))


def merge_switch_flow(flows: DataFrame, switch_stats: DataFrame) -> DataFrame:
    """Overlay the switch's poll statistics with the flow; the flow's protocol wins if set."""
    stats = switch_stats.withColumnRenamed("ip_proto", "switch_proto")
    own = F.when(F.col("ip_proto") != 0, F.col("ip_proto"))
    return (flows.join(stats, ["dpid", "poll_id"], "left")
            .withColumn("ip_proto", F.coalesce(own, F.col("switch_proto"), F.lit(0)).cast("long"))
            .drop("switch_proto"))


def latest_flow_per_src(flows: DataFrame, order: Sequence[str], cap: int = C.TRACKED_SOURCES) -> DataFrame:
    """Current sample per source; keeps the ``cap`` most recently updated sources."""
    rest = [c for c in flows.columns if c != "src_ip"]
    newest = flows.groupBy("src_ip").agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select("src_ip", "r.*")
    return newest.orderBy(*[F.col(c).desc() for c in order], "src_ip").limit(cap)


def live_deltas(polls: DataFrame, *, order: str, malicious: str, normal: str, total: str,
                chunk: int = 100_000) -> DataFrame:
    """Per-poll increments of cumulative counters and the change of the total in percent.

    ``order`` numbers the polls; the series is walked in chunks of that many.
    """
    from floodwatch.plans.slices import SLICE
    rows = polls.withColumn("_series", F.lit(1)).withColumn(SLICE, F.floor(F.col(order) / chunk).cast("long"))
    rows = prefix(rows, ["_series"], [order], lag={"_prev": F.struct(
        F.col(malicious).alias("m"), F.col(normal).alias("n"), F.col(total).alias("t"))})

    def step(col: str, name: str) -> Column:
        prev = F.coalesce(F.col(f"_prev.{name}"), F.lit(0))
        return F.when(prev > 0, F.greatest(F.col(col) - prev, F.lit(0))).otherwise(F.lit(0))

    prev_total = F.coalesce(F.col("_prev.t"), F.lit(0))
    pct = F.when(prev_total > 0, (F.col(total) - prev_total) / F.greatest(prev_total, F.lit(1)) * 100)
    return (rows.withColumn("delta_malicious", step(malicious, "m")).withColumn("delta_normal", step(normal, "n"))
            .withColumn("delta_total", F.col("delta_malicious") + F.col("delta_normal"))
            .withColumn("pct_change", F.coalesce(pct, F.lit(0.0))).drop("_series", "_prev"))
