"""Packet events: classification, filters, per-switch rate limit, address caches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodwatch import config as C
from floodwatch.plans.slices import LEADS, SLICE, greedy_spacing, micros, prefix, with_slice


def tcp_flags(bits: Column) -> tuple[Column, Column]:
    """(syn, ack) booleans from a raw TCP flag byte."""
    return (bits.bitwiseAND(C.SYN_BIT) != 0, bits.bitwiseAND(C.ACK_BIT) != 0)


def classify_packet(packets: DataFrame) -> DataFrame:
    """Add ``flood_proto``: SYN, ACK, ICMP, UDP or null when not tracked."""
    syn, ack = F.col("tcp_flags_syn"), F.col("tcp_flags_ack")
    tcp = F.col("proto") == "TCP"
    return packets.withColumn(
        "flood_proto",
        F.when(tcp & syn & ~ack, "SYN").when(tcp & ack, "ACK")
         .when(F.col("proto") == "ICMP", "ICMP").when(F.col("proto") == "UDP", "UDP"))


def filter_scoreable(df: DataFrame, whitelist: Sequence[str] | DataFrame = C.WHITELIST) -> DataFrame:
    """Drop rows without a usable source, whitelisted sources and empty flows.

    A whitelist given as a table becomes a left-anti join; Spark broadcasts it
    only while its size is under the broadcast threshold.
    """
    out = df.filter(F.col("src_ip").isNotNull() & ~F.col("src_ip").isin("", "0.0.0.0"))
    if isinstance(whitelist, DataFrame):
        out = out.join(whitelist.select("src_ip"), "src_ip", "left_anti")
    elif whitelist:
        out = out.filter(~F.col("src_ip").isin(*whitelist))
    if "packet_count" in df.columns:
        out = out.filter(F.col("packet_count") > 0)
    return out


def packet_rate_limiter(packets: DataFrame, *, limit: int = C.PACKET_IN_LIMIT,
                        window_s: float = 1.0, slice_s: float = 60.0) -> DataFrame:
    """Mark packets over a switch's packet-in limit.

    A window opens at the first packet at least ``window_s`` after the previous
    window opened; ``in_window`` is the packet's ordinal in it.
    """
    order = ["ts", "event_id"]
    spaced = greedy_spacing(packets, ["dpid"], order, ts="ts", gap_s=window_s,
                            width_s=slice_s, strict=False)
    counted = prefix(spaced, ["dpid", "anchor_us"], order, ts="ts", width_s=slice_s,
                     sums={"in_window": F.lit(1)})
    return counted.withColumn("throttled", F.col("in_window") > limit).drop("is_kept")


def packet_rate_tumbling(packets: DataFrame, *, limit: int = C.PACKET_IN_LIMIT,
                         window_s: float = 1.0) -> DataFrame:
    """Aligned-window counts per switch: one map-side combined aggregate."""
    slot = F.floor(micros("ts") / F.lit(window_s * 1e6)).cast("long")
    return (packets.groupBy("dpid", slot.alias("slot")).agg(F.count(F.lit(1)).alias("packets"))
            .withColumn("over_limit", F.greatest(F.col("packets") - limit, F.lit(0))))


PROTO_NUMBER = {"TCP": C.TCP, "UDP": C.UDP, "ICMP": C.ICMP}


def proto_number(proto: Column) -> Column:
    return F.when(proto == "TCP", C.TCP).when(proto == "UDP", C.UDP).when(proto == "ICMP", C.ICMP).otherwise(0)


def resolve_addresses(flows: DataFrame, packets: DataFrame, *, slice_s: float, ports: bool = False) -> DataFrame:
    """Add ``resolved_proto``: the flow's own protocol, else the one remembered for (switch, source), else for the source.

    With ``ports`` also ``port_src`` and ``port_dst``, the source's last TCP or UDP ports, (0, 0) before any.
    TCP and UDP always replace the protocol that is remembered; another is remembered only while nothing is.

    Both caches and the ports come from one scan. Flows and packets of a source
    lie together slice by slice; a slice's own rows are read by windows, and what
    the slices before it left is carried by one summary row per (source, slice),
    with the switches' part as a map (a source is seen by few switches).
    """
    unit = ["src_ip", SLICE]
    number = proto_number(F.col("proto"))
    left = flows.withColumn("_ts", F.col("ts")).withColumn("_side", F.lit(1))
    right = packets.filter(F.col("src_ip").isNotNull() & F.col("ts").isNotNull() & (number != 0)).select(
        "src_ip", "dpid", F.col("ts").alias("_ts"), F.lit(0).alias("_side"), F.col("event_id").alias("_tie"), number.alias("_num"),
        *([F.struct(F.col("tp_src").alias("s"), F.col("tp_dst").alias("d")).alias("_ends")] if ports else []))
    rows = with_slice(left.unionByName(right, allowMissingColumns=True), "_ts", slice_s)
    strong = F.when(F.col("_num").isin(C.TCP, C.UDP), F.col("_num"))
    rows = rows.withColumn("_strong", strong)
    if ports:
        rows = rows.withColumn("_ends", F.when(F.col("_strong").isNotNull(), F.col("_ends")))
    position = F.struct("_ts", "_tie")
    values = ["_strong", "_num", *(["_ends"] if ports else [])]

    def newest(value: str) -> Column:
        return F.max_by(F.col(value), F.when(F.col(value).isNotNull(), position))

    # what each slice leaves per switch, and from those per source
    local = rows.groupBy(*unit, "dpid").agg(*[newest(v).alias(v) for v in values],
                                            *[F.max(F.when(F.col(v).isNotNull(), position)).alias(f"{v}_at") for v in values])
    before = Window.partitionBy("src_ip", "dpid").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    local = local.withColumn("_switch", F.struct("dpid", *[F.last(v, ignorenulls=True).over(before).alias(v) for v in ("_strong", "_num")]))
    summary = local.groupBy(*unit).agg(F.collect_list("_switch").alias("_switches"), *[F.max_by(v, f"{v}_at").alias(v) for v in values])
    before = Window.partitionBy("src_ip").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(*unit, "_switches", *[F.last(v, ignorenulls=True).over(before).alias(f"{v}_came") for v in values])

    # what the earlier slices left comes as a row before the slice's own, so the rows are shuffled once
    rows = rows.withColumn(LEADS, F.lit(0)).unionByName(summary.withColumn(LEADS, F.lit(-1)), allowMissingColumns=True)
    whole = Window.partitionBy(*unit).orderBy(LEADS, "_ts", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    switch = Window.partitionBy(*unit, "dpid").orderBy(LEADS, "_ts", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = {c: F.last(c, ignorenulls=True).over(whole) for c in ("_switches", *[f"{v}_came" for v in values])}
    rows = rows.withColumns({f"{v}_any": F.last(v, ignorenulls=True).over(whole) for v in values} | carried)      # the wider window first: one shuffle serves both
    out = rows.withColumns({f"{v}_own": F.last(v, ignorenulls=True).over(switch) for v in ("_strong", "_num")}).filter("_side = 1")
    came = F.filter("_switches", lambda s: s["dpid"].eqNullSafe(F.col("dpid")))[0]

    def known(strong_now: Column, strong_came: Column, seen_now: Column, seen_came: Column) -> Column:
        return F.coalesce(strong_now, strong_came, F.when(seen_now.isNotNull() | seen_came.isNotNull(), C.ICMP))
    here = known(F.col("_strong_own"), came["_strong"], F.col("_num_own"), came["_num"])
    anywhere = known(F.col("_strong_any"), F.col("_strong_came"), F.col("_num_any"), F.col("_num_came"))
    made = {"resolved_proto": F.coalesce(F.when(F.col("ip_proto") != 0, F.col("ip_proto")), here, anywhere, F.lit(0)).cast("long")}
    if ports:
        ends = F.coalesce("_ends_any", "_ends_came")
        made |= {"port_src": F.coalesce(ends["s"], F.lit(0)).cast("long"), "port_dst": F.coalesce(ends["d"], F.lit(0)).cast("long")}
    return out.withColumns(made).select(*flows.columns, *made)


def resolve_protocol(flows: DataFrame, packets: DataFrame, *, slice_s: float) -> DataFrame:
    """Flow's own protocol, else the (switch, source) cache, else the source cache."""
    return resolve_addresses(flows, packets, slice_s=slice_s)


def resolve_ports(flows: DataFrame, packets: DataFrame, *, slice_s: float) -> DataFrame:
    """Last TCP/UDP ports seen from the source, (0, 0) before any."""
    return resolve_addresses(flows.withColumn("ip_proto", F.lit(0)) if "ip_proto" not in flows.columns else flows, packets, slice_s=slice_s, ports=True).drop("resolved_proto")
