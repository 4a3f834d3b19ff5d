"""Reshape the star-schema test tables into telemetry and ledger tables.

One rule second is stretched to one day, so windows are passed in days. Tables
keep their rows; only columns change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodwatch import config as C
from floodwatch.session import ensure_settings

DAY_S = 86400.0

# Stretched limits for the packets adapter (see FIXTURES.md).
FLOOD_RULES = C.FloodRules(
    limits={"SYN": 4, "ICMP": 3, "UDP": 3}, window_s=DAY_S,
    burst_windows_s=(0.1 * DAY_S, 0.5 * DAY_S), idle_factor=5.0,
    ack_interval_s=0.05 * DAY_S, slice_s=10 * DAY_S)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_settings(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ip(prefix: str, col: str):
    return F.expr(f"concat('{prefix}.', cast({col} div 250 as string), '.', cast({col} % 250 + 1 as string))")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        "event_id", "ts", (F.col("user_id") % 9 + 1).alias("dpid"),
        _ip("10.0", "user_id").alias("src_ip"), F.lit(C.SERVER_IP).alias("dst_ip"),
        F.when(kind.isin("click", "purchase"), "TCP").when(kind == "error", "ICMP")
         .when(kind == "view", "UDP").otherwise("OTHER").alias("proto"),
        (kind == "click").alias("tcp_flags_syn"), (kind == "purchase").alias("tcp_flags_ack"))


FLOW_ORDER = ["ts", "l_orderkey", "l_linenumber", "l_partkey"]


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow samples; one poll per l_shipdate, cumulative counters as given."""
    li = table(spark, sf_dir, "lineitem")
    base = li.select(
        F.col("l_shipdate").alias("ts"),
        F.datediff("l_shipdate", F.lit("1995-01-01")).cast("long").alias("poll_id"),
        F.col("l_linenumber").cast("long").alias("dpid"),
        _ip("10.1", "l_suppkey").alias("src_ip"),
        F.when(F.col("l_returnflag") == "A", 6).when(F.col("l_returnflag") == "N", 17)
         .otherwise(1).cast("long").alias("ip_proto"),
        F.floor("l_quantity").cast("long").alias("packet_count"),
        F.floor("l_extendedprice").cast("long").alias("byte_count"),
        (1 + F.floor(F.col("l_tax") * 100 + 0.5)).cast("double").alias("flow_duration_sec"),
        (F.floor(F.col("l_discount") * 100 + 0.5) * 10000000).cast("double").alias("flow_duration_nsec"),
        (F.col("l_partkey") % 65536).alias("tp_src"), (F.col("l_orderkey") % 1024).alias("tp_dst"),
        _ip("10.3", "(l_partkey % 100)").alias("dst_ip"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax")
    return with_flow_rates(base)


def with_flow_rates(df: DataFrame) -> DataFrame:
    from floodwatch.operators.flows import flow_rates
    return flow_rates(df)


CLASS_OF_PROTO = {6: "SYN Flood", 1: "ICMP Flood", 17: "UDP Flood"}


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flows(spark, sf_dir)
    score = F.lit(0.4) + F.col("l_discount") * 3
    conf = F.lit(0.5) + F.col("l_tax") * 6
    klass = (F.when(conf < C.RF_CONFIDENCE_GATE, "Uncertain")
             .when(F.col("ip_proto") == 6, "SYN Flood").when(F.col("ip_proto") == 1, "ICMP Flood")
             .otherwise("UDP Flood"))
    return (f.withColumn("if_score", score).withColumn("confidence", conf)
            .withColumn("is_anomaly", (F.col("if_score") >= C.IF_THRESHOLD).cast("long"))
            .withColumn("attack_class", klass)
            .withColumn("pps", F.col("packet_count_per_second")))


def attack_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate")
    first = F.expr("o_orderdate - make_dt_interval(0, 0, 0, cast(o_orderkey % 7200 as int))")
    return o.select(
        F.col("o_orderkey").alias("id"), _ip("10.2", "o_custkey").alias("src_ip"),
        F.when(F.col("o_orderkey") % 3 == 0, "SYN Flood").when(F.col("o_orderkey") % 3 == 1, "ICMP Flood")
         .otherwise("UDP Flood").alias("attack_vector"),
        (F.lit(0.4) + (F.col("o_orderkey") % 61) / 100.0).alias("if_score"),
        ((F.col("o_orderkey") % 101) / 100.0).alias("confidence"),
        F.element_at(F.array(*[F.lit(p) for p in ("Low", "Medium", "High", "Critical")]),
                     (F.col("o_orderkey") % 4 + 1).cast("int")).alias("priority"),
        (F.col("o_orderkey") % 3 + 1).alias("phase_reached"),
        first.alias("first_seen"), at.alias("unblocked_at"),
        (F.substring("o_orderpriority", 1, 1).cast("long") - 1).alias("ban_level"),
        (F.col("o_orderkey") % 5).alias("offence_count"),
        F.when(F.col("o_orderstatus") == "F", "Ban Expired").when(F.col("o_orderstatus") == "O", "Attack Stopped")
         .otherwise("Manual Release").alias("unblock_reason"))


def gt_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").filter(F.col("s_suppkey") % 4 != 0)
    start = F.expr("timestamp_ntz'1996-01-01 00:00:00' + make_dt_interval(cast(s_suppkey % 365 as int))")
    return s.select(
        _ip("10.1", "s_suppkey").alias("src_ip"),
        F.when(F.col("s_suppkey") % 8 == 7, "MIXED").when(F.col("s_suppkey") % 4 == 1, "SYN").when(F.col("s_suppkey") % 4 == 2, "ICMP")
         .otherwise("UDP").alias("attack_type"),
        start.alias("start_ts"), F.when(F.col("s_suppkey") % 5 != 0, start + F.expr("make_dt_interval(365)")).alias("end_ts"))


def system_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"),
        F.least("value", F.lit(100.0)).alias("cpu_percent"), (F.col("value") + 50).alias("mem_mb"),
        F.col("value").alias("pps_processed"),
        (F.col("event_type") == "error").cast("long").alias("is_attack"),
        F.least(F.col("value") * 2, F.lit(100.0)).alias("ctrl_cpu_percent"),
        (F.col("value") + 50).alias("ctrl_mem_mb"),
        (F.col("event_type") == "purchase").cast("long").alias("is_mitigating"))


def mitigation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    action = (F.when(kind == "click", "Quarantined").when(kind == "view", "Time Ban (1m)")
              .when(kind == "error", "Blackhole").when(kind == "purchase", "Released").otherwise("Sinkhole"))
    phase = (F.when(kind == "click", "Quarantined").when(kind == "view", "Time Ban")
             .when(kind == "error", "Blackhole").when(kind == "purchase", "Time Ban").otherwise("Sinkhole"))
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"),
        _ip("10.0", "user_id").alias("src_ip"), F.lit("DDoS").alias("predicted_class"),
        F.when(F.col("event_id") % 5 == 0, "Uncertain").when(F.col("event_id") % 5 == 1, "SYN Flood")
         .when(F.col("event_id") % 5 == 2, "ICMP Flood").otherwise("UDP Flood").alias("attack_vector"),
        ((F.col("event_id") % 101) / 100.0).alias("confidence"),
        F.element_at(F.array(*[F.lit(p) for p in ("Low", "Medium", "High", "Critical")]),
                     (F.col("event_id") % 4 + 1).cast("int")).alias("priority"),
        action.alias("action_taken"), (F.lit(0.4) + (F.col("event_id") % 61) / 100.0).alias("if_score"),
        phase.alias("phase"), (F.col("event_id") % 50 == 0).cast("long").alias("is_manual"),
        F.when(kind == "purchase", "released").otherwise("transition").alias("event_type"),
        F.lit(None).cast("string").alias("reason"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("detection_ms"),
        (F.col("value") / 10).alias("mitigation_ms"),
        F.sha2(F.concat_ws("|", _ip("10.0", "user_id"), F.col("event_id").cast("string")), 256)
         .substr(1, 12).alias("session_id"))
