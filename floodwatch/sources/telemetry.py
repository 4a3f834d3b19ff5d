"""Telemetry messages in, typed tables out; ground-truth calls to intervals; contracts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodwatch import config as C
from floodwatch.plans.slices import SLICE, null_safe_join, with_slice
from pyspark.sql import Window

D, L, S, B = T.DoubleType(), T.LongType(), T.StringType(), T.BooleanType()

# Field names of the nested messages.
FLOW_FIELDS = (
    ("flow_duration_sec", D), ("flow_duration_nsec", D), ("idle_timeout", L), ("hard_timeout", L), ("flags", L),
    ("packet_count", L), ("byte_count", L), ("packet_count_per_second", D), ("packet_count_per_nsecond", D),
    ("byte_count_per_second", D), ("byte_count_per_nsecond", D), ("ip_proto", L), ("tp_src", L), ("tp_dst", L),
    ("flow_count_per_src", L),
)
SWITCH_FIELDS = (
    ("disp_pakt", L), ("disp_byte", L), ("mean_pkt", D), ("mean_byte", D), ("avg_durat", D), ("avg_flow_dst", L),
    ("rate_pkt_in", D), ("disp_interval", D), ("gfe", L), ("g_usip", L), ("rfip", L), ("gsp", L), ("ip_proto", L),
)


def _struct(fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


MESSAGE = T.StructType([
    T.StructField("type", S), T.StructField("ts", D), T.StructField("dpid", L), T.StructField("src_ip", S),
    T.StructField("dst_ip", S), T.StructField("proto", S), T.StructField("tcp_flags_syn", B),
    T.StructField("tcp_flags_ack", B), T.StructField("delta", L), T.StructField("connected", L),
    T.StructField("flow_stats", _struct(FLOW_FIELDS)), T.StructField("switch_stats", _struct(SWITCH_FIELDS)),
])
KINDS = ("packet_in", "flow_stats", "dropped_delta", "switch_count")


def parse_telemetry(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON text to typed messages; malformed lines and unknown types are dropped."""
    parsed = raw.select(F.from_json(F.col(column).cast("string"), MESSAGE, {"mode": "PERMISSIVE"}).alias("m"))
    return (parsed.select("m.*").filter(F.col("type").isin(*KINDS))
            .withColumn("ts", F.timestamp_micros(F.rint(F.col("ts") * 1e6).cast("long"))))


def split_telemetry(messages: DataFrame) -> dict[str, DataFrame]:
    """One table per message type, with its own filters."""
    named = F.col("src_ip").isNotNull() & (F.col("src_ip") != "")
    of = lambda kind: messages.filter(F.col("type") == kind)
    return {
        "packet_in": of("packet_in").filter(named).select("ts", "dpid", "src_ip", "dst_ip", "proto", "tcp_flags_syn", "tcp_flags_ack"),
        "flow_stats": of("flow_stats").filter(named & F.col("flow_stats").isNotNull()).select("ts", "dpid", "src_ip", "flow_stats", "switch_stats"),
        "dropped_delta": of("dropped_delta").filter(named & (F.col("delta") > 0)).select("ts", "src_ip", "delta"),
        "switch_count": of("switch_count").select("ts", "connected"),
    }


def read_telemetry(spark: SparkSession, path: str | None = None, *, stream: bool = False,
                   fmt: str = "text", options: dict[str, str] | None = None) -> DataFrame:
    """Messages from files (``text``) or a broker (``kafka``), batch or streaming."""
    reader = (spark.readStream if stream else spark.read).format(fmt).options(**(options or {}))
    return parse_telemetry(reader.load(path) if path else reader.load())


def flatten_flow_stats(flows: DataFrame) -> DataFrame:
    """Lift the nested structs; absent numbers become 0, switch fields get a prefix."""
    keep = [c for c in flows.columns if c not in ("flow_stats", "switch_stats")]
    zero = lambda t: F.lit(0.0) if isinstance(t, T.DoubleType) else F.lit(0).cast("long")
    inner = {f.name for f in flows.schema["flow_stats"].dataType.fields}
    cols = [F.coalesce(F.col(f"flow_stats.{n}") if n in inner else F.lit(None), zero(t)).cast(t).alias(n)
            for n, t in FLOW_FIELDS]
    if "switch_stats" in flows.columns:
        cols += [F.coalesce(F.col(f"switch_stats.{n}"), zero(t)).cast(t).alias(f"switch_{n}") for n, t in SWITCH_FIELDS]
    return flows.select(*keep, *cols)


def nest_flows(flows: DataFrame) -> DataFrame:
    """The wire form of flat flows; the inverse of :func:`flatten_flow_stats`."""
    names = [n for n, _ in FLOW_FIELDS]
    have = [n for n in names if n in flows.columns]
    return flows.select(*[c for c in flows.columns if c not in have], F.struct(*have).alias("flow_stats"))


def ground_truth_intervals(calls: DataFrame, *, slice_s: float) -> DataFrame:
    """Start and stop calls to intervals: the source's next call ends a start; none leaves it open.

    The next call is found inside the time slice, or is the first call of a
    later slice, which comes from one summary row per (source, slice).
    """
    order = ["ts", "event_id"]
    rows = with_slice(calls, "ts", slice_s)
    first = rows.groupBy("src_ip", SLICE).agg(F.min("ts").alias("_first"))
    after = Window.partitionBy("src_ip").orderBy(SLICE)
    later = first.select("src_ip", SLICE, F.lead("_first").over(after).alias("_later"))
    here = Window.partitionBy("src_ip", SLICE).orderBy(*order)
    return (null_safe_join(rows, later, ["src_ip", SLICE])
            .withColumn("end_ts", F.coalesce(F.lead("ts").over(here), F.col("_later")))
            .filter(F.col("call") == "start")
            .select("src_ip", "attack_type", F.col("ts").alias("start_ts"), "end_ts"))


def load_contract(path: str | None = None) -> dict:
    """Feature order, threshold, classes and gate: from a JSON file, else the fixed values."""
    if path:
        with open(path) as f:
            return json.load(f)
    return {"if_features": list(C.IF_FEATURES), "threshold": C.IF_THRESHOLD, "rf_features": list(C.RF_FEATURES),
            "class_names": list(C.CLASS_NAMES), "confidence_gate": C.RF_CONFIDENCE_GATE}
