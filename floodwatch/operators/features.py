"""Feature vectors, imputation, label maps, alert rules and display formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodwatch import config as C


def _log(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def _d(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _ratios() -> dict[str, Column]:
    """Engineered quantities shared by the feature families, before any logarithm."""
    eps = F.lit(C.EPS)
    pkt, byt = _d("packet_count"), _d("byte_count")
    pps, bps = _d("packet_count_per_second"), _d("byte_count_per_second")
    sec = _d("flow_duration_sec")
    return {
        "pkt_byte_rate_ratio": pps / (bps + eps),
        "avg_bytes_per_pkt": byt / (pkt + eps),
        "flow_intensity": pkt * bps,
        "port_entropy": _d("tp_src") / (_d("tp_dst") + 1),
        "bytes_per_duration": byt / (sec + eps),
        "pkt_size_uniformity": byt / (pkt + eps) / (bps + eps),
        "flow_src_intensity": _d("flow_count_per_src") * pps,
    }


RAW_LOGGED = ("flow_duration_sec", "packet_count", "byte_count", "packet_count_per_second",
              "byte_count_per_second", "flow_count_per_src", "tp_src", "tp_dst")


#: What both models' features are computed from, but for the rates, which follow from it.
INPUTS = ("packet_count", "byte_count", "flow_duration_sec", "flow_duration_nsec", "flow_count_per_src", "ip_proto", "tp_src", "tp_dst")


def _vector(names: Sequence[str], extra: dict[str, Column]) -> dict[str, Column]:
    ratios = _ratios()
    out = {}
    for name in names:
        if name in extra:
            out[name] = extra[name]
        elif name == "ip_proto":
            out[name] = _d("ip_proto")
        elif name == "avg_bytes_per_pkt":
            out[name] = ratios[name]
        elif name in RAW_LOGGED:
            out[name] = _log(_d(name))
        else:
            out[name] = _log(ratios[name])
    return out


def if_features(flows: DataFrame, prefix: str = "if_") -> DataFrame:
    """The sixteen anomaly features in contract order, as ``if_<name>`` columns."""
    cols = _vector(C.IF_FEATURES, {})
    return flows.select("*", *[c.alias(prefix + n) for n, c in cols.items()])


def rf_features(flows: DataFrame, prefix: str = "rf_") -> DataFrame:
    """The fifteen class features in contract order; a non-finite value becomes 0."""
    eps = F.lit(C.EPS)
    pkt = _d("packet_count")
    lifetime = _log(_d("flow_duration_sec") * 1e9 + _d("flow_duration_nsec"))
    extra = {
        "duration_pkt_ratio": F.when(pkt > 0, _log(lifetime / (pkt + eps))).otherwise(F.lit(0.0)),
        "pkt_rate_per_duration": _log(pkt / (lifetime + eps)),
    }
    cols = _vector(C.RF_FEATURES, extra)
    return flows.select("*", *[finite(c, F.lit(0.0)).alias(prefix + n) for n, c in cols.items()])


def ledger_features(flows: DataFrame) -> DataFrame:
    """Raw engineered values as stored with each detection; no logarithms."""
    eps = F.lit(C.EPS)
    pkt, byt, bps = _d("packet_count"), _d("byte_count"), _d("byte_count_per_second")
    life = _d("flow_duration_sec") * 1e9 + _d("flow_duration_nsec")
    per_packet = byt / F.greatest(pkt, F.lit(1.0))
    r = _ratios()
    return flows.select(
        "*", life.alias("flow_duration_total_ns"), per_packet.alias("bytes_per_packet"),
        r["pkt_byte_rate_ratio"].alias("pkt_byte_rate_ratio"), r["flow_intensity"].alias("flow_intensity"),
        r["port_entropy"].alias("port_entropy"), r["bytes_per_duration"].alias("bytes_per_duration"),
        (per_packet / (bps + 1)).alias("pkt_size_uniformity"),
        r["flow_src_intensity"].alias("flow_src_intensity"),
        (life / (pkt + eps)).alias("duration_pkt_ratio"), (pkt / (life + eps)).alias("pkt_rate_per_duration"))


def live_view_features(flows: DataFrame) -> DataFrame:
    """The dossier's own variants of the engineered features, rounded for display."""
    pkt, byt = _d("packet_count"), _d("byte_count")
    pps, bps = _d("packet_count_per_second"), _d("byte_count_per_second")
    per_packet = F.round(byt / F.greatest(F.floor(pkt), F.lit(1)), 1)
    return flows.select(
        "*", per_packet.alias("bytes_per_packet"),
        F.round(_log(per_packet / (bps + 1)), 4).alias("pkt_size_uniformity"),
        F.round(_d("tp_src") / (_d("tp_dst") + 1), 4).alias("port_entropy"),
        F.round(pps / F.when(bps == 0, F.lit(1.0)).otherwise(bps), 4).alias("pkt_byte_rate_ratio"),
        F.round(_log(pkt * bps), 4).alias("flow_intensity"),
        F.round(byt / F.greatest(_d("flow_duration_sec"), F.lit(1.0)), 4).alias("bytes_per_duration"),
        F.round(_log(pkt * pps), 4).alias("flow_src_intensity"))


def class_one_hot(df: DataFrame) -> DataFrame:
    hit = lambda name: (F.col("attack_class") == name).cast("long")
    return df.select("*", hit("SYN Flood").alias("flag_syn_flood"), hit("ICMP Flood").alias("flag_icmp_flood"),
                     hit("UDP Flood").alias("flag_udp_flood"), (F.col("is_anomaly") == 0).cast("long").alias("flag_normal"))


def finite(x: Column, instead: Column) -> Column:
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, instead).otherwise(x)


def fit_means(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Means of the finite values (0 if none), one row back: what :func:`impute_with` puts in."""
    row = df.agg(*[F.coalesce(F.avg(finite(F.col(c).cast("double"), F.lit(None))), F.lit(0.0)).alias(c) for c in cols]).first()
    return {c: float(row[c]) for c in cols}


def impute_with(df: DataFrame, means: dict[str, float]) -> DataFrame:
    """Replace NaN, infinite and null values by fitted means, so a row does not depend on its batch."""
    return df.withColumns({c: finite(F.col(c).cast("double"), F.lit(m)) for c, m in means.items()})


def impute_nonfinite(df: DataFrame, cols: Sequence[str], of: DataFrame | None = None) -> DataFrame:
    """Replace NaN, infinite and null values by the mean of the table's finite ones (0 if none); ``of`` names another table for the means.

    The means are scalar subqueries over one aggregate, so no join is involved.
    """
    means = (df if of is None else of).agg(F.struct(*[
        F.coalesce(F.avg(finite(F.col(c).cast("double"), F.lit(None))), F.lit(0.0)).alias(c) for c in cols]).alias("m")).scalar()
    out = df.withColumn("_means", means)
    for c in cols:
        out = out.withColumn(c, finite(F.col(c).cast("double"), F.col("_means")[c]))
    return out.drop("_means")


# --- labels (fixed values) --------------------------------------------------
SHORT_CLASS = {"SYN Flood": "SYN", "ICMP Flood": "ICMP", "UDP Flood": "UDP"}
CLASS_PROTOCOL = {"SYN Flood": 6, "ICMP Flood": 1, "UDP Flood": 17}
PHASE_LABEL = {0: "Sinkhole", 1: "Quarantined", 2: "Time Ban", 3: "Blackhole"}
PROTOCOL_NAME = {6: "TCP (6)", 17: "UDP (17)", 1: "ICMP (1)"}


def lookup(col: Column, values: dict, default: Column | None = None) -> Column:
    out = None
    for key, value in values.items():
        out = F.when(col == key, value) if out is None else out.when(col == key, value)
    return out.otherwise(default) if default is not None else out


def map_labels(df: DataFrame) -> DataFrame:
    klass = F.col("attack_class")
    return df.select(
        "*", F.when(klass != "Uncertain", "DDoS").otherwise("Anomaly").alias("predicted_class"),
        lookup(klass, SHORT_CLASS).alias("short_class"), lookup(klass, CLASS_PROTOCOL).cast("long").alias("class_protocol"))


def phase_label(phase: Column) -> Column:
    return lookup(phase, PHASE_LABEL, F.lit("Unknown"))


def phase_number(label: Column) -> Column:
    return lookup(label, {v: k for k, v in PHASE_LABEL.items()}, F.lit(0))


# --- alert rules (fixed values): class, feature, low, high ------------------
# alert when low < value < high; null means open
ALERT_RULES = (
    ("ICMP Flood", "pps", 500.0, None), ("ICMP Flood", "byte_rate", 51200.0, None),
    ("ICMP Flood", "bpp", 0.0, 100.0), ("ICMP Flood", "pkt_count", 10000.0, None),
    ("ICMP Flood", "byte_count", 1e6, None),
    ("SYN Flood", "pps", 500.0, None), ("SYN Flood", "pkt_size_uniformity", None, 0.05),
    ("SYN Flood", "byte_rate", 5120.0, None), ("SYN Flood", "bpp", 0.0, 70.0),
    ("SYN Flood", "pkt_count", 10000.0, None), ("SYN Flood", "byte_count", 1e6, None),
    ("UDP Flood", "byte_rate", 512000.0, None), ("UDP Flood", "pps", 500.0, None),
    ("UDP Flood", "port_entropy", 1.0, None), ("UDP Flood", "bpp", 200.0, None),
    ("UDP Flood", "pkt_count", 10000.0, None), ("UDP Flood", "byte_count", 1e6, None),
    ("Anomalous", "pps", 500.0, None), ("Anomalous", "byte_rate", 51200.0, None),
    ("Anomalous", "pkt_count", 10000.0, None), ("Anomalous", "byte_count", 1e6, None),
    ("Uncertain", "pps", 500.0, None), ("Uncertain", "byte_rate", 51200.0, None),
    ("Uncertain", "pkt_count", 10000.0, None), ("Uncertain", "byte_count", 1e6, None),
)
ALERT_FEATURES = ("pps", "byte_rate", "bpp", "pkt_count", "byte_count", "port_entropy", "pkt_size_uniformity")


def signal_alerts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per alerting feature of a row, by the rules of its class.

    The rules are a fixed two dozen, so they are a literal array filtered in
    place; a class without rules of its own uses those of "Uncertain".
    """
    known = {c for c, *_ in ALERT_RULES}
    klass = F.when(F.col("attack_class").isin(*known), F.col("attack_class")).otherwise("Uncertain")
    values = F.create_map(*[x for f in ALERT_FEATURES for x in (F.lit(f), F.col(f).cast("double"))])
    rules = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(f).alias("f"),
                               F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi"))
                      for c, f, lo, hi in ALERT_RULES])

    def fires(r):
        v = F.col("_values")[r["f"]]
        return ((r["c"] == F.col("_class"))
                & (r["lo"].isNull() | (v > r["lo"])) & (r["hi"].isNull() | (v < r["hi"])))

    return (df.withColumn("_class", klass).withColumn("_values", values)
            .withColumn("_r", F.explode(F.filter(rules, fires)))
            .select(*keys, "attack_class", F.col("_r.f").alias("feature"),
                    F.col("_values")[F.col("_r.f")].alias("value")))


def score_band(score: Column, threshold: float = C.IF_THRESHOLD) -> Column:
    return F.when(score >= threshold * 1.2, "red").when(score >= threshold, "amber").otherwise("green")


def fp_rate_band(rate: Column) -> Column:
    return F.when(rate < 1, "green").when(rate < 5, "amber").otherwise("red")


# --- display formats (fixed values) -----------------------------------------


def format_percent(fraction: Column) -> Column:
    return F.format_string("%.1f%%", fraction * 100)


def format_duration(seconds: Column) -> Column:
    s = F.coalesce(seconds, F.lit(0)).cast("long")
    minutes = F.floor(s / 60)
    return F.when(s >= 60, F.format_string("%dm %ds", minutes, s % 60)).otherwise(F.format_string("%ds", s))


def format_ban(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.when(s >= 60, F.format_string("%dm", F.floor(s / 60))).otherwise(F.format_string("%ds", s))


def format_byte_rate(b: Column) -> Column:
    return (F.when(b >= 1e6, F.format_string("%.2f MB/s", b / 1e6))
            .when(b >= 1e3, F.format_string("%.1f KB/s", b / 1e3)).otherwise(F.format_string("%.0f B/s", b)))


def protocol_name(proto: Column) -> Column:
    return lookup(proto, PROTOCOL_NAME, proto.cast("string"))
