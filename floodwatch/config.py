"""Thresholds, ladders and feature orders.

Every value in this module is a fixed value: results only match the system this
library stands in for when they are equal to it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: flood prefilter ------------------------------------------
FLOOD_PROTOCOLS = ("SYN", "ICMP", "UDP")
BURST_FRACTION = 0.4
ACK_POP_INTERVAL_S = 0.05
MULTI_VECTOR_PROTOCOLS = 2


@dataclass(frozen=True)
class FloodRules:
    """Sliding-window limits per protocol; times in seconds."""

    limits: dict[str, int] = field(default_factory=lambda: {"SYN": 100, "ICMP": 50, "UDP": 50})
    window_s: float = 1.0
    burst_windows_s: tuple[float, float] = (0.1, 0.5)
    idle_factor: float = 5.0
    ack_interval_s: float = ACK_POP_INTERVAL_S
    slice_s: float = 60.0

    @property
    def idle_s(self) -> float:
        return self.window_s * self.idle_factor

    def burst_limit(self, protocol: str) -> int:
        return max(2, int(self.limits[protocol] * BURST_FRACTION))


# --- fixed values: addresses and IP protocol numbers ------------------------
SERVER_IP = "10.0.0.20"
SINKHOLE_IP = "10.0.0.21"
WHITELIST = (SERVER_IP, SINKHOLE_IP)
TCP, UDP, ICMP = 6, 17, 1
SYN_BIT, ACK_BIT = 0x02, 0x10

# --- fixed values: anomaly and class contracts ------------------------------
IF_THRESHOLD = 0.6092241858026261
RF_CONFIDENCE_GATE = 0.70
CLASS_NAMES = ("ICMP Flood", "SYN Flood", "UDP Flood")
IF_FEATURES = (
    "flow_duration_sec", "packet_count", "byte_count", "packet_count_per_second",
    "byte_count_per_second", "flow_count_per_src", "tp_src", "tp_dst", "ip_proto",
    "pkt_byte_rate_ratio", "avg_bytes_per_pkt", "flow_intensity", "port_entropy",
    "bytes_per_duration", "pkt_size_uniformity", "flow_src_intensity",
)
RF_FEATURES = (
    "flow_duration_sec", "packet_count", "byte_count", "packet_count_per_second",
    "byte_count_per_second", "flow_count_per_src", "ip_proto", "pkt_byte_rate_ratio",
    "duration_pkt_ratio", "pkt_rate_per_duration", "avg_bytes_per_pkt", "flow_intensity",
    "bytes_per_duration", "pkt_size_uniformity", "flow_src_intensity",
)
EPS = 1e-9

# --- fixed values: temporal entropy analysis --------------------------------
TICK_S = 0.5
LEARN_MAX = 15
LEARN_MIN = 10
STABLE_VARIANCE = 0.01
REJECT_SIGMA = 3.0
ALPHA_MIN, ALPHA_MAX = 0.02, 0.10
ATTACK_SIGMA, ATTACK_SIGMA_LOW, ATTACK_SIGMA_HIGH, ATTACK_SIGMA_SLOPE = 2.5, 2.0, 2.8, 1.5
SHARE_SIGMA = 1.5
MAD_FACTOR = 3.0
SIZE_TOLERANCE, INTENSITY_TOLERANCE = 0.02, 0.10
UNLOCK_STREAK = 10
VARIANCE_FLOOR = 1e-9
PROFILE_WINDOW, PROFILE_MIN = 20, 5

# --- fixed values: priority, reputation -------------------------------------
VECTOR_SEVERITY = {"SYN Flood": 1.0, "ICMP Flood": 0.8, "UDP Flood": 0.9, "Uncertain": 0.5}
DEFAULT_SEVERITY = 0.5
PRIORITY_TIERS = (("Critical", 0.85), ("High", 0.65), ("Medium", 0.45))
OFFENCE_WEIGHT = 2.0
HALF_LIFE_S = 24 * 3600.0
REPUTATION_CAP = 10.0
BLACKHOLE_REPUTATION = 10.0

# --- fixed values: telemetry gates ------------------------------------------
YOUNG_FLOW_NS = 10_000_000
LOW_RATE_FLOOR = 0.05
LOW_RATE_FRACTION = 0.1
STALE_S = 3.0
HOLD_S = 15.0
PACKET_IN_LIMIT = 1000
TRACKED_SOURCES = 500
INFERENCE_TTL_S = 1.0


@dataclass(frozen=True)
class LifecycleRules:
    """Fixed values of the mitigation lifecycle; times in seconds.

    ``unit_s`` stretches the clock: with 86400 one rule second is one day.
    """

    unit_s: float = 1.0
    tick_s: float = 1.0
    phase1_s: dict[str, float] = field(default_factory=lambda: {
        "Critical": 5.0, "High": 20.0, "Medium": 15.0, "Low": 10.0})
    ban_s: tuple[int, ...] = (30, 60, 120, 300, 600, 1200)
    blackhole_s: int = 3600
    hold_s: float = HOLD_S
    threshold: float = IF_THRESHOLD
    near_factor: float = 0.8
    active_pps: float = 1.0
    sinkhole_observe_s: float = 30.0
    sinkhole_confidence: float = 0.70
    sinkhole_total_s: float = 90.0
    half_life_s: float = HALF_LIFE_S
    offence_cap: int = 5
    clear_all_at: tuple[float, ...] = ()
    as_of: float | None = None
