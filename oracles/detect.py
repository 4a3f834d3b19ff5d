"""Oracles of the end-to-end detection and the two-stage cascade, with the models written down."""

import re

from oracles.base import COUNTED_FLOWS, FLOWS_BASE, PACKETS, RESULTS, WHITELIST, query
from oracles.flows import NUM, POLLS, SCALED
from oracles.fusion import COMPOSITE, PROFILE, TIER, snapshot, verdict_walk
from oracles.packets import TRIPS_ACKS

KEY = "src_ip, l_orderkey, l_linenumber, l_partkey"
ORDER = "ts, l_orderkey, l_linenumber, l_partkey"
BY_SIZE = "CASE WHEN {size} <= 1500 THEN [0.1, 0.8, 0.05] ELSE [0.7, 0.1, 0.2] END"
BY_PROTO = "CASE WHEN {proto} <= 3 THEN [0.9, 0.05, 0.05] WHEN {proto} <= 10 THEN [0.05, 0.85, 0.1] ELSE [0.0, 0.0, 1.0] END"


def classed(source: str, proto: str) -> str:
    """CTE named: anomalous rows of ``source`` with class and confidence."""
    a, b = BY_PROTO.format(proto=proto), BY_SIZE.format(size="byte_count / (packet_count + 1e-9)")
    p = f"list_transform([1, 2, 3], lambda k: CAST((2 * ({a})[k] + ({b})[k]) / 3 AS DOUBLE))"
    return f"""named AS (SELECT *, CASE WHEN confidence >= 0.7 THEN ['ICMP Flood', 'SYN Flood', 'UDP Flood'][list_position(p, confidence)] ELSE 'Uncertain' END AS attack_class
      FROM (SELECT *, list_max(p) AS confidence FROM (SELECT *, {p} AS p FROM {source} WHERE is_anomaly = 1)))"""


def locked_ticks(rows: str, ticks: str, streak: int) -> str:
    """CTE lk: is any anomaly among the last ``streak`` rows of ``rows`` before the tick (or fewer, if none but those were)?"""
    return f""", fed AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS no FROM {rows}), fed2 AS (
      SELECT ts, no, no - max(CASE WHEN is_anomaly = 1 THEN no END) OVER (ORDER BY no) AS since FROM fed), ends AS (
      SELECT ts, arg_max(since, no) AS since FROM fed2 GROUP BY ts), lk AS MATERIALIZED (
      SELECT tick_ts, coalesce(since < {streak}, false) AS locked FROM (SELECT DISTINCT ts AS tick_ts FROM {ticks}) ASOF LEFT JOIN ends ON tick_ts > ends.ts)"""


SCORED = SCALED.removeprefix(FLOWS_BASE)

# packets carry the flows' sources, 8400 days earlier
CAME = PACKETS.replace("packets AS (", "first_packets AS (", 1) + """, packets AS (
  SELECT * REPLACE ('10.1' || substr(src_ip, 5) AS src_ip, ts - INTERVAL 8400 DAY AS ts) FROM first_packets)"""

SAMPLES = FLOWS_BASE[:FLOWS_BASE.index(", timed AS")] + f""", sampled AS (
  SELECT * REPLACE (flow_duration_sec - 1 AS flow_duration_sec, CAST(CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE ip_proto END AS BIGINT) AS ip_proto,
      CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE tp_src END AS tp_src, CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE tp_dst END AS tp_dst),
    l_orderkey % 5 AS wait_s, row_number() OVER (PARTITION BY dpid, poll_id, src_ip ORDER BY l_orderkey, l_linenumber, l_partkey) AS flow_count_per_src
  FROM flows_base), grown AS (
  SELECT * EXCLUDE (first_ts) FROM (SELECT *, min(ts) OVER (PARTITION BY dpid) AS first_ts FROM sampled)
  WHERE NOT (flow_duration_sec = 0 AND flow_duration_nsec < 10000000) OR ts = first_ts), heard AS (
  SELECT *, {NUM} AS num FROM packets), heard2 AS (
  SELECT dpid, src_ip, ts, event_id, last_value(CASE WHEN num IN (6, 17) THEN num END IGNORE NULLS) OVER a AS s1, count(CASE WHEN num <> 0 THEN 1 END) OVER a AS k1,
    last_value(CASE WHEN num IN (6, 17) THEN num END IGNORE NULLS) OVER b AS s2, count(CASE WHEN num <> 0 THEN 1 END) OVER b AS k2,
    last_value(CASE WHEN num IN (6, 17) THEN event_id END IGNORE NULLS) OVER b AS e2
  FROM heard WINDOW a AS (PARTITION BY dpid, src_ip ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY src_ip ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
by_switch AS (SELECT dpid, src_ip, ts, coalesce(arg_max(s1, event_id), CASE WHEN max(k1) > 0 THEN 1 END) AS p1 FROM heard2 GROUP BY ALL),
by_source AS (SELECT src_ip, ts, coalesce(arg_max(s2, event_id), CASE WHEN max(k2) > 0 THEN 1 END) AS p2, arg_max(e2, event_id) AS e2 FROM heard2 GROUP BY ALL),
found1 AS (SELECT g.*, b.p1 FROM grown g ASOF LEFT JOIN by_switch b ON g.dpid = b.dpid AND g.src_ip = b.src_ip AND g.ts >= b.ts),
found2 AS (SELECT g.*, b.p2, b.e2 FROM found1 g ASOF LEFT JOIN by_source b ON g.src_ip = b.src_ip AND g.ts >= b.ts), timed AS (
  SELECT * REPLACE (CAST(coalesce(nullif(ip_proto, 0), p1, p2, 0) AS BIGINT) AS ip_proto, coalesce(nullif(tp_src, 0), e2 % 65536, 0) AS tp_src,
      coalesce(nullif(tp_dst, 0), e2 % 1024, 0) AS tp_dst), greatest(flow_duration_sec + flow_duration_nsec / 1e9, 1e-9) AS total_s FROM found2), flows AS MATERIALIZED (
  SELECT *, packet_count / total_s AS packet_count_per_second, byte_count / total_s AS byte_count_per_second FROM timed)"""

PHASES = """, phases AS (SELECT src_ip, l_shipdate AS ts, arg_max(l_orderkey % 4, l_orderkey * 10 + l_linenumber) AS phase FROM flows_base, (SELECT 1) WHERE l_partkey % 40 = 0 GROUP BY ALL)"""

GATED = re.sub(r"\bwalk\b", "ack_walk", TRIPS_ACKS.replace(PACKETS, CAME, 1)) + ", " + SAMPLES + PHASES.replace("l_shipdate", "ts") + f""", flags AS (
  SELECT src_ip, min(CASE WHEN reason IS NOT NULL THEN ts END) AS flag_from, max(ts) + INTERVAL 5 DAY AS flag_to FROM rows_ GROUP BY src_ip, ep HAVING count(reason) > 0)
""" + PROFILE.removeprefix(FLOWS_BASE) + """, gated AS MATERIALIZED (
  SELECT s.* EXCLUDE (a, n, m, s, vl, vp, trend, norm, cv), EXISTS (SELECT 1 FROM flags f WHERE f.src_ip = s.src_ip AND s.ts BETWEEN f.flag_from AND f.flag_to) AS flagged,
    CASE WHEN n < 5 THEN 'uncertain' WHEN trend > m*greatest(0.05, least(0.2, 0.1*(1+cv))) OR norm < greatest(0.25, least(0.55, 0.4 - cv*0.15)) THEN 'attack'
      WHEN trend < -(m*greatest(0.05, least(0.2, 0.1*(1+cv)))) OR m < (list_avg(a[1:3]) + 1e-9)*0.5 THEN 'normal' ELSE 'uncertain' END AS ip_verdict
  FROM st2 s)""" + POLLS.removeprefix(FLOWS_BASE) + """, came AS (SELECT dpid, date_diff('day', DATE '1995-01-01', CAST(ts AS DATE)) AS poll_id, count(*) / 0.01::DOUBLE AS rate_in FROM packets GROUP BY ALL),
paced AS (SELECT p.dpid, p.poll_id, p.disp_pakt, p.dominant_proto, CASE WHEN lag(disp_pakt) OVER w IS NULL THEN 0.0 ELSE
    greatest(greatest(disp_pakt - lag(disp_pakt) OVER w, 0) / greatest(p.poll_id - lag(p.poll_id) OVER w, 0.1::DOUBLE), coalesce(rate_in, 0)) END AS switch_delta_pps
  FROM polls p LEFT JOIN came c ON p.dpid = c.dpid AND p.poll_id = c.poll_id WINDOW w AS (PARTITION BY p.dpid ORDER BY p.poll_id))""" + SCORED + f""",
ready AS (SELECT g.* REPLACE (coalesce(nullif(g.ip_proto, 0), q.dominant_proto, 0) AS ip_proto), q.disp_pakt, q.switch_delta_pps, ph.phase,
    g.packet_count_per_second < 2.0 AND NOT g.flagged AS low_rate
  FROM gated g LEFT JOIN paced q ON g.dpid = q.dpid AND g.poll_id = q.poll_id ASOF LEFT JOIN phases ph ON g.src_ip = ph.src_ip AND g.ts >= ph.ts
  WHERE g.src_ip <> '10.1.0.7' AND g.src_ip NOT IN {WHITELIST} AND NOT g.wait_s > 3),
scored AS MATERIALIZED (SELECT r.*, CASE WHEN low_rate THEN 0.0 ELSE fs.s END AS if_score, CAST(NOT low_rate AND fs.s >= 0.58 AS BIGINT) AS is_anomaly
  FROM ready r JOIN fs USING (src_ip, poll_id, dpid, l_orderkey, l_linenumber, l_partkey, l_suppkey))"""

SURE = "attack_class <> 'Uncertain' AND confidence >= 0.7"
DETECT = verdict_walk(GATED + snapshot("'all'").removeprefix(FLOWS_BASE), locked_ticks("(SELECT * FROM scored WHERE NOT low_rate)", "gated", 3)) + ", " + classed("scored", "ip_proto") + f""",
grouped AS (SELECT src_ip, ts, max(CASE WHEN {SURE} THEN struct_pack(c := confidence, k := attack_class) END) AS best FROM named GROUP BY ALL), remembered AS (
  SELECT src_ip, ts, last_value(best IGNORE NULLS) OVER (PARTITION BY src_ip ORDER BY ts RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS prior FROM grouped),
carried AS (SELECT n.* REPLACE (CASE WHEN attack_class = 'Uncertain' AND prior IS NOT NULL THEN prior.k ELSE attack_class END AS attack_class,
    CASE WHEN attack_class = 'Uncertain' AND prior IS NOT NULL THEN prior.c ELSE confidence END AS confidence) FROM named n JOIN remembered r ON n.src_ip = r.src_ip AND n.ts = r.ts),
held AS (SELECT *, max(struct_pack(c := confidence, t := ts, o := l_orderkey, l := l_linenumber, q := l_partkey, k := attack_class))
    OVER (PARTITION BY src_ip ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING) AS lk FROM carried),
final AS (SELECT * EXCLUDE (p, lk) REPLACE (lk.c AS confidence, lk.k AS attack_class) FROM held
  UNION ALL BY NAME SELECT *, 0.0 AS confidence, 'Normal' AS attack_class FROM scored WHERE is_anomaly = 0),
judged AS (SELECT f.*, coalesce(f.phase IN (2, 3), false) AS banned, coalesce(w.attack, false) AS w_attack, coalesce(w.confidence, 'low') AS w_conf, coalesce(w.ready, false) AS w_ready,
    {COMPOSITE.format(pps='packet_count_per_second', rep='0.0').replace('if_score*confidence', 'if_score*f.confidence')} AS composite
  FROM final f LEFT JOIN (SELECT * FROM walk WHERE rn > 0) w ON f.ts = w.tick_ts),
said AS (SELECT *, NOT banned AND ip_verdict = 'attack' AS forced, {TIER.format(c='composite')} AS priority FROM judged),
told AS (SELECT *, (w_attack AND NOT banned) OR forced AS tea_attack_pattern, CASE WHEN forced THEN 'moderate' WHEN banned THEN 'low' ELSE w_conf END AS tea_confidence,
    w_ready AND NOT banned AS tea_is_learned FROM said)"""

SQL = {
    "detect": query(DETECT, f"""SELECT {KEY}, ts, flagged, low_rate, round(if_score, 6) AS if_score, is_anomaly, attack_class, round(confidence, 6) AS confidence, ip_proto, disp_pakt,
      round(switch_delta_pps, 6) AS switch_delta_pps, ip_verdict, CAST(coalesce(phase, -1) AS INTEGER) AS phase, tea_attack_pattern, tea_confidence, tea_is_learned, priority,
      CASE WHEN tea_attack_pattern AND tea_confidence = 'high' AND priority IN ('Low', 'Medium') THEN 'High' ELSE priority END AS logged_priority FROM told""", recursive=True),
    "tick_locks": query(RESULTS + locked_ticks("(SELECT * FROM results WHERE l_partkey % 50 = 0)", "results", 3).replace(f"ORDER BY {ORDER})", f"ORDER BY {ORDER}, l_suppkey)", 1),
                        "SELECT tick_ts, locked FROM lk"),
    "cascade_literal": query(COUNTED_FLOWS.replace(FLOWS_BASE, SCALED, 1) + ", scored AS (SELECT *, CASE WHEN packet_count_per_second < 2.0 THEN 0.0 ELSE s END AS if_score, "
                             "CAST(packet_count_per_second >= 2.0 AND s >= 0.58 AS BIGINT) AS is_anomaly FROM fs), " + classed("scored", "ip_proto"),
                             f"""SELECT {KEY}, round(if_score, 6) AS if_score, is_anomaly, attack_class, round(confidence, 6) AS confidence FROM named
      UNION ALL SELECT {KEY}, round(if_score, 6), is_anomaly, 'Normal', 0.0 FROM scored WHERE is_anomaly = 0"""),
}
