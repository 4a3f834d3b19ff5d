"""CTE texts shared by the oracle queries: the adapters in DuckDB's dialect."""

from __future__ import annotations

THR = "0.6092241858026261"


def ip(prefix: str, col: str) -> str:
    return f"'{prefix}.' || ({col} // 250) || '.' || ({col} % 250 + 1)"


PACKETS = f"""packets AS (
  SELECT event_id, ts, user_id % 9 + 1 AS dpid, {ip('10.0', 'user_id')} AS src_ip, '10.0.0.20' AS dst_ip,
    CASE WHEN event_type IN ('click','purchase') THEN 'TCP' WHEN event_type='error' THEN 'ICMP'
         WHEN event_type='view' THEN 'UDP' ELSE 'OTHER' END AS proto,
    event_type='click' AS tcp_flags_syn, event_type='purchase' AS tcp_flags_ack
  FROM events)"""

CLASSIFIED = PACKETS + """, classified AS (
  SELECT *, CASE WHEN proto='TCP' AND tcp_flags_syn AND NOT tcp_flags_ack THEN 'SYN'
                 WHEN proto='TCP' AND tcp_flags_ack THEN 'ACK'
                 WHEN proto IN ('ICMP','UDP') THEN proto END AS flood_proto
  FROM packets)"""

WHITELIST = "('', '0.0.0.0', '10.0.0.20', '10.0.0.21')"

COUNTED = CLASSIFIED + f""", counted AS (
  SELECT *, count(*) OVER (PARTITION BY src_ip, flood_proto ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n_window,
    count(*) OVER (PARTITION BY src_ip, flood_proto ORDER BY ts RANGE BETWEEN INTERVAL 144 MINUTE PRECEDING AND CURRENT ROW) AS n_burst_short,
    count(*) OVER (PARTITION BY src_ip, flood_proto ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW) AS n_burst_long,
    CAST(max(CASE WHEN flood_proto='SYN' THEN 1 ELSE 0 END) OVER w + max(CASE WHEN flood_proto='ICMP' THEN 1 ELSE 0 END) OVER w
      + max(CASE WHEN flood_proto='UDP' THEN 1 ELSE 0 END) OVER w AS INTEGER) AS active_protocols,
    ts - lag(ts) OVER (PARTITION BY src_ip ORDER BY ts) AS gap
  FROM classified WHERE flood_proto IN ('SYN','ICMP','UDP') AND src_ip NOT IN {WHITELIST}
  WINDOW w AS (PARTITION BY src_ip ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW))"""

TRIPS = COUNTED + """, numbered AS (
  SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 5 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip ORDER BY ts, event_id) AS ep
  FROM counted), rows_ AS (
  SELECT *, min(ts) OVER (PARTITION BY src_ip, ep) AS episode_start,
    CASE WHEN flood_proto='SYN' THEN 4 ELSE 3 END AS lim,
    CASE WHEN n_window >= CASE WHEN flood_proto='SYN' THEN 4 ELSE 3 END
         THEN 'limit=' || n_window || '>=' || CASE WHEN flood_proto='SYN' THEN 4 ELSE 3 END || ' in 86400.0s'
         WHEN n_burst_short >= 2 THEN 'burst=' || n_burst_short || '>=2 in 8640.0s'
         WHEN n_burst_long >= 2 THEN 'burst=' || n_burst_long || '>=2 in 43200.0s' END AS reason
  FROM numbered), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY src_ip, flood_proto, ep ORDER BY ts, event_id) AS rn
  FROM rows_ WHERE reason IS NOT NULL), first_trips AS (
  SELECT src_ip, flood_proto, episode_start, ts AS trip_ts, event_id AS trip_event_id, reason, dpid FROM ranked WHERE rn = 1),
spotted AS (
  SELECT r.src_ip, r.episode_start, min(r.ts) AS multi_vector_ts
  FROM rows_ r JOIN first_trips t ON r.src_ip=t.src_ip AND r.flood_proto=t.flood_proto AND r.episode_start=t.episode_start
  WHERE r.active_protocols >= 2 AND (r.ts, r.event_id) >= (t.trip_ts, t.trip_event_id)
  GROUP BY ALL), trips AS (
  SELECT t.*, s.multi_vector_ts, coalesce(s.multi_vector_ts <= t.trip_ts, false) AS correlated
  FROM first_trips t LEFT JOIN spotted s ON t.src_ip=s.src_ip AND t.episode_start=s.episode_start)"""

FLOWS_BASE = f"""flows_base AS (
  SELECT l_shipdate AS ts, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS poll_id,
    CAST(l_linenumber AS BIGINT) AS dpid, {ip('10.1', 'l_suppkey')} AS src_ip,
    CAST(CASE l_returnflag WHEN 'A' THEN 6 WHEN 'N' THEN 17 ELSE 1 END AS BIGINT) AS ip_proto,
    CAST(floor(l_quantity) AS BIGINT) AS packet_count, CAST(floor(l_extendedprice) AS BIGINT) AS byte_count,
    CAST(1 + CAST(floor(l_tax*100+0.5) AS BIGINT) AS DOUBLE) AS flow_duration_sec,
    CAST(CAST(floor(l_discount*100+0.5) AS BIGINT) * 10000000 AS DOUBLE) AS flow_duration_nsec,
    l_partkey % 65536 AS tp_src, l_orderkey % 1024 AS tp_dst,
    {ip('10.3', '(l_partkey % 100)')} AS dst_ip, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_discount, l_tax
  FROM lineitem), timed AS (
  SELECT *, greatest(flow_duration_sec + flow_duration_nsec / 1e9, 1e-9) AS total_s FROM flows_base), flows AS (
  SELECT *, packet_count / total_s AS packet_count_per_second, packet_count / total_s / 1e9 AS packet_count_per_nsecond,
    byte_count / total_s AS byte_count_per_second, byte_count / total_s / 1e9 AS byte_count_per_nsecond
  FROM timed)"""

COUNTED_FLOWS = FLOWS_BASE + """, cflows AS (
  SELECT *, row_number() OVER (PARTITION BY dpid, poll_id, src_ip ORDER BY l_orderkey, l_linenumber, l_partkey) AS flow_count_per_src
  FROM flows)"""

RESULTS = FLOWS_BASE + f""", results AS (
  SELECT *, 0.4 + l_discount*3 AS if_score, CAST(CASE WHEN 0.4 + l_discount*3 >= {THR} THEN 1 ELSE 0 END AS BIGINT) AS is_anomaly,
    0.5 + l_tax*6 AS confidence,
    CASE WHEN 0.5 + l_tax*6 < 0.7 THEN 'Uncertain' WHEN ip_proto=6 THEN 'SYN Flood' WHEN ip_proto=1 THEN 'ICMP Flood'
         ELSE 'UDP Flood' END AS attack_class,
    packet_count_per_second AS pps
  FROM flows)"""

HISTORY = f"""history AS (
  SELECT o_orderkey AS id, {ip('10.2', 'o_custkey')} AS src_ip,
    CASE o_orderkey % 3 WHEN 0 THEN 'SYN Flood' WHEN 1 THEN 'ICMP Flood' ELSE 'UDP Flood' END AS attack_vector,
    0.4 + (o_orderkey % 61) / 100.0::DOUBLE AS if_score, (o_orderkey % 101) / 100.0::DOUBLE AS confidence,
    ['Low','Medium','High','Critical'][CAST(o_orderkey % 4 + 1 AS BIGINT)] AS priority,
    o_orderkey % 3 + 1 AS phase_reached, o_orderdate - to_seconds(o_orderkey % 7200) AS first_seen,
    o_orderdate AS unblocked_at, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) - 1 AS ban_level,
    o_orderkey % 5 AS offence_count,
    CASE o_orderstatus WHEN 'F' THEN 'Ban Expired' WHEN 'O' THEN 'Attack Stopped' ELSE 'Manual Release' END AS unblock_reason
  FROM orders)"""

GT = f"""gt AS (
  SELECT {ip('10.1', 's_suppkey')} AS src_ip,
    CASE WHEN s_suppkey % 8 = 7 THEN 'MIXED' WHEN s_suppkey % 4 = 1 THEN 'SYN' WHEN s_suppkey % 4 = 2 THEN 'ICMP' ELSE 'UDP' END AS attack_type,
    TIMESTAMP '1996-01-01' + to_days(CAST(s_suppkey % 365 AS INTEGER)) AS start_ts,
    CASE WHEN s_suppkey % 5 <> 0 THEN TIMESTAMP '1996-01-01' + to_days(CAST(s_suppkey % 365 AS INTEGER)) + to_days(365) END AS end_ts
  FROM supplier WHERE s_suppkey % 4 <> 0)"""

METRICS = """metrics AS (
  SELECT event_id AS id, ts AS timestamp, least(value, 100.0) AS cpu_percent, value + 50 AS mem_mb, value AS pps_processed,
    CAST(event_type='error' AS BIGINT) AS is_attack, least(value*2, 100.0) AS ctrl_cpu_percent, value + 50 AS ctrl_mem_mb,
    CAST(event_type='purchase' AS BIGINT) AS is_mitigating FROM events)"""

MITIGATION = f"""mitigation AS (
  SELECT event_id AS id, ts AS timestamp, {ip('10.0', 'user_id')} AS src_ip, 'DDoS' AS predicted_class,
    CASE event_id % 5 WHEN 0 THEN 'Uncertain' WHEN 1 THEN 'SYN Flood' WHEN 2 THEN 'ICMP Flood' ELSE 'UDP Flood' END AS attack_vector,
    (event_id % 101) / 100.0::DOUBLE AS confidence,
    ['Low','Medium','High','Critical'][CAST(event_id % 4 + 1 AS BIGINT)] AS priority,
    CASE event_type WHEN 'click' THEN 'Quarantined' WHEN 'view' THEN 'Time Ban (1m)' WHEN 'error' THEN 'Blackhole'
         WHEN 'purchase' THEN 'Released' ELSE 'Sinkhole' END AS action_taken,
    0.4 + (event_id % 61) / 100.0::DOUBLE AS if_score,
    CASE event_type WHEN 'click' THEN 'Quarantined' WHEN 'view' THEN 'Time Ban' WHEN 'error' THEN 'Blackhole'
         WHEN 'purchase' THEN 'Time Ban' ELSE 'Sinkhole' END AS phase,
    CAST(event_id % 50 = 0 AS BIGINT) AS is_manual,
    CASE WHEN event_type='purchase' THEN 'released' ELSE 'transition' END AS event_type,
    CAST(NULL AS VARCHAR) AS reason,
    CASE WHEN event_id % 7 <> 0 THEN value END AS detection_ms, value / 10 AS mitigation_ms,
    substr(sha256({ip('10.0', 'user_id')} || '|' || event_id), 1, 12) AS session_id
  FROM events)"""


def query(ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"
