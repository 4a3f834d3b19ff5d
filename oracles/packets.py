"""Oracles of the packet and prefilter queries."""

from oracles.base import CLASSIFIED, PACKETS, TRIPS, COUNTED, WHITELIST, query

# each source's packets in order; an ACK forgets the oldest SYN, at most once in 72 minutes
ACKS = COUNTED + f""", px AS MATERIALIZED (SELECT event_id, src_ip, ts, flood_proto, row_number() OVER (PARTITION BY src_ip ORDER BY ts, event_id) AS rn
    FROM classified WHERE flood_proto IS NOT NULL AND src_ip NOT IN {WHITELIST}), walk AS (
  SELECT DISTINCT src_ip, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, CAST([] AS TIMESTAMP[]) AS l, CAST(NULL AS TIMESTAMP) AS popped, CAST(NULL AS TIMESTAMP) AS seen,
    CAST(NULL AS TIMESTAMP) AS now_ts, '' AS kind FROM px
  UNION ALL
  SELECT src_ip, rn, event_id,
    CASE WHEN kind = 'SYN' THEN list_filter(list_append(l0, now_ts), lambda t: t >= now_ts - INTERVAL 1 DAY) WHEN pops THEN l0[2:] ELSE l0 END,
    CASE WHEN pops THEN now_ts ELSE p0 END, CASE WHEN kind = 'ACK' THEN seen ELSE now_ts END, now_ts, kind
  FROM (SELECT *, kind = 'ACK' AND len(l0) > 0 AND now_ts - seen <= INTERVAL 5 DAY AND (p0 IS NULL OR now_ts - p0 >= INTERVAL 72 MINUTE) AS pops FROM (
    SELECT x.src_ip, x.rn, x.event_id, x.ts AS now_ts, x.flood_proto AS kind, w.seen,
      CASE WHEN x.flood_proto <> 'ACK' AND w.seen IS NOT NULL AND x.ts - w.seen > INTERVAL 5 DAY THEN CAST([] AS TIMESTAMP[]) ELSE w.l END AS l0,
      CASE WHEN x.flood_proto <> 'ACK' AND w.seen IS NOT NULL AND x.ts - w.seen > INTERVAL 5 DAY THEN NULL ELSE w.popped END AS p0
    FROM walk w JOIN px x ON x.src_ip = w.src_ip AND x.rn = w.rn + 1))), syn AS (
  SELECT event_id, src_ip, kind, CAST(len(list_filter(l, lambda t: t >= now_ts - INTERVAL 1 DAY)) > 0 AS INTEGER) AS syn_active, len(l) AS a, len(list_filter(l, lambda t: t >= now_ts - INTERVAL 144 MINUTE)) AS b, len(list_filter(l, lambda t: t >= now_ts - INTERVAL 12 HOUR)) AS c FROM walk WHERE kind <> 'ACK'),
counted_acks AS (SELECT c.* REPLACE (CASE WHEN s.kind = 'SYN' THEN s.a ELSE n_window END AS n_window, CASE WHEN s.kind = 'SYN' THEN s.b ELSE n_burst_short END AS n_burst_short,
    CASE WHEN s.kind = 'SYN' THEN s.c ELSE n_burst_long END AS n_burst_long, CAST(s.syn_active + max(CAST(c.flood_proto = 'ICMP' AS INTEGER)) OVER w
    + max(CAST(c.flood_proto = 'UDP' AS INTEGER)) OVER w AS INTEGER) AS active_protocols)
  FROM counted c JOIN syn s USING (event_id) WINDOW w AS (PARTITION BY c.src_ip ORDER BY c.ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW))"""
TRIPS_ACKS = ACKS + TRIPS.removeprefix(COUNTED).replace("FROM counted)", "FROM counted_acks)", 1)

SQL = {
    "ack_popback": query(ACKS, "SELECT event_id, src_ip, a AS n_window, b AS n_burst_short, c AS n_burst_long FROM syn WHERE kind = 'SYN'", recursive=True),
    "parse_telemetry": query(PACKETS, "SELECT dpid, src_ip, dst_ip, proto, tcp_flags_syn, tcp_flags_ack FROM packets"),
    "flood_trips_with_acks": query(TRIPS_ACKS, "SELECT src_ip, flood_proto, episode_start, trip_ts, reason, correlated FROM trips", recursive=True),
    "classify_packet": query(CLASSIFIED, "SELECT event_id, src_ip, coalesce(flood_proto,'none') AS flood_proto FROM classified"),
    "filter_scoreable": query(PACKETS, f"SELECT event_id, src_ip FROM packets WHERE src_ip NOT IN {WHITELIST}"),
    "flood_windows": query(COUNTED, "SELECT event_id, src_ip, flood_proto, n_window, n_burst_short, n_burst_long, active_protocols FROM counted"),
    "flood_trips": query(TRIPS, "SELECT src_ip, flood_proto, episode_start, trip_ts, reason, correlated FROM trips"),
    "multi_vector": query(TRIPS, """SELECT src_ip, episode_start, min(multi_vector_ts) AS multi_vector_ts FROM trips
      WHERE multi_vector_ts IS NOT NULL GROUP BY ALL"""),
    "flag_intervals": query(TRIPS, """SELECT src_ip, episode_start, min(CASE WHEN reason IS NOT NULL THEN ts END) AS flag_from,
      max(ts) + INTERVAL 5 DAY AS flag_to FROM rows_ GROUP BY ALL HAVING count(reason) > 0"""),
    "flag_intervals_with_acks": query(TRIPS_ACKS, """SELECT src_ip, episode_start, min(CASE WHEN reason IS NOT NULL THEN ts END) AS flag_from,
      max(ts) + INTERVAL 5 DAY AS flag_to FROM rows_ GROUP BY ALL HAVING count(reason) > 0""", recursive=True),
    "prefilter_breakdown": query(TRIPS, """SELECT flood_proto, count(*) AS flagged, count(CASE WHEN reason LIKE 'burst%' THEN 1 END) AS by_burst,
      count(CASE WHEN reason LIKE 'limit%' THEN 1 END) AS by_limit, count(multi_vector_ts) AS correlated FROM trips GROUP BY ALL"""),
    "packet_rate_limiter": query(PACKETS + """, ordered AS (
        SELECT event_id, dpid, ts, row_number() OVER (PARTITION BY dpid ORDER BY ts, event_id) AS rn FROM packets), walk AS (
        SELECT event_id, dpid, ts, rn, ts AS opened, CAST(1 AS BIGINT) AS in_window FROM ordered WHERE rn = 1
        UNION ALL
        SELECT o.event_id, o.dpid, o.ts, o.rn, CASE WHEN o.ts - w.opened >= INTERVAL 1 DAY THEN o.ts ELSE w.opened END,
          CASE WHEN o.ts - w.opened >= INTERVAL 1 DAY THEN 1 ELSE w.in_window + 1 END
        FROM walk w JOIN ordered o ON o.dpid = w.dpid AND o.rn = w.rn + 1)""",
        "SELECT event_id, dpid, in_window, in_window > 30 AS throttled FROM walk", recursive=True),
    "packet_rate_tumbling": query(PACKETS, """SELECT dpid, epoch_us(ts) // 86400000000 AS slot, count(*) AS packets,
      greatest(count(*) - 30, 0) AS over_limit FROM packets GROUP BY ALL"""),
}
