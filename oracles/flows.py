"""Oracles of the flow, gate and feature queries."""

from oracles.base import COUNTED_FLOWS, FLOWS_BASE, PACKETS, RESULTS, THR, query

ID = "src_ip, poll_id, l_orderkey, l_linenumber, l_partkey"
NUM = "CASE proto WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 WHEN 'ICMP' THEN 1 ELSE 0 END"
POLLS = FLOWS_BASE + """, proto_n AS (SELECT dpid, poll_id, ip_proto, count(*) AS n FROM flows GROUP BY ALL), dom AS (
  SELECT dpid, poll_id, ip_proto AS dominant_proto FROM proto_n
  QUALIFY row_number() OVER (PARTITION BY dpid, poll_id ORDER BY n DESC, ip_proto DESC) = 1), polls AS (
  SELECT dpid, poll_id, CAST(sum(packet_count) AS BIGINT) AS disp_pakt, CAST(sum(byte_count) AS BIGINT) AS disp_byte, count(*) AS gfe,
    count(DISTINCT src_ip) AS g_usip, count(DISTINCT dst_ip) AS avg_flow_dst, count(DISTINCT tp_dst) AS active_ports, dominant_proto,
    greatest(count(DISTINCT dst_ip) - 1, 0) AS rfip, round(avg(packet_count), 6) AS mean_pkt, round(avg(byte_count), 6) AS mean_byte,
    round(avg(flow_duration_sec*1e6 + flow_duration_nsec/1000), 6) AS avg_durat
  FROM flows JOIN dom USING (dpid, poll_id) GROUP BY dpid, poll_id, dominant_proto)"""


def log(x: str) -> str:
    return f"ln(1 + greatest({x}, 0))"


RATIOS = {
    "pkt_byte_rate_ratio": "packet_count_per_second / (byte_count_per_second + 1e-9)",
    "flow_intensity": "packet_count * byte_count_per_second",
    "port_entropy": "tp_src / (tp_dst + 1)",
    "bytes_per_duration": "byte_count / (flow_duration_sec + 1e-9)",
    "pkt_size_uniformity": "byte_count / (packet_count + 1e-9) / (byte_count_per_second + 1e-9)",
    "flow_src_intensity": "flow_count_per_src * packet_count_per_second",
}
RAW = ("flow_duration_sec", "packet_count", "byte_count", "packet_count_per_second", "byte_count_per_second",
       "flow_count_per_src", "tp_src", "tp_dst")
LIFE = f"({log('flow_duration_sec*1e9 + flow_duration_nsec')})"


def features(prefix: str, names) -> str:
    out = []
    for n in names:
        if n in RAW:
            e = log(n)
        elif n == "ip_proto":
            e = "CAST(ip_proto AS DOUBLE)"
        elif n == "avg_bytes_per_pkt":
            e = "byte_count / (packet_count + 1e-9)"
        elif n == "duration_pkt_ratio":
            e = log(f"{LIFE} / (packet_count + 1e-9)")
        elif n == "pkt_rate_per_duration":
            e = log(f"packet_count / ({LIFE} + 1e-9)")
        else:
            e = log(RATIOS[n])
        out.append(f"round({e}, 6) AS {prefix}{n}")
    return ", ".join(out)


IF = (*RAW, "ip_proto", "pkt_byte_rate_ratio", "avg_bytes_per_pkt", "flow_intensity", "port_entropy",
      "bytes_per_duration", "pkt_size_uniformity", "flow_src_intensity")
RF = (*RAW[:6], "ip_proto", "pkt_byte_rate_ratio", "duration_pkt_ratio", "pkt_rate_per_duration", "avg_bytes_per_pkt",
      "flow_intensity", "bytes_per_duration", "pkt_size_uniformity", "flow_src_intensity")
PER_PACKET = "byte_count / greatest(packet_count, 1)"
TOTAL_NS = "(flow_duration_sec*1e9 + flow_duration_nsec)"
ALERTS = [
    ("ICMP Flood", "pps > 500", "byte_rate > 51200", "bpp > 0 AND bpp < 100", "pkt_count > 10000", "byte_count > 1000000", "false", "false"),
    ("SYN Flood", "pps > 500", "byte_rate > 5120", "bpp > 0 AND bpp < 70", "pkt_count > 10000", "byte_count > 1000000", "false", "pkt_size_uniformity < 0.05"),
    ("UDP Flood", "pps > 500", "byte_rate > 512000", "bpp > 200", "pkt_count > 10000", "byte_count > 1000000", "port_entropy > 1", "false"),
    ("Uncertain", "pps > 500", "byte_rate > 51200", "false", "pkt_count > 10000", "byte_count > 1000000", "false", "false"),
]
NAMES = ("pps", "byte_rate", "bpp", "pkt_count", "byte_count", "port_entropy", "pkt_size_uniformity")
ALERT_SQL = " UNION ALL ".join(
    f"SELECT {ID}, attack_class, '{n}' AS feature, round(CAST({n} AS DOUBLE), 9) AS value FROM shaped WHERE attack_class = '{c}' AND {cond}"
    for c, *conds in ALERTS for n, cond in zip(NAMES, conds) if cond != "false")

SCALED = FLOWS_BASE + """, sc AS (SELECT *, least(greatest(packet_count / 50.0::DOUBLE, 0), 1) AS a, least(greatest(byte_count / 100000.0::DOUBLE, 0), 1) AS b,
    least(greatest(tp_dst / 1000.0::DOUBLE, 0), 1) AS c FROM flows), fs AS (SELECT *, power(2.0::DOUBLE, -((CASE WHEN a < 0.5 THEN 9.5 WHEN b < 0.9 THEN 7.25 ELSE 3.0 END
    + CASE WHEN c >= 0.3 THEN 8.0 WHEN a < 0.8 THEN 10.0 ELSE 2.5 END)::DOUBLE / 2) / (2 * (ln(255.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2 * 255.0::DOUBLE / 256)) AS s FROM sc)"""

SQL = {
    "apply_scaling": query(SCALED, f"SELECT src_ip, l_orderkey, l_linenumber, l_partkey, round(a, 6) AS scaled_packet_count, round(b, 6) AS scaled_byte_count, round(c, 6) AS scaled_tp_dst FROM sc"),
    "forest_score": query(SCALED, f"SELECT src_ip, l_orderkey, l_linenumber, l_partkey, round(s, 6) AS if_score, CAST(s >= 0.6 AS BIGINT) AS is_anomaly FROM fs"),
    "resolve_protocol": query(PACKETS + f""", n AS (SELECT *, {NUM} AS num FROM packets), c AS (SELECT event_id,
        CAST(CASE WHEN event_id % 4 = 0 THEN num ELSE 0 END AS BIGINT) AS ip_proto,
        last_value(CASE WHEN num IN (6,17) THEN num END IGNORE NULLS) OVER a AS s1, count(CASE WHEN num <> 0 THEN 1 END) OVER a AS k1,
        last_value(CASE WHEN num IN (6,17) THEN num END IGNORE NULLS) OVER b AS s2, count(CASE WHEN num <> 0 THEN 1 END) OVER b AS k2
        FROM n WINDOW a AS (PARTITION BY dpid, src_ip ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),
        b AS (PARTITION BY src_ip ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))""",
        """SELECT event_id, ip_proto, CAST(coalesce(nullif(ip_proto, 0), s1, CASE WHEN k1 > 0 THEN 1 END, s2,
        CASE WHEN k2 > 0 THEN 1 END, 0) AS BIGINT) AS resolved_proto FROM c"""),
    "resolve_ports": query(PACKETS, """SELECT event_id,
        coalesce(last_value(CASE WHEN proto IN ('TCP','UDP') THEN event_id % 65536 END IGNORE NULLS) OVER w, 0) AS port_src,
        coalesce(last_value(CASE WHEN proto IN ('TCP','UDP') THEN event_id % 1024 END IGNORE NULLS) OVER w, 0) AS port_dst
        FROM packets WINDOW w AS (PARTITION BY src_ip ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""),
    "flow_rates": query(FLOWS_BASE, f"""SELECT {ID}, round(packet_count_per_second, 6) AS packet_count_per_second,
        round(byte_count_per_second, 6) AS byte_count_per_second, round(packet_count_per_nsecond*1e9, 6) AS pps_from_ns,
        round(byte_count_per_nsecond*1e9, 6) AS bps_from_ns FROM flows"""),
    "young_flow_gate": query(FLOWS_BASE, f"""SELECT {ID} FROM (SELECT *, min(ts) OVER (PARTITION BY dpid) AS first_ts FROM flows)
        WHERE NOT (flow_duration_sec = 1 AND flow_duration_nsec < 10000000) OR ts = first_ts"""),
    "low_rate_gate": query(FLOWS_BASE, f"""SELECT {ID}, ip_proto <> 6 AND packet_count_per_second < greatest(0.05, flow_duration_sec*8*0.1) AS low_rate FROM flows"""),
    "staleness_gate": query(FLOWS_BASE, f"""SELECT {ID}, CASE WHEN flow_duration_sec <= 3 THEN 'score' WHEN ip_proto = 6 THEN 'hold' ELSE 'drop' END AS route FROM flows"""),
    "estimate_pkt_count": query(FLOWS_BASE, f"""SELECT {ID}, greatest(CASE WHEN ip_proto <> 6 THEN packet_count
        ELSE CAST(round_even(packet_count_per_second, 0) AS BIGINT) END, 1) AS pkts FROM flows"""),
    "flow_delta": query(FLOWS_BASE, f"""SELECT {ID}, greatest(packet_count - lag(packet_count, 1, 0) OVER (PARTITION BY src_ip, dpid
        ORDER BY ts, l_orderkey, l_linenumber, l_partkey), 0) AS delta_packets FROM flows"""),
    "flow_count_per_src": query(COUNTED_FLOWS, f"SELECT {ID}, flow_count_per_src FROM cflows"),
    "switch_poll_stats": query(POLLS + """, came AS (SELECT dpid, poll_id, count(*) / 86400.0::DOUBLE AS rate_pkt_in FROM flows
        WHERE ip_proto = 6 GROUP BY ALL)""", "SELECT polls.*, round(coalesce(rate_pkt_in, 0), 9) AS rate_pkt_in FROM polls LEFT JOIN came USING (dpid, poll_id)"),
    "switch_delta_pps": query(POLLS + ", came AS (SELECT dpid, poll_id, count(*) / 0.01::DOUBLE AS rate FROM flows WHERE ip_proto = 6 GROUP BY ALL)",
        """SELECT dpid, poll_id, round(CASE WHEN lag(disp_pakt) OVER w IS NULL THEN 0.0 ELSE
        greatest(greatest(disp_pakt - lag(disp_pakt) OVER w, 0) / greatest(poll_id - lag(poll_id) OVER w, 0.1::DOUBLE), coalesce(rate, 0)) END, 6) AS switch_delta_pps
        FROM polls LEFT JOIN came USING (dpid, poll_id) WINDOW w AS (PARTITION BY dpid ORDER BY poll_id)"""),
    "drop_delta": query(FLOWS_BASE + """, keyed AS (SELECT *, CASE WHEN poll_id % 5 < 3 THEN src_ip ELSE '__proto__' END AS drop_key
        FROM flows WHERE poll_id % 5 < 4), deltas AS (SELECT *, greatest(packet_count - lag(packet_count, 1, 0) OVER (PARTITION BY drop_key
        ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey), 0) AS delta FROM keyed)""", f"SELECT {ID}, drop_key, delta FROM deltas WHERE delta > 0"),
    "merge_switch_flow": query(POLLS, f"""SELECT {ID}, CASE WHEN l_partkey % 3 = 0 THEN dominant_proto ELSE ip_proto END AS ip_proto, disp_pakt, gfe
        FROM flows JOIN polls USING (dpid, poll_id)"""),
    "latest_flow_per_src": query(FLOWS_BASE, f"""SELECT {ID}, packet_count, byte_count FROM flows
        QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) = 1
        ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC LIMIT 50"""),
    "live_deltas": query(FLOWS_BASE + """, p AS (SELECT poll_id, CAST(sum(CASE WHEN ip_proto=6 THEN packet_count ELSE 0 END) AS BIGINT) AS m,
        CAST(sum(CASE WHEN ip_proto<>6 THEN packet_count ELSE 0 END) AS BIGINT) AS n FROM flows GROUP BY ALL), q AS (
        SELECT *, lag(m, 1, 0) OVER w AS pm, lag(n, 1, 0) OVER w AS pn, lag(m+n, 1, 0) OVER w AS pt FROM p WINDOW w AS (ORDER BY poll_id))""",
        """SELECT poll_id, CASE WHEN pm > 0 THEN greatest(m-pm, 0) ELSE 0 END AS delta_malicious, CASE WHEN pn > 0 THEN greatest(n-pn, 0) ELSE 0 END AS delta_normal,
        CASE WHEN pm > 0 THEN greatest(m-pm, 0) ELSE 0 END + CASE WHEN pn > 0 THEN greatest(n-pn, 0) ELSE 0 END AS delta_total,
        round(CASE WHEN pt > 0 THEN (m+n-pt) / greatest(pt, 1) * 100 ELSE 0.0 END, 6) AS pct_change FROM q"""),
    "flatten_flow_stats": query(FLOWS_BASE, f"""SELECT {ID}, packet_count, byte_count, CAST(0 AS BIGINT) AS idle_timeout,
        round(byte_count_per_second, 6) AS byte_count_per_second FROM flows"""),
    "ground_truth_intervals": query(PACKETS, """SELECT src_ip, attack_type, start_ts, end_ts FROM (SELECT src_ip, proto,
        CASE WHEN proto='ICMP' THEN 'ICMP' ELSE 'SYN' END AS attack_type, ts AS start_ts,
        lead(ts) OVER (PARTITION BY src_ip ORDER BY ts, event_id) AS end_ts FROM packets WHERE proto <> 'OTHER') WHERE proto <> 'UDP'"""),
    "if_features": query(COUNTED_FLOWS, f"SELECT {ID}, {features('if_', IF)} FROM cflows"),
    "rf_features": query(COUNTED_FLOWS, f"SELECT {ID}, {features('rf_', RF)} FROM cflows"),
    "ledger_features": query(COUNTED_FLOWS, f"""SELECT {ID}, round({TOTAL_NS}, 4) AS flow_duration_total_ns, round({PER_PACKET}, 4) AS bytes_per_packet,
        round({RATIOS['pkt_byte_rate_ratio']}, 4) AS pkt_byte_rate_ratio, round({RATIOS['flow_intensity']}, 4) AS flow_intensity,
        round({RATIOS['port_entropy']}, 9) AS port_entropy, round({RATIOS['bytes_per_duration']}, 4) AS bytes_per_duration,
        round({PER_PACKET} / (byte_count_per_second + 1), 4) AS pkt_size_uniformity,
        round({RATIOS['flow_src_intensity']}, 4) AS flow_src_intensity, round({TOTAL_NS} / (packet_count + 1e-9) / 1e9, 6) AS duration_pkt_ratio_e9,
        round(packet_count / ({TOTAL_NS} + 1e-9) * 1e9, 4) AS pkt_rate_per_duration_e9 FROM cflows"""),
    "live_view_features": query(FLOWS_BASE, f"""SELECT {ID}, round({PER_PACKET}, 1) AS bytes_per_packet, """ + ", ".join(f"CAST(round(CAST({e} AS DECIMAL(38, 13)), 4) AS DOUBLE) AS {n}" for n, e in {
        "flow_intensity": log('packet_count*byte_count_per_second'), "flow_src_intensity": log('packet_count*packet_count_per_second'),
        "port_entropy": "tp_src/(tp_dst+1)", "bytes_per_duration": "byte_count/greatest(flow_duration_sec, 1)",
        "pkt_byte_rate_ratio": "packet_count_per_second/byte_count_per_second",
        "pkt_size_uniformity": log(f"round({PER_PACKET}, 1)/(byte_count_per_second+1)")}.items()) + " FROM flows"),
    "class_one_hot": query(RESULTS, f"""SELECT {ID}, CAST(attack_class='SYN Flood' AS BIGINT) AS flag_syn_flood, CAST(attack_class='ICMP Flood' AS BIGINT) AS flag_icmp_flood,
        CAST(attack_class='UDP Flood' AS BIGINT) AS flag_udp_flood, CAST(is_anomaly=0 AS BIGINT) AS flag_normal FROM results"""),
    "impute_nonfinite": query(FLOWS_BASE + """, m AS (SELECT *, l_partkey % 11 = 0 OR l_partkey % 13 = 0 OR l_partkey % 17 = 0 AS bad FROM flows)""",
        f"SELECT {ID}, round(CASE WHEN bad THEN (SELECT avg(packet_count) FROM m WHERE NOT bad) ELSE CAST(packet_count AS DOUBLE) END, 6) AS x FROM m"),
    "map_labels": query(RESULTS, f"""SELECT {ID}, CASE WHEN attack_class='Uncertain' THEN 'Anomaly' ELSE 'DDoS' END AS predicted_class,
        CASE attack_class WHEN 'SYN Flood' THEN 'SYN' WHEN 'ICMP Flood' THEN 'ICMP' WHEN 'UDP Flood' THEN 'UDP' ELSE '-' END AS short_class,
        CAST(CASE attack_class WHEN 'SYN Flood' THEN 6 WHEN 'ICMP Flood' THEN 1 WHEN 'UDP Flood' THEN 17 ELSE 0 END AS BIGINT) AS class_protocol FROM results"""),
    "signal_alerts": query(RESULTS + f""", shaped AS (SELECT {ID}, attack_class, pps*40 AS pps, byte_count_per_second AS byte_rate, byte_count/packet_count/20 AS bpp,
        packet_count*400 AS pkt_count, byte_count*20 AS byte_count, tp_src/(tp_dst+1) AS port_entropy,
        ln(1 + byte_count/packet_count/(byte_count_per_second+1)) AS pkt_size_uniformity FROM results)""", ALERT_SQL),
    "score_band": query(RESULTS, f"""SELECT {ID}, CASE WHEN if_score >= {THR}*1.2 THEN 'red' WHEN if_score >= {THR} THEN 'amber' ELSE 'green' END AS band,
        CASE WHEN l_discount*100+0.5 < 1 THEN 'green' WHEN l_discount*100+0.5 < 5 THEN 'amber' ELSE 'red' END AS fp_band FROM results"""),
    "format_fields": query(RESULTS, f"""SELECT {ID}, printf('%.1f%%', round(l_tax, 2)*100) AS pct,
        CASE WHEN l_orderkey % 7200 >= 60 THEN (l_orderkey % 7200) // 60 || 'm ' || (l_orderkey % 7200) % 60 || 's' ELSE (l_orderkey % 7200) || 's' END AS duration,
        CASE WHEN packet_count*10 >= 60 THEN packet_count*10//60 || 'm' ELSE packet_count*10 || 's' END AS ban,
        CASE ip_proto WHEN 6 THEN 'TCP (6)' WHEN 17 THEN 'UDP (17)' ELSE 'ICMP (1)' END AS protocol,
        CASE WHEN (byte_count*250+1) >= 1e6 THEN printf('%.2f MB/s', (byte_count*250+1)/1e6) WHEN (byte_count*250+1) >= 1e3 THEN printf('%.1f KB/s', (byte_count*250+1)/1e3)
        ELSE printf('%.0f B/s', CAST((byte_count*250+1) AS DOUBLE)) END AS rate FROM results"""),
}
