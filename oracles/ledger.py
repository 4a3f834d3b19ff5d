"""Oracles of the ledger, metric, report and switch-rule queries."""

from oracles.base import CLASSIFIED, FLOWS_BASE, HISTORY, METRICS, MITIGATION, PACKETS, RESULTS, query
from oracles.flows import ID
from oracles.fusion import DECISIONS, LABELLED, counters

FEW = MITIGATION + """, few AS (SELECT * REPLACE (0.4 + (id % 3)/100.0::DOUBLE AS if_score) FROM mitigation), keyed AS (
  SELECT *, src_ip || '|' || CAST(id % 3 AS VARCHAR) || '|' || action_taken || '|' || phase AS k,
    row_number() OVER (PARTITION BY src_ip, id % 3, action_taken, phase ORDER BY timestamp, id) AS rn FROM few)"""


def dedupe(days: int) -> str:
    return FEW + f""", kx AS MATERIALIZED (SELECT k, rn, id, timestamp FROM keyed), walk AS (
  SELECT k, rn, id, timestamp AS kept_at, true AS kept FROM kx WHERE rn = 1
  UNION ALL SELECT x.k, x.rn, x.id, CASE WHEN x.timestamp - w.kept_at > INTERVAL {days} DAY THEN x.timestamp ELSE w.kept_at END,
    x.timestamp - w.kept_at > INTERVAL {days} DAY FROM walk w JOIN kx x ON x.k = w.k AND x.rn = w.rn + 1)"""


FEED = MITIGATION + """, kx AS MATERIALIZED (SELECT id, src_ip, timestamp, action_taken LIKE 'Time Ban%' OR action_taken = 'Blackhole' AS force,
    row_number() OVER (PARTITION BY src_ip ORDER BY timestamp, id) AS rn FROM mitigation), walk AS (
  SELECT src_ip, rn, id, timestamp AS kept_at, true AS kept FROM kx WHERE rn = 1
  UNION ALL SELECT x.src_ip, x.rn, x.id, CASE WHEN x.force OR x.timestamp - w.kept_at >= INTERVAL 12 HOUR THEN x.timestamp ELSE w.kept_at END,
    x.force OR x.timestamp - w.kept_at >= INTERVAL 12 HOUR FROM walk w JOIN kx x ON x.src_ip = w.src_ip AND x.rn = w.rn + 1)"""

STATES = MITIGATION + """, changes AS (SELECT id, src_ip, timestamp, if_score, action_taken, attack_vector, action_taken='Released' AS deleted,
    CAST(CASE phase WHEN 'Quarantined' THEN 1 WHEN 'Time Ban' THEN 2 WHEN 'Blackhole' THEN 3 ELSE 0 END AS BIGINT) AS phase,
    CAST(id % 3 <> 0 AS BIGINT) AS permanent, CASE WHEN id % 5 <> 0 THEN timestamp + to_hours(id % 200) END AS block_expires_at FROM mitigation), states AS (
  SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY timestamp DESC, id DESC) = 1)"""

REPORT = MITIGATION + """, report AS (SELECT * FROM mitigation WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-25 23:59:59'
  QUALIFY row_number() OVER (PARTITION BY src_ip, action_taken ORDER BY timestamp, id) = 1)"""

SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in counters())
SUMMARY = DECISIONS + f""", summary AS (SELECT make_timestamp(CAST(epoch_us(ts) // 432000000000 * 432000000000 AS BIGINT)) AS timestamp, {SUMS},
  CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS rescored, CAST(0 AS BIGINT) AS expired_unscored FROM decisions GROUP BY 1)"""


def rates(tp, fp, tn, fn) -> str:
    p, r = f"({tp}/greatest({tp}+{fp}, 1))", f"({tp}/greatest({tp}+{fn}, 1))"
    vals = {"precision": p, "recall": r, "f1": f"(2*{p}*{r}/greatest({p}+{r}, 1e-9))", "accuracy": f"(({tp}+{tn})/greatest({tp}+{fp}+{tn}+{fn}, 1))",
            "fpr": f"({fp}/greatest({fp}+{tn}, 1))", "fnr": f"({fn}/greatest({fn}+{tp}, 1))", "tpr": r, "tnr": f"({tn}/greatest({tn}+{fp}, 1))"}
    return ", ".join(f"round({v}*100, 2) AS {n}" for n, v in vals.items())


def binary(prefix: str) -> str:
    return query(SUMMARY + f""", s AS (SELECT {', '.join(f'CAST(sum({prefix}{n}) AS DOUBLE) AS {n}' for n in ('tp', 'fp', 'tn', 'fn'))} FROM summary
      WHERE timestamp >= TIMESTAMP '1996-02-01' AND timestamp <= TIMESTAMP '1999-12-31 23:59:59')""",
                 f"SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, {rates('tp', 'fp', 'tn', 'fn')} FROM s")


PAIRS = [(a, b) for a in ("syn", "icmp", "udp") for b in ("syn", "icmp", "udp") if a != b]
CELLS = ", ".join([f"CAST(sum(rf_tp_{t}) AS BIGINT) AS {t}_as_{t}" for t in ("syn", "icmp", "udp")] + [f"CAST(sum(rf_{a}_as_{b}) AS BIGINT) AS {a}_as_{b}" for a, b in PAIRS])
HITS = "sum(rf_tp_syn + rf_tp_icmp + rf_tp_udp)"
WRONG = "sum(" + " + ".join(f"rf_{a}_as_{b}" for a, b in PAIRS) + ")"

COMMANDS = MITIGATION + ", " + PACKETS + """, commands AS (SELECT id, src_ip, timestamp AS ts, CASE WHEN action_taken='Quarantined' THEN 'rate_limit'
    WHEN action_taken LIKE 'Time%' THEN 'block' WHEN action_taken='Blackhole' THEN 'quarantine' WHEN action_taken='Released' THEN 'clear' ELSE 'redirect' END AS action
  FROM mitigation)"""
TOUCH = {"block": "'block','clear'", "quarantine": "'quarantine','clear'", "redirect": "'redirect','clear','block','quarantine','rate_limit'", "rate_limit": "'rate_limit','clear'"}
POLICY = COMMANDS + "".join(
    f""", t_{k} AS (SELECT src_ip, ts, action = '{k}' AS live, {"ts + INTERVAL 2 DAY" if k == "block" else "TIMESTAMP '2999-01-01'"} AS until FROM commands WHERE action IN ({v}))"""
    for k, v in TOUCH.items()) + """, t_clear AS (SELECT src_ip, ts FROM commands WHERE action = 'clear'),
  pblocks AS (SELECT proto, ts, event_id % 3 = 0 AS live FROM packets)"""


def per_switch() -> str:
    """Each command on each of its switches, then the rule of (source, switch)."""
    touched = "".join(f""", t_{k} AS (SELECT src_ip, dpid, ts, action = '{k}' AS live, {"ts + INTERVAL 2 DAY" if k == "block" else "TIMESTAMP '2999-01-01'"} AS until
      FROM aimed WHERE action IN ({v}))""" for k, v in TOUCH.items())
    joins = " ".join(f"ASOF LEFT JOIN t_{k} ON p.src_ip = t_{k}.src_ip AND p.dpid = t_{k}.dpid AND p.ts >= t_{k}.ts" for k in (*TOUCH, "clear"))
    case = " ".join(f"WHEN t_{k}.live AND p.ts < t_{k}.until THEN '{k}'" for k in TOUCH)
    return COMMANDS + """, sw AS (SELECT DISTINCT dpid FROM packets), seen AS (SELECT c.*, p.dpid FROM commands c ASOF LEFT JOIN packets p ON c.src_ip = p.src_ip AND c.ts >= p.ts),
      aimed AS (SELECT id, src_ip, ts, action, dpid FROM seen WHERE action = 'clear' AND dpid IS NOT NULL
        UNION ALL SELECT s.id, s.src_ip, s.ts, s.action, sw.dpid FROM seen s, sw WHERE NOT (s.action = 'clear' AND s.dpid IS NOT NULL))""" + touched + f""",
      t_clear AS (SELECT src_ip, dpid, ts FROM aimed WHERE action = 'clear'), resolved AS (SELECT p.event_id, p.src_ip, CASE {case}
      WHEN p.ts < t_clear.ts + INTERVAL 10 DAY THEN 'permit' ELSE 'forward' END AS rule FROM packets p {joins}), done AS (
      SELECT *, CASE WHEN rule IN ('block','quarantine') THEN 'dropped' WHEN rule='redirect' THEN 'redirected' WHEN rule='rate_limit' THEN 'limited' ELSE 'forwarded' END AS outcome FROM resolved)"""


def policy(proto: bool) -> str:
    joins = " ".join(f"ASOF LEFT JOIN t_{k} ON p.src_ip = t_{k}.src_ip AND p.ts >= t_{k}.ts" for k in (*TOUCH, "clear"))
    extra = "ASOF LEFT JOIN pblocks pb ON p.proto = pb.proto AND p.ts >= pb.ts" if proto else ""
    case = " ".join(f"WHEN t_{k}.live AND p.ts < t_{k}.until THEN '{k}'" for k in TOUCH)
    more = "WHEN pb.live THEN 'proto_drop'" if proto else ""
    return POLICY + f""", resolved AS (SELECT p.event_id, p.src_ip, CASE {case} {more}
      WHEN p.ts < t_clear.ts + INTERVAL 10 DAY THEN 'permit' ELSE 'forward' END AS rule FROM packets p {joins} {extra}), done AS (
      SELECT *, CASE WHEN rule IN ('block','quarantine','proto_drop') THEN 'dropped' WHEN rule='redirect' THEN 'redirected'
        WHEN rule='rate_limit' THEN 'limited' ELSE 'forwarded' END AS outcome FROM resolved)"""


TIERS = METRICS + """, tiers AS (SELECT *, CASE WHEN ctrl_cpu_percent >= 99 OR least(ctrl_mem_mb/150*100, 100) >= 95 THEN 'CRIT'
    WHEN ctrl_cpu_percent >= 95 OR least(ctrl_mem_mb/150*100, 100) >= 85 THEN 'HIGH'
    WHEN ctrl_cpu_percent >= 85 OR least(ctrl_mem_mb/150*100, 100) >= 70 THEN 'WARN' ELSE 'NORMAL' END AS tier FROM metrics)"""
LAST = "ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC"

SQL = {
    "append_mitigation_events": query(dedupe(10), "SELECT m.id, m.src_ip, m.action_taken, m.event_type, m.is_manual FROM walk w JOIN mitigation m USING (id) WHERE w.kept", True),
    "ttl_dedupe": query(dedupe(3), "SELECT m.id, m.src_ip FROM walk w JOIN mitigation m USING (id) WHERE w.kept", True),
    "feed_dedupe": query(FEED, "SELECT id, src_ip FROM walk WHERE kept", True),
    "append_manual_action": query(MITIGATION, """SELECT id, src_ip, 'DDoS' AS predicted_class, CASE WHEN id % 100 = 0 THEN 'Manual Release' ELSE 'Manual Block' END AS action_taken,
        CAST(1 AS BIGINT) AS is_manual, 'manual' AS event_type FROM mitigation WHERE is_manual = 1"""),
    "upsert_quarantine_state": query(STATES, "SELECT src_ip, id, action_taken, round(if_score, 6) AS if_score FROM states WHERE NOT deleted"),
    "restore_states": query(STATES, """SELECT src_ip, CASE WHEN permanent = 0 THEN 'purged' WHEN block_expires_at <= TIMESTAMP '2024-01-31 12:00:00' THEN 'expired' ELSE 'restored' END AS outcome,
        CASE WHEN permanent = 0 OR block_expires_at <= TIMESTAMP '2024-01-31 12:00:00' THEN 'clear' WHEN phase = 3 THEN 'block' ELSE 'rate_limit' END AS command,
        CASE WHEN permanent = 1 AND block_expires_at > TIMESTAMP '2024-01-31 12:00:00'
          THEN (epoch_us(block_expires_at) - epoch_us(TIMESTAMP '2024-01-31 12:00:00')) // 1000000 ELSE -1 END AS ttl FROM states WHERE NOT deleted"""),
    "archive_events": query(MITIGATION, """SELECT id, src_ip, CASE WHEN timestamp >= TIMESTAMP '2024-01-20' THEN 'hot' ELSE 'archive' END AS store, session_id,
        round(mitigation_ms, 6) AS mitigation_ms FROM mitigation"""),
    "append_attack_history": query(HISTORY, """SELECT id, src_ip, CAST(epoch(unblocked_at - first_seen) AS BIGINT) AS duration_sec, round(if_score, 6) AS if_score,
        round(confidence, 6) AS confidence, unblock_reason FROM history"""),
    "append_system_metrics": query(METRICS, """SELECT id, timestamp, round(cpu_percent, 2) AS cpu_percent, round(mem_mb, 2) AS mem_mb, round(pps_processed, 2) AS pps_processed, is_attack,
        round(ctrl_cpu_percent, 2) AS ctrl_cpu_percent, round(ctrl_mem_mb, 2) AS ctrl_mem_mb, is_mitigating FROM metrics"""),
    "dedupe_first": query(MITIGATION, """SELECT src_ip, action_taken, id, timestamp, priority FROM mitigation
        QUALIFY row_number() OVER (PARTITION BY src_ip, action_taken ORDER BY timestamp, id) = 1"""),
    "phase_history": query(MITIGATION, """SELECT src_ip, phase, action_taken, timestamp, id FROM (SELECT *, bool_or(timestamp >= TIMESTAMP '2024-01-29') OVER (PARTITION BY src_ip) AS has_hot FROM mitigation)
        WHERE timestamp >= TIMESTAMP '2024-01-29' OR NOT has_hot QUALIFY row_number() OVER (PARTITION BY src_ip, phase, action_taken ORDER BY timestamp, id) = 1"""),
    "first_detection_per_phase": query(MITIGATION, """SELECT src_ip, id // 500 AS phase_entered, id, timestamp FROM mitigation
        QUALIFY row_number() OVER (PARTITION BY src_ip, id // 500 ORDER BY timestamp, id) = 1"""),
    "incident_collapse": query(MITIGATION + """, m2 AS (SELECT * REPLACE (CASE WHEN id % 4 = 0 THEN 'manual' ELSE event_type END AS event_type,
          CASE WHEN id % 12 = 0 THEN 'Manual Release' ELSE action_taken END AS action_taken) FROM mitigation), r AS (
        SELECT *, CASE WHEN event_type='released' OR (event_type='manual' AND lower(action_taken) LIKE '%release%') THEN 1 ELSE 0 END AS rel FROM m2), n AS (
        SELECT *, sum(rel) OVER (PARTITION BY src_ip, event_type ORDER BY timestamp, id) - rel AS inc FROM r)""",
        """SELECT src_ip, event_type, CAST(inc AS BIGINT) AS incident_no, count(*) AS updates, max_by(id, struct_pack(t := timestamp, i := id)) AS id,
        max_by(action_taken, struct_pack(t := timestamp, i := id)) AS action_taken FROM n GROUP BY src_ip, event_type, inc"""),
    "recent_events": query(MITIGATION, """SELECT id, timestamp, src_ip, printf('%.1f%%', confidence*100) AS confidence, action_taken, event_type FROM mitigation
        WHERE timestamp > TIMESTAMP '2024-01-15' ORDER BY timestamp DESC, id DESC LIMIT 500"""),
    "scan_log": query(RESULTS, f"""SELECT {ID}, CASE WHEN is_anomaly=1 THEN attack_class ELSE 'Normal' END AS attack_class, round(if_score, 4) AS if_score, is_anomaly
        FROM results {LAST} LIMIT 200"""),
    "active_list": query(STATES, """SELECT src_ip, phase, round(if_score, 6) AS if_score, CASE WHEN phase = 0 THEN 'Low' ELSE 'High' END AS priority FROM states WHERE NOT deleted"""),
    "traffic_summary": query(SUMMARY, "SELECT * FROM summary"),
    "traffic_summary_with_holds": query(SUMMARY + """, outcomes AS (SELECT make_timestamp(CAST(epoch_us(ts + to_days(CAST(l_orderkey % 4 AS INTEGER))) // 432000000000 * 432000000000 AS BIGINT)) AS timestamp,
        count(*) AS held, count(CASE WHEN l_orderkey % 3 = 1 THEN 1 END) AS rescored, count(CASE WHEN l_orderkey % 3 = 2 THEN 1 END) AS expired_unscored
        FROM flows WHERE flow_duration_sec > 3 AND ip_proto = 6 GROUP BY 1)""",
        """SELECT coalesce(s.timestamp, o.timestamp) AS timestamp, coalesce(COLUMNS(s.* EXCLUDE (timestamp, held, rescored, expired_unscored)), 0), coalesce(o.held, 0) AS held, coalesce(o.rescored, 0) AS rescored,
        coalesce(o.expired_unscored, 0) AS expired_unscored FROM summary s FULL JOIN outcomes o ON s.timestamp = o.timestamp"""),
    "if_metrics": binary("if_"),
    "ml_metrics": binary(""),
    "class_metrics": query(SUMMARY + ", s AS (" + " UNION ALL ".join(
        f"SELECT '{t}' AS attack_type, CAST(sum(rf_tp_{t}) AS DOUBLE) AS tp, CAST(sum(rf_fp_{t}) AS DOUBLE) AS fp, CAST(sum(rf_tn_{t}) AS DOUBLE) AS tn, CAST(sum(rf_fn_{t}) AS DOUBLE) AS fn FROM summary"
        for t in ("syn", "icmp", "udp")) + ")", f"SELECT attack_type, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, {rates('tp', 'fp', 'tn', 'fn')} FROM s"),
    "confusion_3x3": query(SUMMARY, f"SELECT {CELLS}, round({HITS}/greatest({HITS} + {WRONG}, 1)*100, 2) AS micro FROM summary"),
    "confusion_pivot": query(LABELLED, """SELECT wanted AS expected_class, count(CASE WHEN got='SYN' THEN 1 END) AS syn, count(CASE WHEN got='ICMP' THEN 1 END) AS icmp,
        count(CASE WHEN got='UDP' THEN 1 END) AS udp FROM labelled WHERE an AND wanted IS NOT NULL AND got IS NOT NULL GROUP BY ALL"""),
    "model_accuracy": query(SUMMARY, f"SELECT round(sum(if_tp+if_tn)/sum(if_tp+if_tn+if_fp+if_fn)*100, 1) AS if_accuracy, round({HITS}/({HITS} + {WRONG})*100, 1) AS rf_accuracy FROM summary"),
    "session_stats": query(DECISIONS + ", " + STATES + """, dr AS (SELECT sum(greatest(packet_count - p, 0)) AS x FROM (SELECT packet_count,
        lag(packet_count, 1, 0) OVER (PARTITION BY src_ip ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS p FROM flows WHERE ip_proto = 6))""",
        """SELECT CAST((SELECT x FROM dr) + sum(CASE WHEN an THEN 0 ELSE total END) AS BIGINT) AS total_packets, CAST((SELECT x FROM dr) AS BIGINT) AS malicious_dropped,
        CAST(sum(CASE WHEN an THEN 0 ELSE total END) AS BIGINT) AS normal_packets, (SELECT count(*) FROM states WHERE NOT deleted) AS active_threats,
        round(sum(fp)/count(*)*100, 2) AS fp_rate, round(avg(CASE WHEN an THEN packet_count END), 1) AS avg_latency_ms FROM decisions"""),
    "latency_avg": query(MITIGATION, """SELECT round(avg(detection_ms), 2) AS detection_ms, round(avg(mitigation_ms), 2) AS mitigation_ms FROM mitigation
        WHERE detection_ms IS NOT NULL AND mitigation_ms IS NOT NULL AND timestamp >= TIMESTAMP '2024-01-03' AND timestamp <= TIMESTAMP '2024-01-27 23:59:59'"""),
    "latency_percentiles": query(MITIGATION, """SELECT round(quantile_cont(detection_ms, 0.5), 1) AS p50_ms, round(quantile_cont(detection_ms, 0.95), 1) AS p95_ms,
        round(quantile_cont(detection_ms, 0.99), 1) AS p99_ms, count(*) AS samples FROM (SELECT detection_ms FROM mitigation WHERE detection_ms IS NOT NULL ORDER BY timestamp DESC, id DESC LIMIT 500)"""),
    "system_metrics_avg": query(METRICS, """SELECT round(avg(cpu_percent), 2) AS avg_cpu, round(avg(mem_mb), 2) AS avg_mem, round(avg(pps_processed), 2) AS avg_pps FROM metrics
        WHERE timestamp >= TIMESTAMP '2024-01-02' AND timestamp <= TIMESTAMP '2024-01-20 23:59:59'"""),
    "system_metrics_by_condition": query(METRICS, """SELECT round(avg(CASE WHEN is_attack=1 THEN ctrl_cpu_percent END), 2) AS attack_ctrl_cpu,
        round(avg(CASE WHEN is_attack=0 THEN ctrl_cpu_percent END), 2) AS baseline_ctrl_cpu, round(avg(CASE WHEN is_mitigating=1 THEN ctrl_cpu_percent END), 2) AS mitigation_ctrl_cpu FROM metrics
        WHERE timestamp >= TIMESTAMP '2024-01-02' AND timestamp <= TIMESTAMP '2024-01-20 23:59:59'"""),
    "system_metrics_latest": query(METRICS, """SELECT round(cpu_percent, 2) AS cpu_percent, round(mem_mb, 2) AS mem_mb, round(ctrl_cpu_percent, 2) AS ctrl_cpu_percent,
        round(ctrl_mem_mb, 2) AS ctrl_mem_mb FROM metrics ORDER BY id DESC LIMIT 1"""),
    "score_distribution": query(RESULTS + f", l AS (SELECT * FROM results {LAST} LIMIT 200)", """SELECT count(CASE WHEN is_anomaly=0 THEN 1 END) AS normal,
        count(CASE WHEN is_anomaly=1 THEN 1 END) AS anomaly, round(max(if_score), 4) AS max_score FROM l"""),
    "class_distribution": query(RESULTS + f", l AS (SELECT * FROM results {LAST} LIMIT 50)", "SELECT attack_class, count(*) AS n, round(count(*)/50*100, 2) AS share_pct FROM l GROUP BY ALL"),
    "graph_history": query(SUMMARY + """, b AS (SELECT least(CAST(floor(epoch(timestamp - TIMESTAMP '1996-01-01')/(epoch(TIMESTAMP '1999-01-01' - TIMESTAMP '1996-01-01')/60)) AS BIGINT), 59) AS bucket,
        sum(total) AS i, sum(threats) AS k, sum(true_neg) AS f FROM summary WHERE timestamp >= TIMESTAMP '1996-01-01' AND timestamp <= TIMESTAMP '1999-01-01' GROUP BY 1),
        z AS (SELECT epoch(TIMESTAMP '1999-01-01' - TIMESTAMP '1996-01-01')/60 AS size)""", """SELECT r.range AS bucket, round(coalesce(i, 0)/size, 2) AS incoming,
        round(coalesce(k, 0)/size, 2) AS blocked, round(coalesce(f, 0)/size, 2) AS forwarded FROM range(60) r LEFT JOIN b ON r.range = b.bucket, z"""),
    "executive_summary": query(REPORT + """, k AS (SELECT attack_vector AS vector, CASE WHEN action_taken LIKE 'Time Ban%' THEN 'Time Ban' ELSE action_taken END AS action,
        CAST(lower(priority)='high' AS BIGINT) AS h, CAST(is_manual=1 AND action_taken LIKE '%Release%' AS BIGINT) AS rel, CAST(is_manual=1 AND action_taken LIKE '%Block%' AS BIGINT) AS blk FROM report)""",
        """SELECT CASE grouping(vector, action) WHEN 1 THEN 'vector' WHEN 2 THEN 'action' ELSE 'total' END AS section, coalesce(vector, action, 'all') AS name, count(*) AS threats,
        CAST(sum(h) AS BIGINT) AS high, CAST(count(*) - sum(h) AS BIGINT) AS low, CAST(sum(rel) AS BIGINT) AS manual_release, CAST(sum(blk) AS BIGINT) AS manual_block
        FROM k GROUP BY GROUPING SETS ((vector), (action), ())"""),
    "offences_summary": query(HISTORY, """SELECT src_ip, count(*) AS sessions, max(offence_count) AS max_offences, max(ban_level) AS max_ban, max(phase_reached) AS max_phase,
        min(first_seen) AS first_seen, max(unblocked_at) AS last_seen, max_by(attack_vector, struct_pack(u := unblocked_at, i := id)) AS attack_vector FROM history
        WHERE unblocked_at >= TIMESTAMP '1996-01-01' AND unblocked_at <= TIMESTAMP '1998-12-31 23:59:59' GROUP BY src_ip"""),
    "chronological_log": query(REPORT, "SELECT timestamp, src_ip, attack_vector, priority, action_taken FROM report"),
    "history_report": query(HISTORY + ", d AS (SELECT *, CAST(epoch(unblocked_at - first_seen) AS BIGINT) AS s FROM history)", """SELECT id, src_ip, printf('%.4f', round(if_score, 6)) AS if_score, 'Phase ' || phase_reached AS phase,
        CASE WHEN offence_count = 0 THEN 1 ELSE offence_count END AS offences, CASE WHEN s >= 60 THEN s//60 || 'm ' || s%60 || 's' ELSE s || 's' END AS duration, unblocked_at, unblock_reason
        FROM d WHERE unblocked_at >= TIMESTAMP '1996-01-01' AND unblocked_at <= TIMESTAMP '1998-12-31 23:59:59'"""),
    "history_dates": query(HISTORY, "SELECT DISTINCT strftime(unblocked_at, '%Y-%m-%d') AS d FROM history"),
    "ip_dossier": query(MITIGATION + ", " + FLOWS_BASE + ", " + HISTORY + """, ev AS (SELECT *, timestamp >= TIMESTAMP '2024-01-29' AS hot FROM mitigation
          QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY hot DESC, timestamp DESC, id DESC) = 1), ft AS (
        SELECT '10.0' || substr(src_ip, 5) AS src_ip, packet_count, byte_count FROM flows QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) = 1), hs AS (
        SELECT '10.0' || substr(src_ip, 5) AS src_ip, max_by(ban_level, struct_pack(u := unblocked_at, i := id)) AS ban_level, max_by(phase_reached, struct_pack(u := unblocked_at, i := id)) AS phase_reached,
          count(*) AS offences, least(round(sum(2.0*power(0.5, epoch(TIMESTAMP '2002-01-01' - unblocked_at)/86400.0)), 4), 10.0) AS reputation FROM history GROUP BY 1)""",
        """SELECT src_ip, timestamp, action_taken, attack_vector, CAST(CASE phase WHEN 'Quarantined' THEN 1 WHEN 'Time Ban' THEN 2 WHEN 'Blackhole' THEN 3 ELSE coalesce(phase_reached, 0) END AS BIGINT) AS phase_no,
        priority, coalesce(packet_count, 0) AS packet_count, coalesce(byte_count, 0) AS byte_count, coalesce(ban_level, 0) AS ban_level, coalesce(offences, 0) AS offences,
        coalesce(reputation, 0.0) AS reputation, round(confidence*100, 1) AS confidence_pct FROM ev LEFT JOIN ft USING (src_ip) LEFT JOIN hs USING (src_ip)"""),
    "host_status": query(STATES + """, hosts AS (SELECT src_ip, ['attacker','legit','server'][CAST(min(id) % 3 + 1 AS BIGINT)] AS role FROM mitigation GROUP BY ALL),
        att AS (SELECT DISTINCT src_ip, true AS a FROM mitigation WHERE action_taken='Blackhole' AND timestamp >= TIMESTAMP '2024-01-30 12:00:00'), mit AS (SELECT src_ip, action_taken AS m FROM states WHERE NOT deleted)""",
        """SELECT src_ip, role, CASE WHEN role='attacker' THEN CASE WHEN a AND m IS NOT NULL THEN 'ATTACKING -> [' || m || ']' WHEN a THEN 'ATTACKING' WHEN m IS NOT NULL THEN 'MITIGATED [' || m || ']' ELSE 'standby' END
        WHEN role='legit' THEN CASE WHEN m IS NOT NULL THEN 'FP? MITIGATED [' || m || ']' ELSE 'standby' END ELSE role END AS status
        FROM hosts LEFT JOIN att USING (src_ip) LEFT JOIN mit USING (src_ip)"""),
    "resolve_policy": query(policy(True), "SELECT event_id, src_ip, rule, outcome FROM done"),
    "resolve_policy_per_switch": query(per_switch(), "SELECT event_id, src_ip, rule, outcome FROM done"),
    "summary_totals": query(SUMMARY + """, s AS (SELECT CAST(coalesce(sum(total), 0) AS BIGINT) AS total_flows, CAST(coalesce(sum(true_neg), 0) AS BIGINT) AS true_negatives,
        CAST(coalesce(sum(fp), 0) AS BIGINT) AS false_positives, sum(if_fp) AS f, sum(if_tn) AS t FROM summary
        WHERE timestamp >= TIMESTAMP '1996-02-01' AND timestamp <= TIMESTAMP '1999-12-31 23:59:59')""",
        "SELECT total_flows, true_negatives, false_positives, round(f / greatest(f + t, 1) * 100, 2) AS fp_rate FROM s"),
    "policy_counts": query(policy(False), "SELECT rule, outcome, count(*) AS packets FROM done GROUP BY ALL"),
    "command_targets": query(COMMANDS + """, sw AS (SELECT DISTINCT dpid FROM packets), seen AS (SELECT c.id, c.action, p.dpid FROM commands c ASOF LEFT JOIN packets p ON c.src_ip = p.src_ip AND c.ts >= p.ts)""",
        """SELECT id, action, dpid AS target_dpid FROM seen WHERE action = 'clear' AND dpid IS NOT NULL
        UNION ALL SELECT s.id, s.action, sw.dpid FROM seen s, sw WHERE NOT (s.action = 'clear' AND s.dpid IS NOT NULL)"""),
    "resource_tier": query(TIERS, "SELECT id, tier FROM tiers"),
}
SQL |= {
    "evaluate": query(SUMMARY, f"SELECT {CELLS} FROM summary"),
    "incident_report": query(REPORT, "SELECT timestamp, src_ip, action_taken, attack_vector FROM report"),
}
GUARD = TIERS + """, gx AS MATERIALIZED (SELECT user_id % 9 + 1 AS controller, t.id, t.tier, CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 17 END AS num,
    row_number() OVER (PARTITION BY user_id % 9 ORDER BY ts, t.id) AS rn FROM tiers t JOIN events e ON e.event_id = t.id), walk AS (
  SELECT DISTINCT controller, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, '' AS tier, CAST(0 AS BIGINT) AS streak, CAST(0 AS DOUBLE) AS delay, CAST(NULL AS INTEGER) AS wanted,
    CAST(NULL AS INTEGER) AS installed, '-' AS command FROM gx
  UNION ALL SELECT controller, rn, id, tier, streak, CASE WHEN tier='CRIT' THEN 0.05 WHEN tier='HIGH' AND was IS NULL THEN CASE WHEN streak >= 2 THEN 0.02 ELSE d0 END
      WHEN tier='HIGH' THEN 0.02 ELSE 0 END, wanted, CASE WHEN tier='CRIT' THEN wanted END,
    CASE WHEN tier='CRIT' AND wanted IS DISTINCT FROM was THEN CASE WHEN was IS NOT NULL THEN 'remove ' || was || '; ' ELSE '' END || 'install ' || wanted
         WHEN tier<>'CRIT' AND was IS NOT NULL THEN 'remove ' || was ELSE '-' END
  FROM (SELECT x.controller, x.rn, x.id, x.tier, w.installed AS was, w.delay AS d0, coalesce(x.num, w.wanted) AS wanted,
      CASE WHEN x.tier='CRIT' OR (x.tier='HIGH' AND w.installed IS NULL) THEN w.streak + 1 ELSE 0 END AS streak
    FROM walk w JOIN gx x ON x.controller = w.controller AND x.rn = w.rn + 1))"""
SQL |= {
    "guard_transitions": query(GUARD, """SELECT controller, id, tier, streak AS consecutive, delay AS throttle_s, installed IS NOT NULL AS rules_active, command FROM walk WHERE rn > 0""", True),
    "choose_threshold": query(RESULTS, "SELECT round(quantile_disc(if_score, 0.95), 6) AS threshold FROM results WHERE is_anomaly = 0"),
}

SQL |= {
    "evaluate_traffic_summary": SQL["traffic_summary"], "evaluate_class_metrics": SQL["class_metrics"], "evaluate_accuracy": SQL["model_accuracy"],
    "evaluate_if_metrics": SQL["if_metrics"].replace("WHERE timestamp >= TIMESTAMP '1996-02-01' AND timestamp <= TIMESTAMP '1999-12-31 23:59:59'", ""),
    "report_ranges": query(PACKETS + """, asked AS (SELECT event_id, strftime(ts, '%Y-%m-%d') || CASE WHEN event_id % 11 = 0 THEN 'x' ELSE '' END AS start,
        strftime(ts + to_days(CAST(event_id % 7 - 2 AS INTEGER)), '%Y-%m-%d') AS "end" FROM packets)""",
        """SELECT event_id, start, "end", CASE WHEN length(start) <> 10 THEN 'Invalid date format. Use YYYY-MM-DD.' WHEN "end" < start THEN 'End date must be >= start date.'
        WHEN "end" > '2024-01-25' THEN 'End date cannot be in the future.' ELSE 'ok' END AS answer FROM asked"""),
    "parse_telemetry_types": query(PACKETS + ", " + FLOWS_BASE, """SELECT 'packet_in' AS type, ts, src_ip, CAST(0 AS BIGINT) AS n FROM packets
        UNION ALL SELECT 'flow_stats', ts, src_ip, packet_count FROM flows UNION ALL SELECT 'dropped_delta', ts, src_ip, packet_count - 25 FROM flows WHERE packet_count > 25
        UNION ALL SELECT 'switch_count', ts, '-', count(DISTINCT dpid) FROM flows GROUP BY ts"""),
}
