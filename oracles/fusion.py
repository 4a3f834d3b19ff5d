"""Oracles of the entropy, fusion and behaviour queries."""

from oracles.base import CLASSIFIED, FLOWS_BASE, GT, HISTORY, PACKETS, RESULTS, THR, TRIPS, query
from oracles.flows import ID

METRICS = ("size_var", "intensity_var", "proto_entropy", "uniform_share")


def snapshot(scope: str) -> str:
    """Snapshot CTEs keyed by ``scope``."""
    return FLOWS_BASE + f""", shaped AS (
  SELECT {scope} AS scope, ts AS tick_ts, src_ip, ip_proto, ln(1 + greatest(byte_count/(packet_count+1e-9), 0)) AS sx,
    ln(1 + greatest(packet_count_per_second*byte_count_per_second, 0)) AS ix FROM flows), med AS (
  SELECT scope, tick_ts, median(sx) AS ms, median(ix) AS mi FROM shaped GROUP BY ALL), dev AS (
  SELECT scope, tick_ts, abs(sx-ms) AS ds, abs(ix-mi) AS di FROM shaped JOIN med USING (scope, tick_ts)), mad AS (
  SELECT scope, tick_ts, median(ds) AS ds_med, median(di) AS di_med FROM dev GROUP BY ALL), share AS (
  SELECT scope, tick_ts, avg(CASE WHEN ds <= greatest(0.02, 3*ds_med) AND di <= greatest(0.10, 3*di_med) THEN 1.0::DOUBLE ELSE 0.0 END) AS uniform_share
  FROM dev JOIN mad USING (scope, tick_ts) GROUP BY ALL), pn AS (
  SELECT scope, tick_ts, ip_proto, count(*) AS n, sum(count(*)) OVER (PARTITION BY scope, tick_ts) AS t FROM shaped GROUP BY scope, tick_ts, ip_proto), ent AS (
  SELECT scope, tick_ts, sum(-(n/t)*log2(n/t)) AS proto_entropy FROM pn GROUP BY ALL), snap AS (
  SELECT scope, tick_ts, var_pop(sx) AS size_var, var_pop(ix) AS intensity_var, any_value(proto_entropy) AS proto_entropy,
    any_value(uniform_share) AS uniform_share, count(DISTINCT src_ip) AS unique_ips
  FROM shaped JOIN ent USING (scope, tick_ts) JOIN share USING (scope, tick_ts) GROUP BY ALL)"""


def learn(m: str, allowed: str, held: str = "false") -> dict[str, str]:
    """Next (samples, mean, var) of one baseline given value x.{m}; state w.{m}_s/_m/_v; ``held`` stops what is learned from moving."""
    s, mean, var, x = f"w.{m}_s", f"w.{m}_m", f"w.{m}_v", f"x.{m}"
    ns = f"list_append({s}, {x})"
    # population variance of five values about their own mean
    five = lambda a, b: f"list_var_pop({ns}[{a}:{b}])"
    n = f"len({ns})"
    ready = f"({n} >= 15 OR ({n} >= 10 AND abs({five(f'{n}-4', n)} - {five(f'{n}-9', f'{n}-5')}) < 0.01))"
    std = f"sqrt(greatest({var}, 1e-9))"
    cv = f"({std} / (abs({mean}) + 1e-9))"
    alpha = f"(CASE WHEN {mean} = 0 THEN 0.02 ELSE least(0.10, greatest(0.02, 0.10 - {cv}*0.08)) END)"
    nm = f"({alpha}*{x} + (1-{alpha})*{mean})"
    take = f"{allowed} AND NOT ({held}) AND abs({x}-{mean})/{std} < 3.0"
    return {
        f"{m}_s": f"CASE WHEN {mean} IS NOT NULL OR NOT ({allowed}) THEN {s} WHEN {ready} THEN CAST([] AS DOUBLE[]) ELSE {ns} END",
        f"{m}_m": f"CASE WHEN {mean} IS NULL THEN CASE WHEN {allowed} AND {ready} THEN list_avg({ns}) END WHEN {take} THEN {nm} ELSE {mean} END",
        f"{m}_v": f"CASE WHEN {mean} IS NULL THEN CASE WHEN {allowed} AND {ready} THEN list_var_pop({ns}) ELSE 0.0 END "
                  f"WHEN {take} THEN {alpha}*power({x}-{nm}, 2) + (1-{alpha})*{var} ELSE {var} END",
    }


def _baselines() -> str:
    steps = {}
    for m in METRICS:
        steps |= learn(m, "true")
    start = ", ".join(f"CAST([] AS DOUBLE[]) AS {m}_s, CAST(NULL AS DOUBLE) AS {m}_m, CAST(0 AS DOUBLE) AS {m}_v" for m in METRICS)
    return snapshot("'all'") + f""", x AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY tick_ts) AS rn FROM snap), walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS TIMESTAMP) AS tick_ts, {start}
  UNION ALL SELECT x.rn, x.tick_ts, {', '.join(f'{e} AS {k}' for k, e in steps.items())} FROM walk w JOIN x ON x.rn = w.rn + 1)"""


BASELINE = _baselines()

STD = lambda m: f"sqrt(greatest(w.{m}_v, 1e-9))"
Z = {m: f"(CASE WHEN ready THEN (x.{m} - w.{m}_m)/{STD(m)} ELSE 0.0 END)" for m in METRICS}
SIGMA = f"(CASE WHEN w.size_var_m = 0 THEN 2.5 ELSE least(2.8, greatest(2.0, 2.5 + 1.5*{STD('size_var')}/(abs(w.size_var_m)+1e-9))) END)"


def verdict_walk(snapshots: str, locks: str = "") -> str:
    """The verdict fold behind the CTEs of ``snapshots``; ``locks`` is a CTE lk (tick_ts, locked) that goes before it."""
    steps = {}
    for m in METRICS:
        steps |= learn(m, "NOT w.attack", "w.locked" if locks else "false")
    state0 = ", ".join(f"CAST([] AS DOUBLE[]) AS {m}_s, CAST(NULL AS DOUBLE) AS {m}_m, CAST(0 AS DOUBLE) AS {m}_v" for m in METRICS)
    zero = ", ".join(f"CAST(0 AS DOUBLE) AS z_{m}" for m in METRICS)
    carry = ", ".join(f"w.{k}" for k in steps)
    # stage "judge" scores the tick against the state, stage "learn" advances the state
    judged = f"""SELECT x.*, {carry}, w.p_size, w.ready0 AND w.{METRICS[0]}_m IS NOT NULL AND w.{METRICS[1]}_m IS NOT NULL
        AND w.{METRICS[2]}_m IS NOT NULL AND w.{METRICS[3]}_m IS NOT NULL AS ready FROM walk w JOIN x ON x.rn = w.rn + 1"""
    j = "SELECT w.*, " + ", ".join(f"CASE WHEN ready THEN (w.{m} - w.{m}_m)/{STD(m)} ELSE 0.0 END AS z_{m}" for m in METRICS) \
        + f", {SIGMA} AS sg FROM ({judged}) w"
    flags = f"""SELECT w.*, ready AND abs(z_size_var) >= sg AS f_size, ready AND abs(z_intensity_var) >= sg AS f_int,
        ready AND (z_proto_entropy <= -sg OR z_proto_entropy >= 1.5) AS f_proto, ready AND z_uniform_share >= 1.5 AS f_share FROM ({j}) w"""
    attack = f"SELECT w.*, (f_size OR f_int OR f_proto OR f_share) AS attack FROM ({flags}) w"
    learned = ", ".join(f"{e.replace('x.', 'w.')} AS {k}" for k, e in steps.items())
    out = f"""SELECT w.rn, w.tick_ts, true AS ready0, w.size_var AS p_size, {learned}, w.ready, w.attack, w.f_share AS cluster,
        ready AND w.z_size_var >= w.sg AS size_surge, ready AND w.z_intensity_var >= w.sg AS intensity_surge,
        CASE WHEN NOT w.attack THEN 'low' WHEN (f_size AND f_int) OR (f_share AND (f_size OR f_int OR f_proto)) THEN 'high' ELSE 'moderate' END AS confidence,
        {', '.join(f'w.z_{m}' for m in METRICS)}, CASE WHEN ready THEN w.size_var - w.p_size ELSE 0.0 END AS size_delta FROM ({attack}) w"""
    return snapshots + locks + f""", x AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY tick_ts) AS rn FROM snap{' JOIN lk USING (tick_ts)' if locks else ''}), walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS TIMESTAMP) AS tick_ts, false AS ready0, CAST(0 AS DOUBLE) AS p_size, {state0}, false AS ready, false AS attack,
    false AS cluster, false AS size_surge, false AS intensity_surge, 'low' AS confidence, {zero}, CAST(0 AS DOUBLE) AS size_delta
  UNION ALL {out})"""


VERDICT = verdict_walk(snapshot("'all'"))
PROFILE = FLOWS_BASE + """, windowed AS (SELECT *, list(packet_count_per_second) OVER (PARTITION BY src_ip ORDER BY ts, l_orderkey, l_linenumber, l_partkey
    ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS a FROM flows), st AS (
  SELECT *, len(a) AS n, list_avg(a) AS m, list_sum(a) AS s, list_sum(list_transform(a, lambda v: v*log2(v))) AS vl, list_var_pop(a) AS vp FROM windowed), st2 AS (
  SELECT *, CASE WHEN n < 4 THEN 0.0 ELSE list_avg(a[n//2+1:n]) - list_avg(a[1:n//2]) END AS trend,
    (log2(s) - vl/s) / CASE WHEN n > 1 THEN log2(n) ELSE 1 END AS norm, sqrt(greatest(vp, 1e-9))/(abs(m)+1e-9) AS cv FROM st)"""
LABELLED = RESULTS + ", " + GT + """, labelled AS (SELECT r.*, g.attack_type, g.attack_type IS NOT NULL AS is_attacker, nullif(g.attack_type, 'MIXED') AS wanted,
    CASE attack_class WHEN 'SYN Flood' THEN 'SYN' WHEN 'ICMP Flood' THEN 'ICMP' WHEN 'UDP Flood' THEN 'UDP' END AS got, is_anomaly = 1 AS an
  FROM results r LEFT JOIN gt g ON r.src_ip = g.src_ip AND r.ts >= g.start_ts AND (g.end_ts IS NULL OR r.ts < g.end_ts))"""


def counters() -> dict[str, str]:
    b = lambda c: f"CAST(coalesce({c}, false) AS BIGINT)"
    pk = "greatest(packet_count, 1)"
    out = {
        "total": pk, "threats": f"CASE WHEN an THEN {pk} ELSE 0 END", "true_neg": f"CASE WHEN an THEN 0 ELSE {pk} END",
        "fp": b("an AND NOT is_attacker"), "tp": b("an AND is_attacker"), "tn": b("NOT an AND NOT is_attacker"), "fn": b("NOT an AND is_attacker"),
        "if_tp": b("an AND is_attacker"), "if_fp": b("an AND NOT is_attacker"), "if_tn": b("NOT an AND NOT is_attacker"), "if_fn": b("NOT an AND is_attacker"),
        "rf_tp": b("an AND got = wanted"), "rf_fp": b("an AND got <> wanted"),
        "rf_tn": "CAST(0 AS BIGINT)", "rf_fn": b("an AND wanted IS NOT NULL AND (got IS NULL OR got <> wanted)"),
    }
    for t in ("SYN", "ICMP", "UDP"):
        s = t.lower()
        out |= {f"rf_tp_{s}": b(f"an AND got = wanted AND got = '{t}'"), f"rf_fp_{s}": "CAST(0 AS BIGINT)",
                f"rf_tn_{s}": b(f"an AND got = wanted AND got <> '{t}'"), f"rf_fn_{s}": b(f"an AND got IS NULL AND wanted = '{t}'")}
    for a in ("SYN", "ICMP", "UDP"):
        for c in ("SYN", "ICMP", "UDP"):
            if a != c:
                out[f"rf_{a.lower()}_as_{c.lower()}"] = b(f"an AND wanted = '{a}' AND got = '{c}'")
    return out


COUNTER_SQL = ", ".join(f"{e} AS {n}" for n, e in counters().items())
DECISIONS = LABELLED + f", decisions AS (SELECT *, {COUNTER_SQL} FROM labelled)"
COMPOSITE = ("least(1.0, if_score*confidence + (CASE attack_class WHEN 'SYN Flood' THEN 1.0 WHEN 'ICMP Flood' THEN 0.8 WHEN 'UDP Flood' THEN 0.9 ELSE 0.5 END - 0.5)*0.5"
             " + CASE WHEN {pps} > 10 THEN least(0.15, log10({pps}/10)*0.05) ELSE 0.0 END + least(0.2, {rep}*0.02))")
TIER = "CASE WHEN {c} >= 0.85 THEN 'Critical' WHEN {c} >= 0.65 THEN 'High' WHEN {c} >= 0.45 THEN 'Medium' ELSE 'Low' END"
SNAP_COLS = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)
DAYS90 = "(90*86400.0)"

SQL = {
    "tea_snapshot": query(snapshot("'all'"), f"SELECT tick_ts, {SNAP_COLS}, unique_ips FROM snap"),
    "tea_snapshot_per_switch": query(snapshot("CAST(dpid AS VARCHAR)"), f"SELECT scope, tick_ts, {SNAP_COLS}, unique_ips FROM snap"),
    "shannon_entropy": query(FLOWS_BASE, """SELECT src_ip, round(sum(-(w/t)*log2(w/t)), 6) AS entropy FROM (
        SELECT src_ip, ip_proto, sum(packet_count) AS w, sum(sum(packet_count)) OVER (PARTITION BY src_ip) AS t FROM flows GROUP BY src_ip, ip_proto) GROUP BY src_ip"""),
    "uniform_share": query(snapshot("'all'"), "SELECT tick_ts, round(uniform_share, 6) AS uniform_share FROM snap"),
    "adaptive_baseline": query(BASELINE, " UNION ALL ".join(f"""SELECT tick_ts, '{m}' AS metric, {m}_m IS NOT NULL AS learned, round(coalesce({m}_m, 0), 6) AS baseline_mean,
        round({m}_v, 6) AS baseline_var FROM walk WHERE rn > 0""" for m in METRICS), recursive=True),
    "tea_verdict": query(VERDICT, """SELECT tick_ts, ready AS is_learned, attack AS is_attack_pattern, cluster AS mechanized_cluster, size_surge, intensity_surge, confidence,
        round(z_size_var, 6) AS size_zscore, round(z_intensity_var, 6) AS intensity_zscore, round(z_proto_entropy, 6) AS proto_zscore,
        round(z_uniform_share, 6) AS uniform_share_zscore, round(CASE WHEN ready THEN size_var_m ELSE 0.0 END, 6) AS baseline_mean_size, round(size_delta, 6) AS size_delta
        FROM walk WHERE rn > 0""", recursive=True),
    "attach_tea": query(VERDICT + """, v AS (SELECT tick_ts, ready, attack, confidence FROM walk WHERE rn > 0)""",
        f"""SELECT {ID}, coalesce(attack, false) AS tea_attack_pattern, coalesce(confidence, 'low') AS tea_confidence, coalesce(ready, false) AS tea_is_learned
        FROM flows f ASOF LEFT JOIN v ON f.ts >= v.tick_ts""", recursive=True),
    "attach_tea_by_source": query(VERDICT + ", " + PROFILE.removeprefix(FLOWS_BASE + ", ") + """, v AS (SELECT tick_ts, ready, attack, confidence FROM walk WHERE rn > 0 AND ready),
        own AS (SELECT *, l_orderkey % 5 IN (2, 3) AS banned, n >= 5 AND (trend > m*greatest(0.05, least(0.2, 0.1*(1+cv))) OR norm < greatest(0.25, least(0.55, 0.4 - cv*0.15))) AS hostile FROM st2)""",
        f"""SELECT {ID}, NOT banned AND (hostile OR coalesce(attack, false)) AS tea_attack_pattern, CASE WHEN banned THEN 'low' WHEN hostile THEN 'moderate' ELSE coalesce(v.confidence, 'low') END AS tea_confidence,
        NOT banned AND coalesce(ready, false) AS tea_is_learned FROM own f ASOF LEFT JOIN v ON f.ts >= v.tick_ts""", recursive=True),
    "mitigation_advisory": query(VERDICT, """SELECT src_ip, count(CASE WHEN ip_proto <> 6 AND ready AND NOT attack THEN 1 END) AS would_block, count(*) AS scored
        FROM flows JOIN walk ON ts = tick_ts GROUP BY ALL""", recursive=True),
    "ip_profile_verdict": query(PROFILE, f"""SELECT {ID}, n AS samples, CASE WHEN n < 5 THEN 'uncertain'
        WHEN trend > m*greatest(0.05, least(0.2, 0.1*(1+cv))) OR norm < greatest(0.25, least(0.55, 0.4 - cv*0.15)) THEN 'attack'
        WHEN trend < -(m*greatest(0.05, least(0.2, 0.1*(1+cv)))) OR m < (list_avg(a[1:3]) + 1e-9)*0.5 THEN 'normal' ELSE 'uncertain' END AS ip_verdict FROM st2"""),
    "ip_trend": query(PROFILE, f"SELECT {ID}, round(trend, 6) AS ip_trend FROM st2"),
    "label_with_ground_truth": query(LABELLED, f"SELECT {ID}, coalesce(attack_type, '-') AS attack_type, is_attacker FROM labelled"),
    "attach_prefilter_flag": query(TRIPS + """, flags AS (SELECT src_ip, min(CASE WHEN reason IS NOT NULL THEN ts END) AS flag_from,
        max(ts) + INTERVAL 5 DAY AS flag_to FROM rows_ GROUP BY src_ip, ep HAVING count(reason) > 0)""",
        """SELECT event_id, src_ip, EXISTS (SELECT 1 FROM flags f WHERE f.src_ip = p.src_ip AND p.ts BETWEEN f.flag_from AND f.flag_to) AS flagged FROM packets p"""),
    "confidence_lock": query(RESULTS + """, w AS (SELECT *, max(CASE WHEN is_anomaly = 1 THEN struct_pack(c := confidence, t := ts, o := l_orderkey, l := l_linenumber, p := l_partkey, k := attack_class) END)
        OVER (PARTITION BY src_ip ORDER BY ts, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS lk FROM results)""",
        f"""SELECT {ID}, round(CASE WHEN is_anomaly = 1 THEN lk.c ELSE confidence END, 6) AS locked_confidence,
        CASE WHEN is_anomaly = 1 THEN lk.k ELSE attack_class END AS locked_class FROM w"""),
    "carry_prior_class": query(RESULTS + """, g AS (SELECT src_ip, ts, max(is_anomaly) AS is_anomaly, max(confidence) AS confidence,
        max(struct_pack(c := confidence, k := attack_class)).k AS attack_class FROM results GROUP BY ALL), k AS (
        SELECT *, last_value(CASE WHEN attack_class <> 'Uncertain' AND confidence >= 0.7 AND is_anomaly = 1 THEN struct_pack(c := confidence, k := attack_class) END IGNORE NULLS)
          OVER (PARTITION BY src_ip ORDER BY ts RANGE BETWEEN INTERVAL 9 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS s FROM g)""",
        """SELECT src_ip, ts, CASE WHEN attack_class='Uncertain' AND is_anomaly = 1 AND s IS NOT NULL THEN s.k ELSE attack_class END AS carried_class,
        round(CASE WHEN attack_class='Uncertain' AND is_anomaly = 1 AND s IS NOT NULL THEN s.c ELSE confidence END, 6) AS carried_confidence FROM k"""),
    "gate_confidence": query(RESULTS, f"SELECT {ID}, attack_class FROM results"),
    "score_decisions": query(DECISIONS, f"SELECT {ID}, {', '.join(counters())} FROM decisions"),
    "baseline_lock": query(RESULTS + """, n AS (SELECT *, row_number() OVER (PARTITION BY dpid ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS i FROM results),
        l AS (SELECT *, max(CASE WHEN is_anomaly = 1 THEN i END) OVER (PARTITION BY dpid ORDER BY i ROWS UNBOUNDED PRECEDING) AS la FROM n)""",
        f"SELECT {ID}, coalesce(i - la < 3, false) AS locked_after FROM l"),
    "reputation": query(HISTORY, f"""SELECT src_ip, least(round(sum(2.0*power(0.5, epoch(TIMESTAMP '1999-06-01' - unblocked_at)/{DAYS90})), 4), 10.0) AS reputation
        FROM history WHERE unblocked_at <= TIMESTAMP '1999-06-01' GROUP BY ALL"""),
    "attach_reputation": query(HISTORY, f"""SELECT d.id, d.src_ip, least(round(sum(2.0*power(0.5, epoch(d.unblocked_at + INTERVAL 7 DAY - h.unblocked_at)/{DAYS90})), 4), 10.0) AS reputation
        FROM history d JOIN history h ON d.src_ip = h.src_ip AND h.unblocked_at <= d.unblocked_at + INTERVAL 7 DAY GROUP BY ALL"""),
    "running_reputation": query(HISTORY, f"""SELECT d.id, d.src_ip, least(round(sum(2.0*power(0.5, epoch(d.unblocked_at - h.unblocked_at)/{DAYS90})), 4), 10.0) AS reputation
        FROM history d JOIN history h ON d.src_ip = h.src_ip AND h.unblocked_at <= d.unblocked_at GROUP BY ALL"""),
    "prior_ban": query(HISTORY, """SELECT src_ip, max_by(ban_level, id) AS last_ban_level, max_by(offence_count, id) AS last_offence_count,
        max(ban_level) AS max_ban_level FROM history GROUP BY ALL"""),
    "offence_totals": query(HISTORY, "SELECT src_ip, count(*) AS offences, max(ban_level) AS max_ban_level, true AS known_offender FROM history GROUP BY ALL"),
    "priority": query(RESULTS + ", c AS (SELECT *, " + COMPOSITE.format(pps="(pps*10)", rep="(l_partkey % 11)") + " AS comp FROM results)",
        f"SELECT {ID}, round(comp, 6) AS priority_score, {TIER.format(c='comp')} AS priority FROM c"),
    "entropy_fast_track": query(RESULTS + ", c AS (SELECT *, " + COMPOSITE.format(pps="pps", rep="0") + " AS comp FROM results), t AS (SELECT *, " + TIER.format(c="comp") + " AS priority FROM c)",
        f"SELECT {ID}, priority, CASE WHEN l_partkey % 6 = 0 AND priority IN ('Low','Medium') THEN 'High' ELSE priority END AS logged_priority FROM t"),
}
