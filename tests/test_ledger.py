import datetime as dt
import random
import json

import pytest
from pyspark.sql import functions as F

from floodwatch import config as C
from floodwatch.operators import behavior as B
from floodwatch.operators import fusion as FU
from floodwatch.operators import guard as G
from floodwatch.operators import ledger as L
from floodwatch.operators import metrics as M
from floodwatch.operators import reports as R
from floodwatch.sources import sinks, telemetry

T0 = dt.datetime(2024, 1, 1)


def at(*seconds):
    return [T0 + dt.timedelta(seconds=s) for s in seconds]


def events(spark, times, **more):
    rows = [(i, t, more.get("src", "a"), 0.7, "Quarantined", "Phase 1") for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "id long, timestamp timestamp, src_ip string, if_score double, action_taken string, phase string")


def test_ttl_dedupe_edges(spark):
    kept = L.ttl_dedupe(events(spark, at(0, 9.9, 10.0, 10.1, 20.1, 20.2)), slice_s=10.0)
    assert sorted(r["id"] for r in kept.collect()) == [0, 3, 5]     # exactly ten seconds is still a repeat


def test_feed_dedupe_force(spark):
    df = events(spark, at(0, 2, 4, 6, 9, 11)).withColumn("urgent", F.col("id") == 2)
    kept = L.feed_dedupe(df, force=F.col("urgent"), slice_s=5.0)
    assert sorted(r["id"] for r in kept.collect()) == [0, 2, 4]     # the forced row restarts the five seconds


def test_ttl_dedupe_stream_in_any_order(spark, tmp_path):
    """Files arrive out of order; rows far ahead let the watermark pass all others; one far behind (31.5) is dropped by Spark, which counts it, while one
    that comes before anything later was applied (30.5) still takes its place."""
    from floodwatch.streaming.jobs import ttl_dedupe_stream
    df = events(spark, at(0, 5, 9.9, 10.1, 12, 20.2, 50, 55, 3600, 30.5, 31.5, 7200))
    for i, cond in enumerate(["id IN (4, 6, 1)", "id IN (7, 0, 5)", "id IN (2, 3)", "id = 8", "id = 9", "id = 11", "id = 10"]):
        df.filter(cond).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")))
    q = (ttl_dedupe_stream(stream, delay="1 minute").writeStream.format("memory").queryName("dedupe").option("checkpointLocation", str(tmp_path / "cp"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    want = sorted(r["id"] for r in L.ttl_dedupe(df.filter("id <= 9")).collect())
    assert sorted(r["id"] for r in spark.table("dedupe").collect()) == want and len(want) > 3
    assert sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"]) == 1


def test_traffic_summary_stream(spark, tmp_path):
    from floodwatch.streaming.jobs import traffic_summary_stream, write_batches
    rows = [(T0 + dt.timedelta(seconds=s), s % 3, int(s % 2 == 0)) for s in range(40)] + [(T0 + dt.timedelta(seconds=500), 1, 0)]
    df = spark.createDataFrame(rows, "ts timestamp, total long, tp long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = tmp_path / "out"
    q = write_batches(traffic_summary_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "summary",
                      lambda b, i: sinks.append_table(b, str(out), i), once=True)
    q.awaitTermination()
    mine = sinks.read_table(spark, str(out)).select("timestamp", "total", "tp").orderBy("timestamp").collect()
    want = M.traffic_summary(df).filter(F.col("timestamp") < F.lit(T0 + dt.timedelta(seconds=400))).select("timestamp", "total", "tp").orderBy("timestamp").collect()
    assert mine == want and len(mine) == 8


def test_reputation_values(spark):
    h = spark.createDataFrame([("a", T0), ("b", T0 - dt.timedelta(hours=24)), ("c", T0 - dt.timedelta(hours=48))]
                              + [("five", T0 - dt.timedelta(minutes=i)) for i in range(5)] + [("six", T0 - dt.timedelta(minutes=i)) for i in range(6)],
                              "src_ip string, unblocked_at timestamp")
    out = {r["src_ip"]: r["reputation"] for r in B.reputation(h, F.lit(T0)).collect()}
    assert out["a"] == 2.0 and out["b"] == 1.0 and out["c"] == 0.5 and out["six"] == 10.0 and 9.9 < out["five"] < 10.0


def test_reputation_over_many_half_lives(spark):
    """Three years of daily offences of one source stay finite and exact."""
    h = spark.createDataFrame([("a", T0 + dt.timedelta(days=i)) for i in range(1200)], "src_ip string, unblocked_at timestamp")
    out = B.running_reputation(h).orderBy("unblocked_at").collect()
    for i in (0, 1, 5, 700, 1199):
        assert out[i]["reputation"] == pytest.approx(min(10.0, sum(2.0 * 0.5 ** k for k in range(min(i + 1, 60)))), abs=1e-4)


@pytest.mark.parametrize("slice_s", [3600.0, 86_400.0, 40 * 86_400.0])
def test_reputation_of_a_hot_source(spark, slice_s):
    """A third of all offences are one source's, over years with gaps and equal times; slices of any length give the direct sum."""
    rng = random.Random(4)
    times = {"hot": sorted(rng.choice([0, 1, 600, 601, 1400]) * 86_400 + rng.randrange(0, 3 * 86_400, 1800) for _ in range(300)),
             **{f"s{k}": sorted(rng.randrange(0, 900 * 86_400, 1800) for _ in range(6)) for k in range(100)}}
    h = spark.createDataFrame([(k, T0 + dt.timedelta(seconds=t)) for k, ts in times.items() for t in ts], "src_ip string, unblocked_at timestamp")
    asked = spark.createDataFrame([(k, T0 + dt.timedelta(seconds=rng.randrange(0, 1500 * 86_400, 900))) for k in times for _ in range(3)], "src_ip string, ts timestamp")

    def direct(src, at):
        return min(10.0, round(sum(2.0 * 0.5 ** ((at - t) / 86_400) for t in times[src] if t <= at), 4))
    for out, at in ((B.running_reputation(h, slice_s=slice_s), "unblocked_at"), (B.attach_reputation(asked, h, slice_s=slice_s), "ts")):
        rows = out.collect()
        assert len(rows) in (len(asked.collect()), 900)
        assert all(abs(r["reputation"] - direct(r["src_ip"], (r[at] - T0).total_seconds())) < 1.5e-4 for r in rows)


@pytest.mark.parametrize("score,conf,klass,pps,rep,want", [
    (0.45, 1.0, "Uncertain", 10.0, 0.0, "Medium"), (0.4499, 1.0, "Uncertain", 10.0, 0.0, "Low"),
    (0.65, 1.0, "Uncertain", 10.0, 0.0, "High"), (0.85, 1.0, "Uncertain", 0.0, 0.0, "Critical"),
    (0.4499, 1.0, "Uncertain", 11.0, 0.0, "Medium"), (0.5, 1.0, "Uncertain", 1e9, 0.0, "High"),
    (0.45, 1.0, "Uncertain", 0.0, 1000.0, "High"), (0.9, 1.0, "SYN Flood", 1e9, 1000.0, "Critical")])
def test_priority_grid(spark, score, conf, klass, pps, rep, want):
    df = spark.createDataFrame([(score, conf, klass, pps, rep)], "if_score double, confidence double, attack_class string, pps double, reputation double")
    assert B.with_priority(df).first()["priority"] == want


def test_confusion_cases(spark):
    rows = [("s", 1, "SYN Flood", "SYN"), ("s", 1, "UDP Flood", "SYN"), ("s", 1, "Uncertain", "SYN"), ("m", 1, "SYN Flood", "MIXED"),
            ("n", 1, "SYN Flood", None), ("n", 0, "Normal", None), ("s", 0, "Normal", "SYN")]
    df = spark.createDataFrame([(*r, 5, 1.0) for r in rows], "src_ip string, is_anomaly long, attack_class string, attack_type string, packet_count long, pps double")
    df = df.withColumn("is_attacker", F.col("attack_type").isNotNull()).withColumn("expected_class", F.when(F.col("attack_type") != "MIXED", F.col("attack_type")))
    s = FU.score_decisions(df).agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "fn", "fp", "rf_tp", "rf_fp", "rf_fn", "rf_syn_as_udp", "rf_fn_syn", "rf_tn_udp")]).first()
    assert s.asDict() == {"tp": 4, "tn": 1, "fn": 1, "fp": 1, "rf_tp": 1, "rf_fp": 1, "rf_fn": 2, "rf_syn_as_udp": 1, "rf_fn_syn": 1, "rf_tn_udp": 1}


def test_graph_buckets(spark):
    rows = [(T0 + dt.timedelta(seconds=s), 60, 0, 0) for s in (0, 59, 60, 3600)]
    df = spark.createDataFrame(rows, "timestamp timestamp, total long, threats long, true_neg long").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    out = {r["bucket"]: r["incoming"] for r in M.graph_history(df, "2024-01-01 00:00:00", "2024-01-01 01:00:00").collect()}
    assert len(out) == 60 and out[0] == 2.0 and out[1] == 1.0 and out[59] == 1.0 and out[30] == 0.0


def test_report_range():
    today = dt.date(2024, 5, 1)
    assert R.validate_report_range("2024-01-01", "2024-05-01", today)
    for bad in (("2024-02-30", "2024-03-01"), ("2024-03-02", "2024-03-01"), ("2024-03-02", "2024-05-02"), (None, "x")):
        with pytest.raises(ValueError):
            R.validate_report_range(*bad, today)


def test_guard(spark):
    tiers = ["HIGH", "HIGH", "CRIT", "CRIT", "HIGH", "WARN", "CRIT"]
    classes = [None, "UDP Flood", None, "SYN Flood", None, None, None]
    df = spark.createDataFrame([("c", T0 + dt.timedelta(seconds=i), i, t, k) for i, (t, k) in enumerate(zip(tiers, classes))],
                               "controller string, ts timestamp, id long, tier string, attack_class string")
    out = G.guard_transitions(df).orderBy("id").collect()
    assert [r["throttle_s"] for r in out] == [0.0, 0.02, 0.05, 0.05, 0.02, 0.0, 0.05]
    assert [r["command"] for r in out] == [None, None, "install 17", "remove 17; install 6", "remove 6", None, "install 6"]


def test_telemetry_messages(spark, tmp_path):
    flow = {"type": "flow_stats", "dpid": 3, "src_ip": "10.0.0.6", "flow_stats": {"packet_count": 7, "byte_count": 700}, "switch_stats": {"gfe": 2}}
    lines = [json.dumps(m) for m in (
        {"type": "packet_in", "dpid": 1, "src_ip": "10.0.0.6", "dst_ip": "10.0.0.20", "proto": "TCP", "tcp_flags_syn": True, "tcp_flags_ack": False, "ts": 1700000000.25},
        flow, {"type": "dropped_delta", "src_ip": "10.0.0.6", "delta": 4}, {"type": "dropped_delta", "src_ip": "10.0.0.6", "delta": 0},
        {"type": "switch_count", "connected": 9}, {"type": "other"}, {"type": "packet_in", "src_ip": ""})] + ["{broken"]
    (tmp_path / "t.txt").write_text("\n".join(lines))
    parts = telemetry.split_telemetry(telemetry.read_telemetry(spark, str(tmp_path / "t.txt")))
    assert {k: v.count() for k, v in parts.items()} == {"packet_in": 1, "flow_stats": 1, "dropped_delta": 1, "switch_count": 1}
    assert parts["packet_in"].first()["ts"] == dt.datetime.fromtimestamp(1700000000.25)
    flat = telemetry.flatten_flow_stats(parts["flow_stats"]).first()
    assert flat["packet_count"] == 7 and flat["idle_timeout"] == 0 and flat["switch_gfe"] == 2 and flat["switch_gsp"] == 0


def test_sinks(spark, tmp_path):
    df = events(spark, at(0, 90000)).withColumn("deleted", F.lit(False))
    for _ in range(2):   # running a batch again changes nothing
        sinks.archive_table(df, str(tmp_path / "hot"), str(tmp_path / "old"), F.lit(T0 + dt.timedelta(days=1)), 1)
    assert sinks.read_table(spark, str(tmp_path / "hot")).count() == 1 and sinks.read_table(spark, str(tmp_path / "old")).count() == 1
    table = str(tmp_path / "state")
    assert sinks.upsert_table(df.limit(1), table, 0, order=["timestamp", "id"], deleted="deleted").count() == 1
    gone = events(spark, at(200000)).withColumn("deleted", F.lit(True))
    assert sinks.upsert_table(gone, table, 1, order=["timestamp", "id"], deleted="deleted").count() == 0


def test_contract(tmp_path):
    assert telemetry.load_contract()["threshold"] == C.IF_THRESHOLD
    (tmp_path / "c.json").write_text(json.dumps({"threshold": 0.5}))
    assert telemetry.load_contract(str(tmp_path / "c.json")) == {"threshold": 0.5}
