"""What the scans and plans make Spark do: shuffles, written columns, parsing."""

import math
import re
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from floodwatch import catalog
from floodwatch.models.rf import cascade
from floodwatch.operators import flows as FL
from floodwatch.operators import fusion as FU
from floodwatch.operators import policy as PO
from floodwatch.operators import tea as TE
from floodwatch.operators.packets import resolve_addresses
from floodwatch.plans import detect as DE
from floodwatch.plans.slices import SLICE, asof_join, local_window, prefix, with_slice

T0 = pd.Timestamp("2024-01-01")
START = datetime(2024, 1, 1)


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, "hot" if i % 3 else None, T0 + pd.Timedelta(hours=i % 50), None if i % 7 == 0 else i % 5) for i in range(300)]
    return spark.createDataFrame(pd.DataFrame(data, columns=["id", "k", "ts", "v"]).astype({"v": "Int64"}))


def test_scan_shuffles_its_rows_once(rows):
    out = prefix(rows, ["k"], ["ts", "id"], ts="ts", width_s=7200.0, lag={"before": F.col("v")}, last={"latest": F.col("v")},
                 sums={"total": F.col("id")}, maxes={"top": F.col("v")})
    assert "Join" not in optimized(out)
    want = rows.toPandas().sort_values(["ts", "id"])
    got = out.toPandas().set_index("id")
    for _, part in want.groupby("k", dropna=False):
        before = latest = top = None
        total, first = 0, True
        for r in part.itertuples():
            v = None if pd.isna(r.v) else int(r.v)
            latest = v if v is not None else latest
            top = max(x for x in (top, v, -1) if x is not None)
            total += r.id
            seen = got.loc[r.id]
            assert seen.total == total
            for value, name in ((latest, "latest"), (None if first else before, "before"), (None if top == -1 else top, "top")):
                assert pd.isna(seen[name]) if value is None else seen[name] == value
            before, first = v, False


def test_unread_results_cost_no_scan(rows):
    assert "Window" not in optimized(prefix(rows, ["k"], ["ts", "id"], ts="ts", width_s=7200.0, sums={"total": F.col("id")}).select("id", "k"))
    right = rows.select("k", F.col("ts").alias("from"), F.col("v").alias("w"))
    assert "Window" not in optimized(asof_join(rows, right, ["k"], left_ts="ts", right_ts="from", cols=["w"], width_s=7200.0).select("id"))


def flows_of(spark):
    data = [("10.1.0.1" if i % 2 else "10.1.0.2", i, 1 + i % 7, i, 1 + i % 50, (i * 997) % 100000, i % 1000, (6, 1, 17)[i % 3]) for i in range(200)]
    f = spark.createDataFrame(data, "src_ip string, l_orderkey long, l_linenumber long, l_partkey long, packet_count long, byte_count long, tp_dst long, ip_proto long")
    return FL.flow_rates(f.withColumns({"flow_duration_sec": F.lit(1.0), "flow_duration_nsec": F.lit(0.0), "rf_ip_proto": F.col("ip_proto").cast("double"),
                                        "rf_avg_bytes_per_pkt": F.col("byte_count") / F.col("packet_count")}))


def test_cascade_writes_only_what_is_kept(spark):
    f, key = flows_of(spark), catalog.FLOW_KEY
    run = lambda **more: cascade(f, catalog.fixed_forest(), catalog.fixed_classes(), threshold=0.62, **more)
    few = run(keep=key)
    assert "byte_count_per_second" not in optimized(few) and "packet_count" not in optimized(few)
    cols = [*key, "if_score", "is_anomaly", "attack_class", "confidence"]
    made = sorted(map(tuple, few.select(*cols).collect()))
    assert made == sorted(map(tuple, run().select(*cols).collect()))
    assert {r[5] for r in made} == {0, 1}


def test_address_caches_need_no_join(spark):
    flows = spark.createDataFrame([(1, "a", START + timedelta(hours=5), 1, 0)], "id long, src_ip string, ts timestamp, dpid long, ip_proto long")
    packets = spark.createDataFrame([(1, "a", START, 1, "UDP"), (2, "a", START + timedelta(hours=1), 2, "TCP")], "event_id long, src_ip string, ts timestamp, dpid long, proto string")
    out = resolve_addresses(flows, packets, slice_s=3600.0)
    assert "Join" not in optimized(out)
    assert [r.resolved_proto for r in out.collect()] == [17]


def test_messages_are_parsed_once(spark, tmp_path):
    events = spark.createDataFrame([(i, START + timedelta(hours=i), i % 3, ("click", "view")[i % 2], 1.0) for i in range(20)],
                                   "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    lines = spark.createDataFrame([(i, i, i % 3, 1 + i % 7, 20.0 + i, 100.0, 0.01, 0.02, "A", START + timedelta(days=i % 4)) for i in range(20)],
                                  "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                  "l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp_ntz")
    events.write.parquet(str(tmp_path / "events.parquet"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    out = catalog.QUERIES["parse_telemetry_types"](spark, str(tmp_path))
    assert "from_json" not in optimized(out)
    assert {r["type"]: r["count"] for r in out.groupBy("type").count().collect()} == {"packet_in": 20, "flow_stats": 20, "dropped_delta": 14, "switch_count": 4}


def test_few_keys_copy_no_rows(rows):
    right = rows.select("k", F.col("ts").alias("from"), F.col("id").alias("w"))
    out = asof_join(rows, right, ["k"], left_ts="ts", right_ts="from", cols=["w"], width_s=72000.0, right_tie="w", spread_over=8)
    assert "Generate" not in optimized(out) and "xxhash64" not in optimized(out)
    known = [r for r in rows.collect() if r.k is not None]
    for r in out.collect():
        before = [(x.ts, x.id) for x in known if x.k == r.k and x.ts <= r.ts]
        assert r.w == (max(before)[1] if before else None)


def test_commands_are_hashed_not_sorted_for_the_summary(spark):
    at = lambda h: START + timedelta(hours=h)
    packets = spark.createDataFrame([(i, "a" if i < 8 else None, at(i) if i else None, 1 + i % 2, "UDP") for i in range(10)],
                                    "event_id long, src_ip string, ts timestamp, dpid long, proto string")
    commands = spark.createDataFrame([(1, "a", at(0), "rate_limit", None, 1), (None, "a", at(2), "redirect", None, 2), (3, "a", at(2), "block", 7200, 2), (2, "a", at(2), "redirect", None, 2),
                                      (5, None, None, "block", 3600, 1), (4, None, None, "quarantine", None, 2), (6, "a", at(6), "clear", None, 1)],
                                     "id long, src_ip string, ts timestamp, action string, ttl long, target_dpid long")
    out = PO.resolve_policy(packets, commands, slice_s=3600.0)
    before_scan = out._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in before_scan and "max_by" in before_scan
    # the block of hour 2 has the highest id of its switch and removes the redirects; rules without a time come first, and one without an end holds
    assert {r.event_id: r.rule for r in out.collect()} == {0: "forward", 1: "forward", 2: "rate_limit", 3: "block", 4: "rate_limit", 5: "forward",
                                                          6: "permit", 7: "forward", 8: "block", 9: "quarantine"}


def test_sources_of_a_tick_are_not_hashed_before_the_shuffle(spark):
    flows = spark.createDataFrame([("s%d" % (i % 5) if i % 7 else (None, "", "0.0.0.0")[i % 3], START, 6, 10, 1000, 5.0, 500.0) for i in range(70)],
                                  "src_ip string, ts timestamp, ip_proto int, packet_count long, byte_count long, packet_count_per_second double, byte_count_per_second double")
    out = TE.tea_snapshot(flows)
    assert "Expand" not in optimized(out)
    assert out.first()["unique_ips"] == 5 and out.first()["proto_entropy"] == 0.0


def test_uniform_share_sends_medians_to_the_rows(spark):
    """Medians are written, small tables: Spark's size check can see them, and the rows are shuffled only for the result."""
    data = [("all", START + timedelta(seconds=i % 4), float(i % 13), float(i % 7)) for i in range(400)]
    shaped = spark.createDataFrame(data, "scope string, tick_ts timestamp, size_x double, intensity_x double")
    out = TE.uniform_share(shaped)
    physical = out._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in optimized(out) and "SortMergeJoin" not in physical and physical.count("BroadcastHashJoin") == 2
    assert out.count() == 4


def test_verdicts_reach_flows_without_a_sort(spark):
    flows = spark.createDataFrame([(i, "all", START + timedelta(seconds=i)) for i in range(200)], "id long, scope string, ts timestamp")
    verdicts = spark.createDataFrame([("all", START + timedelta(seconds=10 * i), i % 2 == 0, "high", True) for i in range(3, 15)],
                                     "scope string, tick_ts timestamp, is_attack_pattern boolean, confidence string, is_learned boolean")
    out = FU.attach_tea(flows, verdicts, slice_s=320.0)
    assert "Window" not in optimized(out) and "BroadcastHashJoin" in out._jdf.queryExecution().sparkPlan().toString()
    for r in out.collect():
        tick = min(r["id"] // 10, 14)
        assert (r["tea_is_learned"], r["tea_attack_pattern"]) == ((True, tick % 2 == 0) if tick >= 3 else (False, False)), r
    assert out.count() == 200


def test_trained_models_score_the_rows_written_for_training(spark, tmp_path):
    """The flows are counted and labelled once: scoring after a training shuffles nothing."""
    lines = [(i, i % 97, i % 9, 1 + i % 7, 1.0 + i % 50, 100.0 + 7 * i, 0.01 * (i % 10), 0.01 * (i % 8), "ARN"[i % 3], datetime(1996, 1, 1) + timedelta(days=i % 400)) for i in range(600)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                                 "l_tax double, l_returnflag string, l_shipdate timestamp_ntz").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(9).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    first = catalog.QUERIES["isolation_forest_score"](spark, str(tmp_path))
    assert "Exchange" not in first._jdf.queryExecution().sparkPlan().toString() and "Window" not in first._jdf.queryExecution().optimizedPlan().toString()
    made = sorted(map(tuple, first.collect()))
    assert len(made) == 600 and {r[-1] for r in made} == {0, 1}
    # with the models at hand the flows are counted anew, to the same scores
    assert made == sorted(map(tuple, catalog.QUERIES["isolation_forest_score"](spark, str(tmp_path)).collect()))


def exchanges_with(df, column: str) -> int:
    """Shuffles in the plan that move ``column``."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return sum(f"{column}#" in part.split("\n")[1] for part in text.split("\n\n") if re.match(r"\(\d+\) Exchange\n", part.strip("\n") + "\n"))


def test_scans_of_the_same_slices_share_a_shuffle(spark, rows):
    """Dealt scans give what the others give, rows with null keys and times included, and do not shuffle the rows again."""
    some = rows.withColumn("ts", F.when(F.col("id") % 11 != 0, F.col("ts"))).withColumn("cargo", F.col("id") * 2)
    right = some.filter("id % 4 = 0").select("k", F.col("ts").alias("from"), F.col("v").alias("w"), F.col("id").alias("tie"))
    ask = dict(left_ts="ts", right_ts="from", cols=["w"], width_s=7200.0, right_tie="tie")
    apart = asof_join(prefix(some, ["k"], ["ts", "id"], ts="ts", width_s=7200.0, sums={"total": F.col("id")}, lag={"before": F.col("id")}), right, ["k"], **ask)
    dealt = with_slice(some, "ts", 7200.0).withColumn("n", F.row_number().over(local_window(["k"], ["ts", "id"])))
    dealt = prefix(dealt, ["k"], ["ts", "id"], sums={"total": F.col("id")}, lag={"before": F.col("id")}, dealt=True)
    dealt = asof_join(dealt, right, ["k"], **ask, dealt=True)
    assert SLICE in dealt.columns and exchanges_with(dealt, "cargo") == 1 < exchanges_with(apart, "cargo")
    same = ["id", "cargo", "total", "before", "w"]
    want = sorted(map(repr, apart.select(same).collect()))
    assert sorted(map(repr, dealt.select(same).collect())) == want
    # where unions do not keep how their parts lie, the rows are shuffled again
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    try:
        again = dealt.select(same).filter(F.lit(True))
        assert sorted(map(repr, again.collect())) == want
    finally:
        spark.conf.unset("spark.sql.unionOutputPartitioning")


def detection_tables(spark):
    flows = [(i, START + timedelta(minutes=i), i // 60, 1 + i % 2, "10.1.0.%d" % (i % 3 + 1), "10.3.0.1", 0 if i % 4 == 0 else 17, 1 + i % 50, 100 + 31 * i, float(i % 3), 2e8, i % 900, i % 7, 1.0 if i % 9 else 5.0, "c%d" % i)
             for i in range(240)]
    flows = spark.createDataFrame(flows, "flow_id long, ts timestamp, poll_id long, dpid long, src_ip string, dst_ip string, ip_proto long, packet_count long, byte_count long, "
                                         "flow_duration_sec double, flow_duration_nsec double, tp_src long, tp_dst long, wait_s double, cargo string")
    packets = spark.createDataFrame([(i, START + timedelta(seconds=40 * i), 1 + i % 2, "10.1.0.%d" % (i % 3 + 1), "UDP" if i % 5 else "TCP", i % 5 == 0, False) for i in range(300)],
                                    "event_id long, ts timestamp, dpid long, src_ip string, proto string, tcp_flags_syn boolean, tcp_flags_ack boolean")
    states = flows.filter("flow_id % 10 = 0").select("src_ip", "ts", F.col("flow_id").alias("id"), (F.col("flow_id") % 4).cast("int").alias("phase"))
    return flows, packets, states


def test_gate_shuffles_the_flows_once_for_its_scans(spark):
    flows, packets, states = detection_tables(spark)
    flows = flows.withColumn("flow_count_per_src", F.lit(1).cast("long"))
    out = DE.gate(flows, packets, order=["ts", "flow_id"], states=states, wait="wait_s", slice_s=3600.0)
    assert exchanges_with(out, "cargo") == 1
    assert out.count() == 240 and {r["route"] for r in out.collect()} >= {"score"}


def test_detection_writes_no_features_and_joins_small_tables(spark):
    """Features follow from the written columns; polls and verdicts are tables whose size Spark knows."""
    flows, packets, states = detection_tables(spark)
    out = DE.detect(flows, packets, catalog.fixed_models(), order=["ts", "flow_id"], states=states, wait="wait_s", tick_s=600.0, slice_s=3600.0)
    scan = next(line for line in optimized(out.select("flow_id", "if_packet_count", "rf_packet_count", "packet_count_per_second", "is_anomaly")).splitlines() if "Relation" in line)
    assert "if_packet_count" not in scan and "rf_packet_count" not in scan and "packet_count_per_second" not in scan
    assert "SortMergeJoin" not in out._jdf.queryExecution().sparkPlan().toString()
    hits = 0
    for r in out.collect():
        if r["is_anomaly"] == 1:
            hits += 1
            assert r["if_packet_count"] == r["rf_packet_count"] == pytest.approx(math.log1p(r["packet_count"])) and r["pps"] == r["packet_count_per_second"]
        else:
            assert r["if_packet_count"] is None and r["rf_packet_count"] is None
    assert hits


def test_polls_are_summed_without_shuffling_flows_by_all_their_columns(spark):
    flows, _, _ = detection_tables(spark)
    out = FL.switch_poll_stats(flows)
    assert exchanges_with(out, "dst_ip") == 1
    got = {(r["dpid"], r["poll_id"]): r for r in out.collect()}
    want = flows.toPandas().groupby(["dpid", "poll_id"])
    assert len(got) == want.ngroups
    for key, part in want:
        r = got[key]
        assert (r["disp_pakt"], r["gfe"], r["g_usip"], r["active_ports"]) == (part.packet_count.sum(), len(part), part.src_ip.nunique(), part.tp_dst.nunique())
        assert r["dominant_proto"] == max((n, p) for p, n in part.ip_proto.value_counts().items())[1]
