"""No scan loses rows with null keys or times, and they match nothing."""

import random

import pytest

from floodwatch.models.iforest import grow
from floodwatch.operators import behavior, flows, fusion
from floodwatch.plans.slices import asof_join, prefix
from floodwatch.sources.telemetry import ground_truth_intervals
from pyspark.sql import functions as F

HOUR = 3600.0


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    out = [(i, None if rng.random() < 0.1 else f"s{rng.randrange(4)}", None if rng.random() < 0.1 else f"2024-01-0{rng.randrange(1, 9)} 0{rng.randrange(10)}:00:00",
            rng.randrange(1, 3), rng.randrange(100), rng.random(), rng.random() < 0.5) for i in range(400)]
    df = spark.createDataFrame(out, "event_id long, src_ip string, t string, dpid long, packet_count long, confidence double, hit boolean")
    return df.withColumn("ts", F.to_timestamp("t")).withColumn("is_anomaly", F.col("hit").cast("long")).withColumn("attack_class", F.lit("SYN Flood")).drop("t", "hit").cache()


def ids(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


def test_every_scan_keeps_every_row(rows):
    order, want = ["ts", "event_id"], ids(rows)
    calls = rows.filter("event_id % 3 = 0").withColumn("call", F.lit("start")).withColumn("attack_type", F.lit("SYN"))
    intervals = ground_truth_intervals(calls, slice_s=24 * HOUR)
    assert intervals.count() == calls.count()
    flags = rows.filter("event_id % 5 = 0").select("src_ip", F.col("ts").alias("flag_from"), F.col("ts").alias("flag_to"))
    history = rows.select("src_ip", F.col("ts").alias("unblocked_at"))
    made = {
        "flow_delta": flows.flow_delta(rows, order, slice_s=24 * HOUR),
        "label": fusion.label_with_ground_truth(rows, intervals, slice_s=24 * HOUR),
        "flag": fusion.attach_prefilter_flag(rows, flags, slice_s=24 * HOUR),
        "lock": fusion.confidence_lock(rows, order, slice_s=24 * HOUR),
        "baseline": fusion.baseline_lock(rows.withColumn("scope", F.col("src_ip")), order, slice_s=24 * HOUR),
        "reputation": behavior.attach_reputation(rows, history)}
    for name, df in made.items():
        assert ids(df) == want, name
    unknown = F.col("src_ip").isNull() | F.col("ts").isNull()
    assert made["label"].filter(unknown & (F.col("attack_type").isNotNull())).count() == 0
    assert made["flag"].filter(unknown & F.col("flagged")).count() == 0


def test_null_groups_scan_like_a_window(rows):
    from pyspark.sql import Window
    w = Window.partitionBy("src_ip").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    want = {(r.event_id, r.x) for r in rows.withColumn("x", F.sum("packet_count").over(w)).collect()}
    got = prefix(rows, ["src_ip"], ["ts", "event_id"], ts="ts", width_s=24 * HOUR, sums={"x": F.col("packet_count")})
    assert {(r.event_id, r.x) for r in got.collect()} == want


def test_asof_join_of_nulls_matches_nothing(rows):
    right = rows.select("src_ip", F.col("ts").alias("at"), F.col("event_id").alias("other"))
    got = asof_join(rows, right, ["src_ip"], left_ts="ts", right_ts="at", cols=["other"], width_s=24 * HOUR)
    assert ids(got) == ids(rows)
    assert got.filter((F.col("src_ip").isNull() | F.col("ts").isNull()) & F.col("other").isNotNull()).count() == 0
    assert got.filter(F.col("src_ip").isNotNull() & F.col("ts").isNotNull() & F.col("other").isNull()).count() == 0


def test_trees_grow_over_nearly_equal_values():
    import numpy as np
    low = 0.7087087086412887
    x = np.array([[low], [np.nextafter(low, 1)], [low], [np.nextafter(low, 1)]])
    for seed in range(300):
        nodes = grow(x, np.random.default_rng(seed), 8)
        assert len(nodes) == 3 and all(n[0] == 0 for n in nodes[:1])
