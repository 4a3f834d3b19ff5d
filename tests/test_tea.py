import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from floodwatch.functions.entropy import binned_medians, entropy_of, exact_medians, shannon_entropy
from floodwatch.operators import tea as T
from floodwatch.operators.fusion import baseline_lock

T0 = dt.datetime(2024, 1, 1)


def four(x):
    return np.full(4, float(x))


def test_baseline_learns_by_stability_and_by_count():
    base = T.Baselines()
    for i in range(15):
        assert np.isnan(base.mean[0]) == (i < 10) and np.isnan(base.mean[1])
        base = T.learn(base, np.array([1.0 + 0.001 * i, i * i, i * i, i * i]), False)   # the first is calm, the variance of the others keeps moving
    assert base.known and base.head == () and base.mean[1] == pytest.approx(np.mean([i * i for i in range(15)]))
    assert base.mean[0] > np.mean([1.0 + 0.001 * i for i in range(10)])                  # already moving on


def test_baseline_rejects_from_three_sigma_and_while_locked():
    base = T.Baselines(four(10.0), four(1.0))
    assert (T.learn(base, four(13.0), False).mean == 10.0).all()
    assert (T.learn(base, four(12.999), True).mean == 10.0).all()
    moved = T.learn(base, four(12.999), False)
    alpha = 0.10 - (1.0 / (10 + 1e-9)) * 0.08
    assert moved.mean == pytest.approx(four(alpha * 12.999 + (1 - alpha) * 10))
    assert moved.var == pytest.approx(alpha * (12.999 - moved.mean) ** 2 + (1 - alpha))   # error from the new mean
    assert T.learn(T.Baselines(), four(1), True).head                                      # a lock does not stop first learning


def test_lock_takes_ten_normals(spark):
    flags = [0, 1] + [0] * 12
    df = spark.createDataFrame([(i, "all", T0 + dt.timedelta(seconds=i), f) for i, f in enumerate(flags)], ["id", "scope", "ts", "is_anomaly"])
    out = [r["locked_after"] for r in baseline_lock(df, ["ts", "id"], slice_s=3.0).orderBy("id").collect()]
    assert out == [False] + [True] * 10 + [False] * 3


@pytest.mark.parametrize("weights,want", [([5.0], 0.0), ([2.0] * 8, 3.0), ([], 0.0), ([0.0, 0.0], 0.0), ([4.0, 4.0, 0.0], 1.0)])
def test_entropy(spark, weights, want):
    df = spark.createDataFrame([(weights,)], "a array<double>")
    assert df.select(entropy_of(F.col("a"))).first()[0] == pytest.approx(want)
    rows = spark.createDataFrame([("k", str(i), w) for i, w in enumerate(weights)], "k string, c string, w double")
    out = shannon_entropy(rows, ["k"], "c", F.col("w")).collect()
    assert (out[0]["entropy"] if out else 0.0) == pytest.approx(want)


def test_binned_medians_equal_exact(spark):
    rng = random.Random(1)
    rows = []
    for k in range(12):
        n = 1 if k == 0 else 2 if k == 1 else rng.randrange(3, 400)
        rows += [(k, rng.choice([rng.random() * 12, 3.25, 3.2500001]), rng.random() * 0.01) for _ in range(n)]
    df = spark.createDataFrame(rows, "k int, a double, b double").repartition(5)
    left, right = (f(df, ["k"], ["a", "b"]).orderBy("k").toPandas() for f in (binned_medians, exact_medians))
    np.testing.assert_allclose(left[["med_a", "med_b"]], right[["med_a", "med_b"]], rtol=0, atol=1e-12)


def test_identical_flows_are_uniform(spark):
    rows = [("x", T0, f"s{i}", 6, 10, 1000, 5.0, 500.0) for i in range(9)] + [("x", T0, "s9", 6, 10, 1000, 5.0, 500.0 * math.exp(0.2))]
    df = spark.createDataFrame(rows, "scope string, ts timestamp, src_ip string, ip_proto int, packet_count long, byte_count long, "
                                     "packet_count_per_second double, byte_count_per_second double")
    snap = T.tea_snapshot(df).first()
    assert snap["uniform_share"] == pytest.approx(0.9)      # deviation 0.2 is over the 0.10 floor
    assert snap["size_var"] == 0.0 and snap["proto_entropy"] == 0.0 and snap["unique_ips"] == 10


def profile(pps):
    """The verdict for one source's samples, computed directly."""
    a = pps[-20:]
    n = len(a)
    if n < 5:
        return "uncertain"
    mean, half = sum(a) / n, n // 2
    trend = sum(a[half:]) / (n - half) - sum(a[:half]) / half
    total = sum(a)
    ent = -sum(x / total * math.log2(x / total) for x in a if x > 0) if total else 0.0
    cv = math.sqrt(max(np.var(a), 1e-9)) / (abs(mean) + 1e-9)
    slope = mean * max(0.05, min(0.2, 0.1 * (1 + cv)))
    if trend > slope or ent / math.log2(n) < max(0.25, min(0.55, 0.4 - cv * 0.15)):
        return "attack"
    if trend < -slope or mean < (sum(a[:3]) / 3 + 1e-9) * 0.5:
        return "normal"
    return "uncertain"


def test_profiles(spark):
    rng = random.Random(2)
    series = {"rising": [10.0 + i * 3 for i in range(30)], "falling": [100.0 - i * 3 for i in range(30)], "flat": [7.0] * 30,
              "spike": [0.0] * 10 + [900.0] + [0.0] * 12, "hot": [rng.random() * 50 for _ in range(120)]}
    rows = [(k, T0 + dt.timedelta(seconds=i), i, v) for k, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "src_ip string, ts timestamp, id long, packet_count_per_second double")
    out = T.ip_profile_verdict(df, ["ts", "id"], slice_s=7.0).collect()
    assert {r["ip_verdict"] for r in out} == {"uncertain", "attack", "normal"}
    for r in out:
        assert r["ip_verdict"] == profile(series[r["src_ip"]][:r["id"] + 1]), (r["src_ip"], r["id"])


def test_tick_moments_stream(spark, tmp_path):
    from floodwatch.streaming.jobs import tick_moments_stream
    rng = random.Random(3)
    rows = [("all", T0 + dt.timedelta(milliseconds=rng.randrange(5000)), rng.choice([1, 6, 17]), rng.randrange(1, 50), rng.randrange(60, 9000),
             rng.random() * 90, rng.random() * 9000, f"10.0.0.{rng.randrange(9)}") for _ in range(600)]
    rows.append(("all", T0 + dt.timedelta(seconds=90), 6, 1, 60, 1.0, 60.0, "10.0.0.1"))   # closes every earlier tick
    df = spark.createDataFrame(rows, "scope string, ts timestamp, ip_proto int, packet_count long, byte_count long, packet_count_per_second double, "
                                     "byte_count_per_second double, src_ip string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = (tick_moments_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("ticks")
         .option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    mine = spark.table("ticks").orderBy("tick_ts").toPandas()
    want = T.tea_snapshot(df).filter(F.col("tick_ts") < F.lit(T0 + dt.timedelta(seconds=60))).orderBy("tick_ts").toPandas()
    assert len(mine) == len(want) == 10
    for c in ("size_var", "intensity_var", "proto_entropy"):
        np.testing.assert_allclose(mine[c], want[c], atol=1e-9)


def test_verdict_stream_equals_batch(spark, tmp_path):
    """Snapshots arrive in any order, some ticks locked; the fold sees them in order of time."""
    from floodwatch.streaming.jobs import tea_verdict_stream
    rng = random.Random(8)
    calm = lambda: [5 + rng.random() * 0.2, 3 + rng.random() * 0.2, 1 + rng.random() * 0.05, 0.5 + rng.random() * 0.05]
    rows = [(s, T0 + dt.timedelta(seconds=i / 2), *(calm() if i % 23 else [x * 4 for x in calm()]), i, i % 5 == 0) for s in ("a", "b") for i in range(60)]
    df = spark.createDataFrame(rows, "scope string, tick_ts timestamp, size_var double, intensity_var double, proto_entropy double, uniform_share double, unique_ips long, locked boolean")
    for i in range(3):
        df.filter(F.col("unique_ips") % 3 == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    closing = df.limit(1).withColumns({"scope": F.lit("closing"), "tick_ts": F.lit(T0 + dt.timedelta(hours=2)).cast("timestamp")})
    closing.coalesce(1).write.parquet(str(tmp_path / "in" / "p9"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = (tea_verdict_stream(stream, delay="10 minutes").writeStream.format("memory").queryName("verdicts")
         .option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    want = T.tea_verdict(df.drop("locked"), df).orderBy("scope", "tick_ts")
    mine = spark.table("verdicts").select(want.columns).orderBy("scope", "tick_ts").toPandas()
    want = want.toPandas()
    assert len(mine) == 120 and set(want["confidence"]) == {"low", "high"} and 0 < want["is_learned"].sum() < 120
    for c in want.columns:
        if want[c].dtype == float:
            np.testing.assert_allclose(mine[c], want[c], atol=1e-12)
        else:
            assert mine[c].tolist() == want[c].tolist()


def profile_with_nulls(pps):
    """The verdict where samples may be null: they count as samples and have no value."""
    last, mean_of = pps[-20:], lambda xs: sum(xs) / len(xs) if xs else None
    k, a = len(last), [x for x in last if x is not None]
    if k < 5:
        return "uncertain"
    if k == 20:
        some = lambda xs: [x for x in xs if x is not None]
        new, old, first = (mean_of(some(xs)) for xs in (last[10:], last[:10], last[:3]))
    else:
        new, old, first = mean_of(a[k // 2:]), mean_of(a[:k // 2]), mean_of(a[:3])
    trend = None if new is None or old is None else new - old
    mean, total = mean_of(a), sum(a)
    ent = -sum(x / total * math.log2(x / total) for x in a if x > 0) if total else 0.0
    cv = math.sqrt(max(np.var(a), 1e-9)) / (abs(mean) + 1e-9)
    slope = mean * max(0.05, min(0.2, 0.1 * (1 + cv)))
    if trend is not None and trend > slope or ent / math.log2(k) < max(0.25, min(0.55, 0.4 - cv * 0.15)):
        return "attack"
    if trend is not None and trend < -slope or first is not None and mean < (first + 1e-9) * 0.5:
        return "normal"
    return "uncertain"


def test_profiles_with_null_samples(spark):
    rng = random.Random(11)
    series = {f"s{j}": [None if i > 1 and rng.random() < share else rng.random() * 40 for i in range(70)] for j, share in enumerate((0.0, 0.05, 0.3, 0.6, 1.0))}
    rows = [(k, T0 + dt.timedelta(seconds=i), i, v) for k, vs in series.items() for i, v in enumerate(vs) if k != "s4" or i < 15]
    df = spark.createDataFrame(rows, "src_ip string, ts timestamp, id long, packet_count_per_second double")
    out = T.ip_profile_verdict(df, ["ts", "id"], slice_s=7.0).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["ip_verdict"] == profile_with_nulls(series[r["src_ip"]][:r["id"] + 1]), (r["src_ip"], r["id"])
        assert r["samples"] == min(20, r["id"] + 1)


def test_profiles_add_up_rows_instead_of_frames(spark):
    f = spark.createDataFrame([("s", T0, 1, 2.0)], "src_ip string, ts timestamp, id long, packet_count_per_second double")
    plan = T.ip_profile_verdict(f, ["ts", "id"], slice_s=60.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(" in plan and "avg(" not in plan and "var_pop(" not in plan


def test_snapshots_that_may_never_be_read_run_nothing_when_built(spark):
    """Without written medians the same snapshots come from a plan alone: no job runs before they are read."""
    rows = [("s%d" % (i % 7), T0 + dt.timedelta(seconds=i % 5), (6, 1, 17)[i % 3], 1 + i % 13, 40 + 17 * i % 900, 1.0 + i % 11, 60.0 + i % 29) for i in range(180)]
    flows = spark.createDataFrame(rows, "src_ip string, ts timestamp, ip_proto long, packet_count long, byte_count long, packet_count_per_second double, byte_count_per_second double")
    spark.sparkContext.setJobGroup("lazy", "lazy")
    lazy = T.tea_verdict(T.tea_snapshot(flows, tick_s=1.0, written=False))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not list(jobs)
    want = T.tea_verdict(T.tea_snapshot(flows, tick_s=1.0)).orderBy("tick_ts").toPandas()
    pd.testing.assert_frame_equal(lazy.orderBy("tick_ts").toPandas(), want)
