"""Temporal entropy analysis: tick snapshots, adaptive baselines, verdicts, profiles."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodwatch import config as C
from floodwatch.functions.entropy import binned_medians
from floodwatch.plans.slices import OWN, local_window, micros, sorted_map, with_row_halo
from floodwatch.plans.stage import cut

METRICS = ("size_var", "intensity_var", "proto_entropy", "uniform_share")


def with_tick(flows: DataFrame, tick_s: float = C.TICK_S, scope: Column | None = None) -> DataFrame:
    """Add ``scope`` (one for all traffic by default) and the tick's start time."""
    us = int(round(tick_s * 1e6))
    start = F.timestamp_micros(F.floor(micros("ts") / F.lit(float(us))).cast("long") * us)
    ntz = dict(flows.dtypes)["ts"] == "timestamp_ntz"
    return (flows.withColumn("scope", scope if scope is not None else F.lit("all"))
            .withColumn("tick_ts", start.cast("timestamp_ntz") if ntz else start))


def flow_shape(flows: DataFrame) -> DataFrame:
    """Log packet size and log intensity of each flow."""
    size = F.col("byte_count") / (F.col("packet_count") + F.lit(C.EPS))
    rate = F.col("packet_count_per_second") * F.col("byte_count_per_second")
    return (flows.withColumn("size_x", F.log1p(F.greatest(size, F.lit(0.0))))
            .withColumn("intensity_x", F.log1p(F.greatest(rate, F.lit(0.0)))))


def uniform_share(shaped: DataFrame, *, written: bool = True) -> DataFrame:
    """Share of a tick's flows near its median size and its median intensity.

    The tolerance is a multiple of the median absolute deviation with a floor.
    A tick may hold a large part of all rows, so its medians come from narrow bins.
    They are one row a tick, written as tables; where these are small, no row is shuffled for them.
    Where the result may never be read, ``written`` false leaves all work until it is; rows are then shuffled for the medians.
    """
    keys = ["scope", "tick_ts"]
    base = shaped.select(*keys, "size_x", "intensity_x")
    centre = binned_medians(base, keys, ["size_x", "intensity_x"], written=written)
    centre = cut(centre, "centre") if written else centre
    off = (base.join(centre, keys)
           .select(*keys, F.abs(F.col("size_x") - F.col("med_size_x")).alias("size_d"),
                   F.abs(F.col("intensity_x") - F.col("med_intensity_x")).alias("intensity_d")))
    spread = binned_medians(off, keys, ["size_d", "intensity_d"], written=written)
    spread = cut(spread, "spread") if written else spread
    near = ((F.col("size_d") <= F.greatest(F.lit(C.SIZE_TOLERANCE), C.MAD_FACTOR * F.col("med_size_d")))
            & (F.col("intensity_d") <= F.greatest(F.lit(C.INTENSITY_TOLERANCE), C.MAD_FACTOR * F.col("med_intensity_d"))))
    return off.join(spread, keys).groupBy(*keys).agg(F.avg(near.cast("double")).alias("uniform_share"))


def tea_snapshot(flows: DataFrame, *, tick_s: float = C.TICK_S, scope: Column | None = None, written: bool = True) -> DataFrame:
    """One row per (scope, tick): variances, protocol entropy, uniform share, sources; ``written`` as in :func:`uniform_share`."""
    keys = ["scope", "tick_ts"]
    shaped = flow_shape(with_tick(flows, tick_s, scope))
    spread = shaped.groupBy(*keys).agg(F.var_pop("size_x").alias("size_var"),
                                       F.var_pop("intensity_x").alias("intensity_var"))
    weights = shaped.groupBy(*keys, "ip_proto").agg(F.count(F.lit(1)).cast("double").alias("_w"))
    total = F.sum("_w")
    mixed = weights.groupBy(*keys).agg((F.log2(total) - F.sum(F.col("_w") * F.log2("_w")) / total).alias("proto_entropy"))
    # a tick's sources may be as many as its rows: they are numbered after a shuffle, in a sort that spills, and no task hashes those of its whole input split
    real = F.when(~F.col("src_ip").isin("", "0.0.0.0"), F.col("src_ip"))
    nth = F.row_number().over(Window.partitionBy(*keys, "_src").orderBy("tick_ts"))
    sources = (shaped.select(*keys, real.alias("_src")).withColumn("_nth", nth)
               .groupBy(*keys).agg(F.count(F.when(F.col("_nth") == 1, F.col("_src"))).alias("unique_ips")))
    return (spread.join(mixed, keys).join(sources, keys).join(uniform_share(shaped, written=written), keys)
            .select(*keys, *METRICS, "unique_ips"))


# --- adaptive baselines -----------------------------------------------------


@dataclass(frozen=True)
class Baselines:
    """What is known of the four metrics, in the order of METRICS.

    ``mean`` is NaN while a metric is being learned. All metrics are learned from
    the first ticks on, so they share ``head``, the ticks since the start; it is
    empty once all are known, after LEARN_MAX ticks at the latest.
    """

    mean: np.ndarray = field(default_factory=lambda: np.full(len(METRICS), np.nan))
    var: np.ndarray = field(default_factory=lambda: np.zeros(len(METRICS)))
    head: tuple[np.ndarray, ...] = ()

    @property
    def known(self) -> bool:
        return not np.isnan(self.mean).any()


def deviation(var: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(var, C.VARIANCE_FLOOR))


def variation(base: Baselines) -> np.ndarray:
    """Deviation over mean; NaN where it says nothing, as before learning and for a mean of 0."""
    return np.where(base.mean == 0, np.nan, deviation(base.var) / (np.abs(base.mean) + C.EPS))


def learn(base: Baselines, x: np.ndarray, locked: bool) -> Baselines:
    """The baselines after a tick they may learn from. A lock holds what is known; it does not stop first learning."""
    fresh = np.isnan(base.mean)
    pace = np.nan_to_num(np.clip(C.ALPHA_MAX - variation(base) * (C.ALPHA_MAX - C.ALPHA_MIN), C.ALPHA_MIN, C.ALPHA_MAX), nan=C.ALPHA_MIN)
    near = ~fresh & (np.abs(x - base.mean) / deviation(base.var) < C.REJECT_SIGMA) & (not locked)
    mean = np.where(near, pace * x + (1 - pace) * base.mean, base.mean)
    var = np.where(near, pace * (x - mean) ** 2 + (1 - pace) * base.var, base.var)
    if not fresh.any():
        return Baselines(mean, var)
    head = (*base.head, x)
    rows, n = np.array(head), len(head)
    calm = np.abs(rows[-5:].var(0) - rows[-10:-5].var(0)) < C.STABLE_VARIANCE if n >= C.LEARN_MIN else np.zeros(len(x), bool)
    done = fresh & (calm | (n >= C.LEARN_MAX))
    mean, var = np.where(done, rows.mean(0), mean), np.where(done, rows.var(0), var)
    return Baselines(mean, var, () if not np.isnan(mean).any() else head)


def judge(base: Baselines, x: np.ndarray) -> dict:
    """A tick against known baselines: scores, flags and how sure they are."""
    z = dict(zip(METRICS, ((x - base.mean) / deviation(base.var)).tolist()))
    vary = variation(base)[0]
    sigma = C.ATTACK_SIGMA if np.isnan(vary) else float(np.clip(C.ATTACK_SIGMA + C.ATTACK_SIGMA_SLOPE * vary, C.ATTACK_SIGMA_LOW, C.ATTACK_SIGMA_HIGH))
    size, intensity = abs(z["size_var"]) >= sigma, abs(z["intensity_var"]) >= sigma
    proto = z["proto_entropy"] <= -sigma or z["proto_entropy"] >= C.SHARE_SIGMA
    cluster = z["uniform_share"] >= C.SHARE_SIGMA
    attack = size or intensity or proto or cluster
    sure = (size and intensity) or (cluster and (size or intensity or proto))
    return {"size_zscore": z["size_var"], "intensity_zscore": z["intensity_var"], "proto_zscore": z["proto_entropy"], "uniform_share_zscore": z["uniform_share"],
            "mechanized_cluster": cluster, "size_surge": z["size_var"] >= sigma, "intensity_surge": z["intensity_var"] >= sigma,
            "attack_sigma": sigma, "is_attack_pattern": attack, "is_learned": True, "confidence": "low" if not attack else "high" if sure else "moderate"}


def tick_step(state: tuple[Baselines, np.ndarray | None], x: np.ndarray, locked: bool) -> tuple[tuple[Baselines, np.ndarray], dict]:
    """One tick of a scope: the state after it and what is reported. The first tick and those before all baselines are known only teach."""
    base, last = state
    if last is None or not base.known:
        return (learn(base, x, locked), x), {"is_learned": False}
    found = judge(base, x)
    if not found["is_attack_pattern"]:
        base = learn(base, x, locked)
    found |= {"size_delta": x[0] - last[0], "intensity_delta": x[1] - last[1], "baseline_mean_size": base.mean[0], "baseline_mean_intensity": base.mean[1]}
    return (base, x), found


NUMBERS = ("size_delta", "intensity_delta", "size_zscore", "intensity_zscore", "proto_zscore",
           "uniform_share_zscore", "baseline_mean_size", "baseline_mean_intensity", "attack_sigma")
FLAGS = ("mechanized_cluster", "size_surge", "intensity_surge", "is_attack_pattern", "is_learned")


def verdict_schema(snapshots: DataFrame) -> T.StructType:
    return T.StructType([
        *snapshots.select("scope", "tick_ts", *METRICS, "unique_ips").schema.fields,
        *[T.StructField(n, T.DoubleType()) for n in NUMBERS],
        *[T.StructField(n, T.BooleanType()) for n in FLAGS], T.StructField("confidence", T.StringType())])


START = (Baselines(), None)


def verdict_rows(frame: pd.DataFrame, states: dict[str, tuple]) -> pd.DataFrame:
    """Advance the scopes' states over a frame of ordered ticks."""
    locked = frame["locked"] if "locked" in frame else [False] * len(frame)
    found = []
    for scope, lock, x in zip(frame["scope"], locked, frame[list(METRICS)].to_numpy(float)):
        states[scope], said = tick_step(states.get(scope, START), x, bool(lock))
        found.append(said)
    out = frame[["scope", "tick_ts", *METRICS, "unique_ips"]].reset_index(drop=True)
    made = pd.DataFrame(found, columns=[*NUMBERS, *FLAGS, "confidence"])
    for n in NUMBERS:
        out[n] = made[n].astype("float64").fillna(0.0)
    for n in FLAGS:
        out[n] = made[n].eq(True)
    out["confidence"] = made["confidence"].fillna("low")
    return out


def tea_verdict(snapshots: DataFrame, locks: DataFrame | None = None) -> DataFrame:
    """Verdict per tick against adaptive baselines; one fold per scope over ticks.

    Each baseline update depends on the last, so ticks of one scope run in
    order. The fold sees one small row per tick, streams them and keeps a
    constant-size state; scopes run in parallel. ``locks`` (scope, tick_ts,
    locked) freezes learning.
    """
    rows = snapshots
    if locks is not None:
        rows = rows.join(locks.select("scope", "tick_ts", "locked"), ["scope", "tick_ts"], "left")
        rows = rows.withColumn("locked", F.coalesce("locked", F.lit(False)))
    schema = verdict_schema(snapshots)

    def fold(batches):
        states: dict[str, tuple] = {}
        for batch in batches:
            if len(batch) == 0:
                continue
            # scopes arrive one after another; earlier ones are finished
            last = batch["scope"].iloc[-1]
            out = verdict_rows(batch, states)
            states = {last: states[last]}
            yield out

    return (sorted_map(rows, ["scope"], ["tick_ts"], fold, schema)
            .withColumn("is_flash_crowd", F.lit(False)))


def adaptive_baseline(snapshots: DataFrame) -> DataFrame:
    """Each metric's baseline after each tick when nothing is locked or withheld: one row per scope, tick and metric."""
    schema = T.StructType([*snapshots.select("scope", "tick_ts").schema.fields, T.StructField("metric", T.StringType()), T.StructField("learned", T.BooleanType()),
                           T.StructField("baseline_mean", T.DoubleType()), T.StructField("baseline_var", T.DoubleType())])

    def fold(batches):
        scope, base = None, Baselines()
        for batch in batches:
            means, variances = [], []
            for s, x in zip(batch["scope"], batch[list(METRICS)].to_numpy(float)):
                if s != scope:
                    scope, base = s, Baselines()
                base = learn(base, x, False)
                means.append(base.mean)
                variances.append(base.var)
            out = batch.loc[batch.index.repeat(len(METRICS)), ["scope", "tick_ts"]].reset_index(drop=True)
            out["metric"] = list(METRICS) * len(batch)
            mean = np.array(means).ravel()
            out["learned"], out["baseline_mean"] = ~np.isnan(mean), np.nan_to_num(mean)
            out["baseline_var"] = np.array(variances).ravel()
            yield out

    return sorted_map(snapshots.select("scope", "tick_ts", *METRICS), ["scope"], ["tick_ts"], fold, schema)


def mitigation_advisory(rows: DataFrame) -> DataFrame:
    """Add ``would_block``: the gate's advice, which never blocks anything."""
    quiet = (~F.col("flagged") & F.col("tea_is_learned") & ~F.col("tea_attack_pattern")
             & (F.col("tea_confidence") == "low"))
    return rows.withColumn("would_block", F.coalesce(quiet, F.lit(False)))


# --- per-source profile -----------------------------------------------------


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _mean(a: Column) -> Column:
    """Mean of the values that are not null; null if there are none."""
    known = F.array_compact(a)
    return F.when(F.size(known) > 0, _total(known) / F.size(known))


def _added(values: list[Column]) -> Column:
    return reduce(Column.__add__, values)


def ip_profile_verdict(flows: DataFrame, order: list[str], *, slice_s: float, dealt: bool = False) -> DataFrame:
    """Verdict per flow from the source's last twenty packet rates; ``dealt`` as in :func:`floodwatch.plans.slices.prefix`.

    Each row reads the nineteen before it at their offsets and adds them up in plain columns; a sliding
    frame would aggregate all of them anew. Only a source's first nineteen rows, whose halves have other
    sizes, and rows with a null among the twenty look at an array.
    """
    n, half = C.PROFILE_WINDOW, C.PROFILE_WINDOW // 2
    v = F.col("_val")
    rows = with_row_halo(flows, ["src_ip"], order, value=F.col("packet_count_per_second"), n=n, ts="ts", width_s=slice_s, dealt=dealt)
    rows = rows.withColumn("_vl", F.when(v > 0, v * F.log2(v)).otherwise(0.0))
    here = local_window(["src_ip"], order)
    back, logs = [f"_v{i}" for i in range(n - 1, 0, -1)], [f"_vl{i}" for i in range(n - 1, 0, -1)]
    rows = rows.withColumns({"_k": F.least(F.row_number().over(here), F.lit(n))}
                            | {c: F.lag("_val", n - 1 - i).over(here) for i, c in enumerate(back)}
                            | {c: F.lag("_vl", n - 1 - i, 0.0).over(here) for i, c in enumerate(logs)}).filter(OWN)
    xs = [*[F.col(c) for c in back], v]
    # a sum is null where one of the twenty is missing or null
    rows = rows.withColumns({"_old": _added(xs[:half]), "_new": _added(xs[half:]), "_head": _added(xs[:3]), "_vlog": _added([F.col(c) for c in [*logs, "_vl"]])})
    rows = rows.withColumn("_sum", _added([F.col("_old"), *xs[half:]]))
    every, full = F.col("_sum").isNotNull(), F.col("_k") == n
    size = F.col("_k").cast("int")
    rows = rows.withColumn("_last", F.when(~every, F.slice(F.array(*xs), n + 1 - size, size))).withColumn("_young", F.array_compact("_last"))
    a, known = F.col("_young"), F.size("_young") > 0
    rows = rows.withColumn("_mean", F.when(every, F.col("_sum") / n).otherwise(_mean(a)))
    square = lambda x: (x - F.col("_mean")) * (x - F.col("_mean"))
    mid = F.floor(F.col("_k") / 2).cast("int")
    early = F.when(F.col("_k") < 4, 0.0).otherwise(
        _mean(F.slice(a, mid + 1, size)) - _mean(F.slice(a, F.lit(1), F.greatest(mid, F.lit(1)))))
    halves = _mean(F.slice("_last", half + 1, n - half)) - _mean(F.slice("_last", 1, half))
    rows = (rows.withColumn("_var", F.when(every, _added([square(x) for x in xs]) / n)
                            .when(known, F.aggregate(a, F.lit(0.0), lambda s, x: s + square(x)) / F.size(a)))
            .withColumn("samples", F.col("_k").cast("long"))
            .withColumn("ip_trend", F.when(every, F.col("_new") / (n - half) - F.col("_old") / half).when(full, halves).otherwise(early))
            .withColumn("_first", F.when(every, F.col("_head") / 3).when(full, _mean(F.slice("_last", 1, 3))).otherwise(_mean(F.slice(a, 1, 3))))
            .withColumn("_cv", F.sqrt(F.greatest("_var", F.lit(C.VARIANCE_FLOOR))) / (F.abs("_mean") + C.EPS))
            .withColumn("_sum", F.when(every, F.col("_sum")).when(known, _total(a))))
    entropy = F.when(F.col("_sum") > 0, F.log2("_sum") - F.col("_vlog") / F.col("_sum")).otherwise(0.0)
    norm = entropy / F.when(F.col("_k") > 1, F.log2(F.col("_k").cast("double"))).otherwise(1.0)
    repeats = norm < F.greatest(F.lit(0.25), F.least(F.lit(0.55), 0.4 - F.col("_cv") * 0.15))
    slope = F.col("_mean") * F.greatest(F.lit(0.05), F.least(F.lit(0.2), 0.1 * (1 + F.col("_cv"))))
    low = F.col("_mean") < (F.col("_first") + C.EPS) * 0.5
    verdict = (F.when(F.col("_k") < C.PROFILE_MIN, "uncertain").when((F.col("ip_trend") > slope) | repeats, "attack")
               .when((F.col("ip_trend") < -slope) | low, "normal").otherwise("uncertain"))
    return rows.withColumn("ip_verdict", verdict).select(*flows.columns, "samples", "ip_trend", "ip_verdict")
