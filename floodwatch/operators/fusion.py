"""Decision fusion: truth labels, verdicts, flags, confidence lock, scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodwatch import config as C
from floodwatch.operators.features import SHORT_CLASS, lookup
from floodwatch.plans.slices import asof_join, asof_lookup, micros, prefix, with_halo
from floodwatch.plans import slices


def label_with_ground_truth(rows: DataFrame, intervals: DataFrame, *, slice_s: float) -> DataFrame:
    """Attach the attack type active for the source at the row's time.

    A source's intervals do not overlap, so the one in force is the last one
    started; it counts until its end (exclusive), or for good when open.
    """
    out = asof_join(rows, intervals, ["src_ip"], left_ts="ts", right_ts="start_ts",
                    cols=["attack_type", "end_ts"], width_s=slice_s)
    active = F.col("end_ts").isNull() | (F.col("ts") < F.col("end_ts"))
    return (out.withColumn("attack_type", F.when(active, F.col("attack_type")))
            .withColumn("is_attacker", F.col("attack_type").isNotNull())
            .withColumn("expected_class", F.when(F.col("attack_type") != "MIXED", F.col("attack_type")))
            .drop("end_ts"))


def attach_prefilter_flag(rows: DataFrame, flags: DataFrame, *, slice_s: float, dealt: bool = False) -> DataFrame:
    """Flag rows inside a flagged episode of their source (episodes do not overlap); ``dealt`` as in :func:`floodwatch.plans.slices.prefix`."""
    out = asof_join(rows, flags, ["src_ip"], left_ts="ts", right_ts="flag_from",
                    cols=["flag_to"], width_s=slice_s, dealt=dealt)
    return out.withColumn("flagged", F.coalesce(F.col("ts") <= F.col("flag_to"), F.lit(False))).drop("flag_to")


NEUTRAL = {"tea_attack_pattern": False, "tea_confidence": "low", "tea_is_learned": False}


def _verdict_columns(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("scope", "tick_ts", F.col("is_attack_pattern").alias("tea_attack_pattern"),
                           F.col("confidence").alias("tea_confidence"), F.col("is_learned").alias("tea_is_learned"))


def _settled_verdict(rows: DataFrame, profile: str | None, phase: str | None) -> DataFrame:
    """Neutral values where there is no verdict or the source is banned; a source's own "attack" profile counts as a moderate attack."""
    banned = F.coalesce(F.col(phase).isin(2, 3), F.lit(False)) if phase else F.lit(False)
    rows = rows.withColumns({n: F.when(banned, F.lit(v)).otherwise(F.coalesce(F.col(n), F.lit(v))) for n, v in NEUTRAL.items()})
    if profile:
        forced = F.coalesce(F.col(profile) == "attack", F.lit(False)) & ~banned
        rows = rows.withColumns({"tea_attack_pattern": F.col("tea_attack_pattern") | forced,
                                 "tea_confidence": F.when(forced, "moderate").otherwise(F.col("tea_confidence"))})
    return rows


def attach_tea(flows: DataFrame, verdicts: DataFrame, *, slice_s: float, profile: str | None = None,
               phase: str | None = None, groups: int = 8) -> DataFrame:
    """Latest traffic verdict of the scope at or before each flow.

    One scope may hold all flows, so no flow is sorted: verdicts become spans
    (:func:`floodwatch.plans.slices.asof_lookup`). Each slice is cut into
    ``groups``, which should hold a few ticks each.

    A per-source "attack" profile forces an attack pattern with moderate
    confidence; sources in phase 2 or 3 get the neutral verdict.
    """
    out = asof_lookup(flows, _verdict_columns(verdicts), ["scope"], left_ts="ts", right_ts="tick_ts", cols=list(NEUTRAL), width_s=slice_s / groups)
    return _settled_verdict(out, profile, phase)


def attach_tea_by_tick(flows: DataFrame, verdicts: DataFrame, tick: str = "tick_ts", *, profile: str | None = None, phase: str | None = None) -> DataFrame:
    """The same where every flow's tick has a verdict of its own: a plain equi-join with one row per tick."""
    return _settled_verdict(flows.join(_verdict_columns(verdicts).withColumnRenamed("tick_ts", tick), ["scope", tick], "left"), profile, phase)


def confidence_lock(results: DataFrame, order: Sequence[str], *, slice_s: float, dealt: bool = False) -> DataFrame:
    """Per source, an anomaly reports the best (confidence, class) seen so far.

    A result replaces the lock when its confidence is at least the locked one,
    so the lock is the running maximum of (confidence, position): a scan, not a
    fold. Normal results neither set the lock nor read it. ``dealt`` as in
    :func:`floodwatch.plans.slices.prefix`.
    """
    hit = F.col("is_anomaly") == 1
    rank = F.struct(F.col("confidence").alias("c"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)],
                    F.col("attack_class").alias("k"))
    out = prefix(results, ["src_ip"], order, ts=None if dealt else "ts", width_s=slice_s, maxes={"_lock": F.when(hit, rank)}, dealt=dealt)
    return (out.withColumn("locked_confidence", F.when(hit, F.col("_lock.c")).otherwise(F.col("confidence")))
            .withColumn("locked_class", F.when(hit, F.col("_lock.k")).otherwise(F.col("attack_class"))).drop("_lock"))


def carry_prior_class(results: DataFrame, *, order_us: str = "_us", ttl_s: float = C.INFERENCE_TTL_S,
                      gate: float = C.RF_CONFIDENCE_GATE, slice_s: float = 60.0, keep_slice: bool = False) -> DataFrame:
    """Give an Uncertain result the source's confident class of the last ``ttl_s``; with ``keep_slice`` the rows stay dealt by (source, slice) for a scan to follow."""
    sure = (F.col("attack_class") != "Uncertain") & (F.col("confidence") >= gate) & (F.col("is_anomaly") == 1)
    rows = with_halo(results.withColumn(order_us, micros("ts")), "ts", ttl_s, max(slice_s, ttl_s))
    # the latest confident result before the row; a running maximum, then an age check
    back = (Window.partitionBy("src_ip", slices.SLICE).orderBy(order_us)
            .rangeBetween(Window.unboundedPreceding, -1))
    known = F.max(F.when(sure, F.struct(F.col(order_us).alias("t"), F.col("confidence").alias("c"),
                                        F.col("attack_class").alias("k")))).over(back)
    fresh = F.coalesce(F.col(order_us) - F.col("_known.t") < int(round(ttl_s * 1e6)), F.lit(False))
    use = (F.col("attack_class") == "Uncertain") & fresh & (F.col("is_anomaly") == 1)
    return (rows.withColumn("_known", known).filter(slices.OWN)
            .withColumn("carried_class", F.when(use, F.col("_known.k")).otherwise(F.col("attack_class")))
            .withColumn("carried_confidence", F.when(use, F.col("_known.c")).otherwise(F.col("confidence")))
            .drop("_known", slices.OWN, order_us, *([] if keep_slice else [slices.SLICE])))


def gate_confidence(top_class: Column, confidence: Column, gate: float = C.RF_CONFIDENCE_GATE) -> Column:
    """Class when the forest is sure enough, otherwise Uncertain; confidence is kept."""
    return F.when(confidence >= gate, top_class).otherwise("Uncertain")


TRUE_TYPES = ("SYN", "ICMP", "UDP")


def score_decisions(labelled: DataFrame, legit: Sequence[str] | None = None) -> DataFrame:
    """Per-decision 0/1 counters against ground truth.

    Anomaly stage: an anomalous row of an active attacker is a hit; a known
    legitimate host's is a false positive. Class stage: correct, misclassified
    (false positive and false negative overall, one off-diagonal cell) or
    Uncertain (false negative only); rows of MIXED or no attack are not scored.
    """
    anomalous = F.col("is_anomaly") == 1
    attacker = F.col("is_attacker")
    known_good = F.col("src_ip").isin(*legit) if legit else ~attacker
    want, got = F.col("expected_class"), lookup(F.col("attack_class"), SHORT_CLASS)
    scored = anomalous & want.isNotNull()
    right, wrong, missed = scored & (got == want), scored & got.isNotNull() & (got != want), scored & got.isNull()
    bit = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    packets = F.greatest(F.coalesce(F.col("packet_count"), F.rint("pps").cast("long")), F.lit(1))
    cols = {
        "total": packets, "threats": F.when(anomalous, packets).otherwise(0),
        "true_neg": F.when(~anomalous, packets).otherwise(0),
        "tp": bit(anomalous & attacker), "tn": bit(~anomalous & ~attacker), "fn": bit(~anomalous & attacker),
        "if_tp": bit(anomalous & attacker), "if_fp": bit(anomalous & known_good),
        "if_tn": bit(~anomalous & ~attacker), "if_fn": bit(~anomalous & attacker),
        "rf_tp": bit(right), "rf_fp": bit(wrong), "rf_fn": bit(wrong | missed), "rf_tn": F.lit(0).cast("long"),
    }
    for t in TRUE_TYPES:
        s = t.lower()
        cols[f"rf_tp_{s}"] = bit(right & (want == t))
        cols[f"rf_fp_{s}"] = F.lit(0).cast("long")
        cols[f"rf_tn_{s}"] = bit(right & (want != t))
        cols[f"rf_fn_{s}"] = bit(missed & (want == t))
    for a in TRUE_TYPES:
        for b in TRUE_TYPES:
            if a != b:
                cols[f"rf_{a.lower()}_as_{b.lower()}"] = bit(wrong & (want == a) & (got == b))
    if "fp" not in labelled.columns:
        cols["fp"] = bit(anomalous & known_good)
    return labelled.select("*", *[c.cast("long").alias(n) for n, c in cols.items()])


def baseline_lock(results: DataFrame, order: Sequence[str], *, streak: int = C.UNLOCK_STREAK,
                  slice_s: float, keys: Sequence[str] = ("scope",)) -> DataFrame:
    """Whether the traffic baselines are locked after each scored flow.

    An anomaly locks; ``streak`` consecutive normal flows unlock. So the lock
    holds iff an earlier anomaly exists with fewer than ``streak`` flows since.
    A slice says how many rows it has and which was its last anomaly; a window
    over those few adds up what lies before. The rows are shuffled once.
    """
    keys = list(keys)
    here = Window.partitionBy(*keys, slices.SLICE).orderBy(*order)
    rows = slices.with_slice(results, "ts", slice_s).withColumn("_n", F.row_number().over(here))
    rows = rows.withColumn("_last", F.max(F.when(F.col("is_anomaly") == 1, F.col("_n"))).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = Window.partitionBy(*keys).orderBy(slices.SLICE).rowsBetween(Window.unboundedPreceding, -1)
    summary = (rows.groupBy(*keys, slices.SLICE).agg(F.max("_n").alias("_rows"), F.max("_last").alias("_final"))
               .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
               .withColumn("_came", F.last(F.col("_before") + F.col("_final"), ignorenulls=True).over(earlier)))
    out = slices.null_safe_join(rows, summary.select(*keys, slices.SLICE, "_before", "_came"), [*keys, slices.SLICE])
    since = F.coalesce(F.col("_n") - F.col("_last"), F.col("_before") + F.col("_n") - F.col("_came"))
    return out.withColumn("locked_after", F.coalesce(since < streak, F.lit(False))).select(*results.columns, "locked_after")


def tick_locks(results: DataFrame, ticks: DataFrame, order: Sequence[str], *, streak: int = C.UNLOCK_STREAK) -> DataFrame:
    """Whether the baselines are locked when each tick begins: (scope, tick_ts, locked) for every row of ``ticks``.

    The same rule as :func:`baseline_lock`, told per tick: how many flows were
    scored in it, whether any was an anomaly, and where among the last ``streak``
    of them the last anomaly is. The last flows of a tick are picked by a ranking
    that Spark cuts off before the shuffle, so a tick of any size sends few rows.
    """
    unit = ["scope", "tick_ts"]
    hit = F.col("is_anomaly") == 1
    whole = results.groupBy(*unit).agg(F.count(F.lit(1)).alias("_rows"), F.max(hit).alias("_any"))
    newest = Window.partitionBy(*unit).orderBy(*[F.col(c).desc() for c in order])
    tail = (results.select(*unit, *[c for c in order if c not in unit], "is_anomaly").withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= streak)
            .groupBy(*unit).agg(F.min(F.when(hit, F.col("_r"))).alias("_near")))
    each = ticks.select(*unit).distinct().join(whole, unit, "left").join(tail, unit, "left").withColumn("_rows", F.coalesce("_rows", F.lit(0)))
    calendar = Window.partitionBy("scope").orderBy("tick_ts")
    earlier = calendar.rowsBetween(Window.unboundedPreceding, -1)
    upto = F.sum("_rows").over(calendar.rowsBetween(Window.unboundedPreceding, 0))
    # the number of the tick's last anomaly, or of a row far enough back
    each = each.withColumn("_at", F.when(F.col("_any"), upto - F.coalesce(F.col("_near") - 1, F.lit(streak))))
    since = F.sum("_rows").over(earlier) - F.last("_at", ignorenulls=True).over(earlier)
    return each.select(*unit, F.coalesce(since < streak, F.lit(False)).alias("locked"))
