"""Switch rules: which command applies to a packet, and where a command goes."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodwatch.operators.features import lookup
from floodwatch.plans.slices import asof_join, micros, prefix

# Rule priorities; the highest live rule of a source decides.
RULE_PRIORITY = {"block": 100, "quarantine": 90, "redirect": 85, "rate_limit": 80}
PROTO_DROP, FORWARD, PERMIT = 50, 10, 5
OUTCOME = {"block": "dropped", "quarantine": "dropped", "redirect": "redirected", "rate_limit": "limited",
           "proto_drop": "dropped", "forward": "forwarded", "permit": "forwarded"}
PERMIT_S = 10.0
#: Parts that a slice of each protocol's packets is cut into.
GROUPS = 32
#: Last microsecond of a rule that does not end, and of one that was removed.
ENDLESS, REMOVED = 2**63 - 1, -2**63


def _place(ts: str, tie: str) -> Column:
    """One number in the order of (ts, tie), nulls first: HashAggregate compares numbers in place, structs only after a sort."""
    step, first = F.lit(Decimal(2 * 10**19)), F.lit(Decimal(-(10**19 - 1)))
    at = F.coalesce(micros(ts).cast("decimal(19,0)"), F.lit(Decimal(-4 * 10**18)))
    return at * step + F.coalesce(F.col(tie).cast("decimal(19,0)"), first)


def resolve_policy(packets: DataFrame, commands: DataFrame, *, slice_s: float, unit_s: float = 1.0,
                   proto_blocks: DataFrame | None = None) -> DataFrame:
    """Rule in force for each packet.

    ``commands``: src_ip, ts, id, action, ttl. A block ends after its ttl; clear
    removes every rule of the source and permits it for ten seconds; a new
    block, quarantine or rate limit removes a redirect. Commands with a
    ``target_dpid`` (:func:`command_targets`) hold on that switch only, so a
    clear leaves the rules of the other switches. For each rule kind the
    last command that set or removed it decides, so one scan over commands and
    packets of a source yields all kinds at once and no pair is ever formed.
    """
    own = "target_dpid" in commands.columns
    keys = ["src_ip", "dpid"] if own else ["src_ip"]
    cmd = commands.select("src_ip", *([F.col("target_dpid").alias("dpid")] if own else []), F.col("ts"), F.lit(0).alias("_side"), F.col("id").alias("_tie"),
                          F.col("action").alias("_a"), F.col("ttl").alias("_ttl"), F.lit(False).alias("_is_packet"))
    pkt = packets.withColumn("_side", F.lit(1)).withColumn("_tie", F.lit(0).cast("long")).withColumn("_is_packet", F.lit(True))
    both = pkt.unionByName(cmd, allowMissingColumns=True)
    a = F.col("_a")
    removes = {"redirect": a.isin("clear", "block", "quarantine", "rate_limit")}
    last = {}
    for kind in RULE_PRIORITY:
        sets = a == kind
        touches = sets | removes.get(kind, a == "clear")
        expires = F.when(F.col("_ttl").isNotNull() & (a == "block"),
                         F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                          (F.col("_ttl") * unit_s).cast("decimal(18,6)")))
        last[f"_r_{kind}"] = F.when(touches, F.when(sets, F.coalesce(micros(expires), F.lit(ENDLESS))).otherwise(F.lit(REMOVED)))
    last["_cleared"] = F.when(a == "clear", F.col("ts"))
    rows = prefix(both, keys, ["ts", "_side", "_tie"], ts="ts", width_s=slice_s, last=last, sparse=~F.col("_is_packet"),
                  position=_place("ts", "_tie")).filter("_is_packet")
    rule: Column | None = None
    for kind in RULE_PRIORITY:   # highest first
        r = F.col(f"_r_{kind}")
        live = (r == ENDLESS) | (micros("ts") < r)
        rule = F.when(live, kind) if rule is None else rule.when(live, kind)
    if proto_blocks is not None:
        rows = asof_join(rows, proto_blocks.withColumnRenamed("on", "_pb"), ["proto"], left_ts="ts", right_ts="ts",
                         cols=["_pb"], width_s=slice_s, spread_over=GROUPS)   # a protocol has a large part of all packets
        rule = rule.when(F.coalesce(F.col("_pb"), F.lit(False)), "proto_drop")
    fresh = F.col("_cleared").isNotNull() & (
        F.col("ts") < F.col("_cleared") + F.make_dt_interval(
            F.lit(0), F.lit(0), F.lit(0), F.lit(PERMIT_S * unit_s).cast("decimal(18,6)")))
    rule = rule.when(fresh, "permit").otherwise("forward")
    return (rows.withColumn("rule", rule).withColumn("outcome", lookup(F.col("rule"), OUTCOME))
            .select(*packets.columns, "rule", "outcome"))


def policy_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("rule", "outcome").agg(F.count(F.lit(1)).alias("packets"))


def command_targets(commands: DataFrame, packets: DataFrame, *, slice_s: float) -> DataFrame:
    """(command, switch): mitigation goes to every switch, clear to the one that last saw the source.

    The switch list is one array over distinct switches (hundreds, not rows),
    read as a scalar subquery and exploded next to each command.
    """
    switches = packets.agg(F.sort_array(F.collect_set("dpid"))).scalar()
    seen = asof_join(commands, packets.select("src_ip", F.col("ts").alias("_seen"), "event_id",
                                              F.col("dpid").alias("_last")), ["src_ip"],
                     left_ts="ts", right_ts="_seen", cols=["_last"], width_s=slice_s, right_tie="event_id")
    one = F.when((F.col("action") == "clear") & F.col("_last").isNotNull(), F.array("_last")).otherwise(F.col("_all"))
    return (seen.withColumn("_all", switches)
            .select(*commands.columns, F.explode(one).alias("target_dpid")))
