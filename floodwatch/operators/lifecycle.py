"""Per-source mitigation lifecycle as a keyed fold over ordered events.

Events of a source (prefilter trips, scored results, holds, operator actions,
earlier offences) drive it through quarantine, time ban, blackhole and sinkhole.
Deadlines fire on a tick grid, as a once-a-tick sweep would fire them: before an
event is applied, every sweep up to its time has run.

A dominating source is made small before the fold, not inside it. Results that
share a tick see the same deadlines, so of each run of results in a tick only
the first anomaly and the last result can matter on their own; the rest act
through a maximum, a first and last confidence and the last rise in confidence.
:func:`compact_results` computes those in Spark, and the fold sees at most four
rows per source and tick, however many results there were. The fold itself
streams: it holds one source's scalars at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections import namedtuple
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from floodwatch import config as C
from floodwatch.plans.slices import micros, sorted_map

# Event kinds in the order they apply at one instant.
RANK = {"history": 0, "trip": 1, "result": 2, "bulk": 2, "hold": 3, "release": 4, "block": 5}
HOLDING = "Holding (unscored"

EVENT_FIELDS = (
    ("src_ip", T.StringType()), ("us", T.LongType()), ("rank", T.IntegerType()), ("id", T.LongType()),
    ("kind", T.StringType()), ("correlated", T.BooleanType()), ("reason", T.StringType()),
    ("if_score", T.DoubleType()), ("anomalies", T.LongType()), ("attack_class", T.StringType()),
    ("confidence", T.DoubleType()), ("pps", T.DoubleType()), ("risen_class", T.StringType()),
    ("last_confidence", T.DoubleType()), ("ban_level", T.LongType()), ("offence_count", T.LongType()),
)
EVENT_COLUMNS = [n for n, _ in EVENT_FIELDS]


def _events(df: DataFrame, kind: str | Column, ts: str, **cols: Column) -> DataFrame:
    kind_col = F.lit(kind) if isinstance(kind, str) else kind
    have = {"us": micros(ts), "kind": kind_col, "rank": F.lit(RANK.get(kind, 0)) if isinstance(kind, str) else cols.pop("rank"), **cols}
    return df.select(*[(have.get(n, F.col(n) if n in ("src_ip", "id") else F.lit(None)).cast(t)).alias(n) for n, t in EVENT_FIELDS])


def result_events(results: DataFrame, ts: str = "ts") -> DataFrame:
    """Scored flows; a flow that is no anomaly carries no class and no confidence."""
    hit = F.col("is_anomaly") == 1
    return _events(results, "result", ts, if_score=F.coalesce("if_score", F.lit(0.0)), anomalies=hit.cast("long"),
                   attack_class=F.when(hit, F.col("attack_class")).otherwise("Normal"),
                   confidence=F.when(hit, F.col("confidence")).otherwise(0.0), pps=F.coalesce("pps", F.lit(0.0)),
                   last_confidence=F.when(hit, F.col("confidence")).otherwise(0.0))


def trip_events(trips: DataFrame, ts: str = "trip_ts") -> DataFrame:
    return _events(trips, "trip", ts, correlated=F.col("correlated"))


def hold_events(holds: DataFrame, ts: str = "ts") -> DataFrame:
    reason = F.col("reason") if "reason" in holds.columns else F.lit("queue_timeout")
    return _events(holds, "hold", ts, reason=reason)


def manual_events(actions: DataFrame, ts: str = "ts") -> DataFrame:
    """``action`` is release or block."""
    rank = F.when(F.col("action") == "release", RANK["release"]).otherwise(RANK["block"])
    return _events(actions, F.col("action"), ts, rank=rank)


def history_events(history: DataFrame, ts: str = "unblocked_at") -> DataFrame:
    """Offences recorded before the replayed period."""
    return _events(history, "history", ts, ban_level=F.coalesce("ban_level", F.lit(0)), offence_count=F.coalesce("offence_count", F.lit(0)))


def compact_results(events: DataFrame, rules: C.LifecycleRules = C.LifecycleRules()) -> DataFrame:
    """Replace runs of results within a tick by their combined effect; lossless for the fold.

    Window partitions are one source within one tick. The last window's order is
    the one that the aggregate needs.
    """
    cell = F.floor(F.col("us") / F.lit(rules.tick_s * rules.unit_s * 1e6)).cast("long")
    at = F.struct("us", "rank", "id")
    tick = Window.partitionBy("src_ip", "_cell").orderBy("us", "rank", "id")
    is_result = F.col("kind") == "result"
    rows = (events.withColumn("_cell", cell)
            .withColumn("_run", F.sum((~is_result).cast("int")).over(tick.rowsBetween(Window.unboundedPreceding, 0))))
    run = Window.partitionBy("src_ip", "_cell", "_run", "kind")
    hit = F.col("anomalies") > 0
    rows = (rows.withColumn("_first", F.min(F.when(hit, at)).over(run)).withColumn("_last", F.max(at).over(run)))
    alone = ~is_result | (at == F.col("_last")) | F.coalesce(at == F.col("_first"), F.lit(False))
    part = F.when(F.col("_first").isNull() | (at < F.col("_first")), "before").otherwise("between")
    # a row that stays alone is a group of its own; the rest of a run falls into two groups
    rows = (rows.withColumn("_own", F.when(alone, at)).withColumn("_part", F.when(alone, "own").otherwise(part))
            .withColumn("_hit", hit))
    ordered = Window.partitionBy("src_ip", "_cell", "_run", "_part", "_own", "_hit").orderBy("us", "rank", "id")
    rows = rows.withColumn("_rise", F.col("_hit") & (F.col("confidence") > F.lag("confidence").over(ordered)))
    single = F.col("_part") == "own"
    on_hit = F.when(F.col("_hit"), at)
    merged = {
        "kind": F.max(F.when(single, F.col("kind")).otherwise("bulk")), "if_score": F.max("if_score"),
        "anomalies": F.sum("anomalies"),
        "attack_class": F.min_by("attack_class", F.when(single, at).otherwise(on_hit)),
        "confidence": F.min_by("confidence", F.when(single, at).otherwise(on_hit)),
        "risen_class": F.max_by("attack_class", F.when(~single & F.col("_rise"), at)),
        "last_confidence": F.max_by("confidence", F.when(single, at).otherwise(on_hit)),
        # what only a single row carries
        **{n: F.max(F.when(single, F.col(n))) for n in ("correlated", "reason", "pps", "ban_level", "offence_count")},
    }
    out = (rows.groupBy("src_ip", "_cell", "_run", "_part", "_own")
           .agg(F.max(at).alias("p"), *[c.alias(n) for n, c in merged.items()]))
    have = {"us": F.col("p.us"), "rank": F.col("p.rank"), "id": F.col("p.id")}
    return out.select(*[have.get(n, F.col(n)).cast(t).alias(n) for n, t in EVENT_FIELDS])


# --- the fold ---------------------------------------------------------------


@dataclass
class Tracked:
    """One tracked source; times in microseconds."""

    phase: int
    entered: int
    first_seen: int
    session: str
    vector: str = "Uncertain"
    score: float = 0.0
    confidence: float = 0.0
    priority: str = "Low"
    action: str = "Quarantined"
    until: int | None = None
    pinned: bool = False          # permanent manual block
    ban_level: int = 0
    offences: int = 0
    pps: float = 0.0
    hold_flags: int = 0
    rescored: bool = False
    logged_entry: int | None = None


@dataclass
class Watched:
    """One sinkholed source."""

    entered: int
    session: str
    vector: str
    score: float
    confidence: float
    pps: float = 0.0


@dataclass
class Memory:
    """Everything a source carries between events; a few dozen scalars."""

    src_ip: str
    now: int | None = None
    seq: int = 0
    state: Tracked | None = None
    sink: Watched | None = None
    sink_us: int = 0
    holds: int = 0
    weight: float = 0.0
    weight_us: int = 0
    last_ban: int = 0
    last_count: int = 0
    top_ban: int = 0
    total: int = 0

    def dump(self) -> dict:
        return asdict(self)

    @classmethod
    def load(cls, saved: dict) -> "Memory":
        saved = dict(saved)
        saved["state"] = Tracked(**saved["state"]) if saved["state"] else None
        saved["sink"] = Watched(**saved["sink"]) if saved["sink"] else None
        return cls(**saved)


OUT_FIELDS = (
    ("src_ip", T.StringType()), ("us", T.LongType()), ("seq", T.LongType()), ("row", T.StringType()),
    ("from_phase", T.StringType()), ("to_phase", T.StringType()), ("action", T.StringType()),
    ("event_type", T.StringType()), ("reason", T.StringType()), ("is_manual", T.LongType()),
    ("command", T.StringType()), ("ttl", T.LongType()), ("redirect_to", T.StringType()),
    ("attack_vector", T.StringType()), ("if_score", T.DoubleType()), ("confidence", T.DoubleType()),
    ("priority", T.StringType()), ("ban_level", T.LongType()), ("offence_count", T.LongType()),
    ("first_seen_us", T.LongType()), ("session_id", T.StringType()), ("phase", T.LongType()),
    ("in_ledger", T.BooleanType()), ("offence_recorded", T.BooleanType()), ("hold_outcome", T.StringType()),
    ("hold_count", T.LongType()), ("until_us", T.LongType()), ("pps", T.DoubleType()),
)
OUT_SCHEMA = T.StructType([T.StructField(n, t) for n, t in OUT_FIELDS])
OUT_COLUMNS = [n for n, _ in OUT_FIELDS]
BLANK = dict.fromkeys(OUT_COLUMNS) | {"row": "event", "event_type": "transition", "is_manual": 0, "in_ledger": False, "offence_recorded": False, "hold_count": 0}
values_of = itemgetter(*OUT_COLUMNS)
LABEL = {1: "Quarantined", 2: "Time Ban", 3: "Blackhole"}


def ban_label(seconds: int) -> str:
    return f"{seconds // 60}m" if seconds >= 60 else f"{seconds}s"


class Lifecycle:
    """Applies events to a source's memory and collects output rows."""

    def __init__(self, rules: C.LifecycleRules):
        self.rules = rules
        self.unit = rules.unit_s * 1e6
        self.tick = max(1, int(round(rules.tick_s * self.unit)))
        self.phase1 = {priority: self.span(s) for priority, s in rules.phase1_s.items()}
        self.observe = self.span(rules.sinkhole_observe_s)
        self.clears = [self.span(s) for s in sorted(rules.clear_all_at)]
        self.out: list[dict] = []
        self.m: Memory = Memory("")

    # small helpers

    def span(self, seconds: float) -> int:
        return int(round(seconds * self.unit))

    def reputation(self, at: int) -> float:
        m = self.m
        if m.weight == 0.0:
            return 0.0
        half_lives = (at - m.weight_us) / self.unit / self.rules.half_life_s
        return min(round(m.weight * 0.5 ** half_lives, 4), C.REPUTATION_CAP)

    def banished(self, at: int) -> bool:
        return self.reputation(at) >= C.BLACKHOLE_REPUTATION

    def offend(self, at: int, ban_level: int, count: int) -> None:
        m = self.m
        if m.weight:
            m.weight *= 0.5 ** ((at - m.weight_us) / self.unit / self.rules.half_life_s)
        m.weight, m.weight_us = m.weight + C.OFFENCE_WEIGHT, at
        m.last_ban, m.last_count, m.top_ban, m.total = ban_level, count, max(m.top_ban, ban_level), m.total + 1

    def rank(self, at: int, score: float, confidence: float, vector: str, pps: float) -> str:
        bonus = (C.VECTOR_SEVERITY.get(vector, C.DEFAULT_SEVERITY) - 0.5) * 0.5
        volume = min(0.15, math.log10(pps / 10) * 0.05) if pps > 10 else 0.0
        total = min(1.0, score * confidence + bonus + volume + min(0.2, self.reputation(at) * 0.02))
        return next((name for name, bound in C.PRIORITY_TIERS if total >= bound), "Low")

    def session(self, at: int) -> str:
        return hashlib.sha256(f"{self.m.src_ip}|{at}".encode()).hexdigest()[:12]

    def where(self) -> str:
        return LABEL[self.m.state.phase] if self.m.state else "Sinkhole" if self.m.sink else "None"

    def say(self, at: int, before: str, who: Tracked | Watched | None, **more) -> None:
        m = self.m
        whose = {}
        if isinstance(who, Tracked):
            whose = {"attack_vector": who.vector, "if_score": who.score, "confidence": who.confidence, "session_id": who.session, "pps": who.pps,
                     "priority": who.priority, "ban_level": who.ban_level, "offence_count": who.offences, "first_seen_us": who.first_seen, "phase": who.phase}
        elif who is not None:
            whose = {"attack_vector": who.vector, "if_score": who.score, "confidence": who.confidence, "session_id": who.session, "pps": who.pps,
                     "priority": "Low", "ban_level": 0, "offence_count": 0, "first_seen_us": who.entered}
        self.out.append({**BLANK, "src_ip": m.src_ip, "us": at, "seq": m.seq, "from_phase": before, "to_phase": self.where(), **whose, **more})
        m.seq += 1

    # transitions

    def track(self, at: int, phase: int, **more) -> Tracked:
        self.m.state = Tracked(phase=phase, entered=at, first_seen=at, session=self.session(at), **more)
        return self.m.state

    def sinkhole(self, at: int, before: str, vector: str, score: float, confidence: float) -> None:
        if self.m.sink is not None:
            return
        self.m.sink = Watched(at, self.session(at), vector, score, confidence)
        self.say(at, before, self.m.sink, action="Sinkhole", command="redirect", redirect_to=C.SINKHOLE_IP, in_ledger=True)

    def divert(self, at: int) -> None:
        """Quarantine gives way to the sinkhole; the episode counts as an offence."""
        s, before = self.m.state, self.where()
        self.offend(at, s.ban_level, s.offences)
        self.m.state = None
        self.say(at, before, s, action="Diverted", reason="Unresolved after quarantine - escalated to sinkhole", offence_recorded=True)
        self.sinkhole(at, before, s.vector, s.score, s.confidence)

    def ban(self, at: int, reason: str) -> None:
        s, before = self.m.state, self.where()
        s.ban_level = min(s.ban_level + 1, len(self.rules.ban_s) - 1)
        seconds = self.rules.ban_s[s.ban_level]
        s.offences = min(s.offences + 1, self.rules.offence_cap)
        s.phase, s.entered, s.action, s.until = 2, at, "Time Ban", at + self.span(seconds)
        self.offend(at, s.ban_level, s.offences)
        self.say(at, before, s, action=f"Time Ban ({ban_label(seconds)})", reason=reason, command="block", ttl=seconds,
                 in_ledger=True, offence_recorded=True)

    def blackhole(self, at: int, before: str) -> None:
        s, seconds = self.m.state, self.rules.blackhole_s
        s.offences = min(s.offences + 1, self.rules.offence_cap)
        s.phase, s.entered, s.action, s.until = 3, at, "Blackhole", at + self.span(seconds)
        self.offend(at, s.ban_level, s.offences)
        self.say(at, before, s, action="Blackhole", reason="Escalated to Blackhole", command="block", ttl=seconds,
                 in_ledger=True, offence_recorded=True)

    def release(self, at: int, reason: str, *, record: bool = True, count: int | None = None) -> None:
        s, before = self.m.state, self.where()
        if record:
            self.offend(at, s.ban_level, s.offences if count is None else count)
        self.m.state = None
        self.say(at, before, s, action="Released", event_type="released", reason=reason, command="clear",
                 in_ledger=True, offence_recorded=record)

    def reoffend(self, at: int, score: float, vector: str, confidence: float, ban_level: int, count: int) -> None:
        before, top = self.where(), len(self.rules.ban_s) - 1
        facts = dict(vector=vector, score=score, confidence=confidence, priority=self.rank(at, score, confidence, vector, 0.0))
        if self.banished(at):
            self.track(at, 3, ban_level=min(ban_level + 1, top), offences=count, **facts)
            self.blackhole(at, before)
            return
        s = self.track(at, 1, ban_level=ban_level, offences=count + 1, **facts)
        self.say(at, before, s, action="Quarantined", reason=f"Re-offence #{s.offences}", command="rate_limit", in_ledger=True)

    def detect_new(self, at: int, score: float, vector: str, confidence: float) -> None:
        before = self.where()
        tier = self.rank(at, score, confidence, vector, 0.0)
        facts = dict(vector=vector, score=score, confidence=confidence, priority=tier)
        if self.banished(at):
            self.track(at, 3, **facts)
            self.blackhole(at, before)
        elif self.m.top_ban > 0:
            self.reoffend(at, score, vector, confidence, self.m.top_ban, self.m.total)
        elif tier == "High":
            seconds = self.rules.ban_s[1]
            s = self.track(at, 2, action="Time Ban", ban_level=1, offences=1, until=at + self.span(seconds), **facts)
            self.say(at, before, s, action=f"Time Ban ({ban_label(seconds)})", reason="high priority detection", command="block",
                     ttl=seconds, in_ledger=True)
        else:
            s = self.track(at, 1, **facts)
            self.say(at, before, s, action="Quarantined", reason="detection", command="rate_limit")

    def evidence(self, at: int, count: int, vector: str, confidence: float, risen: str | None, last: float) -> None:
        """Anomalous results of an existing state; the score is already in it."""
        s = self.m.state
        if s.pinned:
            return
        if s.action.startswith(HOLDING):
            s.rescored = True
            self.say(at, self.where(), s, row="hold", action=s.action, hold_outcome="rescored", hold_count=count)
        if confidence > s.confidence:
            s.vector = vector
        if risen is not None:
            s.vector = risen
        s.confidence = last
        if s.phase != 3 and self.banished(at):
            self.blackhole(at, self.where())

    # events

    def on_trip(self, at: int, correlated: bool) -> None:
        m = self.m
        if m.sink is not None:
            return
        if m.state is not None:
            if correlated and m.state.phase == 1 and m.state.action == "Quarantined":
                self.divert(at)
            return
        if correlated:
            self.sinkhole(at, "None", "Uncertain", 0.0, 0.0)
        else:
            s = self.track(at, 1)
            self.say(at, "None", s, action="Quarantined", reason="prefilter trip", command="rate_limit", in_ledger=True)

    def on_result(self, at: int, e) -> None:
        m = self.m
        if m.sink is not None:
            m.sink.pps, m.sink.confidence = e.pps, e.confidence
            m.sink.score = max(m.sink.score, e.if_score)
        s = m.state
        if s is not None:
            s.score, s.pps = max(s.score, e.if_score), e.pps
            vector, confidence = s.vector, s.confidence
            if s.phase == 1 and e.confidence > confidence:
                vector, confidence = e.attack_class, e.confidence
            s.priority = self.rank(at, s.score, confidence, vector, e.pps)
        if not e.anomalies:
            return
        if s is not None:
            self.evidence(at, 1, e.attack_class, e.confidence, None, e.confidence)
        elif m.last_ban > 0:
            self.reoffend(at, e.if_score, e.attack_class, e.confidence, m.last_ban, m.last_count)
        else:
            self.detect_new(at, e.if_score, e.attack_class, e.confidence)
        s = m.state
        if s is not None and s.logged_entry != s.entered:
            s.logged_entry = s.entered
            self.say(at, self.where(), s, row="detected", action=s.action, event_type="detected", in_ledger=True)

    def on_bulk(self, at: int, e) -> None:
        """Results whose rate and priority a later result of the same tick replaces."""
        m = self.m
        if m.sink is not None:
            m.sink.score = max(m.sink.score, e.if_score)
        if m.state is not None:
            m.state.score = max(m.state.score, e.if_score)
            if e.anomalies:
                self.evidence(at, int(e.anomalies), e.attack_class, e.confidence, e.risen_class, e.last_confidence)

    def on_hold(self, at: int, reason: str) -> None:
        m, before = self.m, self.where()
        if m.state is not None and m.state.pinned:
            return
        m.holds += 1
        s = m.state or self.track(at, 2)
        s.phase, s.entered, s.action = 2, at, f"{HOLDING}, {reason})"
        s.until, s.hold_flags, s.rescored = at + self.span(self.rules.hold_s), m.holds, False
        self.say(at, before, s, action=s.action, reason=reason, command="rate_limit", ttl=int(self.rules.hold_s),
                 in_ledger=True, hold_outcome="held", hold_count=1)

    def on_release(self, at: int) -> None:
        m, before = self.m, self.where()
        if m.state is not None:
            s, m.state = m.state, None
            self.offend(at, s.ban_level, s.offences)
            self.say(at, before, s, action="Manual Release", event_type="manual", reason="Manual Release", is_manual=1,
                     command="clear", in_ledger=True, offence_recorded=True)
        elif m.sink is not None:
            w, m.sink, m.sink_us = m.sink, None, 0
            self.say(at, before, w, action="Released", event_type="released", reason="manual release", is_manual=1,
                     command="clear", in_ledger=True)

    def on_block(self, at: int) -> None:
        before = self.where()
        s = self.m.state or self.track(at, 3)
        s.phase, s.entered, s.action, s.until, s.pinned = 3, at, "Blackhole", None, True
        self.say(at, before, s, action="Manual Block", event_type="manual", is_manual=1, command="block", in_ledger=True)

    def on_clear_all(self, at: int) -> None:
        s = self.m.state
        if s is not None and not s.pinned:
            before, self.m.state = self.where(), None
            self.say(at, before, s, action="Cleared", command="clear")

    # deadlines

    def due(self) -> int | None:
        """When the next sweep that finds something to do runs."""
        m, end = self.m, None
        if m.state is not None:
            end = m.state.entered + self.phase1[m.state.priority] if m.state.phase == 1 else m.state.until
        if m.sink is not None:
            left = m.sink.entered + self.observe
            end = left if end is None else min(end, left)
        if end is None:
            return None
        return max(-(-end // self.tick), m.now // self.tick + 1) * self.tick

    def sweep(self, at: int) -> None:
        m, s, rules = self.m, self.m.state, self.rules
        m.now = at
        # who is due is settled before anything moves; the sinkhole is swept second
        watched = m.sink
        if s is not None and s.phase == 1 and at - s.entered >= self.phase1[s.priority]:
            hot, busy = s.score >= rules.threshold, s.pps > rules.active_pps
            if not (hot and busy):
                self.release(at, "Attack Stopped")
            elif s.vector == "Uncertain" and s.confidence < rules.sinkhole_confidence:
                self.divert(at)
            elif self.banished(at):
                self.blackhole(at, self.where())
            else:
                self.ban(at, "Attack persisted - escalating to time ban")
        elif s is not None and s.phase == 2 and s.until is not None and at >= s.until:
            held = s.action.startswith(HOLDING)
            if held:
                self.say(at, self.where(), s, row="hold", action=s.action, hold_outcome="expired_unscored", hold_count=1)
            near = s.score > 0 and s.score >= rules.threshold * rules.near_factor
            if s.pps > rules.active_pps and near:
                if self.banished(at):
                    self.blackhole(at, self.where())
                else:
                    self.ban(at, "Escalated to Time Ban")
            else:
                self.release(at, "Ban Expired", record=not held or s.rescored, count=1)
        elif s is not None and s.phase == 3 and s.until is not None and at >= s.until:
            self.release(at, "Blackhole TTL Expired")
        if watched is not None and at - watched.entered >= self.observe:
            self.judge(at, watched)

    def judge(self, at: int, w: Watched) -> None:
        m, rules = self.m, self.rules
        m.sink = None
        m.sink_us += at - w.entered
        busy, sure = w.pps > rules.active_pps, w.confidence >= rules.sinkhole_confidence
        if busy and (sure or m.sink_us >= self.span(rules.sinkhole_total_s)):
            m.sink_us = 0
            if m.state is None:
                self.detect_new(at, w.score, w.vector, w.confidence)
            elif not m.state.pinned:
                m.state.score = max(m.state.score, w.score)
                self.evidence(at, 1, w.vector, w.confidence, None, w.confidence)
        else:
            self.say(at, "Sinkhole", w, action="Released", event_type="released", command="clear", in_ledger=True,
                     reason="confidence unresolved" if busy else "traffic stopped")

    def advance(self, to: int) -> None:
        """Run every sweep up to and including ``to``."""
        while True:
            at = self.due()
            if at is None or at > to:
                return
            self.sweep(at)

    def apply(self, e) -> None:
        at = int(e.us)
        for c in self.clears:
            if (self.m.now is None or self.m.now < c) and c <= at and self.m.now is not None:
                self.advance(c)
                self.on_clear_all(c)
                self.m.now = max(self.m.now, c)
        if self.m.now is None:
            self.m.now = at
        self.advance(at)
        self.m.now = max(self.m.now, at)
        if e.kind == "result":
            self.on_result(at, e)
        elif e.kind == "bulk":
            self.on_bulk(at, e)
        elif e.kind == "trip":
            self.on_trip(at, bool(e.correlated))
        elif e.kind == "hold":
            self.on_hold(at, e.reason or "unscored")
        elif e.kind == "release":
            self.on_release(at)
        elif e.kind == "block":
            self.on_block(at)
        elif e.kind == "history":
            self.offend(at, int(e.ban_level or 0), int(e.offence_count or 0))

    def finish(self) -> None:
        """Fire what is due until ``as_of`` and report the state left."""
        m, rules = self.m, self.rules
        end = None if rules.as_of is None else self.span(rules.as_of)
        for c in self.clears:
            if m.now is not None and m.now < c and (end is None or c <= end):
                self.advance(c)
                self.on_clear_all(c)
                m.now = c
        if end is not None and m.now is not None:
            self.advance(end)
        at = m.now or 0
        if m.state is not None:
            s = m.state
            self.say(at, LABEL[s.phase], s, row="state", action=s.action, until_us=s.until, hold_count=s.hold_flags)
        if m.sink is not None:
            self.say(at, "Sinkhole", m.sink, row="state", action="Sinkhole", phase=0)


def frame_of(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=OUT_COLUMNS)
    for name, t in OUT_FIELDS:
        if isinstance(t, T.LongType):
            out[name] = out[name].astype("Int64")
        elif isinstance(t, T.DoubleType):
            out[name] = out[name].astype("float64")
    return out


Event = namedtuple("Event", EVENT_COLUMNS)


def events_of(batch: pa.RecordBatch) -> Iterator[Event]:
    """A batch's rows; a number that is missing is NaN, as in pandas, and other gaps are None."""
    columns = []
    for name in EVENT_COLUMNS:
        values = batch.column(name)
        if pa.types.is_string(values.type):     # few different ones, or runs of the same
            words = values.dictionary_encode()
            known = np.array([*words.dictionary.to_pylist(), None], dtype=object)
            columns.append(known[words.indices.fill_null(len(known) - 1).to_numpy()].tolist())
        elif pa.types.is_boolean(values.type):
            columns.append(values.to_pylist())
        else:
            columns.append(values.to_numpy(zero_copy_only=False).tolist())
    return map(Event._make, zip(*columns))


def mitigation_lifecycle(events: DataFrame, rules: C.LifecycleRules = C.LifecycleRules(), *,
                         compact: bool = True) -> DataFrame:
    """Replay the lifecycle of every source; one shuffle by source after compaction."""
    rows = compact_results(events, rules) if compact else events.select(*EVENT_COLUMNS)

    out_schema = to_arrow_schema(OUT_SCHEMA)

    def batch_of(found: list[dict]) -> pa.RecordBatch:
        columns = zip(*map(values_of, found))
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

    def fold(batches):
        machine, current = Lifecycle(rules), None
        for batch in batches:
            for e in events_of(batch):
                if e.src_ip != current:
                    if current is not None:
                        machine.finish()
                    current, machine.m = e.src_ip, Memory(e.src_ip)
                machine.apply(e)
            if machine.out:
                yield batch_of(machine.out)
                machine.out = []
        if current is not None:
            machine.finish()
            if machine.out:
                yield batch_of(machine.out)

    return sorted_map(rows, ["src_ip"], ["us", "rank", "id"], fold, OUT_SCHEMA, arrow=True)


# --- views of the output ----------------------------------------------------


def when(us: str = "us") -> Column:
    return F.timestamp_micros(F.col(us)).cast("timestamp_ntz")


def ledger_rows(rows: DataFrame) -> DataFrame:
    """Rows for mitigation_events."""
    phase = F.when(F.col("action") == "Released", F.col("from_phase")).otherwise(F.col("to_phase"))
    return (rows.filter("in_ledger").select(
        "src_ip", when().alias("timestamp"), F.col("seq").alias("id"), F.lit("DDoS").alias("predicted_class"), "attack_vector", "confidence",
        "priority", F.col("action").alias("action_taken"), "if_score", phase.alias("phase"), "is_manual", "event_type", "reason", "session_id"))


def commands(rows: DataFrame) -> DataFrame:
    """Commands for the switches, in order per source."""
    return rows.filter(F.col("command").isNotNull()).select(
        when().alias("ts"), "src_ip", F.col("seq").alias("id"), F.col("command").alias("action"), "ttl", "redirect_to")


def offence_rows(rows: DataFrame) -> DataFrame:
    """Rows for ip_attack_history."""
    return rows.filter("offence_recorded").select(
        "src_ip", F.col("seq").alias("id"), "attack_vector", "if_score", "confidence", "priority", F.col("phase").alias("phase_reached"),
        when("first_seen_us").alias("first_seen"), when().alias("unblocked_at"), "ban_level", "offence_count", F.col("reason").alias("unblock_reason"))


def live_states(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("row") == "state")


def hold_stats(rows: DataFrame) -> DataFrame:
    n = lambda k: F.coalesce(F.sum(F.when(F.col("hold_outcome") == k, F.col("hold_count"))), F.lit(0)).alias(k)
    return rows.agg(n("held"), n("rescored"), n("expired_unscored"))


def hold_outcomes(rows: DataFrame) -> DataFrame:
    """Holds, their re-scorings and expiries as counters at their own times, for the traffic summary."""
    n = lambda k: F.when(F.col("hold_outcome") == k, F.col("hold_count")).otherwise(0).cast("long").alias(k)
    return rows.filter(F.col("hold_outcome").isNotNull()).select(when().alias("ts"), n("held"), n("rescored"), n("expired_unscored"))
