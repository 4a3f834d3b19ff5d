"""Remembered SYNs under ACKs, slice by slice.

A source's SYNs are remembered in order. A SYN drops those older than the window;
an ACK drops the oldest one, if the last ACK that did so is a pause or more ago.
What is remembered is always the end of the SYN sequence, so the state is two
numbers: how many are remembered, and when an ACK last dropped one.

Between two such ACKs nothing happens that a sorted search cannot tell, so a
replay steps from one to the next. A slice is replayed in three rounds:

1. *Summary*, every (source, episode, slice) on its own: the state it leaves as a
   function of the state it is entered with. Most slices forget how they were
   entered: at a SYN by which the window has dropped at least as many as ACKs can
   have, with no ACK in the pause before it, the state is known. A slice that
   does not forget hands on its ACKs with the SYN numbers at each.
2. *Chain*: one narrow row per slice (or per some hundred ACKs of a slice that
   does not forget) is folded along the episode.
3. *Counts*, every slice on its own, from the state it is entered with.

An episode of any length thus runs in as many tasks as it has slices.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodwatch import config as C
from floodwatch.plans.slices import OWN, SLICE, null_safe_join, sorted_map, spread, whole_runs

UNIT = ["src_ip", "episode_start"]
#: ACKs in one row of a slice that does not forget.
PART = 512
NEVER = np.iinfo(np.int64).min // 2
MADE = ("n_window", "n_burst_short", "n_burst_long", "syn_active")


def drops(ack_us, ack_n, ack_low, pause: int, held: int, last: int, note=None) -> tuple[int, int]:
    """Follow ACKs in order; SYNs are numbered, ``held`` is the oldest remembered one.

    ``ack_n`` is the number of the next SYN at each ACK, ``ack_low`` the oldest one
    that the window had left there. Returns ``held`` and the time of the last drop.
    """
    i, end = 0, len(ack_us)
    while i < end:
        i = max(i, bisect_left(ack_us, last + pause, i))
        if i >= end:
            break
        held = max(held, ack_low[i])
        if held < ack_n[i]:
            held, last = held + 1, ack_us[i]
            if note is not None:
                note.append((i, held))
            i += 1
        else:                                    # nothing remembered: the first ACK behind the next SYN
            i = bisect_right(ack_n, ack_n[i], i)
    return held, last


class Frame:
    """Rows of whole (source, episode, slice) groups: SYNs numbered through, and each group's bounds."""

    def __init__(self, frame: pd.DataFrame, starts: np.ndarray, rules: C.FloodRules):
        self.window = int(round(rules.window_s * 1e6))
        self.us = frame["_us"].to_numpy(np.int64)
        kind, own = frame["_kind"].to_numpy(), frame[OWN].to_numpy(bool)
        self.t, self.group, _ = spread(self.us, starts, self.window)
        self.syn = np.flatnonzero(kind == 1)
        self.syn_t = self.t[self.syn]
        self.low = np.searchsorted(self.syn_t, self.syn_t - self.window, "left")
        seen = np.append(0, np.cumsum(kind == 1))
        self.seen = seen[1:]                     # SYNs up to and including each row
        bounds = np.append(starts, len(frame))
        self.first, self.end = seen[bounds[:-1]], seen[bounds[1:]]
        given = np.append(0, np.cumsum((kind == 1) & ~own))
        self.own = self.first + given[bounds[1:]] - given[bounds[:-1]]   # number of a group's first own SYN
        self.ack = np.flatnonzero(kind == 2)
        self.ack_at = np.searchsorted(self.ack, bounds)
        n = self.seen[self.ack]
        self.ack_n = n
        last = np.append(self.low, 0)[n - 1]
        self.ack_low = np.where(n > self.own[self.group[self.ack]], last, NEVER)   # SYNs given have done their part before

    def acks(self, g: int) -> slice:
        return slice(self.ack_at[g], self.ack_at[g + 1])

    def low_at_end(self, g: int) -> int:
        """The oldest SYN that the group's own SYNs leave."""
        return int(self.low[self.end[g] - 1]) if self.end[g] > self.own[g] else NEVER

    def settled(self, g: int, begin_us: int, pause: int) -> int | None:
        """The group's last own SYN at which the state does not depend on how the group was entered, if any.

        Any drops between two times are at most one more than those of ACKs taken as
        early as possible. So ``most`` is at least the oldest remembered SYN, and where
        the window has come as far, it alone decides.
        """
        a, b = self.own[g], self.end[g]
        part = self.acks(g)
        at, rows = self.us[self.ack[part]], self.ack[part]
        taken, last, times = [], NEVER, at.tolist()
        i = 0
        while i < len(times):
            i = max(i, bisect_left(times, last + pause, i))
            if i < len(times):
                last = times[i]
                taken.append(rows[i])
                i += 1
        row = self.syn[a:b]
        early = np.searchsorted(np.array(taken), row)
        before = np.searchsorted(rows, row)
        reach = np.maximum.accumulate(np.append(a, self.low[a:b] - early))[:-1]
        most = np.minimum(reach + early + (before > 0), np.arange(a, b))
        latest = np.append(at, NEVER)[before - 1]
        latest[before == 0] = NEVER
        free = np.maximum(latest, begin_us) <= self.us[row] - pause
        fit = np.flatnonzero((self.low[a:b] >= most) & free)
        return int(a + fit[-1]) if len(fit) else None


def _schemas(rows: DataFrame) -> tuple[T.StructType, T.StructType]:
    keys = [rows.schema[c] for c in [*UNIT, SLICE]]
    whole, longs = T.LongType(), T.ArrayType(T.LongType())
    step = [T.StructField(c, k) for c, k in (("_part", whole), ("_more", T.BooleanType()), ("_settled", T.BooleanType()), ("_held", whole), ("_last", whole),
                                             ("_n", whole), ("_low", whole), ("_us", longs), ("_ns", longs), ("_lows", longs))]
    return T.StructType(keys + step), T.StructType(keys + [T.StructField("_q", whole), T.StructField("_popped", whole)])


def _summaries(rows: DataFrame, rules: C.FloodRules) -> DataFrame:
    schema, _ = _schemas(rows)
    pause, width = int(round(rules.ack_interval_s * 1e6)), int(round(max(rules.slice_s, rules.window_s) * 1e6))

    def run(batches):
        for frame, starts in whole_runs(batches, [*UNIT, SLICE]):
            f = Frame(frame, starts, rules)
            keys = frame.iloc[starts][[*UNIT, SLICE]].reset_index(drop=True)
            out = []                             # numbers are told from the group's first own SYN
            for g, slice_no in enumerate(keys[SLICE].tolist()):
                base, part = int(f.own[g]), f.acks(g)
                n, low = int(f.end[g]) - base, f.low_at_end(g) - base
                at = f.settled(g, slice_no * width, pause) if part.stop > part.start else None
                us, ns, lows = f.us[f.ack[part]], f.ack_n[part], f.ack_low[part]
                if at is not None:
                    later = int(np.searchsorted(f.ack[part], f.syn[at]))
                    held, last = drops(us[later:].tolist(), ns[later:].tolist(), lows[later:].tolist(), pause, int(f.low[at]), NEVER)
                    out.append((g, 0, False, True, max(held - base, low), last, n, low, [], [], []))
                    continue
                cuts = range(0, max(1, len(us)), PART)
                for no, a in enumerate(cuts):
                    b = a + PART
                    out.append((g, no, b < len(us), False, 0, 0, n, low, us[a:b], np.maximum(ns[a:b] - base, 0), np.maximum(lows[a:b] - base, NEVER)))
            made = pd.DataFrame(out, columns=["_g", *[c.name for c in schema.fields[3:]]])
            yield pd.concat([keys.iloc[made.pop("_g")].reset_index(drop=True), made], axis=1)
    return sorted_map(rows, [*UNIT, SLICE], ["_us", "event_id"], run, schema)


def _entered(steps: DataFrame, rows: DataFrame, rules: C.FloodRules) -> DataFrame:
    """How many SYNs are remembered where a slice begins, and the last drop before it."""
    _, schema = _schemas(rows)
    pause = int(round(rules.ack_interval_s * 1e6))

    def run(batches):
        unit, q, last, held = None, 0, NEVER, 0
        for batch in batches:
            out = []
            for src, start, at, part, more, settled, held_, last_, n, low, us, ns, lows in batch.itertuples(index=False):
                if (src, str(start)) != unit:
                    unit, q, last = (src, str(start)), 0, NEVER
                if part == 0:
                    out.append((src, start, at, q, last))
                    held = -q
                if settled:
                    held, last = held_, last_ if last_ > NEVER else last
                else:
                    held, last = drops(us.tolist(), ns.tolist(), lows.tolist(), pause, held, last)
                if not more:
                    q = n - max(held, low)
            yield pd.DataFrame(out, columns=[f.name for f in schema.fields])
    return sorted_map(steps, UNIT, [SLICE, "_part"], run, schema)


def count_remembered(tracked: DataFrame, kept: list[str], rules: C.FloodRules) -> DataFrame:
    """Counts at every packet that is no ACK.

    ``tracked`` has SYN, ICMP, UDP and ACK packets with their episode, ``_us`` and
    ``kept``; returned are ``kept``, the counts of remembered SYNs and ``syn_active``.
    """
    width = int(round(max(rules.slice_s, rules.window_s) * 1e6))
    window, pause = int(round(rules.window_s * 1e6)), int(round(rules.ack_interval_s * 1e6))
    spans = [window, *(int(round(s * 1e6)) for s in rules.burst_windows_s)]
    home = F.floor(F.col("_us") / F.lit(float(width))).cast("long")
    late = (F.col("flood_proto") == "SYN") & (F.col("_us") >= (home + 1) * F.lit(width) - F.lit(window))
    rows = (tracked.filter(F.col("_us").isNotNull())
            .withColumn("_kind", F.when(F.col("flood_proto") == "SYN", 1).when(F.col("flood_proto") == "ACK", 2).otherwise(0))
            .withColumn("_home", home).withColumn(SLICE, F.explode(F.when(late, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))))
            .withColumn(OWN, F.col("_home") == F.col(SLICE)).drop("_home"))
    steps = _summaries(rows.select(*UNIT, SLICE, "_us", "event_id", "_kind", OWN), rules)
    ready = null_safe_join(rows.select(*kept, SLICE, "_us", "_kind", OWN), _entered(steps, rows, rules), [*UNIT, SLICE])
    schema = T.StructType([*[rows.schema[c] for c in kept], *[T.StructField(c, T.LongType()) for c in MADE[:3]], T.StructField(MADE[3], T.IntegerType())])

    def run(batches):
        for frame, starts in whole_runs(batches, [*UNIT, SLICE]):
            f = Frame(frame, starts, rules)
            q, last = frame["_q"].to_numpy(np.int64)[starts], frame["_popped"].to_numpy(np.int64)[starts]
            held = np.zeros(len(frame), np.int64)
            held[starts] = np.maximum(f.own - q, f.first)    # older ones lie before every span
            for g in np.flatnonzero(np.diff(f.ack_at)).tolist():
                part, note = f.acks(g), []
                drops(f.us[f.ack[part]].tolist(), f.ack_n[part].tolist(), f.ack_low[part].tolist(), pause, int(f.own[g] - q[g]), int(last[g]), note)
                if note:
                    at, number = np.array(note).T
                    held[f.ack[part][at]] = np.maximum(number, f.first[g])
            held = np.maximum.accumulate(held)
            counts = {name: f.seen - np.maximum(held, np.searchsorted(f.syn_t, f.t - span, "left")) for name, span in zip(MADE, spans)}
            counts[MADE[3]] = (counts[MADE[0]] > 0).astype(np.int32)
            which = frame[OWN].to_numpy(bool) & (frame["_kind"].to_numpy() != 2)
            yield pd.concat([frame[kept], pd.DataFrame(counts)], axis=1)[which]
    return sorted_map(ready, [*UNIT, SLICE], ["_us", "event_id"], run, schema)
