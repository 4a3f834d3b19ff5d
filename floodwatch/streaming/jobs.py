"""Structured Streaming forms of the operators.

Times must be TIMESTAMP (not TIMESTAMP_NTZ) to carry a watermark. The stateful
operators are folds, so order matters: their rows wait in the key's state until
the watermark has passed them and are then applied in order of time
(:class:`InOrder`), however files or partitions arrive. A row behind the
watermark is late. Spark drops it and counts it in the query's progress
(``numRowsDroppedByWatermark``) if it is behind the watermark of the batch before;
one between the two watermarks is left out here, and reported as ``late`` by the
lifecycle. State is keyed by source (or dedup key),
bounded by the rows of one watermark delay and one window or a few dozen
scalars per key, and timers are in event time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from floodwatch import config as C
from floodwatch.operators.lifecycle import EVENT_COLUMNS, OUT_SCHEMA, Lifecycle, Memory, frame_of
from floodwatch.operators.metrics import COUNTERS
from floodwatch.operators.prefilter import counted_packets
from floodwatch.operators.tea import METRICS, START, Baselines, flow_shape, verdict_rows, verdict_schema
from floodwatch.plans.slices import micros
from floodwatch.session import checkpoint_dir

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Applies a fold to a key's rows in order of time, whatever order they arrive in.

    Rows wait as Arrow batches in a list state, one entry for each arrival, until the watermark has
    passed the first of them; then those it has passed are applied. Subclasses say what a key
    remembers (``start``, ``load``, ``dump`` to JSON values), how rows are applied, and
    when there is something to do without a row (``due``, in microseconds).
    """

    order: list[str]          # the first is a column of microseconds
    columns: list[str]        # of the results
    names: list[str]          # of the rows

    def start(self, key):
        return None

    def load(self, saved, key):
        return saved

    def dump(self, memory):
        return memory

    def due(self, memory) -> int | None:
        return None

    def late(self, key, rows: pd.DataFrame) -> list:
        """Results for rows behind what has been applied; by default such rows are left out."""
        return []

    def apply(self, key, memory, rows: pd.DataFrame | None, mark: int) -> tuple[object, list]:
        raise NotImplementedError

    def init(self, handle) -> None:
        self.handle = handle
        self.wait = handle.getListState("wait", T.StructType([T.StructField("rows", T.BinaryType())]))
        self.memory = handle.getValueState("memory", T.StructType([T.StructField("blob", T.StringType())]))
        # the first waiting row, and up to where rows have been applied
        self.first = handle.getValueState("first", T.StructType([T.StructField("us", T.LongType())]))
        self.done = handle.getValueState("done", T.StructType([T.StructField("us", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        frames = [f for f in rows if len(f)]
        us, missed = self.order[0], []
        if frames:
            came = pd.concat(frames, ignore_index=True)
            came.columns = self.names        # Spark names columns anew that are no plain identifiers
            if self.done.exists():
                behind = came[us] < self.done.get()[0]
                missed, came = self.late(key[0], came[behind]) if behind.any() else [], came[~behind].reset_index(drop=True)
            if len(came):
                self.wait.appendValue((pack(came),))
                lowest = int(came[us].min())
                self.first.update((min(lowest, self.first.get()[0]) if self.first.exists() else lowest,))
        return self._run(key, timerValues.getCurrentWatermarkInMs() * 1000, missed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return self._run(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def _run(self, key, mark: int, missed: list = ()):
        us, ready = self.order[0], None
        if self.first.exists() and self.first.get()[0] < mark:
            wait = pd.concat([unpack(entry[0]) for entry in self.wait.get()], ignore_index=True).sort_values(self.order, kind="stable", ignore_index=True)
            cut = int((wait[us] < mark).sum())
            ready, rest = wait.iloc[:cut], wait.iloc[cut:].reset_index(drop=True)
            self.wait.clear()
            self.first.clear()
            if len(rest):
                self.wait.appendValue((pack(rest),))
                self.first.update((int(rest[us].iloc[0]),))
        memory = self.load(json.loads(self.memory.get()[0]), key[0]) if self.memory.exists() else self.start(key[0])
        memory, found = self.apply(key[0], memory, ready, mark)
        if missed:
            found = [*missed, *found]
        saved = self.dump(memory)
        self.done.update((mark,))
        if saved is None:
            self.memory.clear()
            if not self.first.exists():
                self.done.clear()        # nothing is known of the key any more, so nothing can be out of order
        else:
            self.memory.update((json.dumps(saved),))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        soon = [t for t in (self.first.get()[0] if self.first.exists() else None, self.due(memory)) if t is not None]
        if soon:
            self.handle.registerTimer(max(min(soon) // 1000 + 1, mark // 1000 + 1))
        yield self.result(found)

    def result(self, found: list) -> pd.DataFrame:
        return pd.DataFrame(found, columns=self.columns)


def pack(frame: pd.DataFrame) -> bytes:
    out = pa.BufferOutputStream()
    table = pa.Table.from_pandas(frame, preserve_index=False)
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def unpack(blob: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(blob).read_all().to_pandas()


def folded(rows: DataFrame, key: str, fold: InOrder, schema: T.StructType) -> DataFrame:
    """Run a fold per key. List state and timers need the RocksDB store, which is set for the queries started from here on."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    fold.names = rows.columns
    return rows.groupBy(key).transformWithStateInPandas(fold, schema, "Append", "EventTime")


def traffic_summary_stream(decisions: DataFrame, *, width: str = "5 seconds", delay: str = "10 seconds") -> DataFrame:
    """Counter sums per flush window; append once the watermark passes the window."""
    have = set(decisions.columns)
    sums = [F.sum(c if c in have else F.lit(0)).cast("long").alias(c) for c in COUNTERS]
    out = (decisions.withWatermark("ts", delay).groupBy(F.window("ts", width)).agg(*sums)
           .withColumn("timestamp", F.col("window.start")).drop("window"))
    return out.filter(F.greatest(*[F.col(c) for c in COUNTERS]) > 0)


def tick_moments_stream(flows: DataFrame, *, tick: str = "500 milliseconds", delay: str = "5 seconds") -> DataFrame:
    """Variances and protocol entropy per (scope, tick) from two chained aggregates.

    The first level has one row per protocol and is combined map-side; the
    second merges their counts, means and variances about the common mean (a
    tick has at most 256 protocols).
    """
    rows = flow_shape(flows).withWatermark("ts", delay)
    shapes = ("size_x", "intensity_x")
    fine = rows.groupBy("scope", F.window("ts", tick), "ip_proto").agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[f(c).alias(f"{a}_{c}") for c in shapes for a, f in (("m", F.avg), ("v", F.var_pop))])
    total = F.sum("n")
    merged = fine.groupBy("scope", "window").agg(
        F.collect_list(F.struct("n", *[f"{a}_{c}" for c in shapes for a in "mv"])).alias("parts"), total.alias("n"),
        *[(F.sum(F.col("n") * F.col(f"m_{c}")) / total).alias(f"mean_{c}") for c in shapes],
        (F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("proto_entropy"))

    def variance(c: str):
        return F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["n"] * (p[f"v_{c}"] + F.pow(p[f"m_{c}"] - F.col(f"mean_{c}"), F.lit(2)))) / F.col("n")

    return merged.select("scope", F.col("window.start").alias("tick_ts"), variance("size_x").alias("size_var"), variance("intensity_x").alias("intensity_var"),
                         "proto_entropy", F.col("n").cast("long").alias("flows"))


class Verdicts(InOrder):
    """Memory of a scope: the baselines' arrays and the tick before."""

    order = ["us"]

    def __init__(self, columns: list[str]):
        self.columns = columns

    def start(self, key):
        return START

    def load(self, saved, key):
        mean, var, head, last = saved
        arrays = [np.array([np.nan if x is None else x for x in a]) for a in (mean, var)]
        return Baselines(*arrays, tuple(np.array(x) for x in head)), None if last is None else np.array(last)

    def dump(self, memory):
        base, last = memory
        return [[None if np.isnan(x) else x for x in base.mean], base.var.tolist(), [x.tolist() for x in base.head], None if last is None else last.tolist()]

    def apply(self, key, memory, rows, mark):
        if rows is None:
            return memory, []
        states = {key: memory}
        return_rows = verdict_rows(rows.assign(scope=key), states)
        return states[key], return_rows

    def result(self, found):
        return found if isinstance(found, pd.DataFrame) else pd.DataFrame(found, columns=self.columns)


def tea_verdict_stream(snapshots: DataFrame, *, delay: str = "5 seconds") -> DataFrame:
    """Verdict per tick from a stream of snapshots (as written by :func:`floodwatch.operators.tea.tea_snapshot`), in order of time.

    A column ``locked`` says whether learning is held at the tick.
    """
    kept = ["scope", "tick_ts", *METRICS, "unique_ips", *(["locked"] if "locked" in snapshots.columns else [])]
    rows = snapshots.select(*kept, micros("tick_ts").alias("us")).withWatermark("tick_ts", delay)
    schema = verdict_schema(snapshots)
    return folded(rows, "scope", Verdicts(schema.names), schema).withColumn("is_flash_crowd", F.lit(False))


class TtlDedupe(InOrder):
    """Memory: time of the last kept row."""

    order = ["_us", "id"]

    def __init__(self, columns: list[str], gap: int):
        self.columns, self.gap = columns, gap

    def apply(self, key, last, rows, mark):
        keep = []
        for us in [] if rows is None else rows["_us"].tolist():
            fresh = last is None or us - last > self.gap
            last = us if fresh else last
            keep.append(fresh)
        out = rows.loc[keep, self.columns] if rows is not None else []
        return (None if last is None or last + self.gap < mark else last), out

    def due(self, last):
        return None if last is None else last + self.gap


def ttl_dedupe_stream(events: DataFrame, *, ttl_s: float = 10.0, delay: str = "10 seconds") -> DataFrame:
    """Keep an event, drop repeats of its key within ``ttl_s`` of the kept one."""
    key = F.concat_ws("|", "src_ip", F.format_number(F.round(F.coalesce("if_score", F.lit(0.0)), 4), 4),
                      "action_taken", F.coalesce("phase", F.lit("")))
    rows = events.withColumn("_key", key).withColumn("_us", micros("timestamp")).withWatermark("timestamp", delay)
    return folded(rows, "_key", TtlDedupe(events.columns, int(round(ttl_s * 1e6))), events.schema)


TRIP_SCHEMA = T.StructType([
    T.StructField("src_ip", T.StringType()), T.StructField("flood_proto", T.StringType()),
    T.StructField("trip_us", T.LongType()), T.StructField("event_id", T.LongType()),
    T.StructField("reason", T.StringType()), T.StructField("correlated", T.BooleanType())])


class Trips(InOrder):
    """Memory: packet times of one window per protocol, the latched protocols and the last packet time."""

    order = ["_us", "event_id"]
    columns = [f.name for f in TRIP_SCHEMA]

    def __init__(self, rules: C.FloodRules):
        self.rules = rules
        self.window, self.idle = int(round(rules.window_s * 1e6)), int(round(rules.idle_s * 1e6))
        self.bursts = [(s, int(round(s * 1e6))) for s in rules.burst_windows_s]

    def start(self, key):
        return {"times": {}, "latched": [], "last": None, "multi": False}

    def due(self, seen):
        return None if seen["last"] is None else seen["last"] + self.idle

    def dump(self, seen):
        return None if seen["last"] is None else seen

    def reason(self, proto: str, times: list[int], us: int) -> str | None:
        rules = self.rules
        if len(times) >= rules.limits[proto]:
            return f"limit={len(times)}>={rules.limits[proto]} in {rules.window_s}s"
        for seconds, reach in self.bursts:
            n = sum(t >= us - reach for t in times)
            if n >= rules.burst_limit(proto):
                return f"burst={n}>={rules.burst_limit(proto)} in {seconds}s"
        return None

    def apply(self, key, seen, rows, mark):
        found = []
        for us, event, proto in () if rows is None else zip(rows["_us"].tolist(), rows["event_id"].tolist(), rows["flood_proto"]):
            if seen["last"] is not None and us - seen["last"] > self.idle:
                seen = self.start(key)
            seen["last"] = us
            times = [t for t in seen["times"].get(proto, []) if t >= us - self.window] + [us]
            # a latched protocol only needs to be known as active
            seen["times"][proto] = times[-1:] if proto in seen["latched"] else times
            reason = self.reason(proto, times, us) if proto not in seen["latched"] else None
            if reason is not None:
                seen["latched"].append(proto)
            if proto in seen["latched"]:
                active = sum(bool(t) and t[-1] >= us - self.window for t in seen["times"].values())
                seen["multi"] = seen["multi"] or active >= C.MULTI_VECTOR_PROTOCOLS
            if reason is not None:
                found.append((key, proto, us, event, reason, seen["multi"]))
        return (self.start(key) if seen["last"] is not None and seen["last"] + self.idle < mark else seen), found


def flood_trips_stream(packets: DataFrame, rules: C.FloodRules = C.FloodRules(), *, delay: str = "2 seconds") -> DataFrame:
    """First trip per (source, protocol) and episode, once the watermark has passed the packet.

    Once all of a source's protocols are latched its packets only move the last
    time, so a flood in progress keeps no growing memory beyond the rows that wait.
    """
    rows = counted_packets(packets).withColumn("_us", micros("ts")).withWatermark("ts", delay)
    return folded(rows.select("src_ip", "ts", "_us", "event_id", "flood_proto"), "src_ip", Trips(rules), TRIP_SCHEMA)


class Mitigation(InOrder):
    """The lifecycle's own memory; due sweeps fire when the watermark passes them, with no further event of the source."""

    order = ["us", "rank", "id"]

    def __init__(self, rules: C.LifecycleRules):
        self.rules = rules

    def start(self, key):
        return Memory(key)

    def load(self, saved, key):
        return Memory.load(saved)

    def dump(self, memory):
        return memory.dump()

    def due(self, memory):
        machine = Lifecycle(self.rules)
        machine.m = memory
        return machine.due()

    def apply(self, key, memory, rows, mark):
        machine = Lifecycle(self.rules)
        machine.m = memory
        for e in () if rows is None else rows.itertuples(index=False):
            machine.apply(e)
        if machine.m.now is not None and mark - 1 > machine.m.now:
            machine.advance(mark - 1)     # an event at the watermark itself may still come
        return machine.m, machine.out

    def late(self, key, rows):
        return [{"src_ip": key, "us": int(us), "row": "late", "action": kind} for us, kind in zip(rows["us"], rows["kind"])]

    def result(self, found):
        return frame_of(found)


def lifecycle_stream(events: DataFrame, rules: C.LifecycleRules = C.LifecycleRules(), *, delay: str = "5 seconds") -> DataFrame:
    """The mitigation lifecycle with event-time timers; the same fold as in batch."""
    rows = (events.select(*EVENT_COLUMNS).withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", delay))
    return folded(rows, "src_ip", Mitigation(rules), OUT_SCHEMA)


def write_batches(stream: DataFrame, name: str, write: Callable[[DataFrame, int], None], *,
                  fallback_dir: str | None = None, once: bool = False) -> StreamingQuery:
    """Run ``write(batch, batch_id)`` per micro-batch with its checkpoint in the shared folder."""
    folder = checkpoint_dir(stream.sparkSession, fallback_dir)
    writer = (stream.writeStream.queryName(name).option("checkpointLocation", f"{folder.rstrip('/')}/{name}")
              .outputMode("append").foreachBatch(write))
    return (writer.trigger(availableNow=True) if once else writer).start()
