import math
import random
import re

import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from floodwatch import config as C
from floodwatch.operators import lifecycle as L
from tests import lifecycle_model as M

US = 1_000_000
CLASSES = ["SYN Flood", "ICMP Flood", "UDP Flood", "Uncertain"]


def as_rows(src, events):
    out = []
    for i, (t, kind, e) in enumerate(events):
        row = dict.fromkeys(L.EVENT_COLUMNS)
        row.update(src_ip=src, us=int(round(t * US)), rank=L.RANK[kind], id=i, kind=kind)
        if kind == "result":
            hit = e["hit"]
            row.update(if_score=e["score"], anomalies=int(hit), attack_class=e["vector"] if hit else "Normal",
                       confidence=e["conf"] if hit else 0.0, pps=e["pps"], last_confidence=e["conf"] if hit else 0.0)
        elif kind == "trip":
            row.update(correlated=e["both"])
        elif kind == "history":
            row.update(ban_level=e["level"], offence_count=e["count"])
        elif kind == "hold":
            row.update(reason="queue_timeout")
        out.append(row)
    return out


NAMES = {"expired_unscored": "expired", "held": "held", "rescored": "rescored"}


def told(rows):
    """Output rows in the model's terms."""
    out = []
    for r in sorted(rows, key=lambda r: r["seq"]):
        t, action = r["us"] / US, r["action"]
        level = None if pd.isna(r["ban_level"]) else int(r["ban_level"])
        count = None if pd.isna(r["offence_count"]) else int(r["offence_count"])
        if r["row"] == "hold":
            out += [(t, NAMES[r["hold_outcome"]], None, None)] * int(r["hold_count"])
        elif r["row"] == "event":
            if action.startswith("Time Ban"):
                out.append((t, "Ban", level, count))
            elif action.startswith("Holding"):
                out.append((t, "held", None, None))
            elif action == "Released":
                out.append((t, "Unsunk", None, None) if r["from_phase"] == "Sinkhole" else (t, "Released", level, None))
            elif action in ("Blackhole", "Quarantined"):
                out.append((t, action, level, count))
            elif action == "Manual Release":
                out.append((t, action, level, None))
            else:
                out.append((t, action, None, None))
    return out


def fold(events, until):
    machine = L.Lifecycle(C.LifecycleRules(as_of=until))
    machine.m = L.Memory("10.0.0.6")
    rows = sorted(as_rows("10.0.0.6", events), key=lambda r: (r["us"], r["rank"], r["id"]))
    for e in pd.DataFrame(rows, columns=L.EVENT_COLUMNS).itertuples(index=False):
        machine.apply(e)
    machine.finish()
    return [r for r in machine.out if r["row"] in ("event", "hold")]


def ordered(events):
    return sorted(events, key=lambda x: (x[0], M.ORDER[x[1]]))


def check(events, until=5000.0):
    events = ordered(events)
    assert told(fold(events, until)) == M.run(events, until)


result = st.fixed_dictionaries({"score": st.sampled_from([0.3, 0.48, 0.5, 0.61, 0.8, 0.95]), "hit": st.booleans(),
                                "vector": st.sampled_from(CLASSES), "conf": st.sampled_from([0.3, 0.6, 0.69, 0.7, 0.9]),
                                "pps": st.sampled_from([0.0, 1.0, 1.5, 10.0, 500.0])})
event = st.one_of(
    st.tuples(st.just("result"), result), st.tuples(st.just("result"), result), st.tuples(st.just("result"), result),
    st.tuples(st.just("trip"), st.fixed_dictionaries({"both": st.booleans()})),
    st.tuples(st.just("hold"), st.just({})), st.tuples(st.just("release"), st.just({})), st.tuples(st.just("block"), st.just({})))


@settings(max_examples=250, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0.0, 0.25, 0.5, 1.0, 3.0, 9.75, 31.0, 61.0, 700.0]), event), max_size=40))
def test_fold_equals_simulation(steps):
    t, events = 1000.0, []
    for gap, (kind, e) in steps:
        t += gap
        events.append((t, kind, e))
    check(events, t + 4000)


def hit(score=0.8, vector="SYN Flood", conf=0.9, pps=50.0):
    return {"score": score, "hit": True, "vector": vector, "conf": conf, "pps": pps}


MISS = {"score": 0.3, "hit": False, "vector": "Uncertain", "conf": 0.0, "pps": 0.0}


@pytest.mark.parametrize("events,actions", [
    ([(0.0, "trip", {"both": False})], ["Quarantined", "Released"]),
    ([(0.0, "trip", {"both": True})], ["Sinkhole", "Unsunk"]),
    ([(0.0, "result", hit(0.8, "SYN Flood", 0.9)), (1.0, "result", MISS)], ["Quarantined", "Released"]),
    ([(0.0, "result", hit(0.62, "SYN Flood", 0.75))], ["Ban", "Released"]),
    ([(0.0, "result", hit(0.62, "Uncertain", 0.5)), (1.0, "result", hit(0.62, "Uncertain", 0.5))], ["Quarantined", "Diverted", "Sinkhole", "Unsunk"]),
    ([(0.0, "hold", {})], ["held", "expired", "Released"]),
    ([(0.0, "block", {}), (5.0, "result", hit())], ["Manual Block"]),
    ([(0.0, "trip", {"both": False}), (2.0, "release", {})], ["Quarantined", "Manual Release"]),
])
def test_paths(events, actions):
    events = [(1000 + t, k, e) for t, k, e in events]
    check(events)
    assert [a for _, a, *_ in told(fold(ordered(events), 5000.0))] == actions


def test_sixth_recent_offence_blackholes():
    """Five offences decay just under the cap of ten; the sixth reaches it."""
    for n, phase in ((5, "Quarantined"), (6, "Blackhole")):
        past = [(1000.0 + 60 * i, "history", {"level": 1, "count": 1}) for i in range(n)]
        events = [*past, (2000.0, "result", hit())]
        check(events)
        assert told(fold(events, 2000.0))[0][1] == phase


def test_sinkhole_ceiling_after_three_cycles():
    events = []
    for start in (1000.0, 1040.0, 1080.0):
        events += [(start, "trip", {"both": True}), (start + 1, "result", {**MISS, "score": 0.7, "pps": 5.0})]
    check(events)
    assert [a for _, a, *_ in told(fold(events, 1200.0))][:6] == ["Sinkhole", "Unsunk", "Sinkhole", "Unsunk", "Sinkhole", "Quarantined"]


def random_events(rng, n):
    t, out = 1000.0, []
    for _ in range(n):
        t += rng.choice([0.0, 0.1, 0.2, 0.3, 1.0, 5.0, 40.0])
        kind = rng.choice(["result"] * 12 + ["trip", "hold", "release", "block"] if rng.random() < 0.98 else ["block"])
        e = {"both": rng.random() < 0.4} if kind == "trip" else {}
        if kind == "result":
            e = {"score": rng.choice([0.3, 0.5, 0.62, 0.9]), "hit": rng.random() < 0.5, "vector": rng.choice(CLASSES),
                 "conf": rng.choice([0.4, 0.65, 0.7, 0.8, 0.95]), "pps": rng.choice([0.0, 2.0, 40.0])}
        out.append((round(t, 3), kind, e))
    return out


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(5)
    per = {f"10.9.0.{i}": ordered(random_events(rng, 60)) for i in range(40)}
    rows = [r for src, ev in per.items() for r in as_rows(src, ev)]
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(n, t) for n, t in L.EVENT_FIELDS])
    df = spark.createDataFrame([tuple(r[n] for n in L.EVENT_COLUMNS) for r in rows], schema)
    return per, df


def collected(df):
    out = {}
    for r in df.filter("row IN ('event', 'hold')").toPandas().to_dict("records"):
        out.setdefault(r["src_ip"], []).append(r)
    return {src: told(rows) for src, rows in out.items()}


def test_compaction_changes_nothing(spark, many):
    per, df = many
    rules = C.LifecycleRules(as_of=9000.0)
    whole = collected(L.mitigation_lifecycle(df, rules, compact=False))
    small = L.compact_results(df, rules)
    assert small.count() < df.count()

    def merged(log):
        # repeated rescored notes of one tick carry the time of their last row once merged
        return [x if x[1] != "rescored" else (math.floor(x[0]), *x[1:]) for x in log]

    compacted = collected(L.mitigation_lifecycle(df, rules))
    for src, events in per.items():
        model = M.run(events, 9000.0)
        assert whole.get(src, []) == model
        assert merged(compacted.get(src, [])) == merged(model)


def test_shuffled_stream_equals_batch(spark, many, tmp_path):
    """Events come in any order within the watermark's delay; a closing event of another source lets the watermark pass all of them."""
    from floodwatch.streaming.jobs import lifecycle_stream
    _, df = many
    parts = tmp_path / "events"
    for i in range(3):
        df.filter(F.pmod(F.hash("us", "id"), F.lit(3)) == i).coalesce(1).write.parquet(str(parts / f"p{i}"))
    end = df.agg(F.max("us")).first()[0]
    last = df.limit(1).withColumns({"src_ip": F.lit("closing"), "us": F.lit(end + 3 * 86_400_000_000), "kind": F.lit("trip"), "rank": F.lit(1), "id": F.lit(-1).cast("long")})
    last.coalesce(1).write.parquet(str(parts / "p8"))
    behind = df.limit(1).withColumns({"src_ip": F.lit("closing"), "us": F.lit(end).cast("long"), "kind": F.lit("trip"), "rank": F.lit(1), "id": F.lit(-2).cast("long")})
    behind.coalesce(1).write.parquet(str(parts / "p9"))
    stream = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
              .parquet(str(parts)))
    out = lifecycle_stream(stream, delay="1 day")
    q = (out.writeStream.format("memory").queryName("life").option("checkpointLocation", str(tmp_path / "cp"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    whole = spark.table("life").filter("src_ip <> 'closing'")
    mark = end + 2 * 86_400_000_000
    batch = L.mitigation_lifecycle(df, C.LifecycleRules(as_of=mark / 1e6), compact=False).filter(f"row <> 'state' AND us < {mark}")
    assert collected(whole) == collected(batch)


def test_views(spark, many):
    _, df = many
    rows = L.mitigation_lifecycle(df, C.LifecycleRules(as_of=9000.0)).cache()
    sent = L.commands(rows).toPandas()
    assert set(sent["action"]) <= {"rate_limit", "block", "redirect", "clear"}
    assert (sent.loc[sent["action"] == "redirect", "redirect_to"] == C.SINKHOLE_IP).all()
    stats = L.hold_stats(rows).first()
    assert stats["held"] > 0 and L.offence_rows(rows).count() > 0 and L.ledger_rows(rows).count() > 0
    rows.unpersist()


def test_compaction_sorts_its_rows_three_times(spark):
    """The last window leaves the order that the aggregate groups by."""
    rows = [("10.0.0.%d" % (i % 3), i * 300_000, 2, i, "result", i % 4 == 0) for i in range(40)]
    events = spark.createDataFrame(rows, "src_ip string, us long, rank int, id long, kind string, hit boolean").select(
        *[(F.col(n) if n in ("src_ip", "us", "rank", "id", "kind") else {"anomalies": F.col("hit").cast("long"), "if_score": F.lit(0.5), "confidence": F.lit(0.9)}.get(n, F.lit(None))).cast(t).alias(n)
          for n, t in L.EVENT_FIELDS])
    plan = L.compact_results(events)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bSort \[src_ip#", plan)) == 3


def test_events_are_read_as_pandas_reads_them():
    """Words that repeat, empty ones and gaps; numbers that are missing are NaN."""
    some = {"src_ip": ["a", "a", None, ""], "us": [1, 2, 3, None], "kind": ["result", "hold", None, "result"], "correlated": [True, None, False, None], "if_score": [0.5, None, 1.0, 2.0]}
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
    batch = pa.RecordBatch.from_arrays([pa.array(some.get(n, [None] * 4), types[t.simpleString()]) for n, t in L.EVENT_FIELDS], names=L.EVENT_COLUMNS)
    got = list(L.events_of(batch))
    assert [e.src_ip for e in got] == ["a", "a", None, ""] and [e.kind for e in got] == ["result", "hold", None, "result"]
    assert [e.us for e in got[:3]] == [1, 2, 3] and math.isnan(got[3].us) and math.isnan(got[1].if_score)
    assert [e.correlated for e in got] == [True, None, False, None] and [e.reason for e in got] == [None] * 4
