"""Registered queries on the smallest tables: SQL oracles, and the pipeline stage by stage against brute force."""

import os
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from floodwatch.llm.common import read
from floodwatch.llm.queries import ORACLES, QUERIES
from tests.compare import connect, difference
from tests.llm.test_corpus import classes, prints_of
from tests.llm.test_simple import TOKENIZER, base, words

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert difference(got, connect(SMALL).execute(ORACLES[name]).df()) is None


def test_the_model_beats_the_base(spark):
    held = [r for r in QUERIES["op6_lm_score"](spark, SMALL).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_quality_agrees_with_labels(spark):
    labels = {r.doc_id: r.quality for r in read(spark, SMALL, "labels").collect()}
    rows = [r for r in QUERIES["op5_quality"](spark, SMALL).collect() if r.doc_id in labels and not r.base_failed]
    assert sum(r.kept == (labels[r.doc_id] == 1) for r in rows) >= 0.95 * len(rows)


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files")
def test_pipeline_by_stage(spark, tmp_path):
    docs, seen = read(spark, SMALL, "documents"), {}
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        if name != "bpe":
            assert docs.columns == columns
        now = {r.doc_id: r.text for r in rows} if name != "bpe" else {r.doc_id: r for r in rows}
        assert len(now) == len(rows)
        seen[name] = before, now
        before = now
    labels = {r.doc_id: r.toxic for r in read(spark, SMALL, "labels").collect()}
    was, now = seen["toxicity"]
    assert all(i in now for i in was if labels.get(i) == 0 and not re.search("(?i)idiot|scum|moron|loser|trash|clown|stupid|pathetic|worthless|disgusting", was[i] or ""))
    was, now = seen["simhash"]
    prints = {i: prints_of(t) for i, t in was.items()}
    number = classes(prints.values())
    groups = {}
    for i, p in prints.items():
        groups.setdefault(number[p], []).append(i)
    assert set(now) == {min(g) for g in groups.values()} and all(now[i] == was[i] for i in now)
    was, now = seen["decontamination"]
    windows = {tuple(w[a:a + 10]) for w in (words(r.text) for r in read(spark, SMALL, "benchmark").collect()) for a in range(max(1, len(w) - 9)) if w}
    clean = {i for i, t in was.items() if not any(tuple(w[a:a + n]) in windows for n in {len(x) for x in windows} for w in [words(t)] for a in range(len(w) - n + 1))}
    assert set(now) == clean
    was, now = seen["pii"]
    assert set(was) == set(now)
    for i in now:
        assert now[i] == was[i] if not base(was[i]) and "=" not in was[i] and "@" not in was[i] and not re.search("[0-9]{9}", was[i]) else True
        assert not [s for s in base(now[i])]
    was, now = seen["bpe"]
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(TOKENIZER)
    for i, r in now.items():
        assert np.frombuffer(r.token_ids, "<u4").tolist() == tok.encode(was[i], add_special_tokens=False).ids and r.round_trip
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()) == Counter(list(now))


def test_planted_toxic_rows_go(spark):
    docs = read(spark, SMALL, "documents")
    labels = {r.doc_id: r.toxic for r in read(spark, SMALL, "labels").collect()}
    now = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SMALL).collect()}
    planted = [i for r in docs.collect() for i in [r.doc_id] if labels.get(i) == 1 and len(re.findall("(?i)idiot|scum|moron|loser|trash|clown|stupid|pathetic|worthless|disgusting", r.text or "")) > 1]
    assert len(planted) >= 5 and not now & set(planted)
