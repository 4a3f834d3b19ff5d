"""Language identification: exact sums over segmentations, the fit, held-out accuracy and awkward tables."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodwatch.llm import language
from floodwatch.llm.common import read
from floodwatch.llm.queries import QUERIES, TOKENIZERS
from floodwatch.llm.toxicity import held_out
from tests.llm.data import table, texts

SMALL = "/root/testdata/sf0.001"
PARTS = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b" a", b" ab", b"bc", b"the", b" the", b"\n ", "é".encode(), b"aaaa"]


def brute(word: bytes, p: dict[bytes, float], counts=None) -> float:
    """Sum over all segmentations, one by one; ``counts`` gets the posterior-weighted pieces."""
    def ways(at):
        if at == len(word):
            yield 1.0, ()
        for k in range(1, len(word) - at + 1):
            if word[at:at + k] in p:
                for q, rest in ways(at + k):
                    yield p[word[at:at + k]] * q, (word[at:at + k], *rest)
    found = list(ways(0))
    total = sum(q for q, _ in found)
    for q, parts in found if counts is not None else ():
        for x in parts:
            counts[x] = counts.get(x, 0) + q / total
    return total


def test_forward_sums_and_posterior_counts_equal_all_segmentations():
    rng = random.Random(5)
    vocabulary = language.Vocabulary(PARTS)
    logp = np.log(np.random.default_rng(1).dirichlet(np.ones(len(PARTS)), 3)).T
    words = ["".join(rng.choice("abcthe é") for _ in range(rng.randint(1, 9))).strip() or "a" for _ in range(60)] + ["x", "aaaaaaaa"]
    got = language.word_scores(words, vocabulary, logp)
    lang, times = np.arange(len(words)) % 3, np.arange(len(words)) + 1.0
    want = [{} for _ in range(3)]
    for w, row, k, n in zip(words, got, lang, times):
        for j in range(3):
            counts = {} if j == k else None
            total = brute(b" " + w.encode(), {x: math.exp(logp[i, j]) for i, x in enumerate(PARTS)}, counts)
            assert math.isclose(row[j], math.log(total), rel_tol=1e-12)
            for x, c in (counts or {}).items():
                want[k][x] = want[k].get(x, 0) + n * c
    counts = language.expected(words, times, lang, vocabulary, logp) * language.UNIT
    for k in range(3):
        assert all(math.isclose(counts[k, i], want[k].get(x, 0), abs_tol=0.02) for i, x in enumerate(PARTS))
    long_ = language.word_scores(["a" * 40_000], vocabulary, logp)
    assert np.isfinite(long_).all()
    # sums too small for doubles, and words too long, are taken in logarithms: the same numbers
    tiny = np.full((len(PARTS), 1), -60.0)
    words = ["xyxy", "x" * 20, "x" * 63, "x" * 64, "x" * 200, "the"]
    assert np.allclose(language.word_scores(words, vocabulary, tiny)[:5, 0], [-60.0 * (len(w) + 1) for w in words[:5]], rtol=1e-12)
    got = language.expected(words, np.ones(6), np.zeros(6, int), vocabulary, tiny) * language.UNIT
    assert math.isclose(got[0, ord("x")], 2 + 20 + 63 + 64 + 200, rel_tol=1e-3) and math.isclose(got[0, PARTS.index(b" the")], 1, rel_tol=1e-3)
    with pytest.raises(ValueError):
        language.Vocabulary(PARTS + [b"a b"])
    with pytest.raises(ValueError):
        language.Vocabulary(PARTS[1:])


def test_awkward_tables(spark):
    rows = texts()
    df = table(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "b").when(F.col("doc_id") % 3 == 1, "a")).repartition(5)
    model = language.learn(df, PARTS, ~held_out("doc_id", 4, 2))
    again = language.learn(df.repartition(2), PARTS, ~held_out("doc_id", 4, 2))
    assert model.langs == ["a", "b"] and (model.logp == again.logp).all() and np.allclose(np.exp(model.logp).sum(0), 1)
    got = language.predict(df, model)
    assert set(df.columns) - {"score"} < set(got.columns) and got.columns[-2:] == ["lang_pred", "score"]
    rows_out = got.collect()
    assert len(rows_out) == len(rows)
    for r in rows_out:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1 and r.kept == "own kept"
        assert r.score >= 0.5 if letters else r.score == 0
    by_text = {}
    for r in rows_out:
        assert by_text.setdefault(r.text, (r.lang_pred, r.score)) == (r.lang_pred, r.score)
    nothing = language.learn(df.filter("false"), PARTS, F.lit(True))
    assert nothing.langs == [] and {r.lang_pred for r in language.predict(df, nothing).collect()} == {"und"}
    assert language.predict(df.filter("false"), model).count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL) or not os.path.isdir(TOKENIZERS), reason="test tables are not here")
def test_held_out_accuracy(spark):
    want = {r.doc_id: r.lang for r in read(spark, SMALL, "documents").collect()}
    held = [r for r in QUERIES["op13_language"](spark, SMALL).collect() if r.held_out]
    assert len(held) > 30 and sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.97 * len(held)
