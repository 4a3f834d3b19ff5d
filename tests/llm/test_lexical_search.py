"""Ranked search against scoring every document, over several shards and blocks, with ties and hot groups."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from floodwatch.llm import lexical_search as search
from tests.llm.data import empty, table, texts


def terms(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))


def brute(rows, items, k=10):
    docs = [(i, terms(t)) for i, t in rows]
    docs = [(i, len(t), Counter(t)) for i, t in docs if t]
    n_docs, n_terms = len(docs), sum(n for _, n, _ in docs)
    df = Counter(t for *_, c in docs for t in c)
    out = []
    for item, text in dict.fromkeys((i, t) for i, t in items if t is not None):
        scored = []
        for doc, n, c in docs:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def test_equals_scoring_every_document(spark):
    rows = texts(3, 220) + [(9000 + k, "Zeta alpha ALPHA the the") for k in range(60)] + [(9500, "once"), (9501, "42 é\x00É a_b")]
    rng = random.Random(2)
    items = [(k, " ".join(x.decode() for x in rng.sample(terms(rows[k][1]) or [b"a"], min(8, len(terms(rows[k][1])) or 1)))) for k in range(25)]
    items += [(100, "alpha the"), (101, "alpha alpha zeta THE"), (102, ""), (103, None), (104, "... !"), (105, "unheard of"), (106, "ONCE"), (None, "42 b"), (1, "the"), (100, "alpha the"), (107, "É é 12")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"score": F.lit("own"), "rank": F.lit(1)})
    want = brute(rows, items)
    for shard, block, parts in ((1 << 20, 1 << 20, 3), (300, 200, 7)):
        got = search.rank(table(spark, rows).repartition(parts), asked, shard_counts=shard, block_bytes=block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(tuple(r) for r in got.collect()) == want
    assert search.rank(empty(spark), asked).count() == search.rank(table(spark, rows), asked.limit(0)).count() == 0
    named = asked.select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("item_id"), "text")
    assert search.rank(table(spark, rows), named, k=3).filter("item_id = 'q100'").orderBy("rank").select("doc_id").collect() == [(9000 + k,) for k in range(3)]


def test_bounds_spare_documents():
    """Most documents are never scored, and none that belongs to the result is lost."""
    rng = np.random.default_rng(4)
    n_docs, n_terms = 4000, 80
    popular = 1 / (1 + np.arange(n_terms))
    vectors = [np.unique(rng.choice(n_terms, rng.integers(0, 15), p=popular / popular.sum())) for _ in range(n_docs)]
    doc = np.repeat(np.arange(n_docs), [len(v) for v in vectors])
    term = np.concatenate(vectors)
    tf = rng.integers(1, 4, len(term))
    m = rng.integers(50, 200, n_docs)
    tree = search.Tree(n_terms, doc, term, tf, m)
    assert (tree.hi > tree.lo).all() and sum(tree.hi - tree.lo) == len(term)
    met, scores = [0], tree.scores
    def counted(docs, weight):
        met[0] += len(docs)
        return scores(docs, weight)
    tree.scores = counted
    for k in range(40):
        asked = np.unique(rng.choice(n_terms, 6))
        weights = (np.floor(1000 * np.log(1 + asked)) + 10).astype(np.int64)
        weight = np.zeros(n_terms, np.int64)
        weight[asked] = weights
        best = search.Best(10)
        tree.search(asked, weights, best, tree.order, weight)
        total = np.bincount(doc, weight[term] * search.gain(tf, m[doc]), n_docs).astype(np.int64)
        by = np.lexsort((np.arange(n_docs), -total))[:10]
        by = by[total[by] > 0]
        assert best.ids.tolist() == by.tolist() and best.score.tolist() == total[by].tolist()
    assert met[0] < 40 * n_docs * 0.25
